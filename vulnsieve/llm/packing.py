"""Packing token runs into sequences of fixed size by patterns of few documents.

Only the histogram of lengths, at most ``capacity`` numbers, reaches the driver.  There the
patterns of lengths that fill a sequence get repeat counts by non-negative least squares;
the counts are rounded, the patterns are filled with real lengths, and what is left is packed
by best fit into open space.  The plan says which copies of which length go where, in runs, so
its size does not depend on the number of documents; Spark hands every piece its place.
"""

from __future__ import annotations

import json
import math
import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vulnsieve.llm.bpe import PATTERN, byte_of_char
from vulnsieve.llm.common import slices, small_batches, whole_text, written

PIECE_TYPES = "piece int, start long, length long, ids_crc32 long, ids binary"
ROWS_TOGETHER = 1_000  # texts that a task hands its worker at a time
BLANKS = re.compile(r"(?<!\s)\s{1000}")


class _Library:
    """Ids as the tokenizers library gives them.

    Texts go whole to the library tiktoken under the same vocabulary, which takes a fifth of the time
    and less than looking their words up; that needs ids in the order of the merges, else tokenizers
    is asked once for every word not met before.
    """

    CACHED = 50_000
    LONG = 100_000  # tiktoken fails on a million blanks in a row; no text of this length has them

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import tiktoken
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        self.tool.no_truncation()
        self.tool.no_padding()
        self.special = [t.content for t in self.tool.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        made = [model["vocab"][m.replace(" ", "") if isinstance(m, str) else "".join(m)] for m in model["merges"]]
        self.plain = self._by_words
        if made == sorted(made):
            to_byte = byte_of_char()
            ranks = {bytes(to_byte[c] for c in token): n for token, n in model["vocab"].items()}
            ask = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            self.plain = lambda texts: [array("I", ask(t)).tobytes() for t in texts]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tool.encode_batch_fast(texts, add_special_tokens=False)]

    def _by_words(self, texts: list[str]) -> list[bytes]:
        """No token goes on over a blank that follows a word, so texts are cut there and equal parts
        are encoded once; texts with blanks in a row are encoded whole.
        """
        out: list = [None] * len(texts)
        whole = [i for i, t in enumerate(texts) if "  " in t or "\0" in t]
        for i, ids in zip(whole, self._whole([texts[i] for i in whole])):
            out[i] = ids
        cut = {i: t.replace(" ", "\0 ").split("\0") for i, t in enumerate(texts) if out[i] is None}
        wanted = set().union(*cut.values())
        missing = list(wanted.difference(self.known))
        if len(self.known) + len(missing) > self.CACHED:
            self.known.clear()
            missing = list(wanted)
        self.known.update(zip(missing, self._whole(missing)))
        for i, parts in cut.items():
            out[i] = b"".join(map(self.known.__getitem__, parts))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids (little-endian machines) of every text; those with special tokens, and long ones
        with a thousand blanks in a row, are left to tokenizers."""
        odd = [any(s in t for s in self.special) or len(t) > self.LONG and bool(BLANKS.search(t)) for t in texts]
        whole = iter(self._whole([t for t, o in zip(texts, odd) if o]))
        plain = iter(self.plain([t for t, o in zip(texts, odd) if not o]))
        return [next(whole if o else plain) for o in odd]


_LIBRARIES: dict[str, _Library] = {}


def library(path: str) -> _Library:
    if path not in _LIBRARIES:
        _LIBRARIES[path] = _Library(path)
    return _LIBRARIES[path]


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048,
           end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """``id_col, piece, start, length, ids_crc32[, ids]``: every document's ids and ``end_id``, cut.

    Only documents of more than ``capacity`` ids are cut, into pieces of ``capacity``; the first
    may be shorter.  A null text counts as empty: its one piece is the end alone.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    end = end_id.to_bytes(4, "little")

    def run(batches):
        tool = library(tokenizer_path)
        for batch in batches:
            for first, last in slices(batch, "_text", 250_000):
                rows = []
                texts = batch.column(1).slice(first, last - first).to_pylist()
                for row, ids in enumerate(tool.encode(texts), first):
                    ids += end
                    n = len(ids) // 4
                    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        part = ids[4 * a:4 * b]
                        rows.append((row, i, a, b - a, zlib.crc32(part), part if with_ids else None))
                at, piece, start, length, crc, own = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(own, pa.binary())],
                    [id_col, "piece", "start", "length", "ids_crc32", "ids"])

    out = docs.select(F.col(id_col), whole_text(text_col).alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, {PIECE_TYPES}")
    return out if with_ids else out.drop("ids")


def nnls(a: np.ndarray, b: np.ndarray, rounds: int) -> np.ndarray:
    """Least squares ``|a x - b|`` over x >= 0 by active sets."""
    x = np.zeros(a.shape[1])
    active = np.zeros(a.shape[1], bool)
    gram, target = a.T @ a, a.T @ b
    ridge = 1e-9 * float(np.trace(gram)) / max(1, len(gram))
    tolerance = 1e-6 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(rounds):
        slope = target - gram @ x
        slope[active] = -np.inf
        j = int(slope.argmax())
        if slope[j] <= tolerance:
            break
        active[j] = True
        while True:
            at = np.flatnonzero(active)
            z = np.linalg.solve(gram[np.ix_(at, at)] + ridge * np.eye(len(at)), target[at])
            if (z > 0).all():
                x[:] = 0
                x[at] = z
                break
            bad = z <= 0
            ratio = x[at][bad] / np.maximum(x[at][bad] - z[bad], 1e-300)
            x[at] += min(1.0, float(ratio.min())) * (z - x[at])
            x[x < tolerance] = 0
            active &= x > 0
            if not active.any():
                break
    return x


def patterns(levels: int, most: int = 3) -> list[tuple[int, ...]]:
    """Falling sequences of at most ``most`` levels that add up to ``levels``."""
    def grow(left: int, limit: int, n: int):
        if left == 0:
            yield ()
        elif n:
            for first in range(min(left, limit), (left - 1) // n, -1):
                for rest in grow(left - first, first, n - 1):
                    yield (first, *rest)
    return list(grow(levels, levels, most))


class _Counts:
    """How many pieces of each length are still to be placed."""

    def __init__(self, histogram: dict[int, int]):
        self.left = dict(histogram)
        self.sorted = sorted(self.left)

    def longest(self, low: int, high: int, used: dict[int, int]) -> int | None:
        """The longest length in ``low … high`` of which more are left than ``used``."""
        at = bisect_left(self.sorted, high + 1) - 1
        while at >= 0 and self.sorted[at] >= low:
            length = self.sorted[at]
            if self.left[length] > used.get(length, 0):
                return length
            at -= 1
        return None

    def take(self, length: int, n: int) -> None:
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]
            self.sorted.pop(bisect_left(self.sorted, length))


def plan(histogram: dict[int, int], capacity: int = 2048, levels: int = 128, docs_per_pattern: int = 3, share: float = 0.6) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as ``(lengths, repeats)`` that hold every piece of the histogram once.

    Lengths are rounded up to ``levels`` grid steps for the fit.  Long pieces weigh more in it:
    short ones find room anyway.  In a pattern the last slot takes the longest piece that fits,
    up to two steps above its own.  Of the fitted counts ``share`` is used, rounded down, so that
    enough short pieces are left to fill the room that the rounding of lengths leaves.
    """
    histogram = {k: n for k, n in histogram.items() if n}
    out: list[tuple[tuple[int, ...], int]] = []
    if capacity in histogram:
        out.append(((capacity,), histogram.pop(capacity)))
    counts = _Counts(histogram)
    step = math.ceil(capacity / levels)
    whole = capacity // step
    wanted = np.zeros(whole + 2)
    for length, n in histogram.items():
        wanted[min(whole + 1, math.ceil(length / step))] += n
    spaces: dict[int, list[list]] = defaultdict(list)
    open_spaces: list[int] = []

    def put(lengths: tuple[int, ...], n: int) -> None:
        room = capacity - sum(lengths)
        if not room:
            out.append((lengths, n))
            return
        if not spaces[room]:
            insort(open_spaces, room)
        spaces[room].append([lengths, n])

    known = [p for p in patterns(whole, docs_per_pattern) if all(wanted[x] for x in set(p))]
    if known:
        a = np.zeros((whole + 1, len(known)))
        for j, p in enumerate(known):
            for x in p:
                a[x, j] += 1
        weight = np.clip(np.arange(whole + 1) / (whole / 2), 0.05, 1.0)
        repeats = nnls(a * weight[:, None], wanted[:whole + 1] * weight, rounds=3 * whole)
        for j in np.argsort([-p[0] for p in known], kind="stable"):
            todo = int(share * repeats[j] + 1e-6)
            while todo:
                used: dict[int, int] = {}
                room, lengths = capacity, []
                for i, level in enumerate(known[j]):
                    last = i == len(known[j]) - 1 and i > 0
                    high = min(room, (level + 2) * step) if last else level * step
                    got = counts.longest((level - 1) * step + 1, high, used)
                    if got is not None:
                        used[got] = used.get(got, 0) + 1
                        lengths.append(got)
                        room -= got
                if not lengths:
                    break
                n = min(todo, *(counts.left[x] // k for x, k in used.items()))
                for x, k in used.items():
                    counts.take(x, n * k)
                put(tuple(lengths), n)
                todo -= n

    for length in list(reversed(counts.sorted)):
        n = counts.left[length]
        while n:
            at = bisect_left(open_spaces, length)
            if at == len(open_spaces):
                fit = capacity // length
                if n >= fit:
                    put((length,) * fit, n // fit)
                    n %= fit
                if n:
                    put((length,) * n, 1)
                break
            room = open_spaces[at]
            lengths, have = spaces[room][-1]
            m = min(n, have)
            spaces[room][-1][1] -= m
            if m == have:
                spaces[room].pop()
                if not spaces[room]:
                    open_spaces.pop(at)
            put((*lengths, length), m)
            n -= m
    for group in spaces.values():
        out += [(lengths, n) for lengths, n in group]
    return out


def runs(sequences: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """The plan by length: ``(length, first, end, sequence, offset)``.

    Of the pieces of a length, in any order, those numbered ``first … end - 1`` go to consecutive
    sequences from ``sequence`` on, at ``offset``.
    """
    out, placed, base = [], defaultdict(int), 0
    for lengths, n in sequences:
        offset = 0
        for length in lengths:
            out.append((length, placed[length], placed[length] + n, base, offset))
            placed[length] += n
            offset += length
        base += n
    return out


def pack(parts: DataFrame, keys: tuple[str, ...] = ("doc_id", "piece"), capacity: int = 2048, levels: int = 128,
         rows_per_bucket: int = 50_000) -> DataFrame:
    """``parts`` (with ``keys`` and ``length``, 1 to ``capacity``) with ``sequence_id`` and ``offset``.

    Pieces are numbered within their length over hash buckets, so a length that many pieces share
    is numbered in many tasks.  ``parts`` should be a written table: it is read three times.
    Rows that repeat all keys are told apart by nothing but take different places.
    """
    spark = parts.sparkSession
    histogram = {int(r["length"]): r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = spark.createDataFrame(
        runs(plan(histogram, capacity, levels)) or [(0, 0, 0, 0, 0)],
        "run_length long, run_first long, run_end long, run_sequence long, run_offset long")
    buckets = max(16, math.ceil(sum(histogram.values()) / rows_per_bucket))
    dealt = parts.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_n")).select(
        "length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = Window.partitionBy("length", "_bucket").orderBy(*keys)
    numbered = dealt.withColumn("_rank", F.row_number().over(own) - 1).join(starts, ["length", "_bucket"]).withColumn(
        "_rank", F.col("_rank") + F.col("_start"))
    on = ((F.col("length") == F.col("run_length")) & (F.col("_rank") >= F.col("run_first")) & (F.col("_rank") < F.col("run_end")))
    return numbered.join(F.broadcast(table), on).select(
        *parts.columns, (F.col("run_sequence") + F.col("_rank") - F.col("run_first")).alias("sequence_id"),
        F.col("run_offset").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048,
                   end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its place; see ``pieces`` and ``pack``.  No token is lost."""
    with small_batches(docs.sparkSession, ROWS_TOGETHER):
        parts = written(pieces(docs, tokenizer_path, id_col, text_col, capacity, end_id, with_ids), "pieces")
    return pack(parts, (id_col, "piece"), capacity)
