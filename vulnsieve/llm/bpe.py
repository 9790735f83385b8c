"""Byte-level BPE of a published tokenizer file, encoded by dynamic programming.

Of all ways to end the encoding of a prefix exactly one token is right.  It is found from
left to right: among the tokens that are suffixes of the prefix (an automaton over the
vocabulary yields them) it is the one that forms a valid pair with the last token of the
prefix before it.  Following these tokens back from the end gives the ids.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import sys
from array import array
from itertools import islice

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnsieve.llm.common import slices, whole_text

#: The pre-tokenisation pattern of byte-level BPE (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Entries of a worker's caches; they are emptied when full and change no result.
CACHED = 500_000
LONGEST_CACHED = 64


def byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write every byte as one printable character: printable Latin-1
    bytes as themselves, all others, in order, as the characters from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class _Cache(dict):
    """Texts of one kind to their packed ids; long ones are not kept."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= LONGEST_CACHED:
            if len(self) >= CACHED:
                self.clear()
            self[key] = value
        return value


class Codec:
    """Vocabulary, merges and caches of one tokenizer file; a worker builds it once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        to_byte = byte_of_char()
        packed = {token: bytes(to_byte[c] for c in token) for token in model["vocab"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.bytes_of = {number: packed[token] for token, number in model["vocab"].items()}
        self.bytes_of |= {number: text.encode() for text, number in self.special.items()}
        self.pair: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}  # token: left, right, rank of the merge
        ids = {packed[token]: number for token, number in model["vocab"].items()}
        for rank, merge in enumerate(model["merges"]):
            left, right = (packed[t] for t in (merge.split(" ") if isinstance(merge, str) else merge))
            a, b, whole = ids[left], ids[right], ids[left + right]
            self.pair[a, b] = rank
            self.parts.setdefault(whole, (a, b, rank))
        self.automaton = ahocorasick.Automaton()
        for number in self.parts:
            own = self.bytes_of[number]
            self.automaton.add_word(own.decode("latin-1"), (number, len(own)))
        self.automaton.make_automaton()
        self.single = [(ids.get(bytes([b]), -1), 1) for b in range(256)]
        self.valid: dict[int, bool] = {}
        self.first = _Cache(self._chunk)
        self.spaced = _Cache(self._spaced)
        self.word = _Cache(lambda piece: self.pack(self.encode_piece(piece.encode())))
        self.pieces = regex.compile(PATTERN).findall
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    @staticmethod
    def pack(ids: list[int]) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out = array("I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The pieces a token has at its left (0) or right (1) end while it is being merged,
        each with the rank of the merge that takes it up."""
        out, until = [(token, len(self.pair))], 0
        while token in self.parts:
            until = self.parts[token][2]
            token = self.parts[token][side]
            out.append((token, until))
        return out

    def compatible(self, a: int, b: int) -> bool:
        """Whether encoding the bytes of ``a`` and ``b`` together gives ``a, b`` again.

        It does unless some merge across the border comes before the merges that take up the
        pieces there; of equal merges the leftmost comes first.
        """
        known = self.valid.get(a << 20 | b)
        if known is None:
            right = self._edge(b, 0)
            known = not any(
                (rank := self.pair.get((x, y))) is not None and rank < x_until and rank <= y_until
                for x, x_until in self._edge(a, 1) for y, y_until in right)
            if len(self.valid) >= 2 * CACHED:
                self.valid.clear()
            self.valid[a << 20 | b] = known
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token by the last tokens of its prefixes; linear in its length.

        A prefix that no longer token ends ends in the token of its last byte.
        """
        last = [None] * len(piece)  # by the index of the last byte: token and length
        single, valid, compatible = self.single, self.valid, self.compatible
        for end, match in self.automaton.iter(piece.decode("latin-1")):
            if last[end] is None:
                before = end - match[1]
                if before >= 0:
                    a = (last[before] or single[piece[before]])[0]
                    known = valid.get(a << 20 | match[0])
                    if not (compatible(a, match[0]) if known is None else known):
                        continue
                last[end] = match
        out, at = [], len(piece) - 1
        while at >= 0:
            token, length = last[at] or single[piece[at]]
            out.append(token)
            at -= length
        out.reverse()
        return out

    def _spaced(self, rest: str) -> bytes:
        """A space and what follows it: letters, perhaps with one mark or a line end behind them,
        need no pattern."""
        if rest.isalpha():
            return self.pack(self.encode_piece(b" " + rest.encode()))
        if rest[:-1].isalpha() and rest[-1] in ".,;:!?|":
            return self.spaced[rest[:-1]] + self.word[rest[-1]]
        head, line_end, tail = rest.partition("\n")
        if line_end and head and tail and len(rest.split()) == 2 and not (head[-1].isspace() or tail[0].isspace()):
            return self.spaced[head] + self.word[line_end] + self.first[tail]
        return self._chunk(" " + rest)

    def _chunk(self, text: str) -> bytes:
        return b"".join(map(self.word.__getitem__, self.pieces(text)))

    def encode_plain(self, text: str) -> bytes:
        """Packed ids of a text without special tokens.

        No pre-token goes on over a space that follows a word, so a text may be cut there and
        the parts be looked up one by one, unless spaces follow each other.
        """
        if "  " in text:
            return self._chunk(text)
        parts = text.split(" ")
        return self.first[parts[0]] + b"".join(map(self.spaced.__getitem__, islice(parts, 1, None)))

    def encode(self, text: str) -> bytes:
        if self.at_special is None or not self.at_special.search(text):
            return self.encode_plain(text) if text else b""
        return b"".join(
            self.special[part].to_bytes(4, "little") if part in self.special else self.encode_plain(part)
            for part in self.at_special.split(text) if part)

    def decode(self, packed: bytes) -> str:
        """The text of packed ids; special tokens are written out, broken UTF-8 is replaced."""
        ids = array("I", packed)
        if sys.byteorder == "big":
            ids.byteswap()
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
        gc.freeze()  # the tables stay: the collector need not walk them again and again
    return _CODECS[path]


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, ids`` (binary, little-endian unsigned 32-bit) for every row of ``docs``.

    ``tokenizer_path`` names a byte-level BPE file every executor can open.  A null text
    counts as empty; an empty text has no id.  Rows are encoded where they are read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        tool = codec(tokenizer_path)
        for batch in batches:
            for start, end in slices(batch, "_text"):
                texts = batch.column(1).slice(start, end - start).to_pylist()
                ids = pa.array([tool.encode(t) for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), ids], [id_col, "ids"])

    return docs.select(F.col(id_col), whole_text(text_col).alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, ids binary")


def decode(encoded: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col, text`` from packed ids; null ids give null."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        tool = codec(tokenizer_path)
        for batch in batches:
            for start, end in slices(batch, "_ids", 4_000_000):
                texts = [None if x is None else tool.decode(x) for x in batch.column(1).slice(start, end - start).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, end - start), pa.array(texts, pa.string())], [id_col, "text"])

    return encoded.select(F.col(id_col), F.col(ids_col).alias("_ids")).mapInArrow(run, f"`{id_col}` {kind}, text string")


def round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_tokens, ids_sha256, decoded_sha256``: every text encoded, its ids decoded,
    both in one pass, so that neither ids nor texts leave the task."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        tool = codec(tokenizer_path)
        for batch in batches:
            for start, end in slices(batch, "_text"):
                rows = []
                for text in batch.column(1).slice(start, end - start).to_pylist():
                    ids = tool.encode(text)
                    rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(),
                                 hashlib.sha256(tool.decode(ids).encode()).hexdigest()))
                count, ids_sha, text_sha = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, end - start), pa.array(count, pa.int64()), pa.array(ids_sha),
                     pa.array(text_sha)], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col), whole_text(text_col).alias("_text")).mapInArrow(
        run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
