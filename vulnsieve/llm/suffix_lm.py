"""Language-model scores by a probabilistic suffix tree over words.

The symbols are lower-cased words and the end of a text.  A state is a context of up to
``DEPTH`` words; a context becomes a state when its next-word distribution diverges from that
of its longest suffix state, and is smoothed by it.  The root is the add-one distribution of
single words.  A text is scored by the longest suffix state before every token.

Words, contexts, states and edges are tables that grow with the corpus.  Strings of words are
known by 64-bit hashes, built word by word as Spark's ``xxhash64`` does.  They are counted level
by level: a string counts only if the context before its last word is frequent, which a filter
of a fixed size tells where the text is read, without a miss.  The divergence test is an
aggregate per context.  When texts are scored, the most frequent states and edges (a fixed
number) are looked up on the spot; what a filter finds possibly among the others is joined.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnsieve.llm.common import named, slices, whole_text, written

DEPTH = 3  # words in the longest context
SEED = 42  # of Spark's xxhash64
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
ENDS = b""  # no word is empty: stands for the end
FLUSH = 400_000
PAIRS = 4_000_000  # occurrences counted in a task before they are handed on
FILTER_BITS = 26
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (  # fixed values: the primes of XXH64
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def words_of(text: bytes) -> list[bytes]:
    """Tokens end at ASCII white space; only A-Z are lower-cased."""
    return text.lower().split()


def _rotated(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _hashed(values: np.ndarray, seed: np.ndarray | np.uint64) -> np.ndarray:
    """XXH64 of longs, as Spark's ``xxhash64`` takes them one after the other."""
    h = seed + _P5 + np.uint64(8)
    h = _rotated(h ^ (_rotated(values * _P2, 31) * _P1), 27) * _P1 + _P4
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def longer(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Key of a context one word longer: ``xxhash64(context, word)`` of Spark."""
    return _hashed(word, _hashed(context, np.uint64(SEED)))


def word_key(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, SEED)


END_KEY = np.uint64(word_key(ENDS))


@dataclass
class Tokens:
    """The tokens of some texts, one after the other, ends included."""

    words: list[bytes]  # the distinct ones; the last is the end
    keys: np.ndarray  # of the distinct words
    codes: np.ndarray  # of all tokens: places among the distinct words
    bounds: np.ndarray  # where each text begins, and the end

    @classmethod
    def of(cls, texts: list[bytes]) -> Tokens:
        """As ``words_of`` cuts every text, over all texts at once."""
        data = np.frombuffer(b"\n".join([*texts, b""]).lower(), np.uint8)
        solid = ~SPACE[data]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], solid, [False]])))
        starts, stops = edges[::2], edges[1::2]
        offsets = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int64)
        found = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[solid])]).dictionary_encode()
        words = [*found.dictionary.to_pylist(), ENDS]
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        before = np.searchsorted(starts, ends)  # words up to the end of each text
        bounds = np.concatenate([[0], before + np.arange(1, len(texts) + 1)])
        codes = np.full(len(starts) + len(texts), len(words) - 1, np.int64)
        inside = np.ones(len(codes), bool)
        inside[bounds[1:] - 1] = False
        codes[inside] = found.indices.to_numpy(zero_copy_only=False)
        return cls(words, np.fromiter(map(word_key, words), np.uint64, len(words)), codes, bounds)

    @property
    def stream(self) -> np.ndarray:
        return self.keys[self.codes]


def contexts_of(tokens: np.ndarray, depth: int = DEPTH):
    """For contexts of 1, 2, … ``depth`` words: positions of the tokens after them, and their keys.

    A context lies within a text; the token after it may be the end.
    """
    inside = tokens != END_KEY
    key, good = tokens, inside
    for n in range(1, depth + 1):
        at = np.flatnonzero(good[:len(tokens) - n])
        yield at + n, key[at]
        if n < depth:
            key = longer(key[:-1], tokens[n:])
            good = good[:-1] & inside[n:]


class Filter:
    """Tells which keys are surely not among those it was made of; two bits of a fixed array a key."""

    def __init__(self, rows: pa.Table | None = None):
        self.words = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
        if rows is not None and rows.num_rows:
            self.words[rows.column("place").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
        self.empty = not self.words.any()

    @classmethod
    def of(cls, keys: DataFrame, key: str = "key") -> Filter:
        """Spark sets the bits; at most 2 ** 20 words of 64 bits reach the driver."""
        probe = F.explode(F.array(F.shiftrightunsigned(key, 64 - FILTER_BITS), F.col(key).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))))
        place, bit = F.shiftright("p", 6).alias("place"), F.col("p").bitwiseAND(F.lit(63)).cast("int")
        one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
        return cls(keys.select(probe.alias("p")).groupBy(place).agg(F.bit_or(one).alias("bits")).toArrow())

    def maybe(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        if self.empty:
            return ~out
        for at in (keys >> np.uint64(64 - FILTER_BITS), keys & np.uint64((1 << FILTER_BITS) - 1)):
            out &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out


class Lookup:
    """Places of keys in a sorted array; a table of hash bits spares most searches."""

    SIZE = 1 << 22

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.seen = np.zeros(self.SIZE, bool)
        self.seen[self._slot(keys)] = True

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``keys`` are there, and where."""
        maybe = np.flatnonzero(self.seen[self._slot(keys)])
        if not len(maybe) or not len(self.keys):
            return maybe[:0], maybe[:0]
        place = np.minimum(np.searchsorted(self.keys, keys[maybe]), len(self.keys) - 1)
        hit = self.keys[place] == keys[maybe]
        return maybe[hit], place[hit]


@dataclass
class TreeHead:
    """The most frequent states and edges of all lengths, and filters of the others.

    ``back``: log10 of the share a state leaves to its suffix state; ``gain``: log10 of an edge's
    probability over the root's.
    """

    states: np.ndarray
    back: np.ndarray
    edges: np.ndarray
    gain: np.ndarray
    other_states: Filter
    other_edges: Filter

    def prepare(self) -> TreeHead:
        self.find_state, self.find_edge = Lookup(self.states), Lookup(self.edges)
        return self

    def gains(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """log10 of each token's probability over the root's, by its longest suffix state.

        Also the positions this cannot tell, because a state or an edge may be among the others, with
        gain 0, and for them the keys of the contexts by length (0: there is none).
        """
        out = np.zeros(len(tokens))
        done, open_ = np.zeros(len(tokens), bool), np.zeros(len(tokens), bool)
        levels = list(contexts_of(tokens))
        full = [longer(keys, tokens[at]) for at, keys in levels]
        for (at, keys), edge in zip(levels, full):
            open_[at] |= self.other_states.maybe(keys) | self.other_edges.maybe(edge)
        for (at, keys), edges in zip(reversed(levels), reversed(full)):
            keep = ~done[at]
            at, keys, edges = at[keep], keys[keep], edges[keep]
            hit, place = self.find_state.find(keys)
            at, edges = at[hit], edges[hit]
            known, edge = self.find_edge.find(edges)
            left = np.ones(len(at), bool)
            left[known] = False
            out[at[known]] += self.gain[edge]
            done[at[known]] = True
            out[at[left]] += self.back[place[left]]
        where = np.flatnonzero(open_)
        out[where] = 0
        keys = []
        for at, own in levels:
            whole = np.zeros(len(tokens), np.uint64)
            whole[at] = own
            keys.append(whole[where])
        return out, where, keys


@dataclass
class WordModel:
    """Word counts, and what the score of a text needs besides."""

    words: DataFrame  # word binary, n: count in the training tokens
    frequent: tuple[np.ndarray, np.ndarray]  # keys and counts of the most frequent words and the end, by key
    states: list[DataFrame]  # per context length: key, back
    edges: list[DataFrame]  # per context length: key (of context and next word), gain
    head: TreeHead
    train_tokens: int
    train_texts: int
    distinct: int

    @property
    def unknown(self) -> float:
        """Base score of a token that was not seen."""
        return -math.log10(self.train_tokens + self.distinct + 1)


def with_gain(rows: DataFrame, states: list[DataFrame], edges: list[DataFrame]) -> DataFrame:
    """``rows`` with ``gain`` by the longest state among the contexts ``s1``, ``s2``, … before the word ``x``.

    The edges of the longest context come first; where it has none for the word, its share goes to
    the next shorter one.  Null contexts have no state.
    """
    gain = F.lit(0.0)
    for d, (state, edge) in enumerate(zip(states, edges), 1):
        rows = rows.join(state.select(F.col("key").alias(f"_s{d}"), F.col("back").alias(f"_back{d}")),
                         F.col(f"s{d}") == F.col(f"_s{d}"), "left")
        rows = rows.withColumn(f"_full{d}", F.when(F.col(f"_s{d}").isNotNull(), F.xxhash64(f"s{d}", "x"))).join(
            edge.select(F.col("key").alias(f"_e{d}"), F.col("gain").alias(f"_gain{d}")), F.col(f"_full{d}") == F.col(f"_e{d}"), "left")
        gain = F.coalesce(F.col(f"_gain{d}"), F.coalesce(F.col(f"_back{d}"), F.lit(0.0)) + gain)
    drop = [f"_{what}{d}" for d in range(1, len(states) + 1) for what in ("s", "back", "full", "e", "gain")]
    return rows.withColumn("gain", gain).drop(*drop)


def tree_level(counts: DataFrame, contexts: DataFrame, root: DataFrame, states: list[DataFrame], edges: list[DataFrame],
               divergence: float, types: float) -> tuple[DataFrame, DataFrame]:
    """States ``key, back, n`` and edges ``key, gain, n`` of one context length.

    ``counts``: ``ctx, x, n``; ``contexts``: ``ctx, total, s1, …`` with the keys of the shorter
    contexts; ``root``: ``x, log_root``.  A context becomes a state if the Kullback-Leibler
    divergence of its next words, those not counted taken together, from its suffix state's is
    ``divergence`` nats or more.
    """
    rows = with_gain(counts.join(contexts, "ctx").join(root, "x"), states, edges)
    p, lower = F.col("n") / F.col("total"), F.pow(F.lit(10.0), F.col("log_root") + F.col("gain"))
    rows = written(rows.select("ctx", "x", "n", "total", "log_root", lower.alias("lower"), (p * F.log(p / lower)).alias("term")), "level")
    per = rows.groupBy("ctx").agg(F.first("total").alias("total"), F.sum("n").alias("seen"), F.count("*").alias("kinds"),
                                  F.sum("lower").alias("lower"), F.sum("term").alias("term"))
    rest, lower_rest = (F.col("total") - F.col("seen")) / F.col("total"), F.greatest(F.lit(1e-12), 1 - F.col("lower"))
    far = F.col("term") + F.when(rest > 0, rest * F.log(rest / lower_rest)).otherwise(0.0)
    left, whole = F.col("total") - F.col("seen") + types * F.col("kinds"), F.col("total") + types * F.col("kinds")
    state = written(per.filter(far >= divergence).select("ctx", "total", left.alias("left"), whole.alias("whole")), "states")
    share = (F.col("n") + F.col("left") * F.col("lower")) / F.col("whole")
    edge = rows.drop("total").join(state, "ctx").select(
        F.xxhash64("ctx", "x").alias("key"), (F.log10(share) - F.col("log_root")).alias("gain"), "n")
    return (state.select(F.col("ctx").alias("key"), F.log10(F.col("left") / F.col("whole")).alias("back"), F.col("total").alias("n")),
            written(edge, "edges"))


def _head(rows: DataFrame, value: str, most: int) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """Keys and values of the ``most`` rows of largest ``n``, by key, and the other rows."""
    top = rows.orderBy(F.desc("n"), "key").limit(most).toArrow()
    keys, n = top.column("key").to_numpy(), top.column("n").to_numpy()
    if len(keys) < most:
        others = rows.filter("false")
    else:
        others = rows.filter((F.col("n") < int(n[-1])) | ((F.col("n") == int(n[-1])) & (F.col("key") > int(keys[-1]))))
    order = np.argsort(keys.view(np.uint64))
    return keys.view(np.uint64)[order], top.column(value).to_numpy()[order], others


def train(docs: DataFrame, is_training: Column, text_col: str = "text", least_context: int = 1000, least_count: int = 16,
          divergence: float = 0.05, types: float = 0.5, frequent: int = 1_000_000, head: int = 2_000_000) -> WordModel:
    """Learns from all rows where ``is_training`` holds; nothing is sampled.

    Contexts that occur ``least_context`` times are tested, with the next words that follow them
    ``least_count`` times; both numbers are the same for every corpus, so states and edges grow with
    it.  The ``frequent`` first words and the ``head`` first states and edges reach the driver, and
    filters of a fixed size; all else stays in tables.  A null text counts as empty, repeated rows
    count as often as they stand; without training rows every word is unknown.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(is_training, F.lit(False)).alias("_train"), whole_text(text_col).cast("binary").alias("_text"))
    learned = rows.filter("_train").select("_text")

    def count(batches):
        found: dict[bytes, int] = {}

        def table():
            return pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for start, end in slices(batch, "_text"):
                tokens = Tokens.of(batch.column(0).slice(start, end - start).to_pylist())
                for word, n in zip(tokens.words, np.bincount(tokens.codes, minlength=len(tokens.words)).tolist()):
                    found[word] = found.get(word, 0) + n
                if len(found) > FLUSH:
                    yield table()
                    found = {}
        yield table()

    words = written(learned.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).filter("n > 0"), "words")
    sums = words.agg(F.sum("n").alias("tokens"), F.count("*").alias("types")).first()
    tokens, distinct = sums.tokens or 0, sums.types
    top = words.orderBy(F.desc("n"), "word").limit(frequent).toArrow()
    common = dict(zip(map(word_key, top.column("word").to_pylist()), top.column("n").to_pylist()))
    is_end = F.col("word") == F.lit(bytearray(ENDS))
    texts = common.get(int(END_KEY)) or (words.filter(is_end).agg(F.sum("n")).first()[0] or 0)

    def pairs(depth: int, contexts: Filter, followers: Filter) -> DataFrame:
        """``ctx, x, n``: how often a word follows a context of ``depth`` words, from ``least_count`` times on."""
        shared = spark.sparkContext.broadcast((contexts, followers))

        def run(batches):
            contexts, followers = shared.value
            held, size = [], 0

            def table():
                ctx, x, key = (np.concatenate(c) for c in zip(*held))
                _, first, n = np.unique(key, return_index=True, return_counts=True)
                return pa.RecordBatch.from_arrays([pa.array(ctx[first].view(np.int64)), pa.array(x[first].view(np.int64)),
                                                   pa.array(n.astype(np.int64))], ["ctx", "x", "n"])

            for batch in batches:
                for start, end in slices(batch, "_text"):
                    tokens = Tokens.of(batch.column(0).slice(start, end - start).to_pylist())
                    stream, often = tokens.stream, followers.maybe(tokens.keys)[tokens.codes]
                    *_, (at, ctx) = contexts_of(stream, depth)
                    may = often[at]
                    may[may] = contexts.maybe(ctx[may])
                    ctx, x = ctx[may], stream[at[may]]
                    held.append((ctx, x, longer(ctx, x)))
                    size += len(ctx)
                    if size > PAIRS:
                        yield table()
                        held, size = [], 0
            if size:
                yield table()

        found = learned.mapInArrow(run, "ctx long, x long, n long").groupBy("ctx", "x").agg(F.sum("n").alias("n"))
        return written(found.filter(F.col("n") >= least_count), "pairs")

    hashed = words.select(F.xxhash64("word").alias("x"), "n", is_end.alias("end"))
    root = hashed.select("x", F.log10((F.col("n") + 1.0) / float(tokens + distinct + 1)).alias("log_root"))
    contexts = hashed.filter(~F.col("end") & (F.col("n") >= least_context)).select(F.col("x").alias("ctx"), F.col("n").alias("total"))
    followers = Filter.of(hashed.filter(F.col("n") >= least_count), "x")
    states: list[DataFrame] = []
    edges: list[DataFrame] = []
    for depth in range(1, DEPTH + 1):
        contexts = written(contexts, "contexts")
        counts = pairs(depth, Filter.of(contexts, "ctx"), followers)
        state, edge = tree_level(counts, contexts, root, states, edges, divergence, types)
        # contexts one word longer: what follows often enough, with the keys of their own suffixes
        shorter = [F.col("x").alias("s1"), *[F.xxhash64(f"s{d}", "x").alias(f"s{d + 1}") for d in range(1, depth)]]
        contexts = counts.filter((F.col("n") >= least_context) & (F.col("x") != int(END_KEY.astype(np.int64)))).join(
            contexts.drop("total"), "ctx").select(F.xxhash64("ctx", "x").alias("ctx"), F.col("n").alias("total"), *shorter)
        states.append(state)
        edges.append(edge)
    state_keys, back, other_states = _head(_all(states), "back", head)
    edge_keys, gain, other_edges = _head(_all(edges), "gain", head)
    tree = TreeHead(state_keys, back, edge_keys, gain, Filter.of(other_states), Filter.of(other_edges))
    common[int(END_KEY)] = texts
    keys = np.array(sorted(common), np.uint64)
    return WordModel(words.filter(~is_end), (keys, np.array([common[int(k)] for k in keys], np.int64)), states, edges, tree, tokens, texts, distinct)


def _all(levels: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, levels)


def score(docs: DataFrame, model: WordModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_tokens, n_known, base_score, score`` for every row of ``docs``.

    The most frequent words, states and edges are looked up where the text is read, so nothing that
    many texts share is shuffled; other words are joined with the word table, and tokens whose state
    or edge may be among the others with those tables.  What the tree adds to the base score needs no
    count of rare words.  Repeated rows give repeated results; a null text counts as empty, an empty
    text has its end as only token.
    """
    kind = docs.select(named(id_col)).schema[0].dataType.simpleString()
    unknown = model.unknown
    shared = docs.sparkSession.sparkContext.broadcast((*model.frequent, model.head))
    contexts = [f"s{d}" for d in range(1, DEPTH + 1)]

    def split(batches):
        frequent, counts, tree = shared.value
        tree.prepare()
        find, log = Lookup(frequent), np.log10(counts + 1.0) + unknown
        for batch in batches:
            for start, end in slices(batch, "_text"):
                texts = batch.column(1).slice(start, end - start).to_pylist()
                ids = batch.column(0).slice(start, end - start)
                tokens = Tokens.of(texts)
                stream, bounds = tokens.stream, tokens.bounds
                gains, unsure, keys = tree.gains(stream)
                hit, place = find.find(tokens.keys)
                logs, known, rare = np.zeros(len(tokens.words)), np.zeros(len(tokens.words), np.int64), np.ones(len(tokens.words), bool)
                logs[hit], known[hit], rare[hit] = log[place], counts[place] > 0, False
                base, n_known, gain = (np.add.reduceat(x, bounds[:-1]) for x in (logs[tokens.codes], known[tokens.codes], gains))
                text_keys = pa.array([xxhash.xxh64_intdigest(t) - (1 << 63) for t in texts], pa.int64())
                count, rows = len(texts), np.repeat(np.arange(len(texts)), np.diff(bounds))

                def batch_of(at, **own):
                    types = {"word": pa.binary(), "k": pa.int32(), "tokens": pa.int64(), "known": pa.int64(), "own_base": pa.float64(),
                             "gain": pa.float64(), **{c: pa.int64() for c in ("x", *contexts)}}
                    at = pa.array(at, pa.int64())
                    return pa.RecordBatch.from_arrays([ids.take(at), text_keys.take(at), *[
                        own.get(name, pa.nulls(len(at), kind)) for name, kind in types.items()]], columns)

                # the text's own row: its word holds a blank, which no word does
                yield batch_of(np.arange(count), word=pa.array([b" %d" % k for k in text_keys.to_pylist()], pa.binary()),
                               k=pa.array(np.zeros(count, np.int32)), tokens=pa.array(np.diff(bounds)), known=pa.array(n_known),
                               own_base=pa.array(base), gain=pa.array(gain))
                rare, kinds = rare[tokens.codes], len(tokens.words)
                own, times = np.unique(rows[rare] * kinds + tokens.codes[rare], return_counts=True)
                if len(own):
                    yield batch_of(own // kinds, word=pa.array(tokens.words, pa.binary()).take(pa.array(own % kinds)),
                                   k=pa.array(times.astype(np.int32)))
                if len(unsure):
                    yield batch_of(rows[unsure], x=pa.array(stream[unsure].view(np.int64)),
                                   **{c: pa.array(k.view(np.int64), mask=k == 0) for c, k in zip(contexts, keys)})

    columns = [id_col, "_key", "word", "k", "tokens", "known", "own_base", "gain", "x", *contexts]
    rows = written(docs.select(named(id_col), whole_text(text_col).cast("binary").alias("_text")).mapInArrow(
        split, f"`{id_col}` {kind}, _key long, word binary, k int, tokens long, known long, own_base double, gain double, "
        + ", ".join(f"{c} long" for c in ("x", *contexts))), "scored")
    k, n, zero = F.col("k"), F.coalesce("n", F.lit(0)), F.lit(0)
    by_word = rows.filter("x IS NULL").join(model.words, "word", "left").select(
        id_col, "_key", "tokens", (F.coalesce("known", zero) + F.when(n > 0, k).otherwise(0)).alias("known"),
        F.coalesce(F.col("own_base"), k * (F.log10(n + 1.0) + F.lit(unknown))).alias("base"), "gain")
    joined = with_gain(rows.filter("x IS NOT NULL").select(id_col, "_key", "x", *contexts), model.states, model.edges)
    null = F.lit(None)
    by_word = by_word.unionByName(joined.select(
        id_col, "_key", null.cast("long").alias("tokens"), null.cast("long").alias("known"), null.cast("double").alias("base"), "gain"))
    grouped = by_word.groupBy(id_col, "_key").agg(
        F.count("tokens").alias("copies"), F.sum("tokens").alias("n_tokens"), F.sum("known").alias("n_known"),
        F.sum("base").alias("base_score"), F.sum("gain").alias("gain"))
    copies = F.col("copies")
    return grouped.select(
        id_col, (F.col("n_tokens") / copies).cast("long").alias("n_tokens"), (F.col("n_known") / copies).cast("long").alias("n_known"),
        (F.col("base_score") / copies).alias("base_score"), ((F.col("base_score") + F.col("gain")) / copies).alias("score"),
        F.explode(F.sequence(F.lit(1), copies.cast("int"))).alias("_copy")).drop("_copy")
