"""SimHash near-duplicates: fingerprints, tiled exact comparison, connected components."""

from __future__ import annotations

from itertools import accumulate, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnsieve.llm.common import named, one_of, row_of, whole_text, without, written

BITS, QUARTERS, SIDE = 64, 4, 32
SEED = 42
FREQUENT = 1000


def simhash(text: bytes, width: int = 3) -> int:
    """Bit i is set when more than half of the shingle hashes have it.

    ASCII letters are lower-cased; words end at ASCII white space; shingles of ``width`` words,
    repeats included, are hashed by XXH64.  Fewer words make one shingle, none make zero.
    """
    words = text.lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= width:
        return digest(joined, SEED)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    hashes = np.array([digest(joined[s:e - 1], SEED) for s, e in zip(starts, ends[width - 1:])], ">u8")
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 15):  # long texts a part at a time
        part = hashes[i:i + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``id_col, fingerprint`` (a signed long) for every row; a null text counts as empty."""
    kind = docs.select(named(id_col)).schema[0].dataType.simpleString()

    def run(batches):
        for batch in batches:
            values = np.array([simhash(t, width) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], [id_col, "fingerprint"])

    return docs.select(named(id_col), whole_text(text_col).cast("binary").alias("_text")).mapInArrow(
        run, f"`{id_col}` {kind}, fingerprint long")


def _tile_of(fingerprint: str, radius: int):
    """One number for the population counts of the four quarters of a fingerprint.

    Each count takes a digit with room for ``radius`` on both sides, so adding a step never
    carries into the next digit.
    """
    counts = [F.bit_count(F.shiftrightunsigned(F.col(fingerprint), 16 * i).bitwiseAND(F.lit(0xFFFF))) for i in range(QUARTERS)]
    return sum(((c + radius) * F.lit(SIDE**i) for i, c in enumerate(counts)), F.lit(0)).cast("int")


def _steps(radius: int) -> list[int]:
    """Steps to the tiles that can hold a neighbour, of each pair of opposite steps one.

    Fingerprints within the radius differ in their quarter counts by no more than it in total.
    """
    moves = [m for m in product(range(-radius, radius + 1), repeat=QUARTERS) if sum(map(abs, m)) <= radius]
    return [sum(x * SIDE**i for i, x in enumerate(m)) for m in moves if m >= (0,) * QUARTERS]


def _forest(pairs: list[tuple[int, int]]) -> dict[int, int]:
    """Every linked value to the least value it is linked to, by the pairs of one tile."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent if root(x) != x}


def links(distinct: DataFrame, radius: int = 2, tile_rows: int = 8192, cells: int = 1 << 22) -> DataFrame:
    """``a, b``: links among distinct fingerprints (column ``fingerprint``), ``radius`` bits or less apart.

    Not every pair is returned, but the links of each tile as a forest: as few as connect the same
    fingerprints.  Tiles hold fingerprints with equal population counts of their quarters.  Every
    fingerprint meets its own tile and, of the tiles whose counts differ by the radius at most, those
    on one side; all other pairs of tiles are skipped.  Tiles of more than ``tile_rows`` are cut into
    parts by hash; there are at most 17**4 tiles, whose sizes are broadcast.
    """
    spark = distinct.sparkSession
    rows = distinct.select("fingerprint", _tile_of("fingerprint", radius).alias("tile"))
    sizes = written(rows.groupBy("tile").agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("parts")), "tiles")
    part = F.pmod(F.xxhash64("fingerprint"), F.col("parts")).cast("int")
    home = rows.join(F.broadcast(sizes), "tile").select(
        "tile", part.alias("part"), F.lit(False).alias("probe"), "fingerprint")
    there = rows.select("fingerprint", F.explode(F.array(*[F.col("tile") + s for s in _steps(radius)])).alias("tile"))
    probe = there.join(F.broadcast(sizes), "tile").select(
        "tile", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("probe"), "fingerprint")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = home.unionByName(probe).repartition(partitions, "tile", "part").sortWithinPartitions("tile", "part", "probe")

    def compare(batches):
        key, own, pairs = None, [], []

        def tile_links():
            found = _forest(pairs)
            return pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["a", "b"])

        for batch in batches:
            tile, part_no, probes, values = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            code = tile.astype(np.int64) << 32 | part_no
            cuts = np.flatnonzero((code[1:] != code[:-1]) | (probes[1:] != probes[:-1])) + 1
            for start, end in zip([0, *cuts], [*cuts, len(code)]):
                if start == end:
                    continue
                if code[start] != key:
                    if pairs:
                        yield tile_links()
                    key, own, pairs = code[start], [], []
                run = values[start:end].view(np.uint64)  # bit counts of signed numbers are those of their size
                if not probes[start]:
                    own.append(run)
                    continue
                mine = np.concatenate(own) if own else run[:0]
                own = [mine]
                step = max(1, cells // max(1, len(mine)))
                for i in range(0, len(run) if len(mine) else 0, step):
                    other = run[i:i + step]
                    near = np.bitwise_count(mine[:, None] ^ other[None, :]) <= radius
                    x, y = np.nonzero(near)
                    a, b = mine[x], other[y]
                    differ = a != b
                    pairs += zip(a[differ].view(np.int64).tolist(), b[differ].view(np.int64).tolist())
                    if len(pairs) > 1_000_000:
                        pairs = list(_forest(pairs).items())
        if pairs:
            yield tile_links()

    return met.mapInArrow(compare, "a long, b long")


def components(edges: DataFrame, name: str = "edges") -> DataFrame:
    """``node, root``: every node of the edges ``a, b`` with the least node of its component.

    Alternates large-star and small-star steps, each a grouped minimum and a join, until the
    edges are stars.  Every round is written to the shared folder.
    """
    now = written(edges.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    state = None
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a").select(
            F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
                              F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        now = written(small.filter("a <> b").distinct(), name)
        # stars are a fixed point: the same edges come back
        again = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == again:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = again


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2,
                    width: int = 3) -> DataFrame:
    """``id_col, fingerprint, component_id`` for every row of ``docs``.

    Fingerprints link at ``radius`` or fewer differing bits; ``component_id`` is the smallest
    id reachable over links, its own included.  Texts without words have fingerprint zero and
    are linked like any other; null ids count as larger than all others.  Equal fingerprints
    are one node, so copies never meet in one task and never make pairs.
    """
    rows = written(fingerprints(docs, id_col, text_col, width), "fingerprints")
    nodes = written(rows.groupBy("fingerprint").agg(F.min(id_col).alias("least"), F.count("*").alias("copies")), "nodes")
    linked = components(links(nodes, radius)).select(F.col("node").alias("fingerprint"), "root")
    linked = linked.union(linked.select(F.col("root"), F.col("root")).distinct())
    members = linked.join(nodes, "fingerprint")
    best = members.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = linked.join(best, "root").select("fingerprint", "component_id")
    named = nodes.join(labels, "fingerprint", "left").select(
        "fingerprint", F.coalesce("component_id", "least").alias("component_id"), "copies")
    # fingerprints with a thousandth of all rows, a thousand at most, are resolved where their rows are
    many = F.col("copies") * FREQUENT >= rows.count()
    frequent = written(named.filter(many).select("fingerprint", "component_id"), "frequent")
    head = rows.join(F.broadcast(frequent), "fingerprint")
    tail = rows.join(F.broadcast(frequent), "fingerprint", "left_anti").join(
        named.filter(~many).select("fingerprint", "component_id"), "fingerprint")
    return head.unionByName(tail).select(id_col, "fingerprint", "component_id")


def row_key(id_col: str, text_col: str) -> Column:
    """Key of a row: id and SHA-256 of the text; null ids come after all others."""
    return F.struct(named(id_col).isNull().alias("no_id"), named(id_col).alias("id"),
                    F.unhex(F.sha2(whole_text(text_col).cast("binary"), 256)).alias("digest"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, width: int = 3) -> DataFrame:
    """One row of ``docs`` for each component: that with the smallest id, of equal ids with the least digest.

    Null texts count as empty and null ids as larger than all others.  Rows are told apart by id and
    text, so a null or repeated id never takes another text with it; of rows that repeat both, one
    stays, always the same.  Columns of any name and type are handed through.  An empty table gives
    an empty one.
    """
    keyed = docs.select(row_key(id_col, text_col).alias("key"), named(text_col).alias("text"))
    marks = written(near_duplicates(keyed, "key", "text", radius, width), "marks")
    left = docs.select(row_of(docs).alias("row"), row_key(id_col, text_col).alias("key")).select("row", "key.id", "key.digest")

    def those(part: DataFrame) -> DataFrame:
        return part.select("key.id", "key.digest").distinct()

    stay = marks.filter(F.col("key") == F.col("component_id"))
    twice = written(stay.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "twice")
    gone = those(marks.filter(F.col("key") != F.col("component_id")).select("key").union(twice.select("key")))
    out = without(left, gone, ["id", "digest"]).select("row")
    if not twice.isEmpty():
        mine, other = left.alias("mine"), those(twice).alias("other")
        on = F.col("mine.id").eqNullSafe(F.col("other.id")) & (F.col("mine.digest") == F.col("other.digest"))
        several = mine.join(other, on, "left_semi").groupBy("id", "digest").agg(one_of("row").alias("row"))
        out = out.unionByName(several.select("row"))
    return out.select("row.*")
