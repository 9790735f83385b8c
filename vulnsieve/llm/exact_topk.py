"""Exact top-k inner products by three-phase uniform thresholds, over blocks of vectors.

The score of a pair is the sum of its scores on ``slices`` runs of components: the local score
lists.  A block of candidates holds its share of every list.

1. Every block gives, for each query and list, its ``k`` best entries with their whole scores.
   The k-th best of these candidates bounds the k-th best of all from below: the cutoff.
2. The cutoff goes back with the queries.  A candidate below cutoff / slices in every list
   cannot reach the cutoff; only entries that pass it in some list are collected.
3. What an entry lacks, its scores on the other lists, is resolved exactly where its block is;
   entries below the cutoff go, and the best ``k`` of each query remain.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnsieve.llm.common import named, written

TILE = 1 << 21  # scores worked on at once
COLUMNS = ("query", "query_id", "vec_id", "row", "score")
PAIR = ", ".join(f"{c} long" for c in COLUMNS)


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    doubles = vector.cast("array<double>")
    return vector.isNotNull() & F.forall(
        doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Rows of integers; shorter rows are filled with zeros."""
    arrays = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(arrays, pa.ChunkedArray):
        arrays = arrays.chunk(0) if arrays.num_chunks else pa.array([], arrays.type)
    lengths = np.diff(arrays.offsets.to_numpy())
    values = arrays.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = values
    return out


def _kind(q: np.ndarray, c: np.ndarray):
    """A number type in which all inner products are exact, the fastest first."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else object


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` largest values of every row, ties to the smaller position."""
    n = scores.shape[1]
    if k >= n:
        return np.broadcast_to(np.arange(n), scores.shape)
    if scores.dtype == object:
        return np.array([sorted(range(n), key=lambda i: (-row[i], i))[:k] for row in scores])
    least = np.partition(scores, n - k, axis=1)[:, n - k, None]
    above, ties = scores > least, scores == least
    missing = k - above.sum(axis=1, keepdims=True)
    if (ties.sum(axis=1, keepdims=True) > missing).any():
        ties &= np.cumsum(ties, axis=1) <= missing
    return np.nonzero(above | ties)[1].reshape(-1, k)


def _group(queries: pa.Table, vectors: pa.Table, k: int, slices: int, cutoffs: bool) -> pa.Table:
    """Entries of one block of queries against one block of candidates."""
    empty = pa.table({n: pa.array([], pa.int64()) for n in COLUMNS})
    if not queries.num_rows or not vectors.num_rows:
        return empty
    asked, held = queries.column("query_vector"), vectors.column("vector")
    width = max(pc.max(pc.list_value_length(v)).as_py() or 0 for v in (asked, held))
    ids, rows = (vectors.column(c).to_numpy() for c in ("vec_id", "row"))
    order = np.lexsort((rows, ids))  # smaller positions are smaller ids
    ids, rows = ids[order], rows[order]
    c = _matrix(held, width)[order]
    q = _matrix(asked, width)
    q_ids, q_rows = (queries.column(c).to_numpy() for c in ("query_id", "query"))
    kind = _kind(q, c)
    q, c = q.astype(kind), c.astype(kind)
    cuts = np.linspace(0, width, slices + 1).astype(int)
    floor = queries.column("cutoff").to_numpy() if cutoffs else None
    least_id = queries.column("cutoff_id").to_numpy() if cutoffs else None
    lowest = -np.inf if kind is not object else -(1 << 200)
    out: list[list[np.ndarray]] = [[] for _ in COLUMNS]
    step = max(1, TILE // len(ids))
    for i in range(0, len(q), step):
        lists = [q[i:i + step, a:b] @ c[:, a:b].T for a, b in zip(cuts, cuts[1:])]
        own = q_rows[i:i + step, None] == rows[None, :]
        total = sum(lists[1:], lists[0])
        if cutoffs:
            share = floor[i:i + step, None]
            # a list passes at cutoff / slices: kept in whole numbers
            seen = lists[0] * slices >= share
            for part in lists[1:]:
                seen |= part * slices >= share
            seen &= ~own
            row, place = np.nonzero(seen)
            value = total[row, place]
            good = (value > floor[i + row]) | ((value == floor[i + row]) & (ids[place] <= least_id[i + row]))
            row, place, value = row[good], place[good], value[good]
            # of one block, no more than the best k of a query can be among its best k
            rank_order = np.lexsort((place, -value.astype(np.float64) if kind is not object else [-v for v in value], row))
            row, place, value = row[rank_order], place[rank_order], value[rank_order]
            starts = np.searchsorted(row, row, side="left")
            few = np.arange(len(row)) - starts < k
            row, place, value = row[few], place[few], value[few]
        else:
            picks = []
            for part in lists:
                part[own] = lowest
                picks.append(_best(part, k))
            pick = np.sort(np.concatenate(picks, axis=1), axis=1)
            fresh = np.ones(pick.shape, bool)
            fresh[:, 1:] = pick[:, 1:] != pick[:, :-1]
            fresh &= ~np.take_along_axis(own, pick, axis=1)
            row, at = np.nonzero(fresh)
            place = pick[row, at]
            value = total[row, place]
            if slices == 1:
                value = (q[i + row] * c[place]).sum(axis=1)
        for store, part in zip(out, (q_rows[i + row], q_ids[i + row], ids[place], rows[place], value)):
            store.append(np.asarray(part, dtype=np.int64))
    return pa.table({n: pa.array(np.concatenate(x)) for n, x in zip(COLUMNS, out)})


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "vector",
          slices: int = 2, query_rows: int = 4096, block_rows: int = 16384) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest inner products of every query.

    ``vector_col`` holds arrays of integers; ``is_query`` picks the queries among the rows, each
    of which is held against every other row.  Ties go to the smaller id; fewer candidates give
    fewer rows.  Null vectors and null ids take no part.  Rows that repeat an id are rows of
    their own: each is a candidate of the others and, where asked, a query with ranks of its
    own.  Shorter vectors count as filled with zeros; an empty table gives no row.

    Queries and candidates are cut into blocks by hash of a row number, a block of queries meets
    a block of candidates in one task, and no block grows with the table.
    """
    rows = written(vectors.select(
        named(id_col).cast("long").alias("vec_id"), named(vector_col).cast("array<bigint>").alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("asks"), F.monotonically_increasing_id().alias("row")).filter(
        "vec_id IS NOT NULL AND vector IS NOT NULL"), "vectors")
    n, n_queries = rows.agg(F.count("*"), F.count_if("asks")).first()
    n_blocks, n_sets = max(1, math.ceil(n / block_rows)), max(1, math.ceil(n_queries / query_rows))
    numbered = lambda parts: F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")
    asked = rows.filter("asks").select(
        F.col("row").alias("query"), F.col("vec_id").alias("query_id"), F.col("vector").alias("query_vector"), numbered(n_sets).alias("set"))

    def spread(df: DataFrame, name: str, parts: int) -> DataFrame:
        return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    blocks = spread(rows.select("row", "vec_id", "vector", numbered(n_blocks).alias("block")), "set", n_sets)

    def entries(queries: DataFrame, cutoffs: bool) -> DataFrame:
        both = spread(queries, "block", n_blocks).groupBy("set", "block").cogroup(blocks.groupBy("set", "block"))
        return both.applyInArrow(lambda q, c: _group(q, c, k, slices, cutoffs), PAIR)

    best = _ranked(entries(asked, False), k)
    cutoff = best.groupBy("query").agg(
        F.when(F.count("*") == k, F.min("score")).alias("cutoff"), F.max_by("vec_id", "rank").alias("cutoff_id"))
    lowest = F.lit(-(1 << 62))
    bounded = written(asked.join(cutoff, "query", "left").select(
        "query", "query_id", "query_vector", "set", F.coalesce("cutoff", lowest).alias("cutoff"),
        F.when(F.col("cutoff").isNotNull(), F.col("cutoff_id")).otherwise(F.lit((1 << 63) - 1)).alias("cutoff_id")), "cutoffs")
    return _ranked(entries(bounded, True), k).select("query_id", "rank", "vec_id", "score")
