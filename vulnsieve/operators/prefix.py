"""Running sums and interval joins over range-partitioned rows, without a task that holds a whole key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vulnsieve.scratch import written


def first_rows(df: DataFrame, per: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows per key; the rank filter keeps ``n`` rows per key and task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*per).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[Column], sums: dict[str, str]) -> DataFrame:
    """``df`` with running sums per key, the row itself included.

    ``sums`` names the new columns by the columns they add up; ``order`` places the rows of a key and must
    tell them apart as far as the sums depend on it.  Nulls add nothing; null keys are a key of their own.

    Two passes.  Rows are range-partitioned by key and order into slices, whose number and size follow the
    data (adaptive execution merges small neighbours), and written, so that both passes see the same slices.
    The first pass totals every key within a slice; the running sum of those totals is what a slice of the
    same key starts from.  The second sums each slice on its own.  Only the key a slice begins in can have
    rows before the slice, so at most one carried total a slice is broadcast, however large a key is.
    """
    keys = list(keys)
    ranged = df.repartitionByRange(*[F.col(k) for k in keys], *order)
    rows = written(ranged.withColumn("_slice", F.spark_partition_id()), "slices")
    upto = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "_slice").agg(*[F.sum(source).alias(f"_sum_{name}") for name, source in sums.items()])
    carried = totals.withColumn("_earlier", F.count("*").over(before)).select(
        *[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)], F.col("_slice").alias("_carry_slice"), "_earlier",
        *[F.sum(f"_sum_{name}").over(before).alias(f"_carry_{name}") for name in sums]).filter("_earlier > 0").drop("_earlier")
    inside = rows.withColumns({name: F.coalesce(F.sum(source).over(upto), F.lit(0)) for name, source in sums.items()})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(keys)],
                F.col("_slice") == F.col("_carry_slice"))
    return inside.join(F.broadcast(carried), on, "left").select(
        *df.columns, *[(F.col(name) + F.coalesce(F.col(f"_carry_{name}"), F.lit(0))).alias(name) for name in sums])


def interval_join(points: DataFrame, intervals: DataFrame, keys: Sequence[str], at: str, low: str, high: str) -> DataFrame:
    """Points and intervals of the same key with ``low <= at < high``: all columns of both, keys once.

    Besides the keys the two sides share no column name.  Null keys, points and bounds match nothing; equal
    points match alike, rows that repeat are repeated in the result.

    One sweep in order of position: points and bounds are range-partitioned together, and a running sum
    counts the points passed at every bound (``running_sums``).  An interval then covers the points of the
    numbers between its two counts, so exactly the true pairs are written out and looked up by number.
    Neither crowded keys nor long intervals make other pairs, and no key has to fit into one task.
    """
    numbered, spans = _numbered(points, intervals, list(keys), at, low, high)
    others = [c for c in intervals.columns if c not in keys]
    pairs = spans.select(*keys, *others, F.explode(F.sequence(F.col("_first") + 1, "_last")).alias("_number"))
    # the pairs are far more than their measured input tells: never to be broadcast
    return numbered.join(pairs.hint("merge"), [*keys, "_number"]).select(*points.columns, *others)


def _numbered(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, low: str, high: str) -> tuple[DataFrame, DataFrame]:
    """Points with their ``_number`` in their key, and intervals that cover those after ``_first`` up to ``_last``, one at least."""
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    points = written(points.filter(known & F.col(at).isNotNull()).withColumn("_point", F.monotonically_increasing_id()), "points")
    intervals = written(intervals.filter(known & (F.col(low) < F.col(high))).withColumn(
        "_interval", F.monotonically_increasing_id()), "intervals")
    # a bound comes before the points at its position: low is inclusive, high exclusive
    none = F.lit(None).cast("long")
    line = points.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_one"), "_point", none.alias("_interval")).unionByName(
        intervals.select(*keys, F.explode(F.array(low, high)).alias("_at"), F.lit(0).alias("_one"),
                         none.alias("_point"), "_interval"))
    swept = running_sums(line, keys, [F.col("_at"), F.col("_one"), F.col("_point")], {"_passed": "_one"})
    # both sides are complete before pairs are made, so a pair is joined once
    numbered = swept.filter("_one = 1").select(F.col("_passed").alias("_number"), "_point").join(points, "_point").drop("_point")
    spans = swept.filter("_one = 0").groupBy("_interval").agg(
        F.min("_passed").alias("_first"), F.max("_passed").alias("_last")).filter("_first < _last").join(intervals, "_interval")
    return numbered, spans.drop("_interval")


def alike(points: DataFrame, intervals: DataFrame, keys: Sequence[str], at: str, low: str, high: str) -> DataFrame:
    """``keys, at, _like``: every position of the points, once, beside the least one that the same intervals cover.

    Positions of a key with no bound between them lie in the same intervals, so what is asked of intervals
    need be asked once for all of them.  One sweep counts the distinct bounds at or below each position.
    """
    keys = list(keys)
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    places = points.filter(known & F.col(at).isNotNull()).select(*keys, F.col(at).alias("_at")).distinct()
    bounds = intervals.filter(known).select(*keys, F.explode(F.array(low, high)).alias("_at")).filter("_at IS NOT NULL").distinct()
    line = bounds.withColumn("_bound", F.lit(1)).unionByName(places.withColumn("_bound", F.lit(0)))
    swept = written(running_sums(line, keys, [F.col("_at"), F.col("_bound").desc()], {"_piece": "_bound"}).filter("_bound = 0"), "pieces")
    least = swept.groupBy(*keys, "_piece").agg(F.min("_at").alias("_like"))
    return swept.join(least, [*keys, "_piece"]).select(*keys, F.col("_at").alias(at), "_like")


def first_intervals(
    points: DataFrame, intervals: DataFrame, keys: Sequence[str], at: str, low: str, high: str, order: Sequence[Column], n: int,
) -> DataFrame:
    """Of ``interval_join`` the first ``n`` rows of every position, by ``order`` of the intervals; positions come once.

    No pair is built that is not near the result.  Positions are numbered, and an interval is cut into the
    blocks of 1, 2, 4, … numbers that make it up, two of each size at most.  Of every block only its first
    ``n`` intervals can be among the first of a position inside; a position lies in one block of each size.
    So rows grow with points and intervals and their logarithm, however many intervals cover a point.
    """
    keys = list(keys)
    numbered, spans = _numbered(points.select(*keys, at).distinct(), intervals, keys, at, low, high)
    numbered = written(numbered, "numbers")
    block = [*keys, "_size", "_block"]

    def parts(size: Column) -> Column:
        first = F.call_function("shiftright", F.col("_first") + F.call_function("shiftleft", F.lit(1).cast("long"), size), size)
        end = F.call_function("shiftright", F.col("_last") + 1, size)
        left, right = (first < end) & (first % 2 == 1), (first < end) & (end % 2 == 1)
        return F.array_compact(F.array(F.when(left, F.struct(size.alias("_size"), first.alias("_block"))),
                                       F.when(right, F.struct(size.alias("_size"), (end - 1).alias("_block")))))

    # numbers are of one key, so as many sizes as all points need are enough
    sizes = F.sequence(F.lit(0), F.lit(numbered.count().bit_length()))
    cut = spans.select("*", F.explode(F.flatten(F.transform(sizes, parts))).alias("_part")).select(
        *intervals.columns, "_part.*")
    kept = first_rows(cut, block, order, n)
    places = numbered.select(*keys, at, "_number", F.explode(sizes).alias("_size")).select(
        *keys, at, "_size", F.call_function("shiftright", "_number", F.col("_size")).alias("_block"))
    return first_rows(places.join(kept, block).drop("_size", "_block"), [*keys, at], order, n)
