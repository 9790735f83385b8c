"""Exact, seeded train / validation / test split without sorting the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vulnsieve.operators.prefix import running_sums

PARTS = ("train", "val", "test")


def shuffle_key(key: str | Column, seed: int) -> Column:
    """A reproducible random order: the MD5 of the id and the seed."""
    column = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(column.cast("string"), F.lit(f"-{seed}")))


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    return df.orderBy(shuffle_key(key, seed), key)


def split_dataset(
    df: DataFrame, key: str, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: int = 42, digits: int = 4,
) -> DataFrame:
    """Adds ``part``: the first int(n·ratio) rows of a seeded permutation train, then val, rest test.

    The permutation orders rows by MD5 of their (unique) id.  Rows are counted per
    leading hex digits of the hash (16^digits buckets, however large the table); the
    running total places every bucket, and only the two buckets a cut point falls
    into are ranked row by row, by ``running_sums``.  All other rows get their part from the
    bucket table without a shuffle.
    """
    if abs(sum(ratios) - 1.0) > 1e-6:
        raise ValueError("ratios must sum to 1")
    keyed = df.withColumn("_h", shuffle_key(key, seed)).withColumn("_b", F.substring("_h", 1, digits))
    counts = keyed.groupBy("_b").agg(F.count("*").alias("c"))
    everything = Window.partitionBy()
    above = Window.partitionBy().orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # at most 16^digits rows in these two windows
    buckets = counts.select(
        "_b", (F.sum("c").over(above) - F.col("c")).alias("first"), F.sum("c").over(above).alias("end"),
        F.sum("c").over(everything).alias("n"))
    n_train = F.floor(F.col("n") * F.lit(ratios[0]))
    n_val = F.floor(F.col("n") * F.lit(ratios[1]))
    buckets = buckets.select("_b", "first", "end", n_train.alias("a"), (n_train + n_val).alias("z"))

    def part(position: Column) -> Column:
        return F.when(position < F.col("a"), PARTS[0]).when(position < F.col("z"), PARTS[1]).otherwise(PARTS[2])

    whole = part(F.col("first")) == part(F.col("end") - 1)
    placed = keyed.join(F.broadcast(buckets.withColumn("whole", whole)), "_b")
    columns = [F.col(c) for c in df.columns]
    easy = placed.filter("whole").select(*columns, part(F.col("first")).alias("part"))
    cut = running_sums(placed.filter("NOT whole").withColumn("_one", F.lit(1)), ["_b"], [F.col("_h"), F.col(key)], {"_no": "_one"})
    cut = cut.select(*columns, part(F.col("first") + F.col("_no") - 1).alias("part"))
    return easy.unionByName(cut)
