"""Feeds kept as tables, laid out for look-ups by id."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnsieve.scratch import scratch_path

IN_LIST = 10  # values up to which Spark hands an IN to the Parquet reader as it is
GROUP_BYTES = 8 << 20


def store_feed(df: DataFrame, id_col: str, path: str | None = None, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``df`` written in order of its ids, in small row groups with Bloom filters on them, and read back.

    Ids are dealt by range and sorted, so the bounds of row groups hardly overlap; a dictionary or a
    Bloom filter then tells whether an id lies in a group.  A look-up by ``has_id`` reads the groups
    that can hold one of the ids, whatever the size of the feed.  Null ids come first.  Without a
    path the table lies in the scratch folder of the application.
    """
    path = path or scratch_path(df.sparkSession, "feed")
    df.repartitionByRange(F.col(id_col)).sortWithinPartitions(id_col).write.mode("overwrite").option(
        f"parquet.bloom.filter.enabled#{id_col}", "true").option("parquet.block.size", str(group_bytes)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def has_id(id_col: str, ids: Sequence[str]) -> Column:
    """Whether the column holds one of the ids, as conditions the Parquet reader can test.

    Of a long list Spark would hand on its least and largest value only; several short ones are
    tested value by value.
    """
    parts = [F.col(id_col).isin(*ids[i:i + IN_LIST]) for i in range(0, len(ids), IN_LIST)]
    return reduce(lambda a, b: a | b, parts, F.lit(False)) if parts else F.lit(False)
