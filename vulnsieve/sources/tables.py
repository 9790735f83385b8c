"""Code corpora from tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def code_from_table(df: DataFrame, file_id: str | Column, path: str | Column, text: str | Column) -> DataFrame:
    """``file_id, path, content`` from any table that holds texts; only those columns are read.

    A null text is a file that could not be read: it counts as a file without findings.
    It is not filtered here, so jobs over ids and paths never touch the text column.
    """
    def col(c):
        return F.col(c) if isinstance(c, str) else c

    return df.select(
        col(file_id).cast("long").alias("file_id"),
        col(path).cast("string").alias("path"),
        col(text).alias("content"),
    )


def seeded_corpus(documents: DataFrame, snippets: DataFrame, n_snippets: int) -> DataFrame:
    """Every document with a code snippet in front, so prose tables exercise code checks.

    ``snippets`` (``snippet_id, ext, code``) is a fixed list, hence the broadcast.
    """
    return documents.join(
        F.broadcast(snippets), F.col("doc_id") % n_snippets == F.col("snippet_id")
    ).select(
        F.col("doc_id").alias("file_id"),
        F.concat(F.lit("src/m"), F.col("doc_id"), F.col("ext")).alias("path"),
        F.concat(F.col("code"), F.lit("\n"), F.col("text")).alias("content"),
    )
