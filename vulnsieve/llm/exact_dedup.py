"""Exact duplicates: frequent digests are resolved map-side, the rest by a plain shuffle."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnsieve.llm.common import named, one_of, row_of, whole_text, without, written


def _cut(counts: dict[bytes, int], counters: int) -> dict[bytes, int]:
    """The Misra-Gries reduction: subtract the first count that has no counter left."""
    if len(counts) <= counters:
        return counts
    least = sorted(counts.values(), reverse=True)[counters]
    return {key: n - least for key, n in counts.items() if n > least}


def frequent_digests(digests: DataFrame, counters: int = 1024) -> list[bytes]:
    """Candidates for digests that hold more than 1 / (``counters`` + 1) of all rows.

    Every task summarises its rows in ``counters`` Misra-Gries counters; the summaries are
    added per digest and reduced once more, so at most ``counters`` digests reach the driver
    and none of the frequent ones is missed.  ``digests`` has one binary column ``digest``.
    """
    def summarise(batches):
        counts: dict[bytes, int] = {}
        for batch in batches:
            for key, n in Counter(batch.column(0).to_pylist()).items():
                counts[key] = counts.get(key, 0) + n
            if len(counts) > 2 * counters:
                counts = _cut(counts, counters)
        counts = _cut(counts, counters)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["digest", "n"])

    merged = digests.select("digest").mapInArrow(summarise, "digest binary, n long")
    top = merged.groupBy("digest").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "digest").limit(counters + 1)
    rows = [(bytes(row.digest), row.n) for row in top.collect()]
    least = rows[counters][1] if len(rows) > counters else 0
    return [key for key, n in rows if n > least and n > 1]


def _winners(rows: DataFrame) -> DataFrame:
    """``digest, keep_id, group_size, repeats`` of rows ``doc_id, digest``; a null id is the least one."""
    per_id = rows.groupBy("digest", "doc_id").agg(F.count("*").alias("n"))
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id").alias("id"))
    return per_id.groupBy("digest").agg(
        F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"), F.max_by("n", order).alias("repeats"))


def _digest(text_col: str) -> Column:
    return F.unhex(F.sha2(whole_text(text_col).cast("binary"), 256))


def _split(docs: DataFrame, id_col: str, text_col: str, counters: int) -> tuple[DataFrame, DataFrame]:
    """``doc_id, digest`` of all rows, and the winners of the frequent digests (at most ``counters``)."""
    rows = written(docs.select(named(id_col).alias("doc_id"), _digest(text_col).alias("digest")), "digests")
    found = docs.sparkSession.createDataFrame([(key,) for key in frequent_digests(rows, counters)], "digest binary")
    return rows, written(_winners(rows.join(F.broadcast(found), "digest", "left_semi")), "frequent")


def mark_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = 1024) -> DataFrame:
    """``id_col, digest, keep_id, group_size, repeats, kept`` for every row of ``docs``.

    Texts are equal when their bytes are; ``digest`` is their SHA-256.  Of equal texts the
    row with the largest id stays, of text ids the last in order.  A null text counts as empty, a
    null id as the least one.  Rows that repeat both id and text are one document stored several
    times: all of them carry ``kept`` alike and ``repeats`` says how many there are.  An empty
    table gives no row.

    A digest found frequent by ``frequent_digests`` is verified by an exact count, and its
    winner is broadcast (at most ``counters`` rows): its copies never meet in one task.  All
    other digests are counted before the shuffle and joined back.
    """
    rows, frequent = _split(docs, id_col, text_col, counters)
    head = rows.join(F.broadcast(frequent), "digest")
    rest = rows.join(F.broadcast(frequent), "digest", "left_anti")
    return head.unionByName(rest.join(_winners(rest), "digest")).select(
        F.col("doc_id").alias(id_col), "digest", "keep_id", "group_size", "repeats",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = 1024) -> DataFrame:
    """The rows of ``docs`` that stay, one for each distinct text, with all their columns.

    Null texts and ids, ties and repeats are treated as in ``mark_duplicates``; of rows that repeat
    id and text one stays, always the same.  Columns of any name and type are handed through.  An
    empty table gives an empty one.

    Copies of frequent digests are removed where they are read, by the broadcast winners.  Ids and
    digests of the other rows are shuffled; of whole rows only those that may go (``without``).
    """
    rows, frequent = _split(docs, id_col, text_col, counters)
    rest = rows.join(F.broadcast(frequent), "digest", "left_anti")
    marks = written(rest.join(_winners(rest).filter("group_size > 1"), "digest"), "marks")
    left = docs.select(row_of(docs).alias("row"), named(id_col).alias("id"), _digest(text_col).alias("digest"))
    won = F.broadcast(frequent.select("digest", "keep_id", F.col("repeats").alias("times")))
    left = left.join(won, "digest", "left").filter("times IS NULL OR id <=> keep_id").drop("keep_id")

    def key(part: DataFrame) -> DataFrame:
        return part.select(F.col("doc_id").alias("id"), "digest")

    tail = left.filter("times IS NULL").select("row", "id", "digest")
    out = left.filter("times = 1").select("row").unionByName(
        without(tail, key(marks.filter("NOT doc_id <=> keep_id OR repeats > 1")), ["id", "digest"]).select("row"))
    again = key(marks.filter("doc_id <=> keep_id AND repeats > 1")).distinct()
    if not frequent.filter("repeats > 1").isEmpty() or not again.isEmpty():
        mine, other = tail.alias("mine"), again.alias("other")
        on = F.col("mine.id").eqNullSafe(F.col("other.id")) & (F.col("mine.digest") == F.col("other.digest"))
        several = left.filter("times > 1").select("row", "id", "digest").unionByName(mine.join(other, on, "left_semi"))
        out = out.unionByName(several.groupBy("id", "digest").agg(one_of("row").alias("row")).select("row"))
    return out.select("row.*")
