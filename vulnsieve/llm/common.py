"""Helpers the operators share: folds, tables in the shared folder, text batches."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnsieve.session import checkpoint_dir

_FOLDERS: dict[int, str] = {}


def named(name: str) -> Column:
    """The column of that very name, also one with a dot or a backtick in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_of(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct."""
    return F.struct(*map(named, df.columns))


def one_of(row: str) -> Column:
    """Of several rows (structs) always the same one, whatever types they hold, maps included."""
    return F.min_by(row, F.sha2(F.to_json(row), 256))


FILTER_BLOCKS, FILTER_WORDS = 1 << 17, 4  # blocks of four 64-bit words: 33 million bits


def _probe(keys: list[Column]) -> tuple[Column, list[Column]]:
    """Block of a key and a one-bit mask for each word of the block."""
    bits = F.xxhash64(F.lit(1), *keys)
    masks = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
             for i in range(FILTER_WORDS)]
    return F.pmod(F.xxhash64(*keys), F.lit(FILTER_BLOCKS)), masks


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose ``keys`` (nulls are equal) are not among those of ``gone``, as an anti-join gives them.

    A Bloom filter of ``gone`` of a fixed size, some 5 MB, is broadcast, so rows that surely stay are
    not shuffled; the others meet ``gone`` in an exact join.  Where very many keys go, the filter
    lets through fewer rows and the join has more to do; the result is the same.
    """
    block, masks = _probe([F.col(k) for k in keys])
    words = [f"_word{i}" for i in range(FILTER_WORDS)]
    bloom = gone.groupBy(block.alias("_block")).agg(*[F.bit_or(m).alias(w) for w, m in zip(words, masks)])
    seen = rows.withColumn("_block", block).join(F.broadcast(bloom), "_block", "left")
    possible = reduce(lambda a, b: a & b, [F.coalesce(F.col(w).bitwiseAND(m) == m, F.lit(False)) for w, m in zip(words, masks)])
    other = gone.select(*[F.col(k).alias(f"_gone{i}") for i, k in enumerate(keys)]).distinct()
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_gone{i}")) for i, k in enumerate(keys)])
    tested = seen.filter(possible).join(other, on, "left_anti")
    return seen.filter(~possible).select(*rows.columns).unionByName(tested.select(*rows.columns))


def fold(id_col: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    col = named(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % parts


def whole_text(text_col: str) -> Column:
    return F.coalesce(named(text_col).cast("string"), F.lit(""))


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session has ended already; the folder is scratch space
        pass


def _folder(spark: SparkSession) -> str:
    """This application's scratch folder below the shared one; removed when the driver ends."""
    key = id(spark.sparkContext)
    if key not in _FOLDERS:
        _FOLDERS[key] = f"{checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _FOLDERS[key])
    return _FOLDERS[key]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage and survives lost executors."""
    path = f"{_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it Spark hands Python at most ``rows`` rows at a time: whole texts lie in the executor and in its worker
    as often as a batch is built, sent and read.  Only for jobs that end within it; the session's setting comes back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    if not 0 < int(was) <= rows:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, was)


def slices(batch: pa.RecordBatch, text: str, limit: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch holding about ``limit`` bytes of text each, so that what is
    derived from them stays small however long the texts are."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start = size = 0
    for i, n in enumerate(lengths):
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield start, len(lengths)
