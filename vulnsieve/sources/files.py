"""Code files and manifests from a file system."""

from __future__ import annotations

import posixpath
from collections.abc import Collection, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

from vulnsieve.catalog import patterns as P
from vulnsieve.functions.text import fold_line_ends


def _any_case(extension: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in extension)


def _local_path() -> Column:
    """The path without its scheme, percent escapes resolved."""
    return F.url_decode(F.regexp_replace(
        F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")), F.lit("^[a-z0-9]+:/+"), F.lit("/")))


_FILE = "path string, modificationTime timestamp, length long, content binary"  # fixed: the binary file source


def _listing(reader: DataFrameReader | DataStreamReader, path: str, glob: str | None, recursive: bool) -> DataFrame:
    reader = reader.format("binaryFile").schema(_FILE).option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def read_code_files(
    spark: SparkSession,
    path: str,
    recursive: bool = True,
    extensions: Collection[str] | None = None,
    max_files: int | None = None,
    max_bytes: int | None = None,
    decode: bool = True,
) -> DataFrame:
    """``file_id, path, content`` of the code files under a directory (or of one file).

    Files of other extensions or inside skipped directories are pruned from the listing,
    before any content is read.  All others are read, unless the caller sets a limit:
    ``max_bytes`` leaves larger files out (``skipped_files`` lists them), ``max_files`` keeps
    the first files in path order, part by part, for which the listing is sorted once.
    """
    listed = _listed(spark.read, path, recursive, extensions)
    tasks, files = _tasks(listed), _code_files(listed, path)
    if max_bytes is not None:
        files = files.filter(F.col("_metadata.file_size") <= max_bytes)
    if max_files is not None:
        # Only the last path that fits is fetched; the cut then prunes the listing too.
        parts = F.split(_local_path(), "/", -1)
        last = files.select(parts.alias("p")).orderBy("p").limit(max_files).agg(F.max("p")).first()[0]
        files = files.filter(parts <= F.array(*[F.lit(x) for x in last or [""]]))
    return _numbered(files if tasks is None else files.coalesce(tasks), decode)


#: Input splits that one task may read; of small files each holds some.
SPLITS_A_TASK = 256


def _tasks(listed: DataFrame) -> int | None:
    """How many tasks read the files, where Spark's own splits are far too many.

    Spark counts 4 MB for the opening of a file, so small files come a few to a split and a tree of many has
    far more splits than it has work.  A task takes as many as hold the bytes of one split, all tasks still
    being some for each core.
    """
    spark, splits = listed.sparkSession, listed.select("length").rdd.getNumPartitions()
    size = int(listed._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    most = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    tasks = max(-(-size // most), 4 * spark.sparkContext.defaultParallelism, -(-splits // SPLITS_A_TASK))
    return tasks if tasks < splits else None


def _numbered(files: DataFrame, decode: bool) -> DataFrame:
    numbered = files.select(
        F.xxhash64(_local_path()).alias("file_id"), _local_path().alias("path"), "content")
    return decode_content(numbered) if decode else numbered


def read_code_file_stream(
    spark: SparkSession, path: str, recursive: bool = True, extensions: Collection[str] | None = None,
    max_files_per_trigger: int | None = None, decode: bool = True,
) -> DataFrame:
    """``read_code_files`` as a stream: every file once, when it has appeared in the tree.

    A file is known by its path; one that is changed in place is not read again.
    """
    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return _numbered(_code_listing(reader, path, recursive, extensions), decode)


def skipped_files(
    spark: SparkSession, path: str, max_bytes: int, recursive: bool = True, extensions: Collection[str] | None = None,
) -> DataFrame:
    """``path, size, reason`` of the code files that ``max_bytes`` leaves out; no content is read."""
    size = F.col("_metadata.file_size")
    return _code_listing(spark.read, path, recursive, extensions).filter(size > max_bytes).select(
        _local_path().alias("path"), size.alias("size"), F.lit(f"larger than {max_bytes} bytes").alias("reason"))


def _listed(
    reader: DataFrameReader | DataStreamReader, path: str, recursive: bool, extensions: Collection[str] | None,
) -> DataFrame:
    wanted = sorted(extensions or set(P.EXTENSION_LANGUAGE))
    return _listing(reader, path, "*{" + ",".join(_any_case(e) for e in wanted) + "}", recursive)


def _code_listing(
    reader: DataFrameReader | DataStreamReader, path: str, recursive: bool, extensions: Collection[str] | None,
) -> DataFrame:
    return _code_files(_listed(reader, path, recursive, extensions), path)


def _code_files(listed: DataFrame, path: str) -> DataFrame:
    root = path.rstrip("/")
    below = F.substring(_local_path(), len(root.split(":", 1)[-1].replace("//", "/")) + 1, 1 << 20)
    skipped = F.arrays_overlap(
        F.slice(F.split(below, "/", -1), 1, F.greatest(F.size(F.split(below, "/", -1)) - 1, F.lit(0))),
        F.array(*[F.lit(d) for d in P.SKIP_DIRS]))
    return listed.filter(~skipped)


def decode_content(files: DataFrame) -> DataFrame:
    """Bytes to text: UTF-8 where valid, else Latin-1; all line ends become LF."""
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(
        F.decode("content", "ISO-8859-1"))
    return files.withColumn("content", text).withColumn("content", fold_line_ends(F.col("content")))


def order_files(files: DataFrame) -> DataFrame:
    return files.orderBy("path")


def read_manifests(spark: SparkSession, root: str) -> DataFrame:
    """``project, path, file_name, content``: manifests at the root or one directory below."""
    names = "{" + ",".join(name for name, _ in P.MANIFEST_FILES) + "}"
    base = root.rstrip("/")
    # two levels are listed, not the tree below them
    listed = [_listing(spark.read, f"{base}/{level}", names, recursive=False) for level in ("", "*/")]
    local = base.split(":", 1)[-1].replace("//", "/")
    below = F.split(F.substring(_local_path(), len(local) + 2, 1 << 20), "/", -1)
    at_root = F.size(below) == 1
    one_down = (F.size(below) == 2) & ~F.get(below, F.lit(0)).isin(P.MANIFEST_SKIP_DIRS)
    return listed[0].filter(at_root).select("*", "_metadata").unionByName(listed[1].filter(one_down).select("*", "_metadata")).select(
        F.lit(local).alias("project"), F.concat_ws("/", below).alias("path"),
        F.element_at(below, -1).alias("file_name"), F.col("content").cast("string").alias("content"))


def write_files(rows: DataFrame, path: str) -> None:
    """Every row of ``folder, name, content`` as a text file ``path/folder/name``: the content and a line end.

    The tasks write through Arrow's file systems: a file costs no folder, no checksum file and no call of a
    shell.  A file gets its name when it is complete, so a task that runs again or twice leaves the same files.
    Where Arrow does not know the file system Spark's writer makes ``path/folder=…/name=…/part-…``.
    """
    spark = rows.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toString()
    try:
        fs.FileSystem.from_uri(uri)
    except (OSError, ValueError):
        rows.select("folder", "name", "content").write.partitionBy("folder", "name").text(path)
        return

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(uri)
        attempt, made, n = TaskContext.get().taskAttemptId(), set(), 0
        for batch in batches:
            for folder, name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                inside = posixpath.join(root, folder)
                if folder not in made:
                    files.create_dir(inside, recursive=True)
                    made.add(folder)
                with files.open_output_stream(draft := posixpath.join(inside, f".{name}.{attempt}")) as out:
                    out.write((content or b"") + b"\n")
                files.move(draft, posixpath.join(inside, name))
                n += 1
        yield pa.RecordBatch.from_pydict({"n": [n]}, pa.schema([("n", pa.int64())]))

    rows.select("folder", "name", F.col("content").cast("binary")).mapInArrow(write, "n long").agg(F.sum("n")).collect()
