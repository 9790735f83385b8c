"""Incremental scan: newly arriving code tables are scanned in micro-batches.

Every check looks at one file at a time and merging groups within a file, so the
batch plan runs unchanged on each micro-batch and no state is kept between them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vulnsieve import schemas
from vulnsieve.plans.scan import scan


def read_code_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """A stream of ``file_id, path, content`` from parquet files that appear in a folder."""
    reader = spark.readStream.schema(schemas.CODE_FILES)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def scan_stream(
    files: DataFrame,
    sink: str,
    checkpoint: str,
    on_batch: Callable[[int, dict], None] | None = None,
    available_now: bool = True,
    **scan_options,
) -> StreamingQuery:
    """Writes the findings of every micro-batch to ``sink/batch_id=<n>``.

    A batch that is run again after a failure replaces its own folder, so findings are
    neither lost nor doubled.  ``on_batch`` receives the number of findings per batch.
    """

    def scan_batch(batch: DataFrame, batch_id: int) -> None:
        seen = Observation(f"scan-{batch_id}")
        found = scan(batch, **scan_options).observe(
            seen, F.count("*").alias("findings"), F.count_if(F.col("severity") == "critical").alias("critical"))
        found.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")
        if on_batch:
            on_batch(batch_id, seen.get)

    writer = files.writeStream.foreachBatch(scan_batch).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
