"""Tables written to the shared folder that the cluster names."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from vulnsieve.session import checkpoint_dir

_FOLDERS: dict[int, str] = {}


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session has ended already; the folder is scratch space
        pass


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place in this application's folder, which is removed when the driver ends."""
    key = id(spark.sparkContext)
    if key not in _FOLDERS:
        _FOLDERS[key] = f"{checkpoint_dir(spark).rstrip('/')}/vulnsieve-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _FOLDERS[key])
    return f"{_FOLDERS[key]}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """``df`` as a table: computed once, with lineage cut, there for lost executors too."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)
