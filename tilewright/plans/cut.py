"""Lineage cuts that survive the loss of executors.

``cut`` writes a DataFrame as Parquet below the shared folder that the session
names in ``spark.checkpoint.dir`` and returns it reread. Unlike a local
checkpoint the rows are not tied to an executor, and unlike ``checkpoint()``
the plan runs once and the files are columnar.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}
_local: list[tempfile.TemporaryDirectory] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder; a temporary local one only in local mode, where none is set."""
    for get in (lambda: spark.conf.get("spark.checkpoint.dir", None), lambda: spark.sparkContext.getConf().get("spark.checkpoint.dir")):
        if found := get():
            return found.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local:
        _local.append(tempfile.TemporaryDirectory(prefix="tilewright-"))
    return f"file://{_local[0].name}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; the files go with ``forget`` or when the driver exits."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = spark
    made = spark.read.schema(df.schema).parquet(path)
    made._cut_path = path
    return made


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def forget(*cuts: DataFrame) -> None:
    """Delete the files of DataFrames that ``cut`` returned; for tables whose every reader has been written itself."""
    for df in cuts:
        if spark := _written.pop(df._cut_path, None):
            _delete(spark, df._cut_path)


@atexit.register
def sweep() -> None:
    """Delete what ``cut`` has written, as far as its session still runs."""
    while _written:
        path, spark = _written.popitem()
        try:
            _delete(spark, path)
        except Exception:  # the gateway is gone: the cluster's own clean-up takes over
            return
