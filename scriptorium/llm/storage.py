"""Shared scratch space for cutting lineage without losing recovery.

Intermediate tables go to the folder that the cluster names in
``spark.checkpoint.dir``, so any executor can read what another wrote and a
lost executor costs a re-read only. All scratch of an application lies in one
folder, which ``clear`` removes; ``discard`` removes a table as soon as what was
made from it is written. Where the setting is missing and the session runs
inside one process (tests) a temporary folder of this process is used; a
cluster without the setting is an error.
"""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_dir

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder name below ``spark.checkpoint.dir``."""
    return f"{scratch_dir(spark)}/{uuid.uuid4().hex}"


def materialise(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Python functions see ``BATCH_ROWS`` texts at a time meanwhile, which bounds
    what a task holds on both sides of the pipe.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS))
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove the files of materialised tables that nothing still to be run will read, and the shuffles behind them."""
    for t in tables:
        delete(t.sparkSession, t._scratch)
    tidy(tables[0].sparkSession)


def tidy(spark: SparkSession) -> None:
    """Let the driver collect its garbage now: Spark's cleaner then drops shuffles and broadcasts that no plan refers to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def clear(spark: SparkSession) -> None:
    """Remove all scratch of this application; results that were not written elsewhere go with it."""
    delete(spark, scratch_dir(spark))


def delete(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder on whatever file system holds it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
