"""Session helpers shared by every part of the library."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows of a batch that goes to a Python worker. Texts are long: 10,000 of them would fill a worker's memory.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_ROOT = str(Path(__file__).resolve().parent.parent)


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package where it isn't installed, and send them smaller batches.

    Workers take PYTHONPATH from the context's environment. On a cluster the package is
    installed or shipped with ``--py-files`` and the extra entry is harmless.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, _ROOT])
    if spark.conf.get(BATCH_ROWS) == "10000":  # Spark's default
        spark.conf.set(BATCH_ROWS, "1000")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, one of our own on this machine if all runs on it, else one in the warehouse, which must not be on a machine's own disk."""
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    current = context._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        local, warehouse = context.master.startswith("local"), spark.conf.get("spark.sql.warehouse.dir")
        if not local and spark._jvm.org.apache.hadoop.fs.Path(warehouse).getFileSystem(spark._jsc.hadoopConfiguration()).getScheme() == "file":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="weftmine-") if local else f"{warehouse}/weftmine-{uuid.uuid4().hex}")
        current = context._jsc.sc().getCheckpointDir()
    return current.get()


def cut(df: DataFrame) -> DataFrame:
    """Compute df once into the shared folder; what follows reads it from there, whatever executors are lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Like cut, for larger tables: as Parquet in the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def reopened(spark: SparkSession, path: str) -> DataFrame:
    """A table that stored() wrote, perhaps in another session."""
    return spark.read.parquet(path)


def dropped_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder on whatever file system it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop(*tables: DataFrame) -> None:
    """Delete what stored() wrote."""
    for df in tables:
        for folder in {os.path.dirname(f) for f in df.inputFiles()}:
            dropped_folder(df.sparkSession, folder)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of finished work now; else they stay until the driver collects garbage."""
    gc.collect()
    spark._jvm.System.gc()
