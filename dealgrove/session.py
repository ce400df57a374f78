"""Session helpers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the jobs are written for. A cluster deployment passes its own values
# for the sizes; nothing in the library depends on a particular number.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    ``spark.checkpoint.dir`` names it; where that is unset, on any master, it is a folder
    below ``spark.sql.warehouse.dir``, which all executors share as well.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_intermediate"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def shared_table(spark: SparkSession, name: str) -> str:
    """A fresh path for one intermediate table below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss and keeps iterative plans short."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table of their own in the shared folder: lineage is cut as by
    :func:`cut_lineage`, in compressed columns of which later steps read what they need.

    Spark sizes such a table by its compressed files, and would send rows of many times that size
    through the driver to every executor; so its joins are asked to be shuffled ones.
    """
    path = shared_table(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).hint("merge")
