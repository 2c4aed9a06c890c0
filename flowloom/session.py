"""A Spark session with the settings the engine expects."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(name: str = "flowloom", **conf: str) -> SparkSession:
    """UTC and adaptive execution; anything else is the cluster's, or given as ``spark.key=value``."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """A new folder's name where driver and executors can write: in ``spark.checkpoint.dir``, or a temporary one if all runs on this machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/flowloom-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="flowloom-")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if it is stored in fewer pieces: a small table is often one row group, so one task.

    Pieces are counted without reading a column; a table of as many pieces as there are cores stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    pieces = df.select(F.spark_partition_id().alias("p")).distinct().count()
    return df.repartition(cores) if 0 < pieces < cores else df
