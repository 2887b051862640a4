"""Session helpers: shipping the package to Python workers, tables, and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Folders made by ``scratch`` in this process.
_MADE: list[str] = []
ROOT = str(Path(__file__).resolve().parent.parent)


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from the driver's checkout.

    On a cluster whose workers do not see the checkout, submit the package with
    ``--py-files``; the setting below is then harmless.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a dataset folder, read by Spark (any file system Spark can reach)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The frame dealt by keys to all cores if it comes in fewer partitions than there are cores; a large table stays as it is.

    For narrow rows before costly work on each: a small file is one partition, however many cores wait.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's shared ``spark.checkpoint.dir``.

    Only when that setting is missing (tests, local runs) a local folder is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "letterworks-scratch")
    _MADE.append(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def release_scratch(spark: SparkSession) -> None:
    """Delete the scratch folders of this process, once the results that read them have been written elsewhere."""
    while _MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared scratch folder and read it back: work is done once and lineage is cut."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
