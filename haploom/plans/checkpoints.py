"""Lineage cuts in the folder that the cluster's machines share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only where that is unset (tests, one machine) a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="haploom-ckpt-"))
    return spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the files."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the shared folder; ``delete`` removes it when it has been used."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def delete(df: DataFrame) -> None:
    """Remove the folders of a stored table."""
    remove(df.sparkSession, *{f.rsplit("/", 1)[0] for f in df.inputFiles()})


def remove(spark: SparkSession, *folders: str) -> None:
    """Delete folders by Hadoop's file systems, wherever they are."""
    for folder in folders:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files and checkpoints that nothing refers to; it does so only after a collection of the driver's garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def dealt_once(spark: SparkSession) -> Iterator[None]:
    """What is computed inside (``cut``, ``stored``) joins tables that are dealt by some of the join's keys where they lie, instead of dealing them by all of its keys; results are the same."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)
