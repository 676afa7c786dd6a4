"""Where iterative jobs cut their lineage: files in a folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only for a local master, where it is unset."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    at = spark.conf.get("spark.checkpoint.dir", None) or (known.get() if known.isDefined() else None)
    if not at:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="tarnwick-")
    if not known.isDefined():
        sc.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """df, computed once into the shared folder; what reads it later doesn't depend on any executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
