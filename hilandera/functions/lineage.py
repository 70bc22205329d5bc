"""Lineage cuts for iterative plans: reliable checkpoints in the folder that the session names."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

#: Used where a session names no shared folder, as in tests on one machine.
LOCAL = "/tmp/checkpoints/hilandera"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; a local folder in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named is not None:
        return named
    if not (spark.sparkContext.master or "").startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    os.makedirs(LOCAL, exist_ok=True)
    return f"file://{LOCAL}"


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and read back from the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
