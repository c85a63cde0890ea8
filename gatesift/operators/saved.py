"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_SHARED = "/tmp/checkpoints"  # only for a session that runs on one machine and names no folder


def shared_folder(spark: SparkSession) -> str:
    """The folder which `spark.checkpoint.dir` names; every executor must reach it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder which all executors share")
    return LOCAL_SHARED


def saved(df: DataFrame) -> DataFrame:
    """The rows, written once: lineage ends here, and a lost executor costs its task and nothing before.

    The table stays in the folder until the cluster's own retention clears it, as checkpoints do.
    """
    path = f"{shared_folder(df.sparkSession)}/gatesift-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
