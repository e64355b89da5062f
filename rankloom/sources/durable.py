"""What is kept between jobs: the shared checkpoint folder, and tables written to it."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``. Where it is unset a local session gets one of its own; on a cluster that is an error."""
    context = spark.sparkContext
    told = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if told is None and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(told or tempfile.mkdtemp(prefix="checkpoint-"))
    return told or context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder at once, with its lineage cut: what it took isn't done again, whatever executor is lost."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
