"""Checkpoints in the folder that a cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Only a local session without one (tests, notebooks) gets a temporary folder, since driver and executors are then one process; elsewhere it is an error."""
    context = spark.sparkContext
    if context.getConf().get("spark.checkpoint.dir"):
        return context.getConf().get("spark.checkpoint.dir")
    if context.getCheckpointDir() is None:
        if not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="gridfold-checkpoint-"))
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage of `df` with a reliable checkpoint in the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
