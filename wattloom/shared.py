"""Data that jobs leave for later jobs: checkpoints in the folder that the whole cluster sees."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Without that setting only a local session gets one, a temporary one: on a cluster such a folder would be the driver's own disk."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="wattloom-")
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed eagerly: its lineage ends here, and lost executors cost no earlier step."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)
