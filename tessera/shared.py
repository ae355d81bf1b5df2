"""Where long lineages are cut: the checkpoint folder that the cluster names."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's folder for checkpoints, which executors share; a temporary one where none is named and all run in one process."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Computes the rows now and writes them to the shared folder; later jobs read them from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
