"""Reliable cuts of lineage, for plans that are built in rounds."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """The rows as a checkpoint in the folder that the session shares with its executors.

    That is ``spark.checkpoint.dir`` or the folder set on the context; only a local master may do without.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tessera-"))
    return df.checkpoint(eager=True)
