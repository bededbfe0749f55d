"""Cutting the lineage of iterative plans."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder (spark.checkpoint.dir, which all nodes share; one of its own where Spark is local)."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="lintel-"))
    return df.checkpoint()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df, dealt by keys to all cores. A small file is one split, and adaptive plans join small shuffles into one task, however much
    work its rows make; what is grouped by the keys afterwards needs no other shuffle."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)
