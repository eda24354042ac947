"""Cutting the lineage of iterative work at files every executor can read."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def settle_rounds(df: DataFrame) -> DataFrame:
    """Checkpoint a frame in the folder the cluster names in spark.checkpoint.dir."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            named = tempfile.mkdtemp(prefix="statetrail-")
        context.setCheckpointDir(named)
    return df.checkpoint()
