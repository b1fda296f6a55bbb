"""Cutting lineage in iterative jobs.

State of a loop is written through ``DataFrame.checkpoint`` into the shared folder named by
``spark.checkpoint.dir``, so that a lost executor costs a re-read and never a restart of the loop.
Only a single process (``local`` or ``local[n]``) may fall back to a folder of its own.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints, read from the session; set only where it is unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can read")
        named = tempfile.mkdtemp(prefix="factloom-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably and return it without its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
