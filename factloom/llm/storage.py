"""Intermediate tables in the shared folder that the session names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import uuid
from urllib.parse import urlparse

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from factloom.plans.lineage import ensure_checkpoint_dir


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder name below the session's checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back: lineage ends here, executors may go."""
    spark = df.sparkSession
    path = shared_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The Arrow file system of a path and the path inside it, for tasks that read or write bytes themselves."""
    parsed = urlparse(path)
    if parsed.scheme in ("", "file"):
        return fs.LocalFileSystem(), parsed.path
    if parsed.scheme in ("s3a", "s3n"):  # Spark's names of what Arrow calls s3
        path = "s3" + path[len(parsed.scheme) :]
    return fs.FileSystem.from_uri(path)
