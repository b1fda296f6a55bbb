"""Fact tables on disk: a snapshot directory per version and a pointer to the current one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.maintain import merge_edges, merge_tables

#: Tables that are looked up by one column are written in ranges of it, so that scans skip files.
CLUSTER_BY = {"edges": ["etype", "src"], "symbols": ["name"], "requirements": ["monitor_action"]}


_POINTER = "seq bigint, version string, tables string"


def write_index(tables: dict[str, DataFrame], dir_: str, seq: int = 0) -> None:
    """Write every table under ``dir/v<seq>`` and then append the version to the snapshot log.

    A table with a ``corpus`` column is partitioned by it. A retry of a version overwrites its own
    directory and the log is only appended to, so readers never see half a snapshot.
    """
    spark = next(iter(tables.values())).sparkSession
    version = f"v{seq}"
    for name, df in tables.items():
        cluster = [c for c in CLUSTER_BY.get(name, []) if c in df.columns]
        out = df.repartitionByRange(*cluster).sortWithinPartitions(*cluster) if cluster else df
        writer = out.write.mode("overwrite")
        if "corpus" in df.columns:
            writer = writer.partitionBy("corpus")
        writer.parquet(f"{dir_}/{version}/{name}")
    entry = spark.createDataFrame([(seq, version, ",".join(sorted(tables)))], _POINTER)
    entry.coalesce(1).write.mode("append").json(f"{dir_}/snapshots")


def load_index(spark: SparkSession, dir_: str, before: int | None = None) -> dict[str, DataFrame]:
    """Tables of the newest snapshot, or of the newest one numbered below ``before``."""
    log = spark.read.schema(_POINTER).json(f"{dir_}/snapshots")
    if before is not None:
        log = log.filter(F.col("seq") < before)
    row = log.orderBy(F.col("seq").desc()).first()
    return {t: spark.read.parquet(f"{dir_}/{row['version']}/{t}") for t in row["tables"].split(",")}


def merge_indexes(spark: SparkSession, dirs: list[str]) -> dict[str, DataFrame]:
    """One model from several indexes: the last node with an id wins, edges are kept once."""
    loaded = [load_index(spark, d) for d in dirs]
    out = {}
    for name in sorted({t for idx in loaded for t in idx}):
        parts = [idx[name] for idx in loaded if name in idx]
        if {"src", "etype", "dst"} <= set(parts[0].columns):
            out[name] = merge_edges(parts)
        elif "id" in parts[0].columns:
            out[name] = merge_tables(parts)
        else:
            merged = parts[0]
            for p in parts[1:]:
                merged = merged.unionByName(p, allowMissingColumns=True)
            out[name] = merged.distinct()
    return out
