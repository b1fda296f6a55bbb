"""From raw documents to packed training batches, stage by stage.

``STAGES`` holds ``(name, function)``; each function takes ``(spark, docs, sf_dir)`` and works on all that the stage
before it kept. ``run`` writes each stage's result as Parquet in the shared folder and reads it again. All stages but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm.line_templates import without_recurring_lines
from factloom.llm.near_dups import drop_near_duplicates
from factloom.llm.packing import pack
from factloom.llm.quality import keep_good
from factloom.llm.storage import stored
from factloom.llm.toxicity import keep_clean


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_clean(docs, _labels(spark, sf_dir))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, _labels(spark, sf_dir))


def recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_recurring_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("quality", quality),
    ("recurring_lines", recurring_lines),
    ("near_duplicates", near_duplicates),
    ("packing", packing),
]

#: No SQL twin: trained models, MinHash and templates are tested against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
