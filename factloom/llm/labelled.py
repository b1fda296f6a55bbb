"""Folds by document id, and bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: str, folds: int) -> F.Column:
    """``crc32`` of the id as text, modulo ``folds``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


def sample(labels: DataFrame, label: str, folds: int, out: int, most: int) -> DataFrame:
    """At most ``most`` ids of each label outside fold ``out``: ``(doc_id, y)``, the same rows at every run.

    An id with several labels has the largest one; null ids and labels are left out. The rows with the smallest
    hashes are taken, so a larger table gives another sample of the same size.
    """
    y = F.col(label).cast("int")
    known = labels.filter(F.col("doc_id").isNotNull() & y.isNotNull()).groupBy("doc_id").agg(F.max(y).alias("y"))
    known = known.filter(remainder("doc_id", folds) != out)
    order = F.xxhash64("doc_id")
    return known.filter("y = 1").orderBy(order).limit(most).unionByName(known.filter("y = 0").orderBy(order).limit(most))
