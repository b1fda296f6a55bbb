"""Prefix matching as an equi-join: keys are exploded into the tags that may name them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dotted_prefixes(col: Column) -> Column:
    """``a.b.c`` -> ``[a, a.b, a.b.c]``: the key and its dotted ancestors."""
    parts = F.split(col, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), ".")
    )


def key_names(keys: DataFrame, key: str) -> DataFrame:
    """``(key, name, rank)``: every tag text that reaches a manifest key.

    A tag names a key when it equals it (rank 0), when the key continues it after a dot, or, for a tag
    without ``p:``, when the same holds for the part of the key after any prefix (rank 1). A key of d
    dotted parts gives at most 2d names, whatever the number of tags.
    """
    k = F.col(key)
    ids = keys.select(k.alias("key")).filter("key IS NOT NULL").distinct()
    k = F.col("key")
    has_prefix = F.instr(k, ":") > 0
    prefix = F.substring_index(k, ":", 1)
    local = F.expr("substring(key, instr(key, ':') + 1)")
    rebuilt = F.transform(dotted_prefixes(local), lambda p: F.concat(prefix, F.lit(":"), p))
    names = F.when(has_prefix, F.array_distinct(F.concat(rebuilt, dotted_prefixes(local)))).otherwise(
        F.array(k)
    )
    out = ids.select("key", F.explode(names).alias("name"))
    return out.withColumn("rank", F.when(F.col("name") == F.col("key"), 0).otherwise(1))
