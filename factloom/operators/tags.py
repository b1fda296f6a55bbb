"""Resolving requirement tags against a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import BARE_INTEGER
from factloom.plans.lineage import cut_lineage
from factloom.plans.prefixes import key_names

#: Rows of one set of tags that a task meets with its keys.
TASK_ROWS = 1 << 19


def resolve_tags(tags: DataFrame, keys: DataFrame, key: str = "req_id") -> DataFrame:
    """``(tag, key)`` for every manifest key that a tag names.

    An exact hit is the only hit; a qualified tag names the keys that continue it after a dot; a tag
    without prefix names the section, and what lies under it, of every prefix. Prefix matching is an
    equi-join on exploded key names, never a ``LIKE`` join.
    """
    asked = tags.select("tag").filter("tag IS NOT NULL").distinct()
    names = key_names(keys, key)
    exact_keys = names.select(F.col("key").alias("tag")).distinct()
    exact = asked.join(exact_keys, "tag", "left_semi").select("tag", F.col("tag").alias("key"))
    # a name without prefix that still holds a colon would read as a qualified tag
    loose = names.filter("rank = 1 AND (instr(name, ':') = 0 OR startswith(key, name))").select(
        F.col("name").alias("tag"), "key"
    )
    partial = asked.join(exact_keys, "tag", "left_anti").join(loose, "tag")
    return exact.unionByName(partial)


def annotation_tags(annotations: DataFrame) -> DataFrame:
    """One row per annotation and tag."""
    return annotations.withColumn("tag", F.explode("tags")).drop("tags")


def covered_keys(annotations: DataFrame, manifest: DataFrame) -> DataFrame:
    """Distinct manifest ids that some annotation names."""
    return resolve_tags(annotation_tags(annotations), manifest).select(F.col("key").alias("req_id")).distinct()


def tag_ambiguity(tags: DataFrame, keys: DataFrame, key: str = "req_id") -> DataFrame:
    """Bare integer tags that reach keys under more than one prefix."""
    bare = tags.filter(F.col("tag").rlike(BARE_INTEGER))
    hit = resolve_tags(bare, keys, key).filter(F.instr("key", ":") > 0)
    return (
        hit.groupBy("tag")
        .agg(
            F.count_distinct(F.substring_index("key", ":", 1)).alias("prefixes"),
            F.count("*").alias("keys"),
        )
        .filter("prefixes > 1")
    )


def orphan_tags(annotations: DataFrame, manifest: DataFrame) -> DataFrame:
    """Annotation tags that name no requirement; nothing when there is no manifest."""
    rows = annotation_tags(annotations)
    known = resolve_tags(rows, manifest).select("tag").distinct()
    return rows.join(known, "tag", "left_anti").filter(manifest.exists())


def wire_covers(tagged: DataFrame, manifest: DataFrame) -> DataFrame:
    """``COVERS`` edges from tagged rows (``id``, ``tags``) to manifest ids.

    Rows with the same set of tags share its keys, which are made distinct per set; the edges themselves, of which there may be far
    more than rows, are written as they are joined and never shuffled. The rows meet the keys of their set in all tasks of the session, or
    more, as a few rows may already give many edges; a set of many rows is dealt over several tasks.
    """
    tags = F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.collect_list("tags")))))
    own = tagged.groupBy("id").agg(tags.alias("_set")).filter(F.size("_set") > 0)
    sets = cut_lineage(own.groupBy("_set").agg(F.count("*").alias("_n")))
    rows, most = sets.agg(F.sum("_n"), F.max("_n")).first()
    least, shares = int(tagged.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(most or 1) // TASK_ROWS)
    each = sets.select("_set", F.explode("_set").alias("tag"))
    keys = each.join(resolve_tags(each, manifest), "tag").select("_set", "key").distinct()
    keys = keys.withColumn("_share", F.explode(F.sequence(*[F.lit(n).cast("long") for n in (0, shares - 1)])))
    own = own.withColumn("_share", F.pmod(F.xxhash64("id"), F.lit(shares).cast("long")))
    own = own.repartition(max(least, -(-(rows or 0) // TASK_ROWS)), "_set", "_share")
    met = own.join(keys.hint("shuffle_hash"), ["_set", "_share"])
    return met.select(F.col("id").alias("src"), F.lit("COVERS").alias("etype"), F.col("key").alias("dst"))


def first_covers(tagged: DataFrame, manifest: DataFrame) -> DataFrame:
    """The smallest of each row's ``COVERS`` edges: enough to tell which rows have one, and no more rows than ``tagged`` has."""
    rows = tagged.select("id", F.explode("tags").alias("tag"))
    first = resolve_tags(rows, manifest).groupBy("tag").agg(F.min("key").alias("key"))
    hit = rows.join(first, "tag").groupBy("id").agg(F.min("key").alias("dst"))
    return hit.select(F.col("id").alias("src"), F.lit("COVERS").alias("etype"), "dst")
