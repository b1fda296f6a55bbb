"""Keeping fact tables up to date: set operations, file removal, upsert, overlay, path remapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.plans.keyed import pick_last

# Edge types that are rebuilt by wiring.
WIRED = ["READS", "DEPENDS_ON", "PROPAGATED_FROM"]


def id_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(id, side)``: ids only in a, only in b, or in both. One shuffle, no joins."""
    rows = a.select(F.col(a.columns[0]).alias("id"), F.lit(1).alias("s")).unionByName(
        b.select(F.col(b.columns[0]).alias("id"), F.lit(2).alias("s"))
    )
    sides = rows.groupBy("id").agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    side = F.when(F.col("lo") < F.col("hi"), "both").when(F.col("lo") == 1, "only_a").otherwise("only_b")
    return sides.select("id", side.alias("side"))


def _without_nodes(edges: DataFrame, gone: DataFrame) -> DataFrame:
    ids = gone.select("id").distinct()
    kept = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti")
    return kept.join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti").select(*edges.columns)


def remove_file(nodes: DataFrame, edges: DataFrame, path: str) -> dict[str, DataFrame]:
    """Tables without the nodes of a file, every edge that touches one, and its synthetic write edges."""
    gone = nodes.filter(F.col("path") == path)
    left = _without_nodes(edges, gone).filter(
        ~((F.col("etype") == "WRITES") & F.startswith("src", F.lit(path + ":")))
    )
    return {"nodes": nodes.filter(F.coalesce(F.col("path") != path, F.lit(True))), "edges": left}


def upsert_file(
    nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, path: str, tier: int
) -> dict[str, DataFrame]:
    """Replace the rows of a file that come from this tier or a lower one.

    A row of a higher tier stays and wins over a new one with its id; edges of removed ids go, new ones
    come in once. ``tier`` is a number in the nodes table, higher is better.
    """
    replaced = (F.col("path") == path) & (F.col("tier") <= tier)
    gone = nodes.filter(replaced)
    kept = nodes.filter(~F.coalesce(replaced, F.lit(False)))
    fresh = new_nodes.join(kept.select("id"), "id", "left_anti").select(*nodes.columns)
    really_gone = gone.select("id").join(new_nodes.select("id"), "id", "left_anti")
    # edges that start at a replaced node are rebuilt by the new batch
    base = _without_nodes(edges, really_gone).join(
        gone.select(F.col("id").alias("src")).distinct(), "src", "left_anti"
    ).select(*edges.columns)
    return {
        "nodes": kept.unionByName(fresh),
        "edges": base.unionByName(new_edges.select(*edges.columns)).dropDuplicates(["src", "etype", "dst"]),
    }


def overlay_merge(base: DataFrame, changes: DataFrame) -> DataFrame:
    """Files as a session sees them: ``changes(path, op, content, seq)`` laid over ``base(path, content)``.

    The last change of a path counts: a delete hides the file, a later change brings it back, a created
    file is empty until its first change.
    """
    last = pick_last(changes.select("path", "op", "content", "seq"), ["path"], ["seq"])
    untouched = base.select("path", "content").join(last.select("path"), "path", "left_anti")
    live = last.filter("op <> 'delete'").select("path", F.coalesce("content", F.lit("")).alias("content"))
    return untouched.withColumn("origin", F.lit("base")).unionByName(live.withColumn("origin", F.lit("overlay")))


def remap_prefix(col: Column, old: str, new: str) -> Column:
    """``old`` as a leading directory (or the whole path, or the path part of an id) becomes ``new``."""
    hit = (col == old) | F.startswith(col, F.lit(old + "/")) | F.startswith(col, F.lit(old + ":"))
    return F.when(hit, F.concat(F.lit(new), F.substring(col, len(old) + 1, 1 << 30))).otherwise(col)


def remap_paths(df: DataFrame, old: str, new: str, columns: list[str]) -> DataFrame:
    return df.withColumns({c: remap_prefix(F.col(c), old, new) for c in columns})


def clear_wiring(edges: DataFrame) -> DataFrame:
    return edges.filter(~F.col("etype").isin(WIRED))


def merge_tables(parts: list[DataFrame]) -> DataFrame:
    """Node tables of several corpora; a later table replaces rows with the same id."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("_batch", F.lit(i))
        out = p if out is None else out.unionByName(p)
    return pick_last(out, ["id"], ["_batch"]).drop("_batch")


def merge_edges(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates(["src", "etype", "dst"])
