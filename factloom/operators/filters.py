"""Selections and classifications over fact tables; all push down to the scan or join by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import last_component, module_of  # noqa: F401  (part of this API)

# Rank of each severity, and the severities each diagnostic mode shows.
SEVERITY_RANK = {"error": 4, "warning": 3, "info": 2, "hint": 1}
MODES = {
    "basic": ["error"],
    "standard": ["error", "warning", "info"],
    "strict": ["error", "warning", "info", "hint"],
}


def nodes_of_type(nodes: DataFrame, kind: str) -> DataFrame:
    return nodes.filter(F.col("node_type") == kind)


def first_node_of_type(nodes: DataFrame, kind: str) -> DataFrame:
    """The node of a type with the smallest id."""
    return nodes_of_type(nodes, kind).orderBy("id").limit(1)


def nodes_by_name(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.filter(F.col("name") == name)


def nodes_in_file(nodes: DataFrame, path: str) -> DataFrame:
    return nodes.filter(F.col("path") == path)


def get_node(nodes: DataFrame, node_id: str) -> DataFrame:
    return nodes.filter(F.col("id") == node_id)


def outgoing(edges: DataFrame, node_id: str, etype: str | None = None) -> DataFrame:
    rows = edges.filter(F.col("src") == node_id)
    return rows if etype is None else rows.filter(F.col("etype") == etype)


def incoming(edges: DataFrame, node_id: str, etype: str | None = None) -> DataFrame:
    rows = edges.filter(F.col("dst") == node_id)
    return rows if etype is None else rows.filter(F.col("etype") == etype)


def filter_scope(
    items: DataFrame,
    scope_members: DataFrame,
    scope: str | None = None,
    path: str | None = None,
    is_dir: bool = False,
) -> DataFrame:
    """Rows of the files a scope covers; the scope goes before the path.

    An unknown scope covers its own file only; a directory path is a prefix, a file path an equality;
    without arguments all rows stay.
    """
    if scope is not None:
        members = scope_members.filter(F.col("scope_file") == scope).select(
            F.col("member_path").alias("path")
        )
        alone = items.sparkSession.createDataFrame([(scope,)], "path string").filter(~members.exists())
        return items.join(members.unionByName(alone).distinct(), "path", "left_semi")
    if path is None:
        return items
    if is_dir:
        return items.filter(F.startswith("path", F.lit(path.rstrip("/") + "/")))
    return items.filter(F.col("path") == path)


def filter_corpus(items: DataFrame, text: str) -> DataFrame:
    return items.filter(F.contains("path", F.lit(text)))


def filter_visible(items: DataFrame, file_layers: DataFrame, active: list[str]) -> DataFrame:
    """Rows of files in an active layer or in none; an empty list restricts nothing."""
    if not active:
        return items
    hidden = file_layers.filter(~F.col("layer").isin(active)).select("path").distinct()
    return items.join(hidden, "path", "left_anti")


def filter_in_any_scope(files: DataFrame, scope_members: DataFrame) -> DataFrame:
    member = scope_members.select(F.col("member_path").alias("path")).distinct()
    return files.join(member, "path", "left_semi")


def severity_rank(severity: Column) -> Column:
    return F.coalesce(
        F.create_map(*[F.lit(x) for kv in SEVERITY_RANK.items() for x in kv])[severity], F.lit(0)
    )


def filter_severity(diags: DataFrame, minimum: str) -> DataFrame:
    return diags.filter(severity_rank(F.col("severity")) >= SEVERITY_RANK[minimum])


def filter_mode(diags: DataFrame, mode: str = "standard") -> DataFrame:
    return diags.filter(F.col("severity").isin(MODES[mode]))


def requirement_class() -> Column:
    """TESTER_ONLY, GUARANTEE or ASSUMPTION, in this order of tests."""
    return (
        F.when(F.contains("formula_text", F.lit("_generating")), "TESTER_ONLY")
        .when(F.col("mixin_kind").isin("after", "around"), "GUARANTEE")
        .when(F.col("kind").isin("ensure", "assert"), "GUARANTEE")
        .otherwise("ASSUMPTION")
    )


def classify_requirement(reqs: DataFrame) -> DataFrame:
    return reqs.withColumn("class", requirement_class())


def classify_direction(actions: DataFrame, scope_exports: DataFrame) -> DataFrame:
    """GENERATED when exported, else RECEIVED when imported, else INTERNAL."""
    flags = scope_exports.groupBy("name").agg(
        F.max(F.col("direction") == "export").alias("exported"),
        F.max(F.col("direction") == "import").alias("imported"),
    )
    return (
        actions.join(flags, "name", "left")
        .withColumn(
            "action_direction",
            F.when(F.col("exported"), "GENERATED").when(F.col("imported"), "RECEIVED").otherwise("INTERNAL"),
        )
        .drop("exported", "imported")
    )
