"""Edges of the fact graph: ``(src, etype, dst)``, each once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import exploded, last_component

#: Rows whose hash table and sort a task holds.
TASK_ROWS = 1 << 19
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_.]*"


def _edges(df: DataFrame, src: str, etype: str | Column, dst: str) -> DataFrame:
    etype = F.lit(etype) if isinstance(etype, str) else etype
    return df.select(F.col(src).alias("src"), etype.alias("etype"), F.col(dst).alias("dst")).distinct()


def wire_reads(formulas: DataFrame, state_vars: DataFrame) -> DataFrame:
    """``READS`` edges from formulas (``id``, ``formula_text``) to the variables they mention.

    A token that is a known name counts whole; any other token counts by its dotted suffixes and its
    parts that are known names.
    """
    known = state_vars.select(F.col("name").alias("token")).distinct()
    found = F.array_distinct(F.regexp_extract_all("formula_text", F.lit(IDENTIFIER), F.lit(0)))
    tokens = exploded(formulas, ["id"], found, "token")
    whole = tokens.join(known, "token", "left_semi")
    parts = F.split("token", r"\.")
    size = F.size(parts)
    suffixes = F.transform(
        F.sequence(F.lit(2), size), lambda i: F.array_join(F.slice(parts, i, size), ".")
    )
    pieces = (
        tokens.filter(F.contains("token", F.lit(".")))
        .join(known, "token", "left_anti")
        .select("id", F.explode(F.array_distinct(F.concat(suffixes, parts))).alias("token"))
        .join(known, "token", "left_semi")
    )
    return _edges(whole.unionByName(pieces), "id", "READS", "token")


def wire_constrains(reqs: DataFrame) -> DataFrame:
    """``CONSTRAINS`` edges from requirements to the action they monitor."""
    known = reqs.filter(F.coalesce("monitor_action", F.lit("")) != "").select("id", "monitor_action")
    # an id rarely comes twice: dealt by it, over tasks of bounded size, the rows are made distinct and joined by id where they are
    least = int(reqs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = known.repartition(max(least, -(-reqs.count() // TASK_ROWS)), "id")
    return _edges(known, "id", "CONSTRAINS", "monitor_action")


def wire_depends_on(properties: DataFrame, reads: DataFrame, axioms: DataFrame | None = None) -> DataFrame:
    """``DEPENDS_ON`` edges: a property that shares a variable with an axiom depends on the axiom.

    Without ``axioms`` the edges go through the shared variable: ``(property, SHARES, variable)`` and
    ``(variable, AXIOM, axiom)``, for variables with both sides. That form holds every pair and stays as
    small as its input, also when one variable is everywhere. With ``axioms(id)`` the pairs of those
    axioms are written out.
    """
    p = properties.select("id", (F.col("kind") == "axiom").alias("is_axiom"))
    r = reads.select(F.col("src").alias("id"), F.col("dst").alias("var")).distinct().join(p, "id")
    if axioms is not None:
        wanted = axioms.select(F.col(axioms.columns[0]).alias("id")).distinct()
        side = r.filter("is_axiom").join(wanted, "id", "left_semi").select(F.col("id").alias("axiom"), "var")
        return _edges(r.filter("NOT is_axiom").join(side, "var"), "id", "DEPENDS_ON", "axiom")
    both = (
        r.groupBy("var").agg(F.max("is_axiom").alias("has"), F.min("is_axiom").alias("all")).filter("has AND NOT all")
    )
    shared = r.join(both.select("var"), "var", "left_semi")
    return _edges(shared.filter("NOT is_axiom"), "id", "SHARES", "var").unionByName(
        _edges(shared.filter("is_axiom"), "var", "AXIOM", "id")
    )


def wire_propagated(reqs: DataFrame, includes: DataFrame) -> DataFrame:
    """``PROPAGATED_FROM`` edges: requirement -> each file that directly includes its file."""
    users = includes.select(F.col("to_path").alias("path"), F.col("from_path").alias("user")).distinct()
    return _edges(reqs.select("id", "path").join(users, "path"), "id", "PROPAGATED_FROM", "user")


def wire_types(nodes: DataFrame, types: DataFrame) -> DataFrame:
    """``HAS_PARAM`` and ``RETURNS_TYPE`` edges from declarations to type nodes.

    The type of a parameter is what follows its last colon; its last dotted component is looked up first,
    then the full text; of several types with one name the first id counts.
    """
    by_name = types.groupBy(F.col("name").alias("t")).agg(F.min("id").alias("type_id"))
    of = lambda c: F.when(F.contains(c, F.lit(":")), F.trim(F.substring_index(c, ":", -1)))
    params = nodes.select("id", F.explode("params").alias("p"), F.lit("HAS_PARAM").alias("etype")).withColumn(
        "t", of(F.col("p"))
    )
    returns = nodes.filter("return_sort IS NOT NULL").select(
        "id", F.col("return_sort").alias("p"), F.lit("RETURNS_TYPE").alias("etype")
    ).withColumn("t", F.coalesce(of(F.col("p")), F.trim("p")))
    uses = params.unionByName(returns).filter("t IS NOT NULL AND t <> ''").select("id", "etype", "t").distinct()
    leaf = by_name.select(F.col("t").alias("leaf"), F.col("type_id").alias("leaf_id"))
    found = (
        uses.withColumn("leaf", last_component(F.col("t")))
        .join(leaf, "leaf", "left")
        .join(by_name, "t", "left")
        .withColumn("dst", F.coalesce("leaf_id", "type_id"))
        .filter("dst IS NOT NULL")
    )
    return _edges(found, "id", F.col("etype"), "dst")


# Edge type of each reference kind.
REFERENCE_EDGE = {"call": "CALLS", "instance": "USES", "monitor": "MONITORS"}


def _lookup_node(nodes: DataFrame, out: str) -> tuple[DataFrame, DataFrame]:
    exact = nodes.groupBy(F.col("qualified_name").alias(f"{out}_q")).agg(F.min("id").alias(f"{out}_exact"))
    leaf = nodes.groupBy(F.col("name").alias(f"{out}_l")).agg(F.min("id").alias(f"{out}_leaf"))
    return exact, leaf


def wire_refs(references: DataFrame, nodes: DataFrame) -> DataFrame:
    """``CALLS``, ``USES`` and ``MONITORS`` edges between nodes.

    Both ends are looked up by their last component, an equal qualified name first, else the first id;
    self edges and unresolved ends are dropped.
    """
    kind = F.create_map(*[F.lit(x) for kv in REFERENCE_EDGE.items() for x in kv])[F.col("kind")]
    source = F.regexp_replace("source_name", r"^.*\s", "")
    refs = references.select(kind.alias("etype"), source.alias("s_q"), F.col("target_name").alias("t_q")).distinct()
    for side in ("s", "t"):
        exact, leaf = _lookup_node(nodes, side)
        refs = (
            refs.withColumn(f"{side}_l", last_component(F.col(f"{side}_q")))
            .join(exact, f"{side}_q", "left")
            .join(leaf, f"{side}_l", "left")
            .withColumn(f"{side}_id", F.coalesce(f"{side}_exact", f"{side}_leaf"))
        )
    ok = refs.filter("etype IS NOT NULL AND s_id IS NOT NULL AND t_id IS NOT NULL AND s_id <> t_id")
    return _edges(ok, "s_id", F.col("etype"), "t_id")


def wire_contains(symbols: DataFrame) -> DataFrame:
    """``CONTAINS`` edges from a scope to the symbols declared in it, within a file."""
    s = symbols.withColumn("id", F.concat_ws(":", "path", (F.col("line") + 1).cast("string"), "name"))
    parents = s.filter(F.col("keyword").isin("object", "module")).groupBy(
        "path", F.col("qualified_name").alias("parent_qname")
    ).agg(F.min("id").alias("parent"))
    return _edges(
        s.filter("parent_qname IS NOT NULL").join(parents, ["path", "parent_qname"]).filter("parent <> id"),
        "parent", "CONTAINS", "id",
    )


def wire_includes_nodes(nodes: DataFrame, includes: DataFrame) -> DataFrame:
    """``INCLUDES`` edges between the first nodes of two files."""
    first = nodes.groupBy("path").agg(F.min_by("id", F.struct("line", "id")).alias("node"))
    src = first.select(F.col("path").alias("from_path"), F.col("node").alias("src_node"))
    dst = first.select(F.col("path").alias("to_path"), F.col("node").alias("dst_node"))
    pairs = includes.select("from_path", "to_path").distinct()
    return _edges(
        pairs.join(src, "from_path").join(dst, "to_path").filter("src_node <> dst_node"),
        "src_node", "INCLUDES", "dst_node",
    )
