"""Looking up symbols, definitions, references and callers, for batches of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.plans.keyed import fill_forward


def lookup_symbol(symbols: DataFrame, queries: DataFrame) -> DataFrame:
    """``queries(name)``: dotted names by qualified name; plain names at top level, else at any depth."""
    q = queries.select("name").distinct().withColumnRenamed("name", "query")
    exact = symbols.withColumn("query", F.col("qualified_name")).join(q, "query", "left_semi")
    hit = exact.select("query").distinct()
    open_names = q.filter(~F.contains("query", F.lit("."))).join(hit, "query", "left_anti")
    nested = symbols.withColumn("query", T.last_component(F.col("qualified_name"))).join(
        open_names, "query", "left_semi"
    )
    return exact.withColumn("match", F.lit("exact")).unionByName(nested.withColumn("match", F.lit("leaf")))


def scope_score(
    candidates: DataFrame, visible: DataFrame, file_layers: DataFrame, visible_layers: DataFrame | None = None
) -> DataFrame:
    """``candidates(query, from_path, path, …)`` with a ``score``; external ones go when a visible one exists.

    Score: same file 0, in scope and same directory 1, in scope 2, same directory 3, same layer 4, else 5.
    ``visible(from_path, path)`` is the scope of each asking file; ``visible_layers(layer, visible)`` the
    layers each layer sees.
    """
    in_scope = visible.select("from_path", "path").distinct().withColumn("_in", F.lit(True))
    layer = file_layers.groupBy("path").agg(F.min("layer").alias("_layer"))
    mine = layer.select(F.col("path").alias("from_path"), F.col("_layer").alias("_mine"))
    c = (
        candidates.join(in_scope, ["from_path", "path"], "left")
        .join(layer, "path", "left")
        .join(mine, "from_path", "left")
        .withColumn("_in", F.coalesce("_in", F.lit(False)))
    )
    same_dir = T.dir_of(F.col("path")) == T.dir_of(F.col("from_path"))
    score = (
        F.when(F.col("path") == F.col("from_path"), 0)
        .when(F.col("_in") & same_dir, 1)
        .when(F.col("_in"), 2)
        .when(same_dir, 3)
        .when(F.col("_layer") == F.col("_mine"), 4)
        .otherwise(5)
    )
    c = c.withColumn("score", score)
    if visible_layers is not None:
        sees = visible_layers.select(
            F.col("layer").alias("_mine"), F.col("visible").alias("_layer")
        ).distinct().withColumn("_sees", F.lit(True))
        c = c.join(sees, ["_mine", "_layer"], "left").withColumn(
            "_seen", F.col("_layer").isNull() | F.col("_mine").isNull() | F.coalesce("_sees", F.lit(False))
        )
        any_seen = c.groupBy("query", "from_path").agg(F.max("_seen").alias("_any"))
        c = c.join(any_seen, ["query", "from_path"]).filter("_seen OR NOT _any")
    return c.select(*candidates.columns, "score")


rank_by_scope = scope_score


def goto_definition(
    symbols: DataFrame,
    queries: DataFrame,
    visible: DataFrame,
    file_layers: DataFrame,
    visible_layers: DataFrame | None = None,
) -> DataFrame:
    """``queries(name, from_path)``: the best definition of each name as seen from each file, by the scores of ``scope_score``.

    Asking files never meet all declarations of a name: the first place per (name, file), (name, directory) and (name, layer) is
    worked out first, and each file asks for its own file, its scope, its directory and the layers. A better place that hides behind
    the first one of a directory or layer has a better score elsewhere, so nothing is lost.
    """
    place = F.struct("path", "line", "qualified_name", "kind")
    layer = file_layers.groupBy("path").agg(F.min("layer").alias("_layer"))
    found = lookup_symbol(symbols, queries).select("query", "path", "line", "qualified_name", "kind").join(layer, "path", "left")
    per_file = found.groupBy("query", "path", "_layer").agg(F.min(place).alias("p"))
    per_dir = per_file.groupBy("query", T.dir_of(F.col("path")).alias("_dir"), "_layer").agg(F.min("p").alias("p"))
    per_layer = per_dir.groupBy("query", "_layer").agg(F.min("p").alias("p"))
    mine = layer.select(F.col("path").alias("from_path"), F.col("_layer").alias("_mine"))
    asked = queries.select(F.col("name").alias("query"), "from_path").distinct().join(mine, "from_path", "left")
    asked = asked.withColumn("_dir", T.dir_of(F.col("from_path")))
    row = ["query", "from_path", "_mine", "_layer", "p"]
    own = asked.withColumn("path", F.col("from_path")).join(per_file, ["query", "path"]).select(*row, F.lit(0).alias("score"))
    seen = asked.join(visible.select("from_path", "path").distinct(), "from_path").join(per_file, ["query", "path"])
    near = F.when(T.dir_of(F.col("path")) == F.col("_dir"), 1).otherwise(2)
    beside = asked.join(per_dir, ["query", "_dir"]).select(*row, F.lit(3).alias("score"))
    anywhere = asked.join(per_layer, "query").select(*row, F.when(F.col("_layer") == F.col("_mine"), 4).otherwise(5).alias("score"))
    c = own.unionByName(seen.select(*row, near.alias("score"))).unionByName(beside).unionByName(anywhere)
    order = F.struct("score", "p.path", "p.line", "p.qualified_name", "p.kind")
    if visible_layers is None:
        best = c.groupBy("query", "from_path").agg(F.min(order).alias("b"))
    else:  # a place in a layer that the asking file doesn't see counts only if there is no other
        sees = visible_layers.select(F.col("layer").alias("_mine"), F.col("visible").alias("_layer")).distinct().withColumn("_sees", F.lit(True))
        c = c.join(sees, ["_mine", "_layer"], "left")
        visible_place = F.col("_layer").isNull() | F.col("_mine").isNull() | F.coalesce("_sees", F.lit(False))
        best = c.groupBy("query", "from_path").agg(F.coalesce(F.min(F.when(visible_place, order)), F.min(order)).alias("b"))
    return best.select("query", "from_path", "b.score", "b.path", "b.line", "b.qualified_name", "b.kind")


def find_implementations(symbols: DataFrame, queries: DataFrame) -> DataFrame:
    """An action name finds its monitors; a monitor finds the declaration of its action.

    ``queries(name, is_monitor)``; symbols are nested-scan rows (monitors carry their word as keyword).
    """
    monitors = ["before", "after", "around", "implement"]
    s = symbols.filter(F.col("keyword").isin(["action", *monitors])).select(
        T.last_component(F.col("name")).alias("leaf"),
        F.col("keyword").isin(monitors).alias("found_monitor"),
        "path", "line", "keyword", "qualified_name",
    )
    q = queries.select("name", "is_monitor", T.last_component(F.col("name")).alias("leaf")).distinct()
    return q.join(s, "leaf").filter("found_monitor <> is_monitor").select(
        "name", "is_monitor", "path", "line", "keyword", "qualified_name"
    )


def word_index(files: DataFrame) -> DataFrame:
    """Inverted index of words: ``(word, path, line, col)``, both counted from 0."""
    keep = [c for c in files.columns if c != "content"]
    lines = T.exploded(files, keep, F.split("content", "\n", -1), "text", "line")
    words = F.regexp_extract_all("text", F.lit(r"\w+"), F.lit(0))
    # the separators before each word give its distance to the word before, hence its column
    gaps = F.transform(F.split("text", r"\w+", -1), lambda g: F.length(g))
    rows = lines.withColumns({"words": words, "gaps": gaps}).filter(F.size("words") > 0)
    before = F.slice("gaps", F.lit(1), F.size("words"))
    steps = F.zip_with(before, F.transform("words", lambda w: F.length(w)), lambda g, n: g + n)
    columns = F.zip_with(T.running_offsets(steps), before, lambda at, g: at + g)
    placed = F.zip_with("words", columns, lambda w, at: F.struct(w.alias("word"), at.alias("col")))
    return T.exploded(rows, [*keep, "line"], placed, "w").select(
        F.col("w.word").alias("word"), *keep, "line", F.col("w.col").alias("col")
    )


def find_references(index: DataFrame, queries: DataFrame, declarations: DataFrame | None = None) -> DataFrame:
    """Every whole-word occurrence of each queried name; with ``declarations(name, path, line)`` the
    declaring lines are left out."""
    q = queries.select(F.col(queries.columns[0]).alias("word")).distinct()
    hit = index.join(q, "word", "left_semi")
    if declarations is None:
        return hit
    d = declarations.select(F.col("name").alias("word"), "path", "line").distinct()
    return hit.join(d, ["word", "path", "line"], "left_anti")


def reference_kinds(references: DataFrame, declarations: DataFrame) -> DataFrame:
    """Occurrences marked ``write`` on a line that declares the word, else ``read``."""
    d = declarations.select(F.col("name").alias("word"), "path", "line").distinct().withColumn("_d", F.lit(True))
    return references.join(d, ["word", "path", "line"], "left").withColumn(
        "access", F.when(F.col("_d"), "write").otherwise("read")
    ).drop("_d")


def rename_plan(index: DataFrame, renames: DataFrame) -> DataFrame:
    """``renames(old, new)``: one edit per occurrence, numbered within its file from the end, so that
    applying them in order never moves a later one."""
    r = renames.select(F.col("old").alias("word"), "new").distinct()
    edits = index.join(r, "word").select(
        "path", "line", "col", (F.col("col") + F.length("word")).alias("end_col"), F.col("word").alias("old"), "new"
    )
    # a path holds no more edits than its one text row has words
    order = Window.partitionBy("path").orderBy(F.col("line").desc(), F.col("col").desc())
    return edits.withColumn("edit_no", F.row_number().over(order))


def call_hierarchy_in(edges: DataFrame, nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """Callers: nodes with a ``CALLS`` or ``MONITORS`` edge into each queried node id."""
    q = queries.select(F.col(queries.columns[0]).alias("dst")).distinct()
    e = edges.filter(F.col("etype").isin("CALLS", "MONITORS")).join(q, "dst", "left_semi")
    return e.join(nodes.withColumnRenamed("id", "src"), "src").select(
        F.col("dst").alias("query"), F.col("src").alias("id"), "etype", "name", "path", "line"
    )


def call_hierarchy_out(edges: DataFrame, nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """Callees: nodes that each queried node id has a ``CALLS`` edge to."""
    q = queries.select(F.col(queries.columns[0]).alias("src")).distinct()
    e = edges.filter("etype = 'CALLS'").join(q, "src", "left_semi")
    return e.join(nodes.withColumnRenamed("id", "dst"), "dst").select(
        F.col("src").alias("query"), F.col("dst").alias("id"), "etype", "name", "path", "line"
    )


def callers_by_occurrence(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """Fallback for names without edges: occurrences grouped by the symbol that starts last at or above."""
    s = symbols.select(
        "path", "line", F.lit(-1).alias("col"), F.lit(None).cast("string").alias("word"),
        F.struct("name", F.col("line").alias("start")).alias("_sym"),
    )
    s = s.groupBy("path", "line", "col", "word").agg(F.max("_sym").alias("_sym"))
    r = references.select("path", "line", "col", "word").withColumn(
        "_sym", F.lit(None).cast("struct<name:string,start:int>")
    )
    both = s.unionByName(r)
    filled = fill_forward(both, ["path"], ["line", "col"], {"container": F.col("_sym")})
    return (
        filled.filter("word IS NOT NULL")
        .groupBy("word", "path", F.col("container.name").alias("container"))
        .agg(F.count("*").alias("calls"), F.min("line").alias("first_line"))
    )


def shadow_declarations(symbols: DataFrame) -> DataFrame:
    """Declarations whose name and kind another file of the corpus declares too: one row each, with the
    number of other files and the first of them."""
    keys = ["corpus", "name", "kind"]
    places = symbols.select(*keys, "path", "line").groupBy(*keys, "path").agg(F.min("line").alias("line"))
    per_name = places.groupBy(*keys).agg(
        F.count("*").alias("files"), F.min(F.struct("path", "line")).alias("first")
    ).filter("files > 1")
    # the first file itself points at the second one
    second = (
        places.join(per_name.select(*keys, F.col("first.path").alias("first_path")), keys)
        .filter("path <> first_path")
        .groupBy(*keys)
        .agg(F.min(F.struct("path", "line")).alias("second"))
    )
    other = per_name.join(second, keys)
    return symbols.select(*keys, "path", "line").join(other, keys).select(
        *keys, "path", "line", (F.col("files") - 1).alias("other_files"),
        F.when(F.col("path") == F.col("first.path"), F.col("second.path")).otherwise(F.col("first.path")).alias("other_path"),
        F.when(F.col("path") == F.col("first.path"), F.col("second.line")).otherwise(F.col("first.line")).alias("other_line"),
    )


def symbol_rank(q: str) -> Column:
    """0 leaf equals, 1 leaf starts with, 2 name starts with, 3 contains."""
    leaf, name = F.lower(T.last_component(F.col("qualified_name"))), F.lower("qualified_name")
    return (
        F.when(leaf == q, 0).when(F.startswith(leaf, F.lit(q)), 1).when(F.startswith(name, F.lit(q)), 2).otherwise(3)
    )


def search_symbols(symbols: DataFrame, q: str, cap: int | None = None) -> DataFrame:
    """Symbols that contain the text, ignoring case, best match first, or all of them for an empty text; the first ``cap``, if given."""
    synthetic = F.col("synthetic") if "synthetic" in symbols.columns else F.lit(False)
    if not q:
        out = symbols.orderBy(synthetic, "qualified_name", "path", "line")
        return out if cap is None else out.limit(cap)
    low = q.lower()
    out = symbols.filter(F.contains(F.lower("qualified_name"), F.lit(low))).withColumn("rank", symbol_rank(low))
    out = out.orderBy("rank", "qualified_name", "path", "line")
    return out if cap is None else out.limit(cap)


def search_scoped(
    symbols: DataFrame, q: str, path: str, visible: DataFrame, file_layers: DataFrame, cap: int | None = None
) -> DataFrame:
    """All hits of ``search_symbols``, ordered by definition match, scope of ``path``, its layer, then name; the first ``cap``, if given."""
    low = q.lower()
    hits = symbols.filter(F.contains(F.lower("qualified_name"), F.lit(low))).withColumn("rank", symbol_rank(low))
    boost = F.when(F.lower(T.last_component(F.col("qualified_name"))) == low, 0).otherwise(1)
    scope = visible.filter(F.col("from_path") == path).select("path").distinct().withColumn("_in", F.lit(True))
    layer = file_layers.groupBy("path").agg(F.min("layer").alias("_layer"))
    own = layer.filter(F.col("path") == path).select(F.col("_layer").alias("_own"))
    near = layer.join(own, layer["_layer"] == own["_own"], "left_semi").select("path").withColumn("_near", F.lit(True))
    out = (
        hits.join(scope, "path", "left")
        .join(near, "path", "left")
        .withColumn("boost", boost)
        .withColumn("scope_rank", F.when(F.col("_in"), 0).otherwise(1))
        .withColumn("layer_rank", F.when(F.col("_in") | F.col("_near"), 0).otherwise(1))
        .drop("_in", "_near")
        .orderBy("boost", "scope_rank", "layer_rank", "qualified_name", "path", "line")
    )
    return out if cap is None else out.limit(cap)
