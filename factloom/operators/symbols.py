"""Declarations, includes, references, exports and properties read from source text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.plans.keyed import pick_last

# Declaration keywords and the symbol class each one gives.
SYMBOL_CLASS = {
    "type": "class",
    "action": "function",
    "relation": "function",
    "function": "function",
    "individual": "variable",
    "object": "module",
    "module": "module",
    "isolate": "namespace",
}
# Keywords of the nested scan and their symbol class.
NESTED_CLASS = {
    "type": "class",
    "object": "module",
    "action": "method",
    "relation": "function",
    "module": "module",
    "isolate": "namespace",
    "property": "property",
    "axiom": "property",
    "conjecture": "property",
    "alias": "variable",
    "before": "method",
    "after": "method",
    "instantiate": "variable",
    "function": "function",
    "individual": "variable",
    "definition": "function",
    "var": "variable",
    "invariant": "property",
    "parameter": "variable",
    "implement": "method",
    "derived": "function",
    "interpret": "type_parameter",
    "schema": "interface",
    "theorem": "property",
    "export": "event",
    "import": "event",
    "destructor": "field",
    "constructor": "enum_member",
    "around": "method",
    "attribute": "constant",
    "include": "file",
}
# Keywords that open a naming scope.
SCOPE_WORDS = ["object", "module"]
PROPERTY_WORDS = "invariant|property|axiom|conjecture"


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.create_map(*pairs)[key]


def _numbered_hits(files: DataFrame, pattern: str) -> DataFrame:
    """One row per match over the numbered text: path, ordinal, line, hit without its first mark."""
    found = T.exploded(files, ["path"], T.hits(T.numbered(F.col("content")), pattern), "hit", "ordinal")
    return found.withColumn("line", T.first_line(F.col("hit")))


_DECL = (
    rf"{T.BOL}(?:"
    rf"type[ \t]+[\w.]+(?:{T.WS}={T.WS}\{{[^}}]+\}})?"
    rf"|action[ \t]+[\w.]+{T.WS}(?:\([^)]*\))?(?:{T.WS}returns{T.WS}\([^)]*\))?"
    rf"|relation[ \t]+[\w.]+{T.WS}(?:\([^)]*\))?"
    rf"|function[ \t]+[\w.]+{T.WS}(?:\([^)]*\))?(?:{T.WS}:{T.WS}\w+)?"
    rf"|individual[ \t]+[\w.]+{T.WS}:{T.WS}\w+"
    rf"|(?:object|module|isolate)[ \t]+[\w.]+)"
)


def extract_symbols(files: DataFrame) -> DataFrame:
    """Declarations with keyword, name, symbol class, detail text, parameters and line.

    One regex pass over the numbered text finds all kinds; the matches are short, so taking them apart
    costs little. The row's line is the line of the keyword.
    """
    rows = _numbered_hits(files, _DECL)
    h = T.unnumbered(F.col("hit"))
    rows = rows.withColumn("h", F.trim(h)).withColumn("keyword", F.regexp_extract("h", r"^(\w+)", 1))
    k = F.col("keyword")
    params_raw = F.regexp_extract("h", r"^\w+\s+[\w.]+\s*\(([^)]*)\)", 1)
    params = T.trimmed_list(params_raw)
    returns = F.trim(F.regexp_extract("h", r"returns\s*\(([^)]*)\)", 1))
    variants = F.when(k == "type", T.trimmed_list(F.regexp_extract("h", r"=\s*\{([^}]+)\}", 1))).otherwise(
        F.array().cast("array<string>")
    )
    sort = F.when(
        k.isin("function", "individual"), T.or_null(F.regexp_extract("h", r":\s*(\w+)$", 1))
    )
    shown = F.concat_ws(
        " ",
        F.when(F.size(params) > 0, F.concat(F.lit("("), F.array_join(params, ", "), F.lit(")"))),
        F.when(returns != "", F.concat(F.lit("returns ("), returns, F.lit(")"))),
    )
    detail = (
        F.when((k == "type") & (F.size(variants) > 0), F.concat(F.lit("enum: "), F.array_join(variants, ", ")))
        .when(k == "action", F.when(shown != "", shown).otherwise("action"))
        .when(
            k == "relation",
            F.when(params_raw != "", F.concat(F.lit("("), F.trim(params_raw), F.lit(")"))).otherwise("relation"),
        )
        .when(sort.isNotNull(), F.concat(F.lit(": "), sort))
        .otherwise(k)
    )
    return rows.select(
        "path",
        F.regexp_extract("h", r"^\w+\s+([\w.]+)", 1).alias("name"),
        "keyword",
        _lookup(SYMBOL_CLASS, k).alias("kind"),
        detail.alias("detail"),
        "line",
        F.when(k == "type", F.array().cast("array<string>")).otherwise(params).alias("params"),
        F.coalesce(T.or_null(returns), sort).alias("return_sort"),
        (F.size(variants) > 0).alias("is_enum"),
        variants.alias("variants"),
        F.lit("tier3").alias("tier"),
    )


_WORDS = "|".join(NESTED_CLASS)
_NESTED = (
    rf'<<<(?:[^">]++|"(?:[^"\\]++|\\[\s\S])*+"|>(?!>>))*+(?:>>>|\z)|#[^\n]*+|{T.LINE}(?=[^\n]*(?:{_WORDS})\b)|[{{}}]'
    rf"|(?<![\w.])(?:{_WORDS})\s{T.WS}(?:\[{T.WS}\w+{T.WS}\]|[\w.]+)"
)


def extract_nested_symbols(files: DataFrame) -> DataFrame:
    """Declarations with their enclosing object or module and a dotted qualified name.

    Every declaration looks up, for each nesting level above it, the scope opened last on that level; the
    chain is at most as long as the nesting is deep. Includes always stand at top level.
    """
    toks = T.exploded(files, ["path"], T.hits(T.numbered(F.col("content")), _NESTED), "tok", "pos")
    t = F.col("tok")
    word = F.regexp_extract(t, rf"^({_WORDS})\s", 1)
    name = F.regexp_replace(T.unnumbered(t), r"^\w+\s+\[?\s*|\s*\]$", "")
    toks = (
        toks.withColumn("mark", T.last_line(t))
        .withColumn("keyword", T.or_null(word))
        .withColumn("delta", F.when(t == "{", 1).when(t == "}", -1).otherwise(0))
    )
    by_pos = Window.partitionBy("path").orderBy("pos")
    past = by_pos.rowsBetween(Window.unboundedPreceding, -1)
    upto = by_pos.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    toks = (
        toks.withColumn("line", F.last("mark", True).over(past))
        .withColumn("depth", F.sum("delta").over(upto))
        .filter("keyword IS NOT NULL OR delta <> 0")
    )
    opens_scope = F.col("keyword").isin(SCOPE_WORDS)
    # a scope is open from its keyword to the next brace that closes its level or the level around it, so
    # every closing brace counts on two levels; what it ends is what was opened there since the last one
    closes = F.col("delta") == -1
    base = F.when(F.col("delta") == 1, F.col("depth") - 1).otherwise(F.col("depth"))
    toks = toks.withColumn("level", F.explode_outer(F.when(closes, F.array(base, base + 1)).otherwise(F.array(base))))
    by_level = Window.partitionBy("path", "level").orderBy("pos")
    opened = F.sum(F.coalesce(opens_scope.cast("int"), F.lit(0))).over(
        by_level.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    toks = toks.withColumn("opened", opened)
    before = F.last(F.when(closes, F.col("opened")), True).over(by_level.rowsBetween(Window.unboundedPreceding, -1))
    ended = F.when(closes, F.col("opened") - F.coalesce(before, F.lit(0))).otherwise(0)
    step = F.coalesce(opens_scope.cast("int"), F.lit(0)) - F.col("ended")
    in_order = Window.partitionBy("path").orderBy("pos", "level").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    toks = toks.withColumn("ended", ended).withColumn("nesting", F.sum(step).over(in_order))
    own = toks.filter("keyword IS NOT NULL").select(
        "path", "pos", "line", "keyword", name.alias("name"),
        (F.col("nesting") - opens_scope.cast("int")).alias("nesting"),
        opens_scope.alias("opens"),
    )
    level_names = own.withColumn(
        "slot",
        F.explode(
            F.when(F.col("opens"), F.sequence(F.lit(0).cast("long"), F.col("nesting"))).otherwise(
                F.sequence(F.lit(0).cast("long"), F.greatest(F.col("nesting") - 1, F.lit(0)))
            )
        ),
    )
    is_opener_row = F.col("opens") & (F.col("slot") == F.col("nesting"))
    ranked = (
        Window.partitionBy("path", "slot").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    )
    chain = level_names.withColumn(
        "scope_name", F.last(F.when(is_opener_row, F.col("name")), True).over(ranked)
    ).withColumn("scope_name", F.when(F.col("slot") < F.col("nesting"), F.col("scope_name")))
    rows = chain.groupBy("path", "pos", "line", "keyword", "name").agg(
        F.array_sort(
            F.collect_list(F.when(F.col("scope_name").isNotNull(), F.struct("slot", "scope_name")))
        ).alias("chain")
    )
    parent = F.when(
        (F.size("chain") > 0) & (F.col("keyword") != "include"),
        F.array_join(F.transform("chain", lambda s: s["scope_name"]), "."),
    )
    return rows.select(
        "path",
        "name",
        "keyword",
        _lookup(NESTED_CLASS, F.col("keyword")).alias("kind"),
        parent.alias("parent_qname"),
        F.concat_ws(".", parent, "name").alias("qualified_name"),
        F.when(parent.isNull(), 0).otherwise(F.size("chain")).alias("depth"),
        "line",
        "pos",
    )


# Which declarations become graph nodes, and their node type.
NODE_TYPE = {
    "type": "type",
    "action": "action",
    "relation": "relation",
    "function": "function",
    "individual": "individual",
    "object": "object",
    "module": "module",
    "isolate": "isolate",
}


def symbols_to_nodes(symbols: DataFrame) -> DataFrame:
    """Graph nodes ``path:line:name`` (1-based line) of the declared symbols; other kinds are skipped."""
    node_type = _lookup(NODE_TYPE, F.col("keyword"))
    qualified = F.col("qualified_name") if "qualified_name" in symbols.columns else F.col("name")
    return (
        symbols.withColumn("node_type", node_type)
        .filter("node_type IS NOT NULL")
        .select(
            F.concat_ws(":", "path", (F.col("line") + 1).cast("string"), "name").alias("id"),
            "node_type",
            "name",
            qualified.alias("qualified_name"),
            "path",
            (F.col("line") + 1).alias("line"),
            "params",
            "return_sort",
            "is_enum",
            "variants",
            "tier",
        )
    )


def extract_includes(files: DataFrame, indented: bool = False) -> DataFrame:
    """``include NAME`` lines; at column 0 for the graph, with indent for counts."""
    lead = r"[ \t]*+" if indented else ""
    rows = _numbered_hits(files, rf"{T.LINE}{lead}include[ \t]+\w+")
    return rows.select(
        F.col("path").alias("from_path"),
        F.regexp_extract("hit", r"(\w+)$", 1).alias("include_name"),
        "line",
        "ordinal",
    )


def extract_references(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Call, instance and monitor references.

    A call belongs to the action, relation or function declared last at or above its line; calls
    without one are dropped. This as-of match is one ordered scan over declarations and calls per file.
    """
    starred = rf"{T.BOL}(?:instance[ \t]+[\w.]+{T.WS}:{T.WS}[\w.]+|(?:before|after|around)[ \t]+[\w.]+)"
    other = _numbered_hits(files, starred).withColumn("h", F.trim(T.unnumbered(F.col("hit"))))
    is_instance = F.startswith("h", F.lit("instance"))
    target = F.regexp_extract("h", r"([\w.]+)$", 1)
    other = other.select(
        "path",
        F.when(is_instance, F.regexp_extract("h", r"^instance\s+([\w.]+)", 1))
        .otherwise(F.concat_ws(" ", F.regexp_extract("h", r"^(\w+)", 1), target))
        .alias("source_name"),
        target.alias("target_name"),
        F.when(is_instance, "instance").otherwise("monitor").alias("kind"),
        "line",
    )
    lines = rf"{T.LINE}[^\n]*?\bcall[ \t]+[\w.]+[ \t]*(?:\(|;|(?=\n)|\z)[^\n]*"
    calls = _numbered_hits(files, lines).select(
        "path",
        "line",
        F.explode(
            F.regexp_extract_all(F.col("hit"), F.lit(r"call[ \t]+([\w.]+)[ \t]*(?:\(|;|$)"), F.lit(1))
        ).alias("target_name"),
    )
    declared = symbols.filter(F.col("kind").isin("function", "method")).select(
        "path", "line", F.lit(None).cast("string").alias("target_name"), F.col("name").alias("source_name")
    )
    # two declarations on one line: one of them counts
    declared = declared.groupBy("path", "line").agg(F.min("source_name").alias("source_name"))
    both = calls.withColumn("source_name", F.lit(None).cast("string")).unionByName(
        declared.withColumn("target_name", F.lit(None).cast("string"))
    )
    at_or_above = (
        Window.partitionBy("path")
        .orderBy("line", F.col("target_name").isNotNull())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    calls = (
        both.withColumn("source_name", F.last("source_name", True).over(at_or_above))
        .filter("target_name IS NOT NULL AND source_name IS NOT NULL")
        .select("path", "source_name", "target_name", F.lit("call").alias("kind"), "line")
    )
    return calls.unionByName(other)


def extract_exports(files: DataFrame) -> DataFrame:
    """``export X`` / ``import X`` declarations, also in the ``action export`` form."""
    rows = _numbered_hits(files, rf"{T.BOL}(?:action[ \t]+)?(?:export|import)[ \t]+[\w.]+")
    h = T.unnumbered(F.col("hit"))
    return rows.select(
        "path",
        F.regexp_extract(h, r"([\w.]+)$", 1).alias("name"),
        F.regexp_extract(h, r"\b(export|import)[ \t]+[\w.]+$", 1).alias("direction"),
        "line",
    )


def extract_properties(files: DataFrame) -> DataFrame:
    """Invariant, property, axiom and conjecture declarations with their label and formula."""
    rows = _numbered_hits(files, rf"{T.BOL}(?:{PROPERTY_WORDS})[ \t]+[^\n#]+")
    h = F.trim(T.unnumbered(F.col("hit")))
    label = F.regexp_extract(h, rf"^(?:{PROPERTY_WORDS})\s+\[\s*(\w+)\s*\]", 1)
    return rows.select(
        F.concat_ws(":", "path", F.col("line").cast("string")).alias("id"),
        F.regexp_extract(h, rf"^({PROPERTY_WORDS})", 1).alias("kind"),
        label.alias("name"),
        F.trim(F.regexp_replace(h, rf"^(?:{PROPERTY_WORDS})\s+(?:\[\s*\w+\s*\])?", "")).alias("formula_text"),
        "path",
        "line",
    )


def extract_annotations(files: DataFrame) -> DataFrame:
    """Tag rows per line; lines whose tags are all bare integers are no annotations."""
    rows = _numbered_hits(files, rf"{T.LINE}[^\n]*\][ \t\r]*+(?=\n|\z)")
    tags = T.parse_tags(T.unnumbered(F.col("hit")))
    return (
        rows.withColumn("tags", tags)
        .filter((F.size("tags") > 0) & T.is_annotation(F.col("tags")))
        .select(
            F.concat_ws(":", "path", F.col("line").cast("string"), F.lit("0")).alias("id"),
            "path",
            "line",
            "tags",
        )
    )


def document_outline(symbols: DataFrame) -> DataFrame:
    """Symbols of each file in line order with their depth; rows without a position are left out."""
    return symbols.filter("line IS NOT NULL AND name <> ''").select(
        "path", "line", "depth", "name", "kind", "qualified_name", "pos"
    ).orderBy("path", "line", "pos")


def latest_nodes(nodes: DataFrame) -> DataFrame:
    """A node id seen again replaces the earlier row (``batch`` says which is later)."""
    return pick_last(nodes, ["id"], ["batch"])
