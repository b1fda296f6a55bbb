"""Lint rules: each gives rows ``(code, severity, path, line, subject, detail)``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators.blocks import explode_lines, extract_blocks, extract_writes
from factloom.operators.filters import filter_severity, filter_visible
from factloom.operators.resolve import near_miss, unresolved_includes
from factloom.operators.symbols import _numbered_hits
from factloom.operators.tags import annotation_tags, orphan_tags
from factloom.plans.closure import reach, reach_least
from factloom.plans.keyed import fill_forward
from factloom.plans.lineage import cut_lineage

# Words that soften a commented-out requirement, and thresholds of the rules.
SUPPRESS_WORDS = "todo|fixme|disabled|skip|intentional"
STATEMENTS = ["require", "ensure", "assume", "assert"]
HIGH_IMPACT_READERS = 5
TAG_GAP_MIN_TAGS = 5
TAG_GAP_MAX_RATIO = 0.3


def _diag(
    df: DataFrame, code: str, severity: str | Column, subject: Column | None = None, detail: Column | None = None,
    line: Column | None = None,
) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(
        F.lit(code).alias("code"),
        (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
        "path",
        (F.col("line") if line is None else line).cast("int").alias("line"),
        (none if subject is None else subject.cast("string")).alias("subject"),
        (none if detail is None else detail.cast("string")).alias("detail"),
    )


def lint_missing_header(files: DataFrame) -> DataFrame:
    bad = files.filter(~F.startswith(F.regexp_replace("content", r"^\s+", ""), F.lit("#lang")))
    return _diag(bad, "missing_header", "warning", line=F.lit(0))


def lint_unmatched_brace(files: DataFrame) -> DataFrame:
    """Closers without opener, each at its place, and the number of openers left at the end.

    The depth restarts at zero after every stray closer, so strays are the places where the running sum
    makes a new minimum below zero, and the rest is the final sum above that minimum.
    """
    lines = explode_lines(files.select("path", "content"))
    code = F.when(F.startswith(F.trim("text"), F.lit("#lang")), F.col("text")).otherwise(
        F.substring_index("text", "#", 1)
    )
    # the text before each brace gives its column: split on braces, keep lengths
    braces = F.regexp_extract_all("code", F.lit(r"[{}]"), F.lit(0))
    gaps = F.transform(F.split("code", r"[{}]", -1), lambda g: F.length(g) + 1)
    columns = F.slice(
        F.zip_with(T.running_offsets(gaps), gaps, lambda at, g: at + g - 1), F.lit(1), F.size(braces)
    )
    placed = F.zip_with(braces, columns, lambda c, col: F.struct(c.alias("c"), col.alias("col")))
    coded = lines.withColumn("code", code).filter(F.col("code").rlike(r"[{}]"))
    rows = T.exploded(coded, ["path", F.col("line_no").alias("line")], placed, "b").select(
        "path", "line", F.col("b.col").alias("col"), F.when(F.col("b.c") == "{", 1).otherwise(-1).alias("d")
    )
    order = Window.partitionBy("path").orderBy("line", "col")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("s", F.sum("d").over(upto))
    rows = rows.withColumn(
        "low", F.coalesce(F.min("s").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    rows = rows.withColumn("low", F.least("low", F.lit(0)))
    strays = rows.filter(F.col("s") < F.col("low"))
    last_line = files.select("path", (F.size(F.split("content", "\n", -1)) - 1).alias("line"))
    left = (
        rows.groupBy("path")
        .agg(F.sum("d").alias("total"), F.least(F.min("s"), F.lit(0)).alias("low"))
        .withColumn("open", F.col("total") - F.col("low"))
        .filter("open > 0")
        .join(last_line, "path")
    )
    return _diag(strays, "unmatched_brace", "error", F.lit("}"), F.col("col")).unionByName(
        _diag(left, "unmatched_brace", "error", F.lit("{"), F.col("open"))
    )


def _top_declarations(files: DataFrame, words: str) -> DataFrame:
    rows = _numbered_hits(files, rf"{T.LINE}(?:{words})[ \t]+\w+")
    h = T.unnumbered(F.col("hit"))
    return rows.select(
        "path", "line", F.regexp_extract(h, r"^(\w+)", 1).alias("keyword"), F.regexp_extract(h, r"(\w+)$", 1).alias("name")
    )


def lint_missing_init(files: DataFrame) -> DataFrame:
    """Relations and functions that no ``after init`` block of the file assigns; the last one of a name."""
    declared = _top_declarations(files, "relation|function").groupBy("path", "name").agg(F.max("line").alias("line"))
    init = extract_writes(files).filter("mixin_kind = 'after' AND monitor_action = 'init'").select(
        "path", F.col("var_name").alias("name")
    ).distinct()
    return _diag(declared.join(init, ["path", "name"], "left_anti"), "missing_init", "warning", F.col("name"))


def lint_empty_init(files: DataFrame) -> DataFrame:
    pattern = rf"{T.LINE}[^\n]*?\bafter{T.WS1}init{T.WS}\{{{T.WS}\}}"
    rows = _numbered_hits(files, pattern)
    return _diag(rows, "empty_init", "warning")


def lint_duplicate_decl(files: DataFrame) -> DataFrame:
    """Every repeat of a top-level name in a file, with the line of the first."""
    rows = _top_declarations(files, "relation|function|type|individual")
    first = rows.groupBy("path", "name").agg(F.min("line").alias("first"), F.count("*").alias("n")).filter("n > 1")
    again = rows.join(first, ["path", "name"]).filter("line > first")
    return _diag(again, "duplicate_decl", "error", F.col("name"), F.col("first") + 1)


_ACTION_HEADER = rf"{T.BOL}action{T.WS1}\w+[^=]*={T.WS}\{{"


def lint_unguarded_action(files: DataFrame) -> DataFrame:
    """Action bodies that assign but never require; a body that is not closed goes to the end of the file.

    Only headers, braces, ``:=`` and ``require`` leave the text, as tokens; running counts of the two words are compared between a header and
    the brace that brings the depth back below it, which is its neighbour among the tokens of that level.
    """
    asked = files.filter(F.contains("content", F.lit("action")) & F.contains("content", F.lit(":=")))
    pattern = "|".join((_ACTION_HEADER, r"[{}]", ":=", r"require[ (]"))
    toks = T.exploded(asked, ["path"], T.hits(T.numbered(F.col("content")), pattern), "tok", "pos")
    t = F.col("tok")
    toks = toks.withColumn("kind", F.when(F.length(t) > 8, "header").when(t == "{", "open").when(t == "}", "close").when(t == ":=", "assign").otherwise("require"))
    delta = F.when(F.col("kind").isin("header", "open"), 1).when(F.col("kind") == "close", -1).otherwise(0)
    upto = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    toks = toks.select(
        "path", "pos", "kind", F.when(F.col("kind") == "header", t).alias("tok"), F.sum(delta).over(upto).alias("depth"),
        F.struct(F.count_if(F.col("kind") == "assign").over(upto).alias("assigns"), F.count_if(F.col("kind") == "require").over(upto).alias("requires")).alias("so_far"),
        F.struct(
            F.count_if(F.col("kind") == "assign").over(Window.partitionBy("path")).alias("assigns"),
            F.count_if(F.col("kind") == "require").over(Window.partitionBy("path")).alias("requires"),
        ).alias("total"),
    )
    braces = toks.filter("kind IN ('header', 'open', 'close')").withColumn("level", F.when(F.col("kind") == "close", F.col("depth")).otherwise(F.col("depth") - 1))
    closed = F.coalesce(F.lead("so_far").over(Window.partitionBy("path", "level").orderBy("pos")), F.col("total"))
    bodies = braces.withColumn("end", closed).filter("kind = 'header'")
    bad = bodies.filter("end.assigns > so_far.assigns AND end.requires = so_far.requires")
    return _diag(
        bad, "unguarded_action", "hint", T.group(F.col("tok"), rf"action{T.WS1}(\w+)"), line=T.first_line(F.col("tok"))
    )


def lint_unresolved_include(includes_raw: DataFrame, files: DataFrame, stdlib: DataFrame | None = None) -> DataFrame:
    """Unresolved includes: an error, or a warning with a suggestion when a name comes close."""
    bad = unresolved_includes(includes_raw, files, stdlib)
    stems = files.select(T.stem_of(F.col("path")).alias("stem"))
    near = near_miss(bad.select("include_name"), stems).withColumnRenamed("name", "include_name")
    rows = bad.join(near, "include_name", "left").withColumnRenamed("from_path", "path")
    return _diag(rows.filter("suggestion IS NULL"), "unresolved_include", "error", F.col("include_name")).unionByName(
        _diag(rows.filter("suggestion IS NOT NULL"), "near_miss", "warning", F.col("include_name"), F.col("suggestion"))
    )


def _tag_comments(files: DataFrame) -> DataFrame:
    rows = _numbered_hits(files, rf"{T.LINE}[^\n]*?#[ \t]*tag[ \t]*=[ \t]*\w+")
    return rows.select("path", "line", F.regexp_extract("hit", r"(\w+)$", 1).alias("value"))


def lint_placeholder_tag(files: DataFrame) -> DataFrame:
    return _diag(_tag_comments(files).filter(~F.col("value").rlike(r"^[0-9]+$")), "placeholder_tag", "info", F.col("value"))


def lint_duplicate_tag_value(files: DataFrame) -> DataFrame:
    rows = _tag_comments(files).filter(F.col("value").rlike(r"^[0-9]+$"))
    first = rows.groupBy("path", "value").agg(F.min("line").alias("first"), F.count("*").alias("n")).filter("n > 1")
    again = rows.join(first, ["path", "value"]).filter("line > first")
    return _diag(again, "duplicate_tag_value", "warning", F.col("value"), F.col("first") + 1)


def lint_lowercase_param(files: DataFrame) -> DataFrame:
    """Parameters of relations and functions that start in lower case, at the line they stand on."""
    rows = _numbered_hits(files, rf"{T.BOL}(?:relation|function)[ \t]+[\w.]+{T.WS}\([^)]+\)")
    args = F.split(F.regexp_extract("hit", r"(?s)\(([^)]+)\)$", 1), ",")
    # a part of the list may begin on a later line than the declaration
    rows = rows.select("path", "line", "hit", F.posexplode(args).alias("n", "arg"))
    head = F.substring_index("hit", "(", 1)
    upto = F.concat(head, F.array_join(F.slice(F.split(F.substring_index("hit", "(", -1), ","), F.lit(1), F.col("n")), ","),
                    F.regexp_extract("arg", rf"^((?:\s|{T.LINE})*)", 1))
    name = F.regexp_extract(T.unnumbered(F.col("arg")), r"^\s*([^:]*?)\s*(?::|$)", 1)
    bad = rows.withColumn("name", name).filter(F.col("name").rlike(r"^[a-z]"))
    return _diag(
        bad, "lowercase_param", "error", F.col("name"), T.group(F.col("hit"), r"(relation|function)"),
        line=F.coalesce(T.last_line(upto), F.col("line")),
    )


def lint_commented_requirement(files: DataFrame) -> DataFrame:
    """Comments that start with a statement word; softer when a neighbouring line explains it."""
    rows = explode_lines(files.select("path", "content"), before=2, after=1)
    first = F.lower(F.regexp_extract("text", r"^\s*#+\s*(\w+)(?=\s|$)", 1))
    noted = reduce(
        lambda a, b: a | b,
        [F.coalesce(F.lower(c).rlike(SUPPRESS_WORDS), F.lit(False)) for c in ("prev1", "prev2", "next1")],
    )
    hit = rows.withColumn("word", first).filter(F.col("word").isin(STATEMENTS))
    return _diag(
        hit, "commented_requirement", F.when(noted, "info").otherwise("hint"), F.col("word"), line=F.col("line_no")
    )


def first_bringer(includes: DataFrame, files: DataFrame) -> DataFrame:
    """``(path, line, include_name, brought)``: per asked file, the files each include adds that no earlier
    include of the file has brought.

    Files are numbered and taken in the order of their includes (``reach_least``); only where includes form a cycle, the
    closure of each included file is made and joined with its includers.
    """
    asked = files.select(F.col("path").alias("from_path")).distinct()
    own = includes.filter("to_path IS NOT NULL").join(asked, "from_path", "left_semi").select(
        "from_path", "line", "include_name", "to_path"
    )
    both = includes.select(F.col("from_path").alias("name")).unionByName(includes.select(F.col("to_path").alias("name")))
    ids = cut_lineage(both.filter("name IS NOT NULL").distinct().withColumn("id", F.monotonically_increasing_id()))
    of = lambda c, n: ids.select(F.col("name").alias(c), F.col("id").alias(n))
    step = includes.join(of("from_path", "node"), "from_path").join(of("to_path", "next"), "to_path").select("node", "next")
    order = Window.partitionBy("from_path").orderBy("line", "include_name")
    ranked = own.withColumn("rank", F.row_number().over(order).cast("long")).join(of("from_path", "start"), "from_path")
    ranked = cut_lineage(ranked.join(of("to_path", "node"), "to_path").drop("to_path"))
    least = reach_least(step, ranked)
    if least is not None:
        rows = least.withColumnRenamed("least", "rank").join(of("brought", "node"), "node").drop("node")
        rows = rows.join(ranked.drop("node"), ["start", "rank"])
        return rows.select(F.col("from_path").alias("path"), "line", "include_name", "brought")
    edges = includes.select(F.col("from_path").alias("src"), F.col("to_path").alias("dst"))
    far = reach(edges, own.select("to_path")).select(F.col("start").alias("to_path"), F.col("node").alias("brought"))
    near = own.select("to_path").distinct().withColumn("brought", F.col("to_path"))
    rows = own.join(far.unionByName(near), "to_path")
    return rows.groupBy(F.col("from_path").alias("path"), "brought").agg(
        F.min(F.struct("line", "include_name")).alias("i")
    ).select("path", "i.line", "i.include_name", "brought")


def include_summary_counts(includes: DataFrame, reqs: DataFrame, files: DataFrame) -> DataFrame:
    """Requirements each include newly brings into scope."""
    per_file = reqs.groupBy(F.col("path").alias("brought")).agg(F.count("*").alias("n"))
    return first_bringer(includes, files).join(per_file, "brought").groupBy("path", "line", "include_name").agg(
        F.sum("n").alias("inherited")
    )


def lint_inherited_requirements(includes: DataFrame, reqs: DataFrame, files: DataFrame) -> DataFrame:
    return _diag(
        include_summary_counts(includes, reqs, files), "inherited_requirements", "info", F.col("include_name"), F.col("inherited")
    )


def inherited_related(includes: DataFrame, reqs: DataFrame, files: DataFrame) -> DataFrame:
    """The requirements behind each include note, one row each.

    Notes and requirements meet at the file that is brought in; a caller that shows only some uses ``top_per_key``.
    """
    behind = reqs.select(F.col("path").alias("brought"), "kind", F.col("formula_text").alias("formula"), F.col("line").alias("req_line"))
    return first_bringer(includes, files).join(behind, "brought")


def lint_no_monitor(actions: DataFrame, reqs: DataFrame, exported: DataFrame | None = None) -> DataFrame:
    """Actions without a constraining requirement; with ``exported(name)`` only those."""
    rows = actions if exported is None else actions.join(exported.select("name").distinct(), "name", "left_semi")
    held = reqs.select(F.col("monitor_action").alias("name")).distinct()
    return _diag(rows.join(held, "name", "left_anti"), "no_monitor", "hint", F.col("name"))


def lint_export_no_monitor(patterns: DataFrame, symbols: DataFrame) -> DataFrame:
    """Actions that a file exports and declares but never monitors."""
    d = F.col("details")
    exported = patterns.filter("subtype = 'export'").groupBy("path", d["action"].alias("name")).agg(F.min("line").alias("line"))
    monitored = patterns.filter((F.col("subtype") == "monitor") & (d["mixin_kind"] != "implement")).select(
        "path", d["action"].alias("name")
    ).distinct()
    declared = symbols.filter("keyword = 'action'").select("path", "name").distinct()
    rows = exported.filter("name <> '_finalize'").join(monitored, ["path", "name"], "left_anti").join(
        declared, ["path", "name"], "left_semi"
    )
    return _diag(rows, "no_monitor", "hint", F.col("name"), F.lit("exported"))


def lint_high_impact_var(state_vars: DataFrame, reads: DataFrame, reqs: DataFrame) -> DataFrame:
    """Variables that at least five requirements read; detail = readers across files."""
    n = (
        reads.select("id", "var").distinct().join(reqs.select("id", F.col("path").alias("req_path")), "id")
        .groupBy(F.col("var").alias("id"))
        .agg(F.count("*").alias("readers"), F.count_distinct("req_path").alias("files"))
        .filter(F.col("readers") >= HIGH_IMPACT_READERS)
    )
    rows = state_vars.join(n, "id")
    return _diag(rows, "high_impact_var", "info", F.col("name"), F.concat_ws("/", "readers", "files"))


def _integer_tags(annotations: DataFrame) -> DataFrame:
    last = F.substring_index("tag", ":", -1)
    return annotation_tags(annotations).withColumn("n", F.when(last.rlike(r"^[0-9]+$"), last.try_cast("long"))).filter(
        "n IS NOT NULL"
    )


def lint_tag_duplicate(annotations: DataFrame) -> DataFrame:
    """Integer tags used again in a file, at the later line."""
    rows = annotations.select("path", "line", F.posexplode("tags").alias("at", "tag"))
    last = F.substring_index("tag", ":", -1)
    rows = rows.withColumn("n", F.when(last.rlike(r"^[0-9]+$"), last.try_cast("long"))).filter("n IS NOT NULL")
    first = rows.groupBy("path", "n").agg(
        F.min(F.struct("line", "at")).alias("f"), F.count("*").alias("c")
    ).filter("c > 1")
    again = rows.join(first, ["path", "n"]).filter(F.struct("line", "at") > F.col("f"))
    return _diag(again, "tag_duplicate", "warning", F.col("n"), F.col("f.line") + 1)


def lint_tag_gap(annotations: DataFrame) -> DataFrame:
    """Integers missing from the tags of a file, when there are five or more and few are missing.

    The row stands at the line of the tag one below, else one above, else at line 0.
    """
    tags = _integer_tags(annotations).groupBy("path", "n").agg(F.min("line").alias("line"))
    span = (
        tags.groupBy("path").agg(F.count("*").alias("c"), F.min("n").alias("lo"), F.max("n").alias("hi"))
        .withColumn("span", F.col("hi") - F.col("lo") + 1)
        .filter((F.col("c") >= TAG_GAP_MIN_TAGS) & ((F.col("span") - F.col("c")) / F.col("span") < TAG_GAP_MAX_RATIO))
    )
    missing = span.select("path", F.explode(F.sequence("lo", "hi")).alias("n")).join(tags, ["path", "n"], "left_anti")
    below = tags.select("path", (F.col("n") + 1).alias("n"), F.col("line").alias("b"))
    above = tags.select("path", (F.col("n") - 1).alias("n"), F.col("line").alias("a"))
    rows = missing.join(below, ["path", "n"], "left").join(above, ["path", "n"], "left").withColumn(
        "line", F.coalesce("b", "a", F.lit(0))
    )
    return _diag(rows, "tag_gap", "info", F.col("n"))


def lint_missing_tag(files: DataFrame) -> DataFrame:
    """Statement lines that end at the semicolon, hence carry no tag; the line of the keyword."""
    rows = _numbered_hits(files, rf"{T.BOL}(?:{'|'.join(STATEMENTS)})[ \t]+[^\n]+;[ \t]*(?=\n|\z)")
    h = T.unnumbered(F.col("hit"))
    return _diag(
        rows.filter(~h.rlike(r"#\s*\[")), "missing_tag", "hint", F.regexp_extract(h, r"^\s*(\w+)", 1)
    )


def lint_missing_finalize(files: DataFrame) -> DataFrame:
    name = F.lower(T.base_name(F.col("path")))
    bad = files.filter(
        F.contains(name, F.lit("test"))
        & ~F.contains("content", F.lit("_finalize"))
        & F.col("content").rlike(r"(?m)^[ \t]*export[ \t]+action")
    )
    return _diag(bad, "missing_finalize", "warning", line=F.lit(0))


def lint_orphan_tag(annotations: DataFrame, manifest: DataFrame) -> DataFrame:
    return _diag(orphan_tags(annotations, manifest), "orphan_tag", "warning", F.col("tag"))


def lint_unguarded_write(
    actions: DataFrame, state_vars: DataFrame, writes: DataFrame, reads: DataFrame
) -> DataFrame:
    """Variables written but read by no requirement or property.

    A write belongs to the action that starts last at or above it in its file; each action names its
    variables once. Variables that no action accounts for get a row at their declaration.
    """
    guarded = reads.select(F.col("var").alias("var_name")).distinct()
    known = state_vars.select(F.col("id").alias("var_name")).distinct()
    w = writes.select("path", "line", "var_name").join(guarded, "var_name", "left_anti")
    a = actions.groupBy("path", "line").agg(F.min("name").alias("action"))
    both = a.withColumn("var_name", F.lit(None).cast("string")).unionByName(
        w.withColumn("action", F.lit(None).cast("string"))
    ).withColumn("_last", F.col("var_name").isNotNull().cast("int"))
    filled = fill_forward(
        both, ["path"], ["line", "_last"],
        {"owner": F.when(F.col("action").isNotNull(), F.struct("action", F.col("line").alias("at")))},
    )
    placed = (
        filled.filter("var_name IS NOT NULL AND owner IS NOT NULL").select(
            "path", F.col("owner.at").alias("line"), F.col("owner.action").alias("action"), "var_name"
        ).distinct().join(known, "var_name", "left_semi")
    )
    rest = (
        state_vars.withColumn("var_name", F.col("id"))
        .join(w.select("var_name").distinct(), "var_name", "left_semi")
        .join(placed.select("var_name").distinct(), "var_name", "left_anti")
    )
    return _diag(placed, "unguarded_write", "hint", F.col("action"), F.col("var_name")).unionByName(
        _diag(rest, "unguarded_write", "hint", F.lit(""), F.col("var_name"))
    )


def lint_dead_guard(reqs: DataFrame) -> DataFrame:
    return _diag(reqs.filter(F.trim("formula_text") == "false"), "dead_guard", "info", F.col("monitor_action"))


def lint_orphan_hook(reqs: DataFrame, declared_actions: DataFrame) -> DataFrame:
    """Monitored actions that are declared nowhere."""
    known = declared_actions.select(F.col("name").alias("monitor_action")).distinct()
    rows = reqs.filter(F.coalesce("monitor_action", F.lit("")) != "").join(known, "monitor_action", "left_anti")
    return _diag(rows, "orphan_hook", "warning", F.col("monitor_action"))


def lint_unused_state_var(state_vars: DataFrame, edges: DataFrame) -> DataFrame:
    """Variables that no edge touches."""
    used = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    return _diag(state_vars.join(used, "id", "left_anti"), "unused_state_var", "hint", F.col("name"))


def lint_shadow_declaration(shadows: DataFrame) -> DataFrame:
    return _diag(shadows, "shadow_declaration", "hint", F.col("name"), F.col("other_path"))


# ---- the union ------------------------------------------------------------------------------------

#: Rules that need nothing but the text of the files.
TEXT_RULES = {
    "missing_header": lint_missing_header,
    "unmatched_brace": lint_unmatched_brace,
    "missing_init": lint_missing_init,
    "empty_init": lint_empty_init,
    "duplicate_decl": lint_duplicate_decl,
    "unguarded_action": lint_unguarded_action,
    "duplicate_tag_value": lint_duplicate_tag_value,
    "placeholder_tag": lint_placeholder_tag,
    "lowercase_param": lint_lowercase_param,
    "commented_requirement": lint_commented_requirement,
    "missing_tag": lint_missing_tag,
    "missing_finalize": lint_missing_finalize,
}
#: Rules that look at one line at a time and run on a stream without state.
STATELESS_RULES = [
    "missing_header", "empty_init", "placeholder_tag", "lowercase_param", "commented_requirement",
    "missing_tag", "missing_finalize",
]


def text_diagnostics(files: DataFrame, rules: list[str] | None = None) -> DataFrame:
    return reduce(DataFrame.unionByName, [TEXT_RULES[r](files) for r in rules or TEXT_RULES])


def all_diagnostics(
    parts: list[DataFrame],
    file_layers: DataFrame | None = None,
    layers: list[str] | None = None,
    min_severity: str | None = None,
) -> DataFrame:
    """Union of lint tables, for chosen layers and severities."""
    out = reduce(DataFrame.unionByName, parts)
    if file_layers is not None and layers:
        out = filter_visible(out, file_layers, layers)
    return filter_severity(out, min_severity) if min_severity else out


def diagnostics_counts(diags: DataFrame) -> DataFrame:
    return diags.groupBy("code", "severity").agg(F.count("*").alias("n"))


