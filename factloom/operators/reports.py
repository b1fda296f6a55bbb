"""Summaries and gates over the fact tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators.documents import LEVEL_SYNONYMS
from factloom.operators.filters import classify_direction, requirement_class
from factloom.operators.graph import vars_written_by_action, written_var_counts
from factloom.operators.resolve import unresolved_includes
from factloom.plans.bitsets import counts_through
from factloom.plans.keyed import pick_last, top_per_key

MIXINS = ["before", "after", "around", "implement", "direct"]
KINDS = ["require", "ensure", "assume", "assert"]


# ---- per action -----------------------------------------------------------------------------------


def action_requirements(actions: DataFrame, reqs: DataFrame, formula_chars: int | None = 200) -> DataFrame:
    """One row per action and requirement: mixin group, kind, class, formula, place.

    Formulas of more than ``formula_chars`` characters are cut there and end in ``...``; None keeps them whole.
    """
    a = actions.select(F.col("id").alias("action")).distinct()
    formula = F.col("formula_text")
    if formula_chars is not None:
        cut = F.concat(F.substring(formula, 1, formula_chars), F.lit("..."))
        formula = F.when(F.length(formula) > formula_chars, cut).otherwise(formula)
    return reqs.withColumn("action", F.col("monitor_action")).join(a, "action", "left_semi").select(
        "action", "mixin_kind", "id", "kind", requirement_class().alias("class"), formula.alias("formula"), "path", "line"
    )


def select_actions(
    actions: DataFrame,
    scope_members: DataFrame | None = None,
    scope: str | None = None,
    corpus: str | None = None,
    action: str | None = None,
    path: str | None = None,
) -> DataFrame:
    """The actions a report is asked for; arguments left out restrict nothing.

    ``scope`` keeps the files of a known scope (an unknown one restricts nothing), ``corpus`` the files whose path
    holds the text, ``action`` an id, name or qualified name, ``path`` the file of that path or, if no action left
    lies in one, the files of that base name or with that end.
    """
    out = actions
    if scope is not None:
        members = scope_members.filter(F.col("scope_file") == scope).select(F.col("member_path").alias("path")).distinct()
        out = out.join(members, "path", "left_semi").unionByName(out.filter(~members.exists()))
    if corpus:
        out = out.filter(F.contains("path", F.lit(corpus)))
    if action:
        out = out.filter(F.lit(action).isin(F.col("id"), F.col("name"), F.col("qualified_name")))
    if path:
        exact = out.filter(F.col("path") == path)
        like = (T.base_name(F.col("path")) == path.rsplit("/", 1)[-1]) | F.endswith("path", F.lit("/" + path))
        out = exact.unionByName(out.filter(like & ~exact.select("path").exists()))
    return out


def action_report(
    actions: DataFrame,
    reqs: DataFrame,
    reads: DataFrame,
    writes: DataFrame,
    scope_members: DataFrame | None = None,
    scope_names: DataFrame | None = None,
    scope: str | None = None,
    offset: int = 0,
    limit: int | None = None,
    **asked: str | None,
) -> DataFrame:
    """One row per action asked for (see ``select_actions``), a page of them by path, line and id: requirements by
    mixin and by kind, variables read and written, tags, direction in the scope (null without a known one), and how
    many actions there are and whether more follow.

    The page is cut before anything is joined to it. What is counted stands as rows in ``action_requirements``,
    ``action_tags`` and ``action_variables``, which take the page as their actions.
    """
    chosen = select_actions(actions, scope_members, scope, **asked).select("id", "name", "qualified_name", "path", "line")
    total = chosen.count()
    page = chosen
    if offset or limit is not None:
        page = chosen.orderBy("path", "line", "id").offset(offset)
        page = page if limit is None else page.limit(limit)
    ids = page.select("id").distinct()
    own = reqs.join(ids.withColumnRenamed("id", "monitor_action"), "monitor_action", "left_semi")
    counts = own.groupBy(F.col("monitor_action").alias("id")).agg(
        *[F.count_if(F.col("mixin_kind") == m).alias(m) for m in MIXINS],
        *[F.count_if(F.col("kind") == k).alias(k) for k in KINDS],
        F.count("*").alias("requirements"),
    )
    out = page
    for part in (counts, *_variable_counts(own, reads, writes), _tag_counts(page, own)):
        out = out.join(part, "id", "left")
    numbers = [c for c in out.columns if c not in page.columns]
    out = out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in numbers})
    direction = F.lit(None).cast("string")
    if scope is not None and not scope_members.filter(F.col("scope_file") == scope).isEmpty():
        out = classify_direction(out, scope_names.filter(F.col("scope_file") == scope))
        direction = F.col("action_direction")
    more = limit is not None and offset + limit < total
    return out.withColumn("direction", direction).drop("action_direction").withColumns(
        {"total": F.lit(total).cast("long"), "has_more": F.lit(more)}
    )


def action_variables(actions: DataFrame, reqs: DataFrame, reads: DataFrame, writes: DataFrame) -> DataFrame:
    """``(action, access, var)``: variables that an action's requirements read, and those written in their files."""
    asked = actions.select(F.col("id").alias("monitor_action")).distinct()
    own = reqs.join(asked, "monitor_action", "left_semi")
    read = reads.select("id", "var").join(own.select("id", F.col("monitor_action").alias("action")), "id")
    written = vars_written_by_action(own, writes, asked)
    return read.select("action", F.lit("read").alias("access"), "var").distinct().unionByName(
        written.select("action", F.lit("written").alias("access"), "var")
    )


def _variable_counts(reqs: DataFrame, reads: DataFrame, writes: DataFrame) -> tuple[DataFrame, DataFrame]:
    # the count is of distinct variables, so that repeated reads need not go first
    read = (
        reads.select("id", "var").join(reqs.select("id", "monitor_action"), "id")
        .groupBy(F.col("monitor_action").alias("id")).agg(F.count_distinct("var").alias("vars_read"))
    )
    return read, written_var_counts(reqs, writes).withColumnRenamed("action", "id")


def _tag_counts(actions: DataFrame, reqs: DataFrame) -> DataFrame:
    return action_tags(actions, reqs).groupBy(F.col("action").alias("id")).agg(F.count("*").alias("tags"))


def action_tags(actions: DataFrame, reqs: DataFrame) -> DataFrame:
    """Distinct tags per action, one row each."""
    a = actions.select(F.col("id").alias("monitor_action")).distinct()
    return reqs.join(a, "monitor_action", "left_semi").select(
        F.col("monitor_action").alias("action"), F.explode("tags").alias("tag")
    ).distinct()


def paginate(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """One page in the given order, each row with the total and whether more follow."""
    total = df.count()
    page = df.orderBy(*order).offset(offset).limit(limit)
    return page.withColumn("total", F.lit(total).cast("long")).withColumn("has_more", F.lit(offset + limit < total))


def top_k(df: DataFrame, order: list, k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def truncate_lists(df: DataFrame, group: str, item: str, k: int) -> DataFrame:
    """First ``k`` items per group, with the number there were and a truncated flag."""
    counts = df.groupBy(group).agg(F.count("*").alias("original_count"))
    kept = top_per_key(df.select(group, item), [group], [F.col(item)], k)
    return kept.join(counts, group).withColumn("truncated", F.col("original_count") > k)


def model_summary(
    actions: DataFrame, reqs: DataFrame, reads: DataFrame, writes: DataFrame, exports: DataFrame | None = None
) -> DataFrame:
    """Per action: requirement counts by mixin and kind, variables read and written, tags, direction."""
    def n(kind: str, mixin: str | None = None) -> Column:
        cond = F.col("kind") == kind
        return F.count_if(cond if mixin is None else cond & (F.col("mixin_kind") == mixin))

    counts = reqs.groupBy(F.col("monitor_action").alias("id")).agg(
        n("require", "before").alias("before_require"),
        n("ensure", "before").alias("before_ensure"),
        n("require", "after").alias("after_require"),
        n("ensure", "after").alias("after_ensure"),
        n("assume").alias("assumes"),
        n("assert").alias("asserts"),
        F.count("*").alias("requirements"),
    )
    out = actions.select("id", "name", "path", "line")
    for part in (counts, *_variable_counts(reqs, reads, writes), _tag_counts(actions, reqs)):
        out = out.join(part, "id", "left")
    numbers = [c for c in out.columns if c not in ("id", "name", "path", "line")]
    out = out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in numbers})
    if exports is None:
        return out
    flags = exports.groupBy("name").agg(
        F.max(F.col("direction") == "export").alias("_e"), F.max(F.col("direction") == "import").alias("_i")
    )
    return out.join(flags, "name", "left").withColumn(
        "direction", F.when(F.col("_e"), "GENERATED").when(F.col("_i"), "RECEIVED").otherwise("INTERNAL")
    ).drop("_e", "_i")


def scoped_model_summary(
    actions: DataFrame,
    reqs: DataFrame,
    reads: DataFrame,
    writes: DataFrame,
    scope_members: DataFrame,
    scope_names: DataFrame,
    scope: str,
    corpus: str | None = None,
) -> DataFrame:
    """``model_summary`` of the actions in a known scope's files, with their direction in it."""
    chosen = select_actions(actions, scope_members, scope, corpus)
    own = reqs.join(chosen.select(F.col("id").alias("monitor_action")).distinct(), "monitor_action", "left_semi")
    return model_summary(chosen, own, reads, writes, scope_names.filter(F.col("scope_file") == scope))


def model_totals(actions: DataFrame, state_vars: DataFrame, reqs: DataFrame) -> DataFrame:
    """Numbers of actions, variables and requirements as ``(metric, value)`` rows."""
    one = lambda df, name: df.agg(F.count("*").alias("value")).select(F.lit(name).alias("metric"), "value")
    return one(actions, "actions").unionByName(one(state_vars, "state_vars")).unionByName(one(reqs, "requirements"))


def layered_overview(actions: DataFrame, state_vars: DataFrame, reqs: DataFrame, group_by: str = "file") -> DataFrame:
    """Actions, variables and requirements per file or per module."""
    key = F.col("path") if group_by == "file" else T.module_of(F.col("qualified_name"))
    per_action = reqs.groupBy(F.col("monitor_action").alias("id")).agg(F.count("*").alias("reqs"))
    a = actions.join(per_action, "id", "left").select(
        key.alias("group"), F.lit(1).alias("a"), F.lit(0).alias("v"), F.coalesce("reqs", F.lit(0)).alias("r")
    )
    v = state_vars.select(key.alias("group"), F.lit(0).alias("a"), F.lit(1).alias("v"), F.lit(0).alias("r"))
    return a.unionByName(v).groupBy("group").agg(
        F.sum("a").alias("actions"), F.sum("v").alias("state_vars"), F.sum("r").alias("requirements")
    )


def requirement_counts(reqs: DataFrame) -> DataFrame:
    return reqs.groupBy(F.col("monitor_action").alias("action"), "kind").agg(F.count("*").alias("n"))


def _in_scopes(reqs: DataFrame, scope_members: DataFrame, scope_names: DataFrame) -> DataFrame:
    """Requirement counts per scope, action, kind and class, marked with the direction of the action.

    Requirements are counted per file before they meet the scopes that hold the file, and only the names of a file that the scope knows,
    exported or imported, bring their counts along: of all pairs of a scope and a file these are few.
    """
    per_file = reqs.withColumn("class", requirement_class()).groupBy(
        F.col("path").alias("member_path"), F.col("monitor_action").alias("name"), "kind", "class"
    ).agg(F.count("*").alias("n"))
    # a file has a count for each kind and class of a name, at most
    per_name = per_file.groupBy("member_path", "name").agg(F.collect_list(F.struct("kind", "class", "n")).alias("_counts"))
    flags = scope_names.groupBy("scope_file", "name").agg(
        F.max(F.col("direction") == "export").alias("exported")
    )
    held = scope_members.select("scope_file", "member_path").join(per_name.select("member_path", "name"), "member_path")
    known = held.join(flags, ["scope_file", "name"]).groupBy("scope_file", "name", "member_path").agg(F.max("exported").alias("exported"))
    each = known.join(per_name, ["member_path", "name"]).select("scope_file", "name", "exported", F.inline("_counts"))
    return each.groupBy("scope_file", "name", "kind", "class").agg(F.sum("n").alias("n"), F.max("exported").alias("exported"))


def scoped_counts(reqs: DataFrame, scope_members: DataFrame, scope_names: DataFrame) -> DataFrame:
    """Requirement counts by kind inside each scope, exported actions only."""
    return (
        _in_scopes(reqs, scope_members, scope_names).filter("exported")
        .groupBy("scope_file", F.col("name").alias("action"), "kind").agg(F.sum("n").alias("n"))
    )


def scoped_nct_counts(reqs: DataFrame, scope_members: DataFrame, scope_names: DataFrame) -> DataFrame:
    """Counts by kind and class inside each scope; exported and imported actions, internal ones never."""
    return _in_scopes(reqs, scope_members, scope_names).select(
        "scope_file", F.col("name").alias("action"), "kind", "class", "n"
    )


# ---- inline numbers -------------------------------------------------------------------------------


def monitor_summary(monitors: DataFrame, reqs: DataFrame, reads: DataFrame) -> DataFrame:
    """Per monitor line: requirements by kind on its action and distinct variables read."""
    kinds = reqs.groupBy(F.col("monitor_action").alias("action")).agg(
        *[F.count_if(F.col("kind") == k).alias(k) for k in KINDS]
    )
    read = (
        reads.select("id", "var").distinct().join(reqs.select("id", "monitor_action"), "id")
        .groupBy(F.col("monitor_action").alias("action")).agg(F.count_distinct("var").alias("vars_read"))
    )
    return monitors.select("path", "line", "action").join(kinds, "action").join(read, "action", "left").withColumn(
        "vars_read", F.coalesce("vars_read", F.lit(0).cast("long"))
    )


def state_var_summary(state_vars: DataFrame, reads: DataFrame, reqs: DataFrame) -> DataFrame:
    """Per variable: requirements that read it and the files they stand in."""
    n = (
        reads.select("id", F.col("var")).distinct().join(reqs.select("id", F.col("path").alias("req_path")), "id")
        .groupBy(F.col("var").alias("id"))
        .agg(F.count("*").alias("readers"), F.count_distinct("req_path").alias("files"))
    )
    return state_vars.join(n, "id")


def property_summary(properties: DataFrame, property_reads: DataFrame, reads: DataFrame, reqs: DataFrame) -> DataFrame:
    """Per property: requirements that share a variable with it, and their files.

    Popular variables never multiply with the properties that use them; the counts are exact.
    """
    readers = reads.select("id", "var").distinct().join(reqs.select("id", F.col("path").alias("req_path")), "id")
    used = property_reads.select(F.col("id").alias("pid"), "var")
    counts = counts_through(used, readers, "pid", "var", {"requirements": "id", "files": "req_path"})
    return properties.withColumn("pid", F.col("id")).join(counts, "pid").drop("pid")


def annotation_levels(annotations: DataFrame, manifest: DataFrame) -> DataFrame:
    """Every tag with the level of the requirement of that exact id, if any."""
    level = manifest.select(F.col("req_id").alias("tag"), "level")
    return annotations.select("path", "line", F.explode("tags").alias("tag")).join(level, "tag", "left")


# ---- gates ----------------------------------------------------------------------------------------


def quality_gate(
    files: DataFrame,
    includes_raw: DataFrame,
    manifest: DataFrame | None = None,
    level: str = "minimal",
    stdlib: DataFrame | None = None,
) -> DataFrame:
    """Check rows ``(check, level, count, passed)`` up to minimal, standard or comprehensive.

    All counts over text come from one scan of the files.
    """
    name = T.base_name(F.col("path"))
    body = F.col("content")
    count = lambda p: F.regexp_count(body, F.lit(p))
    # text columns are only computed for the checks that are asked for
    wanted = {
        "no_header": (~F.startswith(body, F.lit("#lang"))).cast("long"),
        "files": F.lit(1).cast("long"),
    }
    if level != "minimal":
        wanted["tests"] = F.contains(name, F.lit("_test")).cast("long")
        wanted["monitors"] = count(r"(?m)^[ \t]*(?:before|after|around)\s+")
        wanted["exports"] = count(r"(?m)^[ \t]*export\s+\w+")
    if level == "comprehensive":
        wanted["tags"] = count(r"(?m)#[ \t]*\[[\w:.,\s]+\][ \t]*$")
    sums = files.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(k) for k, c in wanted.items()])
    rows = [
        ("lang_header", "minimal", "no_header", F.col("no_header") == 0),
        ("minimum_files", "minimal", "files", F.col("files") >= 3),
    ]
    if level != "minimal":
        rows += [
            ("test_specs_exist", "standard", "tests", F.col("tests") > 0),
            ("monitors_exist", "standard", "monitors", F.col("monitors") > 0),
            ("exports_exist", "standard", "exports", F.col("exports") > 0),
        ]
    if level == "comprehensive":
        rows.append(("annotations_exist", "comprehensive", "tags", F.col("tags") > 0))
    shown = F.array(
        *[
            F.struct(
                F.lit(c).alias("check"), F.lit(lv).alias("level"), F.col(k).alias("count"), ok.alias("passed")
            )
            for c, lv, k, ok in rows
        ]
    )
    out = sums.select(F.explode(shown).alias("r")).select("r.*")
    bad = unresolved_includes(includes_raw, files.select("path"), stdlib).agg(F.count("*").alias("count"))
    out = out.unionByName(
        bad.select(F.lit("includes_resolve").alias("check"), F.lit("minimal").alias("level"), "count", (F.col("count") == 0).alias("passed"))
    )
    if level == "comprehensive" and manifest is not None:
        m = manifest.agg(F.count("*").alias("count"))
        out = out.unionByName(
            m.select(F.lit("manifest_exists").alias("check"), F.lit("comprehensive").alias("level"), "count", (F.col("count") > 0).alias("passed"))
        )
    return out


def gate_result(checks: DataFrame) -> DataFrame:
    return checks.agg(
        F.bool_and("passed").alias("passed"), F.count_if("passed").alias("checks_passed"), F.count("*").alias("checks_total")
    )


# Expected parts of a model: name, file name pattern ({p} = corpus), text that shows it.
LAYER_RULES = [
    ("types", "{p}_types.%", "type "),
    ("codec", "{p}_codec.%", "interpret "),
    ("frame", "{p}_frame.%", "variant "),
    ("packet", "{p}_packet.%", "type.*quic_packet"),
    ("connection", "{p}_connection.%", "relation conn"),
    ("transport", "{p}_transport.%", "action "),
    ("security", "{p}_security.%", "action "),
    ("application", "{p}_application.%", "action app_"),
    ("shim", "{p}_shim%.%", "<<< impl"),
    ("test_specs", "{p}_%_test_%.%", "export "),
    ("entities", None, "instance "),
    ("behavior", "{p}_%_behavior.%", "before "),
    ("recovery", "%recovery%.%", None),
    ("extensions", "%ext%.%", None),
]
HIGH_PRIORITY_LAYERS = ["types", "frame", "packet", "connection"]


def completeness_score(
    files: DataFrame, corpus: str, rules: list[tuple] = LAYER_RULES, reach: int | None = None
) -> DataFrame:
    """Expected parts of a model: present or missing, priority of a missing one, and the score of all.

    Markers count anywhere in a text, or within its first ``reach`` characters if that is given. One pass over the files: every rule is a pair of flags, or-ed over the files.
    """
    name = T.base_name(F.col("path"))
    escape = lambda p: p.replace("{p}", corpus).replace("_", r"\_")
    searched = F.col("content") if reach is None else F.substring("content", 1, reach)
    flags = []
    for layer, pattern, marker in rules:
        by_name = name.like(escape(pattern)) if pattern else F.lit(False)
        by_text = F.contains(searched, F.lit(marker)) if marker else F.lit(False)
        flags.append(F.coalesce(F.max(by_name | by_text), F.lit(False)).alias(layer))
    row = files.agg(*flags)
    parts = F.array(*[F.struct(F.lit(r[0]).alias("layer"), F.col(r[0]).alias("present")) for r in rules])
    present = sum((F.col(r[0]).cast("int") for r in rules), F.lit(0))
    return (
        row.select(F.explode(parts).alias("l"), F.bround(present * 100 / len(rules), 0).cast("int").alias("score"))
        .select("l.layer", "l.present", "score")
        .withColumn(
            "priority",
            F.when(F.col("present"), F.lit(None)).when(F.col("layer").isin(HIGH_PRIORITY_LAYERS), "high").otherwise("medium"),
        )
    )


def suggestions(
    actions: DataFrame,
    reqs: DataFrame,
    state_vars: DataFrame,
    reads: DataFrame,
    writes: DataFrame,
    action: str | None = None,
    path: str | None = None,
    line: int | None = None,
) -> DataFrame:
    """What to specify next.

    For a chosen action: variables that requirements sharing a variable with it read and it does not
    (two hops, medium), and variables its files write that it does not guard (high). Otherwise: actions
    without requirement (high) and variables no requirement reads (medium), for one file if asked, nearest line first.
    """
    if action is not None:
        own_reqs = reqs.filter(F.col("monitor_action") == action).select("id", "path")
        r = reads.select("id", "var").distinct().join(reqs.select("id"), "id", "left_semi")
        own = r.join(own_reqs.select("id"), "id", "left_semi").select("var").distinct()
        sharing = r.join(own, "var", "left_semi").select("id").distinct()
        related = r.join(sharing, "id", "left_semi").select("var").distinct().join(own, "var", "left_anti")
        written = writes.join(own_reqs.select("path").distinct(), "path", "left_semi").select("var").distinct()
        vars_ = state_vars.select(F.col("id").alias("var"), "name", "path", "line")
        soft = related.join(vars_, "var").select(
            F.lit("state_var").alias("type"), "name", "path", "line", F.lit("medium").alias("priority")
        )
        hard = written.join(own, "var", "left_anti").join(vars_, "var").select(
            F.lit("missing_guard").alias("type"), "name", "path", "line", F.lit("high").alias("priority")
        )
        return soft.unionByName(hard)
    held = reqs.select(F.col("monitor_action").alias("id")).distinct()
    read = reads.join(reqs.select("id"), "id", "left_semi").select(F.col("var").alias("id")).distinct()
    rows = (
        actions.join(held, "id", "left_anti").select(
            F.lit("uncovered_action").alias("type"), "name", "path", "line", F.lit("high").alias("priority")
        ).unionByName(
            state_vars.join(read, "id", "left_anti").select(
                F.lit("unguarded_state").alias("type"), "name", "path", "line", F.lit("medium").alias("priority")
            )
        )
    )
    if path is None:
        return rows
    base = T.base_name(F.col("path"))
    rows = rows.filter((F.col("path") == path) | (base == path.rsplit("/", 1)[-1]) | F.endswith("path", F.lit("/" + path)))
    return rows if line is None else rows.orderBy(F.abs(F.col("line") - line), "type", "name")


# ---- files, failures, events -----------------------------------------------------------------------


def verification_dashboard(results: DataFrame, files: DataFrame) -> DataFrame:
    """Verified, failed and pending files per corpus, by the latest result of each file."""
    latest = pick_last(results.select("path", "checked_at", "success"), ["path"], ["checked_at", "success"])
    state = F.when(F.col("success"), "verified").when(~F.col("success"), "failed").otherwise("pending")
    return (
        files.select("corpus", "path").distinct().join(latest.select("path", "success"), "path", "left")
        .withColumn("state", state)
        .groupBy("corpus", "state").agg(F.count("*").alias("files"))
    )


def failure_reasons(failures: DataFrame, k: int | None = None) -> DataFrame:
    """Failures by message: how many, and their files as rows; the first ``k`` by name, ranked, if that is given."""
    counts = failures.groupBy("message").agg(F.count("*").alias("n"))
    files = failures.select("message", "path").distinct()
    return counts.join(files if k is None else top_per_key(files, ["message"], [F.col("path")], k), "message")


def error_groups(errors: DataFrame, k: int | None = None) -> DataFrame:
    """``errors(symbol, locations)``: duplicate (two or more places), unresolved (none) or other, with the count
    of each kind and its symbols as rows; the first ``k`` by name, ranked, if that is given."""
    kind = (
        F.when(F.col("locations") == 0, "unresolved").when(F.col("locations") >= 2, "duplicate").otherwise("other")
    )
    rows = errors.withColumn("kind", kind)
    counts = rows.groupBy("kind").agg(F.count("*").alias("n"))
    names = rows.select("kind", "symbol").distinct()
    return counts.join(names if k is None else top_per_key(names, ["kind"], [F.col("symbol")], k), "kind")


def scope_view_status(scope_members: DataFrame, changes: DataFrame) -> DataFrame:
    """Per scope: stale when a changed file is a member; complete, partial (a member is deleted) or building.

    ``changes(path, op, seq)``; the last operation on a path counts.
    """
    last = pick_last(changes.select("path", "op", "seq"), ["path"], ["seq"]).select(
        F.col("path").alias("member_path"), "op"
    )
    rows = scope_members.join(last, "member_path", "left")
    agg = rows.groupBy("scope_file").agg(
        F.max(F.coalesce(F.col("op").isin("create", "change"), F.lit(False))).alias("is_stale"),
        F.max(F.coalesce(F.col("op") == "delete", F.lit(False))).alias("deleted"),
        F.count_if(F.coalesce(F.col("op") != "delete", F.lit(True))).alias("files"),
    )
    state = F.when(F.col("files") == 0, "building").when(F.col("deleted"), "partial").otherwise("complete")
    return agg.select("scope_file", "is_stale", state.alias("completeness"), "files")


def list_scopes(scopes: DataFrame, corpus: str | None = None) -> DataFrame:
    rows = scopes if corpus is None else scopes.filter(F.col("corpus") == corpus)
    return rows.orderBy("scope_file")


def tool_metrics(events: DataFrame) -> DataFrame:
    """Per tool: calls, mean duration in ms (two decimals), errors, timeouts."""
    return events.groupBy("name").agg(
        F.count("*").alias("calls"),
        F.bround(F.avg("duration_ms"), 2).alias("avg_ms"),
        F.count_if(F.col("status") == "error").alias("errors"),
        F.count_if(F.col("status") == "timeout").alias("timeouts"),
    )


def recent_events(journal: DataFrame, n: int = 20) -> DataFrame:
    """The last ``n`` rows of a journal ordered by ``seq``."""
    return journal.orderBy(F.col("seq").desc()).limit(n)


def archive_split(journal: DataFrame, limit: int = 200) -> DataFrame:
    """Rows marked ``archived``: the older half of every journal that holds more than ``limit`` rows.

    ``journal(journal_id, seq)`` is numbered densely from 0, as a journal is; so the half is a comparison
    and needs no ordering of a whole journal in one task.
    """
    size = journal.groupBy("journal_id").agg(F.count("*").alias("_n"), F.min("seq").alias("_lo"))
    half = F.floor(F.col("_n") / 2)
    return journal.join(size, "journal_id").withColumn(
        "archived", (F.col("_n") > limit) & (F.col("seq") - F.col("_lo") < half)
    ).drop("_n", "_lo")


# ---- manifests and staleness ------------------------------------------------------------------------

# Levels a manifest may use.
VALID_LEVELS = ["MUST", "MUST NOT", "SHOULD", "SHOULD NOT", "MAY"]


def manifest_info(manifests: DataFrame, corpora: DataFrame) -> DataFrame:
    """Per corpus: manifests and requirements; a corpus without a manifest has zeros."""
    n = manifests.groupBy("corpus").agg(
        F.count_distinct("path").alias("manifests"), F.count("req_id").alias("requirements")
    )
    zero = F.lit(0).cast("long")
    return corpora.select("corpus").distinct().join(n, "corpus", "left").withColumns(
        {"manifests": F.coalesce("manifests", zero), "requirements": F.coalesce("requirements", zero)}
    )


def validate_manifest(manifests: DataFrame) -> DataFrame:
    """Warnings ``(path, req_id, rule)`` over manifest rows ``(path, rfc, req_id, text, section, level)``.

    A row with a null ``req_id`` stands for a manifest without requirements.
    """
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    level = F.upper(F.coalesce("level", F.lit("")))
    synonym = level.isin(list(LEVEL_SYNONYMS))
    rules = F.filter(
        F.array(
            F.when(empty("text"), "missing_text"),
            F.when(empty("section"), "missing_section"),
            F.when(synonym, "level_synonym").when((level != "") & ~level.isin(VALID_LEVELS), "invalid_level"),
        ),
        lambda r: r.isNotNull(),
    )
    rows = manifests.filter("req_id IS NOT NULL")
    per_row = rows.select("path", "req_id", F.explode(rules).alias("rule"))
    repeated = rows.groupBy("path", "req_id").agg(F.count("*").alias("n")).filter("n > 1").select(
        "path", "req_id", F.lit("duplicate_id").alias("rule")
    )
    none = F.lit(None).cast("string").alias("req_id")
    whole = manifests.groupBy("path").agg(F.max("rfc").alias("rfc"), F.count("req_id").alias("n"))
    no_doc = whole.filter(empty("rfc")).select("path", none, F.lit("missing_document").alias("rule"))
    no_reqs = whole.filter("n = 0").select("path", none, F.lit("missing_requirements").alias("rule"))
    return reduce(DataFrame.unionByName, [per_row, repeated, no_doc, no_reqs])


def manifest_staleness(meta: DataFrame, docs: DataFrame) -> DataFrame:
    """``meta(path, source, content_hash, obsoleted_by)`` against ``docs(source, text)``: stale when the hash
    of the source differs or the source is obsolete; unknown when the source is missing."""
    now = docs.select("source", F.sha2(F.encode("text", "utf-8"), 256).alias("now"))
    rows = meta.join(now, "source", "left")
    match = F.col("now") == F.col("content_hash")
    obsolete = F.coalesce("obsoleted_by", F.lit("")) != ""
    return rows.select(
        "path", "source", match.alias("hash_match"),
        (F.coalesce(~match, F.lit(False)) | obsolete).alias("is_stale"),
    )


def index_staleness(meta: DataFrame, files: DataFrame, tolerance_s: float = 1.0) -> DataFrame:
    """Per corpus: indexed files that are gone, changed or without time, and what that means.

    Fresh when none, ``stale_minor`` below a tenth, else ``stale_major``; files the index does not know
    are counted beside.
    """
    m = meta.select("corpus", "path", F.col("mtime").alias("was"), F.lit(True).alias("_known"))
    f = files.select("corpus", "path", F.col("mtime").alias("now"))
    rows = m.join(f, ["corpus", "path"], "full")
    known = F.coalesce("_known", F.lit(False))
    changed = known & (
        F.col("was").isNull() | F.col("now").isNull() | (F.abs(F.col("now") - F.col("was")) > tolerance_s)
    )
    agg = rows.groupBy("corpus").agg(
        F.count_if(known).alias("total_files"), F.count_if(changed).alias("changed_files"),
        F.count_if(~known).alias("new_files"),
    )
    status = (
        F.when(F.col("total_files") == 0, "stale_major")
        .when(F.col("changed_files") == 0, "fresh")
        .when(F.col("changed_files") * 10 < F.col("total_files"), "stale_minor")
        .otherwise("stale_major")
    )
    return agg.withColumn("status", status)


def classify_files(files: DataFrame, meta: DataFrame, fact_tables: list[DataFrame] | None = None) -> DataFrame:
    """Each file with ``cache_hit``: same hash in the index and present in every fact table given."""
    current = files.withColumn("sha256", F.sha2(F.encode("content", "utf-8"), 256)).select("path", "sha256")
    known = meta.select("path", "sha256").filter("sha256 <> ''").distinct()
    for t in fact_tables or []:
        known = known.join(t.select("path").distinct(), "path", "left_semi")
    hit = known.withColumn("_hit", F.lit(True))
    return current.join(hit, ["path", "sha256"], "left").select(
        "path", "sha256", F.coalesce("_hit", F.lit(False)).alias("cache_hit")
    )
