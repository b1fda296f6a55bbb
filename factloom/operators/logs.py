"""Logs of checking tools: diagnostics, check results, counterexamples.

Input is ``log(log_id, line_no, text)``. Context that an earlier line sets (isolate, section, step) reaches
the later ones through ``fill_forward``, which splits a long log into chunks.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.plans.keyed import fill_forward, pick_first

# Line formats of the tool logs.
RUNTIME_ERROR = r"[\w.]*Error:\s*(.*?):\s*line\s+([0-9]+):\s*(?:(error|warning):\s*)?(.*)"
COMPILER_LINE = r"^(.*?\.\w+):([0-9]+):[0-9]+:\s*(error|warning|fatal error):\s*(.*)"
VERBOSE_LINE = r"^(.*?):\s*line\s+([0-9]+):\s*(error|warning):\s*(.*)"
PLAIN_LINE = r"^(.*?):([0-9]+):\s*(error|warning):\s*(.*)"
EXCEPTION_LINE = r"^(\w+(?:\.\w+)*(?:Error|Exception|Warning|Exit))\s*:\s*(.*)"
ISOLATE_HEADER = r"^Isolate\s+(.+?)\s*:$"
ACTION_CONTEXT = r"^in action\s+(.+?)\s+when called from\s+(.+?)\s*:$"
CHECK_RESULT = r"^([\w./-]+\.\w+):\s*line\s+([0-9]+):\s*(.+?)\s+\.\.\.\s*(PASS|FAIL)$"
SECTION_TYPES = {
    "The following properties are to be checked:": "property",
    "The following program assertions are treated as guarantees:": "guarantee",
}
ISOLATE_STATUS = r"^\s*isolate\s+([\w.]+)\s*:\s*(PASS|FAIL|OK)\s*$"


def _strip(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\u000b\f\r"))


def parse_diagnostics_log(log: DataFrame) -> DataFrame:
    """Diagnostics in five line formats, first format that fits; repeats in a log are dropped."""
    t = F.col("text")

    def row(pattern: str, source: str, stripped: bool) -> Column:
        clean = _strip if stripped else (lambda c: c)
        severity = F.regexp_extract(t, pattern, 3)
        return F.struct(
            clean(F.regexp_extract(t, pattern, 1)).alias("file"),
            F.regexp_extract(t, pattern, 2).try_cast("long").alias("line"),
            F.when(severity.isin("", "fatal error"), "error").otherwise(severity).alias("severity"),
            clean(F.regexp_extract(t, pattern, 4)).alias("message"),
            F.lit(source).alias("source"),
        )

    trimmed = _strip(t)
    exception = F.struct(
        F.lit("").alias("file"),
        F.lit(0).cast("long").alias("line"),
        F.lit("error").alias("severity"),
        F.concat_ws(
            ": ",
            F.regexp_extract(trimmed, EXCEPTION_LINE, 1),
            F.regexp_extract(trimmed, EXCEPTION_LINE, 2),
        ).alias("message"),
        F.lit("exception").alias("source"),
    )
    has = lambda *words: reduce(or_, [F.contains(t, F.lit(word)) for word in words])
    # a plain word that a format needs is asked before its pattern
    diag = (
        F.when(has("Error:") & t.rlike(RUNTIME_ERROR), row(RUNTIME_ERROR, "runtime_error", True))
        .when(has("error:", "warning:") & t.rlike(COMPILER_LINE), row(COMPILER_LINE, "compiler", False))
        .when(has("error:", "warning:") & t.rlike(VERBOSE_LINE), row(VERBOSE_LINE, "checker", True))
        .when(has("error:", "warning:") & t.rlike(PLAIN_LINE), row(PLAIN_LINE, "checker", False))
        .when(trimmed.rlike(EXCEPTION_LINE), exception)
    )
    some = log.filter(has("rror", "arning", "Exception", "Exit"))
    # exploded, as a filter on the row itself would compute it a second time
    rows = T.exploded(some, ["log_id", "line_no"], F.array(diag), "d").filter("d IS NOT NULL").select("log_id", "line_no", "d.*")
    return pick_first(rows, ["log_id", "file", "line", "message"], ["line_no"])


def parse_check_results(log: DataFrame) -> DataFrame:
    """PASS / FAIL lines under their isolate, section type and action.

    An isolate header resets section and action, a section header resets the action, an unknown
    ``The following`` line ends the tracked section.
    """
    kinds = F.create_map(*[F.lit(x) for kv in SECTION_TYPES.items() for x in kv])
    none = F.struct(F.lit(None).cast("string").alias("v"))

    def kind(t: Column) -> Column:
        # the plain start of a pattern is asked first, so that most lines meet one pattern only
        return (
            F.when(F.startswith(t, F.lit("The following")), "section")
            .when(F.startswith(t, F.lit("Isolate")) & t.rlike(ISOLATE_HEADER), "isolate")
            .when(F.startswith(t, F.lit("in action")) & t.rlike(ACTION_CONTEXT), "action")
            .when(F.contains(t, F.lit("...")) & t.rlike(CHECK_RESULT), "check")
        )

    def parsed(k: Column, t: Column) -> Column:
        of = lambda pattern, n: F.regexp_extract(t, pattern, n)
        check = F.struct(
            of(CHECK_RESULT, 1).alias("file"), of(CHECK_RESULT, 2).try_cast("long").alias("line"), of(CHECK_RESULT, 4).alias("result")
        )
        action = F.concat(of(ACTION_CONTEXT, 1), F.lit(" when called from "), of(ACTION_CONTEXT, 2))
        row = F.struct(
            F.when(k == "check", check).alias("check"),
            F.when(k == "isolate", of(ISOLATE_HEADER, 1)).alias("i"),
            F.when(k == "isolate", none).when(k == "section", F.struct(kinds[t].alias("v"))).alias("s"),
            F.when(k.isin("isolate", "section"), none).when(k == "action", F.struct(action.alias("v"))).alias("a"),
        )
        return F.when(k.isNotNull(), row)

    # only context and result lines are shuffled; a line is parsed once
    some = reduce(or_, [F.contains("text", F.lit(word)) for word in ("Isolate", "The following", "in action", "...")])
    row = T.let(_strip(F.col("text")), lambda t: T.let(kind(t), lambda k: parsed(k, t)))
    rows = T.exploded(log.filter(some), ["log_id", "line_no"], F.array(row), "r").filter("r IS NOT NULL").select("log_id", "line_no", "r.*")
    filled = fill_forward(
        rows, ["log_id"], ["line_no"], {"isolate": F.col("i"), "section": F.col("s"), "act": F.col("a")}
    )
    return filled.filter("isolate IS NOT NULL AND section.v IS NOT NULL AND check IS NOT NULL").select(
        "log_id",
        "line_no",
        "isolate",
        F.col("section.v").alias("check_type"),
        F.col("act.v").alias("action"),
        "check.file",
        "check.line",
        "check.result",
    )


def _or_null(c: Column) -> Column:
    return F.when(c != "", c)


def parse_counterexamples(log: DataFrame) -> DataFrame:
    """Steps of the counterexample of each log, with the failed assertion above it.

    One row per step: number, action and a map of assignments (the last value of a name counts). A log
    whose counterexample has no steps gives one row with a null step.
    """
    t = F.col("text")
    marks = fill_forward(
        log.select("log_id", "line_no", "text"),
        ["log_id"],
        ["line_no"],
        {
            "cex": F.when(F.contains(t, F.lit("Counterexample:")), F.lit(1)),
            "step": F.when(
                t.rlike(r"^\s*Step\s+[0-9]+\s*:"),
                F.struct(
                    F.col("line_no").alias("at"),
                    F.regexp_extract(t, r"^\s*Step\s+([0-9]+)\s*:", 1).try_cast("long").alias("number"),
                ),
            ),
            "head": F.when(
                t.rlike(r"The following assertion at line [0-9]+ is not always true:"),
                F.struct(
                    F.regexp_extract(t, r"assertion at line ([0-9]+) is", 1).try_cast("long").alias("line"),
                    F.col("line_no").alias("at"),
                ),
            ),
        },
    )
    body = r"^\s+((?:assert|require|ensure|assume)\s+.+)$"
    assign = r"^\s{2,}(\w[\w.]*)\s*=\s*(.+)$"
    above = F.col("cex").isNull()
    first = lambda value, when: F.min_by(value, F.when(when, F.col("line_no")))
    logs = (
        marks.groupBy("log_id")
        .agg(
            F.max("cex").alias("cex"),
            first(F.col("head.line"), above & (F.col("head.at") == F.col("line_no"))).alias("assertion_line"),
            first(
                _strip(F.regexp_extract(t, body, 1)), above & (F.col("head.at") < F.col("line_no")) & t.rlike(body)
            ).alias("assertion"),
        )
        .filter("cex = 1")
        .drop("cex")
    )
    action = _or_null(_strip(F.regexp_extract(t, r"^\s*Action:\s*(.+)$", 1)))
    # first per step and name, so that the last value of a name is chosen by an aggregate
    names = (
        marks.filter("cex = 1 AND step IS NOT NULL")
        .select(
            "log_id", "line_no", F.col("step.at").alias("at"), F.col("step.number").alias("step_number"),
            action.alias("action"),
            F.when(~F.contains(t, F.lit("Action:")), _or_null(F.regexp_extract(t, assign, 1))).alias("name"),
            _strip(F.regexp_extract(t, assign, 2)).alias("value"),
        )
        .groupBy("log_id", "at", "step_number", "name")
        .agg(
            F.max_by("value", "line_no").alias("value"),
            F.min(F.when(F.col("action").isNotNull(), F.struct("line_no", "action"))).alias("action"),
        )
    )
    steps = names.groupBy("log_id", "at", "step_number").agg(
        F.min("action").getField("action").alias("action"),
        F.map_from_entries(
            F.array_sort(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("name", "value"))))
        ).alias("assignments"),
    )
    return logs.join(steps, "log_id", "left").select(
        "log_id", "assertion_line", "assertion", "step_number", "action",
        F.coalesce("assignments", F.create_map().cast("map<string,string>")).alias("assignments"),
    )


def parse_isolate_status(log: DataFrame) -> DataFrame:
    """``isolate NAME : PASS|FAIL|OK`` lines; OK counts as a pass."""
    t = F.col("text")
    status = F.regexp_extract(t, ISOLATE_STATUS, 2)
    return log.filter(t.rlike(ISOLATE_STATUS)).select(
        "log_id",
        "line_no",
        F.regexp_extract(t, ISOLATE_STATUS, 1).alias("isolate"),
        status.alias("status"),
        status.isin("PASS", "OK").alias("passed"),
    )


def check_summary(checks: DataFrame) -> DataFrame:
    """Passed and failed checks in total, per isolate, and per isolate and type (null = all)."""
    return checks.rollup("isolate", "check_type").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("result") == "PASS").alias("passed"),
        F.count_if(F.col("result") == "FAIL").alias("failed"),
        F.grouping_id().alias("grouping"),
    )


def failed_checks(checks: DataFrame) -> DataFrame:
    """Failures per isolate and action."""
    return checks.filter("result = 'FAIL'").groupBy("isolate", "action").agg(
        F.count("*").alias("failed"), F.min("file").alias("first_file")
    )


def check_headline(checks: DataFrame) -> DataFrame:
    """One line per log: how many checks failed, of which types and where."""
    bad = F.count_if(F.col("result") == "FAIL")
    both = checks.groupBy("log_id", "check_type", "isolate").agg(F.count("*").alias("n"), bad.alias("bad"))
    # types and isolates of a log are counted in one pass, side by side
    sides = F.array(*[F.struct(F.lit(w).alias("what"), F.col(w).alias("name")) for w in ("check_type", "isolate")])
    parts = both.select("log_id", "n", "bad", F.inline(sides)).groupBy("log_id", "what", "name").agg(
        F.sum("n").alias("n"), F.sum("bad").alias("bad")
    )
    of = lambda what, c: F.when(F.col("what") == what, F.col(c))
    types = parts.groupBy("log_id").agg(
        F.sum(of("check_type", "n")).alias("total"),
        F.sum(of("check_type", "bad")).alias("failed"),
        F.count_if(of("check_type", "bad") > 0).alias("bad_types"),
        F.max_by("name", of("check_type", "bad")).alias("worst_type"),
        F.count_if(of("isolate", "bad") > 0).alias("bad_isolates"),
        F.max_by("name", of("isolate", "bad")).alias("worst_isolate"),
    )
    text = F.when(F.col("failed") == 0, F.concat(F.lit("all "), F.col("total"), F.lit(" checks passed"))).otherwise(
        F.concat(
            F.col("failed"), F.lit("/"), F.col("total"), F.lit(" checks failed in "),
            F.col("bad_isolates"), F.lit(" isolates, most in "), F.col("worst_isolate"),
        )
    )
    return types.select(
        "log_id", "total", "failed", "bad_types", "worst_type", "bad_isolates", "worst_isolate", text.alias("summary")
    )
