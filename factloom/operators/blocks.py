"""Lines, brace-matched blocks, and the statements inside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text as T

# Block openers and statement keywords of the specification language.
MONITOR_WORDS = "before|after|around|implement"
STATEMENT_WORDS = "require|ensure|assume|assert"

_MONITOR = rf"\b(?:{MONITOR_WORDS})\s{T.WS}[\w.]+{T.WS}(?:\([^)]*\){T.WS})?\{{"
_ACTION = (
    rf"\baction\s{T.WS}[\w.]+{T.WS}(?:\([^)]*\){T.WS})?(?:returns{T.WS}\([^)]*\){T.WS})?={T.WS}\{{"
)
_NATIVE = r'<<<(?:[^">]++|"(?:[^"\\]++|\\[\s\S])*+"|>(?!>>))*+(?:>>>|\z)'
_COMMENT = r"#[^\n]*+"
_START = rf"(?:{T.LINE}|(?<=\{{))[ \t]*"
_STATEMENT = (
    rf"{_START}(?:{STATEMENT_WORDS})[ \t]+[^\n]+?;[ \t]*(?:#[ \t]*\[[\w:.,\s]+\])?[ \t]*(?=\n|\}}|\z)"
)
_ASSIGN = rf"{_START}[\w.]+(?:\([^)\n]*\))?[ \t]*:="
_GUARD = r"_generating"
# only lines that hold a brace or may open a block need to be known by number
_MARK = rf"{T.LINE}(?=[^\n]*(?:[{{}}]|\b(?:{MONITOR_WORDS}|action)\b))"
_TOKENS = "|".join(
    f"(?:{p})" for p in (_NATIVE, _STATEMENT, _ASSIGN, _COMMENT, _MONITOR, _ACTION, _GUARD, _MARK, r"[{}]")
)


def explode_lines(files: DataFrame, before: int = 0, after: int = 0) -> DataFrame:
    """``(…, line_no, text)``: lines of every file, split on ``\\n`` only, numbered from 0.

    ``before`` and ``after`` add the neighbouring lines as ``prev1…`` and ``next1…``. They are read from
    the array inside the row, so that no window is needed to look around a line.
    """
    lines = F.col("_lines")
    keep = [c for c in files.columns if c != "content"]
    if not (before or after):
        return T.exploded(files, keep, F.split("content", "\n", -1), "text", "line_no")
    wide = files.withColumn("_lines", F.split("content", "\n", -1))
    rows = F.transform(
        lines,
        lambda t, i: F.struct(
            i.alias("line_no"),
            t.alias("text"),
            *[F.when(i >= n, F.get(lines, i - n)).alias(f"prev{n}") for n in range(1, before + 1)],
            *[F.get(lines, i + n).alias(f"next{n}") for n in range(1, after + 1)],
        ),
    )
    return T.exploded(wide, keep, rows, "_r").select(*keep, "_r.*")


def block_tokens(files: DataFrame) -> DataFrame:
    """Openers, braces and statements of every file with depth, line and enclosing block.

    One shuffle by path carries the tokens; the four scans that follow need only re-sort them. A path
    never holds more tokens than its one text row, so the group is bounded by the size of a row.
    """
    toks = T.exploded(files, ["path"], T.hits(T.numbered(F.col("content")), _TOKENS), "tok", "pos")
    t = F.col("tok")
    bare = F.regexp_replace(t, rf"^{T.LINE}", "")
    kind = (
        F.when(t == "{", "open")
        .when(t == "}", "close")
        .when(F.startswith(t, F.lit("<<<")) | F.startswith(t, F.lit("#")), "skip")
        .when(t.rlike(rf"^{T.LINE}$"), "mark")
        .when(bare.rlike(rf"^[ \t]*(?:{STATEMENT_WORDS})[ \t]+[^\n]+;"), "statement")
        .when(t.rlike(r":=$"), "assign")
        .when(t.rlike(r"(?s)\{$"), "header")
        .otherwise("guard")
    )
    opens = F.length(F.regexp_replace(t, r"[^{]", ""))
    closes = F.length(F.regexp_replace(t, r"[^}]", ""))
    toks = (
        toks.withColumn("kind", kind)
        .filter("kind <> 'skip' OR tok LIKE '<<<%'")
        .withColumn("mark", T.last_line(t))
        .withColumn(
            "delta",
            F.when(F.col("kind").isin("skip", "mark", "guard"), 0)
            .when(F.col("kind") == "header", 1)
            .otherwise(opens - closes),
        )
    )
    by_pos = Window.partitionBy("path").orderBy("pos")
    past = by_pos.rowsBetween(Window.unboundedPreceding, -1)
    upto = by_pos.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own_line = T.first_line(t)
    toks = (
        toks.withColumn("depth_after", F.sum("delta").over(upto))
        .withColumn("line_before", F.last("mark", True).over(past))
        .withColumn("guards", F.sum((F.col("kind").isin("guard", "statement") & t.rlike("_generating")).cast("int")).over(upto))
        .withColumn("after_header", F.coalesce(F.lag("kind").over(by_pos) == "header", F.lit(False)))
        .filter("kind NOT IN ('mark', 'skip')")
        .withColumn("starts_line", t.rlike(rf"^{T.LINE}"))
        .withColumn("line", F.when(F.col("starts_line"), own_line).otherwise(F.col("line_before")))
        .withColumn("depth_before", F.col("depth_after") - F.col("delta"))
        .filter("kind NOT IN ('statement', 'assign') OR starts_line OR after_header")
    )
    # a closing brace matches the nearest opener of the same level: neighbours within (path, level)
    level = F.when(F.col("kind") == "close", F.col("depth_after")).otherwise(F.col("depth_before"))
    brace = F.col("kind").isin("open", "close", "header")
    toks = toks.withColumn("level", F.when(brace, level).otherwise(F.lit(-(1 << 30)))).withColumn(
        "brace", brace
    )
    by_level = Window.partitionBy("path", "level").orderBy("pos")
    nxt = F.lead(F.struct("kind", "pos", "line", "guards")).over(by_level)
    toks = (
        toks.withColumn("_next", F.when(F.col("brace"), nxt))
        .withColumn("_prev", F.when(F.col("brace"), F.lag("kind").over(by_level)))
        .withColumn("is_block", (F.col("kind") == "header") & F.coalesce(F.col("_next.kind") == "close", F.lit(False)))
        .withColumn("ends_block", (F.col("kind") == "close") & F.coalesce(F.col("_prev") == "header", F.lit(False)))
        .withColumn(
            "block_delta", F.when(F.col("is_block"), 1).when(F.col("ends_block"), -1).otherwise(0)
        )
        .withColumn("nesting", F.sum("block_delta").over(upto))
    )
    # the enclosing block is the last one opened at the nesting just below
    name = T.group(t, rf"^(?:\w+){T.WS}([\w.]+)", 1)
    mixin = F.regexp_extract(t, rf"^({MONITOR_WORDS}|action)\b", 1)
    block = F.when(
        F.col("is_block"),
        F.struct(
            F.when(mixin == "action", "direct").otherwise(mixin).alias("mixin_kind"),
            name.alias("monitor_action"),
            F.col("line").alias("start_line"),
            F.col("_next.line").alias("end_line"),
            F.col("pos").alias("start_pos"),
            F.col("_next.pos").alias("end_pos"),
            F.col("level").alias("block_level"),
            (F.col("_next.guards") > F.col("guards")).alias("has_generating_guard"),
        ),
    )
    toks = toks.withColumn("slot", F.col("nesting") - 1).withColumn("block", block)
    inside = (
        Window.partitionBy("path", "slot").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    )
    return toks.withColumn(
        "enclosing", F.when(F.col("slot") >= 0, F.last("block", True).over(inside))
    ).select(
        "path", "pos", "kind", "tok", "line", "depth_before", "starts_line", "is_block", "block", "enclosing"
    )


def extract_blocks(files: DataFrame) -> DataFrame:
    """Monitor blocks and action bodies with their closing brace; unclosed ones are left out.

    Braces in comments and in quoted native code do not count. ``mixin_kind`` is the monitor word, or
    ``direct`` for an action body.
    """
    return (
        block_tokens(files)
        .filter("is_block")
        .select(
            "path",
            "block.mixin_kind",
            "block.monitor_action",
            "block.start_line",
            "block.end_line",
            "block.has_generating_guard",
        )
    )


def _inside(tokens: DataFrame, kind: str) -> DataFrame:
    t = tokens.filter((F.col("kind") == kind) & F.col("enclosing").isNotNull())
    # an inline statement belongs to the block whose brace it follows
    return t.filter("starts_line OR depth_before = enclosing.block_level + 1")


def extract_requirements(files: DataFrame) -> DataFrame:
    """Guarded statements inside blocks: one row per ``path:line``, the last one on a line wins."""
    pattern = rf"^(?:{T.LINE})?[ \t]*({STATEMENT_WORDS})[ \t]+([^\n]+?);[ \t]*(?:#[ \t]*\[([\w:.,\s]+)\])?[ \t]*$"
    t = F.col("tok")
    rows = _inside(block_tokens(files), "statement").select(
        "path",
        "line",
        "pos",
        F.concat_ws(":", "path", F.col("line").cast("string")).alias("id"),
        F.regexp_extract(t, pattern, 1).alias("kind"),
        F.trim(F.regexp_extract(t, pattern, 2)).alias("formula_text"),
        "enclosing.monitor_action",
        "enclosing.mixin_kind",
        F.filter(T.trimmed_list(F.regexp_extract(t, pattern, 3)), lambda x: x.rlike(T.TAG)).alias("tags"),
    )
    best = rows.groupBy("path", "line").agg(
        F.max_by(F.struct("id", "kind", "formula_text", "monitor_action", "mixin_kind", "tags"), "pos").alias("r")
    )
    return best.select(
        "r.id", "path", "line", "r.kind", "r.formula_text", "r.monitor_action", "r.mixin_kind", "r.tags"
    )


def extract_writes(files: DataFrame) -> DataFrame:
    """Assignments inside blocks: the name before ``:=`` without its argument list."""
    return _inside(block_tokens(files), "assign").select(
        "path",
        "line",
        F.regexp_extract("tok", rf"^(?:{T.LINE})?[ \t]*([\w.]+)", 1).alias("var_name"),
        "enclosing.monitor_action",
        "enclosing.mixin_kind",
    )
