"""Column functions over source text.

Line numbers without a shuffle: ``numbered`` puts the 0-based number of every line in front of it, between
two ``\\u0001`` marks. A regex over the numbered text then returns matches that carry their own line, also
when a declaration spans lines, so that extraction jobs stay map-only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "\u0001"
#: Line mark in a pattern over numbered text.
LINE = "\u0001[0-9]++\u0001"
#: Start of a line, with indent.
BOL = LINE + "[ \\t]*+"
#: Any white space, line breaks included.
WS = f"(?:\\s++|{LINE})*+"
#: White space that must be there.
WS1 = f"(?:\\s|{LINE}){WS}"


def numbered(content: Column) -> Column:
    lines = F.split(F.translate(content, MARK, ""), "\n", -1)
    mark = F.lit(MARK)
    return F.array_join(
        F.transform(lines, lambda text, i: F.concat(mark, i.cast("string"), mark, text)), "\n"
    )


def unnumbered(text: Column) -> Column:
    return F.regexp_replace(text, LINE, "")


def hits(numbered_text: Column, pattern: str) -> Column:
    """All matches of ``pattern`` in numbered text, in order."""
    return F.regexp_extract_all(numbered_text, F.lit(pattern), F.lit(0))


def first_line(hit: Column) -> Column:
    """Line on which a match starts (the match begins with a line mark)."""
    return F.regexp_extract(hit, "\u0001([0-9]+)\u0001", 1).cast("int")


def last_line(hit: Column) -> Column:
    """Last line mark inside a match, null when there is none."""
    found = F.regexp_extract(hit, "(?s).*\u0001([0-9]+)\u0001", 1)
    return F.when(found != "", found.cast("int"))


def group(hit: Column, pattern: str, n: int = 1) -> Column:
    """Capture group of a pattern with the line marks taken out; empty when it did not take part."""
    return unnumbered(F.regexp_extract(hit, pattern, n))


def exploded(df: DataFrame, keep: list, array: Column, item: str, pos: str | None = None) -> DataFrame:
    """One row per element of a computed array, with its position if asked.

    A plain ``explode`` lets Spark add a filter on the size of the array, which computes it twice (and puts
    it into lambdas that look back at it). The outer form is computed once; empty arrays go afterwards.
    """
    at = pos or "_pos"
    out = df.select(*keep, F.posexplode_outer(array).alias(at, item)).filter(F.col(at).isNotNull())
    return out if pos else out.drop(at)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also when the body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), 0)


def running_offsets(lengths: Column, block: int = 64) -> Column:
    """Start offset of each element: the sum of the lengths before it.

    A plain fold copies its result at every step; folding blocks first keeps long rows cheap.
    """
    zero = F.lit(0)
    empty = F.array().cast("array<int>")

    def starts(part: Column) -> Column:
        state = F.struct(zero.alias("at"), empty.alias("out"))
        return F.aggregate(
            part,
            state,
            lambda st, x: F.struct((st["at"] + x).alias("at"), F.array_append(st["out"], st["at"]).alias("out")),
            lambda st: st["out"],
        )

    def blocked(all_: Column) -> Column:
        last = F.floor((F.size(all_) - 1) / F.lit(block)).cast("int")
        return F.transform(
            F.sequence(zero, last), lambda b: F.slice(all_, b * F.lit(block) + 1, F.lit(block))
        )

    def placed(parts: Column) -> Column:
        sums = F.transform(parts, lambda p: F.aggregate(p, zero, lambda a, x: a + x))
        return F.flatten(
            F.zip_with(
                F.transform(parts, starts), starts(sums), lambda inner, at: F.transform(inner, lambda x: x + at)
            )
        )

    return let(
        lengths,
        lambda all_: F.when(F.size(all_) <= 0, empty)
        .when(F.size(all_) <= block, starts(all_))
        .otherwise(let(blocked(all_), placed)),
    )


def or_null(text: Column) -> Column:
    return F.when(text != "", text)


def trimmed_list(raw: Column, sep: str = ",") -> Column:
    """Split, trim, drop empties."""
    parts = F.transform(F.split(raw, sep), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
    return F.filter(parts, lambda p: p != "")


def typed_fields(raw: Column) -> Column:
    """``a : t, b : u`` -> array of (name, type); parts without a colon are dropped."""
    parts = F.filter(F.split(raw, ","), lambda p: F.contains(p, F.lit(":")))
    return F.transform(
        parts,
        lambda p: F.struct(
            F.regexp_replace(F.substring_index(p, ":", 1), r"^\s+|\s+$", "").alias("name"),
            F.regexp_replace(F.regexp_replace(p, r"^[^:]*:", ""), r"^\s+|\s+$", "").alias("type"),
        ),
    )


def last_component(name: Column) -> Column:
    """Text after the last dot."""
    return F.substring_index(name, ".", -1)


def module_of(name: Column) -> Column:
    """Text before the last dot; the name itself when it has none."""
    return F.when(F.contains(name, F.lit(".")), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem_of(path: Column) -> Column:
    """File name without its last suffix."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def dir_of(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit(""))


# ---- requirement tags --------------------------------------------------------------------------
# The written form of a tag list and of one tag.
TAG = r"^\w+(?:[.:]\w+)*$"
TAG_LIST_ON_CODE = r"#\s*\[([\w:.,\s]+)\]\s*$"
TAG_LIST_ON_COMMENT = r"\[([\w:.,\s]+)\]\s*$"
BARE_INTEGER = r"^\d+$"


def parse_tags(line: Column) -> Column:
    """Tags in the trailing ``[a, b]`` of one line.

    On a comment line the list may end any text, unless a second ``#`` stands before it (that is code
    commented out); on a code line it must follow its own ``#``.
    """
    text = F.trim(F.regexp_replace(line, r"\s", " "))
    is_comment = F.startswith(text, F.lit("#"))
    before = F.regexp_replace(text, TAG_LIST_ON_COMMENT, "")
    on_comment = F.when(
        ~F.contains(F.substring(before, 2, 1 << 30), F.lit("#")),
        F.regexp_extract(text, TAG_LIST_ON_COMMENT, 1),
    ).otherwise("")
    raw = F.when(is_comment, on_comment).otherwise(F.regexp_extract(text, TAG_LIST_ON_CODE, 1))
    return F.filter(
        F.transform(F.split(raw, ","), lambda t: F.trim(t)), lambda t: t.rlike(TAG)
    )


def is_annotation(tags: Column) -> Column:
    """A line counts as an annotation when at least one tag is not a bare integer."""
    return F.exists(tags, lambda t: ~t.rlike(BARE_INTEGER))
