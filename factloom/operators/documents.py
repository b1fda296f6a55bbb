"""Numbered documents: sections, normative sentences, cross references, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import exploded, running_offsets
from factloom.plans.prefixes import dotted_prefixes

# Requirement keywords, strongest first.
KEYWORDS = [
    "MUST NOT",
    "SHALL NOT",
    "SHOULD NOT",
    "MUST",
    "SHALL",
    "REQUIRED",
    "SHOULD",
    "RECOMMENDED",
    "MAY",
    "OPTIONAL",
]
# Keywords that mean the same level.
LEVEL_SYNONYMS = {
    "SHALL": "MUST",
    "SHALL NOT": "MUST NOT",
    "REQUIRED": "MUST",
    "RECOMMENDED": "SHOULD",
    "OPTIONAL": "MAY",
}
# Written forms in numbered documents.
SECTION_HEADER = r"^([0-9]+(?:\.[0-9]+)*)\.\s{2,}(\S.*)$"
SECTION_REF = r"(?:see\s+)?Section\s+([0-9]+(?:\.[0-9]+)*)"
DOC_SECTION_REF = r"\[RFC\s*([0-9]+)\]\s*,?\s*Section\s+([0-9]+(?:\.[0-9]+)*)"
DOC_REF = r"\[RFC\s*[0-9]+\]|RFC\s+[0-9]+"
CONTEXT_CHARS = 40


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _normal_level(level: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LEVEL_SYNONYMS.items() for x in kv])
    return F.coalesce(table[level], level)


def parse_sections(docs: DataFrame) -> DataFrame:
    """Numbered sections of ``docs(doc, text)``: number, title, first line and text.

    A header stands after a blank line, has a real title, and its number may not run backwards against
    the header accepted before it. All of it happens on the array of lines inside the row; the fold
    sees only the header candidates.
    """
    lines = F.split("text", "\n", -1)
    found = F.filter(
        F.transform(
            F.col("_lines"),
            lambda t, i: F.struct(
                i.alias("line"),
                _strip(t).alias("head"),
                F.when(i > 0, F.regexp_like(F.get(F.col("_lines"), i - 1), F.lit(r"\S"))).alias("busy"),
            ),
        ),
        lambda c: c["head"].rlike(SECTION_HEADER) & ~F.coalesce(c["busy"], F.lit(False)),
    )
    parsed = F.transform(
        found,
        lambda c: F.struct(
            c["line"].alias("line"),
            F.regexp_extract(c["head"], SECTION_HEADER, 1).alias("number"),
            _strip(F.regexp_extract(c["head"], SECTION_HEADER, 2)).alias("title"),
            F.transform(
                F.split(F.regexp_extract(c["head"], SECTION_HEADER, 1), r"\."),
                lambda p: p.try_cast("decimal(38,0)"),
            ).alias("parts"),
        ),
    )
    titled = F.filter(
        parsed,
        lambda c: (F.length(c["title"]) >= 2) & ~c["title"].rlike(r"^(?:[0-9]+$|Figure|Table)"),
    )

    def accept(state: Column, c: Column) -> Column:
        prev, cur = state["prev"], c["parts"]
        forward = (
            (F.size(prev) == 0)
            | (F.size(cur) < F.size(prev))
            | ((F.size(cur) == F.size(prev)) & (cur > prev))
            | ((F.size(cur) > F.size(prev)) & (F.slice(cur, F.lit(1), F.size(prev)) >= prev))
        )
        return F.struct(
            F.when(forward, cur).otherwise(prev).alias("prev"),
            F.when(forward, F.array_append(state["lines"], c["line"])).otherwise(state["lines"]).alias("lines"),
        )

    start = F.struct(
        F.array().cast("array<decimal(38,0)>").alias("prev"), F.array().cast("array<int>").alias("lines")
    )
    kept = F.aggregate("_titled", start, accept, lambda s: s["lines"])
    sections = (
        docs.select("doc", lines.alias("_lines"))
        .withColumn("_titled", titled)
        .withColumn("_kept", kept)
        .withColumn("_heads", F.filter("_titled", lambda c: F.array_contains(F.col("_kept"), c["line"])))
    )
    sections = exploded(sections, ["doc", "_lines", "_kept"], F.col("_heads"), "h", "ordinal")
    end = F.coalesce(F.get("_kept", F.col("ordinal") + 1), F.size("_lines"))
    body = F.slice("_lines", F.col("h.line") + 2, end - F.col("h.line") - 1)
    return sections.select(
        "doc",
        "ordinal",
        "h.number",
        "h.title",
        F.col("h.line").alias("start_line"),
        _strip(F.array_join(body, "\n")).alias("text"),
    )


def get_section_text(sections: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted(doc, number)``: text of the exact and deeper sections, blank line between, in order."""
    names = sections.withColumn("wanted", F.explode(dotted_prefixes(F.col("number"))))
    asked = wanted.select("doc", F.col("number").alias("wanted")).distinct()
    found = names.join(asked, ["doc", "wanted"])
    return found.groupBy("doc", F.col("wanted").alias("number")).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("start_line", "text"))), lambda s: s["text"]
            ),
            "\n\n",
        ).alias("text"),
        F.count("*").alias("sections"),
    )


def _joined(text: Column) -> Column:
    return _strip(F.regexp_replace(text, r"\n\s+", " "))


def extract_normative(sections: DataFrame) -> DataFrame:
    """Sentences with a requirement keyword, their strongest keyword, once per section."""
    parts = F.split(_joined(F.col("text")), r"\.(?:\s+(?=[A-Z])|\s*$)", -1)
    sentences = F.transform(
        F.filter(parts, lambda p: p.rlike(r"\S")),
        lambda p: F.regexp_replace(F.concat(_strip(p), F.lit(".")), r"\s+", " "),
    )
    any_word = r"\b(?:" + "|".join(KEYWORDS) + r")\b"
    kept = F.array_distinct(F.filter(sentences, lambda s: s.rlike(any_word)))
    strongest = F.get(
        F.filter(
            F.array(*[F.lit(k) for k in KEYWORDS]),
            lambda k: F.regexp_like("sentence", F.concat(F.lit(r"\b"), k, F.lit(r"\b"))),
        ),
        0,
    )
    rows = exploded(
        sections.filter(F.col("text") != ""), ["doc", F.col("number").alias("section")], kept, "sentence"
    )
    return rows.select("doc", "section", strongest.alias("keyword"), F.col("sentence").alias("text"))


def _with_context(joined: Column, pattern: str) -> Column:
    """Matches of a pattern with up to 40 characters on both sides; contexts may overlap."""
    n = CONTEXT_CHARS
    full = rf"(?is)(?={pattern})(?<=(.{{{n}}}|\A.{{0,{n - 1}}}))((?:{pattern}))(?=(.{{0,{n}}}))"
    inner = pattern.count("(") - pattern.count("(?") - pattern.count(r"\(")
    left, hit, right = (
        F.regexp_extract_all(joined, F.lit(full), F.lit(g)) for g in (inner + 1, inner + 2, 2 * inner + 3)
    )
    return F.arrays_zip(left.alias("left"), hit.alias("hit"), right.alias("right"))


def extract_cross_refs(sections: DataFrame) -> DataFrame:
    """References to other sections and documents, one row per section and target.

    Order of precedence: ``[RFCn] Section s``; then ``Section s`` of the same document, unless the first
    form stands right before it; then a bare document that no reference of the section has named.
    """
    base = sections.filter(F.col("text") != "").select(
        "doc", F.col("number").alias("source_section"), _joined(F.col("text")).alias("joined")
    )
    none = F.lit(None).cast("string")

    def rows(rank: int, pattern: str, target_doc, target_section) -> Column:
        zipped = _with_context(F.col("joined"), pattern)
        return F.transform(
            zipped,
            lambda z, i: F.struct(
                F.lit(rank).alias("rank"),
                i.alias("ordinal"),
                z["left"].alias("left"),
                target_doc(z["hit"]).alias("target_doc"),
                target_section(z["hit"]).alias("target_section"),
                _strip(F.concat(z["left"], z["hit"], z["right"])).alias("context"),
            ),
        )

    number = lambda h: F.concat(F.lit("rfc"), F.regexp_extract(h, r"(?i)RFC\s*([0-9]+)", 1))
    section = lambda h: F.regexp_extract(h, r"([0-9]+(?:\.[0-9]+)*)$", 1)
    found = F.concat(
        rows(1, DOC_SECTION_REF, number, section),
        rows(2, SECTION_REF, lambda h: none, section),
        rows(3, DOC_REF, number, lambda h: none),
    )
    refs = exploded(base, ["doc", "source_section"], found, "r").select(
        "doc", "source_section", "r.*"
    )
    taken = (F.col("rank") == 2) & F.right("left", F.lit(15)).rlike(r"(?i)\[RFC\s*[0-9]+\]\s*,?\s*$")
    one = (
        refs.filter(~taken)
        .groupBy("doc", "source_section", "target_doc", "target_section")
        .agg(
            F.min("rank").alias("rank"),
            F.min_by("context", F.struct("rank", "ordinal")).alias("context"),
        )
    )
    named = one.filter("rank = 1").select("doc", "source_section", "target_doc").distinct()
    bare = one.filter("rank = 3").join(named, ["doc", "source_section", "target_doc"], "left_anti")
    return one.filter("rank < 3").unionByName(bare).select(
        "doc", "source_section", "target_doc", "target_section", "context", "rank"
    )


def _requirement_sentences(text: Column) -> Column:
    """Array of (text, level, offset): the sentences of a document that hold a keyword and end in a dot."""
    pieces = F.split(text, r"\.", -1)
    whole = F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))
    found = "MUST NOT|MUST|SHALL NOT|SHALL|SHOULD NOT|SHOULD|MAY|REQUIRED|RECOMMENDED|OPTIONAL"
    word = rf"(?s)^.*?\b({found})\b"
    placed = F.zip_with(
        whole,
        running_offsets(F.transform(whole, lambda p: F.length(p) + 1)),
        lambda p, at: F.struct(
            F.concat(_strip(p), F.lit(".")).alias("text"),
            F.regexp_extract(p, word, 1).alias("word"),
            at.alias("offset"),
        ),
    )
    return F.transform(
        F.filter(placed, lambda r: r["word"] != ""),
        lambda r: F.struct(r["text"].alias("text"), _normal_level(r["word"]).alias("level"), r["offset"].alias("offset")),
    )


def extract_requirement_sentences(docs: DataFrame) -> DataFrame:
    """Requirement sentences of ``docs(doc, text)`` with normalised level and character offset."""
    return exploded(docs, ["doc"], _requirement_sentences(F.col("text")), "r", "ordinal").select(
        "doc", "ordinal", "r.text", "r.level", "r.offset"
    )


def generate_manifest(docs: DataFrame, base_section: str = "") -> DataFrame:
    """Manifest rows ``doc:base.n`` from the requirement sentences, numbered in document order."""
    n = (F.col("ordinal") + 1).cast("string")
    section = F.concat(F.lit(base_section + "."), n) if base_section else n
    name = F.regexp_replace(F.lower(F.col("doc")), " ", "")
    return extract_requirement_sentences(docs).select(
        F.concat_ws(":", name, section).alias("req_id"),
        F.col("doc").alias("rfc"),
        section.alias("section"),
        "text",
        "level",
        F.lit("").alias("layer"),
        F.lit(True).alias("testable"),
    )


def tag_sections(tags: DataFrame, sections: DataFrame) -> DataFrame:
    """``tags(tag)`` of the form ``doc:number`` with the section of exactly that number."""
    split = tags.filter(F.col("tag").rlike(r"^\w+:[0-9]+(?:\.[0-9]+)*$")).select(
        "tag",
        F.substring_index("tag", ":", 1).alias("doc"),
        F.substring_index("tag", ":", -1).alias("number"),
    )
    return split.distinct().join(sections, ["doc", "number"]).select(
        "tag", "doc", "number", "title", "start_line", "text"
    )


def section_report(sections: DataFrame, number: str, analyze: bool = True) -> DataFrame:
    """One section of every document, with its normative statements and cross references as rows."""
    one = sections.filter(F.col("number") == number)
    head = one.select(
        "doc", F.lit("section").alias("part"), F.concat_ws(":", "doc", "number").alias("tag"),
        F.col("title").alias("label"), "text",
    )
    if not analyze:
        return head
    statements = extract_normative(one).select(
        "doc", F.lit("statement").alias("part"), F.concat_ws(":", "doc", "section").alias("tag"),
        F.col("keyword").alias("label"), "text",
    )
    refs = extract_cross_refs(one).select(
        "doc", F.lit("reference").alias("part"), F.concat_ws(":", "doc", "source_section").alias("tag"),
        F.concat_ws(":", "target_doc", "target_section").alias("label"), F.col("context").alias("text"),
    )
    return head.unionByName(statements).unionByName(refs)


# Document status codes and their labels.
STATUS_LABELS = {
    "ps": "Proposed Standard",
    "ds": "Draft Standard",
    "std": "Internet Standard",
    "bcp": "Best Current Practice",
    "inf": "Informational",
    "exp": "Experimental",
    "hist": "Historic",
}


def search_documents(docs: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """Documents whose title contains the text, ignoring case: all of them, or the first ``limit`` by name."""
    label = F.create_map(*[F.lit(x) for kv in STATUS_LABELS.items() for x in kv])
    found = docs.filter(F.contains(F.lower("title"), F.lit(query.lower())))
    found = found if limit is None else found.orderBy("doc").limit(limit)
    return (
        found.select(
            "doc",
            "title",
            "abstract",
            F.coalesce(label[F.col("status")], F.when(F.col("status") != "", F.col("status")), F.lit("Unknown")).alias(
                "status"
            ),
        )
    )
