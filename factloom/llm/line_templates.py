"""Line dedup by a tree of log templates.

A line is parsed by a tree of fixed depth: its number of words, then its first ``LEADING`` words, or half of its words if
it is shorter than twice that. Words with a digit are variable fields from the start. At a leaf, a word is a constant of its position if at least ``FEWEST``
classes, and a fifth of the leaf's classes, have it there; every other position is a variable field. A line follows the
template of its leaf if at least ``SIMILAR`` of its words after the leading ones are constants.

A leaf may hold many templates, none of them a fifth of it. So its lines are also grouped by their *frequent* words, those that at least
``FEWEST`` classes have at that place, whatever their share: lines of a leaf with the same frequent words at the same places are a
group, which is a template of its own if they make up ``SIMILAR`` of the words after the leading ones. It recurs by the classes of the group.

Documents count by class: near-duplicates (``near_dups``, similarity 0.75) are one class together, and any other document is one. A template
recurs if ``FEWEST`` classes or more have lines of the leaf. A line also recurs if so many classes have it word for word, numbers included;
long lines need fewer classes for that (``LONG``). Lines that only copies share go with the copies, which is the work of
near-dedup. Lines that follow a recurring template are dropped in all documents; all other lines stay as they are.

Everything is counted by keys with combinable aggregates; no leaf is gathered in one task. One pass over the texts writes a narrow table
of lines, with the words of a line only where it is new to its batch. A second pass removes the lines from the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.mapped import SharedMap, SharedSet, shared_map, shared_set
from factloom.llm.near_dups import near_duplicates
from factloom.llm.storage import stored
from factloom.llm.textarrays import mix64, row_bounds, slices, utf8, word_hashes, words

LEADING, FEWEST, SIMILAR, SHARE = 3, 8, 0.6, 0.2
LONG = ((20, 3), (50, 2))  # lines of so many words recur word for word from so many classes on
_FIELD = np.uint64(0x2A)
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_PLACE = np.uint64(0x9E3779B97F4A7C15)


class Lines:
    """The lines of some texts that hold words: row, place of the line in its text, words, leaf and hash of each.

    ``hash`` takes words with a digit as fields, ``verbatim`` as they are.
    """

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        starts, stops, rows = words(data, ends)
        self.words = word_hashes(data, starts, stops)
        numbers = np.zeros(len(starts), dtype=bool)  # words with a digit
        numbers[np.searchsorted(starts, np.flatnonzero(_DIGIT[data]), side="right") - 1] = True
        breaks = np.flatnonzero(data == ord("\n"))
        at = np.searchsorted(breaks, starts)
        new = np.ones(len(starts), dtype=bool)
        new[1:] = (at[1:] != at[:-1]) | (rows[1:] != rows[:-1])
        self.first = np.flatnonzero(new)
        self.size = np.diff(np.append(self.first, len(starts)))
        self.row = rows[self.first]
        self.number = at[self.first] - np.searchsorted(breaks, ends[self.row])  # line breaks of the text before it
        place = (np.arange(len(starts)) - np.repeat(self.first, self.size)).astype(np.uint64)
        place *= _PLACE
        if not len(self.first):
            self.hash = self.verbatim = self.leaf = np.zeros(0, dtype=np.uint64)
            return
        size = self.size.astype(np.uint64)
        exact = self.words[numbers]
        self.words[numbers] = _FIELD
        spread = mix64(self.words + place)
        total = np.add.reduceat(spread, self.first)
        self.hash = mix64(total + size)
        # word for word, a line's sum differs by its words with a digit
        line = np.searchsorted(self.first, np.flatnonzero(numbers), side="right") - 1
        np.add.at(total, line, mix64(exact + place[numbers]) - spread[numbers])
        self.verbatim = mix64(total + size)
        lead = np.zeros(len(self.first), dtype=np.uint64)
        for k in range(LEADING):
            deep = np.flatnonzero(self.size // 2 > k)
            lead[deep] += spread[self.first[deep] + k]
        self.leaf = mix64(lead ^ mix64(size))


_LINES = "doc_class long, leaf long, line long, verbatim long, n_words int, words binary"


def _read(classes: SharedMap):
    """The lines of each text, with the class of its document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                lines = Lines(*utf8(batch.column("text")))
                doc = batch.column("doc_id").to_numpy()[lines.row]
                _, fresh = np.unique(lines.hash, return_index=True)
                shown = np.zeros(len(lines.first), dtype=bool)
                shown[fresh] = True
                held = [
                    lines.words[a : a + n].tobytes() if new else None
                    for a, n, new in zip(lines.first.tolist(), lines.size.tolist(), shown.tolist(), strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(classes.get(doc), pa.int64()),
                        pa.array(lines.leaf.view(np.int64)),
                        pa.array(lines.hash.view(np.int64)),
                        pa.array(lines.verbatim.view(np.int64), mask=lines.verbatim == lines.hash),
                        pa.array(lines.size, pa.int32()),
                        pa.array(held, pa.binary()),
                    ],
                    names=["doc_class", "leaf", "line", "verbatim", "n_words", "words"],
                )

    return run


_FIELDS = "leaf long, line long, classes long, place int, word long"


def _fields(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each word of a line after the leading ones."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            found = [np.frombuffer(x, dtype=np.int64) for x in part.column("words").to_pylist()]
            size = np.array([len(x) for x in found])
            lead = np.minimum(LEADING, size // 2)
            of = pa.array(np.repeat(np.arange(part.num_rows), size - lead))
            places = [np.arange(a, b, dtype=np.int32) for a, b in zip(lead.tolist(), size.tolist(), strict=True)]
            named = [part.column(c).take(of) for c in ("leaf", "line", "classes")]
            values = [x[a:] for x, a in zip(found, lead.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*named, pa.array(np.concatenate(places)), pa.array(np.concatenate(values))], names=["leaf", "line", "classes", "place", "word"]
            )


def _held(fields: DataFrame, members: DataFrame) -> DataFrame:
    """``(leaf, place, word, classes, held)``: how many classes have each word at its place of a leaf, each class once.

    A class with one line of a leaf adds to the weight of that line; only the lines of other classes are taken word by word.
    """
    lines = members.groupBy("leaf", "doc_class").agg(F.min("line").alias("line"), F.count("*").alias("n"))
    lines = stored(lines, "own")
    single = lines.filter("n = 1").groupBy("leaf", "line").agg(F.count("*").alias("held"))
    single = fields.join(single, ["leaf", "line"]).select("leaf", "place", "word", "classes", "held")
    several = members.join(lines.filter("n > 1").select("leaf", "doc_class"), ["leaf", "doc_class"])
    several = fields.join(several, ["leaf", "line"]).select("leaf", "place", "word", "classes", "doc_class").distinct()
    several = several.select("leaf", "place", "word", "classes", F.lit(1).cast("long").alias("held"))
    return single.unionByName(several).groupBy("leaf", "place", "word").agg(F.max("classes").alias("classes"), F.sum("held").alias("held"))


def recurring_lines(docs: DataFrame, fewest: int = FEWEST) -> DataFrame:
    """``line``: the hashes of all lines that follow a recurring template or recur word for word, once each."""
    docs = docs.select(F.col("doc_id").cast("long"), "text").filter("doc_id IS NOT NULL")
    copies = near_duplicates(docs).filter("NOT kept").select("doc_id", "component_id")
    lines = docs.mapInArrow(_read(shared_map(copies, "copies")), _LINES)
    lines = stored(lines, "lines")
    leaves = lines.select("leaf", "doc_class").distinct().groupBy("leaf").agg(F.count("*").alias("classes"))
    leaves = stored(leaves.filter(F.col("classes") >= fewest), "leaves")
    members = lines.select("leaf", "line", "doc_class").join(leaves.select("leaf"), "leaf").distinct()
    members = stored(members, "members")
    texts = lines.filter("words IS NOT NULL").select("leaf", "line", "words").join(leaves, "leaf").dropDuplicates(["leaf", "line"])
    fields = stored(texts.select("leaf", "line", "classes", "words").mapInArrow(_fields, _FIELDS), "fields")
    held = _held(fields.filter(F.col("word") != int(_FIELD)), members)
    constant = held.filter(F.col("held") >= fewest).select(
        "leaf", "place", "word", F.when(F.col("held") >= SHARE * F.col("classes"), 1).alias("constant"), F.lit(1).alias("frequent")
    )
    follows = (
        fields.join(constant, ["leaf", "place", "word"], "left")
        .groupBy("leaf", "line")
        .agg(
            F.count("constant").alias("constants"),
            F.count("frequent").alias("frequent"),
            F.count("*").alias("places"),
            F.bit_xor(F.when(F.col("frequent") == 1, F.xxhash64("place", "word"))).alias("group"),
        )
        .filter(F.col("frequent") >= SIMILAR * F.col("places"))
    )
    follows = stored(follows, "follows")
    by_share = F.col("constants") >= SIMILAR * F.col("places")
    rest = follows.filter(~by_share).select("leaf", "line", "group")
    groups = members.join(rest, ["leaf", "line"]).select("leaf", "group", "doc_class").distinct()
    groups = groups.groupBy("leaf", "group").agg(F.count("*").alias("classes")).filter(F.col("classes") >= fewest)
    grouped = rest.join(groups.select("leaf", "group"), ["leaf", "group"]).select("line")
    follows = follows.filter(by_share).select("line").union(grouped)
    least = F.lit(fewest)
    for n, few in LONG:
        least = F.when(F.col("n_words") >= n, F.least(least, F.lit(few))).otherwise(least)
    same = lines.select(F.coalesce("verbatim", "line").alias("line"), "n_words", "doc_class").distinct()
    same = same.groupBy("line", "n_words").agg(F.count("*").alias("classes")).filter(F.col("classes") >= least)
    return follows.union(same.select("line")).distinct()


def _strip(gone: SharedSet, text: str, names: list[str]):
    """Texts without the lines whose hash is in the set; columns ``n_lines`` and ``n_dropped`` if they are among ``names``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                lines = Lines(*utf8(batch.column(text)))
                out = gone.has(lines.hash) | gone.has(lines.verbatim)
                if "doc_id" in batch.schema.names:
                    out &= batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)[lines.row]
                held = batch.column(text)
                n_lines = pc.fill_null(pc.add(pc.count_substring(held, "\n"), 1), 0)
                n_gone = np.bincount(lines.row[out], minlength=batch.num_rows)
                bounds = row_bounds(lines.row[out], batch.num_rows)
                number = lines.number[out]
                less = []
                for i in np.flatnonzero(n_gone):
                    drop = set(number[bounds[i] : bounds[i + 1]].tolist())
                    less.append("\n".join(line for k, line in enumerate(held[i].as_py().split("\n")) if k not in drop))
                new = {text: pc.replace_with_mask(held, pa.array(n_gone > 0), pa.array(less, held.type))}
                for name, values in (("n_lines", n_lines), ("n_dropped", n_gone)):
                    if name not in batch.schema.names:
                        new[name] = pc.cast(pa.array(values), pa.int64())
                yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(c) for c in names], names=names)

    return run


def drop_recurring_lines(docs: DataFrame, fewest: int = FEWEST) -> DataFrame:
    """Every row of ``docs(doc_id, text)`` as ``(doc_id, text, n_lines, n_dropped)``, without recurring lines.

    A document that loses all lines stays, with an empty text. Null texts stay null; rows without an id are left as they are and count
    for no template. Rows that repeat an id are one document in the counts. Other columns are not read.
    """
    gone = shared_set(recurring_lines(docs, fewest), "recurring")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    names = ["doc_id", "text", "n_lines", "n_dropped"]
    return rows.mapInArrow(_strip(gone, "text", names), "doc_id long, text string, n_lines long, n_dropped long")


def without_recurring_lines(docs: DataFrame, fewest: int = FEWEST) -> DataFrame:
    """The rows of ``docs`` with the columns they have, recurring lines taken out of ``text``; ``n_chars``, if there, is counted anew."""
    gone = shared_set(recurring_lines(docs, fewest), "recurring")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    out = docs.mapInArrow(_strip(gone, "text", docs.columns), schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))
    return out
