"""Spelling variants of a vocabulary, found by generated edits and blocked Bloom filters.

The filters hold a 64-bit key of every word, sharded by word length: a shard is a run of blocks, and all bits of a key lie in one block of
64. Every word is edited in tasks: each deletion of a letter, and each replacement by a letter of the alphabet that comes later than
the letter's own. That meets every pair once, as an insertion is a deletion from the longer word, and a replacement by an earlier letter one by a
later letter from the other word. An edit probes the shard of its length; only positives are shuffled, as (word id, key), and meet the
vocabulary in an equality join; the words of a pair are then compared, so false positives and equal keys of unlike words go.

A filter has ``BITS`` bits a word however large the vocabulary is. What is broadcast at once is at most ``MOST`` blocks (32 MiB): a larger
filter is probed range by range. Words are edited in flat arrays of letters, each edit in constant time, so a very long word
costs as its letters. A word's number of neighbours is bounded by its edits, so no key of a join is hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.storage import stored
from factloom.llm.textarrays import mix64

#: The letters of the words, in code-point order.
ALPHABET = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xC0, 0x100))
BITS, MOST, LONGEST, FLAT = 24, 4 << 20, 64, 1 << 15
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95  # odd, so it has an inverse modulo 2**64
_BACK = np.uint64(pow(_BASE, -1, 1 << 64))


def letter_runs(documents: DataFrame, least: int = 5) -> DataFrame:
    """``(doc_id, run)``: the maximal runs of at least ``least`` letters of every whole text, with A-Z in lower case; null texts have none."""
    run = F.explode(F.regexp_extract_all("text", F.lit(f"[A-Za-zÀ-ÿ]{{{least},}}"), F.lit(0)))
    # lower() is much faster than translate(), but also changes letters beyond A-Z
    lower = F.when(
        F.col("run").rlike("[À-Þ]"), F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    ).otherwise(F.lower("run"))
    return documents.select("doc_id", run.alias("run")).select("doc_id", lower.alias("run"))


def vocabulary(words: DataFrame, letters: int = 5, least: int = 3) -> DataFrame:
    """``(word, n)``: the words of ``words(word)`` with at least ``letters`` code points that occur at least ``least`` times."""
    return words.filter(F.length("word") >= letters).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Letters:
    """The letters of several words side by side, with the 64-bit keys of the words and of their edits."""

    def __init__(self, words: list[str], alphabet: np.ndarray):
        points = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4")
        self.code = np.searchsorted(alphabet, points).astype(np.int64)
        if len(points) and (self.code.max() == len(alphabet) or (alphabet[self.code] != points).any()):
            raise ValueError("a word holds a letter outside the alphabet")
        self.lengths = np.array([len(w) for w in words], dtype=np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))
        self.word = np.repeat(np.arange(len(words)), self.lengths)
        at = np.arange(len(points)) - self.starts[self.word]
        self.power = _powers(int(self.lengths.max(initial=0)))[at]
        self.number = mix64((alphabet.astype(np.uint64) + np.uint64(1)) * _STEP)
        self.before = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.number[self.code] * self.power, dtype=np.uint64)))
        self.total = self.before[self.starts[1:]] - self.before[self.starts[:-1]]

    @staticmethod
    def key(total: np.ndarray, length: np.ndarray) -> np.ndarray:
        return mix64(total + length.astype(np.uint64) * _STEP)

    def keys(self) -> np.ndarray:
        return self.key(self.total, self.lengths)

    def edits(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Word, length and key of every edit, each different edit of a word once."""
        first = np.zeros(len(self.code), dtype=bool)
        first[self.starts[:-1][self.lengths > 0]] = True
        at = np.flatnonzero(first | np.concatenate(([True], self.code[1:] != self.code[:-1]))) if len(self.code) else self.code
        w = self.word[at]
        start, stop = self.before[self.starts[w]], self.before[self.starts[w + 1]]
        rest = (self.before[at] - start) + (stop - self.before[at + 1]) * _BACK
        yield w, self.lengths[w] - 1, self.key(rest, self.lengths[w] - 1)
        for letter in range(1, len(self.number)):
            at = np.flatnonzero(self.code < letter)
            w = self.word[at]
            changed = self.total[w] + (self.number[letter] - self.number[self.code[at]]) * self.power[at]
            yield w, self.lengths[w], self.key(changed, self.lengths[w])


class Shards:
    """Where the filter of each word length lies: runs of blocks for the lengths up to ``LONGEST``, the last one for all longer words."""

    def __init__(self, counts: dict[int, int], bits: int = BITS):
        n = np.zeros(LONGEST + 1, dtype=np.int64)
        for length, count in counts.items():
            n[length] = count
        self.blocks = -(-n * bits // 64)
        self.first = np.concatenate(([0], np.cumsum(self.blocks)))
        self.total = int(self.first[-1])

    def place(self, length: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Block and bits of each key; block -1 where no word has that length."""
        shard = np.minimum(length, LONGEST)
        blocks = self.blocks[shard]
        block = self.first[shard] + ((key >> np.uint64(32)) * blocks.astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        mask = np.zeros(len(key), dtype=np.uint64)
        for i in range(5):
            mask |= np.uint64(1) << ((key >> np.uint64(6 * i)) & np.uint64(63))
        return np.where(blocks > 0, block, -1), mask


def _flat(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Ids and words of a batch in runs of about ``FLAT`` letters."""
    ids, words, letters = [], [], 0
    for i, word in zip(batch.column("id").to_pylist(), batch.column("word").to_pylist(), strict=True):
        ids.append(i)
        words.append(word)
        letters += len(word)
        if letters >= FLAT:
            yield np.array(ids), words
            ids, words, letters = [], [], 0
    if ids:
        yield np.array(ids), words


def _coded(alphabet: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [Letters(words, alphabet).keys() for _, words in _flat(batch)]
            if keys:
                key = pa.array(np.concatenate(keys).view(np.int64))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "word", "n")), key], names=["id", "word", "n", "key"])

    return run


def _blocks(shards: Shards):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, mask = shards.place(batch.column("letters").to_numpy(), batch.column("key").to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(mask.view(np.int64))], names=["block", "mask"])

    return run


def _positives(filter_bits, shards: Shards, low: int, high: int, alphabet: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = filter_bits.value
        for batch in batches:
            for ids, words in _flat(batch):
                found: list[tuple[np.ndarray, np.ndarray]] = []
                for word, length, key in Letters(words, alphabet).edits():
                    block, mask = shards.place(length, key)
                    held = np.flatnonzero((block >= low) & (block < high))
                    held = held[bits[block[held] - low] & mask[held] == mask[held]]
                    if len(held):
                        found.append((ids[word[held]], key[held].view(np.int64)))
                if found:
                    columns = [pa.array(np.concatenate(c)) for c in zip(*found, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "key"])

    return run


def near_pairs(words: DataFrame, alphabet: str = ALPHABET, bits: int = BITS, most: int = MOST) -> DataFrame:
    """``(id, word, n, other, other_word, other_n)``, each pair of near words once, of ``words(id, word, n, key)`` (see :func:`group_variants`)."""
    letters = np.array(sorted(map(ord, alphabet)), dtype="<u4")
    sized = words.withColumn("letters", F.length("word"))
    counts = sized.groupBy(F.least("letters", F.lit(LONGEST)).alias("shard")).count().collect()  # a row for each shard
    shards = Shards({r["shard"]: r["count"] for r in counts}, bits)
    filled = sized.select(F.col("letters").cast("long"), "key").mapInArrow(_blocks(shards), "block long, mask long")
    filled = stored(filled.groupBy("block").agg(F.bit_or("mask").alias("mask")), "filter")
    positives = None
    for low in range(0, shards.total, most):
        high = min(low + most, shards.total)
        part = filled.filter((F.col("block") >= low) & (F.col("block") < high)).toArrow()
        held = np.zeros(high - low, dtype=np.uint64)
        held[part.column("block").to_numpy() - low] = part.column("mask").to_numpy().view(np.uint64)
        shared = words.sparkSession.sparkContext.broadcast(held)
        found = words.select("id", "word").mapInArrow(_positives(shared, shards, low, high, letters), "id long, key long")
        positives = found if positives is None else positives.unionByName(found)
    if positives is None:
        positives = words.select("id", "key")
    other = words.select(F.col("id").alias("other"), F.col("word").alias("other_word"), F.col("n").alias("other_n"), "key")
    pairs = positives.join(other, "key").filter("id <> other").join(words.select("id", "word", "n"), "id")
    return pairs.filter(F.levenshtein("word", "other_word", 1) == 1).select("id", "word", "n", "other", "other_word", "other_n")


def _roots(forms: DataFrame) -> DataFrame:
    """``(id, root)``: the last word that ``forms(id, form)`` leads to, by doubling: every round halves the steps that are left."""
    heads = forms.select("id", F.col("form").alias("head"))
    while True:
        after = heads.select(F.col("id").alias("head"), F.col("head").alias("next"))
        heads = stored(heads.join(after, "head", "left").select("id", F.coalesce("next", "head").alias("head"), F.col("next").isNotNull().alias("moved")), "roots")
        if heads.filter("moved").isEmpty():
            return heads.select("id", F.col("head").alias("root"))
        heads = heads.drop("moved")


def group_variants(words: DataFrame, ratio: int = 2, alphabet: str = ALPHABET, bits: int = BITS, most: int = MOST) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for every row of the vocabulary ``words(word, n)``.

    Two words are near if one insertion, deletion or replacement of a code point turns one into the other; ``n_near`` counts a word's near
    words. ``form`` is the near word with the largest ``n`` (of equal ones the first in code-point order) if that is at least ``ratio`` times
    the word's own, else null, and ``form_n`` its ``n``; ``root`` is the word that the forms lead to in the end. Words are of ``alphabet``;
    another letter is an error. Null and empty words are left out, and a word that is there more than once counts with the sum of its ``n``.
    An empty vocabulary gives no row. Other columns are not read.
    """
    if ratio < 2:
        raise ValueError("with a ratio under 2 forms could lead in a circle")
    own = words.filter("word <> ''").groupBy("word").agg(F.sum("n").cast("long").alias("n"))
    own = own.withColumn("id", F.monotonically_increasing_id()).select("id", "word", "n")
    letters = np.array(sorted(map(ord, alphabet)), dtype="<u4")
    coded = stored(own.mapInArrow(_coded(letters), "id long, word string, n long, key long"), "words")
    pairs = near_pairs(coded, alphabet, bits, most)
    ends = F.array(
        F.struct("id", "n", (-F.col("other_n")).alias("order"), F.col("other_word").alias("form"), F.col("other").alias("to")),
        F.struct(F.col("other").alias("id"), F.col("other_n").alias("n"), (-F.col("n")).alias("order"), F.col("word").alias("form"), F.col("id").alias("to")),
    )
    best = (
        pairs.select(F.explode(ends).alias("e")).select("e.*")
        .groupBy("id").agg(F.count("*").alias("n_near"), F.min("n").alias("n"), F.min(F.struct("order", "form", "to")).alias("best"))
    )
    good = -F.col("best.order") >= ratio * F.col("n")
    best = stored(
        best.select("id", "n_near", F.when(good, F.col("best.form")).alias("form"), F.when(good, -F.col("best.order")).alias("form_n"), F.when(good, F.col("best.to")).alias("to")),
        "near",
    )
    roots = _roots(best.filter("to IS NOT NULL").select("id", F.col("to").alias("form")))
    named = roots.join(coded.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    return (
        coded.join(best, "id", "left")
        .join(named, "id", "left")
        .select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
    )
