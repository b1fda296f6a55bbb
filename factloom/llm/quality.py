"""Document quality by a sparse ensemble of rules.

1. A few statistics (``STATISTICS``) are taken of whole texts, by array operations over bytes.
2. On a bounded sample of labelled documents (``SAMPLE`` of each label) small trees are boosted. Every path from a root to a node is a rule:
   a conjunction of bounds on statistics.
3. Lasso logistic regression weighs the rules; most weights become zero.
4. The remaining rules are compiled into one Spark column expression over the statistics, which scores every document in
   one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.labelled import remainder, sample
from factloom.llm.textarrays import row_bounds, slices, utf8, word_hashes, words

SAMPLE, TREES, DEPTH, CUTS = 6000, 24, 3, 32

STATISTICS = [
    "log_words",  # log(1 + words)
    "mean_word",  # bytes per word
    "long_words",  # share of words of 16 bytes or more
    "upper",  # share of A-Z among ASCII letters
    "digits",  # share of digits among bytes
    "marks",  # share of other ASCII signs than .,;:'"- among bytes that are no white space
    "loud",  # ! and ? per word
    "bars",  # | per word
    "no_letter",  # share of words without a letter
    "other_bytes",  # share of bytes from 128 on
    "repeated",  # share of words that are no first occurrence
    "echo",  # share of words equal to the word before
    "top_word",  # share of the most frequent word
    "log_line",  # log(1 + bytes per line)
    "closed_lines",  # share of lines that end in . ! ? : or a quote
]

_UPPER, _LOWER, _DIGIT, _MARK, _OTHER, _LOUD, _BAR, _BREAK = range(8)
_BYTES = np.zeros((8, 256), dtype=bool)
_BYTES[_UPPER, 65:91] = _BYTES[_LOWER, 97:123] = _BYTES[_DIGIT, 48:58] = _BYTES[_OTHER, 128:] = True
_BYTES[_MARK, 33:127] = True
_BYTES[_MARK] &= ~(_BYTES[_UPPER] | _BYTES[_LOWER] | _BYTES[_DIGIT])
_BYTES[_MARK, list(b".,;:'\"-")] = False
_BYTES[_LOUD, list(b"!?")] = _BYTES[_BAR, ord("|")] = _BYTES[_BREAK, ord("\n")] = True
_CLOSES = np.zeros(256, dtype=bool)
_CLOSES[list(b".!?:\"')")] = True


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive bounds."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return np.diff(total[ends])


def statistics(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``STATISTICS`` of every text, a row each; zeros for an empty text."""
    n = len(ends) - 1
    count = np.stack([_sums(kind[data], ends) for kind in _BYTES]).astype(np.float64)
    size = np.diff(ends).astype(np.float64)
    starts, stops, rows = words(data, ends)
    bounds = row_bounds(rows, n)
    number = np.diff(bounds).astype(np.float64)
    length = stops - starts
    letters = np.concatenate(([0], np.cumsum((_BYTES[_UPPER] | _BYTES[_LOWER] | _BYTES[_OTHER])[data], dtype=np.int64)))
    hashes = word_hashes(data, starts, stops)
    order = np.lexsort((hashes, rows))
    same = np.zeros(len(hashes), dtype=bool)
    same[1:] = (hashes[order][1:] == hashes[order][:-1]) & (rows[order][1:] == rows[order][:-1])
    heads = np.flatnonzero(~same)
    top = np.zeros(n)
    np.maximum.at(top, rows[order][heads], np.diff(np.append(heads, len(hashes))))
    echo = np.zeros(len(hashes), dtype=bool)
    echo[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    breaks = np.zeros(len(data) + 1, dtype=bool)  # a line ends before this place
    breaks[:-1] = data == ord("\n")
    breaks[ends[1:][size > 0]] = True
    stop = np.flatnonzero(breaks)
    owner = np.searchsorted(ends, np.maximum(stop, 1) - 1, side="right") - 1
    closed = np.bincount(owner, weights=_CLOSES[data[np.maximum(stop, 1) - 1]], minlength=n) if len(stop) else np.zeros(n)
    lines = np.bincount(owner, minlength=n).astype(np.float64) if len(stop) else np.zeros(n)
    per_word, per_byte, per_line = (1 / np.maximum(x, 1) for x in (number, size, lines))
    visible = np.maximum(_sums(length, bounds), 1)
    return np.stack(
        [
            np.log1p(number),
            _sums(length, bounds) * per_word,
            _sums(length >= 16, bounds) * per_word,
            count[_UPPER] / np.maximum(count[_UPPER] + count[_LOWER], 1),
            count[_DIGIT] * per_byte,
            count[_MARK] / visible,
            count[_LOUD] * per_word,
            count[_BAR] * per_word,
            _sums(letters[stops] == letters[starts], bounds) * per_word,
            count[_OTHER] * per_byte,
            _sums_by_row(same, rows[order], n) * per_word,
            _sums(echo, bounds) * per_word,
            top * per_word,
            np.log1p(size * per_line),
            closed * per_line,
        ],
        axis=1,
    )


def _sums_by_row(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, weights=values, minlength=n) if len(rows) else np.zeros(n)


def with_statistics(docs: DataFrame, prefix: str = "") -> DataFrame:
    """``docs`` with a column for each of ``STATISTICS``, named ``prefix`` and the statistic; a null text counts as empty."""
    names = docs.columns
    new = [f"{prefix}{s}" for s in STATISTICS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                found = statistics(*utf8(batch.column("text")))
                columns = [pa.array(np.ascontiguousarray(c)) for c in found.T]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*names, *new])

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"`{n}` double" for n in new]
    return docs.mapInArrow(run, ", ".join(schema))


# ---- rules ----------------------------------------------------------------------------------------------------------

Bound = tuple[int, bool, float]  # statistic, whether above the cut, cut


@dataclass(frozen=True)
class Rule:
    bounds: tuple[Bound, ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        ok = np.ones(len(x), dtype=bool)
        for statistic, above, cut in self.bounds:
            ok &= (x[:, statistic] > cut) == above
        return ok

    def column(self, prefix: str) -> F.Column:
        named = [(F.col(prefix + STATISTICS[s]), above, cut) for s, above, cut in self.bounds]
        parts = [c > cut if above else c <= cut for c, above, cut in named]
        out = parts[0]
        for part in parts[1:]:
            out = out & part
        return out


@dataclass(frozen=True)
class Ensemble:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.intercept + sum((w * r.holds(x) for r, w in self.rules), np.zeros(len(x)))
        return 1 / (1 + np.exp(-z))

    def column(self, prefix: str = "") -> F.Column:
        """The score as a Spark expression over the statistics."""
        z = F.lit(self.intercept)
        for rule, weight in self.rules:
            z = z + F.when(rule.column(prefix), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def _paths(x: np.ndarray, residual: np.ndarray, curve: np.ndarray, cuts: list[np.ndarray], depth: int) -> tuple[list[tuple[Bound, ...]], np.ndarray]:
    """The paths of a tree fitted to a Newton step of the logistic loss, and its step for each row."""
    paths: list[tuple[Bound, ...]] = []
    step = np.zeros(len(x))

    def grow(rows: np.ndarray, path: tuple[Bound, ...]) -> None:
        g, h = residual[rows].sum(), curve[rows].sum() + 1.0
        step[rows] = g / h
        best = (1e-6, None)
        if len(path) < depth and len(rows) >= 10:
            for s, at in enumerate(cuts):
                if not len(at):
                    continue
                bucket = np.searchsorted(at, x[rows, s], side="left")  # the cuts below the value
                gs = np.bincount(bucket, weights=residual[rows], minlength=len(at) + 1)
                hs = np.bincount(bucket, weights=curve[rows], minlength=len(at) + 1)
                gl, hl = np.cumsum(gs)[:-1], np.cumsum(hs)[:-1]
                left = np.cumsum(np.bincount(bucket, minlength=len(at) + 1))[:-1]
                gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl) - g**2 / h
                gain[(left < 5) | (len(rows) - left < 5)] = 0
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (s, float(at[k])))
        if best[1] is None:
            return
        s, cut = best[1]
        above = x[rows, s] > cut
        for side in (False, True):
            longer = (*path, (s, side, cut))
            paths.append(longer)
            grow(rows[above == side], longer)

    grow(np.arange(len(x)), ())
    return paths, step


def _lasso(rules: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, steps: int = 600) -> tuple[float, np.ndarray]:
    """Logistic regression with an absolute penalty on all weights but the intercept, by accelerated proximal steps."""
    x = np.concatenate([np.ones((len(rules), 1)), rules], axis=1)
    speed = 4.0 / np.linalg.norm(x * np.sqrt(weight)[:, None], 2) ** 2
    a = np.zeros(x.shape[1])
    ahead, momentum = a, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30)))
        new = ahead - speed * (x.T @ (weight * (p - y)))
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - speed * penalty, 0)
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead, a, momentum = new + (momentum - 1) / after * (new - a), new, after
    return float(a[0]), a[1:]


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, penalty: float = 1e-4, rate: float = 0.3) -> Ensemble:
    """Rules and weights for rows of statistics and labels 0 and 1. With one label only, the score is its share."""
    if not len(y) or y.min() == y.max():
        share = min(max(float(y.mean()) if len(y) else 0.5, 0.01), 0.99)
        return Ensemble(float(np.log(share / (1 - share))), ())
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, CUTS + 2)[1:-1])) for c in x.T]
    weight = np.full(len(y), 1 / len(y))
    z = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    paths: dict[tuple[Bound, ...], None] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        found, step = _paths(x, y - p, p * (1 - p), cuts, depth)
        paths.update(dict.fromkeys(found))
        z = z + rate * step
    rules = [Rule(p) for p in paths]
    if not rules:
        return Ensemble(float(np.log(y.mean() / (1 - y.mean()))), ())
    holds = np.stack([r.holds(x) for r in rules], axis=1).astype(np.float64)
    intercept, weights = _lasso(holds, y.astype(float), weight, penalty)
    return Ensemble(intercept, tuple((r, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-6))


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, folds: int = 3, out: int = 1) -> Ensemble:
    """Fitted on at most ``most`` documents of each value of ``labels(doc_id, quality)`` outside fold ``out``.

    The sample's ids are few by this bound and are therefore broadcast; only its statistics come to the driver.
    """
    chosen = F.broadcast(sample(labels, "quality", folds, out, most))
    rows = with_statistics(docs.select("doc_id", "text").join(chosen, "doc_id")).drop("text").collect()
    rows = sorted(rows, key=lambda r: (r.doc_id, *(r[s] for s in STATISTICS)))
    x = np.array([[r[s] for s in STATISTICS] for r in rows], dtype=np.float64).reshape(len(rows), len(STATISTICS))
    return fit(x, np.array([r.y for r in rows], dtype=int))


def quality(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, folds: int = 3, out: int = 1) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs(doc_id, text)``.

    ``held_out``: the id's ``crc32`` modulo ``folds`` is ``out``; labels of such rows are not learned. Null and empty texts have statistics
    of zero and a score as any other. Rows that repeat an id get a row each. Only the text enters a score; other
    columns are not read.
    """
    score = train(docs, labels, most, folds, out).column()
    stats = with_statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    scored = stats.select("doc_id", (remainder("doc_id", folds) == out).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are predicted good, with the columns they have; nothing is shuffled."""
    prefix = "_" * (1 + max((len(c) for c in docs.columns), default=0))  # no column can have such a name
    score = train(docs, labels).column(prefix)
    return with_statistics(docs, prefix).filter(score >= 0.5).select(*docs.columns)
