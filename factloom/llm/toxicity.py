"""Toxicity by a string-kernel support vector machine with Nystroem landmarks.

A text is a bag of units: its words in lower case; a run of single characters ("i d i o t") is one unit, a unit of more than
``WINDOW`` bytes is cut into windows that overlap by half. The kernel of two units compares all subsequences of three
letters (the edges of a unit are letters, too) within ``SPAN`` bytes; one that spans n bytes weighs ``DECAY ** n``, so letters may be parted by other letters or
signs. Signs take no part, digits that stand for a letter count as that letter, and each unit has norm 1.

Training runs on a bounded sample of labelled texts (``SAMPLE`` of each label). Units with five or seven bytes in a row that toxic texts
have ``ODDS`` times as often as clean ones, by a lower bound of the ratio, are telling, so that a few wrong labels don't decide; a
toxic text without any has a witness, the unit that speaks most for toxicity: at first by such runs, later by the machine. Landmarks
are the commonest of these units and some clean units; a linear machine with squared hinge loss is fitted on their Nystroem
features, against units of the clean texts. A text is as toxic as a logistic function of its highest unit, of how many units lie on
the toxic side and of its number of units says: one plain insult is enough, a word start that clean texts also hold now and then must come
several times. That function is fitted on the decisions of machines that have not seen the text (``FOLDS`` parts of the sample).

The decision is linear in the explicit subsequence weights, so landmarks and coefficients are folded into one weight per
subsequence, and workers score the distinct units of some megabytes of text by array operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.labelled import remainder, sample
from factloom.llm.textarrays import slices, utf8, word_hashes, words

SAMPLE, LANDMARKS, ROUNDS = 2000, 128, 3
CLEAN_UNITS = 10000
DOUBT = 0.1  # weight of a witness that is not telling: the label may be wrong
ODDS, SURE = 4.0, 2.0  # least ratio of shares of a telling run, and how many standard errors of its logarithm it must stand
RUNS = (5, 7)  # bytes, edges included: short words, and word starts with letters of two bytes
FOLDS = 2  # parts of the sample, each judged by a machine of the others
CLEAN_WEIGHT = 4.0  # a clean text called toxic counts as much as four toxic ones missed
SPAN, DECAY, WINDOW = 8, 0.6, 24
_SIZE = 1 << 15  # three letters of five bits

_CLASS = np.zeros(256, dtype=np.int64)  # 0: a sign
_CLASS[ord("a") : ord("z") + 1] = np.arange(1, 27)
_CLASS[ord("A") : ord("Z") + 1] = np.arange(1, 27)
for _digit, _letter in zip("013457", "oieast", strict=True):
    _CLASS[ord(_digit)] = _CLASS[ord(_letter)]
_CLASS[128:] = 27 + np.arange(128) % 4  # bytes of other letters
_EDGE = 31  # before and after a unit

_STEPS = [(d1, d2) for d2 in range(2, SPAN) for d1 in range(1, d2)]


def units(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every unit, before long ones are cut."""
    starts, stops, rows = words(data, ends)
    if not len(starts):
        return starts, stops, rows
    single = stops - starts == 1
    joined = single[1:] & single[:-1] & (starts[1:] == stops[:-1] + 1) & (rows[1:] == rows[:-1])
    heads = np.flatnonzero(np.concatenate(([True], ~joined)))
    return starts[heads], stops[np.append(heads[1:], len(starts)) - 1], rows[heads]


def windows(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of the windows of all units, and the unit that each belongs to."""
    size = stops - starts
    half = WINDOW // 2
    count = np.where(size <= WINDOW, 1, -(-(size - WINDOW) // half) + 1)
    unit = np.repeat(np.arange(len(starts)), count)
    at = np.arange(len(unit)) - np.repeat(np.cumsum(count) - count, count)
    first = starts[unit] + half * at
    return first, np.minimum(first + WINDOW, stops[unit]), unit


def _letters(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letter classes of all pieces one after the other, each between two edge marks; where each piece begins; and how many
    places are left in it at each place."""
    size = stops - starts
    begin = np.cumsum(size + 2) - (size + 2)
    total = int(size.sum()) + 2 * len(size)
    place = np.arange(total) + np.repeat(starts - 1 - begin, size + 2)
    letters = _CLASS[data[np.clip(place, 0, max(0, len(data) - 1))]] if len(data) else np.zeros(total, dtype=np.int64)
    letters[begin] = letters[begin + size + 1] = _EDGE
    left = np.repeat(begin + size + 2, size + 2) - np.arange(total)
    return letters, begin, left


def subsequences(letters: np.ndarray, left: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each pair of steps: places that start a subsequence, its number, and its weight."""
    for d1, d2 in _STEPS:
        n = len(letters) - d2
        if n <= 0:
            continue
        a, b, c = letters[:n], letters[d1 : n + d1], letters[d2 : n + d2]
        at = np.flatnonzero((left[:n] > d2) & (a > 0) & (b > 0) & (c > 0))
        yield at, (a[at] << 10) + (b[at] << 5) + c[at], DECAY ** (d2 + 1)


def decide(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each unit the highest decision of its windows, without the intercept."""
    first, last, unit = windows(starts, stops)
    if not len(first):
        return np.zeros(0)
    letters, begin, left = _letters(data, first, last)
    value, norm = np.zeros(len(letters)), np.zeros(len(letters))
    for at, number, weight in subsequences(letters, left):
        value[at] += weights[number] * weight
        norm[at] += weight * weight
    value, norm = np.add.reduceat(value, begin), np.add.reduceat(norm, begin)
    value = value / np.sqrt(np.maximum(norm, 1e-12))
    return np.maximum.reduceat(value, np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1]))))


def features(texts: list[bytes]) -> np.ndarray:
    """Explicit subsequence weights of some units, a row of norm at most 1 each; only for landmarks."""
    out = np.zeros((len(texts), _SIZE), dtype=np.float64)
    for row, text in zip(out, texts, strict=True):
        data = np.frombuffer(text[:WINDOW], dtype=np.uint8)
        letters, _, left = _letters(data, np.array([0]), np.array([len(data)]))
        norm = 0.0
        for _, number, weight in subsequences(letters, left):
            np.add.at(row, number, weight)
            norm += weight * weight * len(number)
        row /= np.sqrt(max(norm, 1e-12))
    return out


def _units_of(text: str) -> set[bytes]:
    data = text.lower().encode()
    array = np.frombuffer(data, dtype=np.uint8)
    starts, stops, _ = units(array, np.array([0, len(array)]))
    first, last, _ = windows(starts, stops)
    return {data[s:e] for s, e in zip(first.tolist(), last.tolist(), strict=True)}


def _squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """A linear support vector machine, by Newton steps over the rows inside the margin."""
    z = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    a = np.zeros(z.shape[1])
    keep = ridge * np.append(np.ones(x.shape[1]), 1e-3)
    for _ in range(40):
        inside = y * (z @ a) < 1
        own = z[inside] * weight[inside, None]
        new = np.linalg.solve(own.T @ z[inside] + np.diag(keep), own.T @ y[inside])
        if np.abs(new - a).max() < 1e-8:
            break
        a = new
    return a[:-1], float(a[-1])


def evidence(rows: np.ndarray, decisions: np.ndarray, n: int) -> np.ndarray:
    """For ``n`` texts, from the decisions of their units (intercept included): the highest, from -2 to 2; the logarithm of one
    more than the units on the toxic side, the margin counted in part; and the logarithm of one more than all units."""
    highest = np.full(n, -2.0)
    np.maximum.at(highest, rows, np.minimum(decisions, 2.0))
    toxic = np.bincount(rows, np.clip(decisions, 0.0, 1.0), minlength=n)
    return np.stack([highest, np.log1p(toxic), np.log1p(np.bincount(rows, minlength=n))], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Coefficients and intercept of a weighted logistic regression, by Newton steps that are halved until the loss falls."""
    z = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    keep = ridge * np.append(np.ones(x.shape[1]), 1e-3)

    def loss(a: np.ndarray) -> float:
        return float(weight @ np.logaddexp(0, np.where(y == 1, -1, 1) * (z @ a)) + keep @ (a * a) / 2)

    a = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ a, -500, 500)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(keep), z.T @ (weight * (y - p)) - keep * a)
        size = 1.0
        while loss(a + size * step) > loss(a) and size > 1e-6:
            size /= 2
        a = a + size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return a


class Machine:
    """Weights of the subsequences, the intercept, and the line under the logistic function that turns evidence into a score."""

    def __init__(self, weights: np.ndarray, intercept: float, line: np.ndarray):
        self.weights, self.intercept, self.line = weights.astype(np.float32), intercept, line

    def score(self, rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        """Of ``n`` texts, from the values that ``decide`` gives to their units; ``rows`` says whose unit each is."""
        z = evidence(rows, values + self.intercept, n) @ self.line[:-1] + self.line[-1]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


class _Pieces:
    """Units as one byte array."""

    def __init__(self, pieces: list[bytes]):
        size = np.array([len(p) for p in pieces], dtype=np.int64)
        self.data, self.stops = np.frombuffer(b"".join(pieces), dtype=np.uint8), np.cumsum(size)
        self.starts = self.stops - size

    def decide(self, weights: np.ndarray) -> np.ndarray:
        parts = [slice(i, i + 50_000) for i in range(0, max(1, len(self.starts)), 50_000)]
        return np.concatenate([decide(self.data, self.starts[p], self.stops[p], weights) for p in parts])

    def kernel(self, points: np.ndarray) -> np.ndarray:
        """Kernel values of every unit, no longer than a window, with every landmark's weights."""
        letters, begin, left = _letters(self.data, self.starts, self.stops)
        unit = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(letters))))
        columns = np.ascontiguousarray(points.T, dtype=np.float32)
        out, norm = np.zeros((len(begin), len(points))), np.zeros(len(begin))
        for at, number, weight in subsequences(letters, left):
            heads = np.flatnonzero(np.concatenate(([True], np.diff(unit[at]) > 0))) if len(at) else at
            if len(at):
                out[unit[at][heads]] += weight * np.add.reduceat(columns[number], heads, axis=0)
                norm += weight * weight * np.bincount(unit[at], minlength=len(begin))
        return out / np.sqrt(np.maximum(norm, 1e-12))[:, None]


def _first_guess(pieces: _Pieces, bags: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each unit the log odds of its most telling run of bytes (edges included), and whether it holds a telling run.

    Runs of each length in ``RUNS`` are counted once a text. A telling one is in at least 1 % (and five) of the toxic texts, and
    ``ODDS`` times as common there as in clean texts, also ``SURE`` standard errors lower.
    """
    size = pieces.stops - pieces.starts
    begin = np.cumsum(size + 2) - (size + 2)
    total = int(size.sum()) + 2 * len(size)
    byte = pieces.data[np.clip(np.arange(total) + np.repeat(pieces.starts - 1 - begin, size + 2), 0, len(pieces.data) - 1)].astype(np.int64)
    byte[begin] = byte[begin + size + 1] = 1
    left = np.repeat(begin + size + 2, size + 2) - np.arange(total)
    owner = np.repeat(np.arange(len(size), dtype=np.int32), size + 2)
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    best, telling = np.full(len(size), -10.0), np.zeros(len(size), dtype=bool)
    for length in RUNS:
        at = np.flatnonzero(left >= length)
        if not len(at):
            continue
        run = np.unique(sum(byte[at + k] << (8 * k) for k in range(length)), return_inverse=True)[1].astype(np.int32)
        unit = owner[at]
        first = np.searchsorted(unit, np.arange(len(size) + 1))
        counts = np.zeros((2, int(run.max()) + 1))
        for bag, label in zip(bags, y, strict=True):
            many = first[bag + 1] - first[bag]
            own = np.repeat(first[bag] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            counts[int(label), np.unique(run[own])] += 1
        odds = np.log((counts[1] + 0.1) / n1) - np.log((counts[0] + 0.5) / n0)
        error = np.sqrt(1 / (counts[1] + 0.1) + 1 / (counts[0] + 0.5))
        sure = (odds - SURE * error >= np.log(ODDS)) & (counts[1] >= max(5, 0.01 * n1))
        np.maximum.at(best, unit, odds[run])
        np.logical_or.at(telling, unit, sure[run])
    return best, telling


def _disguised(unit: bytes, rng: np.random.Generator) -> list[bytes]:
    """A unit as it is written to get past a word list: letters parted by signs or blanks, a sign or a letter put in."""
    letters = [unit[i : i + 1] for i in range(len(unit))]
    at = int(rng.integers(1, max(2, len(unit))))
    other = bytes([int(rng.integers(ord("a"), ord("z") + 1))])
    return [s.join(letters)[:WINDOW] for s in (b" ", b".", b"-")] + [unit[:at] + x + unit[at:] for x in (b"*", other)]


def _separate(everything: list[bytes], bags: list[np.ndarray], y: np.ndarray, landmarks: int, rounds: int, ridge: float) -> tuple[np.ndarray, float]:
    """Subsequence weights and intercept of the machine for texts that are ``bags`` of units, with both labels.

    Each round fits the telling units and the witnesses, with disguised forms of the common ones, against ``CLEAN_UNITS`` clean units: some at random, and
    those that the round before scored highest.
    """
    pieces = _Pieces(everything)
    in_clean, in_toxic = np.zeros(len(everything)), np.zeros(len(everything))
    for bag, label in zip(bags, y, strict=True):
        (in_toxic if label else in_clean)[bag] += 1
    guess, telling = _first_guess(pieces, bags, y)
    harmless = np.flatnonzero((in_clean > 0) & ~telling)
    value = np.zeros(len(everything))
    rng = np.random.default_rng(5)
    for turn in range(rounds):
        often = np.where(telling, in_toxic, 0.0)
        for bag, label in zip(bags, y, strict=True):
            if label and len(bag) and not telling[bag].any():
                witness = bag[np.argmax((value if turn else guess)[bag])]
                often[witness] += (in_clean[witness] == 0) * (DOUBT if telling.any() else 1.0)
        common = np.flatnonzero(often)
        common = common[np.argsort(-often[common], kind="stable")]
        if not len(common):  # every unit of the toxic texts is in clean texts, too
            common = np.unique([bag[np.argmax(guess[bag])] for bag, label in zip(bags, y, strict=True) if label and len(bag)])
            often[common] = 1
        own = common[: landmarks * 3 // 4]
        hard = harmless[np.argsort(-value[harmless], kind="stable")[: CLEAN_UNITS // 2]]
        other = rng.choice(harmless, min(len(harmless), CLEAN_UNITS // 2), replace=False)
        negative = np.unique(np.concatenate([hard, other]))
        marks = np.concatenate([own, rng.choice(negative, min(len(negative), landmarks - len(own)), replace=False)])
        points = features([everything[i] for i in marks])
        values, vectors = np.linalg.eigh(points @ points.T)
        strong = values > 1e-6 * values.max()
        root = vectors[:, strong] / np.sqrt(values[strong])  # maps kernel rows to Nystroem features
        masked = [d for i in own for d in _disguised(everything[i], rng)]
        rows = _Pieces([everything[i] for i in common] + masked + [everything[i] for i in negative])
        weight = np.concatenate(
            [
                often[common] / often[common].sum(),
                np.full(len(masked), 1.5 / max(1, len(masked))),
                np.full(len(negative), 2.0 / max(1, len(negative))),
            ]
        )
        sign = np.concatenate([np.ones(len(common) + len(masked)), -np.ones(len(negative))])
        beta, intercept = _squared_hinge(rows.kernel(points) @ root, sign, weight, ridge)
        weights = points.T @ (root @ beta)
        value = pieces.decide(weights)
    return weights, intercept


def _bags(texts: list[str]) -> tuple[list[bytes], list[np.ndarray]]:
    """All distinct units, and for each text the sorted numbers of its own."""
    number: dict[bytes, int] = {}
    bags = [np.array(sorted(number.setdefault(u, len(number)) for u in sorted(_units_of(t))), dtype=np.int32) for t in texts]
    return list(number), bags


def _judged(texts: list[str], weights: np.ndarray, intercept: float) -> np.ndarray:
    """The evidence of texts, as workers find it."""
    data, ends = utf8(pa.array(texts, pa.string()))
    starts, stops, rows = units(data, ends)
    return evidence(rows, _by_unit(data, starts, stops, weights) + intercept, len(texts))


def _by_unit(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """``decide`` with each distinct unit looked at once, some at a time."""
    _, first, back = np.unique(word_hashes(data, starts, stops), return_index=True, return_inverse=True)
    cuts = range(0, max(1, len(first)), 50_000)
    return np.concatenate([decide(data, starts[first[i : i + 50_000]], stops[first[i : i + 50_000]], weights) for i in cuts])[back]


def fit(texts: list[str], y: np.ndarray, landmarks: int = LANDMARKS, rounds: int = ROUNDS, ridge: float = 1e-4) -> Machine:
    """A machine for labelled texts (1: toxic). Without both labels every text gets the share of label 1.

    The line from evidence to score is fitted on texts that the judging machine has not learned from; with too few rows for
    ``FOLDS`` parts of both labels, on the texts themselves.
    """
    y = np.asarray(y)
    if not len(y) or y.min() == y.max():
        share = min(max(float(y.mean()) if len(y) else 0.0, 0.01), 0.99)
        return Machine(np.zeros(_SIZE), 0.0, np.array([0.0, 0.0, 0.0, np.log(share / (1 - share))]))
    pieces, bags = _bags(texts)
    weights, intercept = _separate(pieces, bags, y, landmarks, rounds, ridge)
    part, rng = np.zeros(len(y), dtype=int), np.random.default_rng(7)
    for label in (0, 1):
        own = rng.permutation(np.flatnonzero(y == label))
        part[own] = np.arange(len(own)) % FOLDS
    if min((y == 0).sum(), (y == 1).sum()) < 10 * FOLDS:
        seen = _judged(texts, weights, intercept)
    else:
        seen = np.zeros((len(y), 3))
        for k in range(FOLDS):
            rest, own = np.flatnonzero(part != k), np.flatnonzero(part == k)
            other = _separate(*_bags([texts[i] for i in rest]), y[rest], landmarks, rounds, ridge)
            seen[own] = _judged([texts[i] for i in own], *other)
    line = _logistic(seen, y, np.where(y == 1, 1.0, CLEAN_WEIGHT))
    return Machine(weights, intercept, line)


def _score(machine: Machine, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 8 << 20):
                data, ends = utf8(batch.column("text"))
                starts, stops, rows = units(data, ends)
                score = machine.score(rows, _by_unit(data, starts, stops, machine.weights), batch.num_rows)
                kept = [batch.column(n) for n in names]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(score)], names=[*names, "score"])

    return run


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, folds: int = 5, out: int = 0) -> Machine:
    """Fitted on at most ``most`` texts of each value of ``labels(doc_id, toxic)`` outside fold ``out``.

    The sample's ids are few by this bound and are therefore broadcast; its texts come to the driver.
    """
    chosen = F.broadcast(sample(labels, "toxic", folds, out, most))
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").filter("text IS NOT NULL").collect()
    rows = sorted(((r.doc_id, r.text, r.y) for r in rows))
    return fit([t for _, t, _ in rows], np.array([y for _, _, y in rows], dtype=int))


def toxicity(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, folds: int = 5, out: int = 0) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs(doc_id, text)``.

    ``held_out``: the id's ``crc32`` modulo ``folds`` is ``out``; labels of such rows are not learned. A null or empty text has no
    units and scores as clean. Null ids are folded as empty texts; rows that repeat an id get a row each. Only the text
    enters a score; other columns are not read.
    """
    machine = train(docs, labels, most, folds, out)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder("doc_id", folds) == out).alias("held_out"), "text")
    scored = rows.mapInArrow(_score(machine, ["doc_id", "held_out"]), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with the columns they have; nothing is shuffled."""
    machine = train(docs, labels)
    names = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 8 << 20):
                score = next(_score(machine, [])(iter([batch.select(["text"])]))).column("score").to_numpy()
                yield batch.filter(pa.array(score < 0.5)).select(names)

    return docs.mapInArrow(run, schema)
