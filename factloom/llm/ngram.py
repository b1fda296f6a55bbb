"""An interpolated modified Kneser-Ney bigram model, counted in Spark and scored from memory-mapped sorted hash arrays.

Counting
  A task reads whole texts, turns words into 64-bit hashes and adds up its n-grams before anything is shuffled: words go to the shard
  of their hash, pairs to the shard of their first word. First words with more than a quarter of a shard's share of all
  tokens are *heavy*: their pairs are dealt by both words, and what is known of a heavy word is added up afterwards.
  There are fewer than four heavy words a shard.
Storing
  Each shard is one file in the shared folder of ``spark.checkpoint.dir``: sorted hashes with counts of pairs and of contexts
  (pairs file), and of words (words file).
Scoring
  Workers map the files and look up the distinct words and pairs of a few megabytes of text at a time, in sorted order.

With c(u w) the count of a pair, c(u) of a context, N(w) the number of different words before w, and T the number of different pairs:

  P(w | u) = (c(u w) - D[c(u w)] + (D1 n1(u) + D2 n2(u) + D3 n3+(u)) P(w)) / c(u),   or P(w) if u was not seen
  P(w)     = (N(w) - E[N(w)] + (E1 m1 + E2 m2 + E3 m3+) / (V + 1)) / T

where D and E are the modified Kneser-Ney discounts for counts 1, 2 and 3 or more, taken from the counts of counts of pairs and
of N. Unknown words share one place in the uniform end of the chain, so the probabilities of the V known words and
of that place add up to 1 after every context. A text is ``start w1 .. wm end``; the words and the end are predicted.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.mapped import U32, U64, arrays, make_folder, mark_complete, write_arrays
from factloom.llm.storage import shared_folder, stored
from factloom.llm.textarrays import mix64, row_bounds, slices, utf8, word_hashes, words

START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
SHARD_BYTES = 12 << 20  # of training text for each shard
FLUSH_TOKENS = 2 << 20  # counted together before they are shuffled


def pair_keys(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix64(u + mix64(w))


def tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts in order, each text closed by ``END``, and the bounds of the texts."""
    data, ends = utf8(batch.column("text"))
    starts, stops, rows = words(data, ends)
    bounds = row_bounds(rows, len(ends) - 1)
    return np.insert(word_hashes(data, starts, stops), bounds[1:], END), bounds + np.arange(len(bounds))


def contexts(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The token before each token, ``START`` at the first of a text."""
    before = np.empty_like(hashes)
    before[1:] = hashes[:-1]
    before[bounds[:-1]] = START
    return before


def added_up(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct sorted keys and the sum of each count."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, dtype=np.int64)
    return (keys[first], *(np.add.reduceat(c[order], first) if len(first) else c[:0] for c in counts))


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)


def _small(values: np.ndarray) -> bytes:
    return zlib.compress(values.astype(U32).tobytes(), 1)


def _wide(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), dtype=U32).astype(np.int64)


def _u64(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=U64)


# ---- counting -------------------------------------------------------------------------------------------------------

_WORDS = "shard long, kind int, keys binary, counts binary, more binary"
_WORDS_ARROW = pa.schema(
    [("shard", pa.int64()), ("kind", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("more", pa.binary())]
)
WORD_COUNTS, BEFORE, HEAVY, TOTALS = 0, 1, 2, 3  # kinds of rows


def _row(shard: int, kind: int, keys: np.ndarray, counts: np.ndarray, more: bytes | None = None) -> dict:
    return {"shard": shard, "kind": kind, "keys": keys.astype(U64).tobytes(), "counts": _small(counts), "more": more}


def _by_shard(keys: np.ndarray, counts: np.ndarray, shards: int, kind: int) -> list[dict]:
    shard = _shard(keys, shards)
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    return [_row(s, kind, keys[order[a:b]], counts[order[a:b]]) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tokens and contexts of the texts, about ``FLUSH_TOKENS`` at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for whole in batches:
        for batch in slices(whole, "text"):
            hashes, bounds = tokens(batch)
            held.append((hashes, contexts(hashes, bounds)))
            size += len(hashes)
            if size >= FLUSH_TOKENS:
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held, size = [], 0
    if size:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _count_words(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hashes, _ in _gather(batches):
            keys, counts = added_up(hashes, np.ones(len(hashes), dtype=np.int64))
            yield pa.RecordBatch.from_pylist(_by_shard(keys, counts, shards, WORD_COUNTS), schema=_WORDS_ARROW)

    return run


def _merge_words(table: pa.Table) -> pa.Table:
    keys = np.concatenate([_u64(x) for x in table.column("keys").to_pylist()])
    counts = np.concatenate([_wide(x) for x in table.column("counts").to_pylist()])
    keys, counts = added_up(keys, counts)
    return pa.Table.from_pylist([_row(table.column("shard")[0].as_py(), WORD_COUNTS, keys, counts)], schema=_WORDS_ARROW)


def _heavy(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                many = _u64(keys)[_wide(counts) >= least]
                yield pa.RecordBatch.from_pydict({"key": pa.array(many.view(np.int64), pa.int64())})

    return run


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [int(_wide(x).sum()) for x in batch.column("counts").to_pylist()]
        v = [len(x) // 8 for x in batch.column("keys").to_pylist()]
        yield pa.RecordBatch.from_pydict({"n": pa.array(n, pa.int64()), "v": pa.array(v, pa.int64())})


_PAIRS = "shard long, first binary, run binary, second binary, counts binary"
_PAIRS_ARROW = pa.schema([("shard", pa.int64()), *((n, pa.binary()) for n in ("first", "run", "second", "counts"))])


def _count_pairs(shards: int, heavy: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w, u in _gather(batches):
            key = pair_keys(u, w)
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            counts = np.diff(np.append(first, len(key)))
            u, w, key = u[order[first]], w[order[first]], key[first]
            shard = np.where(np.isin(u, heavy), _shard(key, shards), _shard(u, shards))
            order = np.lexsort((u, shard))
            u, w, counts, shard = u[order], w[order], counts[order], shard[order]
            cuts = np.searchsorted(shard, np.arange(shards + 1))
            rows = []
            for s in range(shards):
                a, b = cuts[s], cuts[s + 1]
                if a < b:
                    heads = a + np.flatnonzero(np.concatenate(([True], u[a + 1 : b] != u[a : b - 1])))
                    rows.append(
                        {
                            "shard": s,
                            "first": u[heads].astype(U64).tobytes(),
                            "run": _small(np.diff(np.append(heads, b))),
                            "second": w[a:b].astype(U64).tobytes(),
                            "counts": _small(counts[a:b]),
                        }
                    )
            yield pa.RecordBatch.from_pylist(rows, schema=_PAIRS_ARROW)

    return run


def _contexts_of(u: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each context: its count, and how many words follow it once, twice, more often."""
    one, two = (counts == 1).astype(np.int64), (counts == 2).astype(np.int64)
    return added_up(u, counts, one, two, 1 - one - two)


def _merge_pairs(folder: str, shards: int, heavy: np.ndarray):
    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        u = np.concatenate(
            [np.repeat(_u64(a), _wide(r)) for a, r in zip(table.column("first").to_pylist(), table.column("run").to_pylist(), strict=True)]
        )
        w = np.concatenate([_u64(x) for x in table.column("second").to_pylist()])
        counts = np.concatenate([_wide(x) for x in table.column("counts").to_pylist()])
        key = pair_keys(u, w)
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        counts = np.add.reduceat(counts[order], first)
        u, w, key = u[order[first]], w[order[first]], key[first]
        of_words = _contexts_of(u, counts)
        split = np.isin(of_words[0], heavy)
        write_arrays(
            f"{folder}/pairs-{shard}", [key, counts.astype(U32), of_words[0][~split], *(x[~split].astype(U32) for x in of_words[1:])]
        )
        before, n = added_up(w, np.ones(len(w), dtype=np.int64))
        rows = _by_shard(before, n, shards, BEFORE)
        parts = np.stack([x[split] for x in of_words[1:]]) if split.any() else np.zeros((4, 0), dtype=np.int64)
        for i, k in enumerate(of_words[0][split]):  # at most four a shard on average
            rows.append(_row(int(_shard(k[None], shards)[0]), HEAVY, k[None], parts[:, i]))
        rows.append(_row(shard, TOTALS, key[:0], np.array([(counts == k).sum() for k in (1, 2, 3, 4)])))
        return pa.Table.from_pylist(rows, schema=_WORDS_ARROW)

    return run


_SUMMARY = "kind int, key long, numbers array<long>"
_SUMMARY_ARROW = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("numbers", pa.list_(pa.int64()))])


def _finish_words(folder: str):
    """The words file of a shard; returns counts of counts (of pairs and of N) and the heavy contexts."""

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        kinds = table.column("kind").to_numpy()
        keys = [_u64(x) for x in table.column("keys").to_pylist()]
        counts = [_wide(x) for x in table.column("counts").to_pylist()]
        zero = [np.zeros(0, dtype=U64)], [np.zeros(0, dtype=np.int64)]
        own = [i for i, k in enumerate(kinds) if k in (WORD_COUNTS, BEFORE)]
        merged, c, n = added_up(
            np.concatenate(zero[0] + [keys[i] for i in own]),
            np.concatenate(zero[1] + [counts[i] if kinds[i] == WORD_COUNTS else 0 * counts[i] for i in own]),
            np.concatenate(zero[1] + [counts[i] if kinds[i] == BEFORE else 0 * counts[i] for i in own]),
        )
        write_arrays(f"{folder}/words-{shard}", [merged.astype(U64), c.astype(U64), n.astype(U32)])
        numbers = [int((n == k).sum()) for k in (1, 2, 3, 4)] + [int((n >= 3).sum()), int(n.sum())]
        rows = [{"kind": BEFORE, "key": 0, "numbers": numbers}]
        rows += [{"kind": TOTALS, "key": 0, "numbers": counts[i].tolist()} for i in np.flatnonzero(kinds == TOTALS)]
        heavy: dict[int, np.ndarray] = {}
        for i in np.flatnonzero(kinds == HEAVY):
            heavy[int(keys[i][0])] = heavy.get(int(keys[i][0]), 0) + counts[i]
        rows += [{"kind": HEAVY, "key": int(np.uint64(k).view(np.int64)), "numbers": x.tolist()} for k, x in heavy.items()]
        return pa.Table.from_pylist(rows, schema=_SUMMARY_ARROW)

    return run


def discounts(n: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2, 3+, from the numbers of things counted 1, 2, 3 and 4 times."""
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    steps = [(1, n2, n1), (2, n3, n2), (3, n4, n3)]
    return np.array([0.0] + [min(max(k - (k + 1) * y * (up / at), 0.0), float(k)) if at else 0.5 * k for k, up, at in steps])


class Model:
    """What a worker needs to score texts: the folder with the shards, and numbers that don't grow with the corpus."""

    def __init__(self, folder: str, shards: int, n: int, v: int, summary: list):
        self.folder, self.shards, self.n, self.v = folder, shards, n, v
        pairs = sum((np.array(r.numbers) for r in summary if r.kind == TOTALS), np.zeros(4))
        before = sum((np.array(r.numbers) for r in summary if r.kind == BEFORE), np.zeros(6))
        heavy = sorted((int(np.int64(r.key).view(np.uint64)), r.numbers) for r in summary if r.kind == HEAVY)
        self.heavy = np.array([k for k, _ in heavy], dtype=np.uint64)
        self.heavy_numbers = np.array([x for _, x in heavy], dtype=np.int64).reshape(len(heavy), 4)
        self.d, self.e = discounts(pairs), discounts(before[:4])
        self.different = float(before[5])
        spare = float(self.e[1] * before[0] + self.e[2] * before[1] + self.e[3] * before[4])
        self.floor = spare / self.different / (v + 1) if self.different else 1.0 / (v + 1)

    def _look_up(self, kind: str, keys: np.ndarray, shard: np.ndarray, at: int, columns: list[int]) -> list[np.ndarray]:
        """Values of sorted distinct ``keys`` in the array ``at`` of their shard; 0 where a key is missing."""
        out = [np.zeros(len(keys), dtype=np.int64) for _ in columns]
        order = np.argsort(shard, kind="stable")  # keys stay sorted inside a shard
        cuts = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(cuts)):
            held = arrays(f"{self.folder}/{kind}-{s}")
            if held is None or not len(held[at]):
                continue
            own = order[cuts[s] : cuts[s + 1]]
            place = np.minimum(np.searchsorted(held[at], keys[own]), len(held[at]) - 1)
            hit = held[at][place] == keys[own]
            for values, column in zip(out, columns, strict=True):
                values[own[hit]] = held[column][place[hit]]
        return out

    def word_counts(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """c(w) and N(w) of sorted distinct words."""
        c, n = self._look_up("words", w, _shard(w, self.shards), 0, [1, 2])
        return c, n

    def context_counts(self, u: np.ndarray) -> np.ndarray:
        """c(u), n1(u), n2(u), n3+(u) of sorted distinct contexts, a row each."""
        found = np.stack(self._look_up("pairs", u, _shard(u, self.shards), 2, [3, 4, 5, 6]), axis=1)
        if len(self.heavy):
            place = np.minimum(np.searchsorted(self.heavy, u), len(self.heavy) - 1)
            hit = self.heavy[place] == u
            found[hit] = self.heavy_numbers[place[hit]]
        return found

    def pair_counts(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        key = pair_keys(u, w)
        distinct, at, back = np.unique(key, return_index=True, return_inverse=True)
        first = u[at]
        shard = np.where(np.isin(first, self.heavy), _shard(distinct, self.shards), _shard(first, self.shards))
        return self._look_up("pairs", distinct, shard, 0, [1])[0][back]

    def log10(self, u: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 P(w | u) and the training count of w, for aligned contexts and words."""
        known, back = np.unique(w, return_inverse=True)
        c, before = self.word_counts(known)
        lower = np.maximum(before - self.e[np.minimum(before, 3)], 0) / max(self.different, 1.0) + self.floor
        lower, c = lower[back], c[back]
        seen, place = np.unique(u, return_inverse=True)
        of = self.context_counts(seen).astype(np.float64)
        total, spare = of[:, 0][place], (of[:, 1:] @ self.d[1:])[place]
        pair = self.pair_counts(u, w)
        p = (np.maximum(pair - self.d[np.minimum(pair, 3)], 0) + spare * lower) / np.maximum(total, 1)
        return np.log10(np.where(total > 0, p, lower)), c


def train(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> Model:
    """The model of all texts of ``docs(text)``."""
    spark = docs.sparkSession
    docs = docs.select("text")
    folder = shared_folder(spark, "ngrams")
    make_folder(folder)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(4, -(-size // shard_bytes))
    counted = docs.mapInArrow(_count_words(shards), _WORDS).groupBy("shard").applyInArrow(_merge_words, _WORDS)
    counted = stored(counted, "words")
    sums = counted.mapInArrow(_totals, "n long, v long").agg(F.sum("n"), F.sum("v")).first()
    n, v = sums[0] or 0, sums[1] or 0
    least = max(1000, n // (4 * shards))
    heavy = counted.mapInArrow(_heavy(least), "key long").collect()  # fewer than 4 * shards rows
    many = np.sort(np.array([r.key for r in heavy] + [int(START)], dtype=np.int64).view(np.uint64))
    pairs = docs.mapInArrow(_count_pairs(shards, many), _PAIRS).groupBy("shard").applyInArrow(_merge_pairs(folder, shards, many), _WORDS)
    summary = pairs.unionByName(counted).groupBy("shard").applyInArrow(_finish_words(folder), _SUMMARY).collect()
    mark_complete(folder)
    return Model(folder, shards, n, v, summary)


def _score(model: Model, names: list[str]):
    base = np.log10(model.n + 0.1 * (model.v + 1)) if model.n else np.log10(0.1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                w, bounds = tokens(batch)
                score, c = model.log10(contexts(w, bounds), w)
                sums = [np.add.reduceat(x, bounds[:-1]) for x in (np.log10(c + 0.1) - base, score, (c > 0).astype(np.int64))]
                new = [np.diff(bounds), sums[2], np.full(batch.num_rows, model.n), sums[0], sums[1]]
                kept = [batch.column(x) for x in names]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(x) for x in new)], names=[*names, *_SCORES])

    return run


_SCORES = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of ``docs(doc_id, held_out, text)``.

    Scores are sums of log10 probabilities over all tokens of a text, the end included; perplexity is
    ``10 ** (-score / n_tokens)``. A null text is an empty one, with the end as its only token.
    """
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text")
    return rows.mapInArrow(_score(model, ["doc_id", "held_out"]), schema)


def score_held_out(docs: DataFrame, folds: int = 10) -> DataFrame:
    """Every row of ``docs(doc_id, text)`` scored by a model of the rows outside fold 0 (``crc32`` of the id modulo ``folds``).

    A null id is taken as an empty string, so it is held out. Rows that repeat an id all count. Other columns are not read.
    """
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds
    docs = docs.select("doc_id", "text", (fold == 0).alias("held_out"))
    return score(docs, train(docs.filter("NOT held_out")))
