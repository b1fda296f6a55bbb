"""MinHash near-duplicates with sequential Bayesian verification.

A document's set holds its distinct five-word shingles (64-bit hashes; a text of fewer words is one shingle, a text
without words has none). Two documents are linked when ``100 * |A & B| >= 75 * |A | B|``, always decided on full sets.

1. One pass over the texts gives set size, set digest and the keys of 32 bands of four MinHash values.
   Documents with the same digest are one class, represented by the smallest id.
2. Classes that share a band key are candidates; only their texts are read again, for all 512 values of their
   signatures and their full sets. The signatures of a pair are compared in batches of 64 values; after
   each batch the pair is dropped once the posterior probability of similarity 0.75 or more, given the matches so
   far and a flat prior, is below ``MISS``. Survivors are verified on full sets.
3. First every class is tried with the heaviest class of each of its bands: one pair per row, whatever the size of
   the band. Links found so give components. Then the bands that still hold several components are compared inside
   tasks, in blocks of 256 classes by 256, for pairs of different components only: by signatures, then, for the classes
   with a survivor, on full sets. Pairs inside a component need no test, and no task returns more rows than it has read,
   so a group of thousands of copies is never expanded into pairs.

A pair at similarity 0.75 shares a band with probability 1 - 5e-6; the posterior bound may cost up to ``MISS`` per test.

Rows with a null id are linked with nothing; null or blank texts have an empty set. Rows that repeat an id are one
document and get a row each. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.components import components
from factloom.llm.groups import in_block_pairs, whole_groups
from factloom.llm.mapped import SharedSet, shared_set
from factloom.llm.storage import stored
from factloom.llm.textarrays import mix64, row_bounds, slices, utf8, word_hashes, words

SHINGLE = 5
VALUES, STEP = 512, 64
BANDS, ROWS = 32, 4
MISS = 1e-4
BLOCK = 256

_random = np.random.default_rng(20240229)
_MULTIPLY = (_random.integers(0, 1 << 32, VALUES, dtype=np.uint32) | np.uint32(1))
_ADD = _random.integers(0, 1 << 32, VALUES, dtype=np.uint32)
_PLACES = mix64(np.arange(1, SHINGLE + 2, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(data: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    starts, stops, rows = words(data, ends)
    hashes = word_hashes(data, starts, stops)
    bounds = row_bounds(rows, len(ends) - 1)
    total = np.zeros(max(0, len(hashes) - SHINGLE + 1), dtype=np.uint64)
    for k in range(SHINGLE):
        total += hashes[k : len(total) + k] * _PLACES[k]
    total = mix64(total)
    out = []
    for first, last in zip(bounds[:-1], bounds[1:], strict=True):
        if last - first >= SHINGLE:
            own = np.sort(total[first : last - SHINGLE + 1])
            own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif last > first:  # fewer words than a shingle: all of them, apart from longer shingles by a mark of its own
            few = np.append(hashes[first:last] * _PLACES[: last - first], _PLACES[SHINGLE:] * np.uint64(last - first))
            own = mix64(few.sum(dtype=np.uint64, keepdims=True))
        else:
            own = total[:0]
        out.append(own)
    return out


def signature(shingles: np.ndarray, values: int = VALUES) -> np.ndarray:
    """The first ``values`` MinHash values of a set that isn't empty."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)[:, None]
    least = np.full(values, np.iinfo(np.uint32).max, dtype=np.uint32)
    rows = (1 << 16) // values  # a block stays in the cache of its core
    block = np.empty((min(rows, len(low)), values), dtype=np.uint32)
    for at in range(0, len(low), rows):
        part = low[at : at + rows]
        own = block[: len(part)]
        np.multiply(part, _MULTIPLY[:values], out=own)
        own += _ADD[:values]
        np.minimum(least, own.min(axis=0), out=least)
    return least


_FEATURES = "doc_id long, n_shingles long, digest binary, bands array<long>"


def _digests(sets: list[np.ndarray]) -> pa.Array:
    return pa.array([blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary())


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    none = np.zeros(BANDS * ROWS, dtype=np.uint32)
    for whole in batches:
        for batch in slices(whole, "text"):
            sets = shingle_sets(*utf8(batch.column("text")))
            values = np.stack([signature(s, BANDS * ROWS) if len(s) else none for s in sets])
            wide = values.reshape(len(sets), BANDS, ROWS).astype(np.uint64)
            keys = (wide * _PLACES[:ROWS]).sum(axis=2, dtype=np.uint64) + _PLACES[-1] * np.arange(BANDS, dtype=np.uint64)
            keys = mix64(keys).view(np.int64)
            full = np.array([len(s) > 0 for s in sets])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    _digests(sets),
                    pa.ListArray.from_arrays(
                        pa.array(np.concatenate(([0], np.cumsum(full * keys.shape[1]))), pa.int32()),
                        pa.array(keys[full].ravel(), pa.int64()),
                    ),
                ],
                names=["doc_id", "n_shingles", "digest", "bands"],
            )


def _prune_bounds(threshold: float, miss: float) -> list[int]:
    """For each batch end n: the most matches among n values at which a pair is dropped."""
    low_byte = threshold + (1 - threshold) / 256  # low bytes also agree by chance
    out = []
    for n in range(STEP, VALUES + 1, STEP):
        tail, most = 0.0, -1  # P(similarity >= t | m matches of n) = P(Binomial(n + 1, t) <= m)
        for m in range(n + 1):
            tail += math.comb(n + 1, m) * low_byte**m * (1 - low_byte) ** (n + 1 - m)
            if tail >= miss:
                break
            most = m
        out.append(most)
    return out


def _plausible(a: np.ndarray, b: np.ndarray, bounds: list[int]) -> np.ndarray:
    """Rows at which the sketches ``a`` and ``b`` may belong to linked sets; compares batch after batch."""
    alive = np.arange(len(a))
    matches = np.zeros(len(a), dtype=np.int64)
    for step, most in enumerate(bounds):
        part = slice(step * STEP, (step + 1) * STEP)
        matches = matches + (a[alive, part] == b[alive, part]).sum(axis=1)
        keep = matches > most
        alive, matches = alive[keep], matches[keep]
    return alive


def _sketches(column: pa.Array) -> np.ndarray:
    data, _ = utf8(column)
    return data.reshape(-1, VALUES)


def _prune_pairs(bounds: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keep = _plausible(_sketches(batch.column("sketch_a")), _sketches(batch.column("sketch_b")), bounds)
                yield batch.select(["a", "b"]).take(pa.array(keep))

    return run


_GROUP = ["key", "lo", "hi"]


def _block_pairs(table: pa.Table, s: int, e: int, sketch: np.ndarray, bounds: list[int], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of a group that may be links: of different components and, in a pair of blocks, one from each."""
    comp, block, size = (table.column(c).to_numpy()[s:e] for c in ("component", "block", "n_shingles"))
    i, j = np.triu_indices(e - s, 1)
    ok = comp[i] != comp[j]
    if table.column("lo")[s] != table.column("hi")[s]:
        ok &= block[i] != block[j]
    ok &= 100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j])
    i, j = i[ok], j[ok]
    keep = _plausible(sketch[s:e][i], sketch[s:e][j], bounds)
    return i[keep], j[keep]


def _plausible_members(bounds: list[int], percent: int):
    """Rows sorted by group: those that are in a plausible pair of their group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in whole_groups(batches, _GROUP):
            table = table.combine_chunks()
            sketch = _sketches(table.column("sketch"))
            keep = np.zeros(table.num_rows, dtype=bool)
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                for side in _block_pairs(table, s, e, sketch, bounds, percent):
                    keep[s + side] = True
            yield from table.select([*_GROUP, "node", "component", "block"]).filter(pa.array(keep)).to_batches()

    return run


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) < len(b):
        a, b = b, a
    return int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum()) if len(b) else 0


def _verified_links(bounds: list[int], percent: int):
    """Rows sorted by group, with shingles: links between components that full sets confirm.

    A pair that shares several bands is tested in the first; components that a link joins are one from then on, so the
    links of a group are fewer than its rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in whole_groups(batches, _GROUP):
            table = table.combine_chunks()
            key, node, comp = (table.column(c).to_numpy() for c in ("key", "node", "component"))
            sketch = _sketches(table.column("sketch"))
            bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
            ends, flat = table.column("shingles").combine_chunks().offsets.to_numpy(), table.column("shingles").combine_chunks().values.to_numpy()
            sets = [flat[x:y].view(np.uint64) for x, y in zip(ends[:-1], ends[1:], strict=True)]
            found: list[tuple[int, int]] = []
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                i, j = _block_pairs(table, s, e, sketch, bounds, percent)
                i, j = i + s, j + s
                same = bands[i] == bands[j]
                here = bands[i, same.argmax(axis=1)] == key[i] if len(i) else same[:, 0]
                i, j = i[here], j[here]
                likely = np.argsort(-(sketch[i] == sketch[j]).sum(axis=1), kind="stable")
                head: dict[int, int] = {}
                for a, b in zip(i[likely].tolist(), j[likely].tolist(), strict=True):
                    x, y = int(comp[a]), int(comp[b])
                    while head.get(x, x) != x:
                        x = head[x]
                    while head.get(y, y) != y:
                        y = head[y]
                    if x != y:
                        common = _common(sets[a], sets[b])
                        if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                            head[max(x, y)] = min(x, y)
                            found.append((int(node[a]), int(node[b])))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def _candidates(wanted: SharedSet):
    """Digest, sketch and shingles of the wanted documents; the low byte of each MinHash value is enough to compare."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            ids = whole.column("doc_id")
            whole = whole.filter(pa.array(wanted.has(ids.fill_null(0).to_numpy()) & ids.is_valid().to_numpy(zero_copy_only=False)))
            for batch in slices(whole, "text"):
                sets = shingle_sets(*utf8(batch.column("text")))
                full = pa.array([len(s) > 0 for s in sets], pa.bool_())
                sets = [s for s in sets if len(s)]
                ends = np.cumsum([0, *map(len, sets)])
                flat = np.concatenate([np.zeros(0, dtype=np.uint64), *sets]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").filter(full),
                        _digests(sets),
                        pa.array([signature(s).astype(np.uint8).tobytes() for s in sets], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
                    ],
                    names=["node", "digest", "sketch", "shingles"],
                )

    return run


def candidates_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """``(node, digest, sketch, shingles)`` of the documents whose id is in the only column of ``ids``.

    The ids are a set that workers map, so no text is shuffled.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "node long, digest binary, sketch binary, shingles array<long>"
    return texts.mapInArrow(_candidates(shared_set(ids, "candidates")), schema)


def verify(pairs: DataFrame, sets: DataFrame, percent: int = 75) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets in ``sets(node, shingles)`` fulfil ``100 * intersection >= percent * union``.

    The pairs of a hot ``a`` are dealt over several tasks; its set is sent once to each.
    """
    pairs = pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(1 << 20)))
    busy = pairs.groupBy("a").agg(F.ceil(F.count("*") / 64).alias("parts"))
    pairs = pairs.join(busy, "a").select("a", "b", F.pmod("part", "parts").alias("part"))
    right = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    left = pairs.select("a", "part").distinct().join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    return (
        right.join(left, ["a", "part"])
        .select("a", "b", common.alias("common"), (F.size("sa") + F.size("sb")).cast("long").alias("both"))
        .filter(100 * F.col("common") >= percent * (F.col("both") - F.col("common")))
        .select("a", "b")
    )


def near_duplicates(docs: DataFrame, percent: int = 75, miss: float = MISS) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs(doc_id, text)``; see the module."""
    bounds = _prune_bounds(percent / 100, miss)
    feats = stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_features, _FEATURES), "features")
    full = feats.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = full.groupBy("digest").agg(F.min("doc_id").alias("node"), F.count("*").alias("weight"))
    reps = (
        full.join(classes, "digest")
        .filter("doc_id = node")
        .dropDuplicates(["digest", "node"])
        .select("node", "digest", "weight", "n_shingles", "bands")
    )
    reps = stored(reps, "classes")
    member = reps.select("node", "weight", F.explode("bands").alias("key"))
    shared = member.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    member = stored(member.join(shared, "key"), "bands")
    found = stored(candidates_of(member.select("node").distinct(), docs), "candidates")
    sets = found.select("node", "shingles")
    sketch = found.select("node", "digest", "sketch").dropDuplicates(["node", "digest"])
    sketch = stored(sketch.join(reps.select("node", "digest", "n_shingles", "bands"), ["node", "digest"]).drop("digest"), "sketches")

    # every class with the heaviest class of its band
    hub = member.groupBy("key").agg(F.max(F.struct("weight", (-F.col("node")).alias("minus"))).alias("top"))
    hub = hub.select("key", (-F.col("top.minus")).alias("hub"))
    a, b = F.least("hub", "node"), F.greatest("hub", "node")
    first = member.join(hub, "key").filter("hub <> node").select(a.alias("a"), b.alias("b")).distinct()
    first = (
        first.join(sketch.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("sketch").alias("sketch_a")), "a")
        .join(sketch.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("sketch_b")), "b")
        .filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        .select("a", "b", "sketch_a", "sketch_b")
        .mapInArrow(_prune_pairs(bounds), "a long, b long")
    )
    links = stored(verify(stored(first, "pairs"), sets, percent), "links")
    found = components(links)

    # bands that still hold several components
    member = member.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_bands = member.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y")
    member = member.join(open_bands.select("key"), "key", "left_semi").select("key", "node", "component", "n")
    member = member.join(sketch.select("node", "n_shingles", "sketch"), "node")
    maybe = (
        in_block_pairs(member, "node", "n", BLOCK)
        .select(*_GROUP, "node", "component", "block", "n_shingles", "sketch")
        .repartition(*_GROUP)
        .sortWithinPartitions(*_GROUP)
        .mapInArrow(_plausible_members(bounds, percent), "key long, lo long, hi long, node long, component long, block long")
    )
    maybe = stored(maybe, "members")
    sets = sets.join(maybe.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
    more = (
        maybe.join(sets.join(sketch, "node"), "node")
        .select(*_GROUP, "node", "component", "block", "n_shingles", "sketch", "bands", "shingles")
        .repartition(*_GROUP)
        .sortWithinPartitions(*_GROUP)
        .mapInArrow(_verified_links(bounds, percent), "a long, b long")
    )
    more = stored(more, "links")
    merged = components(links.unionByName(more))

    groups = reps.select("node").join(merged, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    ids = full.select("doc_id", "digest").join(classes.select("digest", "node"), "digest").join(groups, "node")
    # the smallest id of a component is the smallest of its classes' representatives
    ids = ids.select("doc_id", F.col("component").alias("component_id")).distinct()
    out = feats.select("doc_id", "n_shingles").join(ids, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id. Columns stay as they are."""
    gone = near_duplicates(docs, percent).filter("NOT kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
