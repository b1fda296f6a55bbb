"""Near-duplicate vectors by cross-polytope hashing.

Vectors are compared only within a label. In each of ``TABLES`` tables a vector is rotated twice by fast Hadamard
rotations (three rounds of random signs and Hadamard transform); the nearest corner of the cross-polytope, that is
the largest coordinate with its sign, is a hash value. Multiprobe: the two nearest corners of both rotations give four
buckets a table. Vectors that share a bucket are candidates, and every candidate's cosine is computed in double precision.
At cosine 0.93 a pair meets in a table with probability 0.77 and in one of eight tables with 1 - 7e-6; closer pairs more.

Equal vectors are one class, which is hashed and compared once with its number of rows as weight. The
members of a bucket are dealt into blocks of ``BLOCK``; any two blocks are compared in one task by a matrix product, which
returns counts and one component pointer per vector, never pairs. A pair that meets in several buckets counts in the first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from factloom.llm.components import components
from factloom.llm.groups import in_block_pairs, whole_groups
from factloom.llm.storage import stored
from factloom.llm.textarrays import mix64

TABLES, BLOCK, SEED = 8, 64, 8086
_GROUP = ["key", "lo", "hi"]


def usable(vector: str) -> F.Column:
    """Not null, without null or non-finite components, and not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column as rows of doubles; shorter rows end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = int(lengths.max()) if len(lengths) else 0
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Hadamard transform of every row, by butterflies; the width is a power of two."""
    half = 1
    while half < x.shape[1]:
        pairs = x.reshape(len(x), -1, 2, half)
        x = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], axis=2).reshape(len(x), -1)
        half *= 2
    return x


def corners(x: np.ndarray, tables: int = TABLES) -> np.ndarray:
    """``(rows, tables, 2, 2)``: for both rotations of a table the two nearest corners, the smaller number first."""
    width = 1 << max(0, x.shape[1] - 1).bit_length()
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    signs = np.random.default_rng(SEED).choice([-1.0, 1.0], (tables, 2, 3, width))
    out = np.empty((len(x), tables, 2, 2), dtype=np.int32)
    for t in range(tables):
        for r in range(2):
            y = x
            for round_signs in signs[t, r]:
                y = hadamard(y * round_signs)
            near = np.argsort(-np.abs(y), axis=1, kind="stable")[:, : min(2, width)]
            near = np.pad(near, ((0, 0), (0, 2 - near.shape[1])), mode="edge")
            out[:, t, r] = np.sort(2 * near + (np.take_along_axis(y, near, axis=1) > 0), axis=1)
    return out


def _bucket_keys(label: np.ndarray, code: np.ndarray) -> np.ndarray:
    """A key for each label, table, corner of the first rotation and corner of the second."""
    n, tables = code.shape[:2]
    wide = code.astype(np.uint64)
    key = mix64(label.astype(np.int64).view(np.uint64))[:, None, None, None] + np.arange(tables, dtype=np.uint64)[None, :, None, None]
    key = mix64(mix64(key) + wide[:, :, 0, :, None])
    return mix64(key + (wide[:, :, 1, None, :] << np.uint64(32))).reshape(n, -1).view(np.int64)


def _hash(tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            code = corners(matrix(batch.column("vector")), tables)
            keys = _bucket_keys(batch.column("label").to_numpy(zero_copy_only=False), code)
            keys = [np.unique(k) for k in keys]
            ends = np.concatenate(([0], np.cumsum([len(k) for k in keys])))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys), pa.int64()))
            codes = pa.array([c.tobytes() for c in code], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("node", "label", "weight", "vector")), codes, lists],
                names=["node", "label", "weight", "vector", "codes", "keys"],
            )

    return run


def _first_bucket(a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Key of the first bucket that each pair of code rows shares: first table, then smallest common corners."""
    same = a[:, :, :, :, None] == b[:, :, :, None, :]
    common = np.where(same.any(axis=4), a, np.iinfo(np.int32).max).min(axis=3)  # (pairs, tables, rotations)
    table = (common < np.iinfo(np.int32).max).all(axis=2).argmax(axis=1)
    corner = common[np.arange(len(a)), table].astype(np.uint64)
    key = mix64(label.astype(np.int64).view(np.uint64)) + table.astype(np.uint64)
    return mix64(mix64(mix64(key) + corner[:, 0]) + (corner[:, 1] << np.uint64(32))).view(np.int64)


def _compare(threshold: float, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in whole_groups(batches, _GROUP):
            node, label, weight, block, key, lo, hi = (
                table.column(c).to_numpy() for c in ("node", "label", "weight", "block", "key", "lo", "hi")
            )
            vector = matrix(table.column("vector"))
            unit = vector / np.abs(vector).max(axis=1, keepdims=True)  # first to a size whose square is finite
            unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
            codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), dtype=np.int32).reshape(len(node), tables, 2, 2)
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                i, j = np.nonzero(np.triu(unit[s:e] @ unit[s:e].T >= threshold, 1))
                i, j = i + s, j + s
                ok = label[i] == label[j]
                if lo[s] != hi[s]:
                    ok &= block[i] != block[j]
                i, j = i[ok], j[ok]
                ok = _first_bucket(codes[i], codes[j], label[i]) == key[s] if len(i) else ok[:0]
                i, j = i[ok], j[ok]
                if not len(i):
                    continue
                linked = np.zeros((e - s, e - s), dtype=bool)
                linked[i - s, j - s] = linked[j - s, i - s] = True
                links = linked @ weight[s:e]
                head = node[s:e].copy()
                while True:  # the smallest node within reach, for each node
                    near = np.where(linked, head[None, :], np.iinfo(np.int64).max).min(axis=1)
                    if not (near < head).any():
                        break
                    head = np.minimum(head, near)
                some = linked.any(axis=1)
                out.append((node[s:e][some], links[some], head[some]))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x), pa.int64()) for x in zip(*out, strict=True)], names=["node", "links", "head"]
                )

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.93, tables: int = TABLES) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors(vec_id, embedding, label)``.

    Rows with a null label or id, and vectors that are null, zero or hold null or non-finite components, link with
    nothing. Labels are of any type that can be compared. Rows that repeat an id or a vector are vectors of their own and count as links. Other columns are not read.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), "label", F.col("embedding").alias("vector"))
    if isinstance(rows.schema["label"].dataType, IntegralType):
        rows = rows.withColumn("label", F.col("label").cast("long"))
    else:  # labels need only be equal: others are numbered
        numbers = rows.select("label").dropna().distinct().withColumn("number", F.monotonically_increasing_id())
        rows = rows.join(stored(numbers, "labels"), "label", "left").select("vec_id", F.col("number").alias("label"), "vector")
    part = rows.filter("label IS NOT NULL AND vec_id IS NOT NULL").filter(usable("vector"))
    classes = part.groupBy("label", "vector").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight"))
    classes = stored(classes, "classes")
    kind = classes.schema["vector"].dataType.simpleString()
    hashed = classes.mapInArrow(_hash(tables), f"node long, label long, weight long, vector {kind}, codes binary, keys array<long>")
    hashed = stored(hashed, "hashes")
    member = hashed.select("node", F.explode("keys").alias("key"))
    shared = member.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    member = in_block_pairs(member.join(shared, "key").select("key", "node", "n"), "node", "n", BLOCK)
    found = (
        member.join(hashed.drop("keys"), "node")
        .select(*_GROUP, "block", "node", "label", "weight", "vector", "codes")
        .repartition(*_GROUP)
        .sortWithinPartitions(*_GROUP)
        .mapInArrow(_compare(threshold, tables), "node long, links long, head long")
    )
    found = stored(found, "links")
    groups = components(found, "node", "head")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    own = (
        classes.select("label", "vector", "node", "weight")
        .join(counts, "node", "left")
        .join(groups, "node", "left")
        .select(
            "label",
            "vector",
            (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            F.coalesce("component", "node").alias("component_id"),
        )
    )
    linked = part.select("vec_id", "label", "vector").join(own, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(F.col("label").isNull() | F.col("vec_id").isNull() | ~usable("vector")).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return linked.unionByName(alone).withColumn("kept", F.col("component_id").eqNullSafe(F.col("vec_id")))
