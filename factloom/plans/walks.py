"""Reachability as walks inside of tasks, over edges that all workers map from the shared folder.

Nodes are numbered densely, and the edges lie in files by ranges of these numbers. A task takes a few starts at a time and steps from their newest
pairs of start and node to the next ones, as arrays of numbers, and writes what it found. So a pair is never shuffled,
looked up in another table or copied from round to round; it takes its place in the result and nothing else. If the pairs of a few starts
become many, their starts are taken apart and finish one part after the other. Nodes named by text are stored as numbers, and named when read.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from io import BytesIO
from itertools import accumulate
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from factloom.plans.lineage import cut_lineage, ensure_checkpoint_dir

#: Starts that walk together, pairs from which on they are taken apart, and rows that are handed over at once.
TOGETHER, PAIRS, ROWS = 1024, 1 << 22, 1 << 16


def _number(column: str, offsets: list[int]) -> F.Column:
    """A dense number from ``monotonically_increasing_id``, whose upper bits name the partition."""
    first = F.create_map(*[F.lit(x).cast("long") for kv in enumerate(offsets) for x in kv])
    return first[F.shiftright(column, 33).cast("long")] + F.col(column).bitwiseAND((1 << 33) - 1)


def _files(folder: str):
    """``save(name, array)`` and ``load(name)`` of a shared folder, for tasks: files come into place at once, and are mapped on a mounted file system.

    These and the functions below travel inside of closures, so that workers need no path to this package.
    """
    parsed = urlparse(folder)
    local = parsed.path if parsed.scheme in ("", "file") else None
    uri = "s3" + folder[3:] if parsed.scheme in ("s3a", "s3n") else folder  # Spark's names of what Arrow calls s3
    held: dict[str, np.ndarray] = {}

    def save(name: str, array: np.ndarray) -> None:
        if local is None:
            store, path = fs.FileSystem.from_uri(uri)
            data = BytesIO()
            np.save(data, array)
            with store.open_output_stream(f"{path}/{name}.npy") as out:
                out.write(data.getvalue())
            return
        os.makedirs(local, exist_ok=True)
        part = f"{local}/{name}.{uuid.uuid4().hex}"
        with open(part, "wb") as out:
            np.save(out, array)
        os.replace(part, f"{local}/{name}.npy")

    def load(name: str) -> np.ndarray:
        if name not in held:
            if local is not None:
                held[name] = np.load(f"{local}/{name}.npy", mmap_mode="r")
            else:
                store, path = fs.FileSystem.from_uri(uri)
                with store.open_input_stream(f"{path}/{name}.npy") as stream:
                    held[name] = np.load(BytesIO(stream.read()))
        return held[name]

    return save, load


def _writers(folder: str, offsets: list[int], text: bool):
    """Functions of the rows of one shard that write its names, and its edges by node."""
    save, _ = _files(folder)

    def names(rows: pa.Table) -> pa.Table:
        shard = rows.column("shard")[0].as_py()
        held = rows.sort_by("_id").column("node").combine_chunks()
        if text:
            coded = [x.encode() for x in held.to_pylist()]
            save(f"first-{shard}", np.cumsum([0, *map(len, coded)], dtype=np.int64))
            save(f"names-{shard}", np.frombuffer(b"".join(coded), dtype=np.uint8))
        else:
            save(f"names-{shard}", held.cast(pa.int64()).to_numpy(zero_copy_only=False))
        return pa.table({"shard": pa.array([shard], pa.int32())})

    def edges(rows: pa.Table) -> pa.Table:
        shard = rows.column("shard")[0].as_py()
        node = rows.column("node").to_numpy() - offsets[shard]
        order = np.argsort(node, kind="stable")
        save(f"low-{shard}", np.searchsorted(node[order], np.arange(offsets[shard + 1] - offsets[shard] + 1)).astype(np.int64))
        save(f"next-{shard}", rows.column("next").to_numpy()[order])
        return pa.table({"shard": pa.array([shard], pa.int32())})

    return names, edges


def _walker(folder: str, offsets: list[int], text: bool, live: set[int], max_rounds: int | None, together: int, most: int):
    """Functions of batches: of the numbers of starts, which gives ``(start, node, hops)`` as numbers, or values if these are numbers; and of
    such rows of numbers, which gives their names. The shards ``live`` have edges."""
    _, load = _files(folder)
    first, nodes = np.array(offsets), offsets[-1]

    def by_shard(numbers: np.ndarray):
        shard = np.searchsorted(first, numbers, side="right") - 1
        for s in np.unique(shard).tolist():
            at = np.flatnonzero(shard == s)
            yield s, at, numbers[at] - first[s]

    def step(pairs: np.ndarray) -> np.ndarray:  # the pairs one edge further, each once and in order
        found = [pairs[:0]]
        for s, at, local in by_shard(pairs % nodes):
            if s in live:
                low, next_ = load(f"low-{s}"), load(f"next-{s}")
                n = low[local + 1] - low[local]
                inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                found.append(np.repeat(pairs[at] - pairs[at] % nodes, n) + next_[np.repeat(low[local], n) + inner])
        return np.unique(np.concatenate(found))

    def named(numbers: np.ndarray) -> pa.Array:
        parts, places = [], []
        for s, at, local in by_shard(numbers):
            held = load(f"names-{s}")
            if text:
                low = load(f"first-{s}")
                held = pa.LargeStringArray.from_buffers(len(low) - 1, pa.py_buffer(low), pa.py_buffer(held))
                parts.append(held.take(pa.array(local)).cast(pa.string()))
            else:
                parts.append(pa.array(held[local]))
            places.append(at)
        return parts[0] if len(parts) == 1 else pa.concat_arrays(parts).take(pa.array(np.argsort(np.concatenate(places))))

    def walk(starts: np.ndarray):  # (pairs, hops): a pair is the place of its start times the number of nodes, and its node
        own = np.arange(len(starts)) * nodes + starts
        todo = [(0, own, own)]
        while todo:
            hops, newest, known = todo.pop()
            while len(newest) and (max_rounds is None or hops < max_rounds):
                places = newest // nodes
                if len(known) > most and places[0] < places[-1]:
                    middle = (int(places[0]) + int(places[-1]) + 1) // 2 * nodes
                    cut, at = np.searchsorted(newest, middle), np.searchsorted(known, middle)
                    todo.append((hops, newest[cut:], known[at:].copy()))
                    newest, known = newest[:cut], known[:at].copy()
                    continue
                hops += 1
                found = step(newest)
                newest = found[known[np.minimum(np.searchsorted(known, found), len(known) - 1)] != found]
                known = np.sort(np.concatenate([known, newest]), kind="stable")
                yield newest, hops

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = np.sort(np.concatenate([np.zeros(0, dtype=np.int64), *[b.column(0).to_numpy() for b in batches]]))
        for group in range(0, len(asked), together):
            starts = asked[group : group + together]
            for pairs, hops in walk(starts):
                for i in range(0, len(pairs), ROWS):
                    part = pairs[i : i + ROWS]
                    say = pa.array if text else named
                    columns = [say(starts[part // nodes]), say(part % nodes), pa.array(np.full(len(part), hops, dtype=np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, names=["start", "node", "hops"])

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                columns = [named(b.column(c).to_numpy()) for c in ("start", "node")]
                yield pa.RecordBatch.from_arrays([*columns, b.column("hops")], names=["start", "node", "hops"])

    return run, name


def walk_all(step: DataFrame, starts: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """``(start, node, hops)`` over the edges ``step(node, next)`` from ``starts(start)``, each once, as ``plans.closure.reach`` says;
    all three columns are of one type, text or whole numbers, and no edge has a null or leads to its own node."""
    spark = step.sparkSession
    kind = step.schema["node"].dataType
    text = isinstance(kind, StringType)
    named = step.select("node").unionByName(step.select(F.col("next").alias("node"))).distinct()
    named = cut_lineage(named.withColumn("_id", F.monotonically_increasing_id()))
    sizes = {r["p"]: r["n"] for r in named.groupBy(F.shiftright("_id", 33).alias("p")).agg(F.count("*").alias("n")).collect()}
    offsets = list(accumulate((sizes.get(p, 0) for p in range(max(sizes, default=-1) + 1)), initial=0))
    nodes = offsets[-1]
    if not nodes:
        return starts.select("start", F.col("start").alias("node"), F.lit(0).alias("hops")).limit(0)
    ids = named.select("node", F.shiftright("_id", 33).cast("int").alias("shard"), _number("_id", offsets).alias("_id"))
    folder = f"{ensure_checkpoint_dir(spark)}/walks-{uuid.uuid4().hex}"
    write_names, write_edges = _writers(f"{folder}/graph", offsets, text)
    ids.groupBy("shard").applyInArrow(write_names, "shard int").collect()
    near = ids.select("node", "shard", F.col("_id").alias("_node"))
    far = ids.select(F.col("node").alias("next"), F.col("_id").alias("_next"))
    dealt = step.join(near, "node").join(far, "next").select("shard", F.col("_node").alias("node"), F.col("_next").alias("next"))
    live = {r["shard"] for r in dealt.groupBy("shard").applyInArrow(write_edges, "shard int").collect()}
    run, name = _walker(f"{folder}/graph", offsets, text, live, max_rounds, TOGETHER, PAIRS)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = starts.withColumnRenamed("start", "node").join(ids.select("node", "_id"), "node").select("_id").repartition(tasks, "_id")
    found = asked.mapInArrow(run, "start long, node long, hops int")
    if text:  # stored as numbers; a reader names them where they are
        return cut_lineage(found).mapInArrow(name, "start string, node string, hops int")
    found.write.option("compression", "zstd").parquet(f"{folder}/pairs")
    found = spark.read.schema(found.schema).parquet(f"{folder}/pairs")
    return found.select(*[F.col(c).cast(kind).alias(c) for c in ("start", "node")], "hops")
