"""Sorted arrays in files of the shared folder, which tasks write and workers map into memory.

A folder on a mounted file system is mapped: workers of a machine share its pages and read only those they touch.
Another store is read through its Arrow file system, a file at a time. Files come into place at once, so a task may run again.
A shard without rows has no file; the driver marks a folder as complete, and a worker that sees neither file nor mark fails, as its
folder is not the one that was written.
"""

from __future__ import annotations

import os
import uuid
from collections import OrderedDict
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.storage import open_store, shared_folder

U64, U32 = np.dtype("<u8"), np.dtype("<u4")
_OPEN: OrderedDict[str, list[np.ndarray]] = OrderedDict()
_MOST_OPEN, _MOST_BYTES = 256, 256 << 20  # files kept open, and bytes of those that are not mapped
_COMPLETE = "complete"
SET_ROWS = 1 << 20


def _local(path: str) -> str | None:
    parsed = urlparse(path)
    return parsed.path if parsed.scheme == "file" else path if not parsed.scheme else None


def make_folder(path: str) -> None:
    local = _local(path)
    if local is not None:
        os.makedirs(local, exist_ok=True)
    else:
        store, inner = open_store(path)
        store.create_dir(inner)


def write_arrays(path: str, arrays: list[np.ndarray]) -> None:
    """A file of arrays of 4 or 8 bytes: their number, item sizes and lengths, then their bytes."""
    head = np.array([len(arrays)] + [x for a in arrays for x in (a.dtype.itemsize, len(a))], dtype=U64)
    local = _local(path)
    if local is None:
        store, inner = open_store(path)
        out = store.open_output_stream(inner)
    else:
        out = open(f"{local}.{uuid.uuid4().hex}", "wb")  # noqa: SIM115
    with out:
        out.write(head.tobytes())
        for a in arrays:
            out.write(np.ascontiguousarray(a).tobytes() + b"\0" * (-a.nbytes % 8))
    if local is not None:
        os.replace(out.name, local)


def mark_complete(folder: str) -> None:
    """Says that all shards of a folder that have rows are written."""
    write_arrays(f"{folder}/{_COMPLETE}", [])


def _in_memory(path: str) -> int:
    return 0 if _local(path) is not None else sum(a.nbytes for a in _OPEN[path])


def arrays(path: str) -> list[np.ndarray] | None:
    """The arrays of a file, mapped where possible and kept open; None if its folder is complete without such a file."""
    held = _OPEN.pop(path, None)
    if held is None:
        held = _read(path)
        if held is None:
            folder = path.rpartition("/")[0]
            if _read(f"{folder}/{_COMPLETE}") is None:
                raise FileNotFoundError(f"{folder} is not complete or not shared: spark.checkpoint.dir must name a folder that all workers see")
            held = []
    _OPEN[path] = held
    while len(_OPEN) > 1 and (len(_OPEN) > _MOST_OPEN or sum(map(_in_memory, _OPEN)) > _MOST_BYTES):
        _OPEN.popitem(last=False)
    return held or None


def _read(path: str) -> list[np.ndarray] | None:
    local = _local(path)
    if local is not None:
        if not os.path.exists(local):
            return None
        data = np.memmap(local, dtype=np.uint8, mode="r")
    else:
        store, inner = open_store(path)
        try:
            with store.open_input_stream(inner) as stream:
                data = np.frombuffer(stream.read(), dtype=np.uint8)
        except FileNotFoundError:
            return None
    n = int(data[:8].view(U64)[0])
    at, out = 8 * (1 + 2 * n), []
    for size, length in data[8:at].view(U64).reshape(n, 2).tolist():
        out.append(data[at : at + size * length].view({8: U64, 4: U32}[size]))
        at += size * length + -size * length % 8
    return out


class SharedSet:
    """A set of 64-bit numbers of any size, dealt over files of sorted numbers."""

    def __init__(self, folder: str, shards: int):
        self.folder, self.shards = folder, shards

    def has(self, values: np.ndarray) -> np.ndarray:
        """For each 64-bit value whether it is in the set."""
        values = values.view(np.int64)
        out = np.zeros(len(values), dtype=bool)
        shard = values % self.shards
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(cuts)):
            held = arrays(f"{self.folder}/{s}")
            if held is not None and len(held[0]):
                own = order[cuts[s] : cuts[s + 1]]
                wanted = values[own].view(np.uint64)
                out[own] = held[0][np.minimum(np.searchsorted(held[0], wanted), len(held[0]) - 1)] == wanted
        return out


def shared_set(numbers: DataFrame, label: str) -> SharedSet:
    """The distinct numbers of a one-column frame of longs, without nulls, as a set that workers map."""
    spark = numbers.sparkSession
    numbers = numbers.toDF("value").dropna().distinct()
    shards = max(1, -(-numbers.count() // SET_ROWS))
    folder = shared_folder(spark, label)
    make_folder(folder)

    def write(rows: pa.Table) -> pa.Table:
        values = np.sort(rows.column("value").to_numpy().view(np.uint64))
        write_arrays(f"{folder}/{rows.column('shard')[0].as_py()}", [values])
        return pa.table({"written": pa.array([len(values)], pa.int64())})

    dealt = numbers.withColumn("shard", F.pmod("value", F.lit(shards)))
    dealt.groupBy("shard").applyInArrow(write, "written long").agg(F.sum("written")).collect()
    mark_complete(folder)
    return SharedSet(folder, shards)


class SharedMap:
    """A map of 64-bit numbers of any size, dealt over files of sorted keys and their values."""

    def __init__(self, folder: str, shards: int):
        self.folder, self.shards = folder, shards

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each 64-bit key; the key itself where the map has none."""
        keys = keys.view(np.int64)
        out = keys.copy()
        shard = keys % self.shards
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(cuts)):
            held = arrays(f"{self.folder}/{s}")
            if held is not None and len(held[0]):
                own = order[cuts[s] : cuts[s + 1]]
                wanted = keys[own].view(np.uint64)
                place = np.minimum(np.searchsorted(held[0], wanted), len(held[0]) - 1)
                hit = held[0][place] == wanted
                out[own[hit]] = held[1][place[hit]].view(np.int64)
        return out


def shared_map(pairs: DataFrame, label: str) -> SharedMap:
    """The two columns of longs of ``pairs`` as a map that workers map; a key that is there more than once has its least value."""
    spark = pairs.sparkSession
    pairs = pairs.toDF("key", "value").dropna().groupBy("key").agg(F.min("value").alias("value"))
    shards = max(1, -(-pairs.count() // SET_ROWS))
    folder = shared_folder(spark, label)
    make_folder(folder)

    def write(rows: pa.Table) -> pa.Table:
        keys, values = (rows.column(c).to_numpy().view(np.uint64) for c in ("key", "value"))
        order = np.argsort(keys)
        write_arrays(f"{folder}/{rows.column('shard')[0].as_py()}", [keys[order], values[order]])
        return pa.table({"written": pa.array([len(keys)], pa.int64())})

    dealt = pairs.withColumn("shard", F.pmod("key", F.lit(shards)))
    dealt.groupBy("shard").applyInArrow(write, "written long").agg(F.sum("written")).collect()
    mark_complete(folder)
    return SharedMap(folder, shards)
