"""Byte-level BPE: every distinct pre-token of the corpus is encoded once, through a shuffle by word.

1. A task splits its texts by the pattern, block by block (about ``BLOCK_BYTES`` of text). A block keeps, for every document
   in order, the numbers of its words, so positions never travel with words; and it lists each distinct word once.
   A block sends one row with its positions, and its words in one row for each of ``parts`` hash parts.
2. The task that holds a part merges each distinct word by the ranks once, for all blocks, and answers each block
   with the ids of its words. However frequent a word is, a block asks for it once.
3. Answers meet the positions of their block, which were dealt by block in the same exchange, and the ids of every
   document are put together by position.

Decoding joins the ids with the token-byte table, which has as many rows as the vocabulary and is therefore broadcast.

Ids travel as little-endian unsigned 32-bit integers in one binary value per document.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.textarrays import slices

BLOCK_BYTES = 6 << 20
_ROWS = "key long, block long, part int, doc_ids array<long>, lengths binary, sequence binary, parts binary, words binary"
_ROW_NAMES = ["key", "block", "part", "doc_ids", "lengths", "sequence", "parts", "words"]
_SCHEMA = pa.schema(
    [
        ("key", pa.int64()),
        ("block", pa.int64()),
        ("part", pa.int32()),
        ("doc_ids", pa.list_(pa.int64())),
        ("lengths", pa.binary()),
        ("sequence", pa.binary()),
        ("parts", pa.binary()),
        ("words", pa.binary()),
    ]
)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: a line holds the token in base 64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: neighbours with the lowest rank are merged first, the left ones on ties."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    end = list(range(1, n + 1))  # of the piece that starts at i; 0 where no piece starts
    before = list(range(-1, n - 1))
    heap = [(ranks[word[i : i + 2]], i, i + 2) for i in range(n - 1) if word[i : i + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        _, left, stop = heapq.heappop(heap)
        right = end[left]
        if not right or right >= n or end[right] != stop:  # one of the two pieces is no longer what it was
            continue
        end[left], end[right] = stop, 0
        if stop < n:
            before[stop] = left
            rank = ranks.get(word[left : end[stop]])
            if rank is not None:
                heapq.heappush(heap, (rank, left, end[stop]))
        if left:
            rank = ranks.get(word[before[left] : stop])
            if rank is not None:
                heapq.heappush(heap, (rank, before[left], stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers in four planes of bytes, compressed: small numbers leave the upper planes empty."""
    return zlib.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(packed), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _pack_words(words: list[bytes]) -> bytes:
    lengths = np.array([len(w) for w in words], dtype="<u4").tobytes()
    return zlib.compress(np.array([len(words)], dtype="<u4").tobytes() + lengths + b"".join(words), 1)


def _unpack_words(packed: bytes) -> list[bytes]:
    data = zlib.decompress(packed)
    n = int(np.frombuffer(data, dtype="<u4", count=1)[0])
    ends = np.cumsum(np.frombuffer(data, dtype="<u4", count=n, offset=4).astype(np.int64)) + 4 * (n + 1)
    starts = [4 * (n + 1), *ends[:-1].tolist()]
    return [data[s:e] for s, e in zip(starts, ends.tolist(), strict=True)] if n else []


def _split(pattern: str, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).findall
        block = TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in slices(whole, "text", BLOCK_BYTES):
                yield from rows_of(batch, find, block)
                block += 1

    def rows_of(batch: pa.RecordBatch, find, block: int) -> Iterator[pa.RecordBatch]:
        number: dict[str, int] = {}
        add = number.setdefault
        lengths, sequence = [], []
        for text in batch.column("text").to_pylist():
            found = find(text) if text else []
            sequence.append(np.array([add(w, len(number)) for w in found], dtype=np.uint32))
            lengths.append(len(found))
        words = [w.encode() for w in number]
        part = np.array([zlib.crc32(w) % parts for w in words], dtype=np.uint32)
        order = np.argsort(part, kind="stable")
        bounds = np.searchsorted(part[order], np.arange(parts + 1))
        rows = [
            {
                "key": block,
                "block": block,
                "doc_ids": batch.column("doc_id").to_pylist(),
                "lengths": _pack(np.array(lengths)),
                "sequence": _pack(np.concatenate(sequence)),
                "parts": _pack(part),
            }
        ]
        for p in range(parts):
            if bounds[p] < bounds[p + 1]:
                own = [words[i] for i in order[bounds[p] : bounds[p + 1]]]
                rows.append({"key": -1 - p, "block": block, "part": p, "words": _pack_words(own)})
        yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    return run


def _answer(ranks):
    """Word rows to ``(key = block, part, sizes, ids)``; a word that several blocks ask for is merged once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranks.value
        known: dict[bytes, list[int]] = {}
        for batch in batches:
            asked = batch.filter(pc.is_valid(batch.column("words")))
            for block, part, words in zip(
                asked.column("block").to_pylist(), asked.column("part").to_pylist(), asked.column("words").to_pylist(), strict=True
            ):
                found = []
                for word in _unpack_words(words):
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = merge(word, table)
                    found.append(ids)
                flat = np.array([i for ids in found for i in ids], dtype=np.uint32)
                sizes = _pack(np.array([len(ids) for ids in found]))
                yield pa.RecordBatch.from_pydict(
                    {
                        "key": pa.array([block], pa.int64()),
                        "part": pa.array([part], pa.int32()),
                        "sizes": pa.array([sizes], pa.binary()),
                        "ids": pa.array([_pack(flat)], pa.binary()),
                    }
                )

    return run


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions ``starts[i] .. starts[i] + sizes[i] - 1`` of all ``i`` in a row."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def _binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """One binary value for each run of bytes that ends at ``ends``."""
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


_ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def _assemble(rows: pa.Table, answers: pa.Table) -> pa.Table:
    row = rows.filter(pc.is_valid(rows.column("sequence")))
    if not row.num_rows:
        return _ENCODED.empty_table()
    doc_ids = row.column("doc_ids")[0].values
    lengths = _unpack(row.column("lengths")[0].as_py()).astype(np.int64)
    sequence = _unpack(row.column("sequence")[0].as_py())
    part = _unpack(row.column("parts")[0].as_py())
    answers = answers.sort_by("part")
    sizes = [_unpack(x) for x in answers.column("sizes").to_pylist()]
    ids = [_unpack(x) for x in answers.column("ids").to_pylist()]
    none = np.zeros(0, dtype=np.uint32)
    sizes, ids = (np.concatenate([none, *x]) for x in (sizes, ids))
    place = np.empty(len(part), dtype=np.int64)  # of a word among the answers, which come part by part
    place[np.argsort(part, kind="stable")] = np.arange(len(part))
    size_of = sizes.astype(np.int64)[place]
    start_of = (np.cumsum(sizes, dtype=np.int64) - sizes)[place]
    token_sizes = size_of[sequence]
    flat = ids[_ragged(start_of[sequence], token_sizes)].astype("<u4")
    ends = np.concatenate(([0], np.cumsum(token_sizes)))[np.cumsum(lengths)]
    counts = np.diff(ends, prepend=0)
    return pa.table([doc_ids.cast(pa.int64()), pa.array(counts, pa.int64()), _binaries(flat.view(np.uint8), 4 * ends)], schema=_ENCODED)


def encode(docs: DataFrame, ranks_path: str, pattern: str, parts: int | None = None) -> DataFrame:
    """``(doc_id, n_tokens, ids)`` for every row of ``docs(doc_id, text)``, without special tokens.

    A null or empty text has no tokens. Rows that repeat an id, or have none, get a row each. Other columns are not read.
    ``parts`` is the number of hash parts of the words, the session's number of shuffle partitions if not given.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # positions by block and words by part in one exchange, which both sides below read
    dealt = source.mapInArrow(_split(pattern, parts), _ROWS).repartition("key")
    answers = dealt.mapInArrow(_answer(ranks), "key long, part int, sizes binary, ids binary")
    encoded = dealt.groupBy("key").cogroup(answers.groupBy("key"))
    return encoded.applyInArrow(_assemble, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, ranks_path: str, column: str = "ids") -> DataFrame:
    """``encoded`` with a column ``decoded``: the bytes of the tokens; a null stays null."""
    table = sorted((rank, token) for token, rank in read_ranks(ranks_path).items())
    sizes = np.zeros(table[-1][0] + 1, dtype=np.int64)
    sizes[[rank for rank, _ in table]] = [len(token) for _, token in table]
    joined = encoded.sparkSession.sparkContext.broadcast((sizes, b"".join(token for _, token in table)))
    names = encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, data = joined.value
        data, starts = np.frombuffer(data, dtype=np.uint8), np.cumsum(sizes) - sizes
        for whole in batches:
            for batch in slices(whole, column, BLOCK_BYTES):
                ids = [None if x is None else np.frombuffer(x, dtype="<u4") for x in batch.column(column).to_pylist()]
                out = [None if x is None else data[_ragged(starts[x], sizes[x])].tobytes() for x in ids]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{schema}, decoded binary")
