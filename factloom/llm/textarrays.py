"""Whole Arrow text columns as byte arrays: word positions and word hashes without a Python loop per word.

A word is a maximal run of characters other than space and ``\\t \\n \\v \\f \\r``. The separators are single
bytes in UTF-8, so words are found on bytes. ``A-Z`` are folded to lower case when a word is hashed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_WINDOW = 1 << 20  # bytes hashed at once
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95  # odd, so it has an inverse modulo 2**64
_BACK = pow(_BASE, -1, 1 << 64)

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_LETTER = mix64((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _STEP)[LOWER]  # a random number for each folded byte


def _powers(base: int) -> np.ndarray:
    out = np.ones(_WINDOW, dtype=np.uint64)
    done = 1
    while done < len(out):  # doubling: out[done + i] = out[i] * base**done
        n = min(done, len(out) - done)
        out[done : done + n] = out[:n] * np.uint64(pow(base, done, 1 << 64))
        done += n
    return out


_UP: np.ndarray | None = None
_DOWN: np.ndarray | None = None


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its ``len + 1`` offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    ends = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows with about ``most`` bytes of text; a longer text is a run of its own."""
    if not batch.num_rows:
        return
    _, ends = utf8(batch.column(column))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(ends, ends[start] + most, side="right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word, in order."""
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = ~IS_SPACE[data]
    cut = np.zeros(len(data) + 1, dtype=bool)  # a text starts here
    cut[ends] = True
    body = inside[1:]
    before = inside[:-1]
    starts = np.flatnonzero(body[:-1] & (~before[:-1] | cut[:-1]))
    stops = np.flatnonzero(before[1:] & (~body[1:] | cut[1:])) + 1
    rows = np.repeat(np.arange(len(ends) - 1), np.diff(np.searchsorted(starts, ends)))
    return starts, stops, rows


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over random letter codes, taken from running sums window by window."""
    global _UP, _DOWN
    if _UP is None:
        _UP, _DOWN = _powers(_BASE), _powers(_BACK)
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        first = starts[i]
        j = int(np.searchsorted(stops, first + _WINDOW, side="right"))
        if j <= i:  # a word longer than the window
            out[i] = _long_word(data[first : stops[i]])
            i += 1
            continue
        part = _LETTER[data[first : stops[j - 1]]]
        part *= _UP[: len(part)]
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(part, out=total[1:])
        at = starts[i:j] - first
        out[i:j] = (total[stops[i:j] - first] - total[at]) * _DOWN[at]
        i = j
    return mix64(out)


def _long_word(word: np.ndarray) -> np.uint64:
    total, shift = 0, 1
    for at in range(0, len(word), _WINDOW):
        part = _LETTER[word[at : at + _WINDOW]]
        total += shift * int((part * _UP[: len(part)]).sum(dtype=np.uint64))
        shift = shift * pow(_BASE, _WINDOW, 1 << 64) % (1 << 64)
    return np.uint64(total % (1 << 64))


def row_bounds(rows: np.ndarray, n: int) -> np.ndarray:
    """``n + 1`` bounds of the runs of equal ``rows`` (sorted) for rows ``0 .. n - 1``."""
    return np.searchsorted(rows, np.arange(n + 1))
