"""Principal components and whitening of vectors by Chebyshev-filtered subspace iteration.

Components are turned into integers ``floor(scale * x)``. The covariance is that of the distinct integer vectors, each once. It is never
built: a pass over the distinct vectors multiplies it with a block of directions, ``C'(C Q) / n`` for the centred rows ``C``, where every
task folds its rows into one small matrix and Spark adds these up. A round applies a Chebyshev polynomial of the covariance to the block,
one pass a degree, which stays small on the unwanted part of the spectrum, from 0 to the smallest Ritz value, and grows fast above it.
Then the block is made orthonormal (QR) and turned to its Ritz vectors (Rayleigh-Ritz).

The rounds end once the residuals ``|V q - e q|`` of all wanted components are below ``TOLERANCE`` times the largest eigenvalue. The
last ``FRESH`` directions of the block are drawn anew in every round, so that a component which the first draw happened to miss can't hide. The driver holds
the block and sums per dimension, nothing that grows with the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.storage import stored

DEGREE, SPARE, FRESH, ROUNDS, SEED = 12, 28, 2, 60, 1807
TOLERANCE = 1e-13  # of a residual, as a share of the largest eigenvalue
LEAST = 1e-9  # variance of a component, as a share of the whole
BLOCK = 4 << 20  # bytes of a block of rows, before it is packed
_KINDS = (np.int16, np.int32, np.int64)
_RESULT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


@dataclass
class Principal:
    """The distinct vectors' number and sums, and the components: ``values`` falling, ``directions`` as columns."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    directions: np.ndarray
    passes: int = 0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def integer_vectors(vectors: DataFrame, vector: str, scale: int) -> DataFrame:
    """``(vec_id, x)`` of the rows whose vector is not null and holds no null or non-finite entry; shorter vectors end in zeros.

    There is no row if all vectors are empty.
    """
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    rows = vectors.filter(F.coalesce(~bad, F.lit(False)))
    dims = rows.agg(F.max(F.size(vector))).first()[0] or 0
    rows = rows.filter(F.lit(dims > 0))
    x = F.transform(vector, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    full = F.when(F.size(vector) == dims, x).otherwise(F.concat(x, F.array_repeat(F.lit(0).cast("long"), dims - F.size(vector))))
    return rows.select(F.col("vec_id").cast("long"), full.alias("x"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows as blocks of numbers of the smallest width that holds them: many passes read them, and none converts lists."""
    for batch in batches:
        x = _matrix(batch) if batch.num_rows else np.zeros((0, 1), np.int64)
        step = max(1, BLOCK // (8 * x.shape[1]))
        for at in range(0, len(x), step):
            part = x[at : at + step]
            kind = next(k for k in _KINDS if np.iinfo(k).min <= part.min() and part.max() <= np.iinfo(k).max)
            head = [pa.array([v], pa.int32()) for v in (part.shape[1], np.dtype(kind).itemsize)]
            yield pa.RecordBatch.from_arrays([*head, pa.array([part.astype(kind).tobytes()], pa.binary())], names=["dims", "width", "data"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for dims, width, data in zip(*(batch.column(c) for c in ("dims", "width", "data")), strict=True):
            kind = next(k for k in _KINDS if np.dtype(k).itemsize == width.as_py())
            yield np.frombuffer(data.as_buffer(), dtype=kind).reshape(-1, dims.as_py())


def packed(x: DataFrame) -> DataFrame:
    """``x(x)``, vectors of longs of one length, as blocks of rows, stored."""
    return stored(x.mapInArrow(_pack, "dims int, width int, data binary"), "vectors")


def _exact(x: np.ndarray, factor: int) -> np.ndarray:
    """``x`` in a type in which a sum of its elements times ``factor`` is exact."""
    most = max(int(x.max(initial=0)), -int(x.min(initial=0)))
    return x if most * factor * x.size < 2**63 else x.astype(object)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each dimension the sum and the sum of squares, exact; the number of rows in the place of dimension -1."""
    n, sums, squares = 0, [], []
    for x in _unpacked(batches):
        x = x.astype(np.int64)
        x = _exact(x, max(1, int(x.max()), -int(x.min())))
        n += len(x)
        sums = [a + int(b) for a, b in zip(sums or [0] * x.shape[1], x.sum(axis=0), strict=True)]
        squares = [a + int(b) for a, b in zip(squares or [0] * x.shape[1], (x * x).sum(axis=0), strict=True)]
    kind = pa.decimal128(38, 0)
    columns = [[Decimal(v) for v in c] for c in ([n, *sums], [n, *squares])]
    yield pa.RecordBatch.from_arrays(
        [pa.array(range(-1, len(sums)), pa.int32()), *(pa.array(c, kind) for c in columns)], names=["dim", "total", "squares"]
    )


def _folded(x: DataFrame, fold: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """The sum over all rows of ``fold``, which turns a batch of rows into an array of ``shape``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for rows in _unpacked(batches):
            total += fold(rows.astype(np.float64))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["place", "value"])

    sums = x.mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(int(np.prod(shape)))
    out[sums.column("place").to_numpy()] = sums.column("value").to_numpy()
    return out.reshape(shape)


def _centred_product(x: DataFrame, mean: np.ndarray, n: int, block: np.ndarray) -> np.ndarray:
    """The covariance times ``block``, by one pass."""

    def fold(rows: np.ndarray) -> np.ndarray:
        rows = rows - mean
        return rows.T @ (rows @ block)

    return _folded(x, fold, block.shape) / n


def chebyshev(times: Callable[[np.ndarray], np.ndarray], q: np.ndarray, vq: np.ndarray, top: float, edge: float, degree: int) -> np.ndarray:
    """The Chebyshev polynomial for the interval from 0 to ``edge``, scaled to 1 at ``top``, of an operator applied to ``q``.

    ``times`` applies the operator, ``vq`` is the operator applied to ``q``.
    """
    half = max(edge, 1e-12 * top) / 2
    first = step = half / (top - half)
    before, now = q, (vq - half * q) * (step / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - step)
        before, now = now, (times(now) - half * now) * (2 * after / half) - (step * after) * before
        step = after
    return now


def iterate(times: Callable[[np.ndarray], np.ndarray], dims: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric operator without negative ones, falling, and their vectors as columns."""
    rng = np.random.default_rng(SEED)
    k = min(k, dims)
    width = min(dims, k + SPARE)
    q = np.linalg.qr(rng.standard_normal((dims, width)))[0]
    for done in range(ROUNDS):
        vq = times(q)
        values, turn = np.linalg.eigh((q.T @ vq + vq.T @ q) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        top = values[0]
        if top <= 0 or np.linalg.norm(vq[:, :k] - q[:, :k] * values[:k], axis=0).max() <= TOLERANCE * top:
            return values[:k], q[:, :k]
        if width == dims:  # the block is the whole space; another round only mends rounding
            q = np.linalg.qr(q)[0]
            continue
        degree = DEGREE << (done // 12)  # a spectrum with hardly a gap gets a steeper polynomial
        q = chebyshev(times, q, vq, top, values[-1 - FRESH], degree)
        q[:, -FRESH:] = rng.standard_normal((dims, FRESH)) * np.linalg.norm(q[:, -FRESH - 1])
        q = np.linalg.qr(q)[0]
    raise ArithmeticError(f"no certified components after {ROUNDS} rounds")


def principal_components(x: DataFrame, k: int) -> Principal | None:
    """The components of the distinct vectors ``x`` (see :func:`packed`); None without a row or without variance."""
    moments = {r["dim"]: (int(r["total"]), int(r["squares"])) for r in x.mapInArrow(_moments, "dim int, total decimal(38,0), squares decimal(38,0)")
               .groupBy("dim").agg(F.sum("total").alias("total"), F.sum("squares").alias("squares")).collect()}
    n = moments.pop(-1, (0, 0))[0]
    sums = [moments[i][0] for i in range(len(moments))]
    spread = sum(n * moments[i][1] - s * s for i, s in enumerate(sums))
    if not spread:
        return None
    found = Principal(n, sums, spread / n / n, np.zeros(0), np.zeros((len(sums), 0)))
    mean = found.mean

    def times(block: np.ndarray) -> np.ndarray:
        found.passes += 1
        return _centred_product(x, mean, n, block)

    values, directions = iterate(times, len(sums), k)
    some = values > LEAST * found.trace
    found.values, found.directions = values[some], directions[:, some]
    return found


def identity_error(x: DataFrame, found: Principal) -> float:
    """The largest entry of the whitened distinct vectors' covariance minus the identity, from two passes over them."""
    mean, turn = found.mean, found.directions / np.sqrt(found.values)
    k = turn.shape[1]
    centre = _folded(x, lambda rows: ((rows - mean) @ turn).sum(axis=0), (k,)) / found.n

    def fold(rows: np.ndarray) -> np.ndarray:
        w = (rows - mean) @ turn - centre
        return w.T @ w

    return float(np.abs(_folded(x, fold, (k, k)) / found.n - np.eye(k)).max())


def _project(found: Principal, error: float):
    mean, scale, k = found.mean, np.sqrt(found.values), len(found.values)
    n, share = found.n, found.values / found.trace
    sums = np.array(found.sums, dtype=object)
    own = int((sums * sums).sum())
    most = max(1, int(np.abs(sums).max()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch)
            rows = len(x)
            w = ((x - mean) @ found.directions) / scale
            squares = _exact(x, max(1, int(x.max()), -int(x.min())))
            cross = _exact(x, most)
            squares, cross = (squares * squares).sum(axis=1), cross @ sums.astype(cross.dtype)
            deviation = [Decimal(n * n * int(a) - 2 * n * int(b) + own) for a, b in zip(squares, cross, strict=True)]
            deviation = pa.array(deviation, pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(np.repeat(np.arange(rows), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, n)),
                    deviation.take(pa.array(np.repeat(np.arange(rows), k))),
                    pa.array(w.ravel()),
                    pa.array(np.tile(share, rows)),
                    pa.array(np.full(rows * k, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return run


def whiten(vectors: DataFrame, k: int = 4, scale: int = 256, vector: str = "embedding") -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)`` for every usable row of ``vectors`` and component up to ``k``.

    ``n`` is the number of distinct integer vectors, ``deviation`` the sum over the dimensions of ``(n * x - sum)**2``, exact, ``explained`` a
    component's share of the variance. Rows whose vector is null or holds null or non-finite entries are dropped; shorter vectors end in
    zeros; entries beyond 64 bits take the nearest long. Rows that repeat a vector or an id, and null ids, keep rows of their own.
    Components with less than ``LEAST`` of the variance are left out, so equal vectors, a single one or an empty table give no row.
    Components of equal variance may be turned among each other. Other columns are not read.
    """
    rows = integer_vectors(vectors.select("vec_id", vector), vector, scale)
    distinct = packed(rows.select("x").distinct())
    found = principal_components(distinct, k)
    if found is None:
        return vectors.sparkSession.createDataFrame([], _RESULT)
    return rows.mapInArrow(_project(found, identity_error(distinct, found)), _RESULT)
