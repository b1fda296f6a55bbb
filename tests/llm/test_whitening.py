import math

import numpy as np
import pytest

from factloom.llm import queries, whitening


def table(spark, rows):
    return spark.createDataFrame([(*r, 5, "x", 0.5) for r in rows], "vec_id long, embedding array<double>, n int, x string, component double")


def brute(rows, k):
    """Exact integers, then the eigenvectors of the whole covariance."""
    use = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dims = max((len(v) for _, v in use), default=0)
    x = [(i, tuple(math.floor(256 * c) for c in v) + (0,) * (dims - len(v))) for i, v in use]
    distinct = sorted({v for _, v in x})
    n, sums = len(distinct), [sum(c) for c in zip(*distinct, strict=True)]
    centred = np.array([[n * c - s for c, s in zip(v, sums, strict=True)] for v in distinct]) / n
    values, turn = np.linalg.eigh(centred.T @ centred / n)
    values, turn = values[::-1][:k], turn[:, ::-1][:, :k]
    out = []
    for i, v in x:
        d = [n * c - s for c, s in zip(v, sums, strict=True)]
        out.append((i, v, sum(c * c for c in d), np.array(d) / n @ turn / np.sqrt(values)))
    return n, values / (centred * centred).sum() * n, out


def compare(got, rows, k=4):
    n, explained, want = brute(rows, k)
    assert len(got) == len(want) * k and {r.n for r in got} == {n}
    assert {round(r.identity_error, 8) for r in got} == {0.0}
    key = lambda r: (r[0] is None, r[0] or 0)
    want.sort(key=lambda r: (*key(r), r[2]))
    for c in range(k):
        own = sorted((r for r in got if r.component == c + 1), key=lambda r: (r.vec_id is None, r.vec_id or 0, r.deviation))
        assert [(r.vec_id, int(r.deviation)) for r in own] == [(w[0], w[2]) for w in want]
        assert max(abs(r.explained - explained[c]) for r in own) < 1e-12
        a, b = np.array([r.whitened for r in own]), np.array([w[3][c] for w in want])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-9


@pytest.mark.parametrize("dims", [3, 6, 50])
def test_whitening(spark, dims):
    rng = np.random.default_rng(dims)
    scale = np.linspace(1.0, 0.2, dims)
    rows = [(i, (rng.standard_normal(dims) * scale + 3).tolist()) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(40)] + [(5, rows[9][1]), (None, rows[3][1])]
    rows += [(900, None), (901, [float("nan")] * dims), (902, [None] * dims), (903, [float("-inf")] * dims), (904, rows[4][1][:-1]), (905, [])]
    rows += [(906, [-0.0] * dims), (907, [50.0] + [0.0] * (dims - 1))]
    got = whitening.whiten(table(spark, rows)).collect()
    compare(got, rows, min(4, dims))


def test_exact_far_beyond_64_bits(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.standard_normal(5) * 2.0**22).tolist()) for i in range(50)]
    n, _, want = brute(rows, 4)
    got = {r.vec_id: r.deviation for r in whitening.whiten(table(spark, rows)).collect()}
    assert {i: int(d) for i, d in got.items()} == {w[0]: w[2] for w in want} and max(int(d) for d in got.values()) > 2**63


def test_few_rows_and_lost_variance(spark):
    assert whitening.whiten(table(spark, [])).collect() == []
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    assert whitening.whiten(table(spark, [(1, []), (2, None)])).collect() == []
    line = whitening.whiten(table(spark, [(i, [float(i), 2.0 * i, 0.0]) for i in range(4)])).collect()
    assert {r.component for r in line} == {1} and abs(line[0].explained - 1) < 1e-12


def test_iteration_certifies_a_flat_spectrum():
    """The block is a fifth of the space, and the wanted values lie close to the rest."""
    rng = np.random.default_rng(2)
    turn = np.linalg.qr(rng.standard_normal((160, 160)))[0]
    values = np.concatenate(([1.02, 1.01, 1.005, 1.004], np.linspace(1.0, 0.2, 156)))
    v = turn * values @ turn.T
    got, q = whitening.iterate(lambda block: v @ block, 160, 4)
    assert np.abs(got - values[:4]).max() < 1e-12 and np.abs(np.abs(np.sum(q * turn[:, :4], axis=0)) - 1).max() < 1e-12


def test_a_direction_that_the_first_block_misses_is_found(monkeypatch):
    real = np.random.default_rng

    class Blind:
        """The first draw lacks the first coordinate."""

        def __init__(self):
            self.rng, self.first = real(4), True

        def standard_normal(self, shape):
            out = self.rng.standard_normal(shape)
            if self.first:
                out[0], self.first = 0, False
            return out

    values = np.concatenate(([5.0], np.linspace(1.0, 0.1, 79)))
    monkeypatch.setattr(np.random, "default_rng", lambda seed: Blind())
    got, _ = whitening.iterate(lambda block: values[:, None] * block, 80, 4)
    assert abs(got[0] - 5) < 1e-12


def test_query(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.standard_normal(8) * 0.2).tolist()) for i in range(60)]
    spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.QUERIES["op13_chebyshev_whitening"](spark, str(tmp_path))
    assert dict(got.dtypes)["deviation"] == "bigint"
    compare(got.collect(), rows)
