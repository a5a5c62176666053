import math
import random

import numpy as np
import pytest

from tonegauge.llm import whitening as W
from tonegauge.llm.queries import op12_whitening

SCHEMA = "vec_id long, embedding array<double>, dim int, x string, n int"


def make(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], SCHEMA).repartition(3)


def usable(rows):
    return [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]


def far_of(r):
    """The deviation; -1 for one beyond 64 bits."""
    return -1 if r.deviation is None else r.deviation


def check(rows, got):
    rows = usable(rows)
    fit = sorted({tuple(x) for _, x in rows})
    n, dim = len(fit), len(fit[0])
    s = [sum(x[j] for x in fit) for j in range(dim)]
    v = np.array([[(n * sum(x[i] * x[j] for x in fit) - s[i] * s[j]) / n**2 for j in range(dim)] for i in range(dim)])
    value, vector = np.linalg.eigh(v)
    value, vector = value[::-1], vector[:, ::-1]
    k = min(4, int((value > dim * 2.3e-16 * value[0]).sum()))
    assert len(got) == k * len(rows)
    assert {r.n for r in got} <= {n}
    far, seen = {}, {}
    for i, x in rows:
        d = sum((n * a - b) ** 2 for a, b in zip(x, s))
        far.setdefault(i, []).append(d if d < 1 << 63 else -1)
        seen.setdefault(i, []).append(np.array([(n * a - b) / n for a, b in zip(x, s)]) @ vector[:, :k] / np.sqrt(value[:k]))
    for c in range(1, k + 1):
        rs = [r for r in got if r.component == c]
        assert sorted((r.vec_id, far_of(r)) for r in rs) == sorted((i, d) for i, ds in far.items() for d in ds)
        a = np.array(sorted(((r.vec_id, far_of(r), r.whitened) for r in rs), key=lambda r: r[:2]))[:, 2].astype(float)
        b = np.array([w[c - 1] for _, _, w in sorted((i, d, w) for i in far for d, w in zip(far[i], seen[i]))])
        sign = np.sign(a @ b)
        assert np.allclose(a, sign * b, rtol=1e-6, atol=1e-8)
        assert all(abs(r.explained - value[c - 1] / np.trace(v)) <= 1e-4 * value[c - 1] / np.trace(v) for r in rs)
    assert all(r.identity_error <= 1e-4 for r in got) and len({r.identity_error for r in got}) <= 1


@pytest.mark.parametrize("scale, dim", [(1.0, 5), (300.0, 9), (1e-3, 3), (1e6, 4)])
def test_against_big_integers(spark, monkeypatch, scale, dim):
    monkeypatch.setattr(W, "ROWS", 50)
    r = random.Random(dim)
    rows = [(i, [r.gauss(j, 1 + j) * scale for j in range(dim)]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(400)]  # one vector on most rows counts once
    rows += [(2000, None), (2001, [1.0, None] + [0.0] * (dim - 2)), (2002, [float("nan")] * dim), (2003, [float("inf")] * dim), (2004, [])]
    check(rows, W.whitened(make(spark, rows)).collect())


def test_scatter_is_exact():
    r = np.random.default_rng(1)
    for high in (1, 3, 1000, 2**31, 2**62):
        x = r.integers(-high, high, (130, 6), endpoint=True)
        x[:, 2] = 7
        big = [[int(v) for v in row] for row in x]
        sums, products = W.scatter(x)
        assert sums == [sum(row[j] for row in big) for j in range(6)]
        assert products == [[sum(row[i] * row[j] for row in big) for j in range(i, 6)] for i in range(6)]


def test_limbs():
    for v in (0, -1, 1, 2**126, -(2**126) - 5, 2**32, -(2**32)):
        assert sum(x << (32 * k) for k, x in enumerate(W._limbs(v))) == v


def test_extremes(spark):
    rows = [(0, [1e300, 0.0]), (1, [-1e300, 1.0]), (2, [0.0, 2.0])]
    got = W.whitened(make(spark, rows)).collect()
    assert {r.vec_id for r in got} <= {0, 1, 2} and all(math.isfinite(r.whitened) for r in got)
    assert {r.deviation for r in got if r.vec_id == 0} == {None}


def test_degenerate_tables(spark):
    assert W.whitened(make(spark, [])).collect() == []
    assert W.whitened(make(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect() == []  # one point has no spread
    line = W.whitened(make(spark, [(i, [float(i), 2.0 * i, 0.0]) for i in range(5)] + [(None, [1.0, 2.0, 0.0])])).collect()
    assert {r.component for r in line} == {1} and len(line) == 6  # rank 1: one component
    two = W.whitened(make(spark, [(1, [0.0]), (2, [1.0]), (3, [0.0, 0.0]), (4, [1.0, 3.0])])).collect()
    assert sorted((r.vec_id, r.component, r.n) for r in two) == [(1, 1, 2), (2, 1, 2), (3, 1, 2), (4, 1, 2)]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(rows, op12_whitening(spark, sf).collect())
