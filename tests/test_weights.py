"""The certified fit, weights and the rank-sum AUC."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonegauge.operators import weights as W

GOALS = ["a", "b"]


@pytest.fixture(scope="module")
def seeds(spark):
    r = np.random.default_rng(4)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(r.beta(2, 5, (400, 2)))] + [(900, None, 0.5)]
    return spark.createDataFrame(rows, "row_id long, source_a double, source_b double")


def test_the_fit_is_the_optimum(spark, seeds):
    out, auc, fitted = W.uniform_weights(seeds, GOALS, "row_id")
    rows = out.withColumns({f"u_{g}": W.u("col:row_id", 42, "unif", g) for g in GOALS}).orderBy("row_id").collect()
    real = np.array([[r.source_a, r.source_b] for r in rows if r.source_a is not None])
    unif = np.array([[r.u_a, r.u_b] for r in rows if r.source_a is not None])
    x = np.column_stack([np.ones(800), np.vstack([real, unif])])
    y = np.repeat([1.0, 0.0], 400)

    def loss(b):
        z = x @ b
        return (np.logaddexp(0, z) - y * z).sum() + 0.5 * (b[1:] ** 2).sum()

    assert fitted.rows == 800 and fitted.gradient <= W.TOLERANCE
    assert fitted.objective == pytest.approx(loss(fitted.coef), rel=1e-12)
    r = np.random.default_rng(1)
    assert all(loss(fitted.coef + 1e-3 * r.normal(size=3)) > fitted.objective for _ in range(50))
    z = x @ fitted.coef
    want = np.exp(-z[:400]) / np.exp(-z[:400]).sum()
    got = np.array([r.sampling_weights for r in rows if r.source_a is not None])
    np.testing.assert_allclose(got, want, rtol=1e-9)
    assert rows[-1].sampling_weights is None
    pos, neg = z[:400], z[400:]
    brute = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (400 * 400)
    assert auc == pytest.approx(brute, abs=1e-12)


@pytest.mark.parametrize("scores", [[(1.0, 1), (1.0, 0), (1.0, 0), (2.0, 1), (0.0, 0)], [(0.5, 1)] * 40 + [(0.5, 0)] * 60, [(float(i % 7), i % 3 % 2) for i in range(200)]])
def test_auc_with_ties(spark, scores):
    df = spark.createDataFrame(scores, "score double, label int").repartition(4)
    p, n = [s for s, y in scores if y], [s for s, y in scores if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in p for b in n) / (len(p) * len(n))
    assert W.auc(df) == pytest.approx(want, abs=1e-12)
    assert W.auc(df.filter("label = 1")) is None and W.auc(df.limit(0)) is None


def test_a_missed_optimum_fails(spark, seeds, monkeypatch):
    monkeypatch.setattr(W, "STEPS", 1)
    with pytest.raises(RuntimeError, match="gradient"):
        W.uniform_weights(seeds, GOALS, "row_id")
    empty, auc, fitted = W.uniform_weights(seeds.limit(0), GOALS, "row_id")
    assert empty.collect() == [] and auc is None and fitted.rows == 0
