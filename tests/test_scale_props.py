"""Properties: partition-count invariance, exact distributed quantiles, split completeness."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonegauge.operators import quantiles as Q
from tonegauge.operators import splits as SP


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(0)
    vals = np.concatenate([rng.normal(size=20000), np.full(5000, 3.25), [np.nan] * 10])
    df = spark.createDataFrame([(float(v) if not np.isnan(v) else None,) for v in vals], "x DOUBLE").repartition(7)
    st = Q.describe(df, ["x"], (0.025, 0.25, 0.5, 0.75, 0.975))
    clean = vals[~np.isnan(vals)]
    for q, got in zip((0.025, 0.25, 0.5, 0.75, 0.975), st["x"]["quantiles"]):
        assert got == pytest.approx(float(np.percentile(clean, q * 100)), rel=0, abs=1e-12)
    assert st["x"]["n"] == len(clean)


def test_grouped_quantiles(spark):
    from tonegauge.operators.ordered import group_quantiles
    rows = [("a", float(i)) for i in range(1001)] + [("b", float(i % 7)) for i in range(50)]
    st = {r.g: r.q for r in group_quantiles(spark.createDataFrame(rows, "g STRING, v DOUBLE"), ["g"], "v", (0.5,)).collect()}
    assert st["a"][0] == 500.0
    assert st["b"][0] == float(np.percentile([i % 7 for i in range(50)], 50))


@pytest.mark.parametrize("margin", [0.004, 0.0, 0.6])
def test_quantiles_of_extremes_and_missed_brackets(spark, monkeypatch, margin):
    """A bracket that misses its rank is widened: the values do not depend on the sketch."""
    monkeypatch.setattr(Q, "MARGIN", margin)
    rng = np.random.default_rng(3)
    vals = np.concatenate([rng.normal(size=3000), rng.normal(size=50) * 1e300, [np.inf] * 5, [-np.inf] * 5, np.zeros(40), [5e-324, 1.7e308, -1.7e308]])
    df = spark.createDataFrame([(float(v),) for v in vals], "v0 DOUBLE").repartition(5)
    ranks = {0, 4, 5, 6, 700, 1550, 1551, 2500, len(vals) - 6, len(vals) - 5, len(vals) - 1}
    got = Q.order_statistics(df, ["v0"], {"v0": ranks}, {"v0": {"n": len(vals), "min": -np.inf, "max": np.inf}})
    assert {r: got["v0", r] for r in ranks} == {r: float(np.sort(vals)[r]) for r in ranks}


def test_split_exact_and_partition_invariant(spark):
    df = spark.range(0, 1001).select(F.col("id").alias("original_index"), F.lit(1).alias("rep"))
    a = SP.split_fraction(df, ["original_index", "rep"])
    b = SP.split_fraction(df.repartition(13), ["original_index", "rep"])
    assert a.filter("in_first").count() == round(0.5 * 1001)
    assert sorted(r[0] for r in a.filter("in_first").select("original_index").collect()) == \
        sorted(r[0] for r in b.filter("in_first").select("original_index").collect())


def test_position_is_dense(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7 % 5003).alias("k"))
    pos = SP.with_position(df, ["k"]).orderBy("k").select("pos").collect()
    assert [r[0] for r in pos] == list(range(5000))
