"""Positions, per-group quantiles and summaries of many runs."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonegauge.operators import ordered as O
from tonegauge.operators import resummary as RS


def test_positions_are_the_sorted_order(spark):
    keys = spark.range(1000).select((F.xxhash64("id") % 100000).alias("k")).distinct().repartition(7)
    got = sorted((r.pos, r.k) for r in O.positions(keys, ["k"]).collect())
    assert [p for p, _ in got] == list(range(len(got))) and [k for _, k in got] == sorted(k for _, k in got)
    assert O.positions(keys.filter("false"), ["k"]).collect() == []


def test_group_quantiles_against_numpy(spark):
    r = np.random.default_rng(5)
    data = {"hot": r.normal(size=3000), "ties": np.repeat(r.integers(0, 3, 50), 20).astype(float), "one": np.array([2.5]), "two": np.array([1.0, 4.0]),
            None: np.array([1.0, math.inf, math.inf])} | {f"g{i}": r.normal(size=1 + i % 9) for i in range(300)}
    rows = [(g, float(v)) for g, vs in data.items() for v in vs] + [("hot", None), ("hot", math.nan), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {x.g: x for x in O.group_quantiles(df, ["g"], "v", (0.25, 0.5, 0.75, 1.0)).collect()}
    assert set(got) == set(data)
    for g, v in data.items():
        assert got[g].n == len(v)
        if np.isfinite(v).all():
            np.testing.assert_allclose(got[g].q, np.quantile(v, [0.25, 0.5, 0.75, 1.0]), rtol=1e-12, atol=1e-15)
            np.testing.assert_allclose([got[g]["mean"], got[g]["std"], got[g]["min"], got[g]["max"]], [v.mean(), v.std(), v.min(), v.max()], rtol=1e-9, atol=1e-12)
    assert got[None].q[1:] == [math.inf] * 3


def test_the_plan_does_not_grow_with_groups(spark):
    def size(n):
        df = spark.range(5000).select((F.col("id") % n).alias("g"), F.rand(1).alias("v"))
        return len(O.group_quantiles(df, ["g"], "v")._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert size(3) == size(2000)


GOALS = ["a", "b"]


@pytest.fixture(scope="module")
def judged(spark):
    cols = [F.rand(i).alias(c) for i, c in enumerate(f"{p}_{g}" for p in ("source", "output", "target") for g in GOALS)]
    df = spark.range(600).select(F.concat(F.lit("run-"), F.col("id") % 12).alias("run"), *cols,
                                 F.when(F.col("id") % 12 == 3, "No").when(F.col("id") % 5 == 0, "No").when(F.col("id") % 7 == 0, None).otherwise("Yes").alias("answer"),
                                 (F.col("id") % 12 == 3).alias("never"), (F.col("id") % 11 > 0).alias("rationale_approved"))
    df = df.withColumn("rationale_approved", F.col("rationale_approved") | F.col("never")).drop("never")
    return df.withColumns({f"delta_{g}": F.col(f"target_{g}") - F.col(f"source_{g}") for g in GOALS})


def configs(spark, runs):
    return spark.createDataFrame([(f"run-{i}", (f"m{i}",), "direct", (True,) if i % 2 else None, "p") for i in runs], RS.CONFIG)


def test_runs_equal_one_evaluation_each(spark, judged):
    from tonegauge.operators.metrics import evaluate
    got = {(r.run, r.metric): r for r in RS.summarize_runs(judged, GOALS).collect()}
    assert len(got) == 36
    for run in ("run-0", "run-7", "run-3"):
        for want in evaluate(spark, judged.filter(F.col("run") == run), GOALS).collect():
            have = got[run, want.metric]
            for c in ("mean", "median", "min", "max", "std", "q1", "q3", "iqr", "n", "n_total", "n_grounded", "n_flagged", "n_overruled"):
                assert (have[c] is None and want[c] is None) or have[c] == pytest.approx(want[c], rel=1e-9), (run, c)
    assert got["run-3", "steering_error"].n == 0


def test_converted_documents_are_appended_once(spark, judged, tmp_path):
    some = RS.convert_runs(judged.filter("run in ('run-1', 'run-2')"), configs(spark, range(12)), GOALS, "j")
    path = str(tmp_path / "docs")
    assert RS.append_documents(some, path) == 2 and RS.append_documents(some, path) == 0
    assert RS.append_documents(RS.convert_runs(judged, configs(spark, range(12)), GOALS, "j"), path) == 10
    docs = {r.run: json.loads(r.document) for r in spark.read.json(path).collect()}
    assert len(docs) == 12
    assert docs["run-1"]["run"] == {"model_id": "m1", "prompt_strategy": "direct", "negprompt": True, "probe_path": "p", "judge": "j", "legacy_converted": True}
    assert docs["run-2"]["run"]["negprompt"] is False and set(docs["run-2"]["steerability"]) == set(RS.M.METRICS)
    assert docs["run-3"]["data"]["n_grounded"] == 0


def test_runs_need_one_configuration(spark, judged):
    with pytest.raises(Exception, match="no configuration"):
        RS.convert_runs(judged, configs(spark, range(11)), GOALS, "j").collect()
    with pytest.raises(Exception, match="two configurations"):
        RS.convert_runs(judged, configs(spark, [*range(12), 4]), GOALS, "j").collect()
