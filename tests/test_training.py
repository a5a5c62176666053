"""Evaluation sets with cross-probes, saved sides and phases of several tables."""

import pytest
from pyspark.sql import functions as F

from tonegauge.operators import splits as SP
from tonegauge.operators import training as TR
from tonegauge.operators.probe import repeat_rows, with_deltas

GOALS = ["reading_difficulty", "formality"]
CFG = TR.TrainingConfig(n_source_texts=8, instructions_per_text=2, num_train_prompts_for_eval=12, num_test_prompts_for_eval=10, insts_per_probe_source_text=2, clip_min=0.5, clip_max=1.5)


@pytest.fixture(scope="module")
def probe(spark):
    base = spark.range(40).select(F.col("id").alias("original_index"), F.concat(F.lit("text, \"quoted\"\nno "), "id").alias("text"),
                                  (F.col("id") / 40).alias("source_reading_difficulty"), (1 - F.col("id") / 40).alias("source_formality"),
                                  (F.col("id") / 20).alias("sampling_weights_mean"))
    return with_deltas(repeat_rows(base, 4), GOALS, ["original_index", "rep"], 42, 1)


def rows(df, *drop):
    cols = sorted(c for c in df.columns if c not in drop)
    return sorted(map(repr, df.select(*cols).collect()))


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_prepare_and_reuse(spark, probe, tmp_path, fmt):
    first = TR.prepare(probe, GOALS, CFG, "m", str(tmp_path), "run", fmt)
    before = {k: rows(v) for k, v in first.items()}
    assert {r.split for r in first["eval"].select("split").distinct().collect()} == {"train", "test", "train_source_test_inst", "test_source_train_inst"}
    assert first["train"].agg(F.min("sampling_weights_mean"), F.max("sampling_weights_mean")).first() == (0.5, 1.5)
    assert first["train"].schema["prompt"].dataType.simpleString() == TR.CHAT
    # a second start reads the same tables: nothing is computed again
    again = TR.prepare(probe.filter("false"), GOALS, CFG, "m", str(tmp_path), "run", fmt)
    assert {k: rows(v) for k, v in again.items()} == before
    assert again["train"].inputFiles() == first["train"].inputFiles()
    # other settings do not
    other = TR.prepare(probe, GOALS, CFG, "another", str(tmp_path), "run", fmt)
    assert other["train"].inputFiles() != first["train"].inputFiles()
    assert {k: rows(v) for k, v in TR.prepare(probe.filter("false"), GOALS, CFG, "m", str(tmp_path), "run", fmt).items()} == before


def test_a_broken_attempt_is_not_reused(spark, probe, tmp_path):
    with pytest.raises(RuntimeError):
        def broken():
            return {"train": probe, "bad": Broken()}
        TR.written_together(spark, str(tmp_path / "x"), {"a": 1}, broken)
    assert TR._manifest(spark, str(tmp_path / "x"), '{"a": 1}') is None
    out = TR.written_together(spark, str(tmp_path / "x"), {"a": 1}, lambda: {"train": probe})
    assert out["train"].count() == 160


class Broken:
    @property
    def schema(self):
        raise RuntimeError("lost")


def test_four_equalities(spark, probe, tmp_path):
    ev = TR.prepare(probe, GOALS, CFG, "m", str(tmp_path), "run")["eval"]
    n = {r.split: r["count"] for r in ev.groupBy("split").count().collect()}
    assert n["train_source_test_inst"] == n["test_source_train_inst"] == min(n["train"], n["test"])
    faults = {r.check: r.faults for r in TR.cross_faults(ev, GOALS).collect()}
    assert len(faults) == 4 and set(faults.values()) == {0}
    moved = ev.withColumn("text", F.when(F.col("split") == "test_source_train_inst", "other").otherwise(F.col("text")))
    assert sum(r.faults for r in TR.cross_faults(moved, GOALS).collect()) > 0


def test_targets_are_recomputed_and_clipped(spark, probe, tmp_path):
    ev = TR.prepare(probe, GOALS, CFG, "m", str(tmp_path), "run")["eval"].filter("split like '%source%'")
    for g in GOALS:
        want = F.least(F.greatest(F.coalesce(F.col(f"source_{g}") + F.col(f"delta_{g}"), F.col(f"source_{g}")), F.lit(0.0)), F.lit(1.0))
        assert ev.filter(want != F.col(f"target_{g}")).count() == 0


@pytest.mark.parametrize("a, b", [(7, 3), (3, 7), (5, 0)])
def test_unequal_sides_pair_both_ways(spark, a, b):
    left, right = spark.range(a).select(F.col("id").alias("k")), spark.range(100, 100 + b).select(F.col("id").alias("k"))
    pairs = SP.paired_keys(left, right, ["k"])
    assert sorted(map(tuple, pairs.select("_a_k", "_b_k").collect())) == [(i, 100 + i) for i in range(min(a, b))]


def test_saved_sides_and_checks(spark, probe, tmp_path):
    train, test = TR.create_train_test(probe, GOALS, CFG, "m")
    train.withColumn("prompt", F.to_json("prompt")).write.parquet(str(tmp_path / "train.parquet"))
    test.write.parquet(str(tmp_path / "test.parquet"))
    cfg = TR.TrainingConfig(**(CFG.__dict__ | {"train_probe_path": str(tmp_path / "train.parquet"), "test_probe_path": str(tmp_path / "test.parquet"),
                                               "insts_per_probe_source_text": None}))
    got = TR.create_train_test(probe.filter("false"), GOALS, cfg, "m")
    assert rows(got[0]) == rows(train) and rows(got[1]) == rows(test)
    assert TR.prepare(probe, GOALS, cfg, "m", str(tmp_path), "saved")["eval"].filter("split = 'train'").count() == min(12, train.count())
    with pytest.raises(ValueError, match="multiple"):
        TR.TrainingConfig(4, 3, 10, 9).check()
    with pytest.raises(ValueError, match="test_probe_path"):
        TR.TrainingConfig(4, 1, 10, 9, None).check()
    assert {r.split for r in TR.evaluation_set(train, test, GOALS, TR.TrainingConfig(4, 2, 8, 8, 2, cross_probes=False)).select("split").distinct().collect()} == {"train", "test"}
