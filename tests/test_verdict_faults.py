"""Judge noise and caches that earlier versions failed on."""

import os

import pytest
from pyspark.sql import functions as F

from tonegauge.functions import text as X
from tonegauge.keys import u
from tonegauge.operators import goalspace as G
from tonegauge.operators import judge as J
from tonegauge.operators import prompts as PR
from tonegauge.operators import quantiles as Q
from tonegauge.operators import rewards as RW
from tonegauge.operators.splits import split_fraction
from tonegauge.sources import tables as TB


def test_pairwise_verdicts_without_rationale_or_repeated(spark):
    rows = ['x "higher_a": {"answer": "A"} y', 'x "higher_a": {"answer": "A", "rationale": "one"}, "higher_a": {"answer": "B", "rationale": "two"}', "noise"]
    got = [r.m for r in spark.createDataFrame([(r,) for r in rows], "s string").select(X.parse_pairwise_verdict(F.col("s")).alias("m")).collect()]
    assert (got[0]["higher_a"].answer, got[0]["higher_a"].rationale) == ("A", None)
    assert (got[1]["higher_a"].answer, got[1]["higher_a"].rationale) == ("B", "two")
    assert got[2] == {}


def test_cache_with_a_repeated_key_does_not_multiply_rows(spark):
    df = spark.createDataFrame([(1, "one two three."), (2, "four five.")], "id long, text string")
    _, cache = G.map_with_cache(df, None, ["text_length"])
    out, _ = G.map_with_cache(df, cache.unionByName(cache), ["text_length"])
    assert out.count() == 2


def test_cache_keeps_scores_of_other_goals_and_texts(spark):
    df = spark.createDataFrame([(1, "one two three."), (2, "four five.")], "id long, text string")
    _, cache = G.map_with_cache(df.filter("id = 1"), None, ["text_length"])
    other = spark.createDataFrame([("not here", 7.0, 9.0)], "text_key string, text_length double, mood double")
    old = cache.unionByName(other, allowMissingColumns=True)
    out, new = G.map_with_cache(df, old, ["text_length", "reading_difficulty"])
    assert out.filter("text_length is null or reading_difficulty is null").isEmpty() and out.count() == 2
    row = new.filter("text_key = 'not here'").first()
    assert (new.count(), row.mood, row.text_length, row.reading_difficulty) == (3, 9.0, 7.0, None)


def test_order_statistics_of_extreme_doubles_and_nan(spark):
    import random

    big = [1.7e308, -1.7e308, 5e-324, -5e-324, 0.0, 1e-300, float("inf"), float("-inf")]
    rng = random.Random(5)
    values = big + [rng.choice((-1, 1)) * 10 ** rng.uniform(-300, 300) for _ in range(9000)]
    df = spark.createDataFrame([(v,) for v in values + [float("nan")] * 50 + [None]], "v double")
    stats = Q.describe(df, ["v"], (0.0, 0.5, 1.0), moments=False)["v"]
    assert (stats["n"], stats["min"], stats["max"]) == (len(values), float("-inf"), float("inf"))
    ranks = {0, 1, 2, len(values) // 3, len(values) // 2, len(values) - 2}
    found = Q.order_statistics(df.select(Q._number("v").alias("v0")), ["v"], {"v": ranks}, {"v": stats})
    assert {r: found[("v", r)] for r in ranks} == {r: sorted(values)[r] for r in ranks}


def test_split_is_exact_and_uniforms_are_fine_grained(spark):
    df = spark.range(300000).withColumnRenamed("id", "k")
    assert df.select(u("col:k", 42, "split").alias("u")).distinct().count() == 300000
    assert split_fraction(df, ["k"], 0.25).filter("in_first").count() == 75000


def test_rows_without_an_instruction_entry_are_kept_or_fail(spark):
    goals = ["formality"]
    rows = spark.createDataFrame([(1, 0.3), (2, None), (3, -0.9)], "id long, delta_formality double")
    db = spark.createDataFrame([(0.3, ["be formal"]), (None, ["keep it"])], "delta_formality double, edit_instruction array<string>")
    out = PR.with_sampled_instructions(rows, db, goals, ["id"], F.lit("Do."), missing="null")
    assert {r.id: r.instructions is None for r in out.collect()} == {1: False, 2: False, 3: True}
    with pytest.raises(Exception, match="no instruction database entry"):
        PR.with_sampled_instructions(rows, db, goals, ["id"], F.lit("Do.")).collect()


def test_rewards_take_chat_messages_and_ignore_tracked_nulls(spark):
    df = spark.createDataFrame([(1, 0.5, 0.5, 0.5, None, [{"role": "assistant", "content": "<think>a</think> 中"}])],
                               "id long, source_formality double, target_formality double, output_formality double, "
                               "output_text_length double, completion array<struct<role:string,content:string>>")
    df = df.withColumns({"source_text_length": F.lit(0.1), "target_text_length": F.lit(0.2)})
    plan = [("think_format", 1.0), ("english_only", 1.0), ("tl_error", 0.0)]
    row = RW.with_rewards(df, plan, ["formality", "text_length"]).first()
    assert (row.r0_think_format, row.r1_english_only, row.r2_tl_error, row.reward) == (1.0, 0.0, None, 1.0)


def test_phrases_and_whole_texts(spark):
    df = spark.createDataFrame([(0.6,), (0.1,), (-0.3,)], "delta_formality double")
    got = [r.p for r in df.select(PR._phrase("formality", F.col("delta_formality")).alias("p")).collect()]
    assert got == ["much more formal", "slightly more formal", "more informal"]
    text = " ".join(["word"] * 6000)
    one = spark.createDataFrame([(text,)], "t string").select(X.truncate_tokens(F.col("t")).alias("a"), X.truncate_tokens(F.col("t"), 10).alias("b")).first()
    assert one.a == text and one.b == " ".join(["word"] * 10)


def test_kendall_tau_against_pairs(spark):
    import itertools
    import random

    rng = random.Random(3)
    rows = [("a", rng.choice((-1, 0, 1)), rng.choice((-1, 0, 1))) for _ in range(60)] + [("a", None, 1), ("b", 1, 1), ("b", 1, 1)]
    got = {r.attribute: r for r in J.kendall_tau(spark.createDataFrame(rows, "attribute string, x int, y int")).collect()}
    kept = [(x, y) for a, x, y in rows if a == "a" and x is not None]
    s = [((p[0] > q[0]) - (p[0] < q[0]), (p[1] > q[1]) - (p[1] < q[1])) for p, q in itertools.combinations(kept, 2)]
    want = sum(a * b for a, b in s) / (sum(a != 0 for a, _ in s) * sum(b != 0 for _, b in s)) ** 0.5
    assert abs(got["a"].tau - want) < 1e-12 and got["a"].n == 60 and got["b"].tau is None


def test_a_phase_cut_short_is_written_again(spark, tmp_path):
    path = str(tmp_path / "phase")
    os.mkdir(path)
    assert TB.phase(spark, path, lambda: spark.range(3)).count() == 3
    assert TB.phase(spark, path, lambda: spark.range(9)).count() == 3
    with pytest.raises(ValueError, match="none of the configured"):
        TB.collect_datasets(spark, str(tmp_path), [{"name": "absent", "feature_col": "text"}])
