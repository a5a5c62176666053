"""Inverse-distance field, lexicon tagging, prompt strategies and narrow best-of-N plans."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tonegauge.functions import scorers as S
from tonegauge.operators import best as B
from tonegauge.operators import flow as FL
from tonegauge.operators import prompts as PR
from tonegauge.operators import tagging as TG


def idw_brute(points, n, radius):
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    place = lambda v, lo, hi: (v - lo) / (hi - lo) * (n - 1) if hi > lo else 0.0
    at = [(place(x, min(xs), max(xs)), place(y, min(ys), max(ys)), u, v) for x, y, u, v in points]
    out = {}
    for gx in range(n):
        for gy in range(n):
            near = [((fx - gx) ** 2 + (fy - gy) ** 2, u, v) for fx, fy, u, v in at if (fx - gx) ** 2 + (fy - gy) ** 2 <= radius**2]
            on = [p for p in near if p[0] == 0]
            if near:
                w = [(1.0, u, v) for _, u, v in on] or [(1 / d, u, v) for d, u, v in near]
                out[gx, gy] = (sum(a * u for a, u, _ in w) / sum(a for a, *_ in w), sum(a * v for a, _, v in w) / sum(a for a, *_ in w), len(near))
    return out


@pytest.mark.parametrize("radius", [0, 1, 3])
def test_idw_against_all_pairs(spark, radius):
    r = random.Random(radius)
    points = [(r.random(), r.random(), r.gauss(0, 1), r.gauss(0, 1)) for _ in range(60)] + [(0.0, 0.0, 1.0, 2.0), (1.0, 1.0, 3.0, 4.0), (0.0, 0.0, 3.0, 0.0)]
    df = spark.createDataFrame(points, "x1 double, x2 double, u double, v double").repartition(3)
    got = {(x.gx, x.gy): (x.u, x.v, x.n) for x in FL.idw_field(df, 11, radius).collect()}
    want = idw_brute(points, 11, radius)
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-9)
    same = spark.createDataFrame([("g", 1.0, 5.0, 2.0, 4.0)] * 3, "k string, x1 double, x2 double, u double, v double")
    assert [(x.k, x.gx, x.gy, x.u, x.v) for x in FL.idw_field(same, 5, 0, ("k",)).collect()] == [("g", 0, 0, 2.0, 4.0)]


@pytest.mark.parametrize("small", [200_000, 0])
def test_a_lexicon_equals_the_inline_tagger(spark, monkeypatch, small):
    monkeypatch.setattr(TG, "SMALL_LEXICON", small)
    texts = ["The quick fox is not quickly running to a house, oh!", None, "", "12 34", "An apple and an Apple because she was beautiful", "nationalize wonderful happily"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])], "id int, text string")
    inline = {r[0]: tuple(r)[1:] for r in df.dropDuplicates().select("id", *S.pos_percentages(F.col("text"))).collect()}
    twice = TG.closed_classes(spark).union(spark.createDataFrame([("the", "X")], "token string, tag string"))
    got = TG.lexicon_percentages(df, ["id"], twice).collect()
    assert len(got) == len(inline)
    for r in got:
        assert tuple(r)[1:] == pytest.approx(inline[r.id]), texts[r.id]


def test_tagged_tokens(spark):
    tagged = spark.createDataFrame([(1, "The", "DET"), (1, "this", "DET"), (1, "dog", "NOUN"), (1, "x", "PROPN")], "id int, token string, tag string")
    df = spark.createDataFrame([(1,), (2,)], "id int")
    got = {r.id: (r.pct_article, r.pct_noun, r.pct_verb) for r in TG.shares(df, ["id"], tagged).collect()}
    assert got == {1: (25.0, 25.0, 0.0), 2: (0.0, 0.0, 0.0)}


def test_strategies_by_one_entry(spark):
    goals = ["reading_difficulty", "formality"]
    df = spark.createDataFrame([(1, 0.3, None), (2, None, -0.6), (3, None, None)], "id int, delta_reading_difficulty double, delta_formality double")
    db = spark.createDataFrame([(0.3, None, ["do one", "do two"]), (None, -0.6, ["do three"]), (None, None, [])],
                               "delta_reading_difficulty double, delta_formality double, edit_instruction array<string>")
    for name, base in (("direct+inst", "direct"), ("instruct", "null")):
        got = {r.id: r.instructions for r in PR.with_instructions(df, name, goals, ["id"], database=db).collect()}
        plain = {r.id: r.i for r in df.select("id", PR.instruction_for(base, goals, ["id"], no_explain=False).alias("i")).collect()}
        assert set(got) == {1, 2, 3} and all(got[i].startswith(plain[i]) for i in got)
        assert "do one" in got[1] and "do two" in got[1] and "do three" in got[2]
        with pytest.raises(ValueError, match="database"):
            PR.with_instructions(df, name, goals, ["id"])
        with pytest.raises(Exception, match="no instruction database entry"):
            PR.with_instructions(df, name, goals, ["id"], database=db.filter("delta_formality is null")).collect()
    assert {r.instructions for r in PR.with_instructions(df, "null", goals, ["id"]).collect()} == {r.i for r in df.select(PR.null_instruction().alias("i")).collect()}
    with pytest.raises(ValueError):
        PR.with_instructions(df, "no such", goals, ["id"])


@pytest.mark.parametrize("mode", ["best", "worst", "median"])
def test_best_of_n_against_loops(spark, mode):
    r = random.Random(1)
    rows = []
    for t in range(6):
        target = r.choice([0.4, None])
        rows += [(t // 2, g, f"text {t // 2}", 0.5, target, (target or 0.5) - 0.5, r.choice([0.1, 0.3, 0.5, 0.9, None])) for g in range(t * 7, t * 7 + 7)]
    df = spark.createDataFrame(rows, "id int, gen int, text string, source_a double, target_a double, delta_a double, output_a double").repartition(3)
    from tonegauge.operators import metrics as M
    errs = {(x.id, x.gen): (x.text, x.target_a, x.steering_error) for x in M.with_metrics(df, ["a"]).collect()}
    groups = {}
    for key, (text, target, e) in sorted(errs.items()):
        groups.setdefault((text, target), []).append((e, key))
    want = []
    for members in groups.values():
        known = sorted(m for m in members if m[0] is not None)
        if mode == "median":
            mid = {known[(len(known) - 1) // 2][0], known[len(known) // 2][0]}
            want.append(min(k for e, k in known if e in mid))
        else:
            edge = (min if mode == "best" else max)(e for e, _ in known)
            want.append(min(k for e, k in known if e == edge))
    pick = B.oracle_median(df, ["a"], ["id", "gen"]) if mode == "median" else B.oracle_pick(df, ["a"], ["id", "gen"], mode)
    got = pick.collect()
    assert sorted((x.id, x.gen) for x in got) == sorted(want)
    assert all(x.text == f"text {x.id}" and not math.isnan(x.steering_error) for x in got)
