"""Golden rows (FIXTURES.md §3) and unit checks of the Column-level operators."""

import math

import pytest
from pyspark.sql import functions as F

from tonegauge.functions import text as tx
from tonegauge.functions.scorers import mtld_value
from tonegauge.operators import metrics as M
from tonegauge.operators import probe as P

G = ["reading_difficulty", "textual_diversity", "text_length", "formality"]
N = None
ROWS = [
    # id, source, target, output, delta, steering, miscal, ortho
    ("X1", [.5, .5, .5, .5], [.8, N, .3, N], [.8, .5, .3, .5], [.3, N, -.2, N], 0.0, 0.0, 0.0),
    ("X2", [.5, .5, .5, .5], [.9, N, N, N], [.65, .75, .5, .5], [.4, N, N, N], 0.3194382825, 0.4999999650, 0.8943471982),
    ("X3", [.4, .6, .2, .7], [N, .9, N, .2], [.4, .6, .2, .7], [N, .3, N, -.5], 0.4040610178, 0.9999999505, 0.00061249995),
    ("X4", [.5, .5, .5, .5], [N, N, N, N], [.5, .65, .5, .5], [N, N, N, N], 0.1428571429, 0.0, 1.0),
    ("X5", [1., .5, .5, .5], [N, .8, N, N], [.95, .8, .5, .5], [N, .3, N, N], 0.5714285714, 0.0, 1.0),
    ("X6", [.5, .5, .5, .5], [.8, N, N, N], [.8, N, .5, .5], [.3, N, N, N], 0.5714285714, 0.0, 0.8943871928),
]


def _golden_df(spark):
    rows = []
    for rid, s, t, o, d, *_ in ROWS:
        rows.append(tuple([rid] + s + t + o + d))
    cols = ["id"] + [f"{p}_{g}" for p in ("source", "target", "output", "delta") for g in G]
    schema = "id STRING, " + ", ".join(f"{c} DOUBLE" for c in cols[1:])
    return spark.createDataFrame(rows, schema)


def test_golden_metrics(spark):
    out = {r["id"]: r for r in M.with_metrics(_golden_df(spark), G).collect()}
    for rid, *_, se, mc, orth in ROWS:
        r = out[rid]
        assert r["steering_error"] == pytest.approx(se, abs=1e-6), rid
        assert r["miscalibration"] == pytest.approx(mc, abs=1e-6), rid
        assert r["orthogonality"] == pytest.approx(orth, abs=1e-3), rid


def test_bin_edges(spark):
    cases = [(1.0, 1.0, 7), (0.95, 1.0, 3), (0.0, 0.0, 3), (0.5, 0.5, 3), (0.6, 0.5, 4), (0.4, 0.3, 4), (1.0, 0.95, 7), (1.0, 0.05, 7)]
    df = spark.createDataFrame([(v, s) for v, s, _ in cases], "v DOUBLE, s DOUBLE")
    got = [r[0] for r in df.select(M.bin_at(F.col("v"), F.col("s"))).collect()]
    assert got == [b for *_, b in cases]


def test_delta_generator(spark):
    cases = [(.5, 0, -.5), (.5, .25, -.3), (.5, .5, .1), (.5, .75, .3), (.05, .5, .4), (.95, .5, -.4), (.2, .1, -.13), (.2, .5, .35)]
    df = spark.createDataFrame([(float(s), float(u)) for s, u, _ in cases], "s DOUBLE, u DOUBLE")
    got = [r[0] for r in df.select(P.delta_from_uniform(F.col("s"), F.col("u"))).collect()]
    for (s, u, want), g in zip(cases, got):
        assert g == pytest.approx(want, abs=1e-9)
        assert -s - 1e-12 <= g <= 1 - s + 1e-12 and abs(g) >= 0.1 - 1e-12


def test_text_cases(spark):
    df = spark.createDataFrame([("hello\nworld. ok.\nnext", "<think>a\nb</think>\n\nHello\nx", "1. do a\n2 . do b\nz")], "a STRING, b STRING, c STRING")
    r = df.select(tx.newlines_as_sentences(F.col("a"), compat=True).alias("c3"), tx.strip_think(F.col("b")).alias("c5"),
                  tx.numbered_items(F.col("c")).alias("c9")).first()
    assert r["c3"] == "hell. world. ok.\nnext"
    assert r["c5"] == "Hello\nx"
    assert r["c9"] == ["do a", "do b"]


def test_verdict_fallback(spark):
    df = spark.createDataFrame([('{"answer": "Yes", "rationale": "r",}',), ('{"answer": Yes, "rationale": "r",}',), ('{"answer": "No", "rationale": "x"}',)], "s STRING")
    got = [(r["v"]["answer"], r["v"]["rationale"]) for r in df.select(tx.parse_verdict(F.col("s")).alias("v")).collect()]
    assert got == [(None, "r"), ("Yes", "r"), ("No", "x")]


def test_kendall_tau(spark):
    from tonegauge.operators.judge import kendall_tau
    x = [1, 1, 0, -1, -1, 0, 1, -1]
    y = [1, 0, 0, -1, 1, 0, 1, -1]
    df = spark.createDataFrame([("a", a, b) for a, b in zip(x, y)], "attribute STRING, x INT, y INT")
    r = kendall_tau(df).first()
    assert r["tau"] == pytest.approx(0.5238095238, abs=1e-9)
    assert r["n"] == 8


def test_mtld_udf_matches_fold(spark):
    from tonegauge.functions.scorers import diversity_tokens, mtld, mtld_fold
    df = spark.createDataFrame([("the cat sat on the mat and the dog sat on the log " * 5,), ("",), ("one two three",)], "t STRING")
    r = df.select(mtld(diversity_tokens(F.col("t"))).alias("a"), mtld_fold(diversity_tokens(F.col("t"))).alias("b")).collect()
    for row in r:
        assert row["a"] == pytest.approx(row["b"], abs=1e-12)
    assert mtld_value([]) == 0.0


def bleu_brute(cand, ref):
    """Clipped n-gram precisions, method-1 smoothing, brevity penalty, by counting."""
    p = []
    for n in range(1, 5):
        cg = [tuple(cand[i:i + n]) for i in range(len(cand) - n + 1)]
        rg = [tuple(ref[i:i + n]) for i in range(len(ref) - n + 1)]
        m = sum(min(cg.count(g), rg.count(g)) for g in set(cg))
        if n == 1 and m == 0:
            return 0.0
        p.append((m if m else 0.1) / max(1, len(cg)))
    return math.exp(sum(0.25 * math.log(x) for x in p)) * (1 if len(cand) > len(ref) else math.exp(1 - len(ref) / len(cand)))


def test_bleu_brute_force(spark):
    from tonegauge.operators.flow import bleu_by_source, with_bleu
    pairs = [("the cat is on the mat", "the cat sat on the mat"), ("a a a a", "a"), ("a", "a b c"), ("x y", "z"), ("", "a"), ("a", ""), ("a b c d e", "a b c d e"), ("the the cat", "the cat the the")]
    rows = [(i, c, r, "s") for i, (c, r) in enumerate(pairs)] * 2 + [(90, None, "a", "s"), (91, "a", None, "t")]
    df = spark.createDataFrame(rows, "i INT, llm_response STRING, text STRING, source STRING")
    out = with_bleu(df)
    got = [(r.i, r.bleu) for r in out.collect()]
    assert len(got) == len(rows) and {i for i, b in got if b is None} == {90, 91}
    for i, b in got:
        if b is not None:
            assert b == pytest.approx(bleu_brute(*(t.split() for t in pairs[i])), abs=1e-12), pairs[i]
    by = {r.source: (r.mean_bleu, r.n) for r in bleu_by_source(out).collect()}
    assert by["t"] == (None, 1) and by["all"][1] == len(rows)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
