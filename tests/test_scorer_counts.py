"""Counts, tags and MTLD of the Arrow-batched scorers against the patterns and rules as Columns."""

import random

import pytest
from pyspark.sql import functions as F

from tonegauge.functions import scorers as S
from tonegauge.functions import text as tx

WORDS = ["the", "quickly", "running", "nation", "famous", "we", "Été", "naïve", "İa", "K2", "x-y", "…", "wow!", "end.", "a.b", "?", "日本", "½", "e\u0301a", "🙂", "\u00a0", "\n", "co"]


def texts():
    r = random.Random(5)
    rows = [None, "", " ", "\n", "...", "a", "Hi! you", "İİa", "é"]
    return rows + [r.choice([" ", ""]).join(r.choices(WORDS, k=r.randrange(40))) for _ in range(300)] + [None]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(list(enumerate(texts())), "i int, t string").repartition(3, "i").cache()


def test_counts_equal_the_patterns(df):
    found = [F.size(F.regexp_extract_all(t, F.lit(p), 0)) for t, p in
             ((F.col("t"), tx.TOKEN), (F.col("t"), tx.WORD), (F.col("t"), S.SENTENCE_WITH_WORD), (F.lower("t"), S.VOWEL_GROUP))]
    rows = df.select("t", S.text_counts(F.col("t")).alias("x"), *[c.alias(f"w{i}") for i, c in enumerate(found)]).collect()
    for r in rows:
        assert (r.x is None) == (r.t is None)
        assert r.x is None or tuple(r.x) == (r.w0, r.w1, r.w2, r.w3), r.t


def test_tags_equal_the_rules(df):
    toks = S.alpha_tokens(F.col("t"))
    rows = df.select("t", S.tag_counts(toks).alias("n"), F.transform(toks, S.pos_tag).alias("tags"), *S.pos_percentages(F.col("t")), S.formality(F.col("t")).alias("f")).collect()
    for r in rows:
        assert (r.n is None) == (r.t is None)
        want = [(r.tags or []).count(tag) for tag in [*S.POS_TAGS, "OTHER"]]
        assert r.n is None or r.n == want, r.t
        total = sum(want)
        assert [r[f"pct_{tag.lower()}"] for tag in S.POS_TAGS] == pytest.approx([100 * n / total if total else 0.0 for n in want[:-1]])
        signed = sum(S.DEICTIC[tag] * n for tag, n in zip(S.POS_TAGS, want))
        assert r.f == pytest.approx((signed / total * 100 + 100) / 2 if total else 50.0)


def test_texts_are_read_once_a_scorer(df):
    """One tokenisation for all shares, and no pattern run again by the grade's cases."""
    plan = lambda *cols: df.select(*cols)._jdf.queryExecution().executedPlan().toString()
    assert plan(*S.pos_percentages(F.col("t"))).count("regexp_extract_all") == 1
    assert "regexp_extract_all" not in plan(S.reading_difficulty(F.col("t")))


def test_mtld_of_nulls_and_empty_arrays(df):
    rows = df.select("t", S.mtld(S.diversity_tokens(F.col("t"))).alias("a"), S.mtld_fold(S.diversity_tokens(F.col("t"))).alias("b")).collect()
    for r in rows:
        assert r.a == pytest.approx(r.b) if r.t is not None else r.a is None, r.t
