"""Queries B8, B9, I1-I8 (judge analytics) and K1-K4 (best-of-N, top-k)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonegauge.functions import text as tx
from tonegauge.keys import u, u4, u4_sql, u_sql
from tonegauge.operators import best as B
from tonegauge.operators import judge as J
from tonegauge.operators import metrics as M
from tonegauge.plans import fixtures as X
from tonegauge.plans.registry import query, rounded

G = X.GOALS
KEY = ["original_index", "rep", "generation"]
KEY_SQL = "original_index, rep, generation"
W = X.with_ctes

# Fixed value: our judge prompt template (the judge itself runs outside; only the substitution is ours).
JUDGE_TEMPLATE = ("Decide whether the two texts below could describe the same story or event.\n\n"
                  "Version A:\n$version_a\n\nVersion B:\n$version_b\n\n"
                  "Return a JSON object with keys \"answer\" (Yes or No) and \"rationale\".")


@query("b8_grounded_subset", W(X.sql_judged(), f"SELECT {KEY_SQL}, answer, rationale_approved FROM judged WHERE {M.grounded_sql()}"))
def b8_grounded_subset(spark, sf):
    """Rows with (approved and Yes) or (not approved and No)."""
    return J.grounded_subset(X.judged(spark, sf)).select(*KEY, "answer", "rationale_approved")


@query("b9_grounded_complement", W(X.sql_judged(), f"SELECT {KEY_SQL}, answer, rationale_approved FROM judged WHERE NOT coalesce({M.grounded_sql()}, FALSE)"))
def b9_grounded_complement(spark, sf):
    """The complement of B8 (flip)."""
    return J.grounded_subset(X.judged(spark, sf), flip=True).select(*KEY, "answer", "rationale_approved")


def _ab_sql():
    m = f"({u_sql('col:original_index', 'col:rep', 'col:generation', 42, 'ab')} < 0.5)"
    return [("ab", f"SELECT *, {m} AS source_text_is_a, CASE WHEN {m} THEN text ELSE llm_response END AS version_a, "
                   f"CASE WHEN {m} THEN llm_response ELSE text END AS version_b FROM judged")]


@query("i1_problem_set", W(X.sql_judged() + _ab_sql(),
                           f"SELECT {KEY_SQL}, source_text_is_a, md5({tx.fill_template_sql(JUDGE_TEMPLATE, version_a=tx.truncate_tokens_sql('version_a'), version_b=tx.truncate_tokens_sql('version_b'))}) AS prompt_md5, "
                           f"CAST(len({tx.fill_template_sql(JUDGE_TEMPLATE, version_a=tx.truncate_tokens_sql('version_a'), version_b=tx.truncate_tokens_sql('version_b'))}) AS BIGINT) AS prompt_chars FROM ab"))
def i1_problem_set(spark, sf):
    """Blind A/B problem set with the judge prompt (whole prompt checked via md5 and length)."""
    p = J.problem_set(X.judged(spark, sf), JUDGE_TEMPLATE, KEY)
    return p.select(*KEY, "source_text_is_a", F.md5("prompt").alias("prompt_md5"), F.length("prompt").cast("bigint").alias("prompt_chars"))


@query("i2_answer_key", W(X.sql_judged() + _ab_sql(), f"SELECT {KEY_SQL}, " + ", ".join(
    f"{J.answer_key_sql(f'source_{g}', f'output_{g}', 'source_text_is_a')} AS answer_{g}" for g in G) + " FROM ab"))
def i2_answer_key(spark, sf):
    """Per-goal answer key (Tie / A / B, literal '0' at exactly the threshold or on nulls)."""
    p = J.problem_set(X.judged(spark, sf), JUDGE_TEMPLATE, KEY)
    return p.select(*KEY, *[J.answer_key(F.col(f"source_{g}"), F.col(f"output_{g}"), F.col("source_text_is_a")).alias(f"answer_{g}") for g in G])


@query("i3_verdict_counts", W(X.sql_judged(), "SELECT answer, count(*) AS count FROM judged WHERE answer IS NOT NULL GROUP BY answer"))
def i3_verdict_counts(spark, sf):
    """Verdict counts."""
    return J.verdict_counts(X.judged(spark, sf))


@query("i4_no_report", W(X.sql_judged(), "SELECT md5(text) AS text_md5, md5(llm_response) AS response_md5, rationale FROM judged WHERE answer = 'No'"))
def i4_no_report(spark, sf):
    """I4: the judge's No answers (texts reported by md5 to keep the comparison light)."""
    r = J.no_report(X.judged(spark, sf))
    return r.select(F.md5("text").alias("text_md5"), F.md5("llm_response").alias("response_md5"), "rationale")


def _queue_sql():
    us = u_sql("col:original_index", "col:rep", "col:generation", 42, "spot")
    return [("q_not", f"SELECT {KEY_SQL}, answer, 'not_yes' AS queue FROM judged WHERE NOT (answer IS NOT DISTINCT FROM 'Yes')"),
            ("q_yes", f"SELECT {KEY_SQL}, answer, 'spot_check' AS queue FROM judged WHERE answer IS NOT DISTINCT FROM 'Yes' "
                      f"ORDER BY {us}, {KEY_SQL} LIMIT 16"),
            ("queue", "SELECT * FROM q_not UNION ALL SELECT * FROM q_yes")]


@query("i5_review_queue", W(X.sql_judged() + _queue_sql(), "SELECT * FROM queue"))
def i5_review_queue(spark, sf):
    """Review queue = all non-Yes rows + 16 seeded Yes spot checks."""
    return J.review_queue(X.judged(spark, sf), KEY).select(*KEY, "answer", "queue")


def _decisions(spark, sf):
    """Stand-in reviewer decisions over the I5 queue: approve when ``u < 0.75``; each queued row
    decided twice (ord 1, 2) so last-wins is exercised."""
    j = X.judged(spark, sf)
    q = J.review_queue(j, KEY).select(*KEY, "text", "llm_response", "rationale")
    q = X.P.repeat_rows(q, 2, "k")
    order = F.col("original_index") * 1000 + F.col("rep") * 100 + F.col("generation") * 10 + F.col("k")
    return q.select("text", "llm_response", "rationale", order.cast("bigint").alias("ord"),
                    (u("col:original_index", "col:rep", "col:generation", "col:k", 42, "review") < F.lit(0.75)).alias("rationale_approved"))


@query("i6_apply_review", W(X.sql_judged() + [
    ("jt", "SELECT * FROM judged")] + [
    (n, b.replace("SELECT " + KEY_SQL + ", answer,", "SELECT " + KEY_SQL + ", answer, text, llm_response, rationale,")) for n, b in _queue_sql()] + [
    ("dec0", "SELECT q.text, q.llm_response, q.rationale, CAST(q.original_index * 1000 + q.rep * 100 + q.generation * 10 + o.ord AS BIGINT) AS ord, "
             f"{u_sql('col:q.original_index', 'col:q.rep', 'col:q.generation', 'col:o.ord', 42, 'review')} < 0.75 AS rationale_approved "
             "FROM queue q CROSS JOIN (SELECT unnest(generate_series(1, 2)) AS ord) o WHERE q.text IS NOT NULL AND q.llm_response IS NOT NULL AND q.rationale IS NOT NULL"),
    ("dec", "SELECT text, llm_response, rationale, arg_max(rationale_approved, ord) AS approved FROM dec0 GROUP BY text, llm_response, rationale")],
    f"SELECT jt.original_index, jt.rep, jt.generation, CASE WHEN dec.approved IS NOT NULL THEN dec.approved ELSE coalesce(jt.rationale_approved, TRUE) END AS rationale_approved, "
    "CASE WHEN dec.approved IS NOT NULL THEN TRUE ELSE coalesce(jt.spot_check, FALSE) END AS spot_check "
    "FROM jt LEFT JOIN dec ON jt.text = dec.text AND jt.llm_response = dec.llm_response AND jt.rationale = dec.rationale"))
def i6_apply_review(spark, sf):
    """Apply (stand-in) review decisions by (text, response, rationale), last decision wins."""
    out = J.apply_review(X.judged(spark, sf), _decisions(spark, sf))
    return out.select(*KEY, "rationale_approved", "spot_check")


def _choice(key_col, us):
    """Stand-in judge choice: the answer key 70 %, unparsed (null) 10 %, else a random label."""
    u1, u2 = us
    return (F.when(u1 < 0.7, key_col).when(u1 < 0.8, F.lit(None).cast("string"))
            .otherwise(F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("Tie")), (F.floor(u2 * 3) + 1).cast("int"))))


def _pairs(spark, sf):
    p = J.problem_set(X.judged(spark, sf), JUDGE_TEMPLATE, KEY)
    rows = []
    for g in G:
        k = J.answer_key(F.col(f"source_{g}"), F.col(f"output_{g}"), F.col("source_text_is_a"))
        us = u4("col:original_index", "col:rep", "col:generation", 42, "judge", g)
        rows.append(F.struct(F.lit(g).alias("attribute"), k.alias("key"), _choice(k, us[:2]).alias("choice")))
    long = p.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return long.select("attribute", tx.label_to_ordinal(F.col("choice")).alias("x"), tx.label_to_ordinal(F.col("key")).alias("y"))


def _pairs_sql():
    parts = []
    for g in G:
        k = J.answer_key_sql(f"source_{g}", f"output_{g}", "source_text_is_a")
        u1, u2, _, _ = u4_sql("col:original_index", "col:rep", "col:generation", 42, "judge", g)
        ch = f"CASE WHEN {u1} < 0.7 THEN {k} WHEN {u1} < 0.8 THEN NULL ELSE ['A', 'B', 'Tie'][CAST(floor({u2} * 3) AS INTEGER) + 1] END"
        parts.append(f"SELECT '{g}' AS attribute, {tx.label_to_ordinal_sql(ch)} AS x, {tx.label_to_ordinal_sql(k)} AS y FROM ab")
    return [("pairs", " UNION ALL ".join(parts))]


def _tau_sql():
    return [
        ("cells", "SELECT attribute, x, y, CAST(count(*) AS DOUBLE) AS c FROM pairs WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL"),
        ("pq", "SELECT a.attribute, sum(CASE WHEN sign(a.x - b.x) * sign(a.y - b.y) > 0 THEN a.c * b.c ELSE 0.0 END) / 2 AS P, "
               "sum(CASE WHEN sign(a.x - b.x) * sign(a.y - b.y) < 0 THEN a.c * b.c ELSE 0.0 END) / 2 AS Q "
               "FROM cells a JOIN cells b ON a.attribute = b.attribute GROUP BY a.attribute"),
        ("tx", "SELECT attribute, sum(t * (t - 1) / 2) AS pairs, sum(t * (t - 1) * (2.0 * t + 5)) AS v1, sum(t * (t - 1) * (t - 2)) AS v2, "
               "sum(t * (t - 1)) AS v3 FROM (SELECT attribute, x, sum(c) AS t FROM cells GROUP BY ALL) GROUP BY attribute"),
        ("ty", "SELECT attribute, sum(t * (t - 1) / 2) AS pairs, sum(t * (t - 1) * (2.0 * t + 5)) AS v1, sum(t * (t - 1) * (t - 2)) AS v2, "
               "sum(t * (t - 1)) AS v3 FROM (SELECT attribute, y, sum(c) AS t FROM cells GROUP BY ALL) GROUP BY attribute"),
        ("nn", "SELECT attribute, sum(c) AS n FROM cells GROUP BY attribute"),
        ("tj", "SELECT nn.attribute, n, P, Q, n * (n - 1) / 2 AS n0, tx.pairs AS xp, ty.pairs AS yp, tx.v1 AS xv1, ty.v1 AS yv1, "
               "tx.v2 AS xv2, ty.v2 AS yv2, tx.v3 AS xv3, ty.v3 AS yv3 FROM nn JOIN pq USING (attribute) JOIN tx USING (attribute) JOIN ty USING (attribute)"),
        ("tv", "SELECT *, (n0 - xp) * (n0 - yp) AS den, (n * (n - 1) * (2.0 * n + 5) - xv1 - yv1) / 18 "
               "+ CASE WHEN n > 2 THEN xv2 * yv2 / (9.0 * n * (n - 1) * (n - 2)) ELSE 0.0 END "
               "+ CASE WHEN n > 1 THEN xv3 * yv3 / (2.0 * n * (n - 1)) ELSE 0.0 END AS var FROM tj"),
        ("tz", "SELECT attribute, n, CASE WHEN den > 0 THEN (P - Q) / sqrt(den) END AS tau, "
               "CASE WHEN var > 0 AND den > 0 THEN abs((P - Q) / sqrt(var)) / sqrt(2.0) END AS zz FROM tv"),
    ]


@query("i7_kendall_tau", W(X.sql_judged() + _ab_sql() + _pairs_sql() + _tau_sql(),
                           f"SELECT attribute, round(tau, 6) AS tau, round({J.erfc_approx_sql('zz')}, 6) AS p, CAST(n AS BIGINT) AS n FROM tz"))
def i7_kendall_tau(spark, sf):
    """Judge validity per attribute: Kendall tau-b of judge choice vs answer key, p, n."""
    return rounded(J.kendall_tau(_pairs(spark, sf)))


def _run_b(df):
    return X.with_outputs(df.drop(*[f"output_{g}" for g in G]), G, KEY, seed=7)


@query("i8_pair_runs", W(X.sql_result() + [("rb0", "SELECT * EXCLUDE (" + ", ".join(f"output_{g}" for g in G) + ") FROM result")]
                         + [(n, b.replace(f"'{X.SEED}'", "'7'")) for n, b in X._output_ctes("rb0", G, KEY, "rb")],
                         f"SELECT {KEY_SQL}, " + ", ".join(f"round(l.output_{g}, 6) AS left_output_{g}, round(r.output_{g}, 6) AS right_output_{g}" for g in G)
                         + f" FROM (SELECT * FROM result) l FULL OUTER JOIN (SELECT * FROM rb) r USING ({KEY_SQL})"))
def i8_pair_runs(spark, sf):
    """I8: a rewrite-vs-rewrite pairing of two runs (prefix + full outer join on the row key)."""
    a = X.result(spark, sf)
    b = _run_b(a)
    out = J.pair_runs(a.select(*KEY, *[f"output_{g}" for g in G]), b.select(*KEY, *[f"output_{g}" for g in G]), KEY)
    return rounded(out)


# ---------------------------------------------------------------- K1 - K4
N_GEN = 4


def _best_sql(mode):
    ctes = X.sql_result(generations=N_GEN) + M.metrics_ctes("result", G, "m")
    order = "steering_error" if mode == "best" else "-steering_error"
    part = "text, " + ", ".join(f"target_{g}" for g in G)
    ctes.append(("rk", f"SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY {order}, {KEY_SQL}) AS rn FROM m"))
    return W(ctes, f"SELECT {KEY_SQL}, round(steering_error, 6) AS steering_error FROM rk WHERE rn = 1")


@query("k1_best_of_n", _best_sql("best"))
def k1_best_of_n(spark, sf):
    """K1: oracle best of 4 generations per (text, targets) by steering error."""
    b = B.oracle_pick(X.result(spark, sf, generations=N_GEN), G, KEY, "best")
    return rounded(b.select(*KEY, "steering_error"))


@query("k1_worst_of_n", _best_sql("worst"))
def k1_worst_of_n(spark, sf):
    """K1 (worst mode): the generation with the highest steering error per group."""
    b = B.oracle_pick(X.result(spark, sf, generations=N_GEN), G, KEY, "worst")
    return rounded(b.select(*KEY, "steering_error"))


def _median_sql():
    ctes = X.sql_result(generations=N_GEN) + M.metrics_ctes("result", G, "m")
    part = "text, " + ", ".join(f"target_{g}" for g in G)
    ctes.append(("md", f"SELECT *, list_sort(list(steering_error) OVER (PARTITION BY {part})) AS arr FROM m"))
    ctes.append(("mm", "SELECT * EXCLUDE (arr), arr[CAST(floor((len(arr) - 1) / 2) AS INTEGER) + 1] AS lo, "
                       "arr[CAST(ceil((len(arr) - 1) / 2) AS INTEGER) + 1] AS hi FROM md"))
    ctes.append(("rk", f"SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY {KEY_SQL}) AS rn FROM mm "
                       "WHERE steering_error = lo OR steering_error = hi"))
    return W(ctes, f"SELECT {KEY_SQL}, round(steering_error, 6) AS steering_error FROM rk WHERE rn = 1")


@query("k2_median_of_n", _median_sql())
def k2_median_of_n(spark, sf):
    """K2: the generation nearest the group median steering error."""
    b = B.oracle_median(X.result(spark, sf, generations=N_GEN), G, KEY)
    return rounded(b.select(*KEY, "steering_error"))


@query("k3_undo_sentinel", W(X.sql_result(generations=N_GEN) + [
    ("f", "SELECT " + KEY_SQL + ", " + ", ".join(f"source_{g}, coalesce(target_{g}, -1.0) AS target_{g}, coalesce(delta_{g}, -1.0) AS delta_{g}" for g in G) + " FROM result")],
    f"SELECT {KEY_SQL}, " + ", ".join(f"round(CASE WHEN target_{g} = -1.0 THEN source_{g} ELSE target_{g} END, 6) AS target_{g}, "
                                      f"round(CASE WHEN delta_{g} = -1.0 THEN 0.0 ELSE delta_{g} END, 6) AS delta_{g}" for g in G) + " FROM f"))
def k3_undo_sentinel(spark, sf):
    """K3: undo the -1 sentinel left by a compat best-of-N (targets -> source, deltas -> 0)."""
    r = X.result(spark, sf, generations=N_GEN)
    filled = r.fillna({c: -1.0 for c in r.columns if c.startswith(("target_", "delta_"))})
    out = B.undo_sentinel(filled, G)
    return rounded(out.select(*KEY, *[c for g in G for c in (f"target_{g}", f"delta_{g}")]))


@query("k4_top_k", W(X.sql_result() + M.metrics_ctes("result", G, "m"),
                     f"(SELECT 'best' AS side, {KEY_SQL}, round(steering_error, 6) AS steering_error FROM m ORDER BY steering_error ASC NULLS LAST, {KEY_SQL} LIMIT 10) "
                     f"UNION ALL (SELECT 'worst' AS side, {KEY_SQL}, round(steering_error, 6) AS steering_error FROM m ORDER BY steering_error DESC NULLS LAST, {KEY_SQL} LIMIT 10)"))
def k4_top_k(spark, sf):
    """K4: the 10 best and the 10 worst rows by steering error (k = 10 and k = -10)."""
    m = M.with_metrics(X.result(spark, sf), G).select(*KEY, "steering_error")
    best = B.top_k(m, "steering_error", 10, KEY).withColumn("side", F.lit("best"))
    worst = B.top_k(m, "steering_error", -10, KEY).withColumn("side", F.lit("worst"))
    return rounded(best.unionByName(worst).select("side", *KEY, "steering_error"))
