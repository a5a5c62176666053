"""Queries H1-H16 (metrics) over the judged / result fixtures."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from tonegauge.operators import metrics as M
from tonegauge.operators import quantiles as Q
from tonegauge.operators import resummary as RS
from tonegauge.plans import fixtures as X
from tonegauge.plans.registry import query, rounded

G = X.GOALS
KEY = ["original_index", "rep", "generation"]
KEY_SQL = "original_index, rep, generation"


def _sql(ctes, final):
    return X.with_ctes(ctes, final)


def _r(cols):
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


# ---------------------------------------------------------------- H1 / H2 bins
@query("h1_dynamic_bins", _sql(
    X.sql_result() + [("b", "SELECT *, " + ", ".join(
        f"CAST({M._bin_sql(f'output_{g}', f'source_{g}')} AS BIGINT) AS bin_output_{g}, "
        f"CAST({M._bin_sql(f'coalesce(target_{g}, source_{g})', f'source_{g}')} AS BIGINT) AS bin_target_{g}" for g in G) + " FROM result")],
    f"SELECT {KEY_SQL}, " + ", ".join(f"bin_output_{g}, bin_target_{g}" for g in G) + " FROM b"))
def h1_dynamic_bins(spark, sf):
    """H1: bin index of output and (filled) target among ``clip(source + c, 0, 1)`` cuts."""
    r = X.result(spark, sf)
    cols = []
    for g in G:
        s = F.col(f"source_{g}")
        cols += [M.bin_at(F.col(f"output_{g}"), s).cast("bigint").alias(f"bin_output_{g}"),
                 M.bin_at(F.coalesce(F.col(f"target_{g}"), s), s).cast("bigint").alias(f"bin_target_{g}")]
    return r.select(*KEY, *cols)


@query("h2_bin_delta", _sql(X.sql_probe(), "SELECT original_index, rep, " + ", ".join(
    f"CAST({M.bin_delta_sql(f'delta_{g}')} AS BIGINT) AS delta_bin_{g}" for g in G) + " FROM probe"))
def h2_bin_delta(spark, sf):
    """H2: fixed interior-cut bins of each requested delta (null delta -> 0, as np.digitize of NaN)."""
    p = X.probe(spark, sf)
    return p.select("original_index", "rep", *[M.bin_delta(F.col(f"delta_{g}")).cast("bigint").alias(f"delta_bin_{g}") for g in G])


# ---------------------------------------------------------------- H3 - H9 per row
def _vec_query(kind):
    def build(spark, sf):
        r = M.with_metrics(X.result(spark, sf), G, keep_parts=True)
        raw = M.with_vectors(X.result(spark, sf), G, binned=False)
        raw = raw.select(*KEY, M.raw_distance(raw, G, kind).alias(f"raw_{kind}_l2"))
        b = r.select(*KEY, *[F.col(f"{kind}_{g}") for g in G], M.raw_distance(r, G, kind).alias(f"{kind}_l2"))
        return rounded(b.join(raw, KEY))
    return build


def _vec_sql(kind):
    ctes = X.sql_result() + M.metrics_ctes("result", G, "mb", keep_parts=True) + M.metrics_ctes("result", G, "mr", binned=False)
    cols = ", ".join(f"round(b.{kind}_{g}, 6) AS {kind}_{g}" for g in G)
    return _sql(ctes, f"SELECT b.original_index, b.rep, b.generation, {cols}, round({M._norm_sql(f'b.{kind}_', G)}, 6) AS {kind}_l2, "
                      f"round({M._norm_sql(f'r.{kind}_', G)}, 6) AS raw_{kind}_l2 FROM mb b JOIN mr r USING ({KEY_SQL})")


query("h3_steering_error", _vec_sql("to_goal"))(_vec_query("to_goal"))
query("h4_movement", _vec_sql("moved"))(_vec_query("moved"))
query("h5_requested", _vec_sql("requested"))(_vec_query("requested"))


@query("h6_h7_projection_rejection", _sql(
    X.sql_result() + M.metrics_ctes("result", G, "mr", binned=False, keep_parts=True),
    f"SELECT {KEY_SQL}, round(_dot_ab / (_n_req + 1e-8::DOUBLE), 6) AS projection, "
    "round(sqrt(" + " + ".join(f"(to_goal_{g} - (_dot_ab / (_dot_bb + 1e-8::DOUBLE)) * requested_{g}) * (to_goal_{g} - (_dot_ab / (_dot_bb + 1e-8::DOUBLE)) * requested_{g})" for g in G)
    + "), 6) AS rejection FROM mr"))
def h6_h7_projection_rejection(spark, sf):
    """H6 / H7 on raw vectors: projection a.b/(|b|+1e-8), rejection |a - (a.b/(b.b+1e-8)) b|,
    a = target - output, b = target - source."""
    v = M.with_vectors(X.result(spark, sf), G, binned=False)
    return rounded(v.select(*KEY, M.scalar_projection("to_goal_", "requested_", G).alias("projection"),
                            M.scalar_rejection("to_goal_", "requested_", G).alias("rejection")))


def _metric_pair(metric):
    def build(spark, sf):
        r = X.result(spark, sf)
        a = M.with_metrics(r, G).select(*KEY, F.col(metric).alias(metric))
        b = M.with_metrics(r, G, normalize=False).select(*KEY, F.col(metric).alias(f"{metric}_unnormalized"))
        return rounded(a.join(b, KEY))
    return build


def _metric_pair_sql(metric):
    ctes = X.sql_result() + M.metrics_ctes("result", G, "ma") + M.metrics_ctes("result", G, "mu", normalize=False)
    return _sql(ctes, f"SELECT {KEY_SQL}, round(a.{metric}, 6) AS {metric}, round(u.{metric}, 6) AS {metric}_unnormalized "
                      f"FROM ma a JOIN mu u USING ({KEY_SQL})")


query("h8_miscalibration", _metric_pair_sql("miscalibration"))(_metric_pair("miscalibration"))
query("h9_orthogonality", _metric_pair_sql("orthogonality"))(_metric_pair("orthogonality"))


# ---------------------------------------------------------------- H10 / H11 summaries
@query("h10_summary", _sql(X.sql_result() + M.metrics_ctes("result", G, "m"), M.summary_sql("m", M.METRICS)))
def h10_summary(spark, sf):
    """Mean, median, min, max, population std, q1, q3, iqr of each metric (all rows)."""
    m = M.with_metrics(X.result(spark, sf), G).select(*M.METRICS)
    return rounded(M.summarize(spark, m, M.METRICS))


def _h11_sql(judged_ctes, goals, src="judged"):
    ctes = judged_ctes + [
        ("jg", f"SELECT *, {M.grounded_sql()} AS _g FROM {src}"),
        ("cnt", "SELECT count(*) AS n_total, count_if(_g) AS n_grounded, count_if(answer IS NOT DISTINCT FROM 'No') AS n_flagged, "
                "count_if(NOT coalesce(rationale_approved, TRUE)) AS n_overruled FROM jg"),
        ("jf", "SELECT * FROM jg WHERE _g"),
    ] + M.metrics_ctes("jf", goals, "m")
    return _sql(ctes, M.summary_sql("m", M.METRICS, ", any_value(cnt.n_total) AS n_total, any_value(cnt.n_grounded) AS n_grounded, "
                                    "any_value(cnt.n_flagged) AS n_flagged, any_value(cnt.n_overruled) AS n_overruled",
                                    " CROSS JOIN cnt"))


H11_SQL = _h11_sql(X.sql_judged(), G)


@query("h11_evaluate", H11_SQL)
def h11_evaluate(spark, sf):
    """H11 flagship: grounded filter, three metrics, exact summaries and judge counts."""
    return rounded(M.evaluate(spark, X.judged(spark, sf), G, judged=True))


def _numeric_judged_sql():
    j = ("njudged", "SELECT r.*, CASE WHEN o.o_orderstatus = 'F' THEN 'Yes' WHEN o.o_orderstatus = 'O' THEN 'No' END AS answer, "
                    "o.o_orderpriority <> '1-URGENT' AS rationale_approved FROM nresult r LEFT JOIN orders o ON r.l_orderkey = o.o_orderkey")
    return X.sql_numeric_result() + [j]


def numeric_judged(spark, sf):
    """Stand-in judge verdicts for the lineitem goals: answer from the order status, approval
    from the order priority (orders joined on the order key; sort-merge or broadcast by AQE).

    The verdicts meet the narrow lines; goals, deltas and outputs are derived behind the join, so they cross no shuffle."""
    def verdicts(lines):
        o = X.read(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "Yes").when(F.col("o_orderstatus") == "O", "No").alias("answer"),
                                               (F.col("o_orderpriority") != "1-URGENT").alias("rationale_approved"))
        return lines.join(o, lines["l_orderkey"] == o["o_orderkey"], "left").drop("o_orderkey")

    r = X.numeric_result(spark, sf, verdicts)
    judged = ["answer", "rationale_approved"]
    return r.select(*[c for c in r.columns if c not in judged], *judged)


@query("h11_evaluate_numeric", _h11_sql(_numeric_judged_sql(), X.NUM_GOALS, "njudged"))
def h11_evaluate_numeric(spark, sf):
    """H11 over four numeric goals from ``lineitem`` (scale test without text)."""
    return rounded(M.evaluate(spark, numeric_judged(spark, sf), X.NUM_GOALS, judged=True))


# ---------------------------------------------------------------- H12 / H13 run comparison
def _run(spark, sf, seed):
    """A run = the same probe with stand-in outputs drawn under ``seed``."""
    p = X.P.repeat_rows(X.probe(spark, sf), 1, "generation")
    return X.with_outputs(p, G, KEY, seed=seed)


def _run_sql(seed, name):
    gen = (f"{name}_g", "SELECT *, CAST(1 AS INTEGER) AS generation FROM probe")
    return [gen] + X._output_ctes(f"{name}_g", G, KEY, name, seed)


@query("h12_control_compare", _sql(
    X.sql_probe() + _run_sql(42, "runa") + _run_sql(7, "runc") + M.metrics_ctes("runa", G, "ma") + M.metrics_ctes("runc", G, "mc")
    + [("d", f"SELECT {KEY_SQL}, " + ", ".join(f"a.{m} - c.{m} AS {m}" for m in M.METRICS) + f" FROM ma a JOIN mc c USING ({KEY_SQL})"),
       ("dl", " UNION ALL ".join(f"SELECT '{m}' AS metric, {m} AS v FROM d" for m in M.METRICS))],
    "SELECT metric, round(quantile_cont(v, 0.5), 6) AS median_diff, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) AS iqr_diff, "
    "round(avg(CASE WHEN v < 0 THEN 1.0 ELSE 0.0 END), 6) AS share_improved, count(*) AS n FROM dl GROUP BY metric"))
def h12_control_compare(spark, sf):
    """Per-row metric differences against a control run joined on the row key, then the
    median and IQR of the differences and the share of rows improved (difference < 0)."""
    a = M.with_metrics(_run(spark, sf, 42), G).select(*KEY, *M.METRICS)
    c = M.with_metrics(_run(spark, sf, 7), G).select(*KEY, *[F.col(m).alias(f"c_{m}") for m in M.METRICS])
    d = a.join(c, KEY).select(*[(F.col(m) - F.col(f"c_{m}")).alias(m) for m in M.METRICS]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        st = Q.describe(d, M.METRICS, (0.25, 0.5, 0.75), moments=False)
        share = d.agg(*[F.avg(F.when(F.col(m) < 0, 1.0).otherwise(0.0)).alias(m) for m in M.METRICS]).first()
    finally:
        d.unpersist()
    rows = [(m, q2, None if q2 is None else q3 - q1, share[m], int(st[m]["n"])) for m in M.METRICS for q1, q2, q3 in [st[m]["quantiles"]]]
    return rounded(spark.createDataFrame(rows, "metric STRING, median_diff DOUBLE, iqr_diff DOUBLE, share_improved DOUBLE, n BIGINT"))


RUN_SEEDS = [("run_a", 42), ("run_b", 7), ("run_c", 1234)]


@query("h13_leaderboard", _sql(
    X.sql_judged() + sum((_run_sql(s, n) for n, s in RUN_SEEDS), [])
    + sum((M.metrics_ctes(n, G, f"m_{n}") for n, _ in RUN_SEEDS), [])
    + [("lab", f"SELECT {KEY_SQL}, answer, rationale_approved FROM judged"),
       ("allm", " UNION ALL ".join(f"SELECT '{n}' AS run, m.*, lab.answer, lab.rationale_approved FROM m_{n} m JOIN lab USING ({KEY_SQL})" for n, _ in RUN_SEEDS)),
       ("gm", f"SELECT * FROM allm WHERE {M.grounded_sql()}"),
       ("gl", " UNION ALL ".join(f"SELECT run, '{m}' AS metric, {m} AS v FROM gm" for m in M.METRICS))],
    "SELECT run, metric, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) AS iqr, "
    "count(*) AS n FROM gl GROUP BY run, metric"))
def h13_leaderboard(spark, sf):
    """Several runs (unionByName with a ``run`` label), grounded rows only, median (IQR)
    per run and metric with exact per-group quantiles (no group gathered into one task)."""
    labels = X.judged(spark, sf).select(*KEY, "answer", "rationale_approved")
    runs = None
    for name, seed in RUN_SEEDS:
        m = M.with_metrics(_run(spark, sf, seed), G).withColumn("run", F.lit(name))
        runs = m if runs is None else runs.unionByName(m)
    g = runs.join(labels, KEY).filter(M.grounded())
    return rounded(RS.quartiles(RS.long_metrics(g, ["run"], M.METRICS), ["run", "metric"], "v").select("run", "metric", "median", "iqr", "n"))


# ---------------------------------------------------------------- A11 / B14 many runs
RUNS = 1000


def _run_configs(spark, sf):
    """A legacy configuration of every run, derived from the order keys that make the runs."""
    no = X.read(spark, sf, "orders").select((F.col("o_orderkey") % RUNS).alias("no")).distinct()
    return no.select(F.concat(F.lit("run-"), "no").alias("run"), F.struct(F.concat(F.lit("model-"), (F.col("no") % 7)).alias("llm_name")).alias("llm_settings"),
                     F.when(F.col("no") % 3 == 0, "cot").otherwise("direct").alias("prompt_strategy"),
                     F.when(F.col("no") % 5 > 0, F.struct((F.col("no") % 2 == 0).alias("disambig"))).alias("inst_addons"),
                     F.concat(F.lit("probe-"), (F.col("no") % 4)).alias("probe"))


@query("a11_convert_runs", _sql(
    _numeric_judged_sql() + M.metrics_ctes("njudged", X.NUM_GOALS, "rm")
    + [("rr", f"SELECT *, l_orderkey % {RUNS} AS no, {M.grounded_sql()} AS ok FROM rm"),
       ("rc", "SELECT no, count(*) AS n_total, count(*) FILTER (WHERE ok) AS n_grounded, count(*) FILTER (WHERE answer = 'No') AS n_flagged, "
              "count(*) FILTER (WHERE NOT coalesce(rationale_approved, TRUE)) AS n_overruled FROM rr GROUP BY no"),
       ("rl", " UNION ALL ".join(f"SELECT no, '{m}' AS metric, {m} AS v FROM rr WHERE ok" for m in M.METRICS)),
       ("rs", "SELECT no, metric, " + ", ".join(f"round({e}, 6) AS {n}" for n, e in {
           "mean": "avg(v)", "median": "quantile_cont(v, 0.5)", "min": "min(v)", "max": "max(v)", "std": "stddev_pop(v)", "q1": "quantile_cont(v, 0.25)",
           "q3": "quantile_cont(v, 0.75)", "iqr": "quantile_cont(v, 0.75) - quantile_cont(v, 0.25)"}.items()) + ", count(v) AS n FROM rl GROUP BY no, metric")],
    "SELECT 'run-' || no AS run, m.metric, " + ", ".join(f"rs.{c}" for c in RS.STATS) + ", coalesce(rs.n, 0) AS n, " + ", ".join(RS.COUNTS)
    + ", 'model-' || (no % 7) AS model_id, CASE WHEN no % 3 = 0 THEN 'cot' ELSE 'direct' END AS prompt_strategy, no % 5 > 0 AND no % 2 = 0 AS negprompt, "
      "'probe-' || (no % 4) AS probe_path, 'judge-1' AS judge, TRUE AS legacy_converted "
      "FROM rc CROSS JOIN (SELECT unnest([" + ", ".join(f"'{m}'" for m in M.METRICS) + "]) AS metric) m LEFT JOIN rs USING (no, metric)"))
def a11_convert_runs(spark, sf):
    """A11 (with B14): a thousand judged runs summarised again in one plan, under their renamed configurations."""
    runs = numeric_judged(spark, sf).withColumn("run", F.concat(F.lit("run-"), F.col("l_orderkey") % RUNS))
    return rounded(RS.convert_runs(runs, _run_configs(spark, sf), X.NUM_GOALS, "judge-1"))


# ---------------------------------------------------------------- H14 - H16
def _h14_sql():
    base = H11_SQL
    head, final = base.rsplit("\nSELECT metric", 1)
    ctes = head + ",\nsumm AS (SELECT metric" + final + ")\n"
    return ctes + ("SELECT metric, printf('%.3f (%.3f)', median, iqr) AS median_iqr, "
                   "printf('%d (%.2f%%)', n_grounded, n_grounded * 100.0 / n_total) AS valid, "
                   "printf('%d (%.2f%%)', n_flagged, n_flagged * 100.0 / n_total) AS flagged, "
                   "printf('%d (%.2f%%)', n_overruled, n_overruled * 100.0 / n_total) AS overruled FROM summ")


@query("h14_report_rows", _h14_sql())
def h14_report_rows(spark, sf):
    """Report strings, ``median (iqr)`` to 3 places and counts with their share to 2 places."""
    s = M.evaluate(spark, X.judged(spark, sf), G, judged=True)
    s = rounded(s)

    def pct(c):
        return F.format_string("%d (%.2f%%)", F.col(c), F.col(c) * F.lit(100.0) / F.col("n_total"))

    return s.select("metric", F.format_string("%.3f (%.3f)", "median", "iqr").alias("median_iqr"),
                    pct("n_grounded").alias("valid"), pct("n_flagged").alias("flagged"), pct("n_overruled").alias("overruled"))


@query("h15_raw_values", _sql(X.sql_judged() + M.metrics_ctes("judged", G, "m"), f"SELECT {KEY_SQL}, {_r(M.METRICS)} FROM m"))
def h15_raw_values(spark, sf):
    """The raw per-row metric values of a run."""
    return rounded(M.with_metrics(X.judged(spark, sf), G).select(*KEY, *M.METRICS))


@query("h16_nearest_rank", _sql(
    X.sql_result() + M.metrics_ctes("result", G, "m")
    + [("l", " UNION ALL ".join(f"SELECT '{m}' AS metric, {m} AS v FROM m" for m in M.METRICS)),
       ("rk", "SELECT metric, v, row_number() OVER (PARTITION BY metric ORDER BY v) - 1 AS r, count(*) OVER (PARTITION BY metric) AS n FROM l")],
    "SELECT metric, round(max(CASE WHEN r = least(CAST(floor(n * 0.25) AS BIGINT), n - 1) THEN v END), 6) AS q1, "
    "round(max(CASE WHEN r = least(CAST(floor(n * 0.5) AS BIGINT), n - 1) THEN v END), 6) AS median, "
    "round(max(CASE WHEN r = least(CAST(floor(n * 0.75) AS BIGINT), n - 1) THEN v END), 6) AS q3, "
    "round(min(v), 6) AS min, round(max(v), 6) AS max, count(*) AS n FROM rk GROUP BY metric"))
def h16_nearest_rank(spark, sf):
    """Nearest-rank summary, the value at ``floor(n q)`` of the sorted values (q = .25/.5/.75),
    read with the distributed order-statistic selector."""
    m = M.with_metrics(X.result(spark, sf), G).select(*M.METRICS).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        stats = m.agg(*[F.count(c).alias(f"n_{c}") for c in M.METRICS] + [F.min(c).alias(f"mn_{c}") for c in M.METRICS]
                      + [F.max(c).alias(f"mx_{c}") for c in M.METRICS]).first()
        st = {c: {"n": stats[f"n_{c}"], "min": stats[f"mn_{c}"], "max": stats[f"mx_{c}"]} for c in M.METRICS}
        ranks = {c: {min(int(st[c]["n"] * q), st[c]["n"] - 1) for q in (0.25, 0.5, 0.75)} for c in M.METRICS}
        found = Q.order_statistics(m.select(*[F.col(c).alias(f"v{i}") for i, c in enumerate(M.METRICS)]), M.METRICS, ranks, st)
    finally:
        m.unpersist()
    rows = []
    for c in M.METRICS:
        n = st[c]["n"]
        vals = [found[(c, min(int(n * q), n - 1))] for q in (0.25, 0.5, 0.75)]
        rows.append((c, *vals, st[c]["min"], st[c]["max"], int(n)))
    return rounded(spark.createDataFrame(rows, "metric STRING, q1 DOUBLE, median DOUBLE, q3 DOUBLE, min DOUBLE, max DOUBLE, n BIGINT"))
