"""Metrics of rewrite evaluation (H1-H16) as unrolled Column arithmetic.

Per row and goal: source ``s``, target ``t`` (null -> ``s``), output ``o``, delta ``d``.

* Bin of value v at source s: ``#{c in C : v >= clip(s + c, 0, 1)} - 1`` with
  C = (-1, -.5, -.2, -.1, .1, .2, .5, 1), computed as ``s + c`` in double.  A null output
  compares false everywhere and lands in bin -1; a value of exactly 1.0 also passes the top cut
  (always clipped to 1), so it lands in bin 7.
* Divisor ``len(C) - 1 = 7``; centre bin ``(len(C) - 2) / 2 = 3``.
* Requested bin: ``#{c : coalesce(d, 0) >= c} - 1 - 3`` with the *unclipped* C.
* Binned mode: to_goal = (bin(o) - bin(t)) / 7; moved = (bin(o) - 3) / 7; requested as above / 7.
  Raw mode: to_goal = t - o (per goal; the L2 is of o - t), moved = o - s, requested = t - s.
* steering error = ||to_goal||; miscalibration = |a.b / (||b|| + 1e-8)| / (||b|| + 1e-8) with
  a = to_goal, b = requested; orthogonality = clip(||a - (a.b / (b.b + 1e-8)) b|| /
  (||moved|| + 1e-4 (||requested|| + 1e-8)), 0, 1).

Each bin is bound to one named column and every later step only references columns, so the
plan keeps one Project per stage inside whole-stage codegen; no array higher-order functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonegauge.operators import quantiles as Q
from tonegauge.schema import DEFAULT_GOALS

# The direct-prompt cut points.
CUT_POINTS = [-1.0, -0.5, -0.2, -0.1, 0.1, 0.2, 0.5, 1.0]
METRICS = ["steering_error", "miscalibration", "orthogonality"]


def divisor(cuts=CUT_POINTS) -> float:
    return float(len(cuts) - 1)


def centre(cuts=CUT_POINTS) -> float:
    return (len(cuts) - 2) / 2


# --------------------------------------------------------------------------------------------
# H1 / H2 bins

def dynamic_cut(source: Column, c: float) -> Column:
    """H1: ``clip(source + c, 0, 1)``."""
    return F.least(F.greatest(source + F.lit(c), F.lit(0.0)), F.lit(1.0))


def bin_at(value: Column, source: Column, cuts=CUT_POINTS) -> Column:
    """Bin index of ``value`` among the dynamic cuts around ``source`` (null value -> -1)."""
    total = None
    for c in cuts:
        term = F.when(value >= dynamic_cut(source, c), 1).otherwise(0)
        total = term if total is None else total + term
    return total - 1


def bin_delta(delta: Column, cuts=CUT_POINTS) -> Column:
    """H2: fixed bins of a delta over the interior cuts, right-open (``np.digitize``)."""
    total = None
    for c in cuts[1:-1]:
        term = F.when(delta >= F.lit(c), 1).otherwise(0)
        total = term if total is None else total + term
    return total


def requested_bin(delta: Column, cuts=CUT_POINTS) -> Column:
    total = None
    for c in cuts:
        term = F.when(F.coalesce(delta, F.lit(0.0)) >= F.lit(c), 1).otherwise(0)
        total = term if total is None else total + term
    return total - 1 - F.lit(centre(cuts))


def with_bins(df: DataFrame, goals=DEFAULT_GOALS, cuts=CUT_POINTS) -> DataFrame:
    """Bind ``_bo_g`` (output bin), ``_bt_g`` (target bin) and ``_br_g`` (requested bin) once."""
    cols = {}
    for g in goals:
        s = F.col(f"source_{g}")
        t = F.coalesce(F.col(f"target_{g}"), s)
        cols[f"_bo_{g}"] = bin_at(F.col(f"output_{g}"), s, cuts)
        cols[f"_bt_{g}"] = bin_at(t, s, cuts)
        cols[f"_br_{g}"] = requested_bin(F.col(f"delta_{g}"), cuts)
    return df.withColumns(cols)


# --------------------------------------------------------------------------------------------
# H3 / H4 / H5 per-goal vectors

def with_vectors(df: DataFrame, goals=DEFAULT_GOALS, cuts=CUT_POINTS, binned: bool = True) -> DataFrame:
    """Per-goal ``to_goal_g``, ``moved_g``, ``requested_g`` (binned: after :func:`with_bins`)."""
    cols = {}
    k = F.lit(divisor(cuts))
    for g in goals:
        s = F.col(f"source_{g}")
        t = F.coalesce(F.col(f"target_{g}"), s)
        o = F.col(f"output_{g}")
        if binned:
            cols[f"to_goal_{g}"] = (F.col(f"_bo_{g}") - F.col(f"_bt_{g}")) / k
            cols[f"moved_{g}"] = (F.col(f"_bo_{g}") - F.lit(centre(cuts))) / k
            cols[f"requested_{g}"] = F.col(f"_br_{g}") / k
        else:
            cols[f"to_goal_{g}"] = t - o
            cols[f"moved_{g}"] = o - s
            cols[f"requested_{g}"] = t - s
    return df.withColumns(cols)


def _norm(prefix: str, goals) -> Column:
    return F.sqrt(sum((F.col(f"{prefix}{g}") * F.col(f"{prefix}{g}") for g in goals[1:]),
                      F.col(f"{prefix}{goals[0]}") * F.col(f"{prefix}{goals[0]}")))


def _dot(a: str, b: str, goals) -> Column:
    return sum((F.col(f"{a}{g}") * F.col(f"{b}{g}") for g in goals[1:]), F.col(f"{a}{goals[0]}") * F.col(f"{b}{goals[0]}"))


def scalar_projection(a: str, b: str, goals) -> Column:
    """H6: a.b / (||b|| + 1e-8) for per-goal column prefixes a, b."""
    return _dot(a, b, goals) / (_norm(b, goals) + F.lit(1e-8))


def scalar_rejection(a: str, b: str, goals) -> Column:
    """H7: ||a - (a.b / (b.b + 1e-8)) b||."""
    coef = _dot(a, b, goals) / (_dot(b, b, goals) + F.lit(1e-8))
    sq = None
    for g in goals:
        r = F.col(f"{a}{g}") - coef * F.col(f"{b}{g}")
        sq = r * r if sq is None else sq + r * r
    return F.sqrt(sq)


def with_metrics(df: DataFrame, goals=DEFAULT_GOALS, cuts=CUT_POINTS, binned: bool = True,
                 normalize: bool = True, keep_parts: bool = False) -> DataFrame:
    """H3/H8/H9: add ``steering_error``, ``miscalibration``, ``orthogonality`` per row."""
    if binned:
        df = with_bins(df, goals, cuts)
    df = with_vectors(df, goals, cuts, binned)
    # scalar parts bound once
    df = df.withColumns({
        "_n_req": _norm("requested_", goals),
        "_n_mov": _norm("moved_", goals),
        "_dot_ab": _dot("to_goal_", "requested_", goals),
        "_dot_bb": _dot("requested_", "requested_", goals),
        "steering_error": _norm("to_goal_", goals),
    })
    coef = F.col("_dot_ab") / (F.col("_dot_bb") + F.lit(1e-8))
    sq = None
    for g in goals:
        r = F.col(f"to_goal_{g}") - coef * F.col(f"requested_{g}")
        sq = r * r if sq is None else sq + r * r
    rej = F.sqrt(sq)
    proj = F.abs(F.col("_dot_ab") / (F.col("_n_req") + F.lit(1e-8)))
    if normalize:
        miscal = proj / (F.col("_n_req") + F.lit(1e-8))
        denom = F.col("_n_mov") + F.lit(1e-4) * (F.col("_n_req") + F.lit(1e-8))
        ortho = F.least(F.greatest(rej / denom, F.lit(0.0)), F.lit(1.0))
    else:
        miscal = proj
        ortho = rej
    df = df.withColumns({"miscalibration": miscal, "orthogonality": ortho})
    if not keep_parts:
        drop = ["_n_req", "_n_mov", "_dot_ab", "_dot_bb"]
        if binned:
            drop += [f"_b{x}_{g}" for g in goals for x in ("o", "t", "r")]
        df = df.drop(*drop)
    return df


def raw_distance(df: DataFrame, goals=DEFAULT_GOALS, kind: str = "to_goal") -> Column:
    """Raw-mode L2 of one vector kind (``to_goal`` is ||o - t||)."""
    return _norm(f"{kind}_", goals)


# --------------------------------------------------------------------------------------------
# B7 / B8 judge filter helpers used by H11

def fill_targets(df: DataFrame, goals=None) -> DataFrame:
    """``target_g <- coalesce(target_g, source_g)`` for every target column."""
    from tonegauge.schema import goals_of
    goals = goals or goals_of(df, "target_")
    return df.withColumns({f"target_{g}": F.coalesce(F.col(f"target_{g}"), F.col(f"source_{g}")) for g in goals})


def grounded(approved: Column | None = None, answer: Column | None = None) -> Column:
    """(approved and Yes) or (not approved and No); null answers count as neither and a
    missing approval counts as approved (the review default)."""
    approved = F.col("rationale_approved") if approved is None else approved
    answer = F.col("answer") if answer is None else answer
    yes = answer.eqNullSafe(F.lit("Yes"))
    no = answer.eqNullSafe(F.lit("No"))
    appr = F.coalesce(approved, F.lit(True))
    return (appr & yes) | (~appr & no)


# --------------------------------------------------------------------------------------------
# H10 / H11 summaries

SUMMARY_FIELDS = ["mean", "median", "min", "max", "std", "q1", "q3", "iqr", "n"]


def summary_rows(df: DataFrame, columns: list[str]) -> list[dict]:
    """Mean, median, min, max, population std, q1, q3, iqr per column (exact quantiles)."""
    st = Q.describe(df, columns, probs=(0.25, 0.5, 0.75))
    rows = []
    for c in columns:
        q1, med, q3 = st[c]["quantiles"]
        rows.append({
            "metric": c, "mean": st[c].get("mean"), "median": med, "min": st[c]["min"], "max": st[c]["max"],
            "std": st[c].get("std"), "q1": q1, "q3": q3, "iqr": (q3 - q1) if q1 is not None else None,
            "n": int(st[c]["n"]),
        })
    return rows


SUMMARY_SCHEMA = ("metric STRING, mean DOUBLE, median DOUBLE, min DOUBLE, max DOUBLE, std DOUBLE, "
                  "q1 DOUBLE, q3 DOUBLE, iqr DOUBLE, n BIGINT")


def summarize(spark: SparkSession, df: DataFrame, columns: list[str]) -> DataFrame:
    rows = summary_rows(df, columns)
    return spark.createDataFrame([tuple(r[k] for k in ["metric"] + SUMMARY_FIELDS) for r in rows], SUMMARY_SCHEMA)


def evaluate(spark: SparkSession, df: DataFrame, goals=DEFAULT_GOALS, judged: bool = True,
             cuts=CUT_POINTS) -> DataFrame:
    """Optional grounded filter (B8), the three metrics, their summaries and the counts.

    One row per metric: the H10 fields plus ``n_total, n_grounded, n_flagged, n_overruled``
    (the last three null when ``judged`` is false).  Counts come from one conditional ``agg``.
    """
    from pyspark import StorageLevel

    if judged:
        flagged = df.withColumn("_g", grounded())
        counts = flagged.agg(
            F.count(F.lit(1)).alias("n_total"),
            F.count_if(F.col("_g")).alias("n_grounded"),
            F.count_if(F.col("answer").eqNullSafe(F.lit("No"))).alias("n_flagged"),
            F.count_if(~F.coalesce(F.col("rationale_approved"), F.lit(True))).alias("n_overruled"),
        ).first()
        rows = flagged.filter(F.col("_g")).drop("_g")
    else:
        counts = {"n_total": df.count(), "n_grounded": None, "n_flagged": None, "n_overruled": None}
        rows = df
    scored = with_metrics(rows, goals, cuts).select(*METRICS).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        summ = summary_rows(scored, METRICS)
    finally:
        scored.unpersist()
    out = []
    for r in summ:
        out.append(tuple(r[k] for k in ["metric"] + SUMMARY_FIELDS) +
                   (int(counts["n_total"]),) +
                   tuple(None if counts[k] is None else int(counts[k]) for k in ("n_grounded", "n_flagged", "n_overruled")))
    schema = SUMMARY_SCHEMA + ", n_total BIGINT, n_grounded BIGINT, n_flagged BIGINT, n_overruled BIGINT"
    return spark.createDataFrame(out, schema)


def summary_document(summary: DataFrame, run: dict | None = None) -> DataFrame:
    """A5 shape: one row ``{metrics: {metric: {...}}, data: {...}, run: {...}}``."""
    metric_struct = F.struct(*[F.col(k) for k in ["mean", "median", "min", "max", "std", "q1", "q3", "iqr"]])
    doc = summary.agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("metric"), metric_struct))).alias("metrics"),
        F.struct(F.first("n_total").alias("n_total"), F.first("n_grounded").alias("n_grounded"),
                 F.first("n_flagged").alias("n_flagged"), F.first("n_overruled").alias("n_overruled")).alias("data"),
    )
    if run:
        doc = doc.withColumn("run", F.struct(*[F.lit(v).alias(k) for k, v in run.items()]))
    return doc


# --------------------------------------------------------------------------------------------
# DuckDB twins (used by the oracle)

def _bin_sql(v: str, s: str, cuts=CUT_POINTS) -> str:
    terms = [f"(CASE WHEN {v} >= least(greatest({s} + {c!r}::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE) THEN 1 ELSE 0 END)" for c in cuts]
    return "(" + " + ".join(terms) + " - 1)"


def bin_delta_sql(d: str, cuts=CUT_POINTS) -> str:
    return "(" + " + ".join(f"(CASE WHEN {d} >= {c!r}::DOUBLE THEN 1 ELSE 0 END)" for c in cuts[1:-1]) + ")"


def _req_sql(d: str, cuts=CUT_POINTS) -> str:
    terms = [f"(CASE WHEN coalesce({d}, 0.0::DOUBLE) >= {c!r}::DOUBLE THEN 1 ELSE 0 END)" for c in cuts]
    return "(" + " + ".join(terms) + f" - 1 - {centre(cuts)!r}::DOUBLE)"


def _norm_sql(prefix: str, goals) -> str:
    return "sqrt(" + " + ".join(f"{prefix}{g} * {prefix}{g}" for g in goals) + ")"


def _dot_sql(a: str, b: str, goals) -> str:
    return "(" + " + ".join(f"{a}{g} * {b}{g}" for g in goals) + ")"


def metrics_ctes(src: str, goals=DEFAULT_GOALS, name: str = "met", cuts=CUT_POINTS, binned: bool = True,
                 normalize: bool = True, keep_parts: bool = False) -> list[tuple[str, str]]:
    """CTE chain adding the same columns as :func:`with_metrics` to ``src``."""
    k = f"{divisor(cuts)!r}::DOUBLE"
    ctes = []
    if binned:
        b = []
        for g in goals:
            s, t = f"source_{g}", f"coalesce(target_{g}, source_{g})"
            b += [f"{_bin_sql(f'output_{g}', s, cuts)} AS _bo_{g}", f"{_bin_sql(t, s, cuts)} AS _bt_{g}",
                  f"{_req_sql(f'delta_{g}', cuts)} AS _br_{g}"]
        ctes.append((f"{name}_b", f"SELECT *, {', '.join(b)} FROM {src}"))
        src = f"{name}_b"
    v = []
    for g in goals:
        if binned:
            v += [f"(_bo_{g} - _bt_{g}) / {k} AS to_goal_{g}", f"(_bo_{g} - {centre(cuts)!r}::DOUBLE) / {k} AS moved_{g}",
                  f"_br_{g} / {k} AS requested_{g}"]
        else:
            t = f"coalesce(target_{g}, source_{g})"
            v += [f"{t} - output_{g} AS to_goal_{g}", f"output_{g} - source_{g} AS moved_{g}", f"{t} - source_{g} AS requested_{g}"]
    ctes.append((f"{name}_v", f"SELECT *, {', '.join(v)} FROM {src}"))
    ctes.append((f"{name}_s", f"SELECT *, {_norm_sql('requested_', goals)} AS _n_req, {_norm_sql('moved_', goals)} AS _n_mov, "
                              f"{_dot_sql('to_goal_', 'requested_', goals)} AS _dot_ab, {_dot_sql('requested_', 'requested_', goals)} AS _dot_bb, "
                              f"{_norm_sql('to_goal_', goals)} AS steering_error FROM {name}_v"))
    coef = "(_dot_ab / (_dot_bb + 1e-8::DOUBLE))"
    rej = "sqrt(" + " + ".join(f"(to_goal_{g} - {coef} * requested_{g}) * (to_goal_{g} - {coef} * requested_{g})" for g in goals) + ")"
    proj = "abs(_dot_ab / (_n_req + 1e-8::DOUBLE))"
    if normalize:
        miscal = f"{proj} / (_n_req + 1e-8::DOUBLE)"
        ortho = f"least(greatest({rej} / (_n_mov + 1e-4::DOUBLE * (_n_req + 1e-8::DOUBLE)), 0.0::DOUBLE), 1.0::DOUBLE)"
    else:
        miscal, ortho = proj, rej
    drop = ["_n_req", "_n_mov", "_dot_ab", "_dot_bb"]
    if binned:
        drop += [f"_b{x}_{g}" for g in goals for x in ("o", "t", "r")]
    excl = "" if keep_parts else f" EXCLUDE ({', '.join(drop)})"
    ctes.append((name, f"SELECT *{excl}, {miscal} AS miscalibration, {ortho} AS orthogonality FROM {name}_s"))
    return ctes


def grounded_sql(approved: str = "rationale_approved", answer: str = "answer") -> str:
    a = f"coalesce({approved}, TRUE)"
    return f"(({a} AND {answer} IS NOT DISTINCT FROM 'Yes') OR (NOT {a} AND {answer} IS NOT DISTINCT FROM 'No'))"


def summary_sql(src: str, columns: list[str], extra_select: str = "", extra_from: str = "") -> str:
    """Long-format H10 summary of ``columns`` of ``src`` rounded to 6 places."""
    longs = " UNION ALL ".join(f"SELECT '{c}' AS metric, CAST({c} AS DOUBLE) AS v FROM {src}" for c in columns)
    return (f"SELECT metric, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median, round(min(v), 6) AS min, "
            f"round(max(v), 6) AS max, round(stddev_pop(v), 6) AS std, round(quantile_cont(v, 0.25), 6) AS q1, "
            f"round(quantile_cont(v, 0.75), 6) AS q3, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) AS iqr, "
            f"count(v) AS n{extra_select} FROM ({longs}) l{extra_from} GROUP BY ALL")
