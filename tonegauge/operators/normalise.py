"""Normalisation and weight post-processing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonegauge.operators import quantiles as Q


def clip01(x: Column) -> Column:
    """``clip(x, 0, 1)`` that keeps null as null (greatest/least would turn null into a bound)."""
    return F.when(x.isNull(), F.lit(None).cast("double")).otherwise(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def clip01_sql(e: str) -> str:
    return f"(CASE WHEN ({e}) IS NULL THEN NULL ELSE least(greatest({e}, 0.0::DOUBLE), 1.0::DOUBLE) END)"


def percentile_bounds(df: DataFrame, goals: list[str], range_pct: float = 95) -> dict[str, tuple]:
    """E1 step 1: lower/upper percentiles framing the middle ``range_pct`` % of each goal.

    One exact, distributed order-statistic job set for all goals (no single-task percentile).
    """
    if range_pct <= 0 or range_pct >= 100:
        raise ValueError("Range must be in (0, 100).")
    lo_q = (100 - range_pct) / 2 / 100
    hi_q = 1 - lo_q
    qs = Q.quantiles(df, goals, (lo_q, hi_q))
    return {g: (qs[g][0], qs[g][1]) for g in goals}


def apply_bounds(df: DataFrame, bounds: dict[str, tuple], prefix: str = "source_", raw_prefix: str = "") -> DataFrame:
    """``prefix + g = clip((raw - lo) / (hi - lo), 0, 1)``; a constant goal (hi = lo) gives null."""
    cols = {}
    for g, (lo, hi) in bounds.items():
        raw = F.col(raw_prefix + g)
        if lo is None or hi is None:
            cols[prefix + g] = F.lit(None).cast("double")
            continue
        cols[prefix + g] = clip01(F.try_divide(raw - F.lit(float(lo)), F.lit(float(hi) - float(lo))))
    return df.withColumns(cols)


def normalize_percentile(df: DataFrame, goals: list[str], range_pct: float = 95) -> DataFrame:
    """Middle ``range_pct`` % of each raw goal scaled to [0, 1] and clipped -> ``source_<g>``."""
    return apply_bounds(df, percentile_bounds(df, goals, range_pct))


def normalize_percentile_sql(table: str, goals: list[str], range_pct: float = 95, alias: str = "b") -> tuple[str, str]:
    """SQL twin: returns (bounds CTE body, select list of source columns referencing ``alias``)."""
    lo_q = (100 - range_pct) / 2 / 100
    hi_q = 1 - lo_q
    aggs = ", ".join(f"quantile_cont({g}, {lo_q!r}) AS lo_{g}, quantile_cont({g}, {hi_q!r}) AS hi_{g}" for g in goals)
    cte = f"SELECT {aggs} FROM {table}"
    sel = ", ".join(f"{clip01_sql(f'({g} - {alias}.lo_{g}) / ({alias}.hi_{g} - {alias}.lo_{g})')} AS source_{g}" for g in goals)
    return cte, sel


def normalize_fixed(df: DataFrame, ranges: dict[str, tuple], prefix: str = "source_", raw_prefix: str = "") -> DataFrame:
    """Fixed ``(min, max)`` per goal (A6 table or literals), clipped."""
    return apply_bounds(df, ranges, prefix, raw_prefix)


def ranges_from_table(norm: DataFrame) -> dict[str, tuple]:
    """A ``(goal, min, max)`` table is a handful of rows; read it once on the driver."""
    return {r["goal"]: (r["min"], r["max"]) for r in norm.select("goal", "min", "max").collect()}


def recover_ranges(probe: DataFrame, goals: list[str]) -> DataFrame:
    """E3 step 1: the linear map raw -> normalised, from the (raw, normalised) pairs strictly
    inside (0, 1) with the smallest and the largest normalised value.

    One aggregate row: ``slope_g``, ``intercept_g``, ``xmin_g``, ``xmax_g`` (recovered range).
    """
    aggs = []
    for g in goals:
        s = F.col(f"source_{g}")
        inside = (s > 0) & (s < 1)
        aggs += [
            F.min_by(F.when(inside, F.col(g)), F.when(inside, s)).alias(f"x1_{g}"),
            F.min(F.when(inside, s)).alias(f"y1_{g}"),
            F.max_by(F.when(inside, F.col(g)), F.when(inside, s)).alias(f"x2_{g}"),
            F.max(F.when(inside, s)).alias(f"y2_{g}"),
        ]
    row = probe.agg(*aggs)
    cols = []
    for g in goals:
        slope = F.try_divide(F.col(f"y2_{g}") - F.col(f"y1_{g}"), F.col(f"x2_{g}") - F.col(f"x1_{g}"))
        cols.append(slope.alias(f"slope_{g}"))
    row = row.select("*", *cols)
    out = []
    for g in goals:
        icpt = F.col(f"y1_{g}") - F.col(f"slope_{g}") * F.col(f"x1_{g}")
        out += [F.col(f"slope_{g}"), icpt.alias(f"intercept_{g}")]
    row = row.select(*out)
    rng = []
    for g in goals:
        rng += [F.try_divide(-F.col(f"intercept_{g}"), F.col(f"slope_{g}")).alias(f"xmin_{g}"),
                F.try_divide(F.lit(1.0) - F.col(f"intercept_{g}"), F.col(f"slope_{g}")).alias(f"xmax_{g}")]
    return row.select("*", *rng)


def renormalize(raw_out: DataFrame, maps: DataFrame, goals: list[str]) -> DataFrame:
    """E3 step 2: ``output_g = clip(output_raw_g * slope + intercept, 0, 1)``; ``maps`` is one row
    (broadcast, bounded by construction)."""
    joined = raw_out.crossJoin(F.broadcast(maps.select(*[c for g in goals for c in (f"slope_{g}", f"intercept_{g}")])))
    cols = {f"output_{g}": clip01(F.col(f"output_raw_{g}") * F.col(f"slope_{g}") + F.col(f"intercept_{g}")) for g in goals}
    return joined.withColumns(cols).drop(*[c for g in goals for c in (f"slope_{g}", f"intercept_{g}")])


def mean_weights(df: DataFrame, weight: str = "sampling_weights", out: str = "sampling_weights_mean") -> DataFrame:
    """Mean-1 weights ``w * N`` (N from one count job; the total is a scalar)."""
    n = df.count()
    return df.withColumn(out, F.col(weight) * F.lit(float(n)))


def clip_weights(df: DataFrame, lo: float, hi: float, col: str = "sampling_weights_mean") -> tuple[DataFrame, tuple]:
    """Clip weights to [lo, hi]; also return the range before clipping (one ``agg``)."""
    r = df.agg(F.min(col).alias("mn"), F.max(col).alias("mx")).first()
    return df.withColumn(col, F.least(F.greatest(F.col(col), F.lit(lo)), F.lit(hi))), (r["mn"], r["mx"])


def normalization_table(spark: SparkSession, ranges: dict[str, tuple]) -> DataFrame:
    """A6 as a DataFrame ``(goal, min, max)``."""
    return spark.createDataFrame([(g, float(a), float(b)) for g, (a, b) in ranges.items()], "goal STRING, min DOUBLE, max DOUBLE")
