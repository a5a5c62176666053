"""Best-of-N and top-k (K1-K4)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonegauge.keys import text_key
from tonegauge.operators import metrics as M


def _prepare(df: DataFrame, goals: list[str], compat: bool) -> DataFrame:
    if compat:
        # original behaviour: every null in the frame becomes -1 before grouping and scoring
        fills = {c: -1.0 for c in df.columns if c.startswith(("target_", "delta_", "output_", "source_"))}
        df = df.fillna(fills)
    return M.with_metrics(df, goals).withColumnRenamed("steering_error", "_err")


def _narrow(scored: DataFrame, goals: list[str], key: list[str]) -> DataFrame:
    """What the choice needs of a row: its group (text key and targets), its error and its key."""
    return scored.select(text_key(F.col("text")).alias("_tk"), *[F.col(f"target_{g}").alias(f"_t_{g}") for g in goals], "_err", *key)


def _rows_of(scored: DataFrame, chosen: DataFrame, key: list[str]) -> DataFrame:
    """The rows of ``scored`` whose key was chosen (null-safe; texts meet keys only)."""
    keys = chosen.select(*[F.col(k).alias(f"_k_{k}") for k in key])
    same = reduce(Column.__and__, [scored[k].eqNullSafe(F.col(f"_k_{k}")) for k in key])
    return scored.join(keys, same, "left_semi").withColumnRenamed("_err", "steering_error")


def oracle_pick(df: DataFrame, goals: list[str], order_key: list[str], mode: str = "best", compat: bool = False) -> DataFrame:
    """K1: per (text, targets) group the row with the lowest (``best``) or highest (``worst``)
    steering error, first in ``order_key`` on ties; ``order_key`` names a row.

    Grouping uses ``sha2(text)`` plus the target columns (null targets group together, unlike
    the notebook copy).  Only errors and keys are aggregated; the chosen keys then pick their rows, so texts
    and scores are shuffled at most once, and not at all when the caller does not ask for them.
    ``compat`` fills every null with -1 first.
    """
    scored = _prepare(df, goals, compat)
    err = F.col("_err") if mode == "best" else -F.col("_err")
    best = _narrow(scored, goals, order_key).groupBy("_tk", *[f"_t_{g}" for g in goals]).agg(F.min(F.struct(err.alias("e"), *order_key)).alias("_r"))
    return _rows_of(scored, best.select("_r.*"), order_key)


def oracle_median(df: DataFrame, goals: list[str], order_key: list[str], compat: bool = False) -> DataFrame:
    """K2: the row nearest its group's median steering error (first in ``order_key`` on ties).

    The rows nearest the median are exactly those holding one of the two middle order statistics
    (one for an odd count; for an even count both are equally near), so no floating median is
    formed: rows whose error equals either middle value compete and the first by key wins.
    The middle values come from positions within a group (``row_number``), so no group is held in
    an array; the windows share one partitioning and spill.  (The original's median mode crashed;
    this is the fixed intent.)"""
    scored = _prepare(df, goals, compat)
    rows = _narrow(scored, goals, order_key)
    group = Window.partitionBy("_tk", *[f"_t_{g}" for g in goals])
    err = F.col("_err")
    placed = rows.withColumns({"_pos": F.row_number().over(group.orderBy(err.asc_nulls_last(), *order_key)),
                               "_n": F.count(err).over(group)})
    middle = [F.max(F.when(F.col("_pos") == F.floor((F.col("_n") + up) / 2), err)).over(group) for up in (1, 2)]
    near = placed.withColumns({"_lo": middle[0], "_hi": middle[1]}).filter((err == F.col("_lo")) | (err == F.col("_hi")))
    first = near.withColumn("_rn", F.row_number().over(group.orderBy(*order_key))).filter("_rn = 1")
    return _rows_of(scored, first, order_key)


def undo_sentinel(df: DataFrame, goals: list[str]) -> DataFrame:
    """K3: after a compat best-of-N, target -1 -> source and delta -1 -> 0."""
    cols = {}
    for g in goals:
        cols[f"target_{g}"] = F.when(F.col(f"target_{g}") == -1.0, F.col(f"source_{g}")).otherwise(F.col(f"target_{g}"))
        cols[f"delta_{g}"] = F.when(F.col(f"delta_{g}") == -1.0, F.lit(0.0)).otherwise(F.col(f"delta_{g}"))
    return df.withColumns(cols)


def top_k(df: DataFrame, metric: str, k: int, tie_key: list[str]) -> DataFrame:
    """K4: the k best rows by ``metric`` (k < 0: the |k| worst); TakeOrderedAndProject."""
    if k >= 0:
        return df.orderBy(F.col(metric).asc_nulls_last(), *tie_key).limit(k)
    return df.orderBy(F.col(metric).desc_nulls_last(), *tie_key).limit(-k)
