"""Goalspace mapping of text tables.

Scoring is a projection: every scorer is a Column (or an Arrow UDF), so the parallelism is the
partitioning of the input and no batching or worker pool is needed (D9).  The content cache
(D6) scores each distinct text once and reuses earlier scores by content key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonegauge.functions.scorers import REGISTRY
from tonegauge.keys import text_key
from tonegauge.operators import normalise as N
from tonegauge.schema import goals_of


def map_goals(df: DataFrame, goals: list[str], text_col: str = "text", prefix: str = "") -> DataFrame:
    """One raw score column per goal (registry lookup, D7)."""
    return df.withColumns({prefix + g: REGISTRY.get(g)(F.col(text_col)) for g in goals})


def goals_from_columns(df: DataFrame, prefix: str = "source_") -> list[str]:
    """Goals named by ``prefix`` columns that the registry knows; unknown names are skipped."""
    return [g for g in goals_of(df, prefix) if g in REGISTRY]


def map_with_cache(df: DataFrame, cache: DataFrame | None, goals: list[str], text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Content-addressed scoring.

    1. distinct texts by ``sha2`` key (one shuffle of the distinct texts);
    2. the cache is brought to one row per key, column by column; a row is a hit when it holds every
       requested goal (a goal the cache has no column for is missing), the other texts are scored;
    3. the new cache holds every key and every column of the old one and the fresh scores (these win);
    4. scores joined back to every input row by key.
    All joins are null-safe: a null text is a text of its own, with a null key.
    Returns ``(scored rows, new cache)``; persist the new cache by writing it as a new version.
    """
    keyed = df.withColumn("text_key", text_key(F.col(text_col)))
    distinct = keyed.select("text_key", F.col(text_col).alias("_text")).dropDuplicates(["text_key"])
    if cache is None:
        merged = map_goals(distinct, goals, "_text").select("text_key", *goals)
        return _with_scores(keyed, merged, goals), merged
    columns = [c for c in cache.columns if c != "text_key"]
    known = cache.groupBy("text_key").agg(*[F.max(c).alias(c) for c in columns])
    known = known.withColumns({g: F.lit(None).cast("double") for g in goals if g not in columns})
    complete = reduce(Column.__and__, [F.col(g).isNotNull() for g in goals])
    hits = known.filter(complete).select(F.col("text_key").alias("_hit"))
    misses = distinct.join(hits, distinct["text_key"].eqNullSafe(F.col("_hit")), "left_anti")
    fresh = map_goals(misses, goals, "_text").select(F.col("text_key").alias("_new_key"), F.lit(True).alias("_new"), *[F.col(g).alias(f"_new_{g}") for g in goals])
    merged = known.join(fresh, known["text_key"].eqNullSafe(F.col("_new_key")), "full")
    merged = merged.withColumns({"text_key": F.when(F.col("_new"), F.col("_new_key")).otherwise(F.col("text_key"))} | {g: F.coalesce(f"_new_{g}", g) for g in goals})
    merged = merged.drop("_new", "_new_key", *[f"_new_{g}" for g in goals])
    return _with_scores(keyed, merged, goals), merged


def _with_scores(keyed: DataFrame, scores: DataFrame, goals: list[str]) -> DataFrame:
    """The scores of each row's key; equal null keys meet."""
    found = scores.select(F.col("text_key").alias("_key"), *goals)
    return keyed.join(found, keyed["text_key"].eqNullSafe(F.col("_key")), "left").drop("_key")


def score_endpoint(df: DataFrame, goals: list[str], ranges: dict[str, tuple] | None, text_col: str = "text") -> DataFrame:
    """(texts, normalise flag) -> ``output_raw_<g>`` and, with ranges, ``output_<g>``."""
    out = map_goals(df, goals, text_col, prefix="output_raw_")
    if ranges:
        out = N.normalize_fixed(out, {g: ranges[g] for g in goals}, prefix="output_", raw_prefix="output_raw_")
    return out
