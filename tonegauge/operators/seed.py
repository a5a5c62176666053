"""Seed corpus preparation and simple row filters (B1-B3, B10, B11, C1-C3 composition)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonegauge.functions import text as tx
from tonegauge.operators import quantiles as Q


def filter_counts(df: DataFrame, filters: dict) -> DataFrame:
    """B1: row counts before and after each conjunctive equality filter, in one aggregate."""
    aggs = [F.count(F.lit(1)).alias("n_in")]
    cond = None
    for col, value in filters.items():
        c = F.col(col) == F.lit(value)
        cond = c if cond is None else cond & c
        aggs.append(F.count_if(cond).alias(f"n_after_{col}"))
    return df.agg(*aggs)


def apply_filters(df: DataFrame, filters: dict | None) -> DataFrame:
    """B1: keep rows matching every ``column == value`` (a list value means membership)."""
    if not filters:
        return df
    conds = [F.col(c).isin(v) if isinstance(v, (list, tuple)) else F.col(c) == F.lit(v) for c, v in filters.items()]
    return df.filter(reduce(lambda a, b: a & b, conds))


def word_limits(df: DataFrame, lo: int | None = None, hi: int | None = None, text_col: str = "text") -> DataFrame:
    """B2: keep texts whose C4 token count is within [lo, hi] (both inclusive; None = open,
    the default, so no document goes without an explicit bound)."""
    n = tx.token_count(F.col(text_col))
    cond = F.lit(True)
    if lo is not None:
        cond = cond & (n >= lo)
    if hi is not None:
        cond = cond & (n <= hi)
    return df.filter(cond)


def first_n(df: DataFrame, n: int, order_col: str) -> DataFrame:
    """The first n rows in row-id order (TakeOrdered)."""
    return df.orderBy(order_col).limit(n)


def chunk(df: DataFrame, n: int, text_col: str = "text") -> DataFrame:
    """C1 as a table operator: one row per n-sentence paragraph, other columns kept."""
    others = [c for c in df.columns if c != text_col]
    return df.select(*others, F.posexplode(tx.chunk_sentences(F.col(text_col), n)).alias("chunk_index", text_col))


def sign_split(df: DataFrame, g1: str, g2: str) -> DataFrame:
    """``relation`` = correlated (delta product > 0) or anti (< 0); zero / null in neither."""
    p = F.col(f"delta_{g1}") * F.col(f"delta_{g2}")
    return df.filter(p != 0).withColumn("relation", F.when(p > 0, "correlated").when(p < 0, "anti"))


def outlier_mask(df: DataFrame, col: str, lo_q: float = 0.025, hi_q: float = 0.975) -> DataFrame:
    """``outlier`` when the value lies outside the [2.5, 97.5] percentile band."""
    lo, hi = Q.quantiles(df, [col], (lo_q, hi_q))[col]
    return df.withColumn("outlier", (F.col(col) > F.lit(hi)) | (F.col(col) < F.lit(lo)))


def process_dataset(df: DataFrame, feature_col: str, filters: dict | None = None, paragraph_chunksize: int | None = None,
                    min_words_per_doc: int | None = None, max_words_per_doc: int | None = None, newlines_are_sentences: bool = False,
                    sample: int | None = None, select_first: int | None = None, random_state: int = 42,
                    dedup: bool = False, key_col: str | None = None) -> DataFrame:
    """Seed processing: filter (B1), optional sample (F1), chunk (C1), newline rule (C3), word
    limits (B2), first-N (B3).  ``dedup`` adds exact text de-duplication (off by default).

    Word limits are open unless given.  First-N takes rows in ``key_col`` and chunk order (in text
    order without a key, or after ``dedup``), so reruns agree."""
    from tonegauge.operators.probe import sample_uniform
    out = apply_filters(df, filters).withColumnRenamed(feature_col, "text")
    if sample is not None:
        out = sample_uniform(out, sample, [key_col or "text"], seed=random_state)
    _key = F.col(key_col) if key_col else F.lit(0)
    if paragraph_chunksize is not None:
        out = out.select(_key.alias("_key"), F.posexplode(tx.chunk_sentences(F.col("text"), paragraph_chunksize)).alias("_chunk", "text"))
    else:
        out = out.select(_key.alias("_key"), F.lit(0).alias("_chunk"), "text")
    if newlines_are_sentences:
        out = out.withColumn("text", tx.newlines_as_sentences(F.col("text")))
    if min_words_per_doc is not None or max_words_per_doc is not None:
        out = word_limits(out, min_words_per_doc, max_words_per_doc)
    if dedup:
        out = out.select(F.lit(0).alias("_key"), F.lit(0).alias("_chunk"), "text").dropDuplicates(["text"])
    if select_first is not None:
        out = out.orderBy("_key", "_chunk", "text").limit(select_first)
    return out.select("text")
