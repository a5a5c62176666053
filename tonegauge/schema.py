"""Column roles, goal discovery and table schemas.

A goal vector is stored wide, one double column per goal with a role prefix:
raw ``<g>``, ``source_<g>``, ``delta_<g>``, ``target_<g>``, ``output_raw_<g>``, ``output_<g>``.
Goals are always addressed by name; their order is a parameter.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The default goal list and its order.
DEFAULT_GOALS = ["reading_difficulty", "textual_diversity", "text_length", "formality"]

ROLES = ("source_", "delta_", "target_", "output_raw_", "output_")

# Columns that carry a role prefix but are not goals.
NOT_GOALS = {"source_text_is_a"}


def goals_of(df: DataFrame, prefix: str = "source_") -> list[str]:
    """Goal names present under ``prefix`` (prefix match, never substring)."""
    out = []
    for c in df.columns:
        if c.startswith(prefix) and c not in NOT_GOALS:
            g = c[len(prefix):]
            if prefix == "output_" and g.startswith("raw_"):
                continue
            out.append(g)
    return out


def cols(prefix: str, goals: list[str]) -> list[str]:
    return [f"{prefix}{g}" for g in goals]


def nan_to_null(df: DataFrame) -> DataFrame:
    """Float NaN becomes null (Spark orders NaN above every number, so ``NaN >= c`` is true)."""
    exprs = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            exprs.append(F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType)).alias(f.name))
        else:
            exprs.append(F.col(f.name))
    return df.select(*exprs)


def snake_case(name: str) -> str:
    """``ReadingDifficulty`` -> ``reading_difficulty`` (C20)."""
    return re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name).lower()


def select_roles(df: DataFrame, *prefixes: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Keep key columns plus every column starting with one of ``prefixes``."""
    chosen = [c for c in df.columns if c in keep or any(c.startswith(p) for p in prefixes)]
    return df.select(*chosen)


def drop_roles(df: DataFrame, *prefixes: str, also: tuple[str, ...] = ()) -> DataFrame:
    """Drop role columns (e.g. ``delta_``/``target_``) and stale prompt columns."""
    gone = [c for c in df.columns if c in also or any(c.startswith(p) for p in prefixes)]
    return df.drop(*gone)


def add_prefix(df: DataFrame, prefix: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Rename every column (except ``exclude``) to ``prefix + name``."""
    return df.withColumnsRenamed({c: prefix + c for c in df.columns if c not in exclude})


# Table schemas (FIXTURES.md), used when reading CSV exchanges with explicit types.
SEED = T.StructType([
    T.StructField("row_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("source", T.StringType()),
])

NORMALIZATION = T.StructType([
    T.StructField("goal", T.StringType()),
    T.StructField("min", T.DoubleType()),
    T.StructField("max", T.DoubleType()),
])

VERDICT = T.StructType([
    T.StructField("answer", T.StringType()),
    T.StructField("rationale", T.StringType()),
])

CHAT = T.ArrayType(T.StructType([
    T.StructField("role", T.StringType()),
    T.StructField("content", T.StringType()),
]))


def probe_schema(goals: list[str]) -> T.StructType:
    fields = [
        T.StructField("original_index", T.LongType()),
        T.StructField("rep", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("source", T.StringType()),
    ]
    for g in goals:
        fields.append(T.StructField(g, T.DoubleType()))
    for prefix in ("source_", "delta_", "target_"):
        fields += [T.StructField(prefix + g, T.DoubleType()) for g in goals]
    fields += [T.StructField("sampling_weights", T.DoubleType()), T.StructField("sampling_weights_mean", T.DoubleType())]
    return T.StructType(fields)
