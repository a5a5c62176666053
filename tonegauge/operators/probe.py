"""Sampling and probe construction.

All randomness is ``u(key..., seed, purpose)`` from :mod:`tonegauge.keys`, so a probe is a pure
function of its input and seed: reruns, task retries and other engines draw the same values.
NumPy's random stream is not reproduced; agreement with the original is distributional.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonegauge.keys import md5_hex, u, u4, u4_sql, u_from_hex, u_sql
from tonegauge.operators.normalise import clip01, clip01_sql

DELTA_MIN = -0.7
DELTA_MAX = 0.7
DEADZONE = 0.1


def _keys(key_cols: list[str]) -> list[str]:
    return [f"col:{k}" for k in key_cols]


# --------------------------------------------------------------------------------------------
# F1 / F2 samples

def sample_uniform(df: DataFrame, n: int, key_cols: list[str], seed: int = 42, backend: str = "md5") -> DataFrame:
    """exactly ``min(n, rows)`` rows without replacement: the n smallest ``u(key, seed)``.

    ``orderBy(...).limit(n)`` plans as TakeOrderedAndProject: each task keeps its top n, the
    driver merges ``tasks x n`` rows, never the table.
    """
    key = u(*_keys(key_cols), seed, "sample", backend=backend)
    return df.withColumn("_u", key).orderBy("_u", *key_cols).limit(n).drop("_u")


def sample_weighted(df: DataFrame, n: int, key_cols: list[str], weight: str = "sampling_weights",
                    seed: int = 42, backend: str = "md5") -> DataFrame:
    """weighted sample without replacement (Efraimidis-Spirakis exponential keys).

    Key ``-ln(1 - u) / w``, the n smallest win; zero / null weights never win.
    """
    key = -F.log(F.lit(1.0) - u(*_keys(key_cols), seed, "wsample", backend=backend)) / F.col(weight)
    return (df.filter(F.col(weight) > 0).withColumn("_k", key)
            .orderBy("_k", *key_cols).limit(n).drop("_k"))


# --------------------------------------------------------------------------------------------
# F3 repeat

def repeat_rows(df: DataFrame, k: int, name: str = "rep") -> DataFrame:
    """each row ``k`` times with ``name`` in 1..k (a generator, no shuffle)."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(1), F.lit(k))))


# --------------------------------------------------------------------------------------------
# F4 / F5 deltas

def delta_from_uniform(s: Column, uu: Column, delta_min: float = DELTA_MIN, delta_max: float = DELTA_MAX,
                       deadzone: float = DEADZONE) -> Column:
    """uniform on ``[max(-s, m), min(1 - s, M)]`` minus the dead zone ``(-z, z)``.

    lower = clip(s - z, 0, -m - z); upper = clip(1 - s - z, 0, M - z); range = lower + upper;
    min = z if s < z else max(-s, m); max = -z if 1 - s < z else min(1 - s, M);
    d = u range + min, plus 2z when both sides are open and d > -z.
    """
    z = F.lit(deadzone)
    lower = F.least(F.greatest(s - z, F.lit(0.0)), F.lit(-delta_min - deadzone))
    upper = F.least(F.greatest(F.lit(1.0) - s - z, F.lit(0.0)), F.lit(delta_max - deadzone))
    rng = lower + upper
    mn = F.when(s < z, z).otherwise(F.greatest(-s, F.lit(delta_min)))
    mx = F.when(F.lit(1.0) - s < z, -z).otherwise(F.least(F.lit(1.0) - s, F.lit(delta_max)))
    both = (mn < z) & (mx > -z)
    d0 = uu * rng + mn
    return F.when(both & (d0 > -z), d0 + F.lit(2 * deadzone)).otherwise(d0)


def delta_from_uniform_sql(s: str, uu: str, delta_min: float = DELTA_MIN, delta_max: float = DELTA_MAX,
                           deadzone: float = DEADZONE) -> str:
    z = f"{deadzone!r}::DOUBLE"
    lower = f"least(greatest({s} - {z}, 0.0::DOUBLE), {(-delta_min - deadzone)!r}::DOUBLE)"
    upper = f"least(greatest(1.0::DOUBLE - {s} - {z}, 0.0::DOUBLE), {(delta_max - deadzone)!r}::DOUBLE)"
    mn = f"(CASE WHEN {s} < {z} THEN {z} ELSE greatest(-{s}, {delta_min!r}::DOUBLE) END)"
    mx = f"(CASE WHEN 1.0::DOUBLE - {s} < {z} THEN -{z} ELSE least(1.0::DOUBLE - {s}, {delta_max!r}::DOUBLE) END)"
    d0 = f"({uu} * ({lower} + {upper}) + {mn})"
    return f"(CASE WHEN {mn} < {z} AND {mx} > -{z} AND {d0} > -{z} THEN {d0} + {2 * deadzone!r}::DOUBLE ELSE {d0} END)"


def active_flags(picks: dict[str, Column], m: int) -> dict[str, Column]:
    """exactly ``min(m, d)`` active goals: those whose pick uniform ranks among the m smallest
    (ties broken by goal order).  Unrolled comparisons, no arrays."""
    goals = list(picks)
    out = {}
    for i, g in enumerate(goals):
        rank = None
        for j, h in enumerate(goals):
            if h == g:
                continue
            before = (picks[h] < picks[g]) | ((picks[h] == picks[g]) & F.lit(j < i))
            term = F.when(before, 1).otherwise(0)
            rank = term if rank is None else rank + term
        out[g] = (rank if rank is not None else F.lit(0)) < F.lit(m)
    return out


def active_flags_sql(picks: dict[str, str], m: int) -> dict[str, str]:
    goals = list(picks)
    out = {}
    for i, g in enumerate(goals):
        terms = []
        for j, h in enumerate(goals):
            if h == g:
                continue
            tie = "TRUE" if j < i else "FALSE"
            terms.append(f"(CASE WHEN {picks[h]} < {picks[g]} OR ({picks[h]} = {picks[g]} AND {tie}) THEN 1 ELSE 0 END)")
        out[g] = f"(({' + '.join(terms) or '0'}) < {m})"
    return out


def uniforms(key_cols: list[str], goals: list[str], seed: int, purpose: str = "probe") -> dict[str, list[Column]]:
    """Four uniforms per goal from one md5 per (row, goal): [pick, delta, spare, spare]."""
    return {g: u4(*_keys(key_cols), seed, purpose, g) for g in goals}


def uniforms_sql(key_cols: list[str], goals: list[str], seed: int, purpose: str = "probe") -> dict[str, list[str]]:
    return {g: u4_sql(*_keys(key_cols), seed, purpose, g) for g in goals}


def with_deltas(df: DataFrame, goals: list[str], key_cols: list[str], seed: int = 42, max_active: int = 3,
                delta_min: float = DELTA_MIN, delta_max: float = DELTA_MAX, deadzone: float = DEADZONE) -> DataFrame:
    """F4 + F5 + targets: ``delta_g`` (null when inactive) and ``target_g = source_g + delta_g``.

    The uniforms are bound to columns first, so each md5 runs once per row and goal.
    """
    keys = [f"col:{k}" for k in key_cols]
    df = df.withColumns({f"_h_{g}": md5_hex(*keys, seed, "probe", g) for g in goals})
    df = df.withColumns({f"_up_{g}": u_from_hex(F.col(f"_h_{g}"), 0) for g in goals}
                        | {f"_ud_{g}": u_from_hex(F.col(f"_h_{g}"), 1) for g in goals}).drop(*[f"_h_{g}" for g in goals])
    flags = active_flags({g: F.col(f"_up_{g}") for g in goals}, max_active)
    df = df.withColumns({f"delta_{g}": F.when(flags[g], delta_from_uniform(F.col(f"source_{g}"), F.col(f"_ud_{g}"),
                                                                            delta_min, delta_max, deadzone))
                         for g in goals})
    df = df.withColumns({f"target_{g}": F.col(f"source_{g}") + F.col(f"delta_{g}") for g in goals})
    return df.drop(*[f"_up_{g}" for g in goals], *[f"_ud_{g}" for g in goals])


def deltas_sql(goals: list[str], key_cols: list[str], seed: int = 42, max_active: int = 3,
               delta_min: float = DELTA_MIN, delta_max: float = DELTA_MAX, deadzone: float = DEADZONE,
               src: str = "source_{g}") -> tuple[dict[str, str], dict[str, str]]:
    """SQL twin: (uniform columns to bind, delta expressions over the bound columns)."""
    us = uniforms_sql(key_cols, goals, seed)
    bind = {f"_up_{g}": us[g][0] for g in goals} | {f"_ud_{g}": us[g][1] for g in goals}
    flags = active_flags_sql({g: f"_up_{g}" for g in goals}, max_active)
    deltas = {f"delta_{g}": f"CASE WHEN {flags[g]} THEN {delta_from_uniform_sql(src.format(g=g), f'_ud_{g}', delta_min, delta_max, deadzone)} END"
              for g in goals}
    return bind, deltas


def final_probe(goalspace: DataFrame, goals: list[str], n_source_texts: int | None, n_goals_per_text: int,
                key: str = "row_id", seed: int = 42, weighted: bool = True, max_active: int = 3,
                delta_min: float = DELTA_MIN, delta_max: float = DELTA_MAX, deadzone: float = DEADZONE) -> DataFrame:
    """sample texts (F2 / F1; all rows when ``n_source_texts`` is None), repeat (F3),
    choose active goals and deltas (F4 / F5), targets; the seed row id becomes ``original_index``."""
    if n_source_texts is not None:
        if weighted:
            base = sample_weighted(goalspace, n_source_texts, [key], seed=seed)
        else:
            base = sample_uniform(goalspace, n_source_texts, [key], seed=seed)
    else:
        base = goalspace
    base = base.withColumnRenamed(key, "original_index")
    rep = repeat_rows(base, n_goals_per_text)
    return with_deltas(rep, goals, ["original_index", "rep"], seed, max_active, delta_min, delta_max, deadzone)


def matched_probe(probe: DataFrame, seed: int, max_active: int = 3, delta_min: float = DELTA_MIN,
                  delta_max: float = DELTA_MAX, deadzone: float = DEADZONE) -> DataFrame:
    """same texts and sources, fresh deltas/targets under a new seed/config; prompt columns dropped."""
    from tonegauge.schema import drop_roles, goals_of
    goals = goals_of(probe, "source_")
    base = drop_roles(probe, "delta_", "target_", also=("instructions", "prompt", "model_name"))
    return with_deltas(base, goals, ["original_index", "rep"], seed, max_active, delta_min, delta_max, deadzone)


def clip_targets(df: DataFrame, goals: list[str]) -> DataFrame:
    return df.withColumns({f"target_{g}": clip01(F.col(f"target_{g}")) for g in goals})


__all__ = ["sample_uniform", "sample_weighted", "repeat_rows", "delta_from_uniform", "active_flags",
           "with_deltas", "final_probe", "matched_probe", "u_sql", "clip01_sql"]
