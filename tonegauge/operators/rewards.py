"""Per-row rewards over a completions table.

A completions table carries ``completion`` (text or chat messages), ``model_name``, and for
each goal ``source_<g>``, ``target_<g>`` and the scored completion ``output_<g>``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonegauge.functions import text as tx

CJK = r"[\x{4E00}-\x{9FFF}]"
THINK_FORMAT = r"(?s)^<think>.*?</think>"


def _t(g):
    return F.coalesce(F.col(f"target_{g}"), F.col(f"source_{g}"))


def steering_reward(goals: list[str], all_goals: list[str] | None = None, good_enough: float | None = None,
                    too_bad: float | None = None, decile: bool = False, rescale_norm: bool = False,
                    square: bool = False) -> Column:
    """Squared clipped error summed over the chosen goals.

    err_g = clip(|target - output|, good_enough, too_bad) [decile: ceil to tenths, clip 0..1];
    rescale_norm divides by the number of *all* mapped goals (as the original does).
    """
    total = None
    for g in goals:
        e = F.abs(_t(g) - F.col(f"output_{g}"))
        if good_enough is not None:
            e = F.greatest(e, F.lit(good_enough))
        if too_bad is not None:
            e = F.least(e, F.lit(too_bad))
        if decile:
            e = F.least(F.greatest(F.ceil(e * 10) / F.lit(10.0), F.lit(0.0)), F.lit(1.0))
        total = e * e if total is None else total + e * e
    n = float(len(all_goals or goals))
    if rescale_norm:
        return F.lit(1.0) - total / F.lit(n) if square else F.lit(1.0) - F.sqrt(total / F.lit(n))
    return -total if square else -F.sqrt(total)


def _raw_vectors(goals):
    to_goal = {g: _t(g) - F.col(f"output_{g}") for g in goals}
    req = {g: _t(g) - F.col(f"source_{g}") for g in goals}
    moved = {g: F.col(f"output_{g}") - F.col(f"source_{g}") for g in goals}
    return to_goal, req, moved


def _dot(a, b, goals):
    out = None
    for g in goals:
        out = a[g] * b[g] if out is None else out + a[g] * b[g]
    return out


def neg_orthogonality(goals: list[str], normalize: bool = False) -> Column:
    """Minus the rejection of (target - output) from (target - source), raw vectors."""
    a, b, mv = _raw_vectors(goals)
    coef = _dot(a, b, goals) / (_dot(b, b, goals) + F.lit(1e-8))
    sq = None
    for g in goals:
        r = a[g] - coef * b[g]
        sq = r * r if sq is None else sq + r * r
    rej = F.sqrt(sq)
    if normalize:
        denom = F.sqrt(_dot(mv, mv, goals)) + F.lit(1e-4) * (F.sqrt(_dot(b, b, goals)) + F.lit(1e-8))
        rej = F.least(F.greatest(rej / denom, F.lit(0.0)), F.lit(1.0))
    return -rej


def neg_miscalibration(goals: list[str], normalize: bool = False) -> Column:
    """Minus |projection of (target - output) on (target - source)|, raw vectors."""
    a, b, _ = _raw_vectors(goals)
    nb = F.sqrt(_dot(b, b, goals))
    m = F.abs(_dot(a, b, goals) / (nb + F.lit(1e-8)))
    if normalize:
        m = m / (nb + F.lit(1e-8))
    return -m


def neg_abs_error(goal: str) -> Column:
    """Minus |target - output| of one goal."""
    return -F.abs(_t(goal) - F.col(f"output_{goal}"))


def format_reward(completion: Column) -> Column:
    """1.0 when the completion starts with a ``<think>...</think>`` block."""
    return F.when(completion.rlike(THINK_FORMAT), F.lit(1.0)).otherwise(F.lit(0.0))


def english_only_reward(completion: Column) -> Column:
    """0.0 when any CJK unified ideograph (U+4E00-U+9FFF) appears."""
    return F.when(completion.rlike(CJK), F.lit(0.0)).otherwise(F.lit(1.0))


def registry(goals: list[str], completion: Column | None = None) -> dict[str, Callable[[], Column]]:
    """J7 names -> reward Column builders (``j_error`` / ``su_error`` have no scorer: skipped).
    ``completion`` is the text of the completion; the plain column if not given."""
    def said():
        return F.col("completion") if completion is None else completion
    return {
        "steering_error": lambda: steering_reward(goals),
        "miscalibration": lambda: neg_miscalibration(goals),
        "orthogonality": lambda: neg_orthogonality(goals),
        "think_format": lambda: format_reward(said()),
        "english_only": lambda: english_only_reward(said()),
        "rd_error": lambda: neg_abs_error("reading_difficulty"),
        "tl_error": lambda: neg_abs_error("text_length"),
        "td_error": lambda: neg_abs_error("textual_diversity"),
        "fm_error": lambda: neg_abs_error("formality"),
    }


def reward_plan(optimised: list[str], tracked: list[str], model_name: str, goals: list[str]) -> list[tuple[str, float]]:
    """Optimised rewards weight 1, tracked-only weight 0, unknown names skipped; models from
    the ``deepseek-ai`` organisation also optimise ``english_only``."""
    reg = registry(goals)
    plan = [(n, 1.0) for n in optimised if n in reg]
    if model_name.split("/")[0] == "deepseek-ai":
        plan.append(("english_only", 1.0))
    plan += [(n, 0.0) for n in tracked if n in reg]
    return plan


def with_rewards(df: DataFrame, plan: list[tuple[str, float]], goals: list[str]) -> DataFrame:
    """One column per reward plus ``reward`` = the weighted sum.

    Completions may be strings or chat messages (C10).  Rewards of weight 0 are tracked only: they
    stay out of the sum, so a null there leaves ``reward`` as it is.
    """
    completion = tx.unwrap_chat(df, "completion") if "completion" in df.columns else None
    reg = registry(goals, completion)
    cols = {}
    for i, (name, _) in enumerate(plan):
        cols[f"r{i}_{name}"] = reg[name]()
    df = df.withColumns(cols)
    total = None
    for i, (name, w) in enumerate(plan):
        if w == 0:
            continue
        term = F.col(f"r{i}_{name}") * F.lit(w)
        total = term if total is None else total + term
    return df.withColumn("reward", total if total is not None else F.lit(0.0))
