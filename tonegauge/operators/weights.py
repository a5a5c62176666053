"""Uniformising sampling weights by classifier density-ratio estimation.

Real rows (``source_<g>`` vectors) are labelled 1; as many points drawn uniformly from
[0, 1]^d with the deterministic ``u`` are labelled 0.  A logistic regression separates them;
the weight of a real row is ``p(uniform) / p(real)``, normalised to sum 1 (E4).  The AUC of the
classifier measures how non-uniform the seed set is (E5).

A row carries its own uniform point, so the two classes are one table, read once per step.  The fit is
Newton's method on ``1/2 |w|^2 + sum(loss)`` (the intercept is free): each step is one aggregate of the
gradient, the Hessian and the objective, ``(d + 1)(d + 4) / 2 + 1`` sums, whatever the number of rows.  The
objective is strictly convex in the weights, so a small gradient certifies the optimum: the fit returns the
largest gradient entry per row, and fails rather than return coefficients that miss ``TOLERANCE``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonegauge.keys import u
from tonegauge.operators.ordered import positions
from tonegauge.store import written_once

#: largest gradient entry, per row of both classes, of an accepted fit; most Newton steps
TOLERANCE, STEPS = 1e-12, 50


@dataclass(frozen=True)
class Fit:
    """Coefficients (intercept first), rows of both classes, objective and largest gradient entry per row."""

    coef: np.ndarray
    rows: int
    objective: float
    gradient: float


def _margin(coef, x: list[Column]) -> Column:
    z = F.lit(float(coef[0]))
    for b, c in zip(coef[1:], x):
        z = z + F.lit(float(b)) * c
    return z


def _softplus(z: Column) -> Column:
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def _sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _step(points: DataFrame, d: int, coef: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, int]:
    """(objective, gradient, Hessian, rows) at ``coef``: one aggregate over real and uniform points."""
    sums = {"n": None, "f": None}
    for side, sign in (("r", 1.0), ("u", 0.0)):
        x = [F.col(f"{side}{i}") for i in range(d)]
        z = _margin(coef, x)
        p, one = _sigmoid(z), [F.lit(1.0), *x]
        loss = _softplus(z) - z if sign else _softplus(z)
        parts = {"n": F.lit(1), "f": loss} | {f"g{i}": (p - sign) * one[i] for i in range(d + 1)}
        parts |= {f"h{i}_{j}": p * (1 - p) * one[i] * one[j] for i in range(d + 1) for j in range(i, d + 1)}
        for k, v in parts.items():
            sums[k] = v if sums.get(k) is None else sums[k] + v
    row = points.agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(k) for k, v in sums.items()]).first()
    pen = np.append(0.0, coef[1:])
    h = np.zeros((d + 1, d + 1))
    for i in range(d + 1):
        for j in range(i, d + 1):
            h[i, j] = h[j, i] = row[f"h{i}_{j}"]
    h[np.arange(1, d + 1), np.arange(1, d + 1)] += 1
    g = np.array([row[f"g{i}"] for i in range(d + 1)], float) + pen
    return float(row["f"]) + 0.5 * float(pen @ pen), g, h, int(row["n"])


def fit(points: DataFrame, d: int) -> Fit:
    """The minimiser over (``r0..``, ``u0..``) points, by halved Newton steps, with its certificate."""
    coef = np.zeros(d + 1)
    value, g, h, n = _step(points, d, coef)
    if not n:
        return Fit(coef, 0, 0.0, 0.0)
    for _ in range(STEPS):
        if np.abs(g).max() <= TOLERANCE * n:
            break
        step = np.linalg.solve(h, g)
        for _ in range(40):
            now = _step(points, d, coef - step)
            if now[0] <= value + 1e-9 * abs(value):
                break
            step = step / 2
        coef = coef - step
        value, g, h, n = now
    if np.abs(g).max() > TOLERANCE * n:
        raise RuntimeError(f"the fit stopped at a gradient of {np.abs(g).max() / n} per row")
    return Fit(coef, n, value, float(np.abs(g).max() / n))


def auc(scores: DataFrame) -> float | None:
    """Area under the curve of (score, label): the rank sum with mid-ranks for ties; None without both labels.

    Ranks are places in a range-partitioned order; rows of one score meet in an aggregate of their first and last place."""
    placed = positions(scores.select("score", "label").filter("score is not null").withColumn("_tie", F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20))), ["score"])
    ties = placed.groupBy("score").agg(((F.min("pos") + F.max("pos")) / 2.0 + 1).alias("rank"), F.sum("label").alias("p"), F.count("*").alias("n"))
    r = ties.agg(F.sum(F.col("rank") * F.col("p")).alias("s"), F.sum("p").alias("p"), F.sum("n").alias("n")).first()
    if not r.p or r.p == r.n:
        return None
    return (r.s - r.p * (r.p + 1) / 2) / (r.p * (r.n - r.p))


def uniform_weights(df: DataFrame, goals: list[str], key: str, seed: int = 42) -> tuple[DataFrame, float, Fit]:
    """E4 + E5: (``df`` with ``sampling_weights``, AUC, the fit).  Rows with a null goal get a null weight.

    Weights are 1 / odds, scaled by their sum."""
    d = len(goals)
    real = {f"r{i}": F.col(f"source_{g}").cast("double") for i, g in enumerate(goals)}
    drawn = {f"u{i}": u(f"col:{key}", seed, "unif", g) for i, g in enumerate(goals)}
    points = df.select(*[c.alias(k) for k, c in (real | drawn).items()])
    points = written_once(points.na.drop(), "points")
    fitted = fit(points, d)
    sides = F.array(*[F.struct(_margin(fitted.coef, [F.col(f"{s}{i}") for i in range(d)]).alias("score"), F.lit(y).alias("label")) for s, y in (("r", 1), ("u", 0))])
    area = auc(points.select(F.explode(sides).alias("x")).select("x.*"))
    ratio = F.exp(-_margin(fitted.coef, [F.col(f"source_{g}").cast("double") for g in goals]))
    total = points.agg(F.sum(F.exp(-_margin(fitted.coef, [F.col(f"r{i}") for i in range(d)])))).first()[0]
    return df.withColumn("sampling_weights", ratio / F.lit(total)), area, fitted
