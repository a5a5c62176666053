"""Exact global quantiles without gathering a column into one task or the driver.

Spark's exact ``percentile`` merges every distinct value of the column into one buffer in one
task; ``percentile_approx`` is bounded but inexact.  The goal ranges (E1) and the summaries
(H10) need exact order statistics that agree with NumPy / DuckDB linear interpolation, on
inputs of any size, so a sketch guesses where a rank lies and exact counts confirm it:

1. one pass: ``count, min, max`` (plus mean / population std for summaries) per column;
2. one pass merges a KLL sketch per column; its quantiles a little below and above each wanted rank
   bracket the rank's value;
3. one pass counts the values below each bracket; a bracket that misses its rank is widened to the
   whole column (the sketch's error is only likely, not certain);
4. each further pass deals the values inside open brackets to ``BUCKETS`` equal-width buckets,
   ``(target, bucket) -> count, min, max`` with map-side combine, and narrows each bracket to the
   bucket holding its rank, until that holds one distinct value.

The driver sees ``targets x BUCKETS`` rows a pass and never a value of its own choice; only values inside
brackets (under one in a hundred rows) are dealt to buckets.  Bracket ends are values of the column and fall
in different buckets, so every pass narrows a bracket, and divides its width by ``BUCKETS``, which bounds the
passes for any doubles.  NaN counts as null.  For quantiles of many groups see
:func:`ordered.group_quantiles`.  The narrow projection is persisted (MEMORY_AND_DISK) for the passes and
released after.
"""

from __future__ import annotations

import math
import sys

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1024
#: size of the sketches, and how far from a wanted rank the bracket's ends are looked for (share of the values)
SKETCH, MARGIN = 2048, 0.004
LARGEST = sys.float_info.max


def _rank_targets(n: int, probs: list[float]) -> list[tuple[float, int, int]]:
    out = []
    for q in probs:
        h = (n - 1) * q
        lo = int(math.floor(h))
        hi = int(math.ceil(h))
        out.append((h, lo, hi))
    return out


def _bucket(v: Column, lo: float, hi: float) -> Column:
    """Equal-width bucket of ``v`` in ``[lo, hi]``; the infinities have buckets of their own."""
    a, z = max(lo, -LARGEST), min(hi, LARGEST)
    half = 0.5 if math.isinf(z - a) else 1.0  # the span itself may overflow
    width = z * half - a * half
    share = (v * F.lit(half) - F.lit(a * half)) / F.lit(width) * F.lit(float(BUCKETS)) if width else F.lit(0.0)
    b = F.floor(F.least(F.greatest(share, F.lit(0.0)), F.lit(BUCKETS - 1.0))).cast("int")
    return F.when(v == F.lit(-math.inf), -1).when(v == F.lit(math.inf), BUCKETS).otherwise(b)


def _number(c: str) -> Column:
    """The column as a double, NaN as null."""
    v = F.col(c).cast("double")
    return F.when(~F.isnan(v), v)


def _brackets(df: DataFrame, columns: list[str], open_t: dict, stats: dict[str, dict]) -> None:
    """Narrows the open targets to brackets from sketches, with the exact number of values below."""
    idx = {c: i for i, c in enumerate(columns)}
    keys = list(open_t)
    guesses = []
    for t, (c, r) in enumerate(keys):
        n = stats[c]["n"]
        sketch = F.kll_sketch_agg_double(F.col(f"v{idx[c]}"), F.lit(SKETCH))
        for end, at in (("lo", max(0.0, (r + 0.5) / n - MARGIN)), ("hi", min(1.0, (r + 0.5) / n + MARGIN))):
            guesses.append(F.kll_sketch_get_quantile_double(sketch, F.lit(at)).alias(f"{end}{t}"))
    row = df.agg(*guesses).first()
    ends = {k: (row[f"lo{t}"], row[f"hi{t}"]) for t, k in enumerate(keys)}
    counts = []
    for t, k in enumerate(keys):
        v = F.col(f"v{idx[k[0]]}")
        counts += [F.count_if(v < F.lit(ends[k][0])).alias(f"b{t}"), F.count_if((v >= F.lit(ends[k][0])) & (v <= F.lit(ends[k][1]))).alias(f"n{t}")]
    row = df.agg(*counts).first()
    for t, k in enumerate(keys):
        if row[f"b{t}"] <= k[1] < row[f"b{t}"] + row[f"n{t}"]:
            open_t[k] = [*k, *ends[k], row[f"b{t}"]]


def order_statistics(df: DataFrame, columns: list[str], ranks: dict[str, set[int]],
                     stats: dict[str, dict]) -> dict[tuple[str, int], float]:
    """Values at 0-based ``ranks`` (ascending, nulls excluded) of each column."""
    idx = {c: i for i, c in enumerate(columns)}
    # open targets: key -> [column, rank, lo, hi, below]
    open_t = {}
    found: dict[tuple[str, int], float] = {}
    for c, rs in ranks.items():
        for r in rs:
            st = stats[c]
            if st["min"] == st["max"]:
                found[(c, r)] = st["min"]
            else:
                open_t[(c, r)] = [c, r, st["min"], st["max"], 0]
    if open_t:
        _brackets(df, columns, open_t, stats)
    while open_t:
        keys = list(open_t)
        structs = []
        for t, k in enumerate(keys):
            c, _, lo, hi, _ = open_t[k]
            v = F.col(f"v{idx[c]}")
            structs.append(F.when((v >= F.lit(lo)) & (v <= F.lit(hi)),
                                  F.struct(F.lit(t).alias("t"), _bucket(v, lo, hi).alias("b"), v.alias("v"))))
        hist = (df.select(F.explode(F.filter(F.array(*structs), lambda s: s.isNotNull())).alias("s"))
                .groupBy("s.t", "s.b")
                .agg(F.count(F.lit(1)).alias("n"), F.min("s.v").alias("mn"), F.max("s.v").alias("mx"))
                .collect())
        by_t: dict[int, list] = {}
        for row in hist:
            by_t.setdefault(row["t"], []).append((row["b"], row["n"], row["mn"], row["mx"]))
        for t, k in enumerate(keys):
            c, r, lo, hi, acc = open_t[k]
            for b, n, mn, mx in sorted(by_t.get(t, [])):
                if acc + n > r:
                    if mn == mx:
                        found[k] = mn
                        open_t.pop(k)
                    else:
                        open_t[k] = [c, r, mn, mx, acc]
                    break
                acc += n
            else:  # pragma: no cover - rank always inside the bracket
                raise RuntimeError("rank outside bracket")
    return found


def describe(df: DataFrame, columns: list[str], probs: tuple[float, ...] = (0.25, 0.5, 0.75),
             moments: bool = True) -> dict[str, dict]:
    """Per column: n, min, max, (mean, std_pop) and exact linear-interpolated quantiles.

    Quantile at q uses rank ``h = (n - 1) q`` and ``x[floor h] + (h - floor h)(x[ceil h] - x[floor h])``
    (NumPy ``linear``, DuckDB ``quantile_cont``).  Columns with no non-null value give None.
    """
    narrow = df.select(*[_number(c).alias(f"v{i}") for i, c in enumerate(columns)])
    narrow = narrow.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        aggs = []
        for i, _ in enumerate(columns):
            v = F.col(f"v{i}")
            aggs += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"mn{i}"), F.max(v).alias(f"mx{i}")]
            if moments:
                aggs += [F.avg(v).alias(f"avg{i}"), F.stddev_pop(v).alias(f"sd{i}")]
        row = narrow.agg(*aggs).first()
        stats = {}
        for i, c in enumerate(columns):
            stats[c] = {"n": row[f"n{i}"], "min": row[f"mn{i}"], "max": row[f"mx{i}"]}
            if moments:
                stats[c]["mean"] = row[f"avg{i}"]
                stats[c]["std"] = row[f"sd{i}"]
        ranks: dict[str, set[int]] = {}
        plan: dict[str, list] = {}
        for c in columns:
            n = stats[c]["n"]
            if n == 0:
                continue
            plan[c] = _rank_targets(n, list(probs))
            for _, lo, hi in plan[c]:
                ranks.setdefault(c, set()).update({lo, hi})
        found = order_statistics(narrow, columns, ranks, stats)
        for c in columns:
            qs = []
            for h, lo, hi in plan.get(c, []):
                a = found[(c, lo)]
                if hi == lo:
                    qs.append(a)
                else:
                    b = found[(c, hi)]
                    qs.append(a + (h - lo) * (b - a))
            stats[c]["quantiles"] = qs if c in plan else [None] * len(probs)
        return stats
    finally:
        narrow.unpersist()


def quantiles(df: DataFrame, columns: list[str], probs: tuple[float, ...]) -> dict[str, list]:
    st = describe(df, columns, probs, moments=False)
    return {c: st[c]["quantiles"] for c in columns}
