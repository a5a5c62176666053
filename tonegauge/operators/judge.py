"""Judge analytics."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonegauge.functions import text as tx
from tonegauge.keys import u
from tonegauge.operators.metrics import grounded

TIE_THRESHOLD = 0.1
LEVELS = (-1, 0, 1)


def grounded_subset(df: DataFrame, flip: bool = False) -> DataFrame:
    """Rows passing the groundedness check (or, with ``flip``, the complement)."""
    g = grounded()
    return df.filter(~F.coalesce(g, F.lit(False)) if flip else g)


def problem_set(df: DataFrame, template: str, key_cols: list[str], source_col: str = "text",
                response_col: str = "llm_response", seed: int = 42, max_tokens: int | None = None) -> DataFrame:
    """Blind A/B assignment (``u < 0.5`` puts the source first) and the judge prompt with
    both versions (whole, or cut at an explicit ``max_tokens``, C14) substituted into the ``$version_a`` / ``$version_b`` template."""
    mask = u(*[f"col:{k}" for k in key_cols], seed, "ab") < F.lit(0.5)
    a = F.when(mask, F.col(source_col)).otherwise(F.col(response_col))
    b = F.when(mask, F.col(response_col)).otherwise(F.col(source_col))
    out = df.withColumns({"source_text_is_a": mask, "version_a": a, "version_b": b})
    return out.withColumn("prompt", tx.fill_template(template, version_a=tx.truncate_tokens(F.col("version_a"), max_tokens),
                                                        version_b=tx.truncate_tokens(F.col("version_b"), max_tokens)))


def answer_key(source: Column, output: Column, source_is_a: Column, tie: float = TIE_THRESHOLD) -> Column:
    """The version holding more of the attribute.  Closer than ``tie`` is a ``Tie``; beyond it
    A holds more exactly when "the source is greater" and "the source is A" agree; a gap of just
    ``tie``, or a null, has no key (``'0'``)."""
    gap = F.abs(source - output)
    side = F.when((source > output) == source_is_a, "A").otherwise("B")
    return F.when(gap < abs(tie), "Tie").when((gap > abs(tie)) & source_is_a.isNotNull(), side).otherwise("0")


def answer_key_sql(source: str, output: str, source_is_a: str, tie: float = TIE_THRESHOLD) -> str:
    gap, t = f"abs({source} - {output})", f"{abs(tie)!r}::DOUBLE"
    return (f"CASE WHEN {gap} < {t} THEN 'Tie' WHEN {gap} > {t} AND {source_is_a} IS NOT NULL "
            f"THEN if(({source} > {output}) = {source_is_a}, 'A', 'B') ELSE '0' END")


def verdict_counts(df: DataFrame, col: str = "answer") -> DataFrame:
    """``value_counts`` of the verdict (nulls excluded, as pandas does)."""
    return df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count"))


def no_report(df: DataFrame) -> DataFrame:
    """I4: the rows the judge answered No, with text, response and rationale."""
    return df.filter(F.col("answer") == "No").select("text", "llm_response", "rationale")


def review_queue(df: DataFrame, key_cols: list[str], spot_check: int = 16, seed: int = 42) -> DataFrame:
    """Every non-Yes row (null answers included) plus a seeded sample of up to
    ``spot_check`` Yes rows (the n smallest ``u``; TakeOrdered, never a global sort)."""
    yes = F.col("answer").eqNullSafe(F.lit("Yes"))
    no_rows = df.filter(~yes).withColumn("queue", F.lit("not_yes"))
    key = u(*[f"col:{k}" for k in key_cols], seed, "spot")
    yes_rows = (df.filter(yes).withColumn("_u", key).orderBy("_u", *key_cols).limit(spot_check)
                .drop("_u").withColumn("queue", F.lit("spot_check")))
    return no_rows.unionByName(yes_rows)


def _review_key(df: DataFrame) -> Column:
    return F.sha2(F.concat_ws("\u0001", df["text"], df["llm_response"], df["rationale"]), 256)


def apply_review(df: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions ``(text, llm_response, rationale, rationale_approved, ord)``, last ``ord``
    per key wins; matched rows get the decision and ``spot_check = true``; others keep their
    approval (default true) and ``spot_check`` (default false).  Rows with a null key part never
    match (pandas equality on NaN).  Both sides are keyed by a sha-256 of the three texts so
    the shuffle carries 32-byte keys, and the decision side is pre-aggregated to one row per key."""
    dec = (decisions.filter(F.col("text").isNotNull() & F.col("llm_response").isNotNull() & F.col("rationale").isNotNull())
           .withColumn("_k", _review_key(decisions))
           .groupBy("_k").agg(F.max_by("rationale_approved", "ord").alias("_approved")))
    base = df.withColumn("_k", F.when(F.col("text").isNotNull() & F.col("llm_response").isNotNull() & F.col("rationale").isNotNull(),
                                      _review_key(df)))
    j = base.join(dec, "_k", "left")
    hit = F.col("_approved").isNotNull()
    return j.withColumns({
        "rationale_approved": F.when(hit, F.col("_approved")).otherwise(F.coalesce(F.col("rationale_approved"), F.lit(True))),
        "spot_check": F.when(hit, F.lit(True)).otherwise(F.coalesce(F.col("spot_check"), F.lit(False))),
    }).drop("_k", "_approved")


# --------------------------------------------------------------------------------------------
# I7 Kendall tau-b from cell counts

def erfc_approx(x: Column) -> Column:
    """erfc for x >= 0 (Abramowitz & Stegun 7.1.26, absolute error < 1.5e-7)."""
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.3275911) * x)
    poly = t * (F.lit(0.254829592) + t * (F.lit(-0.284496736) + t * (F.lit(1.421413741) + t * (F.lit(-1.453152027) + t * F.lit(1.061405429)))))
    return poly * F.exp(-x * x)


def erfc_approx_sql(x: str) -> str:
    t = f"(1.0::DOUBLE / (1.0::DOUBLE + 0.3275911::DOUBLE * {x}))"
    poly = (f"{t} * (0.254829592::DOUBLE + {t} * (-0.284496736::DOUBLE + {t} * (1.421413741::DOUBLE + {t} * "
            f"(-1.453152027::DOUBLE + {t} * 1.061405429::DOUBLE))))")
    return f"({poly} * exp(-{x} * {x}))"


def kendall_tau(pairs: DataFrame, attr: str = "attribute", x: str = "x", y: str = "y") -> DataFrame:
    """Tau-b, asymptotic two-sided p and n per attribute from ordinals -1, 0, 1 (C18; rows with
    a null on either side stay out).

    One aggregate counts the nine ``(x, y)`` cells of each attribute (map-side combine, one row per
    attribute); the rest is arithmetic on those counts.
      P / Q = pairs of rows ordered alike / against each other; n0 = n(n-1)/2; n1, n2 = tied pairs
      in x, y; tau = (P - Q) / sqrt((n0 - n1)(n0 - n2)), null when either side is constant;
      z = (P - Q) / sqrt(var) with the tie-corrected variance; p = erfc(|z| / sqrt 2).
    """
    grid = [(i, j) for i in LEVELS for j in LEVELS]

    def name(i, j):
        return f"_c{LEVELS.index(i)}{LEVELS.index(j)}"

    both = pairs.filter(F.col(x).isin(*LEVELS) & F.col(y).isin(*LEVELS))
    cells = both.groupBy(attr).agg(*[F.count_if((F.col(x) == i) & (F.col(y) == j)).cast("double").alias(name(i, j)) for i, j in grid])
    c = {cell: F.col(name(*cell)) for cell in grid}

    def total(terms):
        return reduce(Column.__add__, terms)

    ties = {"x": [total([c[i, j] for j in LEVELS]) for i in LEVELS], "y": [total([c[i, j] for i in LEVELS]) for j in LEVELS]}
    sums = {"n": total(list(c.values()))}
    sums |= {way: total([c[p] * c[q] for p in grid for q in grid if p[0] < q[0] and (q[1] - p[1]) * sign > 0])
             for way, sign in (("P", 1), ("Q", -1))}
    for side, counts in ties.items():
        sums |= {f"{side}_pairs": total([t * (t - 1) / 2 for t in counts]), f"{side}_v1": total([t * (t - 1) * (t * 2.0 + 5) for t in counts]),
                 f"{side}_v2": total([t * (t - 1) * (t - 2) for t in counts]), f"{side}_v3": total([t * (t - 1) for t in counts])}
    j = cells.withColumns(sums)
    nn = F.col("n")
    n0 = nn * (nn - 1) / 2
    den = (n0 - F.col("x_pairs")) * (n0 - F.col("y_pairs"))
    tau = F.when(den > 0, (F.col("P") - F.col("Q")) / F.sqrt(den))
    var = ((nn * (nn - 1) * (F.lit(2.0) * nn + 5) - F.col("x_v1") - F.col("y_v1")) / 18
           + F.when(nn > 2, F.col("x_v2") * F.col("y_v2") / (F.lit(9.0) * nn * (nn - 1) * (nn - 2))).otherwise(0.0)
           + F.when(nn > 1, F.col("x_v3") * F.col("y_v3") / (F.lit(2.0) * nn * (nn - 1))).otherwise(0.0))
    z = F.when((var > 0) & den.__gt__(0), (F.col("P") - F.col("Q")) / F.sqrt(var))
    p = erfc_approx(F.abs(z) / F.lit(math.sqrt(2.0)))
    return j.select(attr, tau.alias("tau"), p.alias("p"), nn.cast("bigint").alias("n"))


def pair_runs(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """I8: two runs side by side: every column prefixed ``left_`` / ``right_``, full outer join on
    the row key (rows missing on one side keep nulls), key columns coalesced."""
    lp = left.select(*[F.col(c).alias(c if c in key else f"left_{c}") for c in left.columns])
    rp = right.select(*[F.col(c).alias(c if c in key else f"right_{c}") for c in right.columns])
    return lp.join(rp, key, "full_outer")
