"""Queries S1, S2 (streaming) and E4, E5 (density-ratio weights)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonegauge.functions import scorers as S
from tonegauge.keys import u_sql
from tonegauge.operators import normalise as N
from tonegauge.operators import weights as WT
from tonegauge.plans import fixtures as X
from tonegauge.plans.q_text import RANGES
from tonegauge.plans.registry import query, rounded
from tonegauge.streaming import scoring as ST

G = X.GOALS


@query("s1_stream_scoring", "SELECT doc_id, " + ", ".join(
    f"round({N.clip01_sql(f'({S.REGISTRY.sql(g)("text")} - {lo!r}::DOUBLE) / ({hi - lo!r}::DOUBLE)')}, 6) AS output_{g}"
    for g, (lo, hi) in RANGES.items()) + " FROM documents")
def s1_stream_scoring(spark, sf):
    """Documents arriving as files, scored and normalised by a streaming query (availableNow)."""
    out = ST.score_stream(spark, ST.text_stream(spark, sf), list(RANGES), RANGES)
    return rounded(out)


@query("s2_stream_dedup", "SELECT DISTINCT sha256(text) AS text_key, " + ", ".join(f"round({S.REGISTRY.sql(g)('text')}, 6) AS {g}" for g in G) + " FROM documents")
def s2_stream_dedup(spark, sf):
    """The streaming scorer skips texts already in the score cache (one row per text key)."""
    return rounded(ST.dedup_stream(spark, ST.text_stream(spark, sf), G))


@query("s2_arrivals", "SELECT DISTINCT sha256(text) AS text_key, " + ", ".join(f"round({S.REGISTRY.sql(g)('text')}, 6) AS {g}" for g in G)
       + " FROM documents WHERE doc_id IN (SELECT user_id FROM events)")
def s2_arrivals(spark, sf):
    """S2 over arrivals: every event asks for the text of its user's document again; each text is scored once."""
    texts = X.read(spark, sf, "documents").select(F.col("doc_id").alias("user_id"), "text")
    return rounded(ST.dedup_stream(spark, ST.event_stream(spark, sf).join(texts, "user_id"), G))


@query("s2_drop_repeats", "SELECT DISTINCT user_id, event_type FROM events")
def s2_drop_repeats(spark, sf):
    """S2 by state: the first event of each user and type, repeats dropped within a watermark of 60 days."""
    return ST.drop_repeats(spark, ST.event_stream(spark, sf), ["user_id", "event_type"], "ts", "60 days").select("user_id", "event_type")


def _newton_sql(d: int, steps: int) -> list[tuple[str, str]]:
    """The fit as a chain of Newton steps: one aggregate a step, then Gaussian elimination column by column."""
    out = [("n0", "SELECT " + ", ".join(f"0.0::DOUBLE AS b{i}" for i in range(d + 1)))]
    xs = ["1.0::DOUBLE", *[f"x{i}" for i in range(d)]]
    z = "b0" + "".join(f" + b{i + 1} * x{i}" for i in range(d))
    for t in range(steps):
        out.append((f"np{t}", f"SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + exp(-({z}))) AS p FROM pts CROSS JOIN n{t}"))
        sums = [f"sum((p - y) * {xs[i]}) + {'any_value(b%d)' % i if i else '0.0::DOUBLE'} AS a{i}_{d + 1}" for i in range(d + 1)]
        sums += [f"sum(p * (1 - p) * {xs[i]} * {xs[j]}) + {1 if i == j and i else 0} AS a{i}_{j}" for i in range(d + 1) for j in range(d + 1)]
        out.append((f"ns{t}_0", "SELECT " + ", ".join(sums) + "".join(f", any_value(b{i}) AS b{i}" for i in range(d + 1)) + f" FROM np{t}"))
        for k in range(d + 1):  # eliminate column k from all other rows
            cells = [f"a{i}_{j} - a{i}_{k} / a{k}_{k} * a{k}_{j} AS a{i}_{j}" if i != k else f"a{i}_{j}" for i in range(d + 1) for j in range(d + 2)]
            out.append((f"ns{t}_{k + 1}", "SELECT " + ", ".join(cells) + "".join(f", b{i}" for i in range(d + 1)) + f" FROM ns{t}_{k}"))
        out.append((f"n{t + 1}", "SELECT " + ", ".join(f"b{i} - a{i}_{d + 1} / a{i}_{i} AS b{i}" for i in range(d + 1)) + f" FROM ns{t}_{d + 1}"))
    return out


def _e4_sql() -> str:
    d, steps = len(G), 12
    pts = ("SELECT 1 AS y, " + ", ".join(f"source_{g} AS x{i}" for i, g in enumerate(G)) + " FROM goalspace UNION ALL SELECT 0 AS y, "
           + ", ".join(f"{u_sql('col:row_id', 42, 'unif', g)} AS x{i}" for i, g in enumerate(G)) + " FROM goalspace")
    z = "b0" + "".join(f" + b{i + 1} * x{i}" for i in range(d))
    own = "b0" + "".join(f" + b{i + 1} * source_{g}" for i, g in enumerate(G))
    ctes = X.sql_goalspace() + [("pts", pts)] + _newton_sql(d, steps) + [
        ("sc", f"SELECT y, {z} AS s FROM pts CROSS JOIN n{steps}"),
        ("tie", "SELECT s, (min(r) + max(r)) / 2.0 AS rank, sum(y) AS p FROM (SELECT *, row_number() OVER (ORDER BY s) AS r FROM sc) GROUP BY s"),
        ("roc", "SELECT (sum(rank * p) - sum(p) * (sum(p) + 1) / 2.0) / (sum(p) * (SELECT count(*) - sum(y) FROM sc)) AS auc FROM tie"),
        ("wt", f"SELECT row_id, exp(-({own})) AS r FROM goalspace CROSS JOIN n{steps}")]
    return X.with_ctes(ctes, "SELECT row_id, round(1e3 * r / sum(r) OVER (), 6) AS weight_per_mille, round(r / sum(r) OVER () * count(*) OVER (), 6) AS sampling_weights_mean, "
                             "round(auc, 6) AS auc, TRUE AS certified FROM wt CROSS JOIN roc")


@query("e4_e5_uniform_weights", _e4_sql())
def e4_e5_uniform_weights(spark, sf):
    """E4 density-ratio sampling weights (sum 1, here per mille) and E6 mean-1 weights, the E5 AUC, and whether the
    fit's gradient certifies the optimum.  The twin repeats Newton's steps in SQL."""
    w, auc, fitted = WT.uniform_weights(X.goalspace(spark, sf), G, "row_id")
    w = N.mean_weights(w)
    return rounded(w.select("row_id", (F.col("sampling_weights") * 1e3).alias("weight_per_mille"), "sampling_weights_mean", F.lit(auc).alias("auc"),
                            F.lit(fitted.gradient <= WT.TOLERANCE).alias("certified")))
