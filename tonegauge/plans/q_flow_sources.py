"""Queries L1-L7, M1 (flow fields, overlap) and A/B sources and filters."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tonegauge.functions import text as tx
from tonegauge.operators import flow as FL
from tonegauge.operators import metrics as M
from tonegauge.operators import probe as P
from tonegauge.plans import fixtures as X
from tonegauge.plans.registry import query, rounded
from tonegauge.session import checkpoint_dir
from tonegauge.sources import tables as TB

G = X.GOALS
KEY = ["original_index", "rep", "generation"]
KEY_SQL = "original_index, rep, generation"
W = X.with_ctes
G1, G2 = "reading_difficulty", "formality"


def _sub_sql(unspecified=True, specified_first=False):
    ctes = X.sql_result() + M.metrics_ctes("result", G, "m", keep_parts=False)
    base = (f"SELECT {KEY_SQL}, source_{G1} AS x1, source_{G2} AS x2, moved_{G1} AS dx1, moved_{G2} AS dx2, "
            f"coalesce(requested_{G1}, 0.0) AS dx1_ideal, coalesce(requested_{G2}, 0.0) AS dx2_ideal FROM m")
    if unspecified:
        base = f"SELECT * FROM ({base}) WHERE dx1_ideal + dx2_ideal = 0"
    elif specified_first:
        base = f"SELECT * FROM ({base}) WHERE abs(dx1_ideal) > 0 AND dx2_ideal = 0"
    return ctes + [("sub", base)]


def _sub(spark, sf, **kw):
    return FL.subspace(X.result(spark, sf), G1, G2, G, key_cols=tuple(KEY), **kw)


@query("l1_subspace", W(_sub_sql(), f"SELECT {KEY_SQL}, round(x1, 6) AS x1, round(x2, 6) AS x2, round(dx1, 6) AS dx1, round(dx2, 6) AS dx2, "
                        "round(dx1_ideal, 6) AS dx1_ideal, round(dx2_ideal, 6) AS dx2_ideal FROM sub"))
def l1_subspace(spark, sf):
    """L1: the reading-difficulty x formality subspace of rows with no net requested movement."""
    return rounded(_sub(spark, sf))


@query("l2_l3_remaining_vectors", W(_sub_sql(unspecified=False, specified_first=True),
                                    f"SELECT {KEY_SQL}, round(dx1_ideal - dx1, 6) AS u, round(dx2_ideal - dx2, 6) AS v FROM sub "
                                    "WHERE sqrt((dx1_ideal - dx1) * (dx1_ideal - dx1) + (dx2_ideal - dx2) * (dx2_ideal - dx2)) > 0.1"))
def l2_l3_remaining_vectors(spark, sf):
    """L2 remaining-distance arrows of first-goal-only rows, L3 dropping arrows of length <= 0.1."""
    v = FL.drop_close(FL.vectors(_sub(spark, sf, unspecified=False, specified_first=True), "remaining"), 0.1)
    return rounded(v.select(*KEY, "u", "v"))


def _field_sql(src, n, group=None):
    gsel = f"{group}, " if group else ""
    gby = f"GROUP BY {group}" if group else ""
    join = f"JOIN fbnd USING ({group})" if group else "CROSS JOIN fbnd"
    cell = lambda x, lo, hi: f"(CASE WHEN {hi} - {lo} > 0 THEN CAST(round(({x} - {lo}) / ({hi} - {lo}) * {n - 1}) AS INTEGER) ELSE 0 END)"
    return [("fbnd", f"SELECT {gsel}min(x1) AS x1_min, max(x1) AS x1_max, min(x2) AS x2_min, max(x2) AS x2_max FROM {src} {gby}"),
            ("fcl", f"SELECT s.*, x1_min, x1_max, x2_min, x2_max, {cell('x1', 'x1_min', 'x1_max')} AS gx, {cell('x2', 'x2_min', 'x2_max')} AS gy FROM {src} s {join}"),
            ("fld", f"SELECT {gsel}gx, gy, any_value(x1_min) + gx * (any_value(x1_max) - any_value(x1_min)) / {n - 1} AS x, "
                    f"any_value(x2_min) + gy * (any_value(x2_max) - any_value(x2_min)) / {n - 1} AS y, avg(u) AS u, avg(v) AS v, count(*) AS n "
                    f"FROM fcl GROUP BY {gsel}gx, gy")]


@query("l4_l5_l6_field", W(_sub_sql(unspecified=False) + [("vec", "SELECT *, dx1 AS u, dx2 AS v FROM sub")] + _field_sql("vec", 51)
                           + [("sc", "SELECT *, u * 1.5 AS su, v * 1.5 AS sv, sqrt((u * 1.5) * (u * 1.5) + (v * 1.5) * (v * 1.5)) AS magnitude FROM fld")],
                           "SELECT CAST(gx AS BIGINT) AS gx, CAST(gy AS BIGINT) AS gy, round(x, 6) AS x, round(y, 6) AS y, round(su, 6) AS u, round(sv, 6) AS v, "
                           "n, round(magnitude, 6) AS magnitude, round(max(magnitude) OVER (), 6) AS max_magnitude FROM sc"))
def l4_l5_l6_field(spark, sf):
    """L4 51x51 grid over the observed range, L5 per-node mean movement, L6 x1.5 scaling."""
    fld = FL.field(FL.vectors(_sub(spark, sf, unspecified=False)), 51)
    return rounded(FL.scaled(fld).select("gx", "gy", "x", "y", "u", "v", "n", "magnitude", "max_magnitude"))


def _idw_sql(n=51, r=2):
    place = lambda x: f"(CASE WHEN {x}_max - {x}_min > 0 THEN ({x} - {x}_min) / ({x}_max - {x}_min) * {n - 1} ELSE 0.0 END)"
    off = f"SELECT unnest(range({-r}, {r + 1}))"
    return _sub_sql(unspecified=False) + [
        ("ib", "SELECT min(x1) AS x1_min, max(x1) AS x1_max, min(x2) AS x2_min, max(x2) AS x2_max FROM sub"),
        ("ip", f"SELECT dx1 AS u, dx2 AS v, ib.*, {place('x1')} AS fx, {place('x2')} AS fy FROM sub CROSS JOIN ib"),
        ("ig", f"SELECT ip.*, CAST(round(fx) AS INTEGER) + a.o AS gx, CAST(round(fy) AS INTEGER) + b.o AS gy FROM ip CROSS JOIN ({off} AS o) a CROSS JOIN ({off} AS o) b"),
        ("iw", "SELECT *, (fx - gx) * (fx - gx) + (fy - gy) * (fy - gy) AS d2 FROM ig"),
        ("ia", "SELECT gx, gy, any_value(x1_min) + gx * (any_value(x1_max) - any_value(x1_min)) / " + str(n - 1) + " AS x, "
               "any_value(x2_min) + gy * (any_value(x2_max) - any_value(x2_min)) / " + str(n - 1) + " AS y, "
               + ", ".join(f"coalesce(avg({c}) FILTER (WHERE d2 = 0), sum({c} / d2) FILTER (WHERE d2 > 0) / sum(1.0::DOUBLE / d2) FILTER (WHERE d2 > 0)) AS {c}" for c in "uv")
               + f", count(*) AS n FROM iw WHERE d2 <= {r * r} AND gx BETWEEN 0 AND {n - 1} AND gy BETWEEN 0 AND {n - 1} GROUP BY gx, gy")]


@query("l5_idw_field", W(_idw_sql(), "SELECT CAST(gx AS BIGINT) AS gx, CAST(gy AS BIGINT) AS gy, round(x, 6) AS x, round(y, 6) AS y, round(u, 6) AS u, round(v, 6) AS v, n FROM ia"))
def l5_idw_field(spark, sf):
    """L5 by inverse-distance weighting on the 51x51 grid: empty nodes within two cells of an arrow get a value."""
    return rounded(FL.idw_field(FL.vectors(_sub(spark, sf, unspecified=False)), 51))


def _pairs_sql():
    ctes = X.sql_result() + M.metrics_ctes("result", G, "m")
    parts = []
    for a in G:
        for b in G:
            if a != b:
                parts.append(f"SELECT '{a}|{b}' AS pair, source_{a} AS x1, source_{b} AS x2, moved_{a} AS u, moved_{b} AS v, "
                             f"coalesce(requested_{a}, 0.0) AS i1, coalesce(requested_{b}, 0.0) AS i2 FROM m")
    return ctes + [("pl", f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE abs(i1) > 0 AND i2 = 0")] + _field_sql("pl", 20, "pair")


@query("l7_pairwise_fields", W(_pairs_sql(), "SELECT pair, CAST(gx AS BIGINT) AS gx, CAST(gy AS BIGINT) AS gy, round(x, 6) AS x, round(y, 6) AS y, "
                               "round(u, 6) AS u, round(v, 6) AS v, n FROM fld"))
def l7_pairwise_fields(spark, sf):
    """Movement fields of all 12 ordered goal pairs (specified-first rows, 20x20 grid)."""
    return rounded(FL.pairwise_fields(X.result(spark, sf), G, 20))


def _bleu_sql():
    grams = " UNION ALL ".join(
        f"SELECT id, c, {n} AS n, array_to_string(t[i:i + {n - 1}], chr(1)) AS g FROM (SELECT id, c, t, unnest(range(1, len(t) - {n - 2})) AS i FROM bs)" for n in range(1, 5))
    prec = " + ".join(f"0.25::DOUBLE * ln((CASE WHEN h{n} > 0 THEN h{n} ELSE 0.1::DOUBLE END) / greatest(1, cs - {n - 1}))" for n in range(1, 5))
    return X.sql_result() + [
        ("bp", "SELECT row_number() OVER () AS id, text, llm_response FROM (SELECT DISTINCT text, llm_response FROM result WHERE text IS NOT NULL AND llm_response IS NOT NULL)"),
        ("bs", f"SELECT id, 1 AS c, regexp_extract_all(llm_response, '{tx.TOKEN}') AS t FROM bp UNION ALL SELECT id, 0 AS c, regexp_extract_all(text, '{tx.TOKEN}') AS t FROM bp"),
        ("bz", "SELECT id, max(len(t)) FILTER (WHERE c = 1) AS cs, max(len(t)) FILTER (WHERE c = 0) AS rs FROM bs GROUP BY id"),
        ("bg", grams), ("bc", "SELECT id, n, g, least(sum(c), sum(1 - c)) AS hit FROM bg GROUP BY id, n, g"),
        ("bh", "SELECT id, " + ", ".join(f"coalesce(sum(hit) FILTER (WHERE n = {n}), 0) AS h{n}" for n in range(1, 5)) + " FROM bc GROUP BY id"),
        ("bb", f"SELECT text, llm_response, CASE WHEN coalesce(h1, 0) > 0 THEN (CASE WHEN cs > rs THEN 1.0::DOUBLE ELSE exp(1 - rs / cs) END) * exp({prec}) "
               "ELSE 0.0::DOUBLE END AS bleu FROM bp JOIN bz USING (id) LEFT JOIN bh USING (id)"),
        ("br", "SELECT source, bleu FROM result LEFT JOIN bb USING (text, llm_response)")]


@query("m1_bleu_overlap", W(_bleu_sql(), "SELECT coalesce(source, 'all') AS source, round(avg(bleu), 6) AS mean_bleu, count(*) AS n FROM br GROUP BY ROLLUP (source)"))
def m1_bleu_overlap(spark, sf):
    """M1: sentence BLEU of rewrite vs source, mean overall and per source dataset."""
    r = FL.with_bleu(X.result(spark, sf))
    return rounded(FL.bleu_by_source(r))


# ---------------------------------------------------------------- sources and filters
@query("a1_read_seed", "SELECT doc_id AS row_id, md5(text) AS text_md5, source FROM documents")
def a1_read_seed(spark, sf):
    """A1: read a table with an explicit schema (NaN -> null) as the seed schema."""
    d = TB.read_table(spark, f"{sf}/documents.parquet", columns={"doc_id": "row_id", "text": "text", "source": "source"})
    return d.select("row_id", F.md5("text").alias("text_md5"), "source")


DATASETS = [
    {"name": "documents", "filters": {"lang": "en"}, "feature_col": "text", "kwargs": {"min_words_per_doc": 50, "max_words_per_doc": 2048}},
    {"name": "conversations", "filters": {"role": "user"}, "feature_col": "text",
     "kwargs": {"paragraph_chunksize": 3, "min_words_per_doc": None, "max_words_per_doc": None}},
]


@query("a2_a3_collect_datasets",
       f"SELECT 'Dataset: documents' AS source, md5(text) AS text_md5 FROM documents WHERE lang = 'en' AND {tx.token_count_sql('text')} BETWEEN 50 AND 2048 "
       f"UNION ALL SELECT 'Dataset: conversations' AS source, md5(array_to_string(s[start + 1:start + 3], ' ')) AS text_md5 "
       f"FROM (SELECT s, unnest(range(0, len(s), 3)) AS start FROM (SELECT {tx.sentences_sql('text')} AS s FROM conversations WHERE role = 'user'))")
def a2_a3_collect_datasets(spark, sf):
    """A2 / A3: several configured datasets, each filtered (B1), chunked (C1) and word-limited
    (B2), labelled with its provenance and unioned by name."""
    seed = TB.collect_datasets(spark, sf, DATASETS)
    return seed.select("source", F.md5("text").alias("text_md5"))


VERSIONS = [{"name": "docs", "version": v, "split": s, "feature_col": "text"} for v, s in (("1.1", "train"), ("1.10", "test"), ("2", "train"), ("2", "absent"))]


@query("a2_versions", "SELECT 'Dataset: docs/' || CASE doc_id % 3 WHEN 0 THEN '1.1' WHEN 1 THEN '1.10' ELSE '2' END || '/' || "
       "CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS source, md5(text) AS text_md5 FROM documents "
       "WHERE (doc_id % 3 = 0 AND doc_id % 5 <> 0) OR (doc_id % 3 = 1 AND doc_id % 5 = 0) OR (doc_id % 3 = 2 AND doc_id % 5 <> 0)")
def a2_versions(spark, sf):
    """A2 / A3: datasets by version and split, pruned by folder; the split that does not exist is skipped."""
    base = f"{checkpoint_dir(spark)}/datasets-{uuid.uuid4().hex}"
    version = F.when(F.col("doc_id") % 3 == 0, "1.1").when(F.col("doc_id") % 3 == 1, "1.10").otherwise("2")
    docs = X.read(spark, sf, "documents").select("text", version.alias("version"), F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train").alias("split"))
    docs.write.partitionBy("version", "split").parquet(f"{base}/docs.parquet")
    return TB.collect_datasets(spark, base, VERSIONS).select("source", F.md5("text").alias("text_md5"))


@query("b1_filter_counts", "SELECT count(*) AS n_in, count(*) FILTER (WHERE lang = 'en') AS n_after_lang, "
       "count(*) FILTER (WHERE lang = 'en' AND source = 'src1') AS n_after_source FROM documents")
def b1_filter_counts(spark, sf):
    """B1: conjunctive equality filters with the row count before and after each, in one agg."""
    from tonegauge.operators.seed import filter_counts
    return filter_counts(X.read(spark, sf, "documents"), {"lang": "en", "source": "src1"})


@query("b2_b3_word_limits_first_n", f"SELECT doc_id FROM documents WHERE {tx.token_count_sql('text')} BETWEEN 50 AND 2048 ORDER BY doc_id LIMIT 100")
def b2_b3_word_limits_first_n(spark, sf):
    """B2 inclusive word limits, then B3 the first 100 rows by row id."""
    from tonegauge.operators.seed import first_n, word_limits
    return first_n(word_limits(X.read(spark, sf, "documents"), 50, 2048), 100, "doc_id").select("doc_id")


@query("b10_sign_split", W(X.sql_probe(), f"SELECT {', '.join(['original_index', 'rep'])}, CASE WHEN delta_{G1} * delta_{G2} > 0 THEN 'correlated' "
                          f"WHEN delta_{G1} * delta_{G2} < 0 THEN 'anti' END AS relation FROM probe WHERE delta_{G1} * delta_{G2} <> 0"))
def b10_sign_split(spark, sf):
    """Rows whose two requested deltas move together vs against each other."""
    from tonegauge.operators.seed import sign_split
    return sign_split(X.probe(spark, sf), G1, G2).select("original_index", "rep", "relation")


@query("b11_outlier_mask", W(X.sql_result() + M.metrics_ctes("result", G, "m"),
                             f"SELECT {KEY_SQL}, steering_error > (SELECT quantile_cont(steering_error, 0.975) FROM m) OR "
                             "steering_error < (SELECT quantile_cont(steering_error, 0.025) FROM m) AS outlier FROM m"))
def b11_outlier_mask(spark, sf):
    """Flag values outside the 2.5-97.5 percentile band (exact distributed percentiles)."""
    from tonegauge.operators.seed import outlier_mask
    m = M.with_metrics(X.result(spark, sf), G).select(*KEY, "steering_error")
    return outlier_mask(m, "steering_error").select(*KEY, "outlier")


@query("b12_b13_b16_projection", W(X.sql_result(), f"SELECT {KEY_SQL}, round(source_{G1}, 6) AS x_{G1}, round(source_{G2}, 6) AS x_{G2}, "
                                   f"round(target_{G1}, 6) AS target_x_{G1}, round(target_{G2}, 6) AS target_x_{G2}, 'run-1' AS llm, 'direct' AS chat_type FROM result"))
def b12_b13_b16_projection(spark, sf):
    """B16 2-goal axis projection, B12 prefix rename, B13 signature literals."""
    from tonegauge.schema import add_prefix
    targets = {f"target_{g}": f"target_x_{g}" for g in (G1, G2)}
    r = X.result(spark, sf).select(*KEY, *[F.col(f"source_{g}").alias(g) for g in (G1, G2)],
                                   *[F.col(t).alias(x) for t, x in targets.items()])
    r = add_prefix(r, "x_", exclude=(*KEY, *targets.values()))
    return rounded(r.withColumns({"llm": F.lit("run-1"), "chat_type": F.lit("direct")}))


_WRAPPED = "regexp_replace(text, '(?s)(.{100})', '\\1' || chr(10), 'g')"
_WRAP_SQL = (f"(CASE WHEN length(text) > 0 AND length(text) % 100 = 0 THEN left({_WRAPPED}, length({_WRAPPED}) - 1) ELSE {_WRAPPED} END)")


@query("b15_preview_top_k", W(X.sql_result() + M.metrics_ctes("result", G, "m"),
                              f"SELECT {KEY_SQL}, md5(substr({_WRAP_SQL}, 1, 5000) || CASE WHEN length(text) > 5000 THEN '...' ELSE '' END) AS preview_md5, md5({_WRAP_SQL}) AS whole_md5 "
                              f"FROM (SELECT * FROM m ORDER BY steering_error ASC NULLS LAST, {KEY_SQL} LIMIT 10)"))
def b15_preview_top_k(spark, sf):
    """B15 preview (wrap every 100 characters; whole, and cut at 5000) of the K4 top-10 rows."""
    from tonegauge.operators.best import top_k
    m = M.with_metrics(X.result(spark, sf), G)
    t = top_k(m, "steering_error", 10, KEY)
    return t.select(*KEY, F.md5(tx.wrap_truncate(F.col("text"), limit=5000)).alias("preview_md5"),
                    F.md5(tx.wrap_truncate(F.col("text"))).alias("whole_md5"))
