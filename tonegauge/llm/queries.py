"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonegauge.llm import (
    branch_bound,
    line_spread,
    mixing,
    packing,
    partenum,
    periodic_runs,
    rpforest,
    secret_grammar,
    sparse_suffix,
    style_tree,
    toxicity,
    warc_store,
    whitening,
)
from tonegauge.llm.store import small_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_query
def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return branch_bound.top_inner_products(_table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", 20)


@_query
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@_query
def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style_tree.main_texts(_table(spark, sf_dir, "pages"))


@_query
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_grammar.scan(_table(spark, sf_dir, "documents"))


@_query
def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.jaccard_components(_table(spark, sf_dir, "documents"))


@_query
def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rpforest.nearest(_table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0", 10)


@_query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_spread.remove_spread_lines(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"),
                       F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


ORACLE["op9_line_dedup"] = f"""
WITH lines AS (
  SELECT doc_id, source, trim(x) AS line
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS x FROM documents) WHERE trim(x) <> ''),
wide AS (
  SELECT line, min(doc_id) AS first FROM lines GROUP BY line HAVING count(DISTINCT source) >= {line_spread.SITES}),
gone AS (
  SELECT doc_id, list(DISTINCT line) AS drops FROM lines JOIN wide USING (line) WHERE doc_id <> first GROUP BY doc_id),
cut AS (
  SELECT doc_id, string_split(text, chr(10)) AS parts,
         [x for x in string_split(text, chr(10)) if trim(x) = '' OR NOT list_contains(coalesce(drops, []), trim(x))] AS kept
  FROM documents LEFT JOIN gone USING (doc_id))
SELECT doc_id, CAST(len(parts) AS BIGINT) AS n_lines, CAST(len(parts) - len(kept) AS BIGINT) AS n_removed,
       CAST(length(array_to_string(kept, chr(10))) AS BIGINT) AS n_chars, md5(array_to_string(kept, chr(10))) AS text_md5
FROM cut
"""


@_query
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse_suffix.repeated_passages(_table(spark, sf_dir, "documents"))


@_query
def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_store.archived(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE["op11_warc"] = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest, max(page_id) OVER (PARTITION BY body) AS first FROM p),
r AS (SELECT *, payload_bytes >= {warc_store.SMALL} AND first IS NOT NULL AND page_id IS DISTINCT FROM first AS again FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN first END AS refers_to
FROM r
"""


@_query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(_table(spark, sf_dir, "embeddings"))


@_query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic_runs(_table(spark, sf_dir, "documents"))


#: Integer products of floored components, exact in DuckDB too (vectors of one length in the tables).
ORACLE["op3_exact_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.w, c.w) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.w) = len(c.w)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""

ORACLE["op7_ngram_jaccard_join"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i+4], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a)
SELECT doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(reach.b) AS component_id
FROM documents LEFT JOIN n USING (doc_id) JOIN reach ON reach.a = doc_id GROUP BY doc_id
"""
