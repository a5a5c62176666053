"""Corpus pipeline: each stage reads what its predecessor wrote.

1. toxicity: documents that the classifier rejects go;
2. line dedup: boilerplate lines go from all documents but the first that holds them;
3. n-gram Jaccard join: one document of each group of near copies stays;
4. mixing: each source's documents are taken as often as the mix takes their words, to the nearest
   whole copy; empty documents carry no words and pass once;
5. packing: what is left is packed into token windows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonegauge.llm import line_spread, mixing, packing, partenum, toxicity
from tonegauge.llm.store import keep, small_batches

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold.

    Null and empty texts carry no evidence and stay (unless the labels make most documents toxic); rows with null or
    repeated ids are scored one by one; without labels of both classes, or without rows, nothing goes."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.score(_columns(docs), labels).filter("predicted = 0").select(*COLUMNS)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that stand on many sites.

    Null texts stay null and every row stays, repeated ones too; an emptied text stays as an empty one."""
    rows = line_spread.remove_spread_lines(_columns(docs))
    return rows.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one whose id names the group.

    Null and empty texts are groups of their own and stay; of rows that repeat an id one stays; rows with a null id
    belong to no group and stay."""
    docs = _columns(docs)
    groups = keep(partenum.jaccard_components(docs).select("doc_id", "component_id"), "components")
    left = docs.join(groups.filter("doc_id <> component_id").select("doc_id").distinct(), "doc_id", "left_anti")
    again = groups.filter("doc_id = component_id").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if not again.isEmpty():
        left = left.join(again, "doc_id", "left_anti").unionByName(left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return left.select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    Documents without words (null or empty texts) pass once; a document whose share rounds to no copy goes; rows that
    repeat id and text share their copies; a null source is a source."""
    docs = _columns(docs)
    taken = mixing.mix_sources(docs).groupBy("h").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    copies = taken.select("h", F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int").alias("copies")).filter("copies > 0")
    return (docs.withColumn("h", F.xxhash64("doc_id", "text")).join(copies, "h")
            .withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows.

    A null text counts as empty (its end token alone); every row is packed, repeated ones and those with null ids
    too; no rows give no pieces."""
    return packing.pack(_columns(docs), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_boilerplate), ("near_duplicates", near_duplicates), ("mixing", mix), ("packing", pack)]
#: Trained models and token ids are beyond SQL; tests/llm holds each stage against its operator on
#: the stage's own input, and the operators against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
