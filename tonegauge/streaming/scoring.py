"""Structured Streaming forms of the scoring service.

S1: texts arriving as files are scored and normalised with the same stateless Columns as the
batch path (D5 + E2) and appended to a Parquet sink; the checkpoint makes the query restartable
after executor or driver loss (exactly-once file sink).
S2: "skip texts already scored".  Two forms:

* a cache table is the state (``dedup_stream``): each micro-batch keeps its distinct text keys, anti-joins them
  with the cache, scores only the misses and appends them.  The cache is laid out by the key's first two
  digits, so a batch reads only the folders its keys fall into.  Every text is scored once, however late it comes and
  however often the query starts again; a null text is a text of its own (key null);
* keyed state with event time (``drop_repeats``): repeats within the watermark's delay go and the state
  is forgotten behind it, so rows later than the delay are dropped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonegauge.keys import text_key
from tonegauge.operators.goalspace import map_goals, score_endpoint
from tonegauge.session import checkpoint_dir
from tonegauge.sources.tables import written
from tonegauge.store import written_once

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def _table_stream(spark: SparkSession, schema: T.StructType, folder: str, pattern: str, files_per_trigger: int | None) -> DataFrame:
    """The tables of ``folder`` that match ``pattern``, each one file or a folder of part files.

    A trigger takes as many files as the cluster has slots unless told otherwise, so that a table of many parts
    does not come one task at a time."""
    # a name without wildcards becomes a pattern too: a source path that is one file is taken only as a pattern
    names = pattern if any(c in pattern for c in "*?[{") else f"{pattern[:-1]}[{pattern[-1]}]"
    files = files_per_trigger or spark.sparkContext.defaultParallelism
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/{names}")


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """A file source of events, ``ts`` as a timestamp."""
    return _table_stream(spark, EVENTS, folder, "events.parquet", files_per_trigger).withColumn("ts", F.col("ts").cast("timestamp"))


def text_stream(spark: SparkSession, folder: str, pattern: str = "documents.parquet", files_per_trigger: int | None = None) -> DataFrame:
    """A file source of text rows (explicit schema; new files are picked up as they land)."""
    return _table_stream(spark, DOCUMENTS, folder, pattern, files_per_trigger)


def _work_dir(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def score_stream(spark: SparkSession, stream: DataFrame, goals: list[str], ranges: dict, out_dir: str | None = None) -> DataFrame:
    """Run the scoring stream until the available input is drained (``availableNow``) and
    return the sink as a batch table."""
    out_dir = out_dir or _work_dir(spark, "s1-out")
    scored = score_endpoint(stream, goals, ranges).select("doc_id", *[f"output_{g}" for g in goals])
    q = (scored.writeStream.format("parquet").option("path", out_dir)
         .option("checkpointLocation", out_dir + "-ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(scored.schema).parquet(out_dir)


#: digits of the key that name a folder of the cache, and the folder of the null text
PREFIX, NO_KEY = 2, "none"


def _folder(key: str = "text_key"):
    return F.coalesce(F.substring(key, 1, PREFIX), F.lit(NO_KEY))


def read_cache(spark: SparkSession, cache_dir: str, goals: list[str], folders: list[str] | None = None) -> DataFrame:
    """The score cache, or its part in ``folders`` (pruned at the scan)."""
    schema = T.StructType([T.StructField("text_key", T.StringType()), *[T.StructField(g, T.DoubleType()) for g in goals], T.StructField("folder", T.StringType())])
    if not written(spark, cache_dir):
        return spark.createDataFrame([], schema)
    cache = spark.read.schema(schema).parquet(cache_dir)
    return cache if folders is None else cache.filter(F.col("folder").isin(folders))


def score_misses(batch: DataFrame, cache_dir: str, goals: list[str]) -> None:
    """Scores the texts of ``batch`` that the cache lacks and appends them.

    A batch that is run again after a failure finds what it had appended before."""
    spark = batch.sparkSession
    keyed = batch.select(text_key(F.col("text")).alias("text_key"), "text").dropDuplicates(["text_key"])
    keyed = written_once(keyed.withColumn("folder", _folder()), "batch")
    folders = [r.folder for r in keyed.select("folder").distinct().collect()]  # at most 16 ** PREFIX + 1
    cache = read_cache(spark, cache_dir, goals, folders).select("folder", F.col("text_key").alias("_known"))
    new = keyed.join(cache, (keyed["folder"] == cache["folder"]) & keyed["text_key"].eqNullSafe(F.col("_known")), "left_anti")
    map_goals(new, goals).select("text_key", *goals, "folder").write.mode("append").partitionBy("folder").parquet(cache_dir)


def dedup_stream(spark: SparkSession, stream: DataFrame, goals: list[str], cache_dir: str | None = None) -> DataFrame:
    """Score each distinct text once across micro-batches and starts; returns the cache (``text_key`` and raw goals)."""
    cache_dir = cache_dir or _work_dir(spark, "s2-cache")
    q = (stream.writeStream.foreachBatch(lambda batch, _: score_misses(batch, cache_dir, goals)).option("checkpointLocation", cache_dir + "-ckpt")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return read_cache(spark, cache_dir, goals).select("text_key", *goals)


def drop_repeats(spark: SparkSession, stream: DataFrame, keys: list[str], time_col: str, delay: str, out_dir: str | None = None) -> DataFrame:
    """Rows whose ``keys`` came within ``delay`` of event time before are dropped, by state that the watermark bounds;
    returns the sink as a batch table.  Null keys are keys like any other."""
    out_dir = out_dir or _work_dir(spark, "s2-recent")
    once = stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(keys)
    q = (once.writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", out_dir + "-ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(once.schema).parquet(out_dir)
