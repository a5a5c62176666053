"""Summaries of many judged runs at once, with their run metadata.

``summarize_runs`` is H11 for any number of runs in one plan: the verdict counts are one aggregate, the metrics
become rows of (run, metric, value), and the order statistics of all groups come from one sort (see
:func:`ordered.group_quantiles`).  ``convert_runs`` adds what a legacy run's configuration says, and
``append_documents`` writes the summary document of every run that a folder does not hold yet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonegauge.operators import metrics as M
from tonegauge.operators.ordered import group_quantiles
from tonegauge.sources import tables as TB
from tonegauge.store import written_once

COUNTS = ["n_total", "n_grounded", "n_flagged", "n_overruled"]
STATS = ["mean", "median", "min", "max", "std", "q1", "q3", "iqr"]
#: a legacy configuration, one row a run
CONFIG = ("run string, llm_settings struct<llm_name:string>, prompt_strategy string, inst_addons struct<disambig:boolean>, probe string")


def quartiles(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """The H10 fields of ``value`` per group, exact."""
    q = group_quantiles(df, groups, value, (0.25, 0.5, 0.75))
    fields = {"q1": F.col("q")[0], "median": F.col("q")[1], "q3": F.col("q")[2], "iqr": F.col("q")[2] - F.col("q")[0]}
    return q.select(*groups, *[fields.get(c, F.col(c)).alias(c) for c in STATS], "n")


def long_metrics(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, metric, v): one row per row and metric."""
    return df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("v")) for c in columns])).alias("x")).select(*keys, "x.metric", "x.v")


def summarize_runs(judged: DataFrame, goals: list[str], run: str = "run") -> DataFrame:
    """H11 per run: one row per run and metric with the H10 fields of its grounded rows and its counts.

    A run without grounded rows keeps its counts, with null statistics and ``n`` 0.
    """
    rows = written_once(M.with_metrics(judged.withColumn("_g", M.grounded()), goals).select(
        F.col(run).alias("run"), "_g", *M.METRICS, F.col("answer").eqNullSafe(F.lit("No")).alias("_no"),
        (~F.coalesce("rationale_approved", F.lit(True))).alias("_over")), "run-metrics")
    counts = rows.groupBy("run").agg(F.count("*").alias("n_total"), F.count_if("_g").alias("n_grounded"), F.count_if("_no").alias("n_flagged"),
                                     F.count_if("_over").alias("n_overruled"))
    counts = counts.select(F.col("run").alias("_run"), F.explode(F.array(*[F.lit(m) for m in M.METRICS])).alias("_metric"), *COUNTS)
    stats = quartiles(long_metrics(rows.filter("_g"), ["run"], M.METRICS), ["run", "metric"], "v")
    same = F.col("_run").eqNullSafe(F.col("run")) & (F.col("_metric") == F.col("metric"))
    return counts.join(stats, same, "left").select(F.col("_run").alias("run"), F.col("_metric").alias("metric"), *STATS, F.coalesce("n", F.lit(0)).alias("n"), *COUNTS)


def run_info(judge: str | None, negprompt: Column | None = None) -> dict[str, Column]:
    """The metadata columns of a run from its configuration columns (``inst_addons.disambig`` is the negative prompt)."""
    out = {"model_id": F.col("llm_settings.llm_name"), "prompt_strategy": F.col("prompt_strategy"),
           "negprompt": F.coalesce(F.col("inst_addons.disambig"), F.lit(False)) if negprompt is None else negprompt, "probe_path": F.col("probe")}
    return out | ({} if judge is None else {"judge": F.lit(judge)})


def convert_runs(judged: DataFrame, configs: DataFrame, goals: list[str], judge: str | None, run: str = "run") -> DataFrame:
    """The summaries of legacy runs under their renamed configurations, marked ``legacy_converted``.

    Each run needs one configuration; a run without one fails the job, two of one run do as well.
    """
    info = configs.select(F.col("run").alias("_run"), *[c.alias(k) for k, c in run_info(judge).items()])
    once = info.groupBy("_run").agg(*[F.first(c).alias(c) for c in info.columns if c != "_run"], F.count("*").alias("_n"))
    rows = summarize_runs(judged, goals, run).join(once, F.col("run") == F.col("_run"), "left")
    fault = F.when(F.col("_n").isNull(), F.raise_error("a run has no configuration")).when(F.col("_n") > 1, F.raise_error("a run has two configurations"))
    return rows.withColumn("legacy_converted", F.coalesce(fault.cast("boolean"), F.lit(True))).drop("_run", "_n")


def documents(summary: DataFrame) -> DataFrame:
    """(run, document): the summary document of each run: ``steerability`` by metric, ``data`` and ``run``."""
    info = [c for c in summary.columns if c not in ("run", "metric", "n", *STATS, *COUNTS)]
    stats = F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", F.struct(*STATS)))))
    doc = summary.groupBy("run").agg(stats.alias("steerability"), F.struct(*[F.first(c).alias(c) for c in COUNTS]).alias("data"),
                                     F.struct(*[F.first(c).alias(c) for c in info]).alias("info"))
    return doc.select("run", F.to_json(F.struct("steerability", "data", F.col("info").alias("run"))).alias("document"))


def append_documents(summary: DataFrame, folder: str) -> int:
    """Writes the documents of the runs that ``folder`` lacks; returns how many.  Runs already there are left alone."""
    spark = summary.sparkSession
    docs = documents(summary)
    if TB.written(spark, folder):
        known = spark.read.schema("run string, document string").json(folder).select("run")
        docs = docs.join(known, "run", "left_anti")
    docs = written_once(docs, "documents")
    n = docs.count()
    if n:
        docs.write.mode("append").json(folder)
    return n
