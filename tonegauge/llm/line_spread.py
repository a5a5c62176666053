"""Line dedup by distinct-site spread.

Each line (trimmed of spaces, not empty) gets a 64-bit hash.  One HyperLogLog sketch of sites per
hash, merged by the aggregation, estimates on how many sites the line stands.  Lines whose
estimate lies near the threshold get an exact distinct count.  A line on ``SITES`` sites or more
is boilerplate: it goes from every document but the first (smallest ``doc_id``) that holds it, so
nothing leaves the corpus altogether.

Defined results: null text stays null with no lines; blank lines stay; a null source is no site;
rows with equal ``doc_id`` are cleaned alike; rows with null ``doc_id`` are never the first holder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonegauge.llm.store import keep

SITES, LOG_K = 10, 12
#: three standard errors of a sketch with 2 ** LOG_K registers, at least one site
_NEAR = 3 * 1.04 / 2 ** (LOG_K / 2)


def spread_lines(docs: DataFrame, sites: int = SITES) -> tuple[DataFrame, DataFrame]:
    """(line, doc_id) rows of all lines, and (line, first) of the boilerplate; ``line`` is a hash."""
    lines = (docs.select("doc_id", "source", F.explode(F.split("text", "\n")).alias("x"))
             .select("doc_id", F.xxhash64("source").alias("site"), F.col("source").isNotNull().alias("known"), F.trim("x").alias("x"))
             .filter("x <> ''").select(F.xxhash64("x").alias("line"), "doc_id", F.when(F.col("known"), F.col("site")).alias("site")))
    lines = keep(lines, "lines")
    sketch = lines.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(LOG_K)).alias("s"), F.min("doc_id").alias("first"))
    margin = max(1.0, _NEAR * sites)
    spread = keep(sketch.select("line", "first", F.hll_sketch_estimate("s").alias("sites")).filter(F.col("sites") >= sites - margin), "spread")
    near = spread.filter(F.col("sites") <= sites + margin).select("line")
    exact = (lines.join(near, "line", "left_semi").filter("site is not null").groupBy("line", "site").agg(F.lit(1).alias("one"))
             .groupBy("line").agg(F.count("*").alias("exact")))
    wide = (spread.join(exact, "line", "left")
            .filter(F.coalesce("exact", F.when(F.col("sites") > sites + margin, F.col("sites")), F.lit(0)) >= sites).select("line", "first"))
    return lines, wide


def remove_spread_lines(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, and ``n_lines`` and ``n_removed`` added."""
    lines, wide = spread_lines(docs, sites)
    gone = (lines.join(wide, "line").filter(~F.col("doc_id").eqNullSafe(F.col("first"))).select("doc_id", "line").distinct()
            .groupBy("doc_id").agg(F.collect_list("line").alias("_gone")).withColumnRenamed("doc_id", "_id"))
    parts = F.split("text", "\n")
    left = F.filter(parts, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("_gone"), F.xxhash64(F.trim(x))))
    rows = docs.drop("n_lines", "n_removed").join(gone, F.col("doc_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    rows = rows.withColumn("_left", F.when(F.col("_gone").isNotNull(), left))
    n_lines = F.coalesce(F.size(parts), F.lit(0))
    return (rows.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(n_lines))
            .withColumn("n_removed", F.when(F.col("_gone").isNull() | F.col("text").isNull(), 0).otherwise(F.size(parts) - F.size("_left")))
            .withColumn("text", F.when(F.col("_gone").isNull() | F.col("text").isNull(), F.col("text")).otherwise(F.array_join("_left", "\n")))
            .drop("_gone", "_left"))
