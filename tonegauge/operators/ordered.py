"""Positions and ranks in a global order, without a window over the whole table.

A narrow copy of the order's columns is range-partitioned and sorted (Spark samples the borders, and
equal keys only share a partition if the whole key is equal), numbered inside its partitions and
written once.  Counts per partition, one row each, become offsets.  Nothing is gathered: the driver
sees no row, and the offsets are a table of at most one row per partition (and group).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonegauge.store import written_once

#: ``monotonically_increasing_id`` keeps the partition above these bits
_BITS = 33


def _numbered(keys: DataFrame, order: list[str], name: str) -> DataFrame:
    """``keys`` sorted across partitions, with ``_part`` and ``_row`` (place inside the partition)."""
    order = [*order, "_tie"] if "_tie" in keys.columns else order
    rows = keys.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    rows = rows.withColumns({"_part": F.shiftright("_at", _BITS), "_row": F.col("_at").bitwiseAND(F.lit((1 << _BITS) - 1))})
    return written_once(rows.drop("_tie", "_at"), name)


def _before(counts: DataFrame, within: list[str] | None = None) -> Column:
    """Sum of ``n`` of the partitions before, in each group; ``counts`` has one row per group and partition."""
    w = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    return F.coalesce(F.sum("n").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def positions(keys: DataFrame, order: list[str], name: str = "pos") -> DataFrame:
    """``keys`` with the 0-based place of each row in the global order of ``order``.

    Rows with equal order columns get different places, in no stated order.
    """
    rows = _numbered(keys, order, "positions")
    offsets = rows.groupBy("_part").agg(F.count("*").alias("n"))
    offsets = offsets.select("_part", _before(offsets).alias("_off"))
    # one row per partition: bounded by the number of partitions
    return rows.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_off") + F.col("_row")).drop("_part", "_row", "_off")


def _groups_equal(a: str, b: str, groups: list[str]) -> Column:
    cond = F.lit(True)
    for g in groups:
        cond = cond & F.col(f"{a}.{g}").eqNullSafe(F.col(f"{b}.{g}"))
    return cond


def group_quantiles(df: DataFrame, groups: list[str], value: str, probs: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Per group: n, mean, min, max, population std and exact quantiles (linear interpolation).

    The plan does not depend on the number of groups.  All values are sorted once by (group, value): a
    large group fills many partitions, small ones share one.  A group's values in one partition are
    consecutive, so the place of its k-th value is an offset per (group, partition), and a rank is read
    by an equi-join on that place.  Many equal values of one group spread over partitions by a hash.

    Result: the group columns, ``n``, ``mean``, ``min``, ``max``, ``std`` and ``q`` (array, one per entry of
    ``probs``).  Null groups are a group; null and NaN values count nowhere; groups without values are absent.
    """
    v = F.col(value).cast("double")
    rows = df.select(*groups, F.when(~F.isnan(v), v).alias("_v")).filter("_v is not null")
    rows = rows.withColumn("_tie", F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20)))
    rows = _numbered(rows, [*groups, "_v"], "sorted")
    # (group, partition): as many rows as groups and partitions together, as sorted groups are consecutive
    parts = written_once(rows.groupBy(*groups, "_part").agg(F.count("*").alias("n"), F.min("_row").alias("_first")), "segments")
    parts = parts.withColumn("_off", _before(parts, groups))
    whole = rows.groupBy(*groups).agg(F.count("*").alias("n"), F.avg("_v").alias("mean"), F.min("_v").alias("min"), F.max("_v").alias("max"),
                                      F.stddev_pop("_v").alias("std"))
    ranks = F.array(*[F.struct(F.lit(i).alias("i"), ((F.col("n") - 1) * F.lit(float(p))).alias("h")) for i, p in enumerate(probs)])
    wanted = whole.select(*groups, F.explode(ranks).alias("x")).select(*groups, "x.i", "x.h")
    wanted = wanted.withColumn("k", F.explode(F.array_distinct(F.array(F.floor("h"), F.ceil("h")))))
    found = wanted.alias("w").join(parts.alias("p"), _groups_equal("w", "p", groups) & (F.col("k") >= F.col("_off")) & (F.col("k") < F.col("_off") + F.col("p.n")))
    found = found.select(*[F.col(f"w.{g}").alias(f"_g_{g}") for g in groups], "i", "h", "k", "_part", (F.col("_first") + F.col("k") - F.col("_off")).alias("_row"))
    values = found.join(rows.select("_part", "_row", "_v"), ["_part", "_row"])
    lower, upper = F.min_by("_v", "k"), F.max_by("_v", "k")
    share = F.first("h") - F.floor(F.first("h"))
    # equal neighbours are not subtracted: infinities stay themselves
    q = F.when(lower == upper, lower).otherwise(lower + share * (upper - lower))
    quantile = values.groupBy(*[f"_g_{g}" for g in groups], "i").agg(q.alias("q"))
    quantile = quantile.groupBy(*[f"_g_{g}" for g in groups]).agg(F.array_sort(F.collect_list(F.struct("i", "q"))).alias("q"))
    same = F.lit(True)
    for g in groups:
        same = same & whole[g].eqNullSafe(quantile[f"_g_{g}"])
    out = whole.join(quantile, same)
    return out.select(*[whole[g] for g in groups], "n", "mean", "min", "max", "std", F.transform("q", lambda x: x["q"]).alias("q"))
