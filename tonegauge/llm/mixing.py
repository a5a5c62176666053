"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Sizes are words ``[^\x20\x09-\x0D]+``.  Targets are filled like water: ``SHARE`` of all words dealt
by weight, no source above ``MOST`` times its own size.  Slot ``i`` of the schedule takes the
golden-ratio point ``frac(i * phi)`` to the source in whose part of the cumulative targets it
falls; slots are ranked per source, and rank ``r`` is the source's block ``r`` modulo its blocks.
A source's blocks are ``BLOCK`` words each of its documents in hash order, so a second round
repeats them.  Slots beyond a source's target are left out, and what the points leave a source
short is scheduled at the end, so each source takes its target to the word.

Ranks and word positions are found from counts per chunk or hash bucket and an order within it, so
a source with a third of the rows is never in one task.  Only one row per source meets in a task.

Defined results: null or blank text has size 0 and takes none; a null source is a source of its
own; rows with equal ``doc_id`` are documents of their own, and of equal rows it doesn't matter
which one a word comes from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonegauge.llm.arrowtext import chunks, tidy, word_counts
from tonegauge.llm.store import keep

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
BLOCK, CHUNK, BUCKETS, CELLS = 1024, 1 << 16, 4096, 1 << 12


def document_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, h) of every row; ``h`` is a hash of id and text."""
    def run(batches):
        for batch in batches:
            for b in chunks(batch, "text"):
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(word_counts(b.column("text"))), b.column("h")],
                                                 ["doc_id", "source", "size", "h"])
    return (docs.select("doc_id", "source", "text", F.xxhash64("doc_id", "text").alias("h"))
            .mapInArrow(tidy(run), "doc_id long, source string, size long, h long"))


def source_targets(sizes: DataFrame) -> DataFrame:
    """(sid, source, source_size, target): one row per source; ``sid`` numbers them in code point order."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.orderBy(F.asc_nulls_last("source"))
    s = s.withColumn("sid", F.row_number().over(everything) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("sid") % len(WEIGHTS) + 1).cast("int")).cast("double"))
    s = s.withColumn("cap", (F.col("source_size") * MOST).cast("double"))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    from_here = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(0))
    s = s.withColumn("level", (F.sum("source_size").over(whole) * SHARE - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(from_here))
    # the water level: the first one that its own source does not reach the cap at
    s = s.withColumn("water", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "sid", "level"))).over(whole))
    level = F.coalesce(F.col("water.level"), F.lit(float("inf")))
    return s.select("sid", "source", "source_size", F.least("cap", level * F.col("weight")).alias("target"))


def _ranked(rows: DataFrame, part: str, order: list, size, out: str) -> DataFrame:
    """``out``: the sum of ``size`` over the rows before each one, by source and then ``part``, ``order``."""
    sums = rows.groupBy("sid", part).agg(F.sum(size).alias("_s"))
    sums = sums.withColumn("_b", F.coalesce(F.sum("_s").over(Window.partitionBy("sid").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    own = Window.partitionBy("sid", part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (rows.join(sums, ["sid", part]).withColumn(out, F.col("_b") + F.coalesce(F.sum(size).over(own), F.lit(0))).drop("_b"))


def schedule(targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, sid, rank, block, words): the mix in order; ``block`` numbers the source's own blocks.

    ``words`` is how many words of the block's beginning are taken: all, but in a source's last slot.
    """
    spark = targets.sparkSession
    t = (targets.withColumn("quota", F.floor(F.col("target") + 0.5).cast("long"))
         .withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long")).filter("quota > 0"))
    rest = F.col("quota") % F.col("source_size")
    t = t.withColumn("slots", F.expr("quota div source_size") * F.col("blocks") + F.ceil(rest / block).cast("long"))
    upto = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumn("hi", F.sum("slots").over(upto)).withColumn("lo", F.col("hi") - F.col("slots"))
    t = keep(t.select("sid", "source_size", "quota", "blocks", "slots", "lo", "hi"), "targets")
    total = t.agg(F.max("hi")).first()[0] or 0

    def points(batches):
        for batch in batches:
            i = batch.column("id").to_numpy()
            p = (i.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)  # 2 ** 64 / phi
            x = (p >> np.uint64(11)).astype(np.float64) / 2.0 ** 53
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(x * total)], ["slot", "x"])

    cell = max(1, -(-total // CELLS))
    slots = spark.range(total).mapInArrow(points, "slot long, x double").withColumn("cell", F.floor(F.col("x") / cell).cast("long"))
    places = t.withColumn("cell", F.explode(F.sequence(F.expr(f"lo div {cell}"), F.expr(f"(hi - 1) div {cell}"))))
    hit = (slots.join(places.select("cell", "sid", "lo", "hi"), "cell").filter("x >= lo and x < hi")
           .select("slot", "sid", F.expr(f"slot div {CHUNK}").alias("chunk"), F.lit(1).alias("one")))
    hit = _ranked(hit, "chunk", ["slot"], F.col("one"), "rank").select("slot", "sid", "rank")
    drawn = hit.groupBy("sid").agg(F.count("*").alias("drawn"))
    late = (t.join(drawn, "sid", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0))).filter("drawn < slots")
            .select("sid", F.explode(F.sequence(F.col("drawn"), F.col("slots") - 1)).alias("rank")))
    late = late.select((F.lit(total) + F.col("rank")).alias("slot"), "sid", F.col("rank").cast("long"))
    every = hit.unionByName(late).join(t, "sid").filter("rank < slots")
    every = every.withColumn("block", F.col("rank") % F.col("blocks"))
    taken = F.expr("(rank div blocks) * source_size") + F.col("block") * block
    left = F.least(F.lit(block), F.col("source_size") - F.col("block") * block, F.col("quota") - taken)
    return every.select("slot", "sid", "rank", "block", left.cast("long").alias("words"))


def mix_sources(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source, h) of every document; reads doc_id, text and source."""
    sizes = keep(document_sizes(docs), "sizes")
    targets = keep(source_targets(sizes), "sources")
    rows = sizes.join(targets, sizes.source.eqNullSafe(targets.source)).drop(targets.source)
    none = rows.filter("size = 0").select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), "source", "h")
    some = rows.filter("size > 0").withColumn("bucket", F.shiftrightunsigned("h", 52))
    some = _ranked(some, "bucket", ["h", "doc_id", "size"], F.col("size"), "at")
    some = some.withColumn("block", F.explode(F.sequence(F.expr(f"at div {block}"), F.expr(f"(at + size - 1) div {block}"))))
    slots = schedule(targets, block).select("sid", "block", "words")
    begin, end = F.greatest(F.col("at"), F.col("block") * block), F.least(F.col("at") + F.col("size"), F.col("block") * block + F.coalesce("words", F.lit(0)))
    some = some.join(slots, ["sid", "block"], "left").withColumn("part", F.greatest(F.lit(0), end - begin))
    some = some.groupBy("sid", "at", "doc_id", "size", "source_size", "target", "source", "h").agg(F.sum("part").alias("taken"))
    return some.select(*none.columns).unionByName(none)
