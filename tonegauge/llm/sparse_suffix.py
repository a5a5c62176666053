"""Repeated passages by sparse suffix arrays.

A passage is ``LEAST`` or more words (``[^\x20\x09-\x0D]+``, A-Z lower-cased).  Of all suffixes only
those at content-selected positions are kept: in each run of ``LEAST`` words the position with the
smallest hash of ``KEY`` words (a minimiser), so two equal runs keep the same position.  Suffixes
whose first ``KEY`` words stand nowhere else go at once.  The rest are sorted by their words to the
right, and once more by their words to the left; neighbours are compared and their match extended
left and right.  Only as many words are carried on each side as make ``LEAST`` together with the
key, so a match cut short by that is long enough anyway.  Suffixes with no long match beside them,
in groups of three or more, are looked up by the hashes of all their ``LEAST``-word runs, so a
partner further away is not missed.  Overlapping matches of a document are joined to spans.

Every step is a shuffle by key hash; a passage in many documents gives as many rows as documents,
never pairs of them.

Defined results: null, empty and shorter texts have no spans; rows with equal ``doc_id`` are one
document; rows with null ``doc_id`` are left out; words are compared by hash (64 bits in the key,
32 in the extension).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonegauge.llm.arrowtext import U, chunks, mix, run_hashes, word_hashes
from tonegauge.llm.store import keep

LEAST, KEY = 50, 26
SIDE = LEAST - KEY  # words carried on each side; also the minimiser's window less one


def anchors(h: np.ndarray, wo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions of kept suffixes in the batch's words, their key hashes)."""
    keys = run_hashes(h, KEY)
    n = len(h) - LEAST + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U)
    at = np.arange(n) + np.lib.stride_tricks.sliding_window_view(keys, SIDE + 1)[:n].argmin(1)
    row_end = np.repeat(wo[1:], np.diff(wo))
    at = np.unique(at[np.arange(n) + LEAST <= row_end[:n]])
    return at, keys[at]


def kept_suffixes(docs: DataFrame) -> DataFrame:
    """(key, doc_id, pos): the sparse suffixes of all documents."""
    def run(batches):
        for batch in batches:
            for b in chunks(batch, "text"):
                h, wo = word_hashes(b.column("text"))
                at, key = anchors(h, wo)
                row = np.searchsorted(wo, at, side="right") - 1
                ids = b.column("doc_id").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[row].astype(np.int64)), pa.array((at - wo[row]).astype(np.int32))], ["key", "doc_id", "pos"])
    return docs.select("doc_id", "text").filter("doc_id is not null and text is not null").mapInArrow(run, "key long, doc_id long, pos int")


def shared_suffixes(docs: DataFrame) -> DataFrame:
    """(doc_id, at): positions of each document whose key stands at another place too."""
    same = Window.partitionBy("key")
    s = kept_suffixes(docs).select("doc_id", "pos", *[f("doc_id").over(same).alias(n) for f, n in ((F.min, "d0"), (F.max, "d1"))],
                                   *[f("pos").over(same).alias(n) for f, n in ((F.min, "p0"), (F.max, "p1"))])
    return s.filter("d0 < d1 or p0 < p1").groupBy("doc_id").agg(F.collect_set("pos").alias("at"))


def suffix_contexts(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """(key, doc_id, pos, left, right): shared suffixes with 4 bytes a word on each side, nearest first."""
    def run(batches):
        for batch in batches:
            for b in chunks(batch, "text"):
                h, wo = word_hashes(b.column("text"))
                keys = run_hashes(h, KEY)
                short = (h >> U(32)).astype(">u4")
                back = short[::-1]
                out = []
                for i, (doc, at) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("at").to_pylist())):
                    low, high = int(wo[i]), int(wo[i + 1])
                    for p in at:
                        a = low + p
                        if a + KEY > high:
                            continue  # another row of this id
                        left = back[len(h) - a: len(h) - max(low, a - SIDE)]
                        out.append((int(keys[a].view(np.int64)), doc, p, left.tobytes(), short[a + KEY: min(high, a + KEY + SIDE)].tobytes()))
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 5, kinds)], ["key", "doc_id", "pos", "left", "right"])
    rows = docs.select("doc_id", "text").filter("text is not null").join(shared, "doc_id")
    return rows.mapInArrow(run, "key long, doc_id long, pos int, left binary, right binary")


def _padded(column, fill: bytes) -> np.ndarray:
    size = 4 * SIDE
    raw = b"".join(x.ljust(size, fill) for x in column)
    return np.frombuffer(raw, "<u4").reshape(-1, SIDE)


def _lengths(column) -> np.ndarray:
    return np.array([len(x) // 4 for x in column], np.int64)


def _common(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Words that each two contexts have in common at their beginning."""
    same = (_padded(a, b"\0") == _padded(b, b"\0")).astype(np.int8)
    run = np.cumprod(same, axis=1).sum(1)
    return np.minimum(run, np.minimum(_lengths(a), _lengths(b)))


def neighbour_matches(contexts: DataFrame, order: tuple[str, str]) -> DataFrame:
    """(doc_id, pos, start, stop, other): long matches of neighbours in an order of the suffixes."""
    names = ["key", "doc_id", "pos", "left", "right"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]

    def run(batches):
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, doc, pos = (batch.column(i).to_numpy() for i in range(3))
            left, right = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            if last is not None:
                key, doc, pos = (np.append(x, y) for x, y in zip(last[:3], (key, doc, pos)))
                left, right = [last[3], *left], [last[4], *right]
            last = (key[-1], doc[-1], pos[-1], left[-1], right[-1])
            i = np.flatnonzero((key[1:] == key[:-1]) & ((doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1])))
            if not len(i):
                continue
            before = _common([left[j] for j in i], [left[j + 1] for j in i])
            after = _common([right[j] for j in i], [right[j + 1] for j in i])
            long = before + KEY + after >= LEAST
            i, before, after = i[long], before[long], after[long]
            for a, b in ((i, i + 1), (i + 1, i)):
                cols = [doc[a], pos[a], pos[a] - before, pos[a] + KEY + after, doc[b]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "pos", "start", "stop", "other"])

    return (contexts.repartition("key").sortWithinPartitions("key", *order, "doc_id", "pos").select(*names)
            .mapInArrow(run, "doc_id long, pos int, start int, stop int, other long"))


def _prefix_hashes(words: np.ndarray, seed: int) -> list[np.ndarray]:
    """Hashes of each row's first 0, 1, ... words."""
    out = [np.full(len(words), seed, U)]
    for j in range(words.shape[1]):
        out.append(mix(out[-1] ^ mix(words[:, j].astype(U))))
    return out


def distant_matches(contexts: DataFrame, found: DataFrame) -> DataFrame:
    """Runs of ``LEAST`` words around suffixes without a long match beside them, that stand elsewhere too."""
    alone = contexts.join(found.select("doc_id", "pos").distinct(), ["doc_id", "pos"], "left_anti").select("key").distinct()
    groups = contexts.join(alone, "key", "left_semi")
    groups = groups.join(groups.groupBy("key").count().filter("count > 2").select("key"), "key", "left_semi")

    def run(batches):
        for batch in batches:
            key, doc, pos = (batch.column(i).to_numpy() for i in range(3))
            sides = [batch.column(i).to_pylist() for i in (3, 4)]
            before, after = (_lengths(c) for c in sides)
            head, tail = (_prefix_hashes(_padded(c, b"\0"), seed) for c, seed in zip(sides, (1, 2)))
            for n in range(SIDE + 1):
                i = np.flatnonzero((before >= n) & (after >= SIDE - n))
                whole = mix(head[n][i] + U(3) * tail[SIDE - n][i]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key[i]), pa.array(np.full(len(i), n, np.int32)), pa.array(whole), pa.array(doc[i]), pa.array(pos[i])],
                                                 ["key", "n", "run", "doc_id", "pos"])

    runs = groups.select("key", "doc_id", "pos", "left", "right").mapInArrow(run, "key long, n int, run long, doc_id long, pos int")
    same = Window.partitionBy("key", "n", "run")
    runs = runs.select("doc_id", "pos", "n", *[f(c).over(same).alias(a) for f, c, a in ((F.min, "doc_id", "d0"), (F.max, "doc_id", "d1"), (F.min, "pos", "p0"), (F.max, "pos", "p1"))])
    start = F.col("pos") - F.col("n")
    return runs.filter("d0 < d1 or p0 < p1").select("doc_id", "pos", start.alias("start"), (start + LEAST).alias("stop"),
                                                    F.when(F.col("d0") != F.col("doc_id"), F.col("d0")).otherwise(F.col("d1")).alias("other"))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, start, n_words, other_doc_id): spans of words that repeat, and one document that has
    (part of) them too; the document itself if only it does."""
    shared = keep(shared_suffixes(docs), "shared")
    contexts = keep(suffix_contexts(docs, shared), "contexts")
    found = keep(neighbour_matches(contexts, ("right", "left")).unionByName(neighbour_matches(contexts, ("left", "right"))), "matches")
    every = found.unionByName(distant_matches(contexts, found)).groupBy("doc_id", "start", "stop").agg(F.min(F.when(F.col("other") != F.col("doc_id"), F.col("other"))).alias("other"))
    by_doc = Window.partitionBy("doc_id").orderBy("start", "stop")
    reach = F.max("stop").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    spans = every.withColumn("new", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int"))
    spans = spans.withColumn("span", F.sum("new").over(by_doc.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return (spans.groupBy("doc_id", "span").agg(F.min("start").cast("long").alias("start"), (F.max("stop") - F.min("start")).cast("long").alias("n_words"), F.min("other").alias("other"))
            .select("doc_id", "start", "n_words", F.coalesce("other", "doc_id").alias("other_doc_id")))
