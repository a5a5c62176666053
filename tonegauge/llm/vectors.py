"""Blocks of vectors, joins of query blocks with all blocks, and running top-k lists."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: vectors in a block, and groups that the blocks of all rows are dealt to: a task compares one
#: query block with one group, block by block.
BLOCK, GROUPS = 2048, 16


def by_dimension(batch: pa.RecordBatch, ids: str = "vec_id", vectors: str = "embedding") -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of a batch's vectors of each length, without null ids, vectors or components
    and without components that are not finite."""
    column = batch.column(vectors)
    length = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.fill_null(pc.cast(column.flatten(), pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    start = np.append(0, np.cumsum(length))[:-1]
    known = pc.is_valid(batch.column(ids)).to_numpy(zero_copy_only=False)
    number = pc.fill_null(batch.column(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    for d in np.unique(length[known & (length > 0)]):
        rows = np.flatnonzero(known & (length == d))
        m = flat[start[rows][:, None] + np.arange(d)]
        good = np.isfinite(m).all(1)
        if good.any():
            yield number[rows[good]], m[good]


def blocks(rows: DataFrame, make: Callable[[np.ndarray, np.ndarray], dict | None], extra: str) -> DataFrame:
    """(dim, block, *extra): ``make(ids, matrix)`` gives the further columns of each block."""
    names = ["dim", "block", *[x.split()[0] for x in extra.split(", ")]]

    def run(batches):
        for batch in batches:
            for ids, m in by_dimension(batch):
                for i in range(0, len(ids), BLOCK):
                    out = make(ids[i: i + BLOCK], m[i: i + BLOCK])
                    if out:
                        yield pa.RecordBatch.from_pylist([{"dim": m.shape[1], "block": int(ids[i]), **out}]).select(names)

    return rows.select("vec_id", "embedding").mapInArrow(run, f"dim long, block long, {extra}")


def block_pairs(queries: DataFrame, every: DataFrame) -> DataFrame:
    """Each query block with each block of all rows, those of one query block and group in a row.

    Query blocks are dealt to every group, blocks of all rows to one; they meet by an equi-join.
    """
    q = queries.select("dim", F.explode(F.sequence(F.lit(0), F.lit(GROUPS - 1))).alias("g"), F.col("block").alias("q_block"),
                       *[F.col(c).alias(f"q_{c}") for c in queries.columns if c not in ("dim", "block")])
    c = every.withColumn("g", F.pmod(F.xxhash64("block"), F.lit(GROUPS)).cast("int"))
    return q.join(c, ["dim", "g"]).repartition("dim", "q_block", "g").sortWithinPartitions("dim", "q_block", "g", "block")


class Best:
    """The k best of each query so far; ``largest``: whether higher scores are better.

    A vector id counts once per query; ties go to the smaller id.
    """

    def __init__(self, n: int, k: int, largest: bool, kind=np.float64):
        self.n, self.k, self.sign = n, k, -1 if largest else 1
        self.q, self.ids, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kind)

    def add(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        q, ids, score = np.append(self.q, q), np.append(self.ids, ids), np.append(self.score, score)
        order = np.lexsort((self.sign * score, ids, q))
        q, ids, score = q[order], ids[order], score[order]
        once = np.append(True, (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])) if len(q) else np.zeros(0, bool)
        q, ids, score = q[once], ids[once], score[once]
        order = np.lexsort((ids, self.sign * score, q))
        q, ids, score = q[order], ids[order], score[order]
        first = np.searchsorted(q, np.arange(self.n))
        keep = np.arange(len(q)) - first[q] < self.k
        self.q, self.ids, self.score = q[keep], ids[keep], score[keep]

    def bound(self, nothing) -> np.ndarray:
        """Per query, the k-th best score, or ``nothing`` while there are fewer."""
        count = np.bincount(self.q, minlength=self.n)
        out = np.full(self.n, nothing, self.score.dtype)
        full = count >= self.k
        out[full] = self.score[np.cumsum(count)[full] - 1]
        return out

    def batch(self, query_ids: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(query_ids[self.q]), pa.array(self.ids), pa.array(self.score)], ["query_id", "vec_id", "score"])


def top(found: DataFrame, k: int, largest: bool) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of what the tasks found."""
    by = F.desc("score") if largest else F.asc("score")
    best = found.groupBy("query_id", "vec_id").agg((F.max if largest else F.min)("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(by, "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
