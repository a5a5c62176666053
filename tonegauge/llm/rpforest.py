"""Approximate nearest neighbours by a forest of random-projection trees.

The trees are fitted on a bounded sample (``SAMPLE`` vectors in hash order of their ids): each node
splits at the median of a projection on the difference of two sampled vectors, down to leaves of
``LEAF`` sampled vectors.  Every row is indexed: it is put into one leaf of each tree.  A query
walks all trees through one priority queue, nearest split planes first, until the leaves that it
has opened hold the share ``SEARCH`` of the sampled vectors.  The rows in these leaves are reranked
by exact Euclidean distance on the original vectors.

Defined results: vectors that are null, empty, zero or hold null or non-finite components and rows
with null ids take no part; only vectors of one length are compared; rows with one ``vec_id`` are
one candidate (the nearest of them) and one query; ties go to the smaller id.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonegauge.llm.vectors import Best, block_pairs, blocks, by_dimension, top

SAMPLE, TREES, LEAF, SEARCH = 4096, 32, 32, 0.65


class Forest:
    """Trees over vectors of one length, as arrays: planes, offsets, children and leaf numbers."""

    def __init__(self, sample: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = 7):
        self.trees, self.leaves, self.held, self.size = [], [], [], len(sample)
        random = np.random.default_rng(seed)
        for _ in range(trees):
            nodes: list = []
            held: list[np.ndarray] = []

            def grow(rows: np.ndarray) -> int:
                me = len(nodes)
                nodes.append(None)
                if len(rows) > leaf:
                    a, b = sample[random.choice(rows, 2, replace=False)]
                    w = a - b
                    p = sample[rows] @ w
                    t = float(np.median(p))
                    if (p <= t).all() or (p > t).all():  # copies: no plane parts them
                        t = None
                    if t is not None:
                        nodes[me] = (w / np.linalg.norm(w), t / np.linalg.norm(w), grow(rows[p <= t]), grow(rows[p > t]))
                        return me
                nodes[me] = len(held)
                held.append(rows)
                return me

            grow(np.arange(len(sample)))
            self.trees.append(nodes)
            self.held.append(held)

    def assign(self, m: np.ndarray) -> np.ndarray:
        """(trees x rows) leaf numbers."""
        out = np.zeros((len(self.trees), len(m)), np.int32)
        for nodes, leaf in zip(self.trees, out):
            todo = [(0, np.arange(len(m)))]
            while todo:
                n, rows = todo.pop()
                if isinstance(nodes[n], tuple):
                    w, t, low, high = nodes[n]
                    p = m[rows] @ w <= t
                    todo += [(low, rows[p]), (high, rows[~p])]
                else:
                    leaf[rows] = nodes[n]
        return out

    def opened(self, q: np.ndarray, search: float) -> list[tuple[int, int]]:
        """(tree, leaf) that a query opens."""
        queue = [(0.0, t, 0) for t in range(len(self.trees))]
        seen, out = np.zeros(self.size, bool), []
        while queue and (not out or seen.sum() < search * self.size):
            far, t, n = heapq.heappop(queue)
            node = self.trees[t][n]
            while isinstance(node, tuple):
                w, at, low, high = node
                side = float(q @ w) - at
                near, other = (low, high) if side <= 0 else (high, low)
                heapq.heappush(queue, (max(far, abs(side)), t, other))
                node = self.trees[t][near]
            out.append((t, node))
            seen[self.held[t][node]] = True
        return out


def fit(vectors: DataFrame, sample: int = SAMPLE) -> dict[int, Forest]:
    """A forest for each length of vector, from a sample bounded over all of them."""
    some = vectors.select("vec_id", "embedding").filter("vec_id is not null and embedding is not null")
    rows = some.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    by: dict[int, list[np.ndarray]] = {}
    for batch in rows.to_batches():
        for _, m in by_dimension(batch):
            by.setdefault(m.shape[1], []).append(m[m.any(1)])
    return {d: Forest(np.concatenate(m)) for d, m in by.items() if sum(map(len, m))}


def nearest(vectors: DataFrame, is_query, k: int, search: float = SEARCH) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found; ``is_query`` is a condition."""
    forests = vectors.sparkSession.sparkContext.broadcast(fit(vectors))

    def part(ids, m):
        full = m.any(1)
        return ids[full], m[full], forests.value.get(m.shape[1])

    def index(ids, m):
        ids, m, forest = part(ids, m)
        if not len(ids):
            return None
        leaves = forest.assign(m) if forest else np.zeros((1, len(ids)), np.int32)
        return {"ids": ids.tobytes(), "m": m.tobytes(), "leaves": leaves.tobytes()}

    def ask(ids, m):
        ids, m, forest = part(ids, m)
        if not len(ids):
            return None
        most = max(len(h) for h in forest.held) if forest else 1
        open_ = np.zeros((len(ids), len(forest.trees) if forest else 1, most), bool)
        for i, q in enumerate(m):
            for t, leaf in forest.opened(q, search) if forest else [(0, 0)]:
                open_[i, t, leaf] = True
        return {"ids": ids.tobytes(), "m": m.tobytes(), "open": open_.tobytes(), "most": most}

    pairs = block_pairs(blocks(vectors.filter(is_query), ask, "ids binary, m binary, open binary, most long"),
                        blocks(vectors, index, "ids binary, m binary, leaves binary"))

    def run(batches):
        now = best = q = q_ids = open_ = None
        for batch in batches:
            for r in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                key = (r["dim"], r["q_block"], r["g"], r["q_ids"])
                if key != now:
                    if best is not None:
                        yield best.batch(q_ids)
                    now = key
                    q_ids = np.frombuffer(r["q_ids"], np.int64)
                    q = np.frombuffer(r["q_m"], np.float64).reshape(-1, r["dim"])
                    open_ = np.frombuffer(r["q_open"], bool).reshape(len(q_ids), -1, r["q_most"])
                    best = Best(len(q_ids), k, False)
                ids = np.frombuffer(r["ids"], np.int64)
                m = np.frombuffer(r["m"], np.float64).reshape(-1, r["dim"])
                leaves = np.frombuffer(r["leaves"], np.int32).reshape(-1, len(ids))
                trees = np.arange(len(leaves))[:, None]
                for i in range(len(q)):
                    rows = np.flatnonzero(open_[i][trees, leaves].any(0) & (ids != q_ids[i]))
                    if len(rows):
                        d = np.sqrt(((m[rows] - q[i]) ** 2).sum(1))
                        if len(rows) > 8 * k:  # all that tie with the k-th of different ids stay
                            d_once = np.sort(d[np.unique(ids[rows], return_index=True)[1]])
                            near = d <= d_once[min(k, len(d_once)) - 1]
                            rows, d = rows[near], d[near]
                        best.add(np.full(len(rows), i), ids[rows], d)
        if best is not None:
            yield best.batch(q_ids)

    return top(pairs.mapInArrow(run, "query_id long, vec_id long, score double"), k, False)
