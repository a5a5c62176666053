"""Exact top-k by integer inner product with columnar branch-and-bound.

Each component ``x`` becomes ``floor(64 * x)``.  Blocks hold vectors by dimension (one row of a
block is one dimension of all its vectors).  Scores are accumulated one block of dimensions at a
time; a candidate goes when its partial score and the largest rest (product of the two vectors'
remaining norms) stay below the query's k-th best score so far.  Once few candidates are alive they
are compacted and only they go on.

Defined results: vectors that are null, empty or hold null or non-finite components and rows with
null ids take no part; only vectors of one length are compared; rows with one ``vec_id`` are one
candidate (the best of them) and one query; ties go to the smaller id.  Products beyond 64 bits
wrap.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tonegauge.llm.vectors import Best, block_pairs, blocks, top

SCALE, STEP = 64, 16
#: share of alive candidates under which they are compacted
COMPACT = 0.3


def _integers(m: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * m).clip(-(2.0**62), 2.0**62).astype(np.int64)


def _make(ids: np.ndarray, m: np.ndarray) -> dict:
    v = _integers(m)
    kind = np.int16 if np.abs(v).max(initial=0) < 1 << 15 else np.int64
    return {"ids": ids.tobytes(), "columns": np.ascontiguousarray(v.T.astype(kind)).tobytes(), "bytes": np.dtype(kind).itemsize}


def _load(columns: bytes, size: int, dim: int) -> np.ndarray:
    return np.frombuffer(columns, np.int16 if size == 2 else np.int64).reshape(dim, -1)


def _rest(v: np.ndarray) -> np.ndarray:
    """Norm of what each vector has left at the start of each block of dimensions."""
    square = v.astype(np.float64) ** 2
    return np.sqrt(np.stack([square[i:].sum(0) for i in range(0, len(v) + STEP, STEP)]))


def search_block(best: Best, q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray) -> None:
    """Adds one block's candidates; ``q`` and ``c`` hold one dimension a row."""
    dim = len(q)
    small = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * dim < 2**53
    kind = np.float64 if small else np.int64  # either is exact
    q, c = q.astype(kind), c.astype(kind)
    q_rest, c_rest = _rest(q), _rest(c)
    bound = best.bound(np.iinfo(np.int64).min).astype(np.float64)
    alive = q_ids[:, None] != c_ids[None, :]
    score = np.zeros(alive.shape, kind)
    qi = ci = part = None
    for i, at in enumerate(range(0, dim, STEP), 1):
        end = min(at + STEP, dim)
        if qi is None:
            score += q[at:end].T @ c[at:end]
            alive &= score + q_rest[i][:, None] * c_rest[i][None, :] * (1 + 1e-9) + 1e-6 >= bound[:, None]
            if end < dim and alive.mean() < COMPACT:
                qi, ci = np.nonzero(alive)
                part = score[qi, ci]
        else:
            for d in range(at, end):
                part = part + q[d, qi] * c[d, ci]
            left = part + q_rest[i][qi] * c_rest[i][ci] * (1 + 1e-9) + 1e-6 >= bound[qi]
            qi, ci, part = qi[left], ci[left], part[left]
    if qi is None:
        qi, ci = np.nonzero(alive)
        part = score[qi, ci]
    if len(qi) > 4 * best.k * best.n:  # few bounds yet: each query's own best suffice
        order = np.lexsort((c_ids[ci], -part, qi))
        qi, ci, part = qi[order], ci[order], part[order]
        first = np.searchsorted(qi, np.arange(best.n))
        # repeated ids may hold several of the best places
        most = best.k * max(1, int(np.unique(c_ids, return_counts=True)[1].max()))
        keep = np.arange(len(qi)) - first[qi] < most
        qi, ci, part = qi[keep], ci[keep], part[keep]
    best.add(qi, c_ids[ci], part.astype(np.int64))


def top_inner_products(vectors: DataFrame, is_query, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best of all other rows; ``is_query`` is a condition."""
    columns = "ids binary, columns binary, bytes long"
    pairs = block_pairs(blocks(vectors.filter(is_query), _make, columns), blocks(vectors, _make, columns))

    def run(batches):
        now = best = q = q_ids = None
        for batch in batches:
            for r in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                key = (r["dim"], r["q_block"], r["g"], r["q_ids"])
                if key != now:
                    if best is not None:
                        yield best.batch(q_ids)
                    now = key
                    q_ids = np.frombuffer(r["q_ids"], np.int64)
                    q = _load(r["q_columns"], r["q_bytes"], r["dim"])
                    best = Best(len(q_ids), k, True, np.int64)
                search_block(best, q, q_ids, _load(r["columns"], r["bytes"], r["dim"]), np.frombuffer(r["ids"], np.int64))
        if best is not None:
            yield best.batch(q_ids)

    return top(pairs.mapInArrow(run, "query_id long, vec_id long, score long"), k, True)
