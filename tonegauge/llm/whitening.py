"""Embedding whitening from a bit-sliced scatter.

Each component ``c`` becomes the integer ``floor(256 * c)``.  The fit list holds every distinct integer
vector once.  Blocks of the fit list are laid out by dimension, shifted to start at 0 and cut into bit
planes: 64 rows of one plane are one word.  The product sum of two dimensions is then the sum of
``2 ** (a + b) * popcount(plane a AND plane b)``, in whole numbers.  Blocks add up as 32-bit limbs in
ordinary aggregates, so the cross-products of the whole list are exact at any number of rows; they are
centred as integers (``n * sum(xy) - sum(x) * sum(y)``) and only then turned to doubles for ``eigh``.

What reaches the driver is one row per pair of dimensions, whatever the number of vectors.  Copies
collapse before the shuffle that finds distinct vectors.

Defined results: rows whose vector is null or holds null or non-finite entries are dropped, empty vectors
have no components; a null ``vec_id`` stays null; rows with equal ids are whitened one by one;
components beyond 64 bits are clipped to them, and a deviation beyond 64 bits is null; vectors of each length are
fitted on their own; a component whose eigenvalue is 0 up to rounding cannot be whitened and has no row;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonegauge.llm.store import keep

SCALE, COMPONENTS = 256, 4
#: rows packed at once, and 32-bit limbs of an exact sum (64-bit values: products below 2 ** 126)
ROWS, LIMBS = 1 << 13, 6


def integers(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, integer matrix) of a batch's usable vectors of each length."""
    column = batch.column("embedding")
    length = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.fill_null(pc.cast(column.flatten(), pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    start = np.append(0, np.cumsum(length))[:-1]
    for d in np.unique(length[length > 0]):
        rows = np.flatnonzero(length == d)
        m = flat[start[rows][:, None] + np.arange(d)]
        good = np.isfinite(m).all(axis=1)
        if good.any():
            with np.errstate(over="ignore"):
                x = np.floor(SCALE * m[good])
            top = x >= 2.0**63
            yield batch.column("vec_id").take(pa.array(rows[good])), np.where(top, np.iinfo(np.int64).max, np.where(top, 0, x.clip(-(2.0**63), None)).astype(np.int64))


def _encode(x: np.ndarray) -> list[bytes]:
    """Each row's bytes in the least of three widths that holds it: equal rows have equal bytes."""
    low, high = x.min(axis=1), x.max(axis=1)
    out: list = [b""] * len(x)
    done = np.zeros(len(x), bool)
    for kind in (np.int16, np.int32, np.int64):
        fits = ~done & (low >= np.iinfo(kind).min) & (high <= np.iinfo(kind).max)
        size = x.shape[1] * np.dtype(kind).itemsize
        data = np.ascontiguousarray(x[fits].astype(kind)).tobytes()
        for i, row in enumerate(np.flatnonzero(fits)):
            out[row] = data[i * size: (i + 1) * size]
        done |= fits
    return out


def _decode(rows: list[bytes], dim: int) -> np.ndarray:
    x = np.zeros((len(rows), dim), np.int64)
    size = np.array([len(r) // dim for r in rows])
    for kind in (np.int16, np.int32, np.int64):
        at = np.flatnonzero(size == np.dtype(kind).itemsize)
        if len(at):
            x[at] = np.frombuffer(b"".join(rows[i] for i in at), kind).reshape(len(at), dim)
    return x


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dim, rows, integer matrix) of the encoded vectors of each length."""
    dims = batch.column("dim").to_numpy(zero_copy_only=False)
    x = batch.column("x").to_pylist()
    for d in np.unique(dims):
        rows = np.flatnonzero(dims == d)
        yield int(d), rows, _decode([x[i] for i in rows], int(d))


def scatter(x: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """(sums, product sums of dimensions i and j >= i) of the rows, exact, by popcounts of bit planes."""
    n, dim = x.shape
    low = x.min(axis=0)
    u = x.view(np.uint64) - low.view(np.uint64)  # exact modulo 2 ** 64
    planes = [max(1, int(m).bit_length()) for m in u.max(axis=0)]
    most = max(planes)
    words = -(-n // 64)
    bits = np.zeros((words * 64, dim), np.uint64)
    bits[:n] = u
    packed = np.stack([np.packbits((bits >> np.uint64(a)).astype(np.uint8) & 1, axis=0).T.copy().view(np.uint64) for a in range(most)], axis=1)
    ones = np.bitwise_count(packed).sum(axis=2, dtype=np.int64)
    shift = [int(v) for v in low]
    above = [sum(int(c) << a for a, c in enumerate(ones[i])) for i in range(dim)]
    sums = [above[i] + n * shift[i] for i in range(dim)]
    products = []
    for i in range(dim):
        # counts by a + b of dimension i's planes with those of each dimension from i on
        by = np.zeros((dim - i, 2 * most), np.int64)
        for a in range(planes[i]):
            by[:, a: a + most] += np.bitwise_count(packed[i, a] & packed[i:]).sum(axis=2, dtype=np.int64)
        if 2 * most + n.bit_length() < 62:
            raw = (by << np.arange(2 * most)).sum(axis=1).tolist()
        else:
            raw = [sum(int(c) << s for s, c in enumerate(row) if c) for row in by]
        products.append([r + shift[i] * above[j] + shift[j] * above[i] + n * shift[i] * shift[j] for j, r in enumerate(raw, i)])
    return sums, products


def _limbs(value: int) -> list[int]:
    """32-bit limbs, lowest first; the last one carries the sign."""
    out = []
    for _ in range(LIMBS - 1):
        out.append(value & 0xFFFFFFFF)
        value >>= 32
    return [*out, value]


def _scatter_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per length and pair of dimensions (i = -1: sums; both -1: the count)."""
    held: dict[int, list[np.ndarray]] = {}
    total: dict[int, list] = {}

    def add(dim, x):
        sums, products = scatter(x)
        n, s, p = total.get(dim, (0, [0] * dim, [[0] * (dim - i) for i in range(dim)]))
        total[dim] = (n + len(x), [a + b for a, b in zip(s, sums)], [[a + b for a, b in zip(u, v)] for u, v in zip(p, products)])

    for batch in batches:
        for dim, _, x in _by_dim(batch):
            held.setdefault(dim, []).append(x)
            if sum(map(len, held[dim])) >= ROWS:
                add(dim, np.concatenate(held.pop(dim)))
    for dim, rest in held.items():
        add(dim, np.concatenate(rest))
    for dim, (n, sums, products) in total.items():
        for i in range(-1, dim):
            row = [(-1, n), *enumerate(sums)] if i < 0 else list(enumerate(products[i], i))
            limbs = zip(*[_limbs(v) for _, v in row])
            yield pa.RecordBatch.from_arrays([pa.array([dim] * len(row)), pa.array([i] * len(row)), pa.array([j for j, _ in row]), *[pa.array(x) for x in limbs]],
                                             ["dim", "i", "j", *[f"l{k}" for k in range(LIMBS)]])


def fit(distinct: DataFrame) -> dict[int, dict]:
    """Per vector length: count, sums, eigenvalues, eigenvectors (columns), trace and covariance."""
    limbs = [f"l{k}" for k in range(LIMBS)]
    rows = distinct.mapInArrow(_scatter_rows, "dim long, i long, j long, " + ", ".join(f"{x} long" for x in limbs))
    sums = rows.groupBy("dim", "i", "j").agg(*[F.sum(x).alias(x) for x in limbs]).collect()
    exact: dict[int, dict] = {}
    for r in sums:
        exact.setdefault(r.dim, {})[r.i, r.j] = sum(r[x] << (32 * k) for k, x in enumerate(limbs))
    out = {}
    for dim, values in exact.items():
        n = values[-1, -1]
        s = [values[-1, j] for j in range(dim)]
        v = np.zeros((dim, dim))
        for i in range(dim):
            for j in range(i, dim):
                # rounded once, from the exact quotient
                v[i, j] = v[j, i] = (n * values[i, j] - s[i] * s[j]) / (n * n)
        value, vector = np.linalg.eigh(v)
        value, vector = value[::-1], vector[:, ::-1]
        # the sign makes the largest entry positive, so that reruns agree
        vector = vector * np.sign(vector[np.abs(vector).argmax(axis=0), np.arange(dim)])
        known = int((value[:COMPONENTS] > dim * np.finfo(float).eps * max(value[0], 0)).sum()) if value[0] > 0 else 0
        out[dim] = {"n": n, "s": s, "value": value[:known], "vector": vector[:, :known], "trace": float(np.trace(v))}
    return out


def project(model: dict, x: np.ndarray) -> np.ndarray:
    """Whitened coordinates; the centre is taken off as whole numbers where 64 bits hold them."""
    n, s = model["n"], model["s"]
    if _fits(model, x):
        centred = (n * x - np.array(s, np.int64)) / float(n)
    else:
        centred = np.array([[(n * int(a) - b) / n for a, b in zip(row, s)] for row in x], float)
    return centred @ model["vector"] / np.sqrt(model["value"])


def _fits(model: dict, x: np.ndarray, square: bool = False) -> bool:
    biggest = model["n"] * max(abs(int(x.max())), abs(int(x.min()))) + max(map(abs, model["s"]))
    return biggest * biggest * x.shape[1] < 1 << 63 if square else biggest < 1 << 63


def deviations(model: dict, x: np.ndarray) -> list[int | None]:
    """Sum of the squares of n * x - S per row, null beyond 64 bits."""
    n, s = model["n"], model["s"]
    if _fits(model, x, square=True):
        d = n * x - np.array(s, np.int64)
        return (d * d).sum(axis=1).tolist()
    sums = [sum((n * int(a) - b) ** 2 for a, b in zip(row, s)) for row in x]
    return [v if v < 1 << 63 else None for v in sums]


def identity_errors(distinct: DataFrame, models: dict[int, dict]) -> dict[int, float]:
    """Per length, the largest entry of the whitened fit list's covariance minus the identity."""
    names = [f"w{i}" for i in range(COMPONENTS)]

    def run(batches):
        for batch in batches:
            for dim, _, x in _by_dim(batch):
                if (k := len(models[dim]["value"])):
                    w = np.zeros((len(x), COMPONENTS))
                    w[:, :k] = project(models[dim], x)
                    yield pa.RecordBatch.from_arrays([pa.array([dim]), pa.array([len(x)]), *[pa.array([w[:, i].sum()]) for i in range(COMPONENTS)],
                                                     pa.array([(w.T @ w).ravel().tolist()], pa.list_(pa.float64()))], ["dim", "n", *names, "p"])

    rows = distinct.mapInArrow(run, "dim long, n long, " + ", ".join(f"{x} double" for x in names) + ", p array<double>")
    pairs = [(i, j) for i in range(COMPONENTS) for j in range(i, COMPONENTS)]
    sums = rows.groupBy("dim").agg(F.sum("n").alias("n"), *[F.sum(x).alias(x) for x in names],
                                   *[F.sum(F.col("p")[i * COMPONENTS + j]).alias(f"p{i}{j}") for i, j in pairs]).collect()
    return {r.dim: max(abs(r[f"p{i}{j}"] / r.n - r[names[i]] * r[names[j]] / r.n**2 - (i == j)) for i, j in pairs if j < len(models[r.dim]["value"])) for r in sums}


def encoded(vectors: DataFrame) -> DataFrame:
    """(vec_id, dim, x) of all usable rows, the integer vector as bytes."""
    def run(batches):
        for batch in batches:
            for ids, x in integers(batch):
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(x), x.shape[1])), pa.array(_encode(x), pa.binary())], ["vec_id", "dim", "x"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "vec_id long, dim long, x binary")


def whitened(vectors: DataFrame) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every usable row."""
    rows = keep(encoded(vectors), "integers")
    distinct = keep(rows.select("dim", "x").distinct(), "fitlist")
    models = fit(distinct)
    errors = identity_errors(distinct, models)

    def run(batches):
        for batch in batches:
            for dim, at, x in _by_dim(batch):
                model = models[dim]
                if not (k := len(model["value"])):
                    continue
                w, n = project(model, x), len(x)
                ids = batch.column("vec_id").take(pa.array(np.repeat(at, k)))
                far = pa.array([v for v in deviations(model, x) for _ in range(k)], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, model["n"])), far, pa.array(w.ravel()),
                     pa.array(np.tile(model["value"] / model["trace"], n)), pa.array(np.full(n * k, errors[dim]))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
