"""Periodic runs by scale-tiled distribution.

A run is a stretch of words with smallest period ``q`` and length of at least ``max(24, 3 * q)`` that
cannot be extended on either side.  The periods of one octave, ``[S, 2 * S)``, share tiles: a tile
owns boundaries ``S`` words apart and carries the words around them, so neighbouring tiles overlap.

1. *Explode.* Each document becomes tiles per octave.  A run of the octave holds a boundary ``b`` with
   at least ``S`` equal words behind ``b`` and ``b + p``, so a tile without two equal fingerprints of
   ``S`` words at such places holds no part of a run and is not shipped.
2. *Solve.* Each tile stands alone: Z-functions of the words right and left of a boundary give, for all
   periods of the octave at once, how far each repetition reaches inside the boundary's window.
3. *Stitch.* Fragments meet by document and period; those that share a whole period are one repetition.
   Should a repetition have a smaller period too, that one fills the same interval (the two periods'
   sum fits into it), so the smallest period of an interval names the run.

A tile has ``max(TILE, 8 * S)`` words and a margin, whatever the document's length, and tiles are dealt
out one by one: a very long document is solved by many tasks.  A document's runs are gathered only
to digest them and to cut that same document, whose text is one row anyway.

Defined results: a null text is empty; a null ``doc_id`` is a document of its own kind that
``reshape`` leaves alone; rows with equal id and text get equal results, each its own row; rows with
equal id and different texts are told apart; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonegauge.llm.arrowtext import U, chunks, mix
from tonegauge.llm.store import keep

SHORTEST, REPEATS = 24, 3
#: spacing of the first octave's boundaries (it takes all periods below ``2 * FIRST``), words in a tile
FIRST, TILE = 8, 512
_PART = 1 << 20
_DOC = "kind string, doc_id long, doc binary, n long, plain string, words binary"
_SPAN = "octave long, lo long, ids binary, bytes long, at array<long>, salt long"


def reshape(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """A tenth of the documents, by the crc32 of their ids, repeat a stretch from a word on to the end."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    block = words[a: a + p]
    return words[:a] + (block * ((n - a) // p + 1))[: n - a]


def word_ids(words: list[bytes]) -> np.ndarray:
    """Equal words have equal numbers: the place where each stands first."""
    return np.fromiter(map({}.setdefault, words, count()), np.int64, len(words))


def suspects(ids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(S, boundaries) of each octave where S words recur at a distance of the octave."""
    n, s = len(ids), FIRST
    if n < SHORTEST:
        return
    h = mix(ids.astype(U))
    width = 1
    while REPEATS * s <= n:
        while width < s:
            h = mix(h[:-width] * U(0x9E3779B97F4A7C15) + h[width:])
            width *= 2
        if s == FIRST:  # periods 1 to 2 * FIRST - 1
            blocks = np.append(h, np.zeros(2 * s, U))
            view = np.lib.stride_tricks.sliding_window_view(blocks, 2 * s)[: len(h): s]
            row, p = np.nonzero(view[:, 1:] == view[:, :1])
            p += 1
        else:
            blocks = h[s:]
            blocks = np.append(blocks, np.zeros(-len(blocks) % s, U)).reshape(-1, s)
            row, p = np.nonzero(blocks == h[:: s][: len(blocks), None])
            p += s
        row = row[row * s + p < len(h)]
        if len(row):
            yield s, np.unique(row) * s
        s *= 2


def z_function(x: list[int]) -> list[int]:
    """Length of the common prefix of ``x`` and each of its suffixes (the whole length at 0)."""
    n = len(x)
    z = [n] + [0] * (n - 1)
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        if i + k >= right:
            while i + k < n and x[k] == x[i + k]:
                k += 1
            left, right = i, i + k
        z[i] = k
    return z


@lru_cache(1 << 16)
def prime_factors(p: int) -> tuple[int, ...]:
    out, r = [], 2
    while r * r <= p:
        if p % r == 0:
            out.append(r)
            while p % r == 0:
                p //= r
        r += 1
    return tuple(out + [p] * (p > 1))


def solve_boundary(x: list[int], b: int, s: int) -> Iterator[tuple[int, int, int]]:
    """(period, start, end) of the repetitions around ``x[b]``, as far as the boundary's window shows them.

    A period whose first block is itself a repetition, by the same Z-function, is left to the smaller period.
    """
    lo, hi = max(0, b - s), min(len(x), b + 4 * s)
    right = z_function(x[b: hi])
    periods = [p for p in range(1 if s == FIRST else s, 2 * s)
               if b + p < hi and right[p] >= s and not any(right[p // r] >= p - p // r for r in prime_factors(p))]
    if not periods:
        return
    most = periods[-1]
    before = x[lo: b][::-1]
    left = z_function([*before, -1, *x[lo: b + most][::-1]])
    for p in periods:
        back = left[len(before) + 1 + most - p] if before else 0
        yield p, b - back, b + p + right[p]


def solve_tile(ids: list[int], at: list[int], s: int, whole: tuple[bool, bool]) -> set[tuple[int, int, int]]:
    """(period, start, end) found at a tile's boundaries ``at``, joined inside the tile.

    A repetition that is too short counts only where it may go on beyond the tile; ``whole`` says whether
    the tile begins and ends with its document.
    """
    parts: dict[int, list[tuple[int, int]]] = {}
    for b in at:
        for p, start, end in solve_boundary(ids, b, s):
            got = parts.setdefault(p, [])
            if got and start + p <= got[-1][1]:
                got[-1] = (min(start, got[-1][0]), max(end, got[-1][1]))
            else:
                got.append((start, end))
    return {(p, start, end) for p, got in parts.items() for start, end in got
            if end - start >= max(SHORTEST, REPEATS * p) or (start == 0 and not whole[0]) or (end == len(ids) and not whole[1])}


def _explode(batches: Iterator[pa.RecordBatch], change) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in f"{_DOC}, {_SPAN}".split(", ")]
    salt = 0
    for batch in batches:
        for part in chunks(batch, "text", _PART):
            rows: dict[str, list] = {c: [] for c in names}

            def add(**values):
                for c in names:
                    rows[c].append(values.get(c))

            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").cast(pa.large_binary()).to_pylist()):
                words = change(doc_id, (text or b"").split())
                joined = b" ".join(words)
                plain = hashlib.sha256(joined).hexdigest()
                doc = hashlib.sha256(f"{doc_id}:{plain}".encode()).digest()[:16]
                ids, n, spans = word_ids(words), len(words), 0
                for s, bounds in suspects(ids):
                    size = max(TILE, 8 * s)
                    for t in np.unique(bounds // size):
                        lo, hi = max(0, int(t) * size - s), min(n, (int(t) + 1) * size + 3 * s)
                        local = np.unique(ids[lo: hi], return_inverse=True)[1]
                        kind = np.uint16 if local.max() < 1 << 16 else np.int64
                        salt, spans = salt + 1, spans + 1
                        add(kind="tile", doc=doc, n=n, octave=s, lo=lo, ids=local.astype(kind).tobytes(), bytes=np.dtype(kind).itemsize,
                            at=(bounds[bounds // size == t] - lo).tolist(), salt=salt)
                add(kind="doc", doc_id=doc_id, doc=doc if spans else None, n=n, plain=plain, words=joined if spans else None)
            yield pa.RecordBatch.from_pydict(rows, schema=_arrow(f"{_DOC}, {_SPAN}"))


def _arrow(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")])


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            r = batch.slice(i, 1).to_pylist()[0]
            ids = np.frombuffer(r["ids"], np.uint16 if r["bytes"] == 2 else np.int64).tolist()
            found = solve_tile(ids, r["at"], r["octave"], (r["lo"] == 0, r["lo"] + len(ids) == r["n"]))
            p, start, end = (np.array(x, np.int64) for x in zip(*found)) if found else [np.zeros(0, np.int64)] * 3
            yield pa.RecordBatch.from_arrays([pa.array([r["doc"]] * len(p), pa.binary()), pa.array(p), pa.array(start + r["lo"]), pa.array(end + r["lo"])],
                                             ["doc", "period", "start", "end"])


def stitch(fragments: DataFrame) -> DataFrame:
    """(doc, start, length, period) of the runs that the fragments (doc, period, start, end) are pieces of."""
    pieces = fragments.groupBy("doc", "period", "start").agg(F.max("end").alias("end"))
    order = Window.partitionBy("doc", "period").orderBy("start")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    joined = pieces.withColumn("new", F.coalesce(F.col("start") + F.col("period") > reach, F.lit(True)).cast("long"))
    joined = joined.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = joined.groupBy("doc", "period", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    length = F.col("end") - F.col("start")
    whole = whole.filter((length >= SHORTEST) & (length >= REPEATS * F.col("period")))
    return whole.groupBy("doc", "start", "end").agg(F.min("period").alias("period")).select("doc", "start", length.alias("length"), "period")


def parts_of(docs: DataFrame, change=reshape) -> DataFrame:
    """One written row per document (``kind`` doc) and per suspicious tile (``kind`` tile)."""
    return keep(docs.select("doc_id", "text").mapInArrow(lambda batches: _explode(batches, change), f"{_DOC}, {_SPAN}"), "tiles")


def runs_of(parts: DataFrame) -> DataFrame:
    """(doc, start, length, period) of all runs."""
    tiles = parts.filter("kind = 'tile'").select("doc", "n", "octave", "lo", "ids", "bytes", "at", "salt")
    # dealt by tile, so that repeated documents and long ones spread; few bytes can be much work, so the
    # session's number of partitions stands
    tiles = tiles.repartition(int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc", "octave", "lo", "salt")
    return stitch(tiles.mapInArrow(_solve, "doc binary, period long, start long, end long"))


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The (start, length, period) of greatest length / period; ties to the smallest start, then period."""
    best = runs[0]
    for r in runs[1:]:
        if (d := r[1] * best[2] - best[1] * r[2]) > 0 or (d == 0 and (r[0], r[2]) < (best[0], best[2])):
            best = r
    return best


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words outside the runs, and each run's first period."""
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    left = np.flatnonzero(np.cumsum(gone)[:-1] == 0)
    return [words[i] for i in left.tolist()]


_OUT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _OUT.split(", ")]
    nothing = hashlib.sha256(b"").hexdigest()
    for batch in batches:
        rows = []
        for i in range(batch.num_rows):
            r = batch.slice(i, 1).to_pylist()[0]
            runs = sorted((x["start"], x["length"], x["period"]) for x in r["runs"] or [])
            if not runs:
                rows.append((r["doc_id"], 0, None, None, None, None, nothing, r["plain"]))
                continue
            start, length, period = strongest(runs)
            lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
            kept = b" ".join(collapse(r["words"].split(), runs))
            rows.append((r["doc_id"], len(runs), start, length, period, 1000 * length // period,
                         hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
        yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows)))) if rows else {c: [] for c in names}, schema=_arrow(_OUT))


def periodic_runs(docs: DataFrame, change=reshape) -> DataFrame:
    """Per document its number of runs, the strongest one, and digests of all runs and of the collapsed words."""
    parts = parts_of(docs, change)
    rows = parts.filter("kind = 'doc'").select("doc_id", "doc", "plain", "words")
    found = keep(runs_of(parts), "runs").groupBy("doc").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))
    # documents without a suspicious tile have no runs and need no join
    clear = rows.filter("doc is null").withColumn("runs", F.lit(None).cast(found.schema["runs"].dataType))
    return (rows.filter("doc is not null").join(found, "doc", "left").unionByName(clear)
            .select("doc_id", "plain", "words", "runs").mapInArrow(_digest, _OUT))
