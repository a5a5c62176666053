"""Packing token sequences into windows by non-negative least squares.

A document is its token ids and a final id 1.  Each full window of a document is a sequence of its
own; what is left over is packed:

1. lengths are put into classes of ``UNIT`` tokens and counted (a histogram of fixed size);
2. all combinations of at most ``DEPTH`` classes that fill a window exactly are enumerated;
3. repeat counts are solved against the histogram by non-negative least squares (multiplicative
   updates) and rounded to what the histogram can serve;
4. what they leave is packed greedily: laid end to end by class and cut at window ends.

A document's place follows in closed form from its rank in its class, so only counts per class and
input partition meet anywhere.  Padding is what lengths lose to their class (under ``UNIT`` tokens
a piece) and one last window.

Defined results: null text is empty (one id); rows with equal or null ``doc_id`` are documents of
their own; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonegauge.llm.arrowtext import chunks, tidy, utf8
from tonegauge.llm.arrowtext import words as word_spans
from tonegauge.llm.store import keep

WINDOW, UNIT, DEPTH, END = 2048, 8, 3, 1
_WORDS, _CORES = 400_000, 800_000
#: marks that the tokenizer parts from letters before them
_MARKS = ".,;:!?%&*#$()[]{}\"/-+=_"


class WordTable:
    """Ids of words by hash: sorted keys, and each key's stretch of one array of ids.

    Holds at most about ``most`` words besides those of one batch; the longest unused half goes.
    """

    def __init__(self, most: int, kind: np.dtype):
        self.most, self.turn = most, 0
        self.keys, self.ids = np.zeros(0, np.uint64), np.zeros(0, kind)
        self.begin, self.count, self.used = (np.zeros(0, np.int64) for _ in range(3))

    def _find(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, keys)
        return np.minimum(at, max(0, len(self.keys) - 1))

    def unknown(self, keys: np.ndarray) -> np.ndarray:
        self.turn += 1
        if not len(self.keys):
            return np.arange(len(keys))
        at = self._find(keys)
        known = self.keys[at] == keys
        self.used[at[known]] = self.turn
        return np.flatnonzero(~known)

    def add(self, keys: np.ndarray, ids: list[bytes]) -> None:
        count = np.fromiter(map(len, ids), np.int64, len(ids)) // self.ids.itemsize
        begin = len(self.ids) + np.cumsum(count) - count
        self.ids = np.append(self.ids, np.frombuffer(b"".join(ids), self.ids.dtype))
        every = [np.append(a, b) for a, b in ((self.keys, keys), (self.begin, begin), (self.count, count), (self.used, np.full(len(keys), self.turn)))]
        if len(every[0]) > self.most:
            late = every[3] >= min(self.turn, np.median(every[3]) + 1)
            every = [x[late] for x in every]
            self.ids, every[1] = stretches(self.ids, every[1], every[2])
        order = np.argsort(every[0], kind="stable")
        self.keys, self.begin, self.count, self.used = (x[order] for x in every)

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self._find(keys)
        return self.begin[at], self.count[at]


def stretches(values: np.ndarray, begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the stretches of an array one after another, where each begins there)."""
    stop = np.cumsum(count)
    total = int(stop[-1]) if len(stop) else 0
    return values[np.arange(total) + np.repeat(begin - (stop - count), count)], stop - count


class WordTokenizer:
    """Ids of whole texts, word by word.

    The tokenizer drops white space and never joins across it, so a text's ids are its words' ids
    one after another.  Each word of a batch is looked up once, by its 64-bit hash (A-Z lower-cased,
    as the tokenizer does).  Words, and the letters of words that end in marks, are kept in caches of
    bounded size; the new words of a batch are encoded together.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.words, self.cores, self.tails = (WordTable(n, self.kind) for n in (_WORDS, _CORES, _CORES))
        self.ends = np.zeros(size, bool)
        for piece, i in self.tokenizer.get_vocab().items():
            self.ends[i] = piece.endswith("</w>")

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_cores(self, cores: list[str]) -> list[bytes]:
        """Words of letters only: encoded in one text and cut where a word ends."""
        raw = self._encode([" ".join(cores)])[0]
        size = self.kind.itemsize
        cut = ((np.flatnonzero(self.ends[np.frombuffer(raw, self.kind)]) + 1) * size).tolist()
        if len(cut) != len(cores):
            return self._encode(cores)
        return [raw[i:j] for i, j in zip([0, *cut], cut)]

    def _parts(self, table: WordTable, texts: list[str], encode) -> list[bytes]:
        """Ids of each text, new ones encoded by ``encode``."""
        keys = np.fromiter(map(hash, texts), np.int64, len(texts)).view(np.uint64)
        unique, first, which = np.unique(keys, return_index=True, return_inverse=True)
        new = table.unknown(unique)
        if len(new):
            some = [texts[i] for i in first[new].tolist()]
            table.add(unique[new], [x for i in range(0, len(some), 1000) for x in encode(some[i: i + 1000])])
        if not len(unique):
            return []
        begin, count = table.of(unique)
        flat, at = stretches(table.ids, begin, count)
        raw, size = flat.tobytes(), self.kind.itemsize
        each = [raw[i:j] for i, j in zip((at * size).tolist(), ((at + count) * size).tolist())]
        return [each[i] for i in which.tolist()]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words: those of their letters and of the marks after them, or of the whole word."""
        cores = [w.rstrip(_MARKS) for w in words]
        whole = [not c.isalpha() for c in cores]
        tails = ["" if x else w[len(c):] for w, c, x in zip(words, cores, whole)]
        # ASCII is lower-cased alike everywhere
        cores = [w if x else c.lower() if c.isascii() else c for w, c, x in zip(words, cores, whole)]
        at = [i for i, x in enumerate(whole) if not x]
        out = [b""] * len(words)
        for i, ids in zip(at, self._parts(self.cores, [cores[i] for i in at], self._encode_cores)):
            out[i] = ids
        odd = [i for i, x in enumerate(whole) if x]
        for i, ids in zip(odd, self._encode([words[i] for i in odd])):
            out[i] = ids
        tailed = [i for i, t in enumerate(tails) if t]
        for i, ids in zip(tailed, self._parts(self.tails, [tails[i] for i in tailed], self._encode)):
            out[i] += ids
        return out

    def ids(self, column: pa.Array) -> list[np.ndarray]:
        """Ids of each text of a batch, the same as of encoding it whole."""
        raw, off = utf8(column)
        h, wo, start, length = word_spans(raw, off)
        unique, first, which = np.unique(h, return_index=True, return_inverse=True)
        new = self.words.unknown(unique)
        if len(new):
            at = first[new]
            text = raw.tobytes()
            found = [text[i:j].decode() for i, j in zip(start[at].tolist(), (start[at] + length[at]).tolist())]
            self.words.add(unique[new], self._words(found))
        begin, count = self.words.of(unique) if len(unique) else (first, first)
        flat, at = stretches(self.words.ids, begin[which], count[which])
        cut = np.append(at, len(flat))[wo]
        return [flat[i:j] for i, j in zip(cut[:-1], cut[1:])]


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """This process's tokenizer of a file."""
    if path not in _TOKENIZERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def tokenised(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """One row per document: its full windows' checksums and what is left over.

    ``part`` and ``rank`` number the left-overs of each class within an input partition, ``full``
    the partition's full windows before this document.
    """
    def run(batches):
        t, part = tokenizer(path), TaskContext.get().partitionId()
        seen, full = np.zeros(window // UNIT + 1, np.int64), 0
        for batch in batches:
            for b in chunks(batch, "text"):
                rows = []
                for ids in t.ids(b.column("text")):
                    ids = np.append(ids, ids.dtype.type(END))
                    n, r = len(ids) // window, len(ids) % window
                    wide = ids[: n * window].astype("<u4")
                    crcs = [zlib.crc32(wide[i * window: (i + 1) * window].tobytes()) for i in range(n)]
                    c = -(-r // UNIT)
                    rows.append((len(ids), crcs, ids[n * window:].astype(t.kind).tobytes(), t.kind.itemsize, part, c, int(seen[c]), full))
                    seen[c] += 1
                    full += n
                cols = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], ["doc_id", "doc_tokens", "crcs", "tail", "width", "part", "class", "rank", "full"])
    return docs.select("doc_id", "text").mapInArrow(
        tidy(run), "doc_id long, doc_tokens long, crcs array<long>, tail binary, width int, part int, class int, rank long, full long")


def combinations(units: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """All multisets of at most ``depth`` classes that add up to ``units``, larger first."""
    out: list[tuple[int, ...]] = []

    def grow(parts, left, most):
        if left == 0:
            out.append(parts)
        elif len(parts) < depth:
            for c in range(min(most, left), 0, -1):
                if c * (depth - len(parts)) < left:
                    break
                grow((*parts, c), left - c, c)

    grow((), units, units)
    return out


def solve(histogram: np.ndarray, combos: list[tuple[int, ...]], steps: int = 400) -> np.ndarray:
    """Whole repeat counts: non-negative least squares by multiplicative updates, rounded down to
    what the histogram can serve."""
    a = np.zeros((len(histogram), len(combos)))
    for j, parts in enumerate(combos):
        for c in parts:
            a[c, j] += 1
    x = np.full(len(combos), max(histogram.sum(), 1) / (2.0 * len(combos)))
    gain = a.T @ histogram
    for _ in range(steps):
        x *= gain / np.maximum(a.T @ (a @ x), 1e-12)
    left, out = histogram.astype(np.int64).copy(), np.zeros(len(combos), np.int64)
    for j in np.argsort(-x):
        parts, most = combos[j], int(np.rint(x[j]))
        if most < 1:
            break
        need = {c: parts.count(c) for c in parts}
        out[j] = min([most, *(int(left[c]) // m for c, m in need.items())])
        for c, m in need.items():
            left[c] -= out[j] * m
    return out


class Plan:
    """Where the left-over of (class, global rank) goes; its size depends on the window only."""

    def __init__(self, histogram: np.ndarray, window: int = WINDOW):
        units = window // UNIT
        combos = combinations(units)
        counts = solve(histogram, combos)
        used = np.zeros(units + 1, np.int64)
        self.cuts: list[list[tuple[int, int, int]]] = [[] for _ in range(units + 1)]
        first = 0
        for parts, n in zip(combos, counts):
            if n:
                for c in sorted(set(parts)):
                    m = parts.count(c)
                    self.cuts[c].append((int(used[c]), first, m))
                    used[c] += n * m
                first += int(n)
        self.units, self.used, self.greedy = units, used, first
        rest = (histogram - used) * np.arange(units + 1)
        self.base = np.append(0, np.cumsum(rest))[:-1]
        self.full = first + int(-(-rest.sum() // units))

    def place(self, c: int, rank: int, length: int) -> list[tuple[int, int, int]]:
        """(sequence, slot in it, tokens) of the left-over's pieces in order."""
        if rank < self.used[c]:
            at = np.searchsorted([x[0] for x in self.cuts[c]], rank, side="right") - 1
            start, first, m = self.cuts[c][at]
            return [(first + (rank - start) // m, c * self.units + (rank - start) % m, length)]
        at = int(self.base[c] + (rank - self.used[c]) * c)
        sequence, slot = self.greedy + at // self.units, at % self.units
        room = (self.units - slot) * UNIT
        if length <= room:
            return [(sequence, slot, length)]
        return [(sequence, slot, room), (sequence + 1, 0, length - room)]


def pack(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): one row per piece."""
    rows = keep(tokenised(docs, path, window), "tokens")
    units = window // UNIT
    counts = rows.groupBy("part", "class").agg(F.count("*").alias("n"))
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    counts = keep(counts, "counts")
    histogram = np.zeros(units + 1, np.int64)
    for r in counts.groupBy("class").agg(F.sum("n").alias("n")).filter("class > 0").collect():
        histogram[r["class"]] = r.n
    plan = Plan(histogram, window)
    full = rows.groupBy("part").agg(F.sum(F.size("crcs")).alias("n"))
    full = full.withColumn("full_before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    offsets = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("class", "before"))).alias("before")).join(full, "part")
    rows = rows.join(offsets, "part").withColumn("rank", F.col("rank") + F.element_at("before", F.col("class"))).withColumn("full", F.col("full") + F.col("full_before"))

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                n = len(r["crcs"])
                for i, crc in enumerate(r["crcs"]):
                    out.append((r["doc_id"], i * window, window, crc, r["doc_tokens"], plan.full + r["full"] + i, 0))
                tail = np.frombuffer(r["tail"], f"<u{r['width']}").astype("<u4")
                at = 0
                if len(tail):
                    for sequence, slot, length in plan.place(r["class"], r["rank"], len(tail)):
                        crc = zlib.crc32(tail[at: at + length].tobytes())
                        out.append((r["doc_id"], n * window + at, length, crc, r["doc_tokens"], sequence, slot))
                        at += length
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 7,
                                             ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "slot"])

    pieces = rows.select("doc_id", "doc_tokens", "crcs", "tail", "width", "class", "rank", "full").mapInArrow(
        tidy(run), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, slot long")
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return pieces.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0).cast("long"))).drop("slot")
