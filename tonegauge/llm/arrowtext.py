"""Vectorised words and word hashes over Arrow string batches.

A batch's UTF-8 bytes are treated as one NumPy array: words are found with a byte mask, and each
word's 64-bit hash is the sum of a table value per (position in word, byte), mixed at the end.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
CHUNK_BYTES = 3 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix64 generator: a bijection on 64-bit words."""
    x = x + U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_POSITIONS = 64
_TABLE = mix(np.arange(_POSITIONS * 256, dtype=U))
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: words of ``[^\x20\x09-\x0D]+``
NON_SPACE = np.ones(256, bool)
NON_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: runs of ASCII letters and digits and of non-ASCII characters
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with about ``most`` bytes of text each (a longer text stands alone)."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n) + 1
    yield batch.slice(start)


def tidy(run: Callable) -> Callable:
    """``run`` of a task's batches, after which its memory goes back to the system: Python workers outlive their
    tasks, and several wait beside those at work."""
    def tidied(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)
    return tidied


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string column; a null counts as empty."""
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]: off[-1]], off - off[0]


def word_starts(raw: np.ndarray, off: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(is word byte, starts a word, positions of word starts); words never cross rows."""
    w = cls[raw]
    start = w.copy()
    start[1:] &= ~w[:-1]
    row = off[:-1][off[:-1] < len(raw)]
    start[row] |= w[row]
    return w, start, np.flatnonzero(start)


def word_counts(column: pa.Array) -> np.ndarray:
    """Number of ``[^\x20\x09-\x0D]+`` per row."""
    raw, off = utf8(column)
    s = word_starts(raw, off, NON_SPACE)[2]
    return np.diff(np.searchsorted(s, off)).astype(np.int64)


def words(raw: np.ndarray, off: np.ndarray, cls: np.ndarray = NON_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word with A-Z lower-cased, word offsets of each row, where each word starts, its bytes)."""
    w, start, s = word_starts(raw, off, cls)
    at = np.flatnonzero(w)
    if not len(at):
        return np.zeros(0, U), np.zeros(len(off), np.int64), s, s
    head = np.flatnonzero(start[at])
    lengths = np.diff(np.append(head, len(at)))
    pos = np.arange(len(at)) - np.repeat(head, lengths)
    part = _TABLE[(pos & (_POSITIONS - 1)) * 256 + _FOLD[raw[at]]]
    if lengths.max() > _POSITIONS:
        part = part * ((pos // _POSITIONS).astype(U) * U(2) + U(1))
    return mix(np.add.reduceat(part, head)), np.searchsorted(s, off), s, lengths


def word_hashes(column: pa.Array, cls: np.ndarray = NON_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word with A-Z lower-cased, word offsets of each row)."""
    return words(*utf8(column), cls)[:2]


def run_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive words (``len(h) - width + 1`` of them)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.zeros(n, U)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = (out + h[k: k + n]) * U(0x9E3779B97F4A7C15 | 1)
    return mix(out)
