"""Vectorised text kernels shared by the corpus operators.

Everything here works on whole Arrow batches as flat numpy arrays: the bytes of
all texts laid end to end plus the offsets of the texts.  No kernel loops over
documents or words in Python.

A *word* is a maximal run of bytes other than the six ASCII white-space bytes
(tab, line feed, vertical tab, form feed, carriage return, space).  ``WORD_CLASS``
is the same definition as a regular expression for Spark and DuckDB.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD_CLASS = r"[^ \t\n\x0B\f\r]+"
U64 = np.uint64
#: Bytes of text that one kernel call takes at most, unless a single text is longer.
SLICE_BYTES = 1 << 19

_BYTE_BASE = U64(0x9E3779B97F4A7C15)
_WORD_BASE = U64(0xD1B54A32D192ED03)
_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_FOLDED = _TABLE.copy()
_FOLDED[65:91] = _TABLE[97:123]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; kept between calls while n is ordinary."""
    have = _POWERS.get(int(base))
    if have is not None and len(have[0]) >= n:
        return have
    size = max(n, SLICE_BYTES + 1) if n <= 2 * SLICE_BYTES else n
    inverse = U64(pow(int(base), -1, 1 << 64))
    out = []
    for b in (base, inverse):
        p = np.full(size, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    if size <= 2 * SLICE_BYTES:
        _POWERS[int(base)] = (out[0], out[1])
    return out[0], out[1]


def utf8_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the len(column) + 1 offsets into them; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def give_back() -> None:
    """Return freed memory to the system, so that idle workers don't hold on to what a batch once took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def byte_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``limit`` bytes of ``column`` (text or binary); rows stay whole, none is lost."""
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        offsets = np.zeros(n + 1, np.int64)
        np.cumsum(sizes.to_numpy(zero_copy_only=False), out=offsets[1:])
        start = 0
        while start < n:
            stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
            stop = min(max(stop, start + 1), n)
            yield batch.slice(start, stop - start)
            start = stop
        give_back()


class Words:
    """The words of one batch of texts.

    ``starts``/``ends`` are byte positions in ``data``; ``first[i]:first[i+1]`` are
    the words of text ``i``.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        solid = ~_IS_SPACE[data] if len(data) else np.zeros(0, bool)
        begins = solid.copy()
        ends = solid.copy()
        if len(data):
            begins[1:] &= ~solid[:-1]
            ends[:-1] &= ~solid[1:]
            cut = offsets[1:-1]
            cut = cut[(cut > 0) & (cut < len(data))]
            begins[cut] = solid[cut]
            ends[cut - 1] = solid[cut - 1]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, offsets).astype(np.int64)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, fold: bool = False) -> np.ndarray:
        """A 64-bit hash of each word; ``fold`` reads ASCII capitals as small letters."""
        n = len(self.data)
        power, inverse = _powers(_BYTE_BASE, n + 1)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((_FOLDED if fold else _TABLE)[self.data] * power[:n], out=prefix[1:])
        h = (prefix[self.ends] - prefix[self.starts]) * inverse[self.starts]
        return mix64(h ^ (self.ends - self.starts).astype(np.uint64))


def windows(values: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k values inside each text, with the offsets of the texts' runs.

    A text of 1 to k - 1 values has none.
    """
    n = len(values)
    power, inverse = _powers(_WORD_BASE, n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(values * power[:n], out=prefix[1:])
    runs = np.maximum(np.diff(first) - k + 1, 0)
    at = np.zeros(len(runs) + 1, np.int64)
    np.cumsum(runs, out=at[1:])
    starts = np.arange(at[-1], dtype=np.int64) + np.repeat(first[:-1] - at[:-1], runs)
    return mix64((prefix[starts + k] - prefix[starts]) * inverse[starts]), at


def whole(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One hash of each text's whole sequence of values."""
    n = len(values)
    power, inverse = _powers(_WORD_BASE, n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(values * power[:n], out=prefix[1:])
    h = (prefix[first[1:]] - prefix[first[:-1]]) * inverse[first[:-1]]
    return mix64(h ^ mix64(np.diff(first).astype(np.uint64)))


def sliding_argmin(values: np.ndarray, w: int) -> np.ndarray:
    """For each i, the position of the least of values[i:i+w] (the leftmost of equals); len(values) - w + 1 results."""
    n = len(values) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    # Sparse-table doubling: best[i] covers `span` values from i on.
    best, span = np.arange(len(values), dtype=np.int64), 1
    while span * 2 <= w:
        a, b = best[:-span], best[span:]
        best = np.where(values[b] < values[a], b, a)
        span *= 2
    if span < w:
        a, b = best[: n], best[w - span : w - span + n]
        best = np.where(values[b] < values[a], b, a)
    return best[:n]


def shingles(words: Words, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of all texts, repeats included, and the text that each is from.

    A text of 1 to k - 1 words has one shingle, all its words; a text without words has none.
    """
    runs, at = windows(hashes, words.first, k)
    counts = words.counts
    short = np.flatnonzero((counts > 0) & (counts < k))
    doc = np.repeat(np.arange(len(counts)), np.diff(at))
    if len(short):
        runs = np.concatenate([runs, whole(hashes, words.first)[short]])
        doc = np.concatenate([doc, short])
    return runs, doc


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text (ASCII capitals folded), with offsets."""
    counts = words.counts
    runs, doc = shingles(words, words.hashes(fold=True), k)
    order = np.lexsort((runs, doc))
    runs, doc = runs[order], doc[order]
    fresh = np.ones(len(runs), bool)
    if len(runs):
        fresh[1:] = (runs[1:] != runs[:-1]) | (doc[1:] != doc[:-1])
    runs, doc = runs[fresh], doc[fresh]
    return runs, np.searchsorted(doc, np.arange(len(counts) + 1)).astype(np.int64)
