"""Counts of character and word n-grams of many texts at once, on arrays.

An n-gram is one integer, its text's number in the high bits and its characters or words in the
rest, so counting is sorting integers; strings are made of the distinct ones only.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters or words that are counted at once; a longer text is counted alone.
GROUP = 1 << 18
#: Rows that are made at once.
ROWS = 1 << 16
#: The number of each row's text, the features and their counts.
Part = tuple[np.ndarray, pa.Array, np.ndarray]


def groups(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of GROUP in all at most, or of one text."""
    first = total = 0
    for i, n in enumerate(lengths.tolist()):
        if i > first and total + n > GROUP:
            yield first, i
            first, total = i, 0
        total += n
    if len(lengths):
        yield first, len(lengths)


def _distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes in order, and how often each is there."""
    codes = np.sort(codes)
    first = np.flatnonzero(np.diff(codes, prepend=-1))
    return codes[first], np.diff(first, append=len(codes))


def _bits(values: int) -> int:
    return max(values - 1, 0).bit_length()


def characters(texts: list[str], sizes: tuple[int, ...], base: int = 0) -> Iterator[Part]:
    """Of the texts, each between two spaces, the n-grams with their size as prefix."""
    points = np.frombuffer("".join([f" {t} " for t in texts]).encode("utf-32-le"), "<u4")
    seen = np.zeros(int(points.max()) + 1, bool)
    seen[points] = True
    alphabet = np.flatnonzero(seen)
    bits = _bits(len(alphabet))
    if bits * max(sizes) + _bits(len(texts)) > 63:
        if len(texts) > 1:
            half = len(texts) // 2
            yield from characters(texts[:half], sizes, base)
            yield from characters(texts[half:], sizes, base + half)
        else:  # over 4,096 different characters in one text
            p = f" {texts[0]} "
            for k in sizes:
                found = Counter(p[i : i + k] for i in range(len(p) - k + 1))
                yield np.full(len(found), base), pa.array([f"c{k}:{g}" for g in found], pa.string()), np.fromiter(found.values(), np.int64, len(found))
        return
    place = np.zeros(len(seen), np.int64)
    place[alphabet] = np.arange(len(alphabet))
    ids = place[points]
    text = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])
    ascii = int(np.searchsorted(alphabet, 128))
    octets = np.frombuffer(b"".join(chr(x).encode().ljust(4, b"\0") for x in alphabet.tolist()), "<u4")  # a character's UTF-8 is one integer, too
    width = 1 + (alphabet > 0x7F) + (alphabet > 0x7FF) + (alphabet > 0xFFFF)
    codes = text
    for k in range(1, max(sizes) + 1):
        codes = codes[: len(ids) - k + 1] << bits | ids[k - 1 :]
        if k not in sizes:
            continue
        distinct, n = _distinct(codes[text[: len(codes)] == text[k - 1 :]])
        prefix = np.frombuffer(f"c{k}:".encode(), np.uint8)
        for a in range(0, len(distinct), ROWS):
            u, count = distinct[a : a + ROWS], n[a : a + ROWS]
            c = [u >> bits * (k - 1 - j) & (1 << bits) - 1 for j in range(k)]
            plain = np.logical_and.reduce([x < ascii for x in c])
            for some, size in ((plain, 1), (~plain, 4)):
                if some.all():
                    some = slice(None)  # noqa: PLW2901
                elif not some.any():
                    continue
                v, m = [x[some] for x in c], len(u[some])
                out = np.empty((m, len(prefix) + k * size), np.uint8)
                out[:, : len(prefix)] = prefix
                for j, x in enumerate(v):
                    at = len(prefix) + j * size
                    out[:, at : at + size] = octets[x].astype(np.uint8)[:, None] if size == 1 else octets[x].view(np.uint8).reshape(m, 4)
                ends = np.arange(m + 1, dtype=np.int32) * np.int32(len(prefix) + k)
                if size > 1:
                    np.cumsum(len(prefix) + sum(width[x] for x in v), out=ends[1:])
                    out = out[out > 0] if alphabet[0] > 0 else out[_filled(out, v, width, len(prefix))]
                yield base + (u[some] >> bits * k), pa.StringArray.from_buffers(m, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(out))), count[some]


def _filled(out: np.ndarray, characters: list[np.ndarray], width: np.ndarray, prefix: int) -> np.ndarray:
    """Which octets belong to a character, where the zero character is one."""
    keep = np.ones(out.shape, bool)
    for j, x in enumerate(characters):
        keep[:, prefix + 4 * j : prefix + 4 * j + 4] = np.arange(4) < width[x][:, None]
    return keep


def words(lists: pa.ListArray) -> Iterator[Part]:
    """Of texts as lists of words, the words and the pairs of neighbours, with prefix."""
    coded = lists.flatten().dictionary_encode()
    ids, names = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    bits = _bits(len(names))
    text = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    one = text << bits | ids
    two = (one[:-1] << bits | ids[1:])[text[:-1] == text[1:]]
    for size, codes in ((1, one), (2, two)):
        distinct, n = _distinct(codes)
        for a in range(0, len(distinct), ROWS):
            u = distinct[a : a + ROWS]
            name = lambda j: names.take(pa.array(u >> bits * j & (1 << bits) - 1))  # noqa: B023, E731
            last = name(0) if size == 1 else pc.binary_join_element_wise(name(1), name(0), " ")
            yield u >> bits * size, pc.binary_join_element_wise(f"w{size}:", last, ""), n[a : a + ROWS]


def batch_tally(values: pa.Array, sizes: tuple[int, ...] | None) -> Iterator[Part]:
    """Counts of a batch of texts, or with no sizes of lists of words, in parts; no text is in two groups."""
    lengths = (pc.list_value_length(values) if sizes is None else pc.utf8_length(values)).to_numpy(zero_copy_only=False)
    for a, b in groups(lengths):
        some = values.slice(a, b - a)
        for text, feature, n in words(some) if sizes is None else characters(some.to_pylist(), sizes):
            yield a + text, feature, n
