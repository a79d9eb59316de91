"""Document fingerprints: prefix polynomial hashes.

The prefix array of a text, H[i] = sum of c[j] * base**j for j < i modulo a prime, tells in
constant time whether two spans are equal, and by binary search how far two positions of
the text agree.  Four primes under 2**31 are used, so products fit 64 bits, sums need no
reduction on the way, and two unequal spans agree by chance about once in 2**120.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm.kernels import byte_slices
from attestra.llm.tables import documents_only, table

PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (1103515245, 1220703125, 1566083941, 1812433253)
_SLICE_BYTES = 1 << 20
_TABLES: dict[tuple[int, int], np.ndarray] = {}


def powers(base: int, prime: int, n: int) -> np.ndarray:
    """base**i modulo prime for i < n, at least; kept between calls while n is ordinary."""
    have = _TABLES.get((base, prime))
    if have is not None and len(have) >= n:
        return have
    size = max(n, _SLICE_BYTES + 2)
    out = np.ones(size, np.uint64)
    done = 1
    while done < size:
        more = min(done, size - done)
        out[done : done + more] = out[:more] * np.uint64(pow(base, done, prime)) % np.uint64(prime)
        done += more
    if size <= 4 * _SLICE_BYTES:
        _TABLES[base, prime] = out
    return out


class Prefixes:
    """Prefix arrays over code points; spans are [start, start + length) and may be given as arrays."""

    def __init__(self, points: np.ndarray):
        n = len(points)
        wide = points.astype(np.uint64)
        self.n = n
        self._h, self._up, self._down = [], [], []
        for base, prime in zip(BASES, PRIMES, strict=True):
            up = powers(base, prime, n + 1)
            h = np.zeros(n + 1, np.uint64)
            # each term is under 2**31, so 2**33 of them can be summed before reduction
            np.cumsum(wide * up[:n] % np.uint64(prime), out=h[1:])
            self._h.append(h % np.uint64(prime))
            self._up.append(up)
            self._down.append(powers(pow(base, -1, prime), prime, n + 1))

    def hashes(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two 62-bit numbers for each span, which don't depend on where it lies."""
        parts = []
        for h, down, prime in zip(self._h, self._down, PRIMES, strict=True):
            p = np.uint64(prime)
            parts.append((h[end] + p - h[start]) % p * down[start] % p)
        return (parts[0] << np.uint64(31) | parts[1]).view(np.int64), (parts[2] << np.uint64(31) | parts[3]).view(np.int64)

    def equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the spans of this length at a and b are equal."""
        low, high = np.minimum(a, b), np.maximum(a, b)
        same = np.ones(np.shape(low), bool)
        for h, up, prime in zip(self._h, self._up, PRIMES, strict=True):
            p = np.uint64(prime)
            left = (h[low + length] + p - h[low]) % p * up[high - low] % p
            same &= left == (h[high + length] + p - h[high]) % p
        return same

    def common(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How many code points from a and from b on agree, up to limit; all by one binary search."""
        low, high = np.zeros_like(limit), limit.copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.equal(a, b, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low


_TYPE = "n_chars bigint, fingerprint_a bigint, fingerprint_b bigint, n_lines bigint, repeat_length bigint, repeat_at bigint, repeat_of bigint"
_NEWLINE = 10


def _describe(texts: pa.Array) -> list[pa.Array]:
    missing = texts.is_null()
    texts = texts.fill_null("")
    n = len(texts)
    points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.zeros(n + 1, np.int64)
    np.cumsum(pc.utf8_length(texts).to_numpy(), out=first[1:])
    p = Prefixes(points)
    a, b = p.hashes(first[:-1], first[1:])

    # lines: cut at line feeds and at the ends of texts, empty ones left out
    feed = np.flatnonzero(points == _NEWLINE)
    starts = np.union1d(first[:-1], feed + 1)
    starts = starts[starts < len(points)]
    ends = np.minimum(np.r_[starts[1:], len(points)], len(points)) if len(starts) else starts
    ends = ends - (points[ends - 1] == _NEWLINE) if len(starts) else ends
    starts, ends = starts[ends > starts], ends[ends > starts]
    doc = np.searchsorted(first, starts, "right") - 1
    lines = np.bincount(doc, minlength=n)

    length, at, of = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    if len(starts):
        x, y = p.hashes(starts, ends)
        order = np.lexsort((starts, y, x, doc))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (np.diff(doc[order]) != 0) | (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0)
        source = starts[order][np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))]
        again = ~fresh
        s, o, d = starts[order][again], source[again], doc[order][again]
        reach = p.common(o, s, first[d + 1] - s)
        pick = np.lexsort((s, -reach, d))
        lead = np.ones(len(pick), bool)
        lead[1:] = np.diff(d[pick]) != 0
        w = pick[lead]
        length[d[w]], at[d[w]], of[d[w]] = reach[w], s[w] - first[d[w]], o[w] - first[d[w]]
    none = pa.array(at < 0)
    null = pa.scalar(None, pa.int64())
    whole = [pc.utf8_length(texts), pa.array(a), pa.array(b), pa.array(lines.astype(np.int64)), pa.array(length)]
    rest = [pc.if_else(none, null, pa.array(at)), pc.if_else(none, null, pa.array(of))]
    return [pc.if_else(missing, null, c.cast(pa.int64())) for c in [*whole, *rest]]


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The fingerprint of every text, and the longest passage that a repeated line begins, against the line's first occurrence.

    A row of docs gives (doc_id, n_chars, fingerprint_a, fingerprint_b, n_lines, repeat_length,
    repeat_at, repeat_of): code points, two 62-bit halves of the fingerprint, lines that aren't
    empty, and, among the lines that an earlier line of the text equals, the one from which on
    the text agrees longest with itself from the first such line on (repeat_of); repeat_at and
    repeat_of count code points from 0.  Equal texts have equal fingerprints wherever they are.
    No shuffle: texts are read once, as a whole.

    Defined cases: a null text has nulls; an empty text has the fingerprint 0, 0; a text
    without a repeated line has the repeat_length 0 and null places; of equally long repeats
    the first counts; rows that repeat a doc_id or have none give a row each; an empty table
    gives no rows; other columns are ignored.
    """
    src = documents_only(docs, doc_id, text).select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", *(c.split()[0] for c in _TYPE.split(", "))]
        for part in byte_slices(batches, "text", _SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([part.column(0), *_describe(part.column(1))], names)

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, {_TYPE}")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def _sql_hash(i: int) -> str:
    return f"list_reduce(list_reverse(cs), lambda h, c: (h * {BASES[i]} + c) % {PRIMES[i]}, 0::BIGINT)"


_ORACLE = f"""
WITH d AS (SELECT doc_id, text, length(text)::BIGINT AS n, list_filter(list_transform(string_split(text, ''), lambda c: ord(c)::BIGINT), lambda c: c > 0) AS cs FROM documents),
f AS (SELECT doc_id, n, {", ".join(f"{_sql_hash(i)} AS h{i}" for i in range(4))} FROM d),
u AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
l AS (SELECT doc_id, line, (sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(line) - 1)::BIGINT AS pos FROM u),
k AS (SELECT doc_id, pos, min(pos) OVER (PARTITION BY doc_id, line) AS src FROM l WHERE line <> ''),
c AS (SELECT doc_id, count(*) AS lines FROM k GROUP BY 1),
r AS (SELECT k.doc_id, k.pos, k.src, coalesce(list_filter(range(0, n - pos), lambda j: cs[pos + j + 1] <> cs[src + j + 1])[1], n - pos) AS reach FROM k JOIN d USING (doc_id) WHERE src < pos),
b AS (SELECT doc_id, reach, pos, src FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY reach DESC, pos) = 1)
SELECT f.doc_id, n AS n_chars, h0 * 2147483648 + h1 AS fingerprint_a, h2 * 2147483648 + h3 AS fingerprint_b, coalesce(lines, 0) AS n_lines,
  coalesce(reach, 0)::BIGINT AS repeat_length, pos AS repeat_at, src AS repeat_of
FROM f LEFT JOIN c USING (doc_id) LEFT JOIN b USING (doc_id)
"""

QUERIES = {"op1_fingerprints": op1_fingerprints}
ORACLE = {"op1_fingerprints": _ORACLE}
