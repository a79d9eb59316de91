"""Packing documents into bins of a fixed number of tokens: best fit, then swap-based local search.

Documents meet in cells of about CELL pieces, chosen by a hash, and each cell is packed
for itself, so the work is spread and the number of cells grows with the corpus.  The
underfull bins of all cells then meet in cells of as many pieces, and are packed again.
"""

from __future__ import annotations

import bisect
import heapq
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestra.llm.tables import documents_only, kept, table
from attestra.llm.tokens import token_length

CAPACITY = 8192
CELL = 4000
#: So many rows with one id and length are numbered by one task.
CHUNK = 1 << 16
#: Bins filled less than this are underfull; local search tries to empty them.
UNDERFULL = 0.98


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[list[list[int]], list[int]]:
    """Bins (item numbers) and their fills: items, largest first, go to the fullest bin that has room."""
    order = np.argsort(-sizes, kind="stable")
    bins: list[list[int]] = []
    fill: list[int] = []
    room: list[tuple[int, int]] = []  # (room left, bin), sorted
    for i in order.tolist():
        s = int(sizes[i])
        at = bisect.bisect_left(room, (s, -1))
        if at < len(room):
            left, b = room.pop(at)
            bins[b].append(i)
            fill[b] += s
            left -= s
        else:
            b, left = len(bins), capacity - s
            bins.append([i])
            fill.append(s)
        if left:
            bisect.insort(room, (left, b))
    return bins, fill


def _pairs(items: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sums, first items, second items): a pair of items for every two sizes that two items have."""
    items = items[np.argsort(sizes[items], kind="stable")]
    u, first, count = np.unique(sizes[items], return_index=True, return_counts=True)
    i, j = np.triu_indices(len(u))
    there = (i != j) | (count[i] > 1)
    i, j = i[there], j[there]
    return u[i] + u[j], items[first[i]], items[first[j] + (i == j)]


class _Search:
    """Bins under local search: arrays of all items with their bins, so that one exchange changes two bins only."""

    def __init__(self, bins: list[list[int]], fill: list[int], sizes: np.ndarray, capacity: int):
        n = len(bins)
        self.bins, self.sizes, self.capacity = bins, sizes, capacity
        self.fill = np.asarray(fill, np.int64)
        self.room = capacity - self.fill
        # what a bin may give back: nothing (entry b for bin b) or an item (entry n + item)
        self.back = np.concatenate([np.zeros(n, np.int64), sizes])
        self.of = np.concatenate([np.arange(n), np.zeros(len(sizes), np.int64)])
        for b, items in enumerate(bins):
            self.of[n + np.asarray(items)] = b
        self._twos: list = [None] * n
        self._flat: tuple | None = None
        self._stale: set[int] = set()

    def twos(self, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self._twos[b] is None:
            sums, i, j = _pairs(np.asarray(self.bins[b]), self.sizes)
            order = np.argsort(sums, kind="stable")
            self._twos[b] = sums[order], i[order], j[order]
        return self._twos[b]

    def _joined(self, which) -> tuple:
        """(sums, first items, second items, bins) of the pairs of those of these bins that have room."""
        which = [b for b in which if self.room[b] > 0 and self.bins[b]]
        each = [self.twos(b) for b in which] or [(np.zeros(0, np.int64),) * 3]
        owners = np.repeat(np.asarray(which, np.int64), [len(e[0]) for e in each][: len(which)])
        return (*(np.concatenate([e[k] for e in each]) for k in range(3)), owners)

    def _all_twos(self) -> tuple:
        """The pairs of all bins, taken from the last full list and, for bins changed since, anew."""
        if self._flat is None or len(self._stale) > 64:
            self._flat, self._stale = self._joined(range(len(self.bins))), set()
        if not self._stale:
            return self._flat
        fresh = self._joined(sorted(self._stale))
        old = np.where(np.isin(self._flat[3], list(self._stale)), -1, self._flat[3])
        return (*(np.concatenate([self._flat[k], fresh[k]]) for k in range(3)), np.concatenate([old, fresh[3]]))

    def find(self, a: int, others: np.ndarray | None = None) -> tuple[int, list[int], list[int]] | None:
        """The exchange (bin, items to give, items to take) between a and one of ``others`` (all by default) that adds most to the sum of squared fills.

        An exchange takes one item, or two, from a for nothing or one item of the other bin,
        or one item from a for two of the other: a net shift of d > 0 words to the other bin.
        The gain d * (d + other's fill - a's fill) is greatest for the greatest d that fits, so
        for each thing to take back one search among the sorted things to give finds the best.
        The last kind is the dearest, and is tried only where the others find nothing.
        """
        n = len(self.bins)
        mine = np.asarray(self.bins[a])
        mine = mine[np.argsort(self.sizes[mine], kind="stable")]
        if others is None:
            entries, back, of = None, self.back, self.of
        else:
            entries = np.concatenate([others, *(n + np.asarray(self.bins[b], np.int64) for b in others)])
            back, of = self.back[entries], self.of[entries]

        def best(give: np.ndarray, back: np.ndarray, of: np.ndarray) -> tuple[int, int, int]:
            at = np.searchsorted(give, back + self.room[of], "right") - 1
            d = np.where(at >= 0, give[at] - back, 0)
            gain = np.where((d > 0) & (of >= 0) & (of != a), d * (d + self.fill[of] - self.fill[a]), 0)
            k = int(gain.argmax())
            return int(gain[k]), k, int(at[k])

        found, most = None, 0
        gives = [(self.sizes[mine], (mine,))]
        if len(mine) > 1:
            sums, x, y = self.twos(a)
            gives.append((sums, (x, y)))
        for sums, items in gives:
            gain, k, g = best(sums, back, of)
            if gain > most:
                entry = k if entries is None else int(entries[k])
                most, found = gain, (int(of[k]), [int(x[g]) for x in items], [] if entry < n else [entry - n])
        if found is None:
            sums, x, y, of = self._all_twos() if others is None else self._joined(others)
            if len(sums):
                gain, k, g = best(self.sizes[mine], sums, of)
                if gain > 0:
                    found = int(of[k]), [int(mine[g])], [int(x[k]), int(y[k])]
        return found

    def apply(self, a: int, b: int, gives: list[int], takes: list[int]) -> None:
        n = len(self.bins)
        d = int(self.sizes[gives].sum() - (self.sizes[takes].sum() if takes else 0))
        self.bins[a] = [x for x in self.bins[a] if x not in gives] + takes
        self.bins[b] = [x for x in self.bins[b] if x not in takes] + gives
        self.of[n + np.asarray(gives)] = b
        self.of[n + np.asarray(takes, np.int64)] = a
        for c, more in ((a, -d), (b, d)):
            self.fill[c] += more
            self.room[c] = self.capacity - self.fill[c] if self.bins[c] else 0  # an empty bin takes nothing any more
            self._twos[c] = None
            self._stale.add(c)


def improve(bins: list[list[int]], fill: list[int], sizes: np.ndarray, capacity: int, underfull: float = UNDERFULL) -> None:
    """Exchange until no underfull bin has an exchange that raises the sum of squared fills; bins that empty are dropped.

    Every exchange raises that sum by at least one, so this ends.  A bin that found nothing
    looks again only at bins that have changed since.
    """
    search = _Search(bins, fill, sizes, capacity)
    n, clock = len(bins), 0
    changed, stuck = np.zeros(n, np.int64), np.full(n, -1)  # when a bin last changed, and last found nothing
    low = lambda b: bool(bins[b]) and search.fill[b] < underfull * capacity
    while todo := [(int(search.fill[b]), b) for b in range(n) if low(b) and stuck[b] < clock]:
        heapq.heapify(todo)
        while todo:
            f, a = heapq.heappop(todo)
            if f != search.fill[a] or not low(a) or stuck[a] >= clock:
                continue
            others = np.flatnonzero(changed > stuck[a]) if stuck[a] >= changed[a] else None
            found = search.find(a, others if others is not None and 4 * len(others) < n else None)
            if found is None:
                stuck[a] = clock
                continue
            search.apply(a, *found)
            clock += 1
            for c in (a, found[0]):
                changed[c] = clock
                if low(c):
                    heapq.heappush(todo, (int(search.fill[c]), c))
    keep = [b for b in range(n) if bins[b]]
    bins[:], fill[:] = [bins[b] for b in keep], [int(search.fill[b]) for b in keep]


def pack_sizes(sizes: np.ndarray, capacity: int, underfull: float = UNDERFULL, start: list[list[int]] | None = None) -> list[list[int]]:
    """Bins of item numbers for sizes of 1 to capacity: best fit, or the bins ``start`` if they are fewer, then exchanges."""
    bins, fill = best_fit(sizes, capacity)
    if start is not None and len(start) < len(bins):
        bins, fill = [list(b) for b in start], [int(sizes[b].sum()) for b in start]
    improve(bins, fill, sizes, capacity, underfull)
    return bins


_PIECE = "doc_id bigint, copy bigint, piece bigint, start bigint, tokens bigint, bin bigint"


def _pieces(sized: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, copy, piece, start, tokens) of sized(doc_id, n, rows), which has one row for all rows with this id and length.

    Such rows can't be told apart by what is returned, so they are numbered without a look at
    each; many of them are numbered by several tasks.
    """
    at = Window.partitionBy("doc_id").orderBy("n")  # one row a length
    numbered = sized.withColumn("before", F.sum("rows").over(at) - F.col("rows"))
    parts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("rows") - 1) / F.lit(CHUNK)).cast("bigint"))).alias("part")
    few = numbered.filter(F.col("rows") <= CHUNK).select("*", F.lit(0).cast("bigint").alias("part"))
    many = numbered.filter(F.col("rows") > CHUNK).select("*", parts).repartition("doc_id", "n", "part")
    each = F.sequence(F.col("part") * CHUNK + 1, F.least(F.col("rows"), (F.col("part") + 1) * CHUNK))
    rows = few.unionByName(many).select("doc_id", "n", "before", F.explode(each).alias("k"))
    last = F.greatest(F.ceil(F.col("n") / F.lit(capacity)), F.lit(1)).cast("bigint") - 1
    cut = rows.select("doc_id", (F.col("before") + F.col("k")).alias("copy"), "n", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece"))
    return cut.select("doc_id", "copy", "piece", (F.col("piece") * capacity).alias("start"), F.least(F.col("n") - F.col("piece") * capacity, F.lit(capacity)).cast("bigint").alias("tokens"))


def pack(docs: DataFrame, capacity: int = CAPACITY, cell: int = CELL, underfull: float = UNDERFULL, measure: Callable[[Column], Column] = token_length, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, copy, piece, start, tokens, bin): the pieces of each row of docs and their bins, which hold at most ``capacity`` tokens.

    ``measure`` tells how many tokens a text has; by default those of token_counts().  A
    document longer than a bin is cut into pieces of ``capacity`` tokens and a last one of
    the rest; ``start`` is the number of tokens before the piece.  ``copy`` numbers the rows
    that share a doc_id, shorter ones first, so (doc_id, copy, piece) names a piece.  Pieces
    are packed in cells of about ``cell``; what the underfull bins of all cells hold is then
    packed once more, in cells of as many.  Bins are numbered cell * 2^24 + number in the cell.

    Defined cases: a null, empty or blank text has one piece of no tokens, with a null bin
    (blank by the measure: for tokens, white space counts); rows with a null doc_id are
    packed like others, as copies of one another; rows that repeat a doc_id are packed each
    for itself, and any number of them is spread over cells; ties in size go by doc_id, copy
    and piece; an empty table gives no rows; other columns are ignored.
    """
    if capacity < 1 or cell < 1:
        raise ValueError("capacity and cell must be at least 1")
    src = documents_only(docs, doc_id, text).select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), measure(F.col(f"`{text}`").cast("string")).alias("n"))
    sized = kept(src.groupBy("doc_id", "n").agg(F.count("*").alias("rows")), "sizes")
    n_pieces = sized.agg(F.sum(F.ceil(F.col("n") / F.lit(capacity)) * F.col("rows"))).first()[0]
    cells = max(1, math.ceil(int(n_pieces or 0) / cell))
    pieces = _pieces(sized, capacity)
    placed = pieces.filter("tokens > 0").withColumn("cell", F.pmod(F.xxhash64("doc_id", "copy", "piece"), F.lit(cells)))

    def run(first: int):
        def pack_cell(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(["tokens", "doc_id", "copy", "piece"], ascending=[False, True, True, True], kind="stable", na_position="first").reset_index(drop=True)
            sizes = group["tokens"].to_numpy(np.int64)
            start = [list(x) for x in group.groupby("bin", sort=True).indices.values()] if "bin" in group else None
            number, is_open = np.zeros(len(group), np.int64), np.zeros(len(group), bool)
            for b, items in enumerate(pack_sizes(sizes, capacity, underfull, start)):
                number[items] = (first + int(key[0]) << 24) + b
                is_open[items] = sizes[items].sum() < underfull * capacity
            return group[["doc_id", "copy", "piece", "start", "tokens"]].assign(bin=number, open=is_open)

        return pack_cell

    packed = placed.groupBy("cell").applyInPandas(run(0), f"{_PIECE}, open boolean")
    if cells > 1:
        packed = kept(packed, "packed")
        again = packed.filter("open").drop("open")
        wide = max(1, math.ceil(again.count() / cell))
        again = again.withColumn("cell", F.pmod(F.xxhash64("bin"), F.lit(wide))).groupBy("cell").applyInPandas(run(cells), f"{_PIECE}, open boolean")
        packed = packed.filter("not open").unionByName(again)
    blank = pieces.filter("tokens = 0").withColumn("bin", F.lit(None).cast("bigint"))
    return packed.drop("open").unionByName(blank)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op4_packing": op4_packing}
ORACLE: dict[str, str] = {}
