"""MinHash near-duplicate detection with fast similarity sketching.

Sketch: each text's set of word shingles is thrown into ``bins`` bins, round after
round.  In rounds 0 to bins - 1 a shingle lands in a hashed bin with the value
round + u, u hashed into [0, 1); in rounds bins to 2 bins - 1 every shingle lands
in the one bin round - bins.  A bin keeps its least value, and a text stops after
the first round that leaves no bin empty.  So every coordinate is filled, a long
text needs about one round, and the share of equal coordinates concentrates on the
Jaccard similarity as with independent samples.

Search: coordinates are cut into bands; texts that agree on a band meet in a
bucket.  Every candidate pair is then compared exactly, on its whole shingle sets.
Nothing is capped: within a bucket each text is first compared with the bucket's
least id, and only pairs whose two texts are not yet in one component are compared
after that.  Pairs left out by this are connected already, so the groups are the
same as if every pair in every bucket had been compared.

A bucket, or a group of copies, may hold a third of all texts: its rows are spread over
tasks (skew.py), and the pairs of a large bucket are formed block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm import kernels as K
from attestra.llm.graph import components
from attestra.llm.skew import hot_keys, sample, with_groups
from attestra.llm.tables import documents_only, free_name, kept, release, table

SHINGLE = 3
THRESHOLD = 0.5
BANDS = 56
ROWS = 4
SEED = 7
#: Texts of a bucket whose pairs are formed by one task.
BLOCK = 1024
_FULL = np.iinfo(np.uint64).max


def sketch(values: np.ndarray, doc: np.ndarray, n: int, bins: int, seed: int = SEED) -> np.ndarray:
    """The n x bins coordinates of n sets; ``values`` belong to the sets ``doc``.  A set without values stays empty (all ones)."""
    out = np.full(n * bins, _FULL, np.uint64)
    seeds = np.random.default_rng(seed).integers(0, 2**63, 2 * bins, dtype=np.uint64)
    low = np.uint64(0xFFFFFFFF)
    for r in range(2 * bins):
        if not len(values):
            break
        h = K.mix64(values ^ seeds[r])
        v = (np.uint64(r) << np.uint64(32)) | (h & low)
        at = ((h >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32) if r < bins else np.uint64(r - bins)
        np.minimum.at(out, doc * bins + np.asarray(at, np.int64), v)
        which = np.unique(doc) if r else np.arange(n)
        gaps = np.zeros(n, bool)
        gaps[which] = (out.reshape(n, bins)[which] == _FULL).any(axis=1)
        again = gaps[doc]
        if not again.all():
            values, doc = values[again], doc[again]
    return out.reshape(n, bins)


def band_keys(coordinates: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of each sketch."""
    n = len(coordinates)
    parts = coordinates[:, : bands * rows].reshape(n, bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (n, bands)).copy()
    for j in range(rows):
        key = K.mix64(key ^ K.mix64(parts[:, :, j] + np.uint64(j + 1)))
    return key


_SKETCH_TYPE = "doc_id bigint, h1 bigint, h2 bigint, bands array<bigint>"


def _sketches(shingle: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in K.byte_slices(batches, "text"):
            words = K.Words(*K.utf8_parts(part.column(1)))
            h = words.hashes(fold=True)
            n = part.num_rows
            values, doc = K.shingles(words, h, shingle)
            keys = band_keys(sketch(values, doc, n, bands * rows), bands, rows).view(np.int64)
            keep = words.counts > 0
            m = int(keep.sum())
            first, second = K.whole(h, words.first), K.whole(K.mix64(h + np.uint64(1)), words.first)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).filter(pa.array(keep)),
                    pa.array(first[keep].view(np.int64)),
                    pa.array(second[keep].view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * bands), pa.array(keys[keep].ravel())),
                ],
                ["doc_id", "h1", "h2", "bands"],
            )

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in K.byte_slices(batches, "text"):
            values, at = K.shingle_sets(K.Words(*K.utf8_parts(part.column(1))), shingle)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.view(np.int64)))], ["doc_id", "shingles"])

    return run


def _similar(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have at least this Jaccard similarity."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y")).cast("double")
    joined = pairs.join(left, "a").join(right, "b")
    # a size test first: sets whose sizes alone rule the threshold out are not intersected
    fits = F.least(F.size("x"), F.size("y")) >= F.lit(threshold) * F.greatest(F.size("x"), F.size("y"))
    return joined.filter(fits).filter(both >= F.lit(threshold) * (F.size("x") + F.size("y") - both)).select("a", "b")


def _pairs(mixed: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Distinct (a, b) of two texts of one bucket in different components, from (key, doc_id, root).

    A bucket is cut into blocks of about BLOCK texts, and each two blocks meet in a task of their own.
    """
    counted = with_groups(mixed, ["key"], hot, m=F.count("*")).withColumn("blocks", F.ceil(F.col("m") / F.lit(BLOCK)).cast("bigint"))
    block = counted.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    other = block.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    placed = other.select("key", "doc_id", "root", "block", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))
    x, y = placed.alias("x"), placed.alias("y")
    met = x.join(y, F.expr("x.key = y.key and x.p = y.p and x.q = y.q and x.doc_id < y.doc_id and x.root <> y.root and (x.p = x.q or x.block <> y.block)"))
    return met.select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, group_id, keep) of every document that has a near or exact copy.

    Two documents are linked if the Jaccard similarity of their sets of ``shingle``-word
    shingles (ASCII capitals folded, white space ignored) is at least ``threshold``;
    groups are the connected components, ``group_id`` is the least doc_id of the group,
    and ``keep`` is true for that document alone.

    Defined cases: a null doc_id can't be named in a result and is left out; null, empty
    and blank texts have no shingles and are in no group; a text of fewer words than a
    shingle counts as one shingle; texts of any length are read whole; rows that repeat a
    doc_id are versions of one document, which is linked if any version is, and which
    alone makes no group; an empty table gives no rows; other columns are ignored.
    """
    src = documents_only(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    sk = kept(src.mapInArrow(_sketches(shingle, bands, rows), _SKETCH_TYPE), "sketches")

    # exact copies: tied to the least id with the same words, and searched as one
    prints = sk.select("doc_id", "h1", "h2")
    same = with_groups(prints, ["h1", "h2"], hot_keys(sample(prints), ["h1", "h2"]), a=F.min("doc_id"))
    copies = kept(same.filter("a < doc_id").distinct(), "copies")
    banded = lambda s: s.join(copies.select("doc_id", "h1", "h2"), ["doc_id", "h1", "h2"], "left_anti").select("doc_id", F.explode("bands").alias("key"))
    single = banded(sk)

    hot = hot_keys(banded(sample(sk)), ["key"])
    met = with_groups(single, ["key"], hot, leader=F.min("doc_id"), last=F.max("doc_id")).filter("leader < last").select("key", "doc_id", "leader").distinct()
    met = kept(met, "buckets")
    sets = src.join(met.select("doc_id").distinct(), "doc_id", "left_semi").mapInArrow(_sets(shingle), "doc_id bigint, shingles array<bigint>")
    sets = kept(sets, "sets")

    stars = met.filter("leader < doc_id").select(F.col("leader").alias("a"), F.col("doc_id").alias("b")).distinct()
    links = kept(_similar(stars, sets, threshold), "links")
    roots = components(links)

    # what is left: pairs in one bucket that are in different components and don't include its leader, who has met all
    marked = met.join(roots, met["doc_id"] == roots["node"], "left").select("key", "doc_id", "leader", F.coalesce("root", "doc_id").alias("root"))
    mixed = with_groups(marked, ["key"], hot, r1=F.min("root"), r2=F.max("root")).filter("r1 < r2 and doc_id <> leader").select("key", "doc_id", "root")
    more = kept(_similar(_pairs(mixed, hot), sets, threshold), "links")

    exact = copies.select("a", F.col("doc_id").alias("b"))
    groups = components(links.unionByName(exact).unionByName(more).distinct())
    for done in (sk, copies, met, sets, links, more):
        release(done)
    return groups.select(F.col("node").alias("doc_id"), F.col("root").alias("group_id"), (F.col("node") == F.col("root")).alias("keep"))


def drop_near_duplicates(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of docs but for documents that near_duplicates() doesn't keep; all columns, rows with a null doc_id included."""
    name = free_name("gone", docs)
    gone = near_duplicates(docs, **parameters).filter("not keep").select(F.col("doc_id").alias(name))
    return docs.join(gone, F.col("`doc_id`") == F.col(f"`{name}`"), "left_anti")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


_ORACLE = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{K.WORD_CLASS}') AS ws FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) < {SHINGLE} THEN [hash(array_to_string(ws, ' '))]
    ELSE list_transform(range(1, len(ws) - {SHINGLE - 2}), lambda i: hash(array_to_string(ws[i:i + {SHINGLE - 1}], ' '))) END) AS sh
  FROM w WHERE len(ws) > 0
), u AS (SELECT doc_id, unnest(sh) AS g FROM s), n AS (SELECT doc_id, len(sh) AS n FROM s),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM u x JOIN u y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE k >= {THRESHOLD} * (na.n + nb.n - k)),
e2 AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(node, root) AS (SELECT a, a FROM e2 UNION SELECT e2.b, r.root FROM r JOIN e2 ON e2.a = r.node)
SELECT node AS doc_id, min(root) AS group_id, node = min(root) AS keep FROM r GROUP BY node
"""

QUERIES = {"op3_near_dedup": op3_near_dedup}
ORACLE = {"op3_near_dedup": _ORACLE}
