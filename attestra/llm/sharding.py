"""Sharding by longest-processing-time scheduling.

Groups that must stay together go, largest first, each to the shard that holds least,
taken from a heap.  Groups of one size are interchangeable for that, so the heap runs
over the histogram of group sizes on the driver.  Distinct sizes add up to no more than
the corpus, so there are at most sqrt(2 x its bytes) of them: 14 million for 100 TB, 16
bytes each as they reach the driver.  Each class of equal sizes is filled as a whole, and
the groups then find their shard by their rank in their class, in parallel.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestra.llm.tables import documents_only, kept, table

SHARDS = 64


def lpt_runs(sizes: list[int], counts: list[int], shards: int) -> list[tuple[int, int, int, int]]:
    """Runs (size, first, last, shard): the groups of this size with ranks first to last go to the shard.

    ``sizes`` are distinct.  Exactly the schedule of taking the groups one by one, largest
    first and equal ones in the order of their ranks, with a heap of (load, shard); only,
    the groups that one shard gets of one size have consecutive ranks.  A class of m
    groups costs O(min(m, shards) log shards), whatever m is.
    """
    heap = [(0, j) for j in range(shards)]
    runs = []
    for size, m in sorted(zip(sizes, counts, strict=True), reverse=True):
        if m <= shards or size == 0:
            got: dict[int, int] = {}
            if size == 0:
                got[heap[0][1]] = m
            else:
                for _ in range(m):
                    load, j = heapq.heappop(heap)
                    got[j] = got.get(j, 0) + 1
                    heapq.heappush(heap, (load + size, j))
        else:
            loads = np.zeros(shards, object)
            for load, j in heap:
                loads[j] = load
            # shard j takes the groups t = 0, 1, .. for which (load + t * size, j) is among the m least
            def below(x: int) -> list[int]:
                return [max(0, -((int(v) - x) // size)) if x > v else 0 for v in loads]

            low, high = min(map(int, loads)), max(map(int, loads)) + size * (m + 1)
            while low < high:  # the least x with at least m takings at a load under x
                mid = (low + high) // 2
                if sum(below(mid)) >= m:
                    high = mid
                else:
                    low = mid + 1
            take = below(low)
            over = sum(take) - m
            # those at load low - 1 tie; the shards with the highest numbers go without
            for j in range(shards - 1, -1, -1):
                if over and take[j] and int(loads[j]) + (take[j] - 1) * size == low - 1:
                    take[j] -= 1
                    over -= 1
            got = {j: t for j, t in enumerate(take) if t}
            heap = [(int(loads[j]) + take[j] * size, j) for j in range(shards)]
            heapq.heapify(heap)
        first = 1
        for j in sorted(got):
            runs.append((size, first, first + got[j] - 1, j))
            first += got[j]
    return runs


def shard_groups(groups: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(group_key, size, shard) of each row of groups(group_key string, size bigint), whose keys are distinct.

    Of equal sizes, the one with the least md5 of its key comes first.
    """
    spark = groups.sparkSession
    if shards < 1:
        raise ValueError("shards must be at least 1")
    # ranks in a class are counted by cells of 1/256 of the md5 range, so that no class is one task
    g = kept(groups.withColumn("m", F.md5(F.coalesce("group_key", F.lit("")).cast("binary"))).withColumn("cell", F.substring("m", 1, 2)), "groups")
    cells = g.groupBy("size", "cell").agg(F.count("*").alias("n"))
    cells = cells.withColumn("before", F.sum("n").over(Window.partitionBy("size").orderBy("cell")) - F.col("n"))
    rank = F.row_number().over(Window.partitionBy("size", "cell").orderBy("m", "group_key"))
    ranked = g.withColumn("r", rank).join(cells.select("size", "cell", "before"), ["size", "cell"]).select("group_key", "size", (F.col("before") + F.col("r")).alias("rank"))
    # flat Arrow columns, not rows of Python numbers
    classes = g.groupBy("size").agg(F.count("*").alias("n")).toArrow().combine_chunks()
    runs = lpt_runs(classes.column("size").to_pylist(), classes.column("n").to_pylist(), shards)
    if not runs:
        return ranked.select("group_key", "size", F.lit(0).alias("shard"))
    # one row a size, with its runs in order; a group finds its run among them
    size, _, last, of = (np.array(c, np.int64) for c in zip(*runs, strict=True))
    fresh = np.flatnonzero(np.r_[True, size[1:] != size[:-1]])
    pairs = pa.StructArray.from_arrays([pa.array(last), pa.array(of.astype(np.int32))], ["last", "shard"])
    lists = pa.ListArray.from_arrays(pa.array(np.r_[fresh, len(size)].astype(np.int32)), pairs)
    by_size = spark.createDataFrame(pa.table({"size": size[fresh], "runs": lists}))
    found = ranked.join(by_size, "size")
    return found.select("group_key", "size", F.expr("filter(runs, x -> x.last >= rank)[0].shard").alias("shard"))


def shard(docs: DataFrame, shards: int = SHARDS, group: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, shard) of every row of docs; rows of one group share a shard, and shards hold about as many bytes of text.

    Without ``group``, documents with the same text are a group, so that no copy gets into
    another shard.

    Defined cases: rows whose group (or text) is null are one group, as with GROUP BY; null
    and empty texts have the size 0; groups of size 0 go to the shard that then holds least;
    a group larger than the mean shard has a shard mostly to itself; rows that repeat a
    doc_id give as many rows; an empty table gives no rows; other columns are ignored.
    """
    src = documents_only(docs, *dict.fromkeys([doc_id, text, *([group] if group else [])]))
    body = F.col(f"`{text}`").cast("string")
    key = F.col(f"`{group}`").cast("string") if group else F.md5(body.cast("binary"))
    rows = kept(src.select(F.col(f"`{doc_id}`").alias("doc_id"), key.alias("group_key"), F.coalesce(F.octet_length(body), F.lit(0)).cast("bigint").alias("bytes")), "members")
    groups = rows.groupBy("group_key").agg(F.sum("bytes").alias("size"))
    placed = shard_groups(groups, shards).select(F.col("group_key").alias("k"), "shard")
    return rows.join(placed, F.col("group_key").eqNullSafe(F.col("k"))).select("doc_id", "shard")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


_ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, md5(text) AS k, coalesce(strlen(text), 0) AS b FROM documents),
g AS (SELECT k, sum(b)::BIGINT AS size, md5(coalesce(k, '')) AS m FROM d GROUP BY k),
o AS (SELECT k, size, m, row_number() OVER (ORDER BY size DESC, m, k) AS i FROM g),
lpt AS (
  SELECT 0::BIGINT AS i, list_transform(range({SHARDS}), lambda x: 0::BIGINT) AS loads, 0 AS shard
  UNION ALL
  SELECT o.i, list_transform(loads, lambda v, j: CASE WHEN j = list_position(loads, list_min(loads)) THEN v + o.size ELSE v END),
    (list_position(loads, list_min(loads)) - 1)::INT
  FROM lpt JOIN o ON o.i = lpt.i + 1),
taken AS (SELECT o.k, o.size, o.m, lpt.shard FROM o JOIN lpt ON o.i = lpt.i),
-- of one size, the shards take consecutive ranks in the order of their numbers
a AS (SELECT size, k, row_number() OVER (PARTITION BY size ORDER BY m, k) AS r FROM taken),
b AS (SELECT size, shard, row_number() OVER (PARTITION BY size ORDER BY shard) AS r FROM taken)
SELECT d.doc_id, b.shard FROM d JOIN a ON a.k IS NOT DISTINCT FROM d.k JOIN b ON b.size = a.size AND b.r = a.r
"""

QUERIES = {"op2_sharding": op2_sharding}
ORACLE = {"op2_sharding": _ORACLE}
