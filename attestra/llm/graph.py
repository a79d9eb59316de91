"""Connected components of large edge lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.skew import HOT, hot_keys, sample, with_groups
from attestra.llm.tables import kept, release


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that an edge touches; root is the least node of its component.

    Alternates the large-star and small-star steps until the edge list no longer
    changes; each round is two shuffles over the edges, in which the edges of a node with
    very many are spread, and its results are written tables, so lineage stays short.  An
    edge with a null end or with equal ends says nothing and is left out.  No edges give no
    rows.
    """
    e = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a > b").distinct()
    e = kept(e, "edges")
    seen = None
    while True:
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if (state["n"], state["s"]) == seen:
            break
        seen = (state["n"], state["s"])
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        many = 2 * state["n"] >= HOT  # fewer edges have no node with too many
        least = with_groups(both, ["a"], hot_keys(sample(both), ["a"]) if many else None, least=F.min("b"))
        large = least.filter("b > a").select(F.col("b").alias("a"), F.least("a", "least").alias("b")).distinct()
        large = kept(large, "edges") if many else large
        small = with_groups(large, ["a"], hot_keys(sample(large), ["a"]) if many else None, m=F.min("b"))
        small = small.select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("x")).select(F.col("x.b").alias("a"), F.col("x.m").alias("b"))
        after = kept(small.filter("a > b").distinct(), "edges")
        release(e)
        if many:
            release(large)
        e = after
    stars = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
