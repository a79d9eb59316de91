"""Owner-disjoint splits: lineage components and seeded allocation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.sources.shared import kept, shared_folder

SPLITS = ("train", "validation", "test")


def _written(df: DataFrame, folder: str) -> DataFrame:
    return kept(df, "components", folder)


def components(edges: DataFrame, a: str, b: str, folder: str) -> DataFrame:
    """(node, component): the least node that each node is connected with.

    Labels spread to the least of a node's neighbours and, by one more join, to that one's
    own label, so rounds grow with the logarithm of chains; each round is written to
    ``folder``, which all executors must share.
    """
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x is not null and y is not null")
    both = _written(e.union(e.select("y", "x")).distinct(), folder)
    label = _written(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("l")), folder)
    while True:
        near = both.join(label.select(F.col("x").alias("y"), "l"), "y").groupBy("x").agg(F.min("l").alias("m"))
        step = label.join(near, "x").select("x", F.least("l", "m").alias("n"), "l")
        jump = step.join(label.select(F.col("x").alias("n"), F.col("l").alias("j")), "n", "left").select("x", F.least("n", F.coalesce("j", "n")).alias("n"), "l")
        done = _written(jump, folder)
        if done.filter("n <> l").isEmpty():
            return done.select(F.col("x").alias("node"), F.col("n").alias("component"))
        label = done.select("x", F.col("n").alias("l"))


def seats(groups: Column, ratios: tuple[float, float, float] = (0.6, 0.2, 0.2)) -> list[Column]:
    """How many of so many groups each split gets: its share rounded down, one at least, and what is left by largest remainder, train first.

    Fewer groups than splits are an error of the job.
    """
    shares = [groups * F.lit(r) for r in ratios]
    base = [F.greatest(F.lit(1), F.floor(x)) for x in shares]
    rest = [x - b for x, b in zip(shares, base, strict=True)]
    left = groups - sum(base[1:], base[0])
    ahead = [sum(((rest[j] >= rest[i] if j < i else rest[j] > rest[i]).cast("int") for j in range(3) if j != i), F.lit(0)) for i in range(3)]
    few = F.raise_error(F.lit("a domain has too few groups for the splits")).cast("bigint")
    return [F.when(groups < len(ratios), few).otherwise(base[i] + (ahead[i] < left).cast("int")) for i in range(3)]


def assign(groups: DataFrame, domain: str, key: str, seed: int, ratios: tuple[float, float, float] = (0.6, 0.2, 0.2)) -> DataFrame:
    """(domain, key, split): in each domain, groups in the order of a seeded hash fill train, then validation, then test."""
    h = F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 256)
    ranked = groups.select(domain, key).distinct().withColumn("r", F.row_number().over(Window.partitionBy(domain).orderBy(h, key)))
    sizes = ranked.groupBy(domain).agg(F.count("*").alias("n"))
    train, validation, _ = seats(F.col("n"), ratios)
    sizes = sizes.select(F.col(domain).alias("__domain"), train.alias("train"), (train + validation).alias("both"))
    split = F.when(F.col("r") <= F.col("train"), "train").when(F.col("r") <= F.col("both"), "validation").otherwise("test")
    return ranked.join(sizes, F.col(domain).eqNullSafe(F.col("__domain"))).select(domain, key, split.alias("split"))


def owner_disjoint(repositories: DataFrame, key: str, domain: str, lineage: str, seed: int, ratios: tuple[float, float, float] = (0.6, 0.2, 0.2), blocks: DataFrame | None = None, folder: str | None = None) -> DataFrame:
    """(domain, key, component, split) of every repository; those that share a lineage, directly or by others, are in one split.

    ``blocks`` (key, lineage) tie repositories besides.  A component in two domains is an
    error of the job.
    """
    ties = repositories.select(key, F.concat(F.lit("repository:"), F.col(lineage).cast("string")).alias("tie"))
    if blocks is not None:
        ties = ties.unionByName(blocks.select(key, F.concat(F.lit("block:"), F.col(lineage).cast("string")).alias("tie")))
    # a star about the least member of each lineage, so a lineage of n members has n edges
    least = ties.groupBy("tie").agg(F.min(key).alias("least"))
    joined = components(ties.join(least, "tie"), key, "least", folder or shared_folder(repositories.sparkSession))
    placed = repositories.select(domain, key).join(joined.withColumnRenamed("node", key), key)
    domains = placed.groupBy("component").agg(F.min(domain).alias("low"), F.max(domain).alias("high"))
    one = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.raise_error(F.lit("a lineage spans domains")).cast(placed.schema[domain].dataType))
    splits = assign(domains.select(one.alias(domain), "component"), domain, "component", seed, ratios)
    return placed.join(splits.select("component", "split"), "component").select(domain, key, "component", "split")
