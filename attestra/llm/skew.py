"""Aggregates beside the rows of their groups, where one group may hold a third of all rows.

A window does that in one shuffle, but a window's group is one task.  So the few hottest
keys are found first, in a sample; their groups are aggregated map-side and joined back,
which spreads their rows, and all other groups go through the window.  Which way a group
takes changes nothing in the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.llm.tables import kept

#: Share of the rows that are looked at to find hot keys.
SHARE = 1 / 16
#: Keys of about so many rows are hot, at most MOST of them, the hottest; of all rows a key beyond those has less than one in MOST.
HOT = 8192
MOST = 4096


def sample(df: DataFrame) -> DataFrame:
    """The rows of df among which hot_keys() counts."""
    return df.sample(SHARE, seed=17)


def hot_keys(sampled: DataFrame, keys: list[str]) -> DataFrame | None:
    """The hot keys of what sample() gave, a local table of at most MOST rows, or None."""
    counts = sampled.groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n") >= max(1, int(HOT * SHARE)))
    rows = counts.orderBy(F.desc("__n"), *keys).limit(MOST).drop("__n").collect()
    return sampled.sparkSession.createDataFrame(rows, sampled.select(*keys).schema) if rows else None


def split(df: DataFrame, hot: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of df whose keys aren't hot, and those whose keys are, written once."""
    return df.join(F.broadcast(hot), on, "left_anti"), kept(df.join(F.broadcast(hot), on, "left_semi"), "hot")


def with_groups(df: DataFrame, keys: list[str], hot: DataFrame | None, **aggregates: Column) -> DataFrame:
    """df with the aggregates of the rows that share its keys, none of which is null; ``hot`` is what hot_keys() found."""
    by = Window.partitionBy(*keys)
    windowed = lambda rows: rows.select("*", *[a.over(by).alias(name) for name, a in aggregates.items()])
    if hot is None:
        return windowed(df)
    cool, warm = split(df, hot, keys)
    cool = windowed(cool)
    stats = kept(warm.groupBy(*keys).agg(*[a.alias(name) for name, a in aggregates.items()]), "hot-groups")
    return cool.unionByName(warm.join(stats, keys).select(*cool.columns))
