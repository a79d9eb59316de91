"""Sparse text features, linear models over them, and ranking of evidence."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions import grams as G
from attestra.functions import text as T
from attestra.functions.stats import sigmoid


def _counts(df: DataFrame, key: str, text: str, read, sizes: tuple[int, ...] | None, unique: bool) -> DataFrame:
    """Counted per row in Arrow; rows of one key are added up, where ``unique`` doesn't rule them out."""
    kind = df.schema[key].dataType.simpleString()
    normal = df.filter(F.col(text).isNotNull()).select(key, read(T.normalize_ml(T.normalize_text(F.col(text)))).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, feature, n in G.batch_tally(b.column(1), sizes):
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), feature, pa.array(n, pa.int64())], [key, "feature", "n"])

    rows = normal.mapInArrow(run, f"`{key}` {kind}, feature string, n bigint")
    return rows if unique else rows.groupBy(key, "feature").agg(F.sum("n").alias("n"))


def word_counts(df: DataFrame, key: str, text: str, unique: bool = False) -> DataFrame:
    """(key, feature, n) of word 1- and 2-grams of the normalised text; with ``unique`` keys, one row each, without a shuffle."""
    return _counts(df, key, text, T.ml_words, None, unique)


def character_counts(df: DataFrame, key: str, text: str, unique: bool = False) -> DataFrame:
    """(key, feature, n) of character 3-, 4- and 5-grams."""
    return _counts(df, key, text, lambda c: c, (3, 4, 5), unique)


def idf(counts: DataFrame, documents: DataFrame, size: int = 20_000) -> DataFrame:
    """(feature, df, idf) of the ``size`` commonest features, ties by name."""
    n = documents.agg(F.count("*").alias("docs"))
    top = counts.groupBy("feature").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "feature").limit(size)
    return top.crossJoin(F.broadcast(n)).select("feature", "df", (F.log((1.0 + F.col("docs")) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def tfidf(counts: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    """(key, feature, weight): (1 + ln tf) idf, of length 1 for each key."""
    raw = counts.join(F.broadcast(weights.select("feature", "idf")), "feature").select(key, "feature", ((1.0 + F.log("n")) * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return raw.select(key, "feature", (F.col("w") / norm).alias("weight"))


def predict(vectors: DataFrame, coefficients: DataFrame, intercept: float, key: str) -> DataFrame:
    """(key, probability) by coefficients(feature, coefficient)."""
    z = vectors.join(coefficients, "feature", "left").groupBy(key).agg(F.sum(F.col("weight") * F.coalesce("coefficient", F.lit(0.0))).alias("z"))
    return z.select(key, sigmoid(F.col("z") + intercept).alias("probability"))


def train_logistic(vectors: DataFrame, labels: DataFrame, key: str, epochs: int = 200, rate: float = 0.8, l2: float = 0.001) -> tuple[list[tuple[str, float]], float]:
    """Coefficients and intercept by full-batch gradient descent; each step is one aggregation, and only gradients reach the driver.

    The number of features is bounded by what idf() keeps.
    """
    spark = vectors.sparkSession
    data = vectors.join(labels.select(key, F.col("label").cast("double").alias("y")), key).cache()
    n = data.select(key).distinct().count()
    w: dict[str, float] = {}
    b = 0.0
    schema = "feature string, coefficient double"
    for _ in range(epochs if n else 0):
        now = spark.createDataFrame(list(w.items()), schema)
        p = data.join(now, "feature", "left").groupBy(key, "y").agg(F.sum(F.col("weight") * F.coalesce("coefficient", F.lit(0.0))).alias("z"))
        error = p.select(key, (sigmoid(F.col("z") + b) - F.col("y")).alias("e"))
        step = data.select(key, "feature", "weight").join(error, key).groupBy("feature").agg((F.sum(F.col("e") * F.col("weight")) / n).alias("g"))
        gradient = {r["feature"]: r["g"] for r in step.toLocalIterator()}
        shift = error.agg(F.avg("e")).first()[0]
        w = {f: w.get(f, 0.0) - rate * (g + l2 * w.get(f, 0.0)) for f, g in gradient.items()}
        b -= rate * shift
    data.unpersist()
    return sorted(w.items()), b


def compatibility(claim: Column, evidence: Column) -> tuple[Column, Column, Column]:
    """(matched, missing, conflicting) keys of a claim's context in an evidence's."""
    keys = F.map_keys(claim)
    there = lambda k: F.map_contains_key(evidence, k)
    same = lambda k: F.lower(F.trim(F.try_element_at(claim, k))) == F.lower(F.trim(F.try_element_at(evidence, k)))
    return F.filter(keys, lambda k: there(k) & same(k)), F.filter(keys, lambda k: ~there(k)), F.filter(keys, lambda k: there(k) & ~same(k))


def rank(scored: DataFrame, claim: str, candidate: str, score: str = "score") -> DataFrame:
    """Candidates of each claim with their rank: by score, ties by id."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(claim).orderBy(F.desc(score), candidate)))
