"""Streaming forms of the batch operators; extensions, for tables that arrive bit by bit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.functions.text import fingerprint


def fresh_rows(stream: DataFrame, columns: list[str], time: str, delay: str = "1 hour") -> DataFrame:
    """Rows whose values did not occur within the delay; state is dropped as the watermark passes."""
    marked = stream.withColumn("__print", fingerprint(columns)).withWatermark(time, delay)
    return marked.dropDuplicatesWithinWatermark(["__print"]).drop("__print")


def leaked_rows(stream: DataFrame, train: DataFrame, columns: list[str]) -> DataFrame:
    """Stream rows whose values occur in a static train table; no state."""
    seen = train.select(fingerprint(columns).alias("__print")).distinct()
    return stream.withColumn("__print", fingerprint(columns)).join(seen, "__print", "left_semi").drop("__print")


def windowed_accuracy(stream: DataFrame, time: str, truth: str, prediction: str, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """(start, n, accuracy) of tumbling windows, late rows within the delay included."""
    by = stream.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"))
    return by.agg(F.count("*").alias("n"), F.avg((F.col(truth) == F.col(prediction)).cast("double")).alias("accuracy")).select(F.col("w.start").alias("start"), "n", "accuracy")
