"""The bundled Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(train, test): every fifth document is test.  All documents are in one of the two."""
    docs = table(spark, sf_dir, "documents")
    return docs.filter("doc_id % 5 <> 0"), docs.filter("doc_id % 5 = 0")


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions on the labelled documents: (doc_id, lang, source, y_true, y_pred, y_score).

    The score is a fixed function of the length, with many ties; the prediction is score >= 0.5.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y_true"))
    score = ((F.col("n_chars") % 100) / F.lit(100.0)).alias("y_score")
    out = labels.join(docs, "doc_id").select("doc_id", "lang", "source", "y_true", score)
    return out.withColumn("y_pred", (F.col("y_score") >= 0.5).cast("int"))


SCORED_LABELS = "p AS (SELECT l.doc_id, lang, source, quality AS y_true, (n_chars % 100) / 100.0::DOUBLE AS y_score, ((n_chars % 100) / 100.0::DOUBLE >= 0.5)::INT AS y_pred FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"
