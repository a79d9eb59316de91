"""Files of repositories: roles by path, bounded selection, hash-ranked samples, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EXCLUDED = ("node_modules", "vendor", "third_party", ".github", "test", "tests")


def role(path: Column) -> Column:
    """predictions, metrics or report by extension and stem; null for other and excluded paths."""
    low = F.lower(path)
    parts = F.split(low, "/")
    stem = F.element_at(parts, -1)
    out = F.arrays_overlap(parts, F.array(*[F.lit(x) for x in EXCLUDED]))
    return F.when(out, None).when(stem.rlike(r"\.(csv|tsv|parquet)$") & stem.rlike("pred|result|output"), "predictions").when(stem.rlike(r"\.(json|csv)$") & stem.rlike("metric|score|eval"), "metrics").when(stem.rlike(r"\.(md|txt|rst|html?|ipynb)$") | stem.rlike("readme|report"), "report")


def priority(path: Column, role_: Column) -> Column:
    """Sort key: the role's band, depth, path in small letters."""
    band = F.when(role_ == "report", 0).when(role_ == "metrics", 1).otherwise(2)
    return F.struct(band.alias("band"), F.size(F.split(path, "/")).alias("depth"), F.lower(path).alias("low"))


def select(files: DataFrame, repository: str, path: str, size: str, limit: int, max_bytes: int) -> DataFrame:
    """Every file with a role, and why it is left out: oversized, over its repository's limit, or null if it is in."""
    known = files.withColumn("role", role(F.col(path))).filter("role is not null")
    fits = F.col(size) <= max_bytes
    order = F.row_number().over(Window.partitionBy(repository, fits).orderBy(priority(F.col(path), F.col("role")), path))
    return known.withColumn("reason", F.when(~fits, "oversized").when(order > limit, "artifact_limit"))


def hash_ranked(df: DataFrame, stratum: str, key: str, amount: int) -> DataFrame:
    """The first ``amount`` of each stratum by the SHA-256 of the key."""
    h = F.sha2(F.col(key).cast("string"), 256)
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(stratum).orderBy(h, key))).filter(F.col("rank") <= amount)


def describe(spark: SparkSession, folder: str) -> DataFrame:
    """(path, sha256, size_bytes) of the files of a folder."""
    return spark.read.format("binaryFile").load(folder).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"))


def integrity(registered: DataFrame, found: DataFrame, key: str = "path") -> DataFrame:
    """(path, problem): files that are missing, unregistered or changed."""
    a = registered.select(key, F.col("sha256").alias("a"))
    b = found.select(key, F.col("sha256").alias("b"))
    problem = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "unregistered").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, key, "full_outer").select(key, problem.alias("problem")).filter("problem is not null")


def discover(candidates: DataFrame, domain: str, order: list[Column], reasons: Column, quota: int) -> DataFrame:
    """Candidates in order with why each was left out: the given reason, or its domain's quota; null if taken."""
    taken = F.row_number().over(Window.partitionBy(domain, reasons.isNull()).orderBy(*order))
    return candidates.withColumn("reason", F.when(reasons.isNotNull(), reasons).when(taken > quota, "quota"))
