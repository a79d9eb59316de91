"""Metrics recomputed from predictions: classification, probability and regression.

All are one or two aggregations; nothing is collected.  Counts come first and ratios are
taken of their sums, so partial aggregation does the work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions.stats import ratio, wilson
from attestra.sources.shared import kept

EPSILON = 2.220446049250313e-16


def confusion(df: DataFrame, truth: str = "y_true", prediction: str = "y_pred") -> DataFrame:
    """(actual, predicted, n)."""
    return df.groupBy(F.col(truth).cast("string").alias("actual"), F.col(prediction).cast("string").alias("predicted")).agg(F.count("*").alias("n"))


def accuracy(df: DataFrame, truth: str = "y_true", prediction: str = "y_pred") -> DataFrame:
    """(accuracy, n, ci_low, ci_high), the interval by Wilson's score."""
    out = df.agg(F.count("*").alias("n"), F.sum((F.col(truth).cast("string") == F.col(prediction).cast("string")).cast("bigint")).alias("hits"))
    p = F.col("hits").cast("double") / F.col("n")
    low, high = wilson(p, F.col("n"))
    out = out.withColumn("n", F.when(F.col("n") > 0, F.col("n")).otherwise(F.raise_error(F.lit("there are no predictions")).cast("bigint")))
    return out.select(p.alias("accuracy"), "n", low.alias("ci_low"), high.alias("ci_high"))


def per_label(df: DataFrame, truth: str = "y_true", prediction: str = "y_pred") -> DataFrame:
    """(label, tp, fp, fn, tn, support, precision, recall, f1) of every label on either side.

    One pass over the rows; the labels' counts follow from the confusion counts.
    """
    cells = confusion(df, truth, prediction)
    each = cells.select(F.explode(F.array(F.struct(F.col("actual").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("guessed"), F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("tp")), F.struct(F.col("predicted").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("guessed"), F.lit(0).cast("bigint").alias("tp")))).alias("x")).select("x.*")
    by = each.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("guessed").alias("guessed"), F.sum("support").alias("support"))
    total = cells.agg(F.sum("n").alias("total"))
    out = by.crossJoin(total).withColumn("fp", F.col("guessed") - F.col("tp")).withColumn("fn", F.col("support") - F.col("tp"))
    out = out.withColumn("tn", F.col("total") - F.col("tp") - F.col("fp") - F.col("fn"))
    out = out.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    out = out.withColumn("f1", ratio(2.0 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return out.select("label", "tp", "fp", "fn", "tn", "support", "precision", "recall", "f1")


def averaged(labels: DataFrame) -> DataFrame:
    """(averaging, precision, recall, f1): macro and by support, of per_label()."""
    columns = ("precision", "recall", "f1")
    macro = labels.agg(*[F.avg(c).alias(c) for c in columns]).select(F.lit("macro").alias("averaging"), *columns)
    by_support = labels.agg(*[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in columns])
    return macro.unionByName(by_support.select(F.lit("weighted").alias("averaging"), *columns))


def binary(labels: DataFrame, positive: str) -> DataFrame:
    """(precision, recall, f1, dice, iou) of one label."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return labels.filter(F.col("label") == positive).select("precision", "recall", "f1", F.col("f1").alias("dice"), ratio(tp, tp + fp + fn).alias("iou"))


def _by_score(df: DataFrame, positive: Column, score: str) -> DataFrame:
    """(score, pos, n): counts of each distinct score; what follows is over these."""
    return df.groupBy(F.col(score).alias("score")).agg(F.sum(positive.cast("bigint")).alias("pos"), F.count("*").alias("n"))


def running(df: DataFrame, order: str, sums: dict[str, str], ascending: bool = False, buckets: int = 256) -> DataFrame:
    """df with running sums over distinct values of ``order``, without one task that sees all rows.

    df is cut into ranges of ``order`` and written once; sums within a range are windowed in
    parallel, and the sums of the ranges before are added from a table of one row a range.
    """
    marked = kept(df.repartitionByRange(buckets, order).withColumn("__cell", F.spark_partition_id()), "ranges")
    direction = F.col(order).asc() if ascending else F.col(order).desc()
    inside = Window.partitionBy("__cell").orderBy(direction).rowsBetween(Window.unboundedPreceding, 0)
    # at most ``buckets`` rows; summed up here, so the plan has no join of the table with itself
    totals = marked.groupBy("__cell").agg(*[F.sum(c).alias(f"__b_{n}") for n, c in sums.items()])
    so_far, starts = [0] * len(sums), []
    for r in sorted(totals.collect(), key=lambda r: r["__cell"], reverse=not ascending):
        starts.append((r["__cell"], *so_far))
        so_far = [a + (b or 0) for a, b in zip(so_far, r[1:], strict=True)]
    starts = df.sparkSession.createDataFrame(starts, totals.schema)
    out = marked.select("*", *[F.sum(c).over(inside).alias(f"__w_{n}") for n, c in sums.items()]).join(F.broadcast(starts), "__cell")
    return out.select(*df.columns, *[(F.col(f"__w_{n}") + F.col(f"__b_{n}")).alias(n) for n in sums])


def auroc(df: DataFrame, positive: Column, score: str = "y_score") -> DataFrame:
    """(auroc): chance that a positive outscores a negative, ties half; null without both classes."""
    scores = running(_by_score(df, positive, score).withColumn("neg", F.col("n") - F.col("pos")), "score", {"below": "neg"}, ascending=True)
    wins = F.sum(F.col("pos") * (F.col("below") - F.col("neg") + F.col("neg") / 2.0))
    return scores.agg(wins.alias("w"), F.sum("pos").alias("p"), F.sum("neg").alias("q")).select(F.when((F.col("p") > 0) & (F.col("q") > 0), F.col("w") / (F.col("p").cast("double") * F.col("q"))).alias("auroc"))


def auprc(df: DataFrame, positive: Column, score: str = "y_score") -> DataFrame:
    """(auprc): precision summed over the recall gained at each distinct score, from high to low; null without positives."""
    scores = running(_by_score(df, positive, score), "score", {"tp": "pos", "taken": "n"})
    return scores.agg((F.sum(F.col("pos") * (F.col("tp") / F.col("taken"))) / F.nullif(F.sum("pos"), F.lit(0))).alias("auprc"))


def log_loss_brier(df: DataFrame, positive: Column, score: str = "y_score") -> DataFrame:
    """(log_loss, brier), scores clipped by EPSILON for the first."""
    p = F.least(F.greatest(F.col(score), F.lit(EPSILON)), F.lit(1.0 - EPSILON))
    y = positive.cast("double")
    return df.agg((-F.avg(y * F.log(p) + (1.0 - y) * F.log(1.0 - p))).alias("log_loss"), F.avg((F.col(score) - y) * (F.col(score) - y)).alias("brier"))


def regression(df: DataFrame, truth: str = "y_true", prediction: str = "y_pred") -> DataFrame:
    """(n, mae, rmse, r2); r2 of a constant target is 1 if every prediction is exact, else 0."""
    mean = df.agg(F.avg(truth).alias("m"))
    e = F.col(prediction) - F.col(truth)
    d = F.col(truth) - F.col("m")
    out = df.crossJoin(F.broadcast(mean)).agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sum(e * e).alias("rss"), F.sum(d * d).alias("tss"))
    r2 = F.when(F.col("tss") > 0, 1.0 - F.col("rss") / F.col("tss")).otherwise((F.col("rss") == 0).cast("double"))
    return out.select("n", "mae", F.sqrt(F.col("rss") / F.col("n")).alias("rmse"), r2.alias("r2"))
