"""Queries that recompute metrics from predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.operators import classification as C
from attestra.sources.tables import SCORED_LABELS, scored_labels, table



def _yes():
    return F.col("y_true") == 1


def clf_accuracy_wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.accuracy(scored_labels(spark, sf_dir))


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return flags guessed from line status and quantity: three labels on one side, two of them on the other."""
    guess = F.when(F.col("l_linestatus") == "O", "N").when(F.col("l_quantity") > 25, "A").otherwise("R")
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("y_true"), guess.alias("y_pred"))


def clf_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.confusion(_flags(spark, sf_dir))


def clf_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.per_label(_flags(spark, sf_dir))


def clf_averaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.averaged(C.per_label(_flags(spark, sf_dir)))


def clf_binary_dice_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.binary(C.per_label(scored_labels(spark, sf_dir)), "1")


def prob_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.auroc(scored_labels(spark, sf_dir), _yes())


def prob_auprc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.auprc(scored_labels(spark, sf_dir), _yes())


def prob_auroc_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a line was returned, by its price."""
    return C.auroc(table(spark, sf_dir, "lineitem"), F.col("l_returnflag") == "R", "l_extendedprice")


def prob_logloss_brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.log_loss_brier(scored_labels(spark, sf_dir), _yes())


def reg_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices against a linear rule on the quantity."""
    return C.regression(table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("y_true"), (F.col("l_quantity") * 1500.0 + 100.0).alias("y_pred"))).select("n", *[F.round(c, 6).alias(c) for c in ("mae", "rmse", "r2")])


_FLAGS = "f AS (SELECT l_returnflag AS t, CASE WHEN l_linestatus = 'O' THEN 'N' WHEN l_quantity > 25 THEN 'A' ELSE 'R' END AS p FROM lineitem)"
_LABELS = """l AS (SELECT t AS label FROM f UNION SELECT p FROM f),
c AS (SELECT label, count_if(t = label AND p = label) AS tp, count_if(t <> label AND p = label) AS fp, count_if(t = label AND p <> label) AS fn, count_if(t <> label AND p <> label) AS tn FROM f, l GROUP BY label),
r AS (SELECT *, tp + fn AS support, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0::DOUBLE END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0::DOUBLE END AS recall FROM c),
m AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2.0::DOUBLE * precision * recall / (precision + recall) ELSE 0.0::DOUBLE END AS f1 FROM r)"""

QUERIES = {f.__name__: f for f in (clf_accuracy_wilson, clf_confusion, clf_per_label, clf_averaged, clf_binary_dice_iou, prob_auroc, prob_auprc, prob_auroc_lineitem, prob_logloss_brier, reg_metrics)}
ORACLE = {
    "clf_accuracy_wilson": f"""WITH {SCORED_LABELS}, a AS (SELECT count(*) AS n, count_if(y_true = y_pred) / count(*) AS p FROM p),
w AS (SELECT *, (p + 1.96::DOUBLE * 1.96 / (2.0::DOUBLE * n)) / (1.0::DOUBLE + 1.96::DOUBLE * 1.96 / n) AS c, 1.96::DOUBLE * sqrt(p * (1.0::DOUBLE - p) / n + 1.96::DOUBLE * 1.96 / (4.0::DOUBLE * n * n)) / (1.0::DOUBLE + 1.96::DOUBLE * 1.96 / n) AS d FROM a)
SELECT p AS accuracy, n, greatest(0.0::DOUBLE, c - d) AS ci_low, least(1.0::DOUBLE, c + d) AS ci_high FROM w""",
    "clf_confusion": f"WITH {_FLAGS} SELECT t AS actual, p AS predicted, count(*) AS n FROM f GROUP BY t, p",
    "clf_per_label": f"WITH {_FLAGS}, {_LABELS} SELECT label, tp, fp, fn, tn, support, precision, recall, f1 FROM m",
    "clf_averaged": f"""WITH {_FLAGS}, {_LABELS} SELECT 'macro' AS averaging, avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1 FROM m
UNION ALL SELECT 'weighted', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support) FROM m""",
    "clf_binary_dice_iou": f"WITH {SCORED_LABELS}, f AS (SELECT y_true::VARCHAR AS t, y_pred::VARCHAR AS p FROM p), {_LABELS} SELECT precision, recall, f1, f1 AS dice, tp / (tp + fp + fn) AS iou FROM m WHERE label = '1'",
    "prob_auroc": f"""WITH {SCORED_LABELS}, a AS (SELECT y_score AS s, count(*) AS n FROM p WHERE y_true = 1 GROUP BY 1), b AS (SELECT y_score AS s, count(*) AS n FROM p WHERE y_true <> 1 GROUP BY 1)
SELECT (SELECT sum(a.n * b.n * CASE WHEN a.s > b.s THEN 1.0::DOUBLE WHEN a.s = b.s THEN 0.5::DOUBLE ELSE 0 END) FROM a, b) / ((SELECT sum(n) FROM a)::DOUBLE * (SELECT sum(n) FROM b)) AS auroc""",
    "prob_auprc": f"""WITH {SCORED_LABELS}, s AS (SELECT y_score AS s, count_if(y_true = 1) AS pos, count(*) AS n FROM p GROUP BY 1),
r AS (SELECT pos, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS taken FROM s) SELECT sum(pos * (tp / taken)) / sum(pos) AS auprc FROM r""",
    "prob_auroc_lineitem": """WITH s AS (SELECT l_extendedprice AS s, count_if(l_returnflag = 'R') AS pos, count_if(l_returnflag <> 'R') AS neg FROM lineitem GROUP BY 1),
r AS (SELECT pos, neg, sum(neg) OVER (ORDER BY s) AS below FROM s) SELECT (sum(pos * (below - neg) * 2 + pos * neg)::DOUBLE / 2) / (sum(pos)::DOUBLE * sum(neg)::DOUBLE) AS auroc FROM r""",
    "prob_logloss_brier": f"""WITH {SCORED_LABELS}, q AS (SELECT y_true::DOUBLE AS y, y_score AS s, least(greatest(y_score, {C.EPSILON!r}::DOUBLE), 1.0::DOUBLE - {C.EPSILON!r}::DOUBLE) AS c FROM p)
SELECT -avg(y * ln(c) + (1.0::DOUBLE - y) * ln(1.0::DOUBLE - c)) AS log_loss, avg((s - y) * (s - y)) AS brier FROM q""",
    "reg_metrics": """WITH q AS (SELECT l_extendedprice AS t, l_quantity * 1500.0::DOUBLE + 100.0::DOUBLE AS p FROM lineitem), m AS (SELECT avg(t) AS m FROM q)
SELECT count(*) AS n, round(avg(abs(p - t)), 6) AS mae, round(sqrt(sum((p - t) * (p - t)) / count(*)), 6) AS rmse, round(1.0::DOUBLE - sum((p - t) * (p - t)) / sum((t - m) * (t - m)), 6) AS r2 FROM q, m""",
}
