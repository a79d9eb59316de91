"""Queries on detections.  No table has boxes, so they are made of the lines of orders: an order is an image, its lines are boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.operators import detection as D
from attestra.sources.tables import table


def _boxes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image"), F.col("l_returnflag").alias("class_id"), F.col("l_linenumber").alias("box_id"), (F.col("l_partkey") % 40).cast("double").alias("x1"), (F.col("l_suppkey") % 40).cast("double").alias("y1"), (F.col("l_quantity") + 10.0).alias("w"), (F.col("l_quantity") + 12.0).alias("h"), F.col("l_discount"), F.col("l_tax"))
    truth = lines.select("image", "class_id", "box_id", "x1", "y1", (F.col("x1") + F.col("w")).alias("x2"), (F.col("y1") + F.col("h")).alias("y2"))
    shift = F.floor(F.col("l_tax") * 100.0 + 0.5)
    moved = lines.withColumn("x1", F.col("x1") + shift).withColumn("confidence", F.col("l_discount") * 8.0 + 0.1)
    return truth, moved.select("image", "class_id", "box_id", "confidence", "x1", "y1", (F.col("x1") + F.col("w")).alias("x2"), (F.col("y1") + F.col("h")).alias("y2"))


def detection_iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.iou_pairs(*_boxes(spark, sf_dir))


def detection_unique_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.unique_pairs(D.iou_pairs(*_boxes(spark, sf_dir)), 0.5)


def detection_ap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.average_precision(*_boxes(spark, sf_dir)).select("class_id", "threshold", F.round("ap", 9).alias("ap"))


def detection_greedy_ap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.average_precision(*_boxes(spark, sf_dir), thresholds=(0.5, 0.75), matching="greedy", interpolation="trapezoid_101")


def detection_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.summary(D.average_precision(*_boxes(spark, sf_dir))).select(*[F.round(c, 9).alias(c) for c in ("map50", "map75", "map50_95")])


_BOXES = """l AS (SELECT l_orderkey AS image, l_returnflag AS class_id, l_linenumber AS box_id, (l_partkey % 40)::DOUBLE AS x1, (l_suppkey % 40)::DOUBLE AS y1, l_quantity + 10 AS w, l_quantity + 12 AS h, floor(l_tax * 100.0::DOUBLE + 0.5::DOUBLE) AS s, l_discount * 8.0::DOUBLE + 0.1::DOUBLE AS confidence FROM lineitem),
o AS (SELECT t.image, t.class_id, t.box_id AS truth_id, p.box_id AS prediction_id, p.confidence, t.w * t.h AS ta, p.w * p.h AS pa,
  greatest(0, least(t.x1 + t.w, p.x1 + p.s + p.w) - greatest(t.x1, p.x1 + p.s)) * greatest(0, least(t.y1 + t.h, p.y1 + p.h) - greatest(t.y1, p.y1)) AS i FROM l t JOIN l p ON t.image = p.image AND t.class_id = p.class_id),
q AS (SELECT image, class_id, truth_id, prediction_id, confidence, i / (ta + pa - i) AS iou FROM o WHERE i > 0)"""
_MATCH = """g AS (SELECT unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95])::DOUBLE AS threshold),
b AS (SELECT q.*, threshold FROM q JOIN g ON iou >= threshold QUALIFY row_number() OVER (PARTITION BY threshold, image, class_id, prediction_id ORDER BY iou DESC, truth_id) = 1),
m AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY threshold, image, class_id, truth_id ORDER BY prediction_id) = 1)"""
_AP = """n AS (SELECT class_id, count(*) AS truths FROM l GROUP BY 1),
f AS (SELECT l.class_id, g.threshold, confidence, image, box_id, (m.prediction_id IS NOT NULL)::INT AS hit FROM l JOIN g ON true LEFT JOIN m USING (threshold, image, class_id) WHERE false),
f2 AS (SELECT l.class_id, g.threshold, l.confidence, l.image, l.box_id, (m.prediction_id IS NOT NULL)::INT AS hit FROM l JOIN g ON true LEFT JOIN m ON m.threshold = g.threshold AND m.image = l.image AND m.class_id = l.class_id AND m.prediction_id = l.box_id),
k AS (SELECT class_id, threshold, sum(hit) OVER w AS tp, count(*) OVER w AS seen FROM f2 WINDOW w AS (PARTITION BY class_id, threshold ORDER BY confidence DESC, image, box_id ROWS UNBOUNDED PRECEDING)),
c AS (SELECT class_id, threshold, tp / truths AS recall, max(tp / seen) AS precision FROM k JOIN n USING (class_id) GROUP BY 1, 2, 3),
e AS (SELECT class_id, threshold, recall, max(precision) OVER (PARTITION BY class_id, threshold ORDER BY recall DESC) AS best FROM c),
r AS (SELECT class_id, threshold, v, max(CASE WHEN recall >= v / 100.0::DOUBLE THEN best END) AS best FROM e, (SELECT unnest(range(101)) AS v) GROUP BY 1, 2, 3),
ap AS (SELECT class_id, threshold, sum(coalesce(best, 0)) / 101 AS ap FROM r GROUP BY 1, 2)"""
_AP = "\n".join(x for x in _AP.split("\n") if not x.startswith("f AS"))

QUERIES = {f.__name__: f for f in (detection_iou_pairs, detection_unique_matches, detection_ap, detection_greedy_ap, detection_map)}
ORACLE = {
    "detection_iou_pairs": f"WITH {_BOXES} SELECT image, class_id, truth_id, prediction_id, confidence, iou FROM q",
    "detection_unique_matches": f"WITH {_BOXES}, {_MATCH} SELECT image, class_id, threshold, prediction_id FROM m WHERE threshold = 0.5",
    "detection_ap": f"WITH {_BOXES}, {_MATCH}, {_AP} SELECT class_id, threshold, round(ap, 9) AS ap FROM ap",
    "detection_map": f"WITH {_BOXES}, {_MATCH}, {_AP}, t AS (SELECT threshold, avg(ap) AS m FROM ap GROUP BY 1) SELECT round(max(m) FILTER (threshold = 0.5), 9) AS map50, round(max(m) FILTER (threshold = 0.75), 9) AS map75, round(avg(m), 9) AS map50_95 FROM t",
}
