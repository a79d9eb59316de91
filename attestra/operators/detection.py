"""Average precision of detections: IoU, greedy matching, interpolation.

Boxes of one image and class meet in a join, and whether a prediction is a hit at each of the
thresholds is found there, without a row a threshold.  The ranking of a class is cut into
ranges, and of its curve only what the 101 levels of recall need is kept, so no task sees or
holds all rows of a class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from attestra.sources.shared import kept

THRESHOLDS = tuple(round(0.5 + 0.05 * i, 2) for i in range(10))
MATCHING = ("greedy", "unique_pairs")
INTERPOLATION = ("coco_101_mean", "trapezoid_101")
#: Ranges that the ranking of all classes is cut into.
RANGES = 256


def iou(a: str, b: str) -> Column:
    """Of boxes in the columns a_x1, a_y1, a_x2, a_y2 and those of b."""
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(F.col(f"{a}_{hi}"), F.col(f"{b}_{hi}")) - F.greatest(F.col(f"{a}_{lo}"), F.col(f"{b}_{lo}")))
    area = lambda x: (F.col(f"{x}_x2") - F.col(f"{x}_x1")) * (F.col(f"{x}_y2") - F.col(f"{x}_y1"))
    both = side("x1", "x2") * side("y1", "y2")
    either = area(a) + area(b) - both
    return F.when(either > 0, both / either).otherwise(0.0)


def iou_pairs(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """(image, class_id, truth_id, prediction_id, confidence, iou) of overlapping boxes of one image and class.

    truth(image, class_id, box_id, x1, y1, x2, y2); predictions also have a confidence.
    """
    t = truth.select("image", "class_id", F.col("box_id").alias("truth_id"), *[F.col(c).alias(f"t_{c}") for c in ("x1", "y1", "x2", "y2")])
    p = predictions.select("image", "class_id", F.col("box_id").alias("prediction_id"), "confidence", *[F.col(c).alias(f"p_{c}") for c in ("x1", "y1", "x2", "y2")])
    return t.join(p, ["image", "class_id"]).withColumn("iou", iou("t", "p")).filter("iou > 0").select("image", "class_id", "truth_id", "prediction_id", "confidence", "iou")


def unique_pairs(pairs: DataFrame, threshold: float | Column) -> DataFrame:
    """(image, class_id, threshold, prediction_id): each prediction's best truth by IoU, then each truth's first such prediction."""
    ok = pairs.withColumn("threshold", F.lit(threshold) if isinstance(threshold, float) else threshold).filter(F.col("iou") >= F.col("threshold"))
    key = ["image", "class_id", "threshold"]
    best = ok.withColumn("r", F.row_number().over(Window.partitionBy(*key, "prediction_id").orderBy(F.desc("iou"), "truth_id"))).filter("r = 1")
    first = best.withColumn("r", F.row_number().over(Window.partitionBy(*key, "truth_id").orderBy("prediction_id"))).filter("r = 1")
    return first.select(*key, "prediction_id")


def greedy(pairs: DataFrame, threshold: Column) -> DataFrame:
    """As unique_pairs(), but predictions in order of confidence each take the best truth that is left.

    Predictions of different images don't compete, so a group is one image's pairs, folded in order.
    """
    ok = pairs.withColumn("threshold", threshold).filter(F.col("iou") >= F.col("threshold"))
    kinds = {f.name: f.dataType for f in ok.schema}
    item = F.struct((-F.col("confidence")).alias("c"), F.col("prediction_id").alias("p"), (-F.col("iou")).alias("i"), F.col("truth_id").alias("t"))
    ordered = ok.groupBy("image", "class_id", "threshold").agg(F.sort_array(F.collect_list(item)).alias("x"))
    none = F.struct(F.array().cast(ArrayType(kinds["truth_id"])).alias("t"), F.array().cast(ArrayType(kinds["prediction_id"])).alias("p"))
    free = lambda s, x: ~F.array_contains(s["t"], x["t"]) & ~F.array_contains(s["p"], x["p"])
    step = lambda s, x: F.when(free(s, x), F.struct(F.array_append(s["t"], x["t"]).alias("t"), F.array_append(s["p"], x["p"]).alias("p"))).otherwise(s)
    taken = F.aggregate("x", none, step)
    return ordered.select("image", "class_id", "threshold", F.explode(taken["p"]).alias("prediction_id"))


def _unique_hits(predictions: DataFrame, pairs: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """The predictions with h0, h1, ...: whether unique_pairs() has them at each threshold.

    A prediction's best truth is the same at every threshold, and it is the first with that
    truth above the best IoU of those before it.
    """
    key = ["image", "class_id"]
    best = pairs.withColumn("r", F.row_number().over(Window.partitionBy(*key, "prediction_id").orderBy(F.desc("iou"), "truth_id"))).filter("r = 1")
    before = F.max("iou").over(Window.partitionBy(*key, "truth_id").orderBy("prediction_id").rowsBetween(Window.unboundedPreceding, -1))
    best = best.select(*key, "prediction_id", F.col("iou").alias("own"), F.coalesce(before, F.lit(-1.0)).alias("taken"))
    hit = lambda t: F.coalesce((F.col("own") >= t) & (F.col("taken") < t), F.lit(False)).cast("int")
    return predictions.join(best, [*key, "prediction_id"], "left").select(*predictions.columns, *[hit(t).alias(f"h{i}") for i, t in enumerate(thresholds)])


def _greedy_hits(predictions: DataFrame, pairs: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """The predictions with h0, h1, ...: whether greedy() has them at each threshold."""
    kinds = {f.name: f.dataType for f in pairs.schema}
    item = F.struct((-F.col("confidence")).alias("c"), F.col("prediction_id").alias("p"), (-F.col("iou")).alias("i"), F.col("truth_id").alias("t"))
    ordered = pairs.filter(F.col("iou") >= min(thresholds)).groupBy("image", "class_id").agg(F.sort_array(F.collect_list(item)).alias("x"))
    none = F.struct(F.array().cast(ArrayType(kinds["truth_id"])).alias("t"), F.array().cast(ArrayType(kinds["prediction_id"])).alias("p"))
    free = lambda s, x: ~F.array_contains(s["t"], x["t"]) & ~F.array_contains(s["p"], x["p"])
    step = lambda s, x: F.when(free(s, x), F.struct(F.array_append(s["t"], x["t"]).alias("t"), F.array_append(s["p"], x["p"]).alias("p"))).otherwise(s)
    ordered = ordered.select("image", "class_id", *[F.aggregate(F.filter("x", lambda x: -x["i"] >= t), none, step, lambda s: s["p"]).alias(f"__p{i}") for i, t in enumerate(thresholds)])  # noqa: B023
    hit = lambda i: F.coalesce(F.array_contains(f"__p{i}", F.col("prediction_id")), F.lit(False)).cast("int")
    return predictions.join(ordered, ["image", "class_id"], "left").select(*predictions.columns, *[hit(i).alias(f"h{i}") for i in range(len(thresholds))])


def _ranked(flags: DataFrame, n: int) -> DataFrame:
    """(class_id, truths, seen, h0, tp0, h1, tp1, ...): of each prediction its place by confidence in its class, and the hits down to it at each of n thresholds."""
    order = [F.desc("confidence"), F.asc("image"), F.asc("prediction_id")]
    cut = kept(flags.repartitionByRange(RANGES, "class_id", *order).withColumn("cell", F.spark_partition_id()), "ranked")
    hits = [f"h{i}" for i in range(n)]
    totals = cut.groupBy("class_id", "cell").agg(F.count("*").alias("n"), *[F.sum(h).alias(h) for h in hits])
    # at most RANGES rows and one a class more
    starts, so_far, at = [], [], None
    for r in sorted(totals.collect(), key=lambda r: (str(r["class_id"]), r["cell"])):
        if r["class_id"] != at:
            at, so_far = r["class_id"], [0] * (n + 1)
        starts.append((r["class_id"], r["cell"], *so_far))
        so_far = [x + y for x, y in zip(so_far, r[2:], strict=True)]
    before = flags.sparkSession.createDataFrame(starts, totals.schema).withColumnsRenamed({"n": "__n"} | {h: f"__{h}" for h in hits})
    inside = Window.partitionBy("cell", "class_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    windowed = cut.select("class_id", "cell", "truths", *hits, F.count("*").over(inside).alias("seen"), *[F.sum(h).over(inside).alias(f"tp{i}") for i, h in enumerate(hits)])
    both = windowed.join(F.broadcast(before), ["class_id", "cell"])
    return both.select("class_id", "truths", (F.col("seen") + F.col("__n")).alias("seen"), *[x for i, h in enumerate(hits) for x in (F.col(h), (F.col(f"tp{i}") + F.col(f"__{h}")).alias(f"tp{i}"))])


def average_precision(truth: DataFrame, predictions: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS, matching: str = "unique_pairs", interpolation: str = "coco_101_mean") -> DataFrame:
    """(class_id, threshold, ap) of every class that has truth boxes."""
    if matching not in MATCHING or interpolation not in INTERPOLATION:
        raise ValueError("unknown matching or interpolation")
    thresholds = tuple(float(t) for t in thresholds)
    classes = truth.groupBy("class_id").agg(F.count("*").alias("truths"))
    every = predictions.select("image", "class_id", F.col("box_id").alias("prediction_id"), "confidence").join(F.broadcast(classes), "class_id")
    flags = (_greedy_hits if matching == "greedy" else _unique_hits)(every, iou_pairs(truth, predictions), thresholds)
    # a curve changes its best only where there is a hit, besides its first row, of recall and precision 0 if that is none
    kinds = [F.struct(F.lit(t).alias("threshold"), F.col(f"h{i}").alias("hit"), F.col(f"tp{i}").alias("tp")) for i, t in enumerate(thresholds)]
    points = _ranked(flags, len(thresholds)).select("class_id", "truths", "seen", F.explode(F.filter(F.array(*kinds), lambda k: (k["hit"] == 1) | (F.col("seen") == 1))).alias("k"))
    key = ["class_id", "threshold"]
    recall = F.col("recall")
    curve = points.select("class_id", "k.threshold", (F.col("k.tp") / F.col("truths")).alias("recall"), (F.col("k.tp") / F.col("seen")).alias("precision"))
    # the least level that is no less than the recall, and the greatest that is no more
    near = F.round(recall * 100.0).cast("int")
    up = F.when(near / 100.0 < recall, near + 1).otherwise(near)
    down = F.when(near / 100.0 > recall, near - 1).otherwise(near)
    steps = curve.groupBy(*key, (down if interpolation == "coco_101_mean" else up).alias("level")).agg(F.max("precision").alias("best"), F.min("recall").alias("first"), F.max(F.struct("recall", "precision")).alias("last"))
    knots = steps.groupBy(*key).agg(F.collect_list(F.struct("level", "best", "first", "last")).alias("curve"))
    if interpolation == "coco_101_mean":
        # precision at a recall is the best at that recall or more
        at = lambda i: F.coalesce(F.array_max(F.transform(F.filter("curve", lambda x: x["level"] >= i), lambda x: x["best"])), F.lit(0.0))
        ap = F.aggregate(F.sequence(F.lit(0), F.lit(100)), F.lit(0.0), lambda s, i: s + at(i)) / 101.0
    else:
        ap = _trapezoid()
    found = knots.select(*key, ap.alias("ap"))
    grid_rows = classes.select("class_id", F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold"))
    return grid_rows.join(found, key, "left").select(*key, F.coalesce("ap", F.lit(0.0)).alias("ap"))


def _trapezoid() -> Column:
    """Area under the envelope, padded by (0, best) and (1, 0), linear between knots, on 101 levels."""

    def at(i: Column) -> Column:
        x = i / 100.0
        low = F.array_max(F.transform(F.filter("curve", lambda k: k["level"] <= i), lambda k: k["last"]))
        above = F.filter("curve", lambda k: k["level"] > i)
        beyond = F.coalesce(F.array_max(F.transform(above, lambda k: k["best"])), F.lit(0.0))
        top = F.array_max(F.transform("curve", lambda k: k["best"]))
        r0 = F.coalesce(low["recall"], F.lit(0.0))
        y0 = F.when(r0 == 0, top).otherwise(F.greatest(low["precision"], beyond))
        r1 = F.coalesce(F.array_min(F.transform(above, lambda k: k["first"])), F.lit(1.0))
        return F.when(i >= 100, F.lit(0.0)).otherwise(y0 + (beyond - y0) * (x - r0) / (r1 - r0))

    levels = F.transform(F.sequence(F.lit(0), F.lit(100)), at)
    return F.aggregate(F.transform(F.array(levels), lambda v: F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: (F.get(v, i) + F.get(v, i + 1)) / 2.0 * 0.01))[0], F.lit(0.0), lambda s, y: s + y)


def summary(ap: DataFrame) -> DataFrame:
    """(map50, map75, map50_95) from average_precision() at THRESHOLDS."""
    by = ap.groupBy("threshold").agg(F.avg("ap").alias("m"))
    pick = lambda t: F.max(F.when(F.abs(F.col("threshold") - t) < 1e-9, F.col("m")))
    return by.agg(pick(0.5).alias("map50"), pick(0.75).alias("map75"), F.avg("m").alias("map50_95"))
