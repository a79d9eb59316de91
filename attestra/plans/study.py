"""Queries on judgements: labels as gold, fixed functions of lengths and events as arms and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.operators import study as S
from attestra.sources.tables import SCORED_LABELS, scored_labels, table

_STATUS = "CASE WHEN {0} = 0 THEN 'contradicted' WHEN {0} = 1 THEN 'supported' ELSE 'not_verifiable' END"


def _arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = scored_labels(spark, sf_dir)
    return p.withColumns({"gold": F.expr(_STATUS.format("y_true")), "arm_a": F.expr(_STATUS.format("doc_id % 3")), "arm_b": F.expr(_STATUS.format("y_pred"))})


def arm_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = list(S.STATUSES)
    out = _arms(spark, sf_dir).groupBy("gold").pivot("arm_a", states).count()
    return out.select("gold", *[F.coalesce(s, F.lit(0)).alias(s) for s in states])


def arm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.arm_scores(_arms(spark, sf_dir), "gold", "arm_a", "contradicted")


def arm_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.class_scores(_arms(spark, sf_dir), "gold", "arm_a")


def arm_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An arm that lacks some documents, has others besides, and repeats one in nine."""
    gold = scored_labels(spark, sf_dir).select("doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id").filter("doc_id % 7 <> 0")
    return S.coverage(gold, docs.unionByName(docs.filter("doc_id % 9 = 0")), "doc_id")


def recall_delta_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much more contradictions one arm finds than another, by 200 draws of owners as in its SQL."""
    values, statistic = S.recall_delta("arm_b", "arm_a", "gold", "contradicted")
    return S.interval(S.cluster_bootstrap(_arms(spark, sf_dir), "source", values, statistic, 200))


def paired_recall_delta_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = scored_labels(spark, sf_dir)
    yes = F.col("y_true") == 1
    values, statistic = S.paired_recall_delta(F.col("y_score") >= 0.4, yes, yes & (F.col("y_pred") == 1), F.col("doc_id") % 3 < 2)
    return S.step_interval(S.cluster_bootstrap(p, "source", values, statistic, 200))


def threshold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.threshold_metrics(scored_labels(spark, sf_dir), "y_score", F.col("y_true") == 1, 0.35)


def system_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two systems on labelled documents as cases: toxic ones are defects, sources their families."""
    labels = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    cases = labels.withColumn("system", F.explode(F.array(F.lit("length"), F.lit("id"))))
    found = F.when(F.col("system") == "length", F.col("n_chars") % 3 == 0).otherwise(F.col("doc_id") % 2 == 0)
    return S.system_summary(cases, "system", F.col("toxic") == 1, found, "source")


def pairwise_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _arms(spark, sf_dir)
    right = {c: F.col(c) == F.col("gold") for c in ("arm_a", "arm_b")} | {"majority": F.col("gold") == "supported"}
    return S.pairwise_tests(a, right).drop("p_value")


def mcnemar_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _arms(spark, sf_dir)
    return S.paired_test(a, F.col("gold") == F.col("arm_a"), F.col("gold") == F.col("arm_b")).select("only_a", "only_b")


def mcnemar_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact p; SQL has no sum of this kind that is as exact, so tests hold it against integers."""
    a = _arms(spark, sf_dir)
    return S.paired_test(a, F.col("gold") == F.col("arm_a"), F.col("gold") == F.col("arm_b"))


def holm_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), ((F.col("n_nationkey") * 7 % 25 + 1) / 1000.0).alias("p_value"))
    return S.holm(tests)


def kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.kappa(scored_labels(spark, sf_dir), F.col("y_true") == 1, F.col("y_pred") == 1)


def _owner_draws(spark: SparkSession, sf_dir: str, samples: int) -> DataFrame:
    p = scored_labels(spark, sf_dir)
    values = {"hits": (F.col("y_true") == F.col("y_pred")).cast("bigint"), "n": F.lit(1).cast("bigint")}
    return S.cluster_bootstrap(p, "source", values, F.col("hits") / F.col("n"), samples)


def owner_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of 200 draws, as in its SQL."""
    return _owner_draws(spark, sf_dir, 200)


def owner_bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.interval(owner_bootstrap(spark, sf_dir))


def owner_bootstrap_interval_1000(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the reference's 1,000 draws."""
    return S.interval(_owner_draws(spark, sf_dir, 1000))


def calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.calibration_bins(scored_labels(spark, sf_dir), "y_score", F.col("y_true") == 1)


def ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.expected_calibration_error(calibration_bins(spark, sf_dir))


def average_precision_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.average_precision(scored_labels(spark, sf_dir), "y_score", F.col("y_true") == 1, "doc_id")


def risk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.risk_coverage(scored_labels(spark, sf_dir), "y_score", F.col("y_true") == 1)


def calibration_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.calibrate(scored_labels(spark, sf_dir), "y_score", F.col("y_true") == 1, "source", 0.8, 0.7)


def subgroups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.subgroups(scored_labels(spark, sf_dir), ["lang", "source"], F.col("y_pred") == 1, F.col("y_true") == 1, "source")


def selective_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as decisions: their values give scores, their props a context of which some is missing."""
    e = table(spark, sf_dir, "events").select("event_id", ((F.col("event_id") * 37 % 100) / 100.0).alias("a"), ((F.col("user_id") * 13 % 100) / 100.0).alias("b"), ((F.col("event_id") * 11 % 60) / 100.0).alias("ood"), (F.col("event_type") != "error").alias("eligible"), F.when(F.col("event_id") % 7 == 0, 0.5).otherwise(1.0).alias("completeness"))
    e = e.withColumn("reliability", S.reliability(["a", "b"], "ood"))
    action, reasons = S.select_action(F.col("reliability"), 0.5, 0.2, F.col("eligible"), F.col("completeness"))
    return e.select("event_id", "reliability", action.alias("action"), F.concat_ws(",", reasons).alias("reasons"))


def greedy_claim_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as claims (ship mode and quantity) against those shifted by a rule."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("metric"), F.col("l_quantity").alias("value"), "l_linenumber")
    found = lines.filter("l_linenumber <> 3").withColumn("value", F.when(F.col("l_linenumber") == 2, F.col("value") + 1.0).otherwise(F.col("value")))
    return S.match_multiset(lines, found, ["metric", "value"], "l_orderkey")


def claim_match_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.micro(greedy_claim_match(spark, sf_dir))


def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.best_threshold(scored_labels(spark, sf_dir), "y_score", F.col("y_true") == 1)


_ARMS = f"{SCORED_LABELS}, a AS (SELECT *, {_STATUS.format('y_true')} AS gold, {_STATUS.format('doc_id % 3')} AS arm_a, {_STATUS.format('y_pred')} AS arm_b FROM p)"
_BOOT = f"""{SCORED_LABELS}, s AS (SELECT source, count_if(y_true = y_pred) AS hits, count(*) AS n, row_number() OVER (ORDER BY source) - 1 AS slot FROM p GROUP BY source),
g AS (SELECT i AS sample, ('0x' || sha256('20260821:' || i || ':' || slot)[1:12])::BIGINT % (SELECT count(*) FROM s) AS slot FROM (SELECT unnest(range(200)) AS i), s),
b AS (SELECT sample, sum(hits) / sum(n) AS statistic FROM g JOIN s USING (slot) GROUP BY sample)"""
_CLASSES = f"""{_ARMS}, c AS (SELECT unnest(['supported', 'contradicted', 'not_verifiable']) AS c), k AS (SELECT c, count_if(gold = c) AS s, count_if(arm_a = c) AS q, count_if(gold = c AND arm_a = c) AS t FROM a, c GROUP BY c),
e AS (SELECT *, CASE WHEN q > 0 THEN t / q ELSE 1 END AS precision, CASE WHEN s > 0 THEN t / s ELSE 1 END AS recall FROM k), f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM e)"""
_DRAWS = """s AS (SELECT source, {values}, row_number() OVER (ORDER BY source) - 1 AS slot FROM {rows} GROUP BY source),
g AS (SELECT i AS sample, ('0x' || sha256('20260821:' || i || ':' || slot)[1:12])::BIGINT % (SELECT count(*) FROM s) AS slot FROM (SELECT unnest(range(200)) AS i), s)"""
_BINS = f"{SCORED_LABELS}, b AS (SELECT least(floor(y_score * 10), 9)::INT AS bin, count(*) AS n, avg(y_score) AS confidence, avg((y_true = 1)::INT::DOUBLE) AS accuracy FROM p GROUP BY 1)"
_MATCHED = """e AS (SELECT l_orderkey, l_returnflag AS m, l_quantity AS v, count(*) AS e FROM lineitem GROUP BY 1, 2, 3),
a AS (SELECT l_orderkey, l_returnflag AS m, CASE WHEN l_linenumber = 2 THEN l_quantity + 1 ELSE l_quantity END AS v, count(*) AS a FROM lineitem WHERE l_linenumber <> 3 GROUP BY 1, 2, 3),
f AS (SELECT l_orderkey, coalesce(e, 0) AS e, coalesce(a, 0) AS a FROM e FULL JOIN a USING (l_orderkey, m, v)),
r AS (SELECT l_orderkey, sum(least(e, a))::BIGINT AS tp, sum(a - least(e, a))::BIGINT AS fp, sum(e - least(e, a))::BIGINT AS fn FROM f GROUP BY 1)"""

QUERIES = {f.__name__: f for f in (arm_confusion, arm_scores, arm_classes, arm_coverage, recall_delta_interval, paired_recall_delta_interval, threshold_metrics, system_summary, pairwise_counts, mcnemar_counts, mcnemar_p, holm_adjust, kappa, owner_bootstrap, owner_bootstrap_interval, owner_bootstrap_interval_1000, calibration_bins, ece, average_precision_rows, risk_coverage, calibration_pick, subgroups, selective_action, greedy_claim_match, claim_match_micro, best_threshold)}
ORACLE = {
    "arm_confusion": f"WITH {_ARMS} SELECT gold, count_if(arm_a = 'contradicted') AS contradicted, count_if(arm_a = 'supported') AS supported, count_if(arm_a = 'not_verifiable') AS not_verifiable FROM a GROUP BY gold",
    "arm_scores": f"""WITH {_CLASSES} SELECT sum(s)::BIGINT AS n, sum(t) / sum(s) AS accuracy, sum(f1) / 3 AS macro_f1, max(recall) FILTER (c = 'contradicted') AS recall_positive,
  CASE WHEN sum(s) FILTER (c <> 'contradicted') > 0 THEN (SELECT count_if(arm_a = 'contradicted' AND gold <> 'contradicted') FROM a) / sum(s) FILTER (c <> 'contradicted') ELSE 0 END AS false_accusation_rate FROM f""",
    "arm_classes": f"WITH {_CLASSES} SELECT c AS status, s AS support, q AS guessed, t AS hits, precision, recall, f1 FROM f",
    "arm_coverage": """WITH d AS (SELECT doc_id FROM documents WHERE doc_id % 7 <> 0), r AS (SELECT * FROM d UNION ALL SELECT * FROM d WHERE doc_id % 9 = 0)
SELECT (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM r)) AS missing, (SELECT count(DISTINCT doc_id) FROM r WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS unexpected, count(*) - count(DISTINCT doc_id) AS repeated FROM r""",
    "recall_delta_interval": f"""WITH {_ARMS}, {_DRAWS.format(values="count_if(gold = 'contradicted') AS x, count_if(gold = 'contradicted' AND arm_b = 'contradicted') AS y, count_if(gold = 'contradicted' AND arm_a = 'contradicted') AS z", rows="a")},
b AS (SELECT sample, CASE WHEN sum(x) > 0 THEN (sum(y) - sum(z)) / sum(x) ELSE 0 END AS statistic FROM g JOIN s USING (slot) GROUP BY sample)
SELECT quantile_cont(statistic, 0.025) AS low, quantile_cont(statistic, 0.975) AS high FROM b""",
    "paired_recall_delta_interval": f"""WITH {SCORED_LABELS}, {_DRAWS.format(values="count_if(doc_id % 3 < 2) AS x, count_if(y_score >= 0.4::DOUBLE AND y_true = 1) AS y, count_if(y_true = 1 AND y_pred = 1) AS z", rows="p")},
b AS (SELECT (sum(y) - sum(z)) / sum(x) AS v, row_number() OVER (ORDER BY (sum(y) - sum(z)) / sum(x)) - 1 AS i FROM g JOIN s USING (slot) GROUP BY sample HAVING sum(x) > 0)
SELECT count(*)::INT AS samples, max(v) FILTER (i = floor(0.025 * 199)) AS low, max(v) FILTER (i = ceil(0.975 * 199)) AS high FROM b""",
    "threshold_metrics": f"""WITH {SCORED_LABELS}, c AS (SELECT count(*) AS records, count_if(y_true = 1 AND y_score >= 0.35::DOUBLE) AS tp, count_if(y_true <> 1 AND y_score >= 0.35::DOUBLE) AS fp, count_if(y_true = 1 AND y_score < 0.35::DOUBLE) AS fn, count_if(y_true <> 1 AND y_score < 0.35::DOUBLE) AS tn, avg((y_score - (y_true = 1)::INT) ** 2) AS brier FROM p)
SELECT *, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) AS f1, 0.35::DOUBLE AS threshold FROM c""",
    "system_summary": """WITH c AS (SELECT s AS system, source, toxic = 1 AS defect, CASE WHEN s = 'length' THEN n_chars % 3 = 0 ELSE l.doc_id % 2 = 0 END AS found FROM labels l JOIN documents d ON d.doc_id = l.doc_id, (SELECT unnest(['length', 'id']) AS s)),
k AS (SELECT system, count_if(defect AND found) AS tp, count_if(defect AND NOT found) AS fn, count_if(NOT defect AND found) AS fp, count_if(NOT defect AND NOT found) AS tn FROM c GROUP BY 1),
f AS (SELECT system, avg(full_::INT) AS family_coverage FROM (SELECT system, source, bool_and(found) AS full_ FROM c WHERE defect GROUP BY 1, 2) GROUP BY 1),
r AS (SELECT *, tp / (tp + fn) AS p, (tp + fn)::DOUBLE AS n, tn / (tn + fp) AS q, (tn + fp)::DOUBLE AS m, 1.96::DOUBLE * 1.96 AS z FROM k JOIN f USING (system))
SELECT system, tp, fn, fp, tn, p AS sensitivity, greatest(0, (p + z / (2 * n) - sqrt(z * (p * (1 - p) / n + z / (4 * n * n)))) / (1 + z / n)) AS sensitivity_low, least(1, (p + z / (2 * n) + sqrt(z * (p * (1 - p) / n + z / (4 * n * n)))) / (1 + z / n)) AS sensitivity_high,
  q AS specificity, greatest(0, (q + z / (2 * m) - sqrt(z * (q * (1 - q) / m + z / (4 * m * m)))) / (1 + z / m)) AS specificity_low, least(1, (q + z / (2 * m) + sqrt(z * (q * (1 - q) / m + z / (4 * m * m)))) / (1 + z / m)) AS specificity_high, (p + q) / 2 AS balanced_accuracy, family_coverage FROM r""",
    "pairwise_counts": f"""WITH {_ARMS}, r AS (SELECT gold = arm_a AS x, gold = arm_b AS y, gold = 'supported' AS z FROM a)
SELECT 'arm_a' AS first, 'arm_b' AS second, count_if(x AND NOT y) AS first_only, count_if(y AND NOT x) AS second_only, count_if(x <> y) AS discordant FROM r
UNION ALL SELECT 'arm_b', 'majority', count_if(y AND NOT z), count_if(z AND NOT y), count_if(y <> z) FROM r""",
    "mcnemar_counts": f"WITH {_ARMS} SELECT count_if(gold = arm_a AND gold <> arm_b) AS only_a, count_if(gold <> arm_a AND gold = arm_b) AS only_b FROM a",
    "holm_adjust": """WITH t AS (SELECT n_name AS name, (n_nationkey * 7 % 25 + 1) / 1000.0::DOUBLE AS p FROM nation), s AS (SELECT *, p * (count(*) OVER () - row_number() OVER (ORDER BY p, name) + 1) AS s FROM t)
SELECT name, p AS p_value, least(1.0::DOUBLE, max(s) OVER (ORDER BY p, name)) AS adjusted FROM s""",
    "kappa": f"""WITH {SCORED_LABELS}, c AS (SELECT count_if(y_true = 1 AND y_pred = 1) AS x, count_if(y_true = 1 AND y_pred <> 1) AS oa, count_if(y_true <> 1 AND y_pred = 1) AS ob, count_if(y_true <> 1 AND y_pred <> 1) AS z FROM p),
r AS (SELECT (x + z) / (x + oa + ob + z) AS seen, ((x + oa) * (x + ob) + (z + oa) * (z + ob)) / ((x + oa + ob + z) * (x + oa + ob + z)) AS chance FROM c)
SELECT seen AS agreement, CASE WHEN chance <> 1 THEN (seen - chance) / (1.0::DOUBLE - chance) END AS kappa FROM r""",
    "owner_bootstrap": f"WITH {_BOOT} SELECT sample, statistic FROM b",
    "owner_bootstrap_interval": f"WITH {_BOOT} SELECT quantile_cont(statistic, 0.025) AS low, quantile_cont(statistic, 0.975) AS high FROM b",
    "calibration_bins": f"WITH {_BINS} SELECT * FROM b",
    "ece": f"WITH {_BINS} SELECT sum(n * abs(confidence - accuracy)) / sum(n) AS ece FROM b",
    "average_precision_rows": f"""WITH {SCORED_LABELS}, r AS (SELECT (y_true = 1)::INT AS y, row_number() OVER w AS r, sum((y_true = 1)::INT) OVER w AS tp FROM p WINDOW w AS (ORDER BY y_score DESC, doc_id))
SELECT sum(CASE WHEN y = 1 THEN tp / r ELSE 0 END) / sum(y) AS average_precision FROM r""",
    "risk_coverage": f"""WITH {SCORED_LABELS}, b AS (SELECT y_score AS t, count(*) AS n, count_if(y_true <> 1) AS w FROM p GROUP BY 1), c AS (SELECT t, sum(n) OVER (ORDER BY t DESC) AS d, sum(w) OVER (ORDER BY t DESC) AS e FROM b)
SELECT t AS threshold, d::BIGINT AS decisions, d / (SELECT count(*) FROM p) AS coverage, e / d AS risk FROM c""",
    "calibration_pick": f"""WITH {SCORED_LABELS}, t AS (SELECT DISTINCT y_score AS t FROM p), c AS (SELECT t, count(*) AS n, count_if(y_true = 1) AS c, count(DISTINCT source) AS o FROM t JOIN p ON y_score >= t GROUP BY t),
k AS (SELECT *, c / n AS q, 1.959963984540054::DOUBLE AS z FROM c), w AS (SELECT *, greatest(0.0::DOUBLE, (q + z * z / (2.0::DOUBLE * n)) / (1.0::DOUBLE + z * z / n) - z * sqrt(q * (1.0::DOUBLE - q) / n + z * z / (4.0::DOUBLE * n * n)) / (1.0::DOUBLE + z * z / n)) AS low FROM k)
SELECT t AS threshold, n AS selected, c AS correct, o AS owners, q AS precision, low AS wilson_low FROM w WHERE q >= 0.8 AND low >= 0.7 AND n >= 20 AND o >= 3 ORDER BY n DESC, t LIMIT 1""",
    "subgroups": f"""WITH {SCORED_LABELS}, r AS (SELECT 'lang' AS field, lang AS value, * FROM p UNION ALL SELECT 'source', source, * FROM p)
SELECT field, value, count(*) AS n, count(DISTINCT source) AS owners, count_if(y_pred = 1) AS decisions, CASE WHEN count_if(y_pred = 1) > 0 THEN count_if(y_pred = 1 AND y_true = 1) / count_if(y_pred = 1) ELSE 0 END AS precision, count_if(y_pred = 1) / count(*) AS coverage FROM r GROUP BY 1, 2""",
    "selective_action": """WITH e AS (SELECT event_id, (event_id * 37 % 100) / 100.0::DOUBLE AS a, (user_id * 13 % 100) / 100.0::DOUBLE AS b, (event_id * 11 % 60) / 100.0::DOUBLE AS ood, event_type <> 'error' AS el, CASE WHEN event_id % 7 = 0 THEN 0.5 ELSE 1 END AS co FROM events),
r AS (SELECT *, least(a, b, 1.0::DOUBLE - ood) AS r FROM e)
SELECT event_id, r AS reliability, CASE WHEN NOT el OR r < 0.2::DOUBLE THEN 'abstain' WHEN r < 0.5::DOUBLE OR co < 1 THEN 'review' ELSE 'verify' END AS action,
  concat_ws(',', CASE WHEN NOT el THEN 'not_eligible' END, CASE WHEN co < 1 THEN 'incomplete_context' END, CASE WHEN r < 0.2::DOUBLE THEN 'below_review' END, CASE WHEN r >= 0.2::DOUBLE AND r < 0.5::DOUBLE THEN 'below_verify' END) AS reasons FROM r""",
    "greedy_claim_match": f"WITH {_MATCHED} SELECT * FROM r",
    "claim_match_micro": f"""WITH {_MATCHED}, s AS (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, avg((fp = 0 AND fn = 0)::INT::DOUBLE) AS exact_rate FROM r), q AS (SELECT *, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall FROM s)
SELECT tp, fp, fn, precision, recall, 2.0::DOUBLE * precision * recall / (precision + recall) AS f1, exact_rate FROM q""",
    "best_threshold": f"""WITH {SCORED_LABELS}, t AS (SELECT y_score AS t FROM p UNION SELECT 0.0::DOUBLE UNION SELECT 0.5::DOUBLE UNION SELECT 1.0::DOUBLE), c AS (SELECT t, count(y_score) AS n, count_if(y_true = 1) AS c FROM t LEFT JOIN p ON y_score >= t GROUP BY t)
SELECT t AS threshold, 2 * c / (n + (SELECT count_if(y_true = 1) FROM p)) AS f1 FROM c ORDER BY f1 DESC, t DESC LIMIT 1""",
}
