"""Queries on whole audits: findings, statuses and certificates of the generated reports, and the parts that studies need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.operators import audit as A
from attestra.operators import study as S
from attestra.plans import claims as P
from attestra.sources.shared import kept
from attestra.sources.tables import SCORED_LABELS, scored_labels, table


def evidence_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.conflicts(P._observations(spark, sf_dir), "p_partkey", "position")


def witness_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.conflict_witness(evidence_conflicts(spark, sf_dir), P._observations(spark, sf_dir), "p_partkey", "position")


def audit_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.findings(P.claim_check(spark, sf_dir), evidence_conflicts(spark, sf_dir), "p_partkey").drop("message")


def audit_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the text of every report and its observations to a sealed entry each."""
    return A.reports(table(spark, sf_dir, "part"), P.claim_check(spark, sf_dir), P.evidence_merge(spark, sf_dir), "p_partkey")


def audit_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.batch_status(audit_reports(spark, sf_dir))


def certificate_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sealed entries of which some were tampered with, some dropped and some invented."""
    fresh, key = kept(audit_reports(spark, sf_dir), "entries"), F.col("p_partkey")
    seal = fresh.filter(key % 11 != 0).select("p_partkey", F.when(key % 13 == 0, F.reverse("certificate_sha256")).otherwise(F.col("certificate_sha256")).alias("certificate_sha256"))
    extra = seal.filter(key % 17 == 0).select((-key).alias("p_partkey"), "certificate_sha256")
    return A.certificate_errors(seal.unionByName(extra), fresh, "p_partkey")


def claim_surroundings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every line of the reports the line before it, the 6 before it and the 25 that end two lines before it."""
    lines = P._reports(spark, sf_dir).select("p_partkey", F.posexplode(F.split("text", "\n")).alias("line", "body"))
    out = lines
    for name, back, gap in (("previous", 1, 1), ("prefix", 6, 1), ("nearby", 25, 2)):
        out = A.before_lines(out, "p_partkey", "line", "body", back, gap).withColumnRenamed("before", name)
    return out.drop("body")


def _layers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("metric"), F.floor(F.col("l_quantity") / 10).alias("value"), "l_linenumber")
    return lines.filter("l_linenumber % 3 = 1"), lines.filter("l_linenumber % 3 <> 1")


def layer_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.added_beyond(*_layers(spark, sf_dir), ["l_orderkey", "metric", "value"], "l_linenumber")


def layer_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.added_beyond(*_layers(spark, sf_dir), ["l_orderkey", "metric", "value"], "l_linenumber", only_absent=True)


def evidence_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as claims, their kinds as repositories, and five files for each repository."""
    p = table(spark, sf_dir, "part")
    kind = F.col("p_type")
    claims = p.select(kind.alias("repository"), F.col("p_partkey").alias("claim_id"), F.element_at(F.array(F.lit("accuracy"), F.lit("f1"), F.lit("recall")), (F.col("p_size") % 3 + 1).cast("int")).alias("metric"), F.create_map(F.lit("split"), F.when(F.col("p_size") % 2 == 0, "test").otherwise("dev"), F.lit("model"), F.col("p_brand")).alias("context"))
    n = F.col("n")
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), n + 1)
    files = p.select(kind.alias("repository")).distinct().withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(4))))
    files = files.select("repository", F.concat_ws("#", "repository", n.cast("string")).alias("artifact_id"), pick([*A.ROLES, "other"]).alias("role"), F.when(n == 3, F.array().cast("array<string>")).otherwise(F.array(F.lit("accuracy"), F.when(n == 1, "f1").otherwise("mae"))).alias("metric_names"), F.when(n == 0, F.create_map(F.lit("split"), F.lit(" Test "))).otherwise(F.create_map(F.lit("split"), F.lit("dev"), F.lit("model"), F.lit("Brand#11"))).alias("context"), pick([A.GRADES[0], A.GRADES[1], A.GRADES[1], A.GRADES[2], A.GRADES[2]]).alias("evidence_grade"), (n != 2).alias("integrity_verified"))
    return A.evidence_candidates(claims, files, "repository")


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as answers: users are participants."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    return e.select("user_id", F.when(i % 2 == 0, "manual").otherwise("assisted").alias("condition"), (i % 3 == 0).alias("defect_present"), F.when(i % 5 < 2, "defect").when(i % 5 < 4, "clean").otherwise("unsure").alias("verdict"), F.col("value").alias("duration_seconds"), (i % 10 / 10.0).alias("confidence")).withColumn("correct", F.col("verdict") == F.when(F.col("defect_present"), "defect").otherwise("clean"))


def condition_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.condition_summary(_responses(spark, sf_dir))


def participant_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.participant_differences(_responses(spark, sf_dir), "user_id")


def trial_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    claims = scored_labels(spark, sf_dir).select(F.col("source").alias("owner"), F.element_at(F.array(F.lit("natural_a"), F.lit("natural_b"), F.lit("controlled_mutation")), (d % 3 + 1).cast("int")).alias("stratum"), F.when(F.col("y_true") == 0, "contradicted").when(d % 4 == 0, "not_verifiable").otherwise("supported").alias("gold_status"), F.when(d % 5 == 0, "report_only").otherwise("metrics").alias("evidence_tier"))
    return A.trial_counts(claims, ["natural_a", "natural_b"])


def balanced_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.balanced_threshold(scored_labels(spark, sf_dir), "y_score", F.col("y_true") == 1)


_CONFLICTS = f"""{P._OBS}, x AS (SELECT a.p_partkey, a.metric, a.source AS left_source, a.value AS left_value, b.source AS right_source, b.value AS right_value FROM o a JOIN o b ON a.p_partkey = b.p_partkey AND a.metric = b.metric AND a.source = 'metrics.json' AND b.source = 'predictions.csv' AND abs(a.value - b.value) > 0.005::DOUBLE)"""
_FINDINGS = f"""{P._CHECKS}, xc AS (SELECT a.p_partkey, a.metric FROM o a JOIN o b ON a.p_partkey = b.p_partkey AND a.metric = b.metric AND a.source = 'metrics.json' AND b.source = 'predictions.csv' AND abs(a.value - b.value) > 0.005::DOUBLE),
found AS (SELECT p_partkey, 'high' AS severity, 'metric_evidence_conflict' AS code, metric, NULL::INT AS line FROM xc
UNION ALL SELECT p_partkey, CASE status WHEN 'mismatch' THEN 'high' ELSE 'medium' END, CASE status WHEN 'mismatch' THEN 'claim_metric_mismatch' ELSE 'claim_without_evidence' END, metric, line FROM k WHERE status IN ('mismatch', 'no_evidence'))"""
_REPORTS = f"""{_FINDINGS}, y AS (SELECT p_partkey, count(*) AS claims FROM k GROUP BY 1), z AS (SELECT p_partkey, count(*) AS findings, '["' || string_agg(code, '","' ORDER BY code) || '"]' AS codes FROM found GROUP BY 1),
w AS (SELECT part.p_partkey, coalesce(claims, 0) AS claims, coalesce(findings, 0) AS findings, coalesce(codes, '[]') AS codes, CASE WHEN findings > 0 THEN 'needs_review' ELSE 'passed' END AS status FROM part LEFT JOIN y USING (p_partkey) LEFT JOIN z USING (p_partkey)),
entries AS (SELECT p_partkey, status, claims, findings, sha256('{{"claims":' || claims || ',"codes":' || codes || ',"findings":' || findings || ',"id":"' || p_partkey || '","status":"' || status || '"}}') AS certificate_sha256 FROM w)"""
_LAYERS = """t AS (SELECT l_orderkey, l_returnflag AS metric, floor(l_quantity / 10)::BIGINT AS value, l_linenumber FROM lineitem),
h AS (SELECT l_orderkey, metric, value, count(*) AS n FROM t WHERE l_linenumber % 3 = 1 GROUP BY 1, 2, 3),
r AS (SELECT t.*, row_number() OVER (PARTITION BY l_orderkey, metric, value ORDER BY l_linenumber) AS r, coalesce(n, 0) AS n FROM t LEFT JOIN h USING (l_orderkey, metric, value) WHERE l_linenumber % 3 <> 1)"""
_RESPONSES = """e AS (SELECT user_id, CASE WHEN event_id % 2 = 0 THEN 'manual' ELSE 'assisted' END AS condition, event_id % 3 = 0 AS bad, CASE WHEN event_id % 5 < 2 THEN 'defect' WHEN event_id % 5 < 4 THEN 'clean' ELSE 'unsure' END AS verdict, value AS t, (event_id % 10) / 10.0::DOUBLE AS confidence FROM events),
a AS (SELECT *, (verdict = CASE WHEN bad THEN 'defect' ELSE 'clean' END)::INT::DOUBLE AS correct FROM e)"""

QUERIES = {f.__name__: f for f in (evidence_conflicts, witness_conflict, audit_findings, audit_reports, audit_batch, certificate_errors, claim_surroundings, layer_difference, layer_absent, evidence_features, condition_summary, participant_differences, trial_counts, balanced_threshold)}
ORACLE = {
    "evidence_conflicts": f"WITH {_CONFLICTS} SELECT * FROM x",
    "witness_conflict": f"WITH {_CONFLICTS} SELECT p_partkey, metric, 1 AS left_node, 2 AS right_node FROM x",
    "audit_findings": f"WITH {_FINDINGS} SELECT * FROM found",
    "audit_reports": f"WITH {_REPORTS} SELECT * FROM entries",
    "audit_batch": f"WITH {_REPORTS} SELECT CASE WHEN count_if(status = 'needs_review') > 0 THEN 'needs_review' ELSE 'passed' END AS status, count(*) AS experiments, count_if(status = 'needs_review') AS needing_review FROM entries",
    "certificate_errors": f"WITH {_REPORTS} SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'absent' ELSE 'changed' END AS error FROM entries WHERE p_partkey % 11 = 0 OR p_partkey % 13 = 0 UNION ALL SELECT -p_partkey, 'unexpected' FROM entries WHERE p_partkey % 11 <> 0 AND p_partkey % 17 = 0",
    "claim_surroundings": f"""WITH {P._TEXT}, l AS (SELECT p_partkey, string_split(text, chr(10)) AS a, unnest(range(len(string_split(text, chr(10))))) AS line FROM r)
SELECT p_partkey, line::INT AS line, CASE WHEN line > 0 THEN a[line] ELSE '' END AS previous, array_to_string(a[greatest(line - 5, 1):line], chr(10)) AS prefix, CASE WHEN line > 1 THEN array_to_string(a[greatest(line - 25, 1):line - 1], chr(10)) ELSE '' END AS nearby FROM l""",
    "layer_difference": f"WITH {_LAYERS} SELECT l_orderkey, metric, value, l_linenumber FROM r WHERE r > n",
    "layer_absent": f"WITH {_LAYERS} SELECT l_orderkey, metric, value, l_linenumber FROM r WHERE n = 0 AND r = 1",
    "evidence_features": """WITH c AS (SELECT p_type, p_partkey AS claim_id, ['accuracy', 'f1', 'recall'][p_size % 3 + 1] AS metric, p_size % 2 = 0 AS test, p_brand FROM part),
j AS (SELECT claim_id, n, p_type || '#' || n AS artifact_id, (metric = 'accuracy' AND n <> 3 OR metric = 'f1' AND n = 1)::INT::DOUBLE AS f, CASE WHEN n = 0 THEN test::INT ELSE (NOT test)::INT + (p_brand = 'Brand#11')::INT END AS m, CASE WHEN n = 0 THEN (NOT test)::INT ELSE test::INT + (p_brand <> 'Brand#11')::INT END AS x FROM c, (SELECT unnest([0, 1, 2, 3]) AS n))
SELECT claim_id, artifact_id, (m + f) / 3 AS completeness, x = 0 AS compatible, f AS metric_match, (n = 3)::INT::DOUBLE AS metric_missing, m / 2 AS context_match_ratio, (2 - m - x) / 2 AS context_missing_ratio, x / 2 AS context_conflict_ratio,
  (n = 0)::INT::DOUBLE AS raw_recomputed, (n IN (1, 2))::INT::DOUBLE AS structured_reported, (n = 3)::INT::DOUBLE AS text_reported, (n = 0)::INT::DOUBLE AS role_predictions, (n = 1)::INT::DOUBLE AS role_metrics, (n = 2)::INT::DOUBLE AS role_detection, (n = 3)::INT::DOUBLE AS role_report, (n <> 2)::INT::DOUBLE AS integrity_verified FROM j""",
    "condition_summary": f"WITH {_RESPONSES} SELECT condition, count(*) AS responses, avg(correct) AS accuracy, median(t) AS median_duration_seconds, avg(confidence) AS mean_confidence, count_if(NOT bad AND verdict = 'defect') AS false_positives, count_if(bad AND verdict = 'clean') AS false_negatives FROM a GROUP BY 1",
    "participant_differences": f"WITH {_RESPONSES} SELECT user_id, avg(correct) FILTER (condition = 'assisted') - avg(correct) FILTER (condition = 'manual') AS accuracy_difference, median(t) FILTER (condition = 'assisted') - median(t) FILTER (condition = 'manual') AS median_time_difference FROM a GROUP BY 1",
    "trial_counts": f"""WITH {SCORED_LABELS}, c AS (SELECT source, CASE WHEN y_true = 0 THEN 'contradicted' WHEN doc_id % 4 = 0 THEN 'not_verifiable' ELSE 'supported' END AS g, doc_id % 5 = 0 AS r FROM p WHERE doc_id % 3 < 2)
SELECT count(DISTINCT source) AS repository_owners, count(*) AS claims, count_if(g = 'contradicted') AS contradicted_claims, count_if(g = 'not_verifiable') AS not_verifiable_claims, count_if(g = 'supported' AND NOT r) AS supported_evidence_claims FROM c""",
    "balanced_threshold": f"""WITH {SCORED_LABELS}, g AS (SELECT i / 1000.0::DOUBLE AS t FROM range(1, 1001) r(i)), c AS (SELECT t, count_if(y_true = 1 AND y_score >= t) AS tp, count_if(y_true <> 1 AND y_score >= t) AS fp, count_if(y_true = 1 AND y_score < t) AS fn, count_if(y_true <> 1 AND y_score < t) AS tn FROM g, p GROUP BY t),
m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END AS specificity FROM c),
f AS (SELECT *, (recall + specificity) / 2 AS balanced_accuracy, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM m)
SELECT t AS threshold, tp, tn, fp, fn, (tp + tn) / (tp + tn + fp + fn) AS accuracy, balanced_accuracy, precision, recall, specificity, f1 FROM f ORDER BY balanced_accuracy DESC, f1 DESC, t DESC LIMIT 1""",
}
