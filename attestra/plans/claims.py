"""Queries on claims.  No table has reports, so each part is one, its lines made of its columns; each order's line statistics are evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.functions import names as N
from attestra.operators import claims as C
from attestra.operators import evidence as E
from attestra.sources.tables import table

_REPORT = r"""concat('# Report', chr(10), 'Accuracy: ', cast(p_size + 40 as {s}), '% on the test set, F1 = 0,', cast(p_size + 10 as {s}), chr(10),
 'The recall was ', cast(p_partkey % 90 + 5 as {s}), '% and RMSE of ', cast(p_size % 7 as {s}), '.', cast(p_partkey % 10 as {s}), chr(10), 'No figure here.', chr(10), 'throughput 1,', cast(p_partkey % 900 + 100 as {s}))"""


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.expr(_REPORT.format(s="string").replace("chr(10)", "'\\n'")).alias("text"))


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources of figures for each part; the second, recomputed, is right more often."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    one = lambda m, v, s, l, n: p.select("p_partkey", F.lit(m).alias("metric"), v.cast("double").alias("value"), F.lit(s).alias("source"), F.lit(l).alias("evidence_level"), F.lit(n).alias("position"), F.lit(int(l == "recomputed")).alias("priority"))  # noqa: E731, E741
    size, key = F.col("p_size"), F.col("p_partkey")
    return one("accuracy", (size + 40) / 100.0, "metrics.json", "reported", 1).unionByName(one("accuracy", (size + 40 + key % 3) / 100.0, "predictions.csv", "recomputed", 2)).unionByName(one("recall", (key % 90 + 5 + F.when(key % 4 == 0, 3).otherwise(0)) / 100.0, "metrics.json", "reported", 3))


def claim_inline_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.core_claims(_reports(spark, sf_dir), "p_partkey", "text")


def claim_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All layers of extract(); on these reports it finds what the core grammar finds."""
    return C.extract(_reports(spark, sf_dir), "p_partkey", "text").select("p_partkey", "line", "metric", "value")


def evidence_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.merge(_observations(spark, sf_dir), "p_partkey", "position")


def _checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims carry the split they are of, evidence that of its source; every third report's don't agree for accuracy."""
    key = F.col("p_partkey")
    evidence = E.merge(_observations(spark, sf_dir), "p_partkey", "position")
    evidence = evidence.select("p_partkey", "metric", "value", F.when(F.col("source") == "predictions.csv", "recomputed").otherwise("reported").alias("evidence_level"), F.when(F.col("metric") == "accuracy", F.create_map(F.lit("split"), F.lit(" TEST"))).otherwise(F.create_map(F.lit("model"), F.lit("a"))).alias("context"))
    split = F.create_map(F.lit("split"), F.when(key % 3 == 0, "validation").otherwise("test"))
    return C.check(claim_inline_core(spark, sf_dir).withColumn("context", split), evidence, "p_partkey").drop("context")


def claim_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checks(spark, sf_dir)


def evidence_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.graph_nodes(_checks(spark, sf_dir), _observations(spark, sf_dir), "p_partkey")


def evidence_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.graph_edges(_checks(spark, sf_dir), _observations(spark, sf_dir), "p_partkey")


def witness_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.mismatch_witness(evidence_graph_edges(spark, sf_dir), "p_partkey")


def claim_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checks(spark, sf_dir).groupBy("metric", "status").agg(F.count("*").alias("n"))


_TEXT = "r AS (SELECT p_partkey, " + _REPORT.format(s="varchar") + " AS text FROM part)"
_RE = C.CORE.replace("'", "''")
_CANON = "CASE lower(n) " + " ".join(f"WHEN '{a}' THEN '{c}'" for a, c in N.ALIASES.items()) + " END"
_UNIT = ", ".join(f"'{m}'" for m in sorted(N.UNIT_INTERVAL))
_CORE = f"""{_TEXT}, l AS (SELECT p_partkey, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM r),
x AS (SELECT p_partkey, line, unnest(regexp_extract_all(body, '{_RE}', 1)) AS n, unnest(regexp_extract_all(body, '{_RE}', 2)) AS d, unnest(regexp_extract_all(body, '{_RE}', 3)) AS s, unnest(range(len(regexp_extract_all(body, '{_RE}', 1)))) AS position FROM l),
v AS (SELECT p_partkey, line::INT AS line, position::INT AS position, {_CANON} AS metric, s, (CASE WHEN regexp_matches(d, '^-?[1-9]\\d{{0,2}}(,\\d{{3}})+(\\.\\d+)?$') THEN replace(d, ',', '') ELSE replace(d, ',', '.') END)::DOUBLE AS q FROM x),
core AS (SELECT p_partkey, line, position, metric, CASE WHEN s = '%' OR metric IN ({_UNIT}) AND abs(q) > 1 AND abs(q) <= 100 THEN q / 100.0::DOUBLE ELSE q END AS value FROM v)"""
_OBS = """o AS (SELECT p_partkey, 'accuracy' AS metric, (p_size + 40) / 100.0::DOUBLE AS value, 'metrics.json' AS source FROM part
UNION ALL SELECT p_partkey, 'accuracy', (p_size + 40 + p_partkey % 3) / 100.0::DOUBLE, 'predictions.csv' FROM part
UNION ALL SELECT p_partkey, 'recall', (p_partkey % 90 + 5 + CASE WHEN p_partkey % 4 = 0 THEN 3 ELSE 0 END) / 100.0::DOUBLE, 'metrics.json' FROM part),
e AS (SELECT * FROM o WHERE source = 'predictions.csv' OR metric = 'recall')"""
_CHECKS = f"""{_CORE}, {_OBS}, f AS (SELECT c.*, e.value AS o, CASE WHEN e.source = 'predictions.csv' THEN 'recomputed' ELSE 'reported' END AS level, e.metric IS NOT NULL AND NOT (e.metric = 'accuracy' AND c.p_partkey % 3 = 0) AS fits
  FROM core c LEFT JOIN e ON e.p_partkey = c.p_partkey AND e.metric = c.metric),
k AS (SELECT p_partkey, line, position, metric, value, CASE WHEN NOT fits THEN 'no_evidence' WHEN abs(value - o) > 0.005::DOUBLE THEN 'mismatch' WHEN level = 'recomputed' THEN 'verified' ELSE 'supported' END AS status,
  CASE WHEN fits THEN o END AS observed, CASE WHEN fits THEN abs(value - o) END AS difference, 0.005::DOUBLE AS tolerance, CASE WHEN fits THEN level END AS evidence_level, CASE WHEN metric IN ({_UNIT}) THEN 'percentage' ELSE 'scalar' END AS display_kind FROM f)"""
_EDGES = f"""{_CHECKS}, m AS (SELECT *, 'metric:' || lpad((row_number() OVER (PARTITION BY p_partkey ORDER BY metric, source, value))::VARCHAR, 4, '0') AS node FROM o),
c AS (SELECT *, 'claim:' || lpad((row_number() OVER (PARTITION BY p_partkey ORDER BY line, position))::VARCHAR, 4, '0') AS node FROM k),
edges AS (SELECT c.p_partkey, m.node AS source, c.node AS target, CASE WHEN status = 'mismatch' THEN 'contradicts' ELSE 'supports' END AS relation FROM c JOIN m ON m.p_partkey = c.p_partkey AND m.metric = c.metric WHERE status <> 'no_evidence'
UNION ALL SELECT p_partkey, node, 'finding:' || lpad((row_number() OVER (PARTITION BY p_partkey ORDER BY line, position))::VARCHAR, 4, '0'), 'raises' FROM c WHERE status = 'mismatch')"""
QUERIES = {f.__name__: f for f in (claim_inline_core, claim_full, evidence_merge, claim_check, claim_status_counts, evidence_graph_nodes, evidence_graph_edges, witness_mismatch)}
ORACLE = {
    "claim_inline_core": f"WITH {_CORE} SELECT * FROM core",
    "claim_full": f"WITH {_CORE} SELECT p_partkey, line, metric, value FROM core",
    "evidence_merge": f"WITH {_OBS} SELECT e.p_partkey, e.metric, e.value, e.source, CASE WHEN e.metric = 'accuracy' AND abs(e.value - o.value) > 0.005::DOUBLE THEN 1 ELSE 0 END AS conflicts FROM e JOIN o ON o.p_partkey = e.p_partkey AND o.metric = e.metric AND o.source = 'metrics.json'",
    "claim_check": f"WITH {_CHECKS} SELECT * FROM k",
    "claim_status_counts": f"WITH {_CHECKS} SELECT metric, status, count(*) AS n FROM k GROUP BY 1, 2",
    "evidence_graph_nodes": f"""WITH {_CHECKS}, every AS (SELECT DISTINCT p_partkey, 'experiment' AS kind, 'experiment' AS label, 1 AS n FROM o
UNION ALL SELECT p_partkey, 'metric', metric, row_number() OVER (PARTITION BY p_partkey ORDER BY metric, source, value) FROM o
UNION ALL SELECT p_partkey, 'claim', metric || ' ' || status, row_number() OVER (PARTITION BY p_partkey ORDER BY line, position) FROM k
UNION ALL SELECT p_partkey, 'finding', 'mismatch ' || metric, row_number() OVER (PARTITION BY p_partkey ORDER BY line, position) FROM k WHERE status = 'mismatch')
SELECT p_partkey, kind || ':' || lpad(n::VARCHAR, 4, '0') AS node_id, kind, label FROM every""",
    "evidence_graph_edges": f"WITH {_EDGES} SELECT * FROM edges",
    "witness_mismatch": f"WITH {_EDGES} SELECT r.p_partkey, r.target AS finding, r.source AS claim, min(b.source) AS metric FROM edges r JOIN edges b ON b.p_partkey = r.p_partkey AND b.target = r.source WHERE r.relation = 'raises' AND b.relation = 'contradicts' GROUP BY 1, 2, 3",
}
