"""Metric evidence: cleaning, flattening, ordered merging with conflicts, and the evidence graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions import names as N
from attestra.operators.claims import parse_number


def clean_metrics(items: DataFrame, key: str, name: str = "name", value: str = "value") -> DataFrame:
    """(key, metric, value) of reported (name, value) text: names canonical, percentages rescued, values without a number left out.

    Values outside their metric's range, and metrics that a key has twice, are errors of the job.
    """
    raw = F.trim(F.col(value).cast("string"))
    number = parse_number(F.rtrim(F.replace(raw, F.lit("%"), F.lit(""))))
    metric = N.canonical_column(F.col(name))
    out = items.select(key, metric.alias("metric"), number.alias("v")).filter("v is not null")
    v = F.when(N.is_unit_interval(F.col("metric")) & (F.col("v") > 1.0) & (F.col("v") <= 100.0), F.col("v") / 100.0).otherwise(F.col("v"))
    wrong = (N.is_unit_interval(F.col("metric")) & ((v < 0) | (v > 1))) | (N.is_nonnegative(F.col("metric")) & (v < 0)) | ((F.col("metric") == "r2") & (v > 1))
    checked = F.when(wrong, F.raise_error(F.concat(F.lit("out of range: "), F.col("metric")))).otherwise(v)
    once = F.count("*").over(Window.partitionBy(key, "metric"))
    return out.select(key, "metric", checked.alias("value"), once.alias("n")).select(key, "metric", F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("reported twice: "), F.col("metric")))).otherwise(F.col("value")).alias("value"))


def merge(observations: DataFrame, key: str, order: str, tolerance: float = 0.005) -> DataFrame:
    """(key, metric, value, source, conflicts): the observation that stands after reading all in order.

    An observation replaces the one that stands if its priority is no lower; it is counted as
    a conflict if it differs from it by over the tolerance.  A fold over the few observations of one metric.
    """
    item = F.struct(F.col(order).alias("o"), F.col("value").alias("v"), F.col("source").alias("s"), F.col("priority").alias("p"))
    ordered = observations.groupBy(key, "metric").agg(F.sort_array(F.collect_list(item)).alias("x"))
    start = F.struct(F.lit(None).cast("double").alias("v"), F.lit(None).cast("string").alias("s"), F.lit(-1).alias("p"), F.lit(0).alias("c"))

    def step(s, x):
        differs = s["v"].isNotNull() & (F.abs(x["v"] - s["v"]) > tolerance)
        takes = x["p"] >= s["p"]
        return F.struct(F.when(takes, x["v"]).otherwise(s["v"]).alias("v"), F.when(takes, x["s"]).otherwise(s["s"]).alias("s"), F.when(takes, x["p"]).otherwise(s["p"]).alias("p"), (s["c"] + F.coalesce(differs.cast("int"), F.lit(0))).alias("c"))

    return ordered.withColumn("r", F.aggregate("x", start, step)).select(key, "metric", F.col("r.v").alias("value"), F.col("r.s").alias("source"), F.col("r.c").alias("conflicts"))


def graph_nodes(checks: DataFrame, observations: DataFrame, key: str) -> DataFrame:
    """(key, node_id, kind, label): the experiment, its metrics, claims and findings, numbered by kind in a fixed order."""
    root = checks.select(key).union(observations.select(key)).distinct().select(key, F.lit("experiment").alias("kind"), F.lit("experiment").alias("label"), F.lit(1).alias("n"))
    number = lambda *c: F.row_number().over(Window.partitionBy(key).orderBy(*c))
    metrics = observations.select(key, F.lit("metric").alias("kind"), F.col("metric").alias("label"), number("metric", "source", "value").alias("n"))
    claimed = checks.select(key, F.lit("claim").alias("kind"), F.concat_ws(" ", "metric", "status").alias("label"), number("line", "position").alias("n"))
    bad = checks.filter("status = 'mismatch'")
    findings = bad.select(key, F.lit("finding").alias("kind"), F.concat(F.lit("mismatch "), F.col("metric")).alias("label"), number("line", "position").alias("n"))
    every = root.unionByName(metrics).unionByName(claimed).unionByName(findings)
    return every.select(key, F.concat_ws(":", "kind", F.lpad(F.col("n").cast("string"), 4, "0")).alias("node_id"), "kind", "label")


def graph_edges(checks: DataFrame, observations: DataFrame, key: str) -> DataFrame:
    """(key, source, target, relation): metrics support or contradict claims of their name, claims raise findings.  The checks are made once."""
    four = lambda n: F.lpad(n.cast("string"), 4, "0")
    order = lambda *c: Window.partitionBy(key).orderBy(*c)
    m = observations.select(key, "metric", F.concat(F.lit("metric:"), four(F.row_number().over(order("metric", "source", "value")))).alias("source"))
    m = m.groupBy(key, "metric").agg(F.collect_list("source").alias("sources"))
    bad, by = F.col("status") == "mismatch", order("line", "position")
    c = checks.select(key, "metric", "status", F.concat(F.lit("claim:"), four(F.row_number().over(by))).alias("claim"), F.concat(F.lit("finding:"), four(F.count_if(bad).over(by.rowsBetween(Window.unboundedPreceding, 0)))).alias("finding"))
    edge = lambda source, target, relation: F.struct(source.alias("source"), target.alias("target"), relation.alias("relation"))
    none = F.array().cast("array<struct<source:string,target:string,relation:string>>")
    judged = F.when(F.col("status") != "no_evidence", F.transform("sources", lambda s: edge(s, F.col("claim"), F.when(bad, "contradicts").otherwise("supports"))))
    raised = F.when(bad, F.array(edge(F.col("claim"), F.col("finding"), F.lit("raises"))))
    found = c.filter("status <> 'no_evidence'").join(m, [key, "metric"], "left")
    return found.select(key, F.inline(F.concat(F.coalesce(judged, none), F.coalesce(raised, none))))


def mismatch_witness(edges: DataFrame, key: str) -> DataFrame:
    """(key, finding, claim, metric): of each finding the least path metric -> claim -> finding."""
    up = edges.filter("relation = 'raises'").select(key, F.col("target").alias("finding"), F.col("source").alias("claim"))
    back = edges.filter("relation = 'contradicts'").select(key, F.col("target").alias("claim"), F.col("source").alias("metric"))
    return up.join(back, [key, "claim"]).groupBy(key, "finding").agg(F.min(F.struct("claim", "metric")).alias("w")).select(key, "finding", "w.claim", "w.metric")


def graph_errors(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """(key, error, subject): node ids that repeat and edge ends that are no node."""
    twice = nodes.groupBy(key, "node_id").count().filter("count > 1").select(key, F.lit("duplicate_node").alias("error"), F.col("node_id").alias("subject"))
    ends = edges.select(key, F.explode(F.array("source", "target")).alias("node_id")).distinct()
    loose = ends.join(nodes, [key, "node_id"], "left_anti").select(key, F.lit("dangling_edge").alias("error"), F.col("node_id").alias("subject"))
    return twice.unionByName(loose)


def mermaid(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """(key, flowchart) of each graph, nodes and edges in order of their ids."""
    n = nodes.groupBy(key).agg(F.concat_ws("\n", F.sort_array(F.collect_list(F.concat(F.lit("  "), F.replace("node_id", F.lit(":"), F.lit("_")), F.lit('["'), F.col("label"), F.lit('"]'))))).alias("n"))
    arrow = F.concat(F.lit("  "), F.replace("source", F.lit(":"), F.lit("_")), F.lit(" -->|"), F.col("relation"), F.lit("| "), F.replace("target", F.lit(":"), F.lit("_")))
    e = edges.groupBy(key).agg(F.concat_ws("\n", F.sort_array(F.collect_list(arrow))).alias("e"))
    return n.join(e, key, "left").select(key, F.concat_ws("\n", F.lit("flowchart LR"), "n", "e").alias("flowchart"))
