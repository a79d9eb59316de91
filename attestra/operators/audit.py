"""From checks and observations to findings, statuses and certificates of many reports at once, and what stands before a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Codes of findings: of checks by their status, and of conflicts of evidence.
CHECK_CODES = {"mismatch": "claim_metric_mismatch", "no_evidence": "claim_without_evidence"}
CONFLICT_CODE = "metric_evidence_conflict"


def conflicts(observations: DataFrame, key: str, order: str, tolerance: float = 0.005) -> DataFrame:
    """(key, metric, left_source, left_value, right_source, right_value): each observation that differs by over the tolerance from the one that stood when it came.

    A fold over the few observations of one metric, as in evidence.merge().
    """
    item = F.struct(F.col(order).alias("o"), F.col("value").alias("v"), F.col("source").alias("s"), F.col("priority").alias("p"))
    ordered = observations.groupBy(key, "metric").agg(F.sort_array(F.collect_list(item)).alias("x"))
    pair = "struct<left_source:string,left_value:double,right_source:string,right_value:double>"
    start = F.struct(F.lit(None).cast("double").alias("v"), F.lit(None).cast("string").alias("s"), F.lit(-1).alias("p"), F.array().cast(f"array<{pair}>").alias("c"))

    def step(s, x):
        found = F.struct(s["s"].alias("left_source"), s["v"].alias("left_value"), x["s"].alias("right_source"), x["v"].alias("right_value")).cast(pair)
        differs = s["v"].isNotNull() & (F.abs(x["v"] - s["v"]) > tolerance)
        takes = x["p"] >= s["p"]
        pick = lambda f: F.when(takes, x[f]).otherwise(s[f]).alias(f)
        return F.struct(pick("v"), pick("s"), pick("p"), F.when(differs, F.array_append(s["c"], found)).otherwise(s["c"]).alias("c"))

    return ordered.select(key, "metric", F.explode(F.aggregate("x", start, step)["c"]).alias("c")).select(key, "metric", "c.*")


def conflict_witness(found: DataFrame, observations: DataFrame, key: str, order: str) -> DataFrame:
    """(key, metric, left_node, right_node): for each conflict every two observations of its metric, the earlier first, that have its two sources and values."""
    o = observations.select(key, "metric", F.col(order).alias("node"), "source", "value")
    side = lambda c: o.select(key, "metric", *[F.col(x).alias(f"{c}_{x}") for x in ("node", "source", "value")])
    pairs = side("a").join(side("b"), [key, "metric"]).filter("a_node < b_node and a_source <> b_source")
    same = F.expr("(a_source = left_source and a_value = left_value and b_source = right_source and b_value = right_value) or (a_source = right_source and a_value = right_value and b_source = left_source and b_value = left_value)")
    return pairs.join(found, [key, "metric"]).filter(same).select(key, "metric", F.col("a_node").alias("left_node"), F.col("b_node").alias("right_node")).distinct()


def findings(checks: DataFrame, conflict_rows: DataFrame, key: str) -> DataFrame:
    """(key, severity, code, metric, line, message): conflicts of evidence, claims that don't agree with it, claims without it."""
    four, eight = lambda c: F.format_string("%.4f", c), lambda c: F.format_string("%.8g", c)
    two = conflict_rows.select(key, F.lit("high").alias("severity"), F.lit(CONFLICT_CODE).alias("code"), "metric", F.lit(None).cast("int").alias("line"), F.concat(F.lit("Conflicting "), F.col("metric"), F.lit(" evidence: "), eight("left_value"), F.lit(" from "), F.col("left_source"), F.lit(" versus "), eight("right_value"), F.lit(" from "), F.col("right_source"), F.lit(".")).alias("message"))
    bad = F.col("status") == "mismatch"
    text = F.when(bad, F.concat(F.lit("Claimed "), F.col("metric"), F.lit("="), four("value"), F.lit(", observed "), four("observed"), F.lit("."))).otherwise(F.concat(F.lit("No metric evidence for "), F.col("metric"), F.lit(" claim.")))
    claimed = checks.filter("status in ('mismatch', 'no_evidence')").select(key, F.when(bad, "high").otherwise("medium").alias("severity"), F.when(bad, CHECK_CODES["mismatch"]).otherwise(CHECK_CODES["no_evidence"]).alias("code"), "metric", "line", text.alias("message"))
    return two.unionByName(claimed)


def reports(keys: DataFrame, checks: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """(key, status, claims, findings, certificate_sha256) of every key: needs_review with a finding, else passed.

    The findings are those of findings(), only counted: checks and merged evidence, which
    has its number of conflicts, meet in one aggregation of counts by code.  The checks are
    made once, and the join's hint keeps the counts of all keys from being broadcast.  The
    certificate is the SHA-256 of the canonical JSON of the other columns and of the
    findings' codes, in order.
    """
    codes = sorted([*CHECK_CODES.values(), CONFLICT_CODE])
    row = lambda df, **n: df.select(key, *[n.get(c, F.lit(0)).cast("bigint").alias(c) for c in ("claims", *codes)])
    rows = row(checks, claims=F.lit(1), **{code: F.col("status") == s for s, code in CHECK_CODES.items()}).unionByName(row(evidence, **{CONFLICT_CODE: F.col("conflicts")}))
    n = rows.groupBy(key).agg(*[F.sum(c).alias(c) for c in ("claims", *codes)])
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    each = F.concat(*[F.array_repeat(F.lit(c), zero(c).cast("int")) for c in codes])
    out = keys.select(key).join(n.hint("merge"), key, "left").select(key, zero("claims").alias("claims"), F.size(each).cast("bigint").alias("findings"), each.alias("codes"))
    out = out.withColumn("status", F.when(F.col("findings") > 0, "needs_review").otherwise("passed"))
    return out.select(key, "status", "claims", "findings", _digest(key).alias("certificate_sha256"))


def _digest(key: str):
    return F.sha2(F.to_json(F.struct("claims", "codes", "findings", F.col(key).cast("string").alias("id"), "status")), 256)


def batch_status(entries: DataFrame) -> DataFrame:
    """(status, experiments, needing_review) of reports(): one that needs review makes the batch need it."""
    bad = F.sum((F.col("status") == "needs_review").cast("bigint"))
    return entries.agg(F.when(bad > 0, "needs_review").otherwise("passed").alias("status"), F.count("*").alias("experiments"), F.coalesce(bad, F.lit(0)).alias("needing_review"))


def certificate_errors(sealed: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """(key, error): sealed entries that a fresh audit doesn't bear out: changed, absent or not expected."""
    a, b = sealed.select(key, F.col("certificate_sha256").alias("a")), fresh.select(key, F.col("certificate_sha256").alias("b"))
    error = F.when(F.col("b").isNull(), "unexpected").when(F.col("a").isNull(), "absent").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, key, "full_outer").select(key, error.alias("error")).filter("error is not null")


def before_lines(lines: DataFrame, key: str, line: str, text: str, back: int, gap: int = 1) -> DataFrame:
    """lines with the column ``before``: the ``back`` lines up to ``gap`` lines before each, joined by line feeds; empty at the top."""
    span = Window.partitionBy(key).orderBy(line).rowsBetween(-(back + gap - 1), -gap)
    return lines.withColumn("before", F.array_join(F.collect_list(text).over(span), "\n"))


def added_beyond(known: DataFrame, later: DataFrame, keys: list[str], order: str, only_absent: bool = False) -> DataFrame:
    """The rows of ``later`` that go beyond how often ``known`` has their keys, in order; with ``only_absent`` one of each that it lacks."""
    counts = known.groupBy(*keys).agg(F.count("*").alias("__known"))
    numbered = later.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).join(counts, keys, "left")
    have = F.coalesce("__known", F.lit(0))
    new = (have == 0) & (F.col("__r") == 1) if only_absent else F.col("__r") > have
    return numbered.filter(new).select(*later.columns)


ROLES = ("predictions", "metrics", "detection", "report")
GRADES = ("raw_recomputed", "structured_reported", "text_reported")


def evidence_candidates(claims: DataFrame, artifacts: DataFrame, repository: str) -> DataFrame:
    """Every claim with every artifact of its repository that has a known role: claim_id, artifact_id, completeness, compatible, and the ranker's thirteen features.

    claims(repository, claim_id, metric, context); artifacts(repository, artifact_id, role,
    metric_names, context, evidence_grade, integrity_verified).
    """
    a = artifacts.filter(F.col("role").isin(*ROLES)).withColumnRenamed("context", "there")
    j = claims.join(a, repository)
    keys = F.map_keys("context")
    has = lambda k: F.map_contains_key("there", k)
    same = lambda k: F.lower(F.trim(F.try_element_at("context", k))) == F.lower(F.trim(F.try_element_at("there", k)))
    size = lambda p: F.size(F.filter(keys, p))
    j = j.withColumns({"m": size(lambda k: has(k) & same(k)), "x": size(lambda k: ~has(k)), "c": size(lambda k: has(k) & ~same(k)), "k": F.size(keys), "metric_match": F.array_contains("metric_names", F.col("metric")).cast("double")})
    share = lambda c: (F.col(c) / F.greatest(F.col("k"), F.lit(1)))
    flag = lambda c: c.cast("double")
    return j.select(
        "claim_id",
        "artifact_id",
        ((F.col("m") + F.col("metric_match")) / (F.col("k") + 1)).alias("completeness"),
        (F.col("c") == 0).alias("compatible"),
        "metric_match",
        flag(F.size("metric_names") == 0).alias("metric_missing"),
        share("m").alias("context_match_ratio"),
        share("x").alias("context_missing_ratio"),
        share("c").alias("context_conflict_ratio"),
        *[flag(F.col("evidence_grade") == g).alias(g) for g in GRADES],
        *[flag(F.col("role") == r).alias(f"role_{r}") for r in ROLES],
        flag(F.col("integrity_verified")).alias("integrity_verified"),
    )


def condition_summary(rows: DataFrame) -> DataFrame:
    """(condition, responses, accuracy, median_duration_seconds, mean_confidence, false_positives, false_negatives) of each condition."""
    n = lambda c: F.sum(c.cast("bigint"))
    says = F.col("verdict") == "defect"
    return rows.groupBy("condition").agg(F.count("*").alias("responses"), F.avg(F.col("correct").cast("double")).alias("accuracy"), F.median("duration_seconds").alias("median_duration_seconds"), F.avg("confidence").alias("mean_confidence"), n(~F.col("defect_present") & says).alias("false_positives"), n(F.col("defect_present") & (F.col("verdict") == "clean")).alias("false_negatives"))


def participant_differences(rows: DataFrame, participant: str, first: str = "manual", second: str = "assisted") -> DataFrame:
    """(participant, accuracy_difference, median_time_difference): the second condition's less the first's."""
    of = lambda c, v: F.when(F.col("condition") == c, v)
    right, time = F.col("correct").cast("double"), F.col("duration_seconds")
    return rows.groupBy(participant).agg((F.avg(of(second, right)) - F.avg(of(first, right))).alias("accuracy_difference"), (F.median(of(second, time)) - F.median(of(first, time))).alias("median_time_difference"))


def trial_counts(claims: DataFrame, natural: list[str]) -> DataFrame:
    """(repository_owners, claims, contradicted_claims, not_verifiable_claims, supported_evidence_claims) on the natural strata."""
    status = F.col("gold_status")
    n = lambda c: F.count_if(c)
    return claims.filter(F.col("stratum").isin(*natural)).agg(F.count_distinct("owner").alias("repository_owners"), F.count("*").alias("claims"), n(status == "contradicted").alias("contradicted_claims"), n(status == "not_verifiable").alias("not_verifiable_claims"), n((status == "supported") & (F.col("evidence_tier") != "report_only")).alias("supported_evidence_claims"))
