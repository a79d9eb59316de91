"""Statistics used to judge extractors and rankers: arms, paired tests, calibration, selection, bootstrap.

Random draws are hashes of (seed, sample, slot), so that any engine can repeat them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions.stats import Z95_EXACT, cohen_kappa, mcnemar_exact, ratio, wilson
from attestra.operators.classification import running


STATUSES = ("supported", "contradicted", "not_verifiable")


def coverage(gold: DataFrame, arm: DataFrame, key: str) -> DataFrame:
    """(missing, unexpected, repeated): keys of gold that the arm lacks, keys it has besides, and rows of it that repeat a key; all 0 if it covers gold exactly."""
    a = gold.groupBy(key).agg(F.lit(1).alias("g"))
    b = arm.groupBy(key).agg(F.count("*").alias("n"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    both = a.join(b, key, "full_outer")
    return both.agg(zero(F.col("n").isNull().cast("int")).alias("missing"), zero(F.col("g").isNull().cast("int")).alias("unexpected"), zero(F.col("n") - 1).alias("repeated"))


def class_scores(df: DataFrame, gold: str, arm: str, statuses: tuple[str, ...] = STATUSES) -> DataFrame:
    """(status, support, guessed, hits, precision, recall, f1) of every status, whether it occurs or not; empty denominators count as 1.

    A status that isn't among them is an error of the job.
    """
    known = lambda c: F.when(F.col(c).isin(*statuses), F.col(c)).otherwise(F.raise_error(F.concat(F.lit("unknown status: "), F.coalesce(F.col(c), F.lit("null")))))
    cells = df.groupBy(known(gold).alias("g"), known(arm).alias("a")).agg(F.count("*").alias("n"))
    sums = [F.coalesce(F.sum(F.when(w, F.col("n"))), F.lit(0)).cast("bigint") for s in statuses for w in (F.col("g") == s, F.col("a") == s, (F.col("g") == s) & (F.col("a") == s))]
    one = cells.agg(F.array(*[F.struct(F.lit(s).alias("status"), *[c.alias(x) for c, x in zip(sums[3 * i : 3 * i + 3], ("support", "guessed", "hits"), strict=True)]) for i, s in enumerate(statuses)]).alias("x"))
    rows = one.select(F.explode("x").alias("x")).select("x.*")
    rows = rows.withColumn("precision", ratio(F.col("hits"), F.col("guessed"), 1.0)).withColumn("recall", ratio(F.col("hits"), F.col("support"), 1.0))
    return rows.withColumn("f1", ratio(2.0 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def arm_scores(df: DataFrame, gold: str, arm: str, positive: str, statuses: tuple[str, ...] = STATUSES) -> DataFrame:
    """(n, accuracy, macro_f1, recall_positive, false_accusation_rate) of a column of statuses against gold ones.

    All statuses count for macro_f1; the rate of accusations is 0 where no case could be accused wrongly.
    """
    of = lambda c: F.sum(F.when(F.col("status") == positive, F.col(c)).otherwise(0))
    total = class_scores(df, gold, arm, statuses).agg(F.sum("support").alias("n"), F.sum("hits").alias("hits"), F.avg("f1").alias("macro_f1"), of("recall").alias("recall_positive"), of("guessed").alias("g"), of("hits").alias("h"), of("support").alias("s"))
    return total.select("n", ratio(F.col("hits"), F.col("n")).alias("accuracy"), "macro_f1", "recall_positive", ratio(F.col("g") - F.col("h"), F.col("n") - F.col("s")).alias("false_accusation_rate"))


def recall_delta(arm: str, other: str, gold: str, positive: str) -> tuple[dict[str, Column], Column]:
    """Values and statistic for cluster_bootstrap(): how much more of the positive cases an arm finds than another; 0 in a draw without any."""
    is_positive = F.col(gold) == positive
    values = {"cases": is_positive.cast("bigint"), "ours": (is_positive & (F.col(arm) == positive)).cast("bigint"), "theirs": (is_positive & (F.col(other) == positive)).cast("bigint")}
    return values, ratio(F.col("ours") - F.col("theirs"), F.col("cases"))


def paired_recall_delta(selected: Column, correct: Column, baseline: Column, eligible: Column) -> tuple[dict[str, Column], Column]:
    """As recall_delta(), for a selective system against a baseline among eligible cases; null in a draw without any, which interval() leaves out."""
    values = {"eligible": eligible.cast("bigint"), "system": (selected & correct).cast("bigint"), "base": baseline.cast("bigint")}
    return values, F.when(F.col("eligible") > 0, (F.col("system") - F.col("base")) / F.col("eligible"))


def step_interval(samples: DataFrame, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """(samples, low, high): order statistics of the statistic without interpolation, rounded outwards; 0 and 0 without any."""
    s = samples.agg(F.array_sort(F.collect_list("statistic")).alias("x"))  # a row a draw
    n = F.size("x")
    at = lambda i: F.coalesce(F.get("x", i.cast("int")), F.lit(0.0))
    return s.select(n.alias("samples"), at(F.floor((n - 1) * F.lit(low))).alias("low"), at(F.ceil((n - 1) * F.lit(high))).alias("high"))


def threshold_metrics(df: DataFrame, score: str, actual: Column, threshold: float) -> DataFrame:
    """(records, tp, fp, fn, tn, precision, recall, f1, brier, threshold) of score >= threshold; empty denominators count as 0."""
    guess = F.col(score) >= threshold
    n = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    y = actual.cast("double")
    out = df.agg(F.count("*").alias("records"), n(actual & guess).alias("tp"), n(~actual & guess).alias("fp"), n(actual & ~guess).alias("fn"), n(~actual & ~guess).alias("tn"), F.avg((F.col(score) - y) * (F.col(score) - y)).alias("brier"))
    out = out.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    out = out.withColumn("f1", ratio(2.0 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return out.select("records", "tp", "fp", "fn", "tn", "precision", "recall", "f1", "brier", F.lit(threshold).alias("threshold"))


def system_summary(cases: DataFrame, system: str, defect: Column, detected: Column, family: str) -> DataFrame:
    """Of each system: (system, tp, fn, fp, tn, sensitivity, sensitivity_low, sensitivity_high, specificity, specificity_low, specificity_high, balanced_accuracy, family_coverage).

    A family of defects is covered if all its cases are detected; shares of nothing, and their intervals, are 1.
    """
    n = lambda c: F.sum(c.cast("bigint"))
    families = cases.groupBy(system, family).agg(n(defect & detected).alias("tp"), n(defect & ~detected).alias("fn"), n(~defect & detected).alias("fp"), n(~defect & ~detected).alias("tn"))
    has = (F.col("tp") + F.col("fn") > 0).cast("bigint")
    full = ((F.col("tp") > 0) & (F.col("fn") == 0)).cast("bigint")
    out = families.groupBy(system).agg(*[F.sum(c).alias(c) for c in ("tp", "fn", "fp", "tn")], ratio(F.sum(full), F.sum(has), 1.0).alias("family_coverage"))
    for name, a, b in (("sensitivity", "tp", "fn"), ("specificity", "tn", "fp")):
        total = F.col(a) + F.col(b)
        low, high = wilson(F.col(a) / F.greatest(total, F.lit(1)), F.greatest(total, F.lit(1)))
        some = total > 0
        out = out.withColumn(name, ratio(F.col(a), total, 1.0)).withColumn(f"{name}_low", F.when(some, low).otherwise(1.0)).withColumn(f"{name}_high", F.when(some, high).otherwise(1.0))
    return out.select(F.col(system).alias("system"), "tp", "fn", "fp", "tn", "sensitivity", "sensitivity_low", "sensitivity_high", "specificity", "specificity_low", "specificity_high", ((F.col("sensitivity") + F.col("specificity")) / 2).alias("balanced_accuracy"), "family_coverage")


def pairwise_tests(df: DataFrame, right: dict[str, Column]) -> DataFrame:
    """(first, second, first_only, second_only, discordant, p_value) of each two neighbours among the systems."""
    names = list(right)
    out = None
    for a, b in zip(names, names[1:]):
        one = paired_test(df, right[a], right[b]).select(F.lit(a).alias("first"), F.lit(b).alias("second"), F.col("only_a").alias("first_only"), F.col("only_b").alias("second_only"), (F.col("only_a") + F.col("only_b")).alias("discordant"), "p_value")
        out = one if out is None else out.unionByName(one)
    return out


def paired_test(df: DataFrame, right_a: Column, right_b: Column) -> DataFrame:
    """(only_a, only_b, p_value): discordant pairs and McNemar's exact two-sided p."""
    counts = df.agg(F.sum((right_a & ~right_b).cast("bigint")).alias("only_a"), F.sum((~right_a & right_b).cast("bigint")).alias("only_b"))
    return counts.select("only_a", "only_b", mcnemar_exact(F.col("only_a"), F.col("only_b")).alias("p_value"))


def holm(tests: DataFrame, name: str = "name", p: str = "p_value") -> DataFrame:
    """(name, p_value, adjusted): step-down adjustment; one row a test, so few rows."""
    m = tests.agg(F.count("*").alias("m"))
    order = Window.orderBy(p, name)
    scaled = tests.crossJoin(m).withColumn("s", F.col(p) * (F.col("m") - F.row_number().over(order) + 1))
    return scaled.select(F.col(name).alias("name"), F.col(p).alias("p_value"), F.least(F.lit(1.0), F.max("s").over(order.rowsBetween(Window.unboundedPreceding, 0))).alias("adjusted"))


def kappa(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """(agreement, kappa) of two yes/no columns."""
    n = lambda c: F.sum(c.cast("bigint"))
    counts = df.agg(n(a & b).alias("both"), n(a & ~b).alias("oa"), n(~a & b).alias("ob"), n(~a & ~b).alias("none"))
    c = [F.col(x) for x in ("both", "oa", "ob", "none")]
    return counts.select(((c[0] + c[3]) / (c[0] + c[1] + c[2] + c[3])).alias("agreement"), cohen_kappa(*c).alias("kappa"))


def draw(seed: int, sample: Column, slot: Column, n: Column) -> Column:
    """A number in [0, n) that depends on seed, sample and slot alone."""
    h = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), sample, slot), 256), 1, 12), 16, 10).cast("bigint")
    return F.pmod(h, n)


def cluster_bootstrap(df: DataFrame, cluster: str, values: dict[str, Column], statistic: Column, samples: int = 1000, seed: int = 20260821) -> DataFrame:
    """(sample, statistic) of ``samples`` draws of clusters with replacement.

    Rows are first summed by cluster (``values``), so a draw costs one row a cluster;
    ``statistic`` is of those sums.  Draws without clusters that count have a null.
    """
    sums = df.groupBy(F.col(cluster).alias("k")).agg(*[F.sum(c).alias(n) for n, c in values.items()])
    ranked = sums.withColumn("slot", F.row_number().over(Window.orderBy("k")) - 1)
    n = ranked.agg(F.count("*").alias("clusters"))
    grid = df.sparkSession.range(samples).select(F.col("id").alias("sample")).crossJoin(ranked.select(F.col("slot").alias("place"))).crossJoin(n)
    drawn = grid.withColumn("slot", draw(seed, F.col("sample"), F.col("place"), F.col("clusters")).cast("int"))
    return drawn.join(ranked, "slot").groupBy("sample").agg(*[F.sum(c).alias(c) for c in values]).select("sample", statistic.alias("statistic"))


def interval(samples: DataFrame, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """(low, high): linear quantiles of the statistic."""
    return samples.agg(F.percentile("statistic", F.lit(low)).alias("low"), F.percentile("statistic", F.lit(high)).alias("high"))


def calibration_bins(df: DataFrame, score: str, correct: Column, bins: int = 10) -> DataFrame:
    """(bin, n, confidence, accuracy); the last bin is closed."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("confidence"), F.avg(correct.cast("double")).alias("accuracy"))


def expected_calibration_error(bins: DataFrame) -> DataFrame:
    return bins.agg((F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))) / F.sum("n")).alias("ece"))


def average_precision(df: DataFrame, score: str, correct: Column, position: str) -> DataFrame:
    """(average_precision) row by row in order of score, ties by position, a number; 0 without correct rows.

    Rows are windowed in ranges of scores, and those of one frequent score in ranges of positions.
    """
    rows = df.select(F.col(score).alias("s"), F.col(position).alias("p"), correct.cast("bigint").alias("y"))
    marks = rows.approxQuantile(["s", "p"], [i / 64 for i in range(1, 64)], 0.002)
    often = {a for a, b in zip(marks[0], marks[0][1:]) if a == b}
    scores = sorted({*marks[0], *(math.nextafter(m, math.inf) for m in often)})
    count = lambda ms, c: sum(((F.lit(m) <= c).cast("int") for m in ms), F.lit(0))
    places = sorted(set(marks[1])) if often else []
    cell = F.struct((-count(scores, F.col("s"))).alias("a"), (F.when(F.col("s").isin(*often), count(places, F.col("p"))).otherwise(0) if often else F.lit(0)).alias("b"))
    rows = rows.withColumn("cell", cell)
    # at most 128 cells, or with frequent scores 128 x 64
    before, taken, hits = [], 0, 0
    for r in sorted(rows.groupBy("cell").agg(F.count("*").alias("n"), F.sum("y").alias("y")).collect(), key=lambda r: tuple(r["cell"])):
        before.append((tuple(r["cell"]), taken, hits))
        taken, hits = taken + r["n"], hits + r["y"]
    if not hits:
        return df.sparkSession.createDataFrame([(0.0,)], "average_precision double")
    starts = df.sparkSession.createDataFrame(before, "cell struct<a:int,b:int>, n0 bigint, y0 bigint")
    order = Window.partitionBy("cell").orderBy(F.desc("s"), "p")
    ranked = rows.select("cell", "y", F.row_number().over(order).alias("r"), F.sum("y").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("tp"))
    ranked = ranked.filter("y = 1").join(F.broadcast(starts), "cell")
    return ranked.agg((F.sum((F.col("tp") + F.col("y0")) / (F.col("r") + F.col("n0"))) / F.lit(hits)).alias("average_precision"))


def risk_coverage(df: DataFrame, score: str, correct: Column) -> DataFrame:
    """(threshold, decisions, coverage, risk) of every distinct score as the least accepted one."""
    by = df.groupBy(F.col(score).alias("threshold")).agg(F.count("*").alias("n"), F.sum((~correct).cast("bigint")).alias("wrong"))
    total = df.agg(F.count("*").alias("all"))
    cum = running(by, "threshold", {"decisions": "n", "errors": "wrong"}).crossJoin(F.broadcast(total))
    return cum.select("threshold", "decisions", (F.col("decisions") / F.col("all")).alias("coverage"), (F.col("errors") / F.col("decisions")).alias("risk"))


def calibrate(df: DataFrame, score: str, correct: Column, owner: str, target_precision: float = 0.95, target_lower: float = 0.9, minimum: int = 20, minimum_owners: int = 3) -> DataFrame:
    """The admissible threshold that selects most: (threshold, selected, correct, owners, precision, wilson_low), no row if none is admissible.

    An owner counts at every threshold up to its best score.
    """
    by = df.groupBy(F.col(score).alias("threshold")).agg(F.count("*").alias("n"), F.sum(correct.cast("bigint")).alias("c"))
    first = df.groupBy(owner).agg(F.max(score).alias("threshold")).groupBy("threshold").agg(F.count("*").alias("o"))
    joined = by.join(first, "threshold", "left").fillna(0, ["o"])
    cum = running(joined, "threshold", {"selected": "n", "correct": "c", "owners": "o"})
    cum = cum.withColumn("precision", F.col("correct") / F.col("selected"))
    cum = cum.withColumn("wilson_low", wilson(F.col("precision"), F.col("selected"), Z95_EXACT)[0])
    fine = cum.filter((F.col("precision") >= target_precision) & (F.col("wilson_low") >= target_lower) & (F.col("selected") >= minimum) & (F.col("owners") >= minimum_owners))
    return fine.orderBy(F.desc("selected"), "threshold").limit(1).select("threshold", "selected", "correct", "owners", "precision", "wilson_low")


def subgroups(df: DataFrame, fields: list[str], selected: Column, correct: Column, owner: str) -> DataFrame:
    """(field, value, n, owners, decisions, precision, coverage) of each value of each field."""
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x"), selected.alias("s"), correct.alias("c"), F.col(owner).alias("o"))
    by = rows.groupBy("x.field", "x.value").agg(F.count("*").alias("n"), F.count_distinct("o").alias("owners"), F.sum(F.col("s").cast("bigint")).alias("decisions"), F.sum((F.col("s") & F.col("c")).cast("bigint")).alias("hits"))
    return by.select("field", "value", "n", "owners", "decisions", ratio(F.col("hits"), F.col("decisions")).alias("precision"), (F.col("decisions") / F.col("n")).alias("coverage"))


def reliability(scores: list[str], ood: str) -> Column:
    return F.least(*[F.col(s) for s in scores], 1.0 - F.col(ood))


def select_action(reliability: Column, verify: float, review: float, eligible: Column, completeness: Column, minimum_completeness: float = 1.0) -> tuple[Column, Column]:
    """(action, reasons): verify, review or abstain, with every gate that held it back."""
    reasons = F.array_compact(F.array(F.when(~eligible, F.lit("not_eligible")), F.when(completeness < minimum_completeness, F.lit("incomplete_context")), F.when(reliability < review, F.lit("below_review")), F.when((reliability >= review) & (reliability < verify), F.lit("below_verify"))))
    action = F.when(~eligible | (reliability < review), "abstain").when((reliability < verify) | (completeness < minimum_completeness), "review").otherwise("verify")
    return action, reasons


def match_multiset(expected: DataFrame, actual: DataFrame, keys: list[str], case: str) -> DataFrame:
    """(case, tp, fp, fn) where equal keys are matched one to one within a case."""
    count = lambda df, name: df.groupBy(case, *keys).agg(F.count("*").alias(name))
    both = count(expected, "e").join(count(actual, "a"), [case, *keys], "full_outer").fillna(0, ["e", "a"])
    hit = F.least("e", "a")
    return both.groupBy(case).agg(F.sum(hit).alias("tp"), F.sum(F.col("a") - hit).alias("fp"), F.sum(F.col("e") - hit).alias("fn"))


def micro(matched: DataFrame, empty: float = 1.0) -> DataFrame:
    """(tp, fp, fn, precision, recall, f1, exact_rate) over cases."""
    s = matched.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.avg(((F.col("fp") == 0) & (F.col("fn") == 0)).cast("double")).alias("exact_rate"))
    s = s.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"), empty)).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn"), empty))
    return s.withColumn("f1", ratio(2.0 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).select("tp", "fp", "fn", "precision", "recall", "f1", "exact_rate")


def ranking_quality(ranks: DataFrame, rank: str = "rank") -> DataFrame:
    """(cases, recall_at_1, recall_at_3, mrr); a null rank is a miss."""
    hit = lambda k: F.avg(F.coalesce((F.col(rank) <= k).cast("double"), F.lit(0.0)))
    return ranks.agg(F.count("*").alias("cases"), hit(1).alias("recall_at_1"), hit(3).alias("recall_at_3"), F.avg(F.coalesce(1.0 / F.col(rank), F.lit(0.0))).alias("mrr"))


def best_threshold(df: DataFrame, score: str, correct: Column) -> DataFrame:
    """(threshold, f1): of 0, 0.5, 1 and all scores the one with the best F1, the highest of equals."""
    grid = df.select(F.col(score).alias("threshold")).union(df.sparkSession.createDataFrame([(0.0,), (0.5,), (1.0,)], "threshold double")).distinct()
    by = grid.join(df.groupBy(F.col(score).alias("threshold")).agg(F.count("*").alias("n"), F.sum(correct.cast("bigint")).alias("c")), "threshold", "left").fillna(0)
    total = df.agg(F.sum(correct.cast("bigint")).alias("pos"))
    cum = running(by, "threshold", {"taken": "n", "tp": "c"}).crossJoin(F.broadcast(total))
    f1 = ratio(2 * F.col("tp"), F.col("taken") + F.col("pos"))
    return cum.select("threshold", f1.alias("f1")).agg(F.max(F.struct("f1", "threshold")).alias("m")).select("m.threshold", "m.f1")


def balanced_threshold(df: DataFrame, score: str, actual: Column, steps: int = 1000) -> DataFrame:
    """(threshold, tp, tn, fp, fn, accuracy, balanced_accuracy, precision, recall, specificity, f1) of the best of ``steps`` even thresholds.

    Best by balanced accuracy, then F1, then the threshold.  Precision of no guesses is 1,
    other shares of nothing are 0.
    """
    grid = df.sparkSession.range(1, steps + 1).select((F.col("id") / float(steps)).alias("threshold"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("c"), F.lit(1).alias("on_grid"))
    by = df.groupBy(F.col(score).alias("threshold")).agg(F.count("*").alias("n"), F.sum(actual.cast("bigint")).alias("c"), F.lit(0).alias("on_grid"))
    by = by.unionByName(grid).groupBy("threshold").agg(F.sum("n").alias("n"), F.sum("c").alias("c"), F.max("on_grid").alias("on_grid"))
    total = df.agg(F.count("*").alias("all"), F.sum(actual.cast("bigint")).alias("pos"))
    cum = running(by, "threshold", {"taken": "n", "tp": "c"}).filter("on_grid = 1").crossJoin(F.broadcast(total))
    cum = cum.withColumn("fp", F.col("taken") - F.col("tp")).withColumn("fn", F.col("pos") - F.col("tp")).withColumn("tn", F.col("all") - F.col("taken") - F.col("fn"))
    cum = cum.withColumn("precision", ratio(F.col("tp"), F.col("taken"), 1.0)).withColumn("recall", ratio(F.col("tp"), F.col("pos"))).withColumn("specificity", ratio(F.col("tn"), F.col("tn") + F.col("fp")))
    cum = cum.withColumn("balanced_accuracy", (F.col("recall") + F.col("specificity")) / 2).withColumn("accuracy", (F.col("tp") + F.col("tn")) / F.col("all")).withColumn("f1", ratio(2.0 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return cum.orderBy(F.desc("balanced_accuracy"), F.desc("f1"), F.desc("threshold")).limit(1).select("threshold", "tp", "tn", "fp", "fn", "accuracy", "balanced_accuracy", "precision", "recall", "specificity", "f1")
