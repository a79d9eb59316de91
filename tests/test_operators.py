"""Operators on small literal cases."""

import json
import math
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from attestra.functions import canonical, names, stats
from attestra.functions import text as T
from attestra.operators import artifacts, claims, classification, detection, evidence, features, leakage, notebooks, similarity, split, study
from attestra.plans import features as features_plans
from attestra.plans import leakage as leakage_plans
from attestra.sources import readers
from attestra.streaming import screening


def one(df):
    return df.collect()[0]


def test_binary_predictions(spark):
    df = spark.createDataFrame([("0", "0"), ("0", "1"), ("1", "1"), ("1", "1")], "y_true string, y_pred string")
    a = one(classification.accuracy(df))
    assert a["accuracy"] == 0.75 and a["n"] == 4 and 0 < a["ci_low"] < 0.75 < a["ci_high"] <= 1
    b = one(classification.binary(classification.per_label(df), "1"))
    assert (b["precision"], b["recall"], b["dice"], b["iou"]) == pytest.approx((2 / 3, 1.0, 0.8, 2 / 3))
    s = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1)], "y_true int, y_score double")
    yes = F.col("y_true") == 1
    assert one(classification.auroc(s, yes))[0] == 0.75
    assert one(classification.auprc(s, yes))[0] == pytest.approx(5 / 6)
    p = one(classification.log_loss_brier(s, yes))
    assert (p["log_loss"], p["brier"]) == pytest.approx((0.5442084719221214, 0.1875))
    assert one(classification.auroc(s.filter("y_true = 1"), yes))[0] is None


def test_running_sums_cross_cells(spark):
    df = spark.range(1000).select((F.col("id") % 250).cast("double").alias("s"), F.lit(1).alias("x")).groupBy("s").agg(F.sum("x").alias("x"))
    got = {r["s"]: r["c"] for r in classification.running(df, "s", {"c": "x"}, ascending=True, buckets=16).collect()}
    assert got == {float(i): 4 * (i + 1) for i in range(250)}
    assert one(classification.running(df, "s", {"c": "x"}).filter("s = 249"))["c"] == 4


def test_regression_of_constants(spark):
    c = spark.createDataFrame([(2.0, 2.0), (2.0, 2.0)], "y_true double, y_pred double")
    assert one(classification.regression(c))["r2"] == 1.0
    assert one(classification.regression(c.withColumn("y_pred", F.lit(3.0))))["r2"] == 0.0


def test_perfect_boxes_have_map_one(spark):
    truth = spark.createDataFrame([("a", "c", 1, 0.0, 0.0, 10.0, 10.0), ("b", "c", 1, 5.0, 5.0, 9.0, 9.0)], "image string, class_id string, box_id int, x1 double, y1 double, x2 double, y2 double")
    predictions = truth.withColumn("confidence", F.lit(0.9))
    for matching in detection.MATCHING:
        m = one(detection.summary(detection.average_precision(truth, predictions, matching=matching)))
        assert tuple(m) == pytest.approx((1.0, 1.0, 1.0))
    none = detection.average_precision(truth, predictions.withColumn("x1", F.lit(100.0)).withColumn("x2", F.lit(101.0)), thresholds=(0.5,))
    assert one(none)["ap"] == 0.0
    with pytest.raises(ValueError):
        detection.average_precision(truth, predictions, matching="other")


def test_greedy_matching_lets_the_surest_choose_first(spark):
    pairs = spark.createDataFrame([("a", "c", 1, 1, 0.9, 0.6), ("a", "c", 1, 2, 0.8, 0.9), ("a", "c", 2, 2, 0.8, 0.55)], "image string, class_id string, truth_id int, prediction_id int, confidence double, iou double")
    assert sorted(r["prediction_id"] for r in detection.greedy(pairs, F.lit(0.5)).collect()) == [1, 2]
    assert sorted(r["prediction_id"] for r in detection.unique_pairs(pairs, 0.5).collect()) == [1]


def _features(t):
    n = T.normalized(t)
    import re

    toks = re.findall(r"\w+", n)
    w = " ".join(re.sub(r"[^\w\s]+", " ", n).split())
    s = f" {w} "
    return toks, {s[i : i + 3] for i in range(len(s) - 2)} if len(w) >= 3 else set()


def _score(a, b, method):
    (ta, ga), (tb, gb) = _features(a), _features(b)
    if method == "ordered_tokens_v1":
        return SequenceMatcher(None, ta, tb, autojunk=False).ratio()
    x, y = set(ta), set(tb)
    j = len(x & y) / len(x | y) if x | y else 0.0
    return j if method == "token_jaccard_v1" else max(j, 2 * len(ga & gb) / (len(ga) + len(gb)) if ga or gb else 0.0)


@pytest.mark.parametrize("method", T.METHODS)
def test_indexed_join_is_the_exhaustive_one(spark, method):
    r = random.Random(117)
    word = ["alpha", "beta", "Gamma", "delta", "ε", "straße", "x", "y2", "über"]
    make = lambda n: [" ".join(r.choice(word) for _ in range(r.randrange(0, 8))) for _ in range(n)]
    train, test = make(35), make(25)
    frame = lambda xs: spark.createDataFrame(list(enumerate(xs)), "id int, text string")
    got = {r["test_id"]: (r["train_id"], r["similarity"]) for r in similarity.best_matches(frame(train), frame(test), "id", "id", "text", 0.62, method).collect()}
    want = {}
    for i, a in enumerate(test):
        if not any(_features(a)):
            continue
        s, t = max((_score(a, b, method), -j) for j, b in enumerate(train))
        if s >= 0.62:
            want[i] = (-t, s)
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and math.isclose(got[k][1], want[k][1]) for k in want)


def _documents(spark, folder):
    """Documents with near copies across the split, long ones among them: one letter changed in many words, one word added, two words exchanged."""
    r = random.Random(118)
    words = ["".join(r.choice("abcdefghijklmnoprstuvwy") for _ in range(r.randrange(4, 12))) for _ in range(400)]
    texts = []
    for i in range(24):
        base = [r.choice(words) for _ in range((12, 60, 300)[i % 3])]
        a = [x + "s" if k % 9 == 0 else x for k, x in enumerate(base)]
        at = r.randrange(len(base) - 1)
        b = base[:at] + [base[at + 1], base[at]] + base[at + 2 :]
        texts += [" ".join(x) for x in (base, a, b, [*base, "added"], r.sample(base, len(base)))]
    r.shuffle(texts)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return texts


def _brute_matches(texts, method, threshold):
    want = {}
    train = [j for j in range(len(texts)) if j % 5]
    for i in range(0, len(texts), 5):
        s, t = max((_score(texts[i], texts[j], method), -j) for j in train)
        if s >= threshold:
            want[i] = (-t, s)
    return want


@pytest.mark.parametrize("name, method, threshold", [("near_match_hybrid_documents", "hybrid_lexical_v1", 0.9), ("near_match_ordered_documents", "ordered_tokens_v1", 0.8)])
def test_near_copies_among_documents_are_found(spark, tmp_path, name, method, threshold):
    texts = _documents(spark, tmp_path)
    got = {r["test_id"]: (r["train_id"], r["similarity"]) for r in leakage_plans.QUERIES[name](spark, str(tmp_path)).collect()}
    want = _brute_matches(texts, method, threshold)
    assert want.keys() != _brute_matches(texts, "token_jaccard_v1", threshold).keys()
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and math.isclose(got[k][1], want[k][1]) for k in want)


def test_divisions_by_nothing(spark):
    none = spark.createDataFrame([(0, 0.5), (0, 0.2)], "y int, y_score double")
    assert one(study.average_precision(none.withColumn("i", F.col("y_score")), "y_score", F.col("y") == 1, "i"))[0] == 0.0
    assert one(classification.auprc(none, F.col("y") == 1))[0] is None
    with pytest.raises(Exception, match="no predictions"):
        classification.accuracy(spark.createDataFrame([], "y_true string, y_pred string")).collect()


def test_average_precision_of_many_ties(spark):
    r = random.Random(5)
    rows = [(i, r.choice([0.1, 0.5, 0.5, 0.5, r.random()]), r.random() < 0.3) for i in range(3000)]
    df = spark.createDataFrame(rows, "i int, s double, y boolean")
    ranked = sorted(rows, key=lambda x: (-x[1], x[0]))
    hits, want = 0, []
    for k, (_, _, y) in enumerate(ranked, 1):
        hits += y
        want += [hits / k] if y else []
    assert one(study.average_precision(df, "s", F.col("y"), "i"))[0] == pytest.approx(sum(want) / len(want))


def test_arm_scores_with_an_absent_status(spark):
    rows = spark.createDataFrame([("supported", "supported"), ("supported", "not_verifiable"), ("not_verifiable", "not_verifiable")], "gold string, arm string")
    s = one(study.arm_scores(rows, "gold", "arm", "contradicted"))
    assert (s["macro_f1"], s["recall_positive"], s["false_accusation_rate"]) == pytest.approx(((2 / 3 + 1.0 + 2 / 3) / 3, 1.0, 0.0))
    with pytest.raises(Exception, match="unknown status"):
        study.arm_scores(rows.withColumn("arm", F.lit("maybe")), "gold", "arm", "contradicted").collect()


def test_a_threshold_of_zero_compares_blank_rows_too(spark):
    train = spark.createDataFrame([(1, "a b"), (2, "")], "id int, text string")
    test = spark.createDataFrame([(5, "  "), (6, "b a")], "id int, text string")
    got = {r["test_id"]: (r["train_id"], r["similarity"]) for r in similarity.best_matches(train, test, "id", "id", "text", 0.0, "token_jaccard_v1").collect()}
    assert got == {5: (1, 0.0), 6: (1, 1.0)}
    few = similarity.best_matches(train, test, "id", "id", "text", 0.5, "token_jaccard_v1", excluded=test.filter("id = 6"))
    assert few.count() == 0


def test_auprc_in_a_session_of_its_own():
    import subprocess
    import sys

    code = """
from pyspark.sql import SparkSession, functions as F
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from attestra.operators import classification
d = s.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1)], "y int, y_score double")
print("found", round(classification.auprc(d, F.col("y") == 1).first()[0], 6))
"""
    root = str(__import__("pathlib").Path(__file__).resolve().parent.parent)
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=200)
    assert "found 0.833333" in out.stdout, out.stderr[-2000:]


def test_counters_are_those_of_the_generated_corpora(spark):
    c = one(leakage_plans.QUERIES["join_counters_sparse"](spark, ""))
    assert tuple(c) == (10_000_000, 51_548, 500)
    c = one(leakage_plans.QUERIES["join_counters_common"](spark, ""))
    assert tuple(c) == (400_000, 400_000, 100)


def test_join_counters(spark):
    train = spark.createDataFrame([(i, f"shared token{i}") for i in range(20)], "id int, text string")
    c = one(similarity.join_counters(train, train.limit(5), "id", "id", "text"))
    assert (c["exhaustive"], c["candidates"], c["scored"]) == (100, 100, 5)


def test_leakage(spark):
    train = spark.createDataFrame([("1", "p1", "Hello  World", "a"), ("2", "p2", "other", "b")], "id string, patient string, text string, label string")
    test = spark.createDataFrame([("3", "P1 ", "Hello  World", "a"), ("4", "p3", "hello world", "a"), ("5", "", "new", "b")], train.schema)
    s = one(leakage.leakage_summary(train, test, ["text"], group="patient", label="label"))
    assert (s["exact_overlap"], s["normalized_overlap"], s["normalized_only"], s["group_overlap"]) == (1, 2, 1, 1)
    assert [r["id"] for r in leakage.normalized_only(train, test, ["text"]).collect()] == ["4"]
    assert leakage.identity_columns(train, test, None, "label", "patient") == ["id", "text"]
    with pytest.raises(ValueError):
        leakage.identity_columns(train, test, ["nothing"])
    assert T.normalized("Straße ﬁne  ") == "strasse fine"


def test_mcnemar_is_exact(spark):
    for b, c in [(0, 0), (6, 0), (3, 5), (12, 30), (2247, 854), (10, 10)]:
        n, k = b + c, min(b, c)
        want = min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n) if n else 1.0
        got = one(spark.range(1).select(stats.mcnemar_exact(F.lit(b), F.lit(c))))[0]
        assert got == pytest.approx(want, rel=1e-9)


def test_holm_and_kappa(spark):
    t = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "name string, p_value double")
    got = {r["name"]: r["adjusted"] for r in study.holm(t).collect()}
    assert got == pytest.approx({"a": 0.03, "c": 0.06, "b": 0.06})
    k = spark.createDataFrame([(True, True)] * 3, "a boolean, b boolean")
    assert one(study.kappa(k, F.col("a"), F.col("b")))["kappa"] is None


def test_claims_of_every_layer():
    text = "\n".join(["Accuracy: 91.5% and F1 = 0,91", "Точность составила 88%", "", "| model | accuracy | latency (ms) |", "|---|---|---|", "| A | 0.93 | 12 ms |", "| B | **91%** | 8 ms |", "", "<table><tr><th>model</th><th>recall</th></tr>", "<tr><td>C</td><td>0.5</td></tr></table>"])
    got = [(line, m, round(v, 6)) for line, m, v, _, _ in claims.claims(text)]
    assert got == [(1, "accuracy", 0.915), (1, "f1", 0.91), (2, "accuracy", 0.88), (6, "accuracy", 0.93), (6, "latency_seconds", 0.012), (7, "accuracy", 0.91), (7, "latency_seconds", 0.008), (10, "recall", 0.5)]
    assert claims.claims(text)[3][4] == {"model": "A"}
    assert [(m, v) for _, m, v, _, _ in claims.claims("model\trmse\nA\t1.5\nB\t2")] == [("rmse", 1.5), ("rmse", 2.0)]
    assert claims.number("1,234") == 1234 and claims.number("0,912") == 0.912 and claims.number("−3") == -3


def test_extract_in_spark(spark):
    df = spark.createDataFrame([(1, "Accuracy: 90%"), (2, "nothing"), (3, None)], "id int, text string")
    r = one(claims.extract(df, "id", "text"))
    assert (r["id"], r["line"], r["metric"], r["value"]) == (1, 1, "accuracy", 0.9)


def test_claim_status(spark):
    c = spark.createDataFrame([(1, "f1", 0.9, {"split": "test"}), (1, "recall", 0.5, {}), (1, "rmse", 2.0, {}), (1, "auroc", 0.7, {"split": "dev"})], "id int, metric string, value double, context map<string,string>")
    e = spark.createDataFrame([(1, "f1", 0.902, "recomputed", {"split": " TEST"}), (1, "recall", 0.6, "reported", {}), (1, "auroc", 0.7, "reported", {"split": "test"})], "id int, metric string, value double, evidence_level string, context map<string,string>")
    got = {r["metric"]: r["status"] for r in claims.check(c, e, "id").collect()}
    assert got == {"f1": "verified", "recall": "mismatch", "rmse": "no_evidence", "auroc": "no_evidence"}


def test_clean_metrics(spark):
    items = spark.createDataFrame([(1, "Accuracy", "91,5%"), (1, "ROC-AUC", "0.8"), (1, "note", "text")], "id int, name string, value string")
    assert {(r["metric"], r["value"]) for r in evidence.clean_metrics(items, "id").collect()} == {("accuracy", 0.915), ("auroc", 0.8)}
    with pytest.raises(Exception, match="out of range"):
        evidence.clean_metrics(spark.createDataFrame([(1, "recall", "-0.5")], items.schema), "id").collect()
    with pytest.raises(Exception, match="reported twice"):
        evidence.clean_metrics(spark.createDataFrame([(1, "recall", "0.5"), (1, "sensitivity", "0.5")], items.schema), "id").collect()


def test_graph(spark):
    nodes = spark.createDataFrame([(1, "a:1", "A"), (1, "b:1", "B"), (1, "b:1", "B")], "g int, node_id string, label string")
    edges = spark.createDataFrame([(1, "a:1", "b:1", "supports"), (1, "a:1", "c:9", "raises")], "g int, source string, target string, relation string")
    assert {(r["error"], r["subject"]) for r in evidence.graph_errors(nodes, edges, "g").collect()} == {("duplicate_node", "b:1"), ("dangling_edge", "c:9")}
    assert "a_1 -->|supports| b_1" in one(evidence.mermaid(nodes, edges, "g"))["flowchart"]


def test_metric_names():
    assert names.canonical("F1-Score") == "f1" and names.canonical("my metric!") == "my_metric"
    assert names.family("validation roc auc (%)") == "auroc" and names.family("size") is None
    assert names.scoped(["run", "metrics", "accuracy", "test"]) == "accuracy.test" and names.scoped(["a"]) is None


def test_components_and_split(spark, tmp_path):
    chain = [(i, i + 1) for i in range(40) if i % 10 != 9]
    got = {r["node"]: r["component"] for r in split.components(spark.createDataFrame(chain, "a int, b int"), "a", "b", f"file://{tmp_path}").collect()}
    assert got == {i: i // 10 * 10 for i in range(40)}
    assert split.components(spark.createDataFrame([], "a int, b int"), "a", "b", f"file://{tmp_path}").count() == 0
    sizes = spark.createDataFrame([(n,) for n in (3, 4, 5, 8, 13, 15, 100)], "n bigint")
    got = {r["n"]: tuple(r)[1:] for r in sizes.select("n", *split.seats(F.col("n"))).collect()}
    assert got == {3: (1, 1, 1), 4: (2, 1, 1), 5: (3, 1, 1), 8: (5, 2, 1), 13: (8, 3, 2), 15: (9, 3, 3), 100: (60, 20, 20)}
    with pytest.raises(Exception, match="too few groups"):
        split.assign(spark.createDataFrame([("d", 1), ("d", 2)], "d string, k int"), "d", "k", 1).collect()


def test_notebooks(spark):
    cell = lambda s, n: {"cell_type": "code", "execution_count": n, "source": s}
    bad = {"cells": [cell("sc.fit(X)", 2), cell("X_train, X_test = train_test_split(X)", 1), cell("m.fit(X_test)\nz = X_test + 1", 3), cell("x = (", 4)]}
    codes = {c for c, _ in notebooks.audit(json.dumps(bad))}
    assert codes == {"non_monotonic_notebook_execution", "random_seed_not_detected", "preprocessing_before_split", "fit_on_test_data", "unparsed_notebook_cells"}
    flow = {"cells": [cell("a, b = train_test_split(X, random_state=0)\nm.fit(b)", 1)]}
    assert [c for c, _ in notebooks.audit(json.dumps(flow))] == ["fit_on_test_dataflow"]
    df = spark.createDataFrame([(1, json.dumps(flow)), (2, "no json"), (3, None)], "id int, text string")
    assert {(r["id"], r["code"]) for r in notebooks.audit_notebooks(df, "id", "text").collect()} == {(1, "fit_on_test_dataflow"), (2, "unreadable_notebook"), (3, "unreadable_notebook")}


def test_logistic_learns(spark):
    rows = [(i, "good fine nice" if i % 2 else "bad poor awful") for i in range(20)]
    df = spark.createDataFrame(rows, "id int, text string")
    counts = features.word_counts(df, "id", "text")
    vectors = features.tfidf(counts, features.idf(counts, df), "id")
    w, b = features.train_logistic(vectors, df.select("id", (F.col("id") % 2).alias("label")), "id", epochs=3)
    p = features.predict(vectors, spark.createDataFrame(w, "feature string, coefficient double"), b, "id")
    assert all((r["probability"] > 0.5) == bool(r["id"] % 2) for r in p.collect())


def test_artifacts(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one")
    found = artifacts.describe(spark, str(tmp_path))
    wrong = found.withColumn("sha256", F.lit("x")).unionByName(spark.createDataFrame([("gone", "y", 1)], "path string, sha256 string, size_bytes bigint"))
    assert {r["problem"] for r in artifacts.integrity(wrong, found).collect()} == {"changed", "missing"}
    c = spark.createDataFrame([("d", "a", 3, None), ("d", "b", 2, "fork"), ("d", "c", 1, None)], "domain string, name string, stars int, why string")
    got = {r["name"]: r["reason"] for r in artifacts.discover(c, "domain", [F.desc("stars")], F.col("why"), 1).collect()}
    assert got == {"a": None, "b": "fork", "c": "quota"}


def test_readers(spark, tmp_path):
    p = tmp_path / "p.csv"
    p.write_text("y_true,y_pred,y_score,z\n1,1,0.9,q\n0,1,0.4,q\n")
    assert one(readers.read_predictions(spark, str(p), True).agg(F.avg("y_score")))[0] == pytest.approx(0.65)
    (tmp_path / "bad.csv").write_text("a,a\n1,2\n")
    with pytest.raises(ValueError):
        readers.read_csv(spark, str(tmp_path / "bad.csv"))
    wide = tmp_path / "w.csv"
    wide.write_text("model,accuracy,f1\nA,0.9,0.8\nB,0.7,0.6\n")
    assert {(r["name"], r["value"]) for r in readers.read_metrics_csv(spark, str(wide), ("model", "B")).collect()} == {("accuracy", "0.7"), ("f1", "0.6")}
    with pytest.raises(ValueError):
        readers.read_metrics_csv(spark, str(wide))
    (tmp_path / "m.json").write_text(json.dumps({"run": {"accuracy": 0.9, "note": "x"}, "f1": {"macro": "0.5"}}))
    assert {(r["name"], r["value"]) for r in readers.read_metrics_json(spark, str(tmp_path / "m.json")).collect()} == {("accuracy", "0.9"), ("f1.macro", "0.5")}
    (tmp_path / "d.json").write_text(json.dumps({"images": [{"id": " i ", "ground_truth": [{"class_id": "c", "bbox": [0, 0, 2, 2]}], "predictions": [{"class_id": "c", "confidence": 0.5, "bbox": [0, 0, 2, 2]}]}]}))
    assert one(detection.summary(detection.average_precision(*readers.read_detections(spark, str(tmp_path / "d.json")))))["map50"] == pytest.approx(1.0)
    nb = json.dumps({"cells": [{"cell_type": "markdown", "source": ["# Hi\n", "x"]}, {"cell_type": "code", "source": "1", "outputs": [{"text": ["acc 0.9\n"]}, {"data": {}}]}]})
    assert one(spark.createDataFrame([(nb,)], "t string").select(readers.notebook_text(F.col("t"))))[0] == "# Hi\nx\nacc 0.9\n"
    out = str(tmp_path / "out")
    readers.write_once(spark.range(2), out)
    with pytest.raises(Exception, match="exists"):
        readers.write_once(spark.range(2), out)


def test_digests(spark):
    a, b = '{"b": 1, "a": [1.5, "é"]}', '{"a": [1.5, "é"], "b": 1}'
    got = [r[0] for r in spark.createDataFrame([(a,), (b,), (None,)], "t string").select(canonical.canonical_digest("t")).collect()]
    assert got[0] == got[1] and got[2] is None
    assert canonical.digest({"a": 1, "d": "x"}, blank="d") == canonical.digest({"a": 1, "d": "y"}, blank="d")
    with pytest.raises(ValueError):
        canonical.canonical_json(float("nan"))


def test_streaming(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("2026-01-01 00:00:00", "a", 1, 1), ("2026-01-01 00:01:00", "a", 1, 0), ("2026-01-01 00:02:00", "b", 0, 0)], "ts string, text string, y int, p int").selectExpr("cast(ts as timestamp) ts", "text", "y", "p").write.parquet(src)
    stream = lambda: spark.readStream.schema("ts timestamp, text string, y int, p int").parquet(src)
    train = spark.createDataFrame([("a",)], "text string")
    for name, df, n in [("fresh", screening.fresh_rows(stream(), ["text"], "ts"), 2), ("leaked", screening.leaked_rows(stream(), train, ["text"]), 2)]:
        q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(60)
        assert spark.table(name).count() == n
    q = screening.windowed_accuracy(stream(), "ts", "y", "p").writeStream.format("memory").queryName("acc").outputMode("complete").option("checkpointLocation", str(tmp_path / "acc")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("acc").first()["accuracy"] == pytest.approx(2 / 3)


def test_the_rest_does_not_need_the_corpus_operators():
    import pathlib

    import attestra

    root = pathlib.Path(attestra.__file__).parent
    assert not [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts and "attestra.llm" in p.read_text()]


def test_text_features_are_of_whole_documents(spark, tmp_path):
    import re
    from collections import Counter

    r = random.Random(119)
    texts = [" ".join(f"{r.choice('abcdé')}{r.randrange(400)}x" for _ in range(n)) for n in (0, 1, 2, 40, 3000, *[700] * 25)] + ["Straße 12.5% 𝒳 up", "A a a"]
    spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: features_plans.QUERIES[name](spark, str(tmp_path)).collect()
    normal = [T.normalized(re.sub(r"(?<![\w.])[-+]?\d+(?:[.,]\d+)*%?", "<num>", T.normalized(t))) for t in texts]
    words = [re.findall(r"<num>|\w+", t) for t in normal]
    bags = [Counter([f"w1:{x}" for x in w] + [f"w2:{x} {y}" for x, y in zip(w, w[1:])]) for w in words]
    assert {(x["doc_id"], x["feature"]): x["n"] for x in run("word_features_documents")} == {(i, f): n for i, b in enumerate(bags) for f, n in b.items()}
    chars = [Counter(f"c{k}:{p[i : i + k]}" for k in (3, 4, 5) for i in range(len(p) - k + 1)) for p in (f" {t} " for t in normal)]
    assert {(x["doc_id"], x["feature"]): x["n"] for x in run("character_features_documents")} == {(i, f): n for i, b in enumerate(chars) for f, n in b.items()}
    df = Counter(f for b in bags for f in b)
    assert len(df) > 20_000
    top = sorted(df, key=lambda f: (-df[f], f))[:20_000]
    idf = {f: math.log((2.0 + len(texts)) / (1.0 + df[f])) + 1.0 for f in top}
    assert {x["feature"]: x["idf"] for x in run("idf_documents")} == pytest.approx(idf)
    want = {}
    for i, b in enumerate(bags):
        w = {f: (1 + math.log(n)) * idf[f] for f, n in b.items() if f in idf}
        want |= {(i, f): x / math.sqrt(sum(y * y for y in w.values())) for f, x in w.items()}
    assert {(x["doc_id"], x["feature"]): x["weight"] for x in run("tfidf_documents")} == pytest.approx(want)


def test_n_grams_are_counted_on_arrays():
    from collections import Counter

    import pyarrow as pa

    from attestra.functions import grams

    r = random.Random(14)
    wide = "".join(map(chr, range(0x4E00, 0x4E00 + 5000)))  # more characters than five fit into 63 bits
    texts = ["", "a", "ab", "aaaaaa", "naïve 𝒳𝒳 <num>", "\0é\0a世\0\0\0", wide, wide[::-1] + wide[:9], "z" * (grams.GROUP + 5), *["".join(r.choice("abcдéß世 ") for _ in range(n)) for n in (1, 50, 9000)]]
    want = Counter((i, f"c{k}:{p[j : j + k]}") for i, t in enumerate(texts) for p in [f" {t} "] for k in (3, 4, 5) for j in range(len(p) - k + 1))
    rows = lambda parts: [((int(i), f), int(n)) for row, feature, count in parts for i, f, n in zip(row, feature.to_pylist(), count)]
    got = rows(grams.batch_tally(pa.array(texts), (3, 4, 5)))
    assert len(got) == len(want) and dict(got) == want
    lists = [[], ["a"], ["a", "a", "a"], [], ["b", "<num>", "ж"], [r.choice("abcdef") for _ in range(grams.GROUP + 5)], ["a"]]
    want = Counter((i, f) for i, w in enumerate(lists) for f in [f"w1:{x}" for x in w] + [f"w2:{x} {y}" for x, y in zip(w, w[1:])])
    got = rows(grams.batch_tally(pa.array(lists, pa.list_(pa.string())), None))
    assert len(got) == len(want) and dict(got) == want
    assert not rows(grams.batch_tally(pa.array([], pa.string()), (3,))) and not rows(grams.batch_tally(pa.array([[]], pa.list_(pa.string())), None))


def test_claims_of_one_small_file_are_spread_and_searched_once(spark, tmp_path):
    import re

    r = random.Random(21)
    other = list(names.ALIASES)
    old, new = (re.compile(rf"(?i)\b({p})(?:\s*[:=]\s*|\s+)(\d+)") for p in (names.PATTERN, names.TREE))
    for _ in range(2000):
        line = "".join(r.choice([r.choice(other), r.choice(other).upper(), r.choice(other)[:4], " ", ": ", "=", str(r.randrange(99)), "x"]) for _ in range(12))
        assert [m.groups() for m in old.finditer(line)] == [m.groups() for m in new.finditer(line)]
    spark.range(50).selectExpr("id k", "concat('map 50-95: 0,', id, ' and F1 = ', id, '%\nno\nTOP-1 accuracy of 3') t").coalesce(1).write.parquet(str(tmp_path / "r"))
    df = spark.read.parquet(str(tmp_path / "r"))
    for found in (claims.core_claims(df, "k", "t"), claims.extract(df, "k", "t")):
        assert found.rdd.getNumPartitions() > 4
        assert found.filter("k = 7").select("line", "metric", "value").collect() == [(1, "map50_95", 0.7), (1, "f1", 0.07), (3, "top1_accuracy", 0.03)]
    checks = claims.core_claims(df, "k", "t").withColumn("status", F.when(F.col("k") % 2 == 0, "mismatch").otherwise("supported"))
    observed = df.selectExpr("k", "explode(array('f1', 'map50_95')) metric", "'s' source", "1.0D value")
    edges = evidence.graph_edges(checks, observed, "k")
    assert edges._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    raised = [("claim:000" + str(i), "finding:000" + str(i), "raises") for i in (1, 2, 3)]
    assert sorted(tuple(x)[1:] for x in edges.filter("k = 8").collect()) == [*raised, ("metric:0001", "claim:0002", "contradicts"), ("metric:0002", "claim:0001", "contradicts")]


def test_certificates_are_checked_against_one_audit(spark):
    from attestra.plans import audit as audit_plans

    plan = audit_plans.certificate_errors(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan and "aggregate" not in plan.lower()


def test_reports_are_audited_in_one_pass(spark):
    import hashlib

    from attestra.operators import audit
    from attestra.plans import audit as audit_plans

    plan = audit_plans.audit_reports(spark, "/root/testdata/sf0.001")._jdf.queryExecution()
    assert plan.optimizedPlan().toString().count("regexp_extract_all") == 1
    text = "F1: 0.5, acc 90% and loss 3\nF1 is 0.7"
    keys = spark.createDataFrame([(k, text if k < 3 else "") for k in (1, 2, 3, 4, 4)], "k long, t string")
    seen = [(1, "f1", 0.7, "a", 1, 0), (1, "f1", 0.5, "b", 2, 1), (3, "recall", 0.1, "a", 1, 0), (3, "recall", 0.2, "b", 2, 0), (3, "recall", 0.3, "c", 3, 0)]
    observed = spark.createDataFrame(seen, "k long, metric string, value double, source string, o int, priority int")
    merged = evidence.merge(observed, "k", "o")
    side = lambda df: df.withColumn("context", F.create_map(F.lit("split"), F.lit("test")))
    checks = claims.check(side(claims.core_claims(keys.distinct(), "k", "t")), side(merged.withColumn("evidence_level", F.lit("reported"))), "k")
    found = audit.findings(checks, audit.conflicts(observed, "k", "o"), "k").groupBy("k").agg(F.sort_array(F.collect_list("code")).alias("c"))
    codes = {r["k"]: r["c"] for r in found.collect()}
    assert codes == {1: ["claim_metric_mismatch", "claim_without_evidence", "metric_evidence_conflict"], 2: ["claim_without_evidence"] * 3, 3: ["metric_evidence_conflict"] * 2}

    def entry(k, n):
        c = codes.get(k, [])
        status = "needs_review" if c else "passed"
        sealed = json.dumps({"claims": n, "codes": c, "findings": len(c), "id": str(k), "status": status}, separators=(",", ":"))
        return k, status, n, len(c), hashlib.sha256(sealed.encode()).hexdigest()

    assert sorted(map(tuple, audit.reports(keys, checks, merged, "k").collect())) == [entry(1, 3), entry(2, 3), entry(3, 0), entry(4, 0), entry(4, 0)]


def test_names_are_found_by_their_length(spark):
    odd = ["", " ", "F1-Score", "ROC_AUC", "Точность", "R²", "no such metric", "x" * 60, "req/sec"]
    every = [n for a in names.ALIASES for n in (a, a.upper(), f" {a} ")] + odd
    df = spark.createDataFrame([(n,) for n in every], "n string").select("n", names.canonical_column(F.col("n")).alias("c"))
    assert [r["c"] for r in df.collect()] == [names.canonical(n) for n in every]


def test_weights_go_to_the_counts(spark):
    counts = spark.createDataFrame([(1, "w1:a", 2)], "id long, feature string, n long")
    plan = features.tfidf(counts, spark.createDataFrame([("w1:a", 1.5)], "feature string, idf double"), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan


def test_bootstrap_makes_the_reference_s_draws(spark):
    import inspect

    df = spark.createDataFrame([("a", 1), ("b", 0), ("c", 1)], "k string, v int")
    assert study.cluster_bootstrap(df, "k", {"v": F.col("v")}, F.col("v")).count() == 1000
    assert inspect.signature(features.train_logistic).parameters["epochs"].default == 200
def test_texts_are_normalised_one_at_a_time():
    from pyspark.util import PythonEvalType

    assert T.normalize_text.evalType == PythonEvalType.SQL_SCALAR_ARROW_UDF




def _analyzed(df):
    return df._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("matching, interpolation", [(m, i) for m in detection.MATCHING for i in detection.INTERPOLATION])
def test_no_window_holds_a_class_of_detections(spark, matching, interpolation):
    r = random.Random(41)
    box = lambda: (x := r.randrange(8), y := r.randrange(8), x + 6 + r.randrange(6), y + 6 + r.randrange(6))
    truth = [(i, c, k, *map(float, box())) for i in range(40) for c in "ab" for k in range(3)]
    guess = [(i, c, k, *[x + r.randrange(3) for x in xs], r.choice([0.2, 0.5, 0.9])) for i, c, k, *xs in truth]
    t = spark.createDataFrame(truth, "image int, class_id string, box_id int, x1 double, y1 double, x2 double, y2 double")
    p = spark.createDataFrame(guess, "image int, class_id string, box_id int, x1 double, y1 double, x2 double, y2 double, confidence double")
    df = detection.average_precision(t, p, matching=matching, interpolation=interpolation)
    assert "windowspecdefinition(class_id" not in _analyzed(df)
    pairs = detection.iou_pairs(t, p)
    for row in df.collect():
        found = (detection.greedy(pairs, F.lit(row["threshold"])) if matching == "greedy" else detection.unique_pairs(pairs, row["threshold"])).filter(F.col("class_id") == row["class_id"]).collect() if row["threshold"] in (0.5, 0.8) else None
        if found is None:
            continue
        hits, tp, curve = {(x["image"], x["prediction_id"]) for x in found}, 0, {}
        for seen, g in enumerate(sorted((g for g in guess if g[1] == row["class_id"]), key=lambda g: (-g[-1], g[0], g[2])), 1):
            tp += (g[0], g[2]) in hits
            curve[tp / 120] = max(curve.get(tp / 120, 0.0), tp / seen)
        best = lambda v: max((p for q, p in curve.items() if q >= v), default=0.0)
        if interpolation == "coco_101_mean":
            want = sum(best(i / 100.0) for i in range(101)) / 101
        else:
            ends = [(0.0, best(0)), *[(q, best(q)) for q in sorted(curve)], (1.0, 0.0)]

            def at(x):
                low, high = [k for k in ends if k[0] <= x][-1], next((k for k in ends if k[0] > x), None)
                return low[1] if high is None else low[1] + (high[1] - low[1]) * (x - low[0]) / (high[0] - low[0])

            want = sum((at(i / 100.0) + at((i + 1) / 100.0)) / 2.0 * 0.01 for i in range(100))
        assert row["ap"] == pytest.approx(want, abs=1e-12)


def test_mcnemar_of_many_pairs_is_one_sum(spark):
    b, c = 20_000, 20_400
    n, term, total = b + c, 1, 0
    for i in range(b + 1):
        total += term
        term = term * (n - i) // (i + 1)
    assert one(spark.range(1).select(stats.mcnemar_exact(F.lit(b), F.lit(c))))[0] == pytest.approx(2 * total / 2**n if n < 1000 else float(__import__("fractions").Fraction(2 * total, 2**n)), rel=1e-9)


def test_ranges_of_running_sums_are_no_expression(spark):
    df = spark.range(3000).select(F.col("id").cast("double").alias("y_score"), F.col("id") % 2 == 0)
    assert len(_analyzed(classification.auroc(df, F.col("y_score") % 3 == 0))) < 20_000


@pytest.mark.parametrize("method", T.METHODS)
def test_copies_are_not_expanded_into_pairs(spark, monkeypatch, method):
    formed, whole = [], similarity._pairs
    monkeypatch.setattr(similarity, "_pairs", lambda *a: formed.append(whole(*a)) or formed[-1])
    texts = ["one two three four", "five six seven eight"]
    docs = spark.createDataFrame([(i, "train validation test".split()[i % 3], texts[i % 2].upper() if i % 5 == 0 else texts[i % 2]) for i in range(600)], "i int, split string, text string")
    train, test = docs.filter("split = 'train'"), docs.filter("split = 'test'")
    got = {r["test_id"]: (r["train_id"], r["similarity"]) for r in similarity.best_matches(train, test, "i", "i", "text", 0.9, method).collect()}
    assert got == {i: ((0, 1.0) if i % 2 == 0 else (3, 1.0)) for i in range(2, 600, 3)}
    assert similarity.cross_split_near(docs, "i", "split", "text", 0.9, method).count() == 0 and len(formed) == 2  # one join for all splits; equal but for form
    assert similarity.scored_pairs(train, test, "i", "i", "text").first()["scored"] == 2 * 100 * 100
    assert [p.count() for p in formed] == [0, 0, 0]
