"""Prose layers and tab-separated tables of the claim grammar."""

import pytest

from attestra.operators import claims


def found(text):
    return [(m, pytest.approx(v)) for _, m, v, _, _ in claims.claims(text)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("latency 12 ms", [("latency_seconds", 0.012)]),
        ("Latency: 1.5 minutes, runtime = 2 h", [("latency_seconds", 90), ("runtime_seconds", 7200)]),
        ("MSE = 1.2e-3", [("mse", 0.0012)]),
        ("latency of 3 microseconds", [("latency_seconds", 3e-6)]),
        ("throughput 1,234 msgs", [("throughput_ops_per_second", 1234)]),
        ("completed in 250 ms", [("runtime_seconds", 0.25)]),
        ("now 3.5x faster, a 20% speedup", [("speedup", 3.5), ("speedup", 0.2)]),
        ("beats it by 5-7 %", [("speedup_range_low", 0.05), ("speedup_range_high", 0.07)]),
        ("cuts memory to 512 MB from 2 GB", [("memory_mb", 512), ("memory_mb", 2048)]),
        ("peak memory of 6 GB VRAM", [("memory_mb", 6144)]),
        ("all 1,204 unit tests", [("test_count", 1204)]),
        ("87 passed, 2 skipped", [("test_count", 87)]),
        ("Recall@10 = 83%, nDCG@5: 0.4", [("recall_10", 0.83), ("ndcg_5", 0.4)]),
        ("| model | MSE | latency |\n|---|---|---|\n| A | 2e-2 | 2 minutes |", [("mse", 0.02), ("latency_seconds", 120)]),
        (" Average Precision  (AP) @[ IoU=0.50:0.95 | area=   all | maxDets=100 ] = 0.412", [("map50_95", 0.412)]),
        (" Average Recall     (AR) @[ IoU=0.50:0.95 | area= small | maxDets=100 ] = 0.2", []),
        ("completed in 5 m and 3 mins", [("runtime_seconds", 300)]),
    ],
)
def test_units_exponents_and_prose_layers(text, want):
    assert found(text) == want


def test_each_run_of_tabbed_lines_is_a_table():
    text = "a\tstray tab\n\nmodel\trmse\nA\t1.5\nB\t2\n\nprose\nmodel\tmae\tf1\nC\t3\t0.5\n"
    assert [(line, m, v, c) for line, m, v, _, c in claims.claims(text)] == [(4, "rmse", 1.5, {"model": "A"}), (5, "rmse", 2.0, {"model": "B"}), (9, "mae", 3.0, {"model": "C"}), (9, "f1", 0.5, {"model": "C"})]


def test_a_table_follows_a_title_or_another_table_directly():
    assert [(m, v) for _, m, v, _, _ in claims.claims("Results\tof May\tall\nmodel\trmse\nA\t1.5\nmodel\tmae\tf1\nC\t3\t0.5")] == [("rmse", 1.5), ("mae", 3.0), ("f1", 0.5)]
    assert [(m, v) for _, m, v, _, _ in claims.claims("model\trmse\nA\t1.5\nmodel\tmae\nB\t3")] == [("rmse", 1.5), ("mae", 3.0)]
