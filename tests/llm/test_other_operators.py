"""Operators that SQL can't express: held against brute force, exact counts or held-out labels."""

import itertools
import os
import random

import numpy as np
import pyarrow as pa
import pytest

from attestra.llm import language, packing, quality, tokens
from tests.llm import helpers as H

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables here")


def _bins_needed(sizes, capacity):
    """The least number of bins, by trying all placings."""
    best = len(sizes)

    def place(i, fills):
        nonlocal best
        if len(fills) >= best:
            return
        if i == len(sizes):
            best = len(fills)
            return
        for k in range(len(fills)):
            if fills[k] + sizes[i] <= capacity:
                place(i + 1, [*fills[:k], fills[k] + sizes[i], *fills[k + 1 :]])
        place(i + 1, [*fills, sizes[i]])

    place(0, [])
    return best


def _gains(bins, sizes, capacity, underfull):
    """Every exchange from an underfull bin that would raise the sum of squared fills."""
    fill = [sum(sizes[i] for i in b) for b in bins]
    for a, b in itertools.permutations(range(len(bins)), 2):
        if fill[a] >= underfull * capacity or fill[b] >= capacity:
            continue
        ones, twos = [(i,) for i in bins[a]], list(itertools.combinations(bins[a], 2))
        back = [(), *[(j,) for j in bins[b]]]
        for give, take in [*itertools.product(ones + twos, back), *itertools.product(ones, itertools.combinations(bins[b], 2))]:
            d = sum(sizes[i] for i in give) - sum(sizes[j] for j in take)
            if d > 0 and fill[b] + d <= capacity and d * (d + fill[b] - fill[a]) > 0:
                yield a, b, give, take


@pytest.mark.parametrize("seed", range(8))
def test_packing_ends_where_no_exchange_helps(seed):
    r = np.random.default_rng(seed)
    sizes = r.integers(1, 60, 40)
    bins = packing.pack_sizes(sizes, 100, 0.98)
    assert sorted(itertools.chain(*bins)) == list(range(40))
    assert all(sizes[b].sum() <= 100 for b in bins)
    assert next(_gains(bins, sizes.tolist(), 100, 0.98), None) is None
    start, fill = packing.best_fit(sizes, 100)
    assert len(bins) <= len(start)
    assert sum(int(sizes[b].sum()) ** 2 for b in bins) >= sum(f * f for f in fill)


@pytest.mark.parametrize("seed", range(8))
def test_packing_is_within_a_bin_of_the_best(seed):
    sizes = np.random.default_rng(100 + seed).integers(10, 70, 9)
    assert len(packing.pack_sizes(sizes, 100)) <= _bins_needed(sizes.tolist(), 100) + 1


def test_packing_improves_on_best_fit_somewhere():
    better = 0
    for seed in range(300):
        sizes = np.random.default_rng(seed).integers(20, 60, 24)
        better += len(packing.pack_sizes(sizes, 100, 1.0)) < len(packing.best_fit(sizes, 100)[0])
    assert better > 0


def test_local_search_is_quick_and_ends_at_an_optimum():
    """Texts of a third to half a bin, where nearly every bin is underfull."""
    import time

    sizes = np.random.default_rng(0).integers(2500, 4200, 4000)
    began = time.process_time()
    bins = packing.pack_sizes(sizes, 8192)
    assert time.process_time() - began < 10 * 3  # 10 s on an ordinary machine
    assert sorted(itertools.chain(*bins)) == list(range(4000)) and all(sizes[b].sum() <= 8192 for b in bins)
    assert len(bins) < len(packing.best_fit(sizes, 8192)[0])
    few = packing.pack_sizes(sizes[:60], 8192)
    assert next(_gains(few, sizes[:60].tolist(), 8192, 0.98), None) is None


def test_packing_of_documents(spark):
    docs = H.awkward(spark).unionByName(H.documents(spark, [(100 + i, H.prose(i, 1 + i * 7 % 90)) for i in range(200)]))
    by_words = {"capacity": 100, "cell": 50, "measure": tokens.word_count}
    got = packing.pack(H.with_clashes(docs), **by_words).collect()
    fills, pieces = {}, {}
    for r in got:
        if r["bin"] is None:
            assert r["tokens"] == 0
            continue
        fills[r["bin"]] = fills.get(r["bin"], 0) + r["tokens"]
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["tokens"]))
    assert max(fills.values()) <= 100
    for d, text in [(100 + i, H.prose(i, 1 + i * 7 % 90)) for i in range(200)]:
        assert sum(w for _, w in pieces[d]) == len(text.split())
    assert sum(w for _, w in pieces[4]) == 60_000 and len(pieces[4]) == 600
    assert sum(w for _, w in pieces[8]) == 360
    assert sum(1 for r in got if r["bin"] is None) == 4
    assert len({(r["doc_id"], r["copy"], r["piece"]) for r in got}) == len(got)
    assert packing.pack(docs.limit(0)).count() == 0
    # the same bins, however rows are spread
    again = packing.pack(docs.repartition(7, "text"), **by_words)
    assert H.rows(again) == sorted(map(tuple, got), key=lambda r: tuple((x is not None, str(type(x)), x) for x in r))


def test_packing_meets_again_across_cells(spark):
    docs = H.documents(spark, [(i, H.prose(i, 20 + i * 37 % 60)) for i in range(400)])
    bins = lambda cell: packing.pack(docs, capacity=100, cell=cell, measure=tokens.word_count).filter("bin is not null").select("bin").distinct().count()
    one, many = bins(400), bins(20)
    alone = sum(len(packing.pack_sizes(np.array([20 + i * 37 % 60 for i in range(k, 400, 20)]), 100)) for k in range(20))
    assert one <= many <= alone


def test_packing_spreads_rows_that_share_an_id(spark, monkeypatch):
    monkeypatch.setattr(packing, "CHUNK", 7)
    rows = [(None, "one two three")] * 50 + [(3, "one two three")] * 20 + [(3, "one two")] * 5
    got = packing.pack(H.documents(spark, rows), capacity=9, cell=10, measure=tokens.word_count).collect()
    assert sorted((str(r["doc_id"]), r["copy"], r["tokens"]) for r in got) == sorted([("None", k, 3) for k in range(1, 51)] + [("3", k, 2 if k <= 5 else 3) for k in range(1, 26)])
    assert len({r["bin"] >> 24 for r in got}) > 3


@pytest.mark.skipif(not os.path.exists(tokens.TOKENIZERS), reason="no tokenizers here")
def test_packing_is_by_tokens(spark):
    docs = H.awkward(spark)
    count, _ = tokens.counter(f"{tokens.TOKENIZERS}/{tokens.VOCABULARY}")
    sums = {}
    for r in packing.pack(docs, capacity=500).collect():
        sums[r["doc_id"]] = sums.get(r["doc_id"], 0) + r["tokens"]
    want = {}
    for r in docs.collect():
        want[r["doc_id"]] = want.get(r["doc_id"], 0) + count([r["text"] or ""])[0]
    assert sums == want


TEXTS = ["", " ", "a", "I'll go,  they've   gone.\n\n\nNew line\t tab ", "straße 漢字かな 🎵🎵 é", "<|endoftext|> x", "x" * 500, "1234567 89 , . ! ?", "a  b   c    d"]


@pytest.mark.skipif(not os.path.exists(tokens.TOKENIZERS), reason="no tokenizers here")
@pytest.mark.parametrize("vocabulary", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_of_parts_add_up_to_the_whole(vocabulary):
    path = f"{tokens.TOKENIZERS}/{vocabulary}"
    r = random.Random(1)
    texts = [*TEXTS, *["".join(r.choice(TEXTS[3:]) + r.choice([" ", "", "\n", "  "]) for _ in range(30)) for _ in range(25)]]
    count, _ = tokens.counter(path)
    assert tokens.count_texts([*texts, None], path, limit=20) == [*count(texts), 0]


@pytest.mark.skipif(not os.path.exists(tokens.TOKENIZERS), reason="no tokenizers here")
def test_token_counts_of_documents(spark):
    docs = H.awkward(spark)
    got = H.rows(tokens.token_counts(H.with_clashes(docs)))
    count, _ = tokens.counter(f"{tokens.TOKENIZERS}/{tokens.VOCABULARY}")
    want = [(r["doc_id"], count([r["text"] or ""])[0]) for r in docs.collect()]
    assert got == sorted(want, key=lambda r: tuple((x is not None, str(type(x)), x) for x in r))
    assert tokens.token_counts(docs.limit(0)).count() == 0


def test_long_texts_are_cut_at_every_kind_of_place():
    assert max(map(len, tokens.parts("漢字漢字,かな" * 20_000, 1000))) < 1020
    assert max(map(len, tokens.parts("ab12" * 20_000, 1000))) < 1020
    assert max(map(len, tokens.parts("line\n" * 20_000, 1000))) < 1020
    assert max(map(len, tokens.parts("a word " * 20_000, 1000, "space"))) < 1020
    assert not any(p.endswith("'") for p in tokens.parts("it's" * 50, 1)) and tokens.parts("it's", 1) == ["it", "'s"]


def test_parts_lose_nothing():
    for t in [*TEXTS, H.prose(1, 3000)]:
        assert "".join(tokens.parts(t, 16)) == t
        assert "".join(tokens.parts(t, 16, "space")).replace(" ", "") == t.replace(" ", "")


def _grams(text):
    """N-grams by the definition in language.grams, one character at a time."""
    out, run = [], []
    for c in "\n" + text.lower() + "\n":
        letter = "a" <= c <= "z" or (ord(c) >= 0xC0 and c not in "×÷" and not 0x2000 <= ord(c) < 0x2C00)
        if letter:
            run.append(c)
        elif not run or run[-1] != " ":
            run.append(" ")
    for k in language.ORDERS:
        out += ["".join(run[i : i + k]) for i in range(len(run) - k + 1) if any(x != " " for x in run[i : i + k])]
    return out


def test_grams_are_what_they_say():
    texts = ["", "A b, c!", "Straße 漢 x", "123", "ab  cd\n\nef", "ÉÀ×"]
    f, d = language.grams(pa.array([*texts, None]))
    for i, t in enumerate(texts):
        want = _grams(t)
        assert (d == i).sum() == len(want)
        # equal n-grams share a feature, and unequal ones rarely do
        assert len(set(f[d == i].tolist())) == len(set(want))
    assert (d == len(texts)).sum() == 0


def test_ftrl_is_sparse_and_learns():
    r = np.random.default_rng(0)
    rows, y = [], []
    for _ in range(300):
        c = int(r.integers(3))
        rows.append((np.unique(np.r_[c * 3 + r.integers(0, 3, 2), 10 + r.integers(0, 90, 4)]), None))
        y.append(c)
    rows = [(f, np.ones(len(f))) for f, _ in rows]
    w = language.ftrl(rows, np.array(y), 3, 100, l1=2.0)
    right = np.mean([np.argmax(w[f].sum(axis=0)) == c for (f, _), c in zip(rows, y)])
    assert right > 0.97 and (w == 0).mean() > 0.5


def test_ftrl_is_the_scalar_algorithm():
    """One weight at a time, by the published update."""
    r = np.random.default_rng(4)
    rows = [(np.sort(r.choice(30, r.integers(1, 6), replace=False)), None) for _ in range(60)]
    rows = [(f, r.random(len(f)) * 3) for f, _ in rows] + [(np.zeros(0, np.int64), np.zeros(0))]
    y = r.integers(0, 3, len(rows))
    alpha, beta, l1, l2, epochs, seed = 0.5, 1.0, 0.3, 0.5, 2, 5
    z, n = {}, {}

    def weight(i, c):
        a, b = z.get((i, c), 0.0), n.get((i, c), 0.0)
        return 0.0 if abs(a) <= l1 else -(a - np.sign(a) * l1) / ((beta + np.sqrt(b)) / alpha + l2)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            f, x = rows[k]
            scores = [sum(weight(i, c) * v for i, v in zip(f, x)) for c in range(3)]
            top = max(scores)
            e = [np.exp(s - top) for s in scores]
            w = {(i, c): weight(i, c) for i in f for c in range(3)}
            for c in range(3):
                for i, v in zip(f, x):
                    g = (e[c] / sum(e) - (y[k] == c)) * v
                    sigma = (np.sqrt(n.get((i, c), 0.0) + g * g) - np.sqrt(n.get((i, c), 0.0))) / alpha
                    z[i, c] = z.get((i, c), 0.0) + g - sigma * w[i, c]
                    n[i, c] = n.get((i, c), 0.0) + g * g
    want = np.array([[weight(i, c) for c in range(3)] for i in range(30)])
    got = language.ftrl(rows, y, 3, 30, alpha, beta, l1, l2, epochs, seed)
    assert np.allclose(got, want) and (got == 0).any() and (got != 0).any()


def test_language_sample_is_bounded_and_ties_go_by_name(spark):
    stems = ["ka", "lo", "mi", "nu", "pe", "ri", "so", "tu", "va", "ze", "bo", "du"]
    rows = [(i, f"{stems[i % 12]}{stems[i % 12]} " * 6 + f"{stems[i % 12]}{i % 7}", f"l{i % 12:02}") for i in range(240)]
    rows += [(7, rows[7][1], "l07")] * 40 + [(None, "kaka kaka", "l00")] * 40 + [(7, "other text with the same id", "l07")]
    docs = H.documents(spark, rows)
    model = language.train(docs, sample=10, sample_all=120)
    assert model.languages == [f"l{k:02}" for k in range(12)]
    got = language.identify(docs.filter("doc_id is not null and doc_id <> 7"), model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["language"] == r["lang"] for r in got]) > 0.9
    again = language.train(docs.repartition(5, "text"), sample=10, sample_all=120)
    assert (again.weights == model.weights).all() and again.temperature == model.temperature
    flat = language.Model(["b", "c"], np.zeros((1 << language.BITS, 2), np.float32), 1.0)
    (r,) = language.identify(H.documents(spark, [(1, "any text")]), flat, min_confidence=0.5).collect()
    assert (r["language"], r["confidence"], r["keep"]) == ("b", 0.5, True)


def test_temperature_is_the_likeliest():
    r = np.random.default_rng(1)
    z = r.normal(size=(4000, 3)) * 2
    p = language.softmax(z / 2.5)
    y = np.array([r.choice(3, p=q) for q in p])
    assert language.temperature(z, y) == pytest.approx(2.5, rel=0.15)


@needs_data
def test_language_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = language.train(docs.filter("doc_id % 4 <> 0"))
    held = docs.filter("doc_id % 4 = 0")
    got = language.identify(held, model).join(held.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["language"] == r["lang"] for r in got]) > 0.98
    assert np.mean([r["keep"] for r in got]) > 0.98
    # scores are those of the plain formula
    texts = [r["text"] for r in held.limit(5).collect()]
    p, _ = model.probabilities(pa.array(texts))
    for t, q in zip(texts, p):
        f, _ = language.grams(pa.array([t]))
        z = model.weights[f].astype(float).sum(axis=0) * 100.0 / len(f) / model.temperature
        assert np.allclose(language.softmax(z[None, :])[0], q, atol=1e-4)
    df, total = language.document_frequencies(held)
    assert total == held.count()
    want = np.zeros(len(df), int)
    for r in held.collect():
        want[np.unique(language.grams(pa.array([r["text"]]))[0])] += 1
    assert (df == want).all()


def test_language_handles_every_case(spark):
    train = H.documents(spark, [(i, "the house and the tree of the man " * 5, "en") for i in range(20)] + [(50 + i, "der hund und die katze im haus ist " * 5, "de") for i in range(20)])
    model = language.train(train)
    docs = H.awkward(spark).unionByName(H.documents(spark, [(60, "the tree and the man"), (61, "die katze und der hund", "de"), (62, "%%% 123 !!!")]))
    got = {}
    for r in language.identify(H.with_clashes(docs).drop("keep"), model).collect():
        got.setdefault(r["doc_id"], r)
    assert got[60]["language"] == "en" and got[61]["language"] == "de" and got[60]["keep"]
    assert all(got[i]["language"] is None and not got[i]["keep"] and got[i]["confidence"] == 0.0 for i in (1, 2, 3, 62))
    kept = language.filter_language(train.unionByName(docs))
    assert kept.columns == docs.columns
    assert {60: "en", 61: "de"}.items() <= {r["doc_id"]: r["lang"] for r in kept.collect()}.items()
    assert language.filter_language(docs.limit(0)).count() == 0
    none = language.train(docs.limit(0))
    assert not any(r["keep"] for r in language.identify(docs, none).collect())


def _statistics(text):
    """The statistics one text at a time, by plain counting."""
    ws = H.words(text)
    raw = [w.encode() for w in ws]
    n = len(raw)
    if not n:
        return [0.0] * len(quality.FEATURES)
    P, L, S = quality.PRIOR, quality.PRIOR_LENGTH, quality.PRIOR_SPREAD
    data = text.encode()
    letters = sum(97 <= b < 123 or b >= 128 for b in data) + P * L
    capitals, digits = sum(65 <= b < 91 for b in data), sum(48 <= b < 58 for b in data)
    signs = sum(33 <= b < 127 and not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123) for b in data)
    solid = letters + capitals + digits + signs
    mean = (sum(map(len, raw)) + P * L) / (n + P)
    spread = np.sqrt(max((sum(len(w) ** 2 for w in raw) + P * (L * L + S * S)) / (n + P) - mean * mean, 0))
    low = [bytes(b + 32 if 65 <= b < 91 else b for b in w) for w in raw]
    bare = sum(all(33 <= b < 127 and not chr(b).isalnum() for b in w) for w in raw)
    pairs = list(zip(low, low[1:]))
    return [np.log1p(n), np.log1p(mean), np.log1p(spread), *[np.sqrt(x / solid) for x in (letters, capitals, digits, signs)], np.sqrt(data.count(b"\n") / (n + P)), (len(set(low)) + P) / (n + P) ** 0.85, (len(set(pairs)) + P) / (len(pairs) + P), np.sqrt(bare / (n + P)), np.sqrt(sum(len(w) > 12 for w in raw) / (n + P))]


def test_statistics_match_plain_counting():
    from attestra.llm import kernels as K

    texts = [*TEXTS, H.prose(4, 300), "Same same SAME | | --- x\nline\n", "über Ünder"]
    got = quality.statistics(*K.utf8_parts(pa.array(texts)))
    assert np.allclose(got, [_statistics(t) for t in texts])


def test_discriminant_is_the_density_difference():
    r = np.random.default_rng(2)
    x = [r.normal(size=(60, 3)) @ r.normal(size=(3, 3)), 1 + r.normal(size=(90, 3))]
    n, s, ss = np.array([60.0, 90.0]), np.array([a.sum(axis=0) for a in x]), np.array([a.T @ a for a in x])
    model = quality.discriminant(n, s, ss, 0.2, 0.02)
    pooled = sum(np.cov(a.T) * (len(a) - 1) for a in x) / 148
    points, want = r.normal(size=(20, 3)), []
    for a in x:
        c = 0.98 * (0.8 * np.cov(a.T) + 0.2 * pooled) + 0.02 * np.diag(np.diag(pooled))
        d = points - a.mean(axis=0)
        want.append(np.log(len(a) / 150) - 0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) + np.log(np.linalg.det(c))))
    assert np.allclose(model.scores(points), want[1] - want[0])


def test_fit_and_query_are_those_of_plain_sums(spark, tmp_path):
    """The whole query: statistics, sums and densities, a document at a time."""
    texts = {i: H.prose(i, 20 + i % 60, 50 + i) for i in range(80)} | {100 + i: "### x1 " * (10 + i) + H.prose(i, 5) for i in range(60)}
    labels = [(i, 1) for i in range(50)] + [(100 + i, 0) for i in range(40)] + [(3, 1), (999, 0), (None, 1), (60, 5)]
    H.documents(spark, [*texts.items(), (None, "no id"), (200, None), (201, " ")]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, q, 0) for d, q in labels], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    x = {d: np.array(_statistics(t)) for d, t in texts.items()}
    of = {k: np.array([x[d] for d, q in labels if q == k and d in x]) for k in (0, 1)}
    pooled = sum((a - a.mean(0)).T @ (a - a.mean(0)) for a in of.values()) / (sum(map(len, of.values())) - 2)
    density = {}
    for k, a in of.items():
        c = (1 - quality.TO_POOLED) * np.cov(a.T) + quality.TO_POOLED * pooled
        c = (1 - quality.TO_DIAGONAL) * c + quality.TO_DIAGONAL * np.diag(np.maximum(np.diag(pooled), 1e-6))
        density[k] = lambda v, m=a.mean(0), i=np.linalg.inv(c), s=np.linalg.slogdet(c)[1], p=len(a) / 91: np.log(p) - 0.5 * ((v - m) @ i @ (v - m) + s)
    got = {r["doc_id"]: r for r in quality.op10_quality(spark, str(tmp_path)).collect()}
    for d, v in x.items():
        want = density[1](v) - density[0](v)
        assert got[d]["score"] == pytest.approx(want, rel=1e-6) and got[d]["keep"] == (want >= 0)
    assert got[200]["score"] is None and got[201]["score"] is None and not got[201]["keep"]


def test_statistics_that_are_constant_in_a_class(spark):
    docs = H.documents(spark, [(i, "same text each time") for i in range(5)] + [(10 + i, H.prose(i, 30 + i)) for i in range(8)])
    labels = spark.createDataFrame([(i, 0) for i in range(5)] + [(10 + i, 1) for i in range(8)], "doc_id bigint, quality int")
    got = {r["doc_id"]: r for r in quality.fit_and_classify(docs, labels).collect()}
    assert all(np.isfinite(r["score"]) for r in got.values())
    assert not got[0]["keep"] and all(got[10 + i]["keep"] for i in range(8))


@needs_data
def test_quality_accuracy_on_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    model = quality.fit(docs, labels.filter("doc_id % 2 = 0"))
    got = quality.classify(docs, model).join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    good, bad = [r for r in got if r["quality"] == 1], [r for r in got if r["quality"] == 0]
    assert np.mean([r["keep"] for r in good]) > 0.97 and np.mean([not r["keep"] for r in bad]) > 0.9


def test_quality_handles_every_case(spark):
    docs = H.awkward(spark).unionByName(H.documents(spark, [(100 + i, H.prose(i, 50)) for i in range(20)] + [(200 + i, "### " * 40 + str(i)) for i in range(20)]))
    labels = spark.createDataFrame([(100 + i, 1) for i in range(20)] + [(200 + i, 0) for i in range(20)] + [(None, 1), (5, None), (100, 7)], "doc_id bigint, quality int")
    model = quality.fit(H.with_clashes(docs), labels)
    got = {}
    for r in quality.classify(H.with_clashes(docs), model).collect():
        got.setdefault(r["doc_id"], r)
    assert all(got[i]["score"] is None and not got[i]["keep"] for i in (1, 2, 3))
    assert all(got[100 + i]["keep"] and not got[200 + i]["keep"] for i in range(20))
    none = quality.fit(docs, labels.limit(0))
    assert [r["keep"] for r in quality.classify(docs.filter("doc_id in (2, 6)"), none).orderBy("doc_id").collect()] == [False, True]
    assert quality.classify(docs.limit(0), model).count() == 0
