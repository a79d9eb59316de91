"""Each stage of the pipeline on what the one before kept, against brute force."""

import numpy as np
import pyarrow as pa

import corpus_pipeline as P
from attestra.llm import language, packing, tokens
from attestra.llm.tables import kept
from tests.llm import helpers as H
from tests.llm.test_exact_operators import _brute_repeats


def _documents(spark):
    en = "the house and the tree of the man with a dog in the garden is not by the river".split()
    import random

    r = random.Random(0)

    def text(seed, n=90):
        q = random.Random(seed)
        return " ".join(q.choice(en) + q.choice(["", "s", "ing", "er", "ed", "ly"]) + q.choice(["", "ment", "tion"]) for _ in range(n))

    rows = [(i, text(i), "en", f"s{i % 3}") for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "s0") for i in range(6)]  # copies
    passage = " ".join(text(500, 60).split())
    rows += [(200 + i, text(600 + i, 70) + "\n" + passage + "\n" + text(700 + i, 70), "en", "s1") for i in range(5)]
    rows += [(300, "%%% 123 ***", "en", "s1"), (301, None, "en", "s1"), (None, text(900), "en", None), (302, "", None, "s2")]
    r.shuffle(rows)
    return H.documents(spark, rows)


def test_stages(spark, tmp_path):
    docs = _documents(spark)
    names = [n for n, _ in P.STAGES]
    assert names == ["language_id", "near_dedup", "substring_dedup", "mixing", "packing"]
    inputs = [docs]
    for name, stage in P.STAGES:
        inputs.append(kept(stage(spark, inputs[-1], ""), name))
    for df in inputs[1:-1]:
        assert df.columns == docs.columns
    ids = [sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=str) for df in inputs]

    # language: the scores of the model by plain sums, and clean documents stay
    model = language.train(docs)
    keep = []
    for r in docs.collect():
        f, _ = language.grams(pa.array([r["text"] or ""]))
        z = model.weights[f].astype(float).sum(axis=0) * language._SCALE / max(1, len(f)) / model.temperature
        if len(f) and language.softmax(z[None, :]).max() >= language.MIN_CONFIDENCE:
            keep.append(r["doc_id"])
    keep = sorted(keep, key=str)
    assert ids[1] == keep and not {300, 301, 302} & set(ids[1]) and None in ids[1] and set(range(60)) <= set(ids[1])

    # near copies: by comparing all pairs
    rows = [(r["doc_id"], r["text"]) for r in inputs[1].collect()]
    sets = {d: {tuple(w[i : i + 3]) for i in range(len(w) - 2)} for d, t in rows if d is not None for w in [H.words(t.lower())]}
    root = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b]):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {d: new if x == old else x for d, x in root.items()}
    assert ids[2] == sorted([d for d in ids[1] if d is None or root[d] == d], key=str)

    # passages: by dictionary, on what is left
    rows = [(r["doc_id"], r["text"]) for r in inputs[2].collect() if r["doc_id"] is not None]
    gone = {}
    for d, a, b, first in _brute_repeats(rows, 50):
        if not first:
            gone.setdefault(d, set()).update(range(a, b))
    want = {d: [w for i, w in enumerate(H.words(t)) if i not in gone.get(d, ())] for d, t in rows}
    got = {r["doc_id"]: r for r in inputs[3].collect()}
    assert {d: H.words(r["text"]) for d, r in got.items() if d is not None} == {d: w for d, w in want.items() if w}
    assert set(gone) == {201, 202, 203, 204}
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())

    # mixing: by the definition
    count, _ = tokens.counter(f"{tokens.TOKENIZERS}/{tokens.VOCABULARY}")
    sums, rows = {}, inputs[3].collect()
    for r in rows:
        sums[r["source"]] = sums.get(r["source"], 0) + count([r["text"]])[0]
    share = sum(sums.values()) / sum(t**0.5 for t in sums.values())
    import hashlib

    expect = []
    for r in rows:
        rate = sums[r["source"]] ** 0.5 * share / sums[r["source"]]
        name = "" if r["doc_id"] is None else str(r["doc_id"])
        draw = int(hashlib.md5(f"11|{name}".encode()).hexdigest()[:12], 16) / 2**48
        expect += [r["doc_id"]] * (int(rate) + (draw < rate - int(rate)))
    assert ids[4] == sorted(expect, key=str)

    # packing: the bins of each document's tokens, by packing them here
    want = sorted(count([r["text"]])[0] for r in inputs[4].collect())
    packed = inputs[5].collect()
    assert sorted(r["tokens"] for r in packed) == want
    bins = {}
    for r in packed:
        bins.setdefault(r["bin"], []).append(r["tokens"])
    here = packing.pack_sizes(np.array(sorted(want, reverse=True)), packing.CAPACITY)
    assert sorted(map(sum, bins.values())) == sorted(int(np.array(sorted(want, reverse=True))[b].sum()) for b in here)
    assert len({(r["doc_id"], r["copy"], r["piece"]) for r in packed}) == len(packed)


def test_run_applies_the_stages(spark, tmp_path):
    docs = _documents(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    once = H.rows(P.run(spark, str(tmp_path)))
    step = docs
    for name, stage in P.STAGES:
        step = kept(stage(spark, step, str(tmp_path)), name)
    assert once == H.rows(step) and once
    empty = tmp_path / "empty"
    docs.limit(0).write.parquet(f"{empty}/documents.parquet")
    assert P.run(spark, str(empty)).count() == 0


def test_stages_take_awkward_documents(spark):
    docs = H.with_clashes(H.awkward(spark))
    for name, stage in P.STAGES:
        out = stage(spark, docs, "")
        assert out.count() >= 0
        if name != "packing":
            assert out.columns == docs.columns
