"""Operators with SQL: held against it on awkward documents and on copies, and against brute force."""

import heapq
import random

import numpy as np
import pytest

from attestra.llm import fingerprints, media, mixing, near_dedup, sharding, skew, substrings, tokens
from tests.llm import helpers as H


def test_fingerprints_match_sql_and_handle_every_case(spark):
    docs = H.awkward(spark)
    lines = "a line\nother\na line\nother\nthe end"
    # in 24 the second and third b agree equally long with the first, in 25 the third A agrees longer with the second than with the first
    docs = docs.unionByName(H.documents(spark, [(20, lines), (21, "x\n" * 40), (22, "\n\n"), (23, "é\né"), (24, "b\n1\nb\n2\nb\n3"), (25, "A\nx\nA\ny\nA\ny")]))
    found = fingerprints.fingerprints(H.with_clashes(docs)).collect()
    assert len(found) == docs.count()
    got = {(r["doc_id"], r["n_chars"]): r for r in found}
    assert (got[(24, 11)]["repeat_length"], got[(24, 11)]["repeat_at"], got[(24, 11)]["repeat_of"]) == (2, 4, 0)
    assert (got[(25, 11)]["repeat_length"], got[(25, 11)]["repeat_of"]) == (2, 0)
    longs = [r for r in found if r["doc_id"] in (4, 5)]
    assert len({tuple(r)[1:] for r in longs}) == 1 and longs[0]["n_lines"] == 1
    assert len({tuple(r) for r in found if r["doc_id"] == 8}) == 2
    assert got[(20, len(lines))]["repeat_length"] == len("a line\nother\n")
    assert (got[(20, len(lines))]["repeat_at"], got[(20, len(lines))]["repeat_of"]) == (13, 0)
    assert got[(21, 80)]["repeat_length"] == 78
    assert got[(2, 0)]["fingerprint_a"] == 0 and got[(2, 0)]["repeat_at"] is None
    assert got[(1, None)]["fingerprint_a"] is None
    plain = docs.filter("text is not null and doc_id is not null and doc_id not in (4, 5, 8)")
    H.same_as_sql(fingerprints.fingerprints(plain), fingerprints._ORACLE, documents=plain)
    assert fingerprints.fingerprints(docs.limit(0)).count() == 0


def test_prefixes_answer_spans_and_extensions_like_slices():
    r = random.Random(3)
    text = "".join(r.choice("ab") for _ in range(400)) * 2
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    p = fingerprints.Prefixes(points)
    a, b = np.array([r.randrange(700) for _ in range(500)]), np.array([r.randrange(700) for _ in range(500)])
    n = np.array([r.randrange(0, 100) for _ in range(500)])
    assert p.equal(a, b, n).tolist() == [text[x : x + k] == text[y : y + k] for x, y, k in zip(a, b, n)]
    limit = len(text) - np.maximum(a, b)

    def common(x, y):
        k = 0
        while max(x, y) + k < len(text) and text[x + k] == text[y + k]:
            k += 1
        return k

    assert p.common(a, b, limit).tolist() == [common(x, y) for x, y in zip(a, b)]
    assert len({tuple(map(int, h)) for h in zip(*p.hashes(np.zeros(1, int), np.array([800])))}) == 1


def _lpt(sizes, shards):
    heap = [(0, j) for j in range(shards)]
    loads = [0] * shards
    for s in sorted(sizes, reverse=True):
        load, j = heapq.heappop(heap)
        loads[j] += s
        heapq.heappush(heap, (load + s, j))
    return loads


@pytest.mark.parametrize("seed", range(6))
def test_lpt_by_size_classes_is_lpt_one_by_one(seed):
    r = random.Random(seed)
    shards = r.choice([1, 2, 5, 8])
    sizes = [r.choice([0, 1, 2, 3, 7, 50, 51, r.randrange(1, 1000)]) for _ in range(r.randrange(1, 400))]
    classes = sorted(set(sizes))
    loads = [0] * shards
    placed = 0
    for size, first, last, j in sharding.lpt_runs(classes, [sizes.count(c) for c in classes], shards):
        loads[j] += size * (last - first + 1)
        placed += last - first + 1
    assert placed == len(sizes)
    assert loads == _lpt(sizes, shards)


def test_sharding_keeps_groups_together_and_matches_sql(spark):
    docs = H.awkward(spark)
    got = sharding.shard(H.with_clashes(docs), 5)
    assert got.count() == docs.count()
    by_text = docs.select("doc_id", "text").join(got, "doc_id").filter("doc_id <> 8").groupBy("text").agg({"shard": "collect_set"}).collect()
    assert all(len(r[1]) == 1 for r in by_text)
    plain = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    H.same_as_sql(sharding.shard(plain, 64), sharding._ORACLE, documents=plain)
    assert sharding.shard(docs.limit(0)).count() == 0
    assert {r["shard"] for r in sharding.shard(docs.filter("source is null"), 3, group="source").collect()} <= {0, 1, 2}
    with pytest.raises(ValueError):
        sharding.shard(docs, 0)


def _near_copy(text, seed, change):
    r = random.Random(seed)
    w = text.split()
    for _ in range(change):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


def test_near_duplicates_match_sql_on_planted_copies(spark):
    base = [H.prose(i, 150) for i in range(30)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, t) for i, t in enumerate(base[:8])]  # exact
    rows += [(200 + i, t.upper().replace(" ", "\n  ")) for i, t in enumerate(base[4:10])]  # case and space
    rows += [(300 + 20 * i + j, _near_copy(t, 31 * i + j, 5)) for i, t in enumerate(base[:12]) for j in range(3)]
    rows += [(900, "two words"), (901, "two words"), (902, ""), (903, "")]
    docs = H.documents(spark, rows)
    got = H.same_as_sql(near_dedup.near_duplicates(docs), near_dedup._ORACLE, documents=docs)
    groups = {r[0]: r[1] for r in got}
    assert all(groups[100 + i] == i for i in range(8))
    assert all(groups[300 + 20 * i + j] == i for i in range(12) for j in range(3))
    assert 29 not in groups and 902 not in groups and groups[901] == 900
    kept = {r["doc_id"] for r in near_dedup.drop_near_duplicates(H.with_clashes(docs)).collect()}
    assert kept == {r[0] for r in rows} - {d for d, g in groups.items() if d != g}


def test_near_duplicates_handle_every_case(spark):
    docs = H.awkward(spark)
    got = {r["doc_id"]: (r["group_id"], r["keep"]) for r in near_dedup.near_duplicates(H.with_clashes(docs)).collect()}
    assert got == {4: (4, True), 5: (4, False), 6: (6, True), 7: (6, False)}
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 2
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_chain_of_near_copies_is_one_group(spark):
    """Links that the bucket leader doesn't have: each text is near the next, the ends are not near each other."""
    w = H.prose(7, 300).split()
    texts = []
    for step in range(8):
        texts.append(" ".join(w))
        w[step * 30 : step * 30 + 30] = [f"s{step}x{i}" for i in range(30)]
    docs = H.documents(spark, [(10 + i, t) for i, t in enumerate(texts)])
    got = H.same_as_sql(near_dedup.near_duplicates(docs), near_dedup._ORACLE, documents=docs)
    assert {r[1] for r in got} == {10} and len(got) == 8


def _brute_repeats(docs, span):
    """Maximal runs of repeated spans, by dictionary."""
    first, count = {}, {}
    ws = {d: H.words(t) for d, t in docs}
    for d in sorted(ws):
        for i in range(len(ws[d]) - span + 1):
            k = tuple(ws[d][i : i + span])
            first.setdefault(k, (d, i))
            count[k] = count.get(k, 0) + 1
    out = []
    for d in ws:
        run = None
        for i in range(len(ws[d]) - span + 1):
            k = tuple(ws[d][i : i + span])
            mark = (first[k] == (d, i)) if count[k] > 1 else None
            if run and run[2] == mark:
                run[1] = i + span
            else:
                run = [i, i + span, mark] if mark is not None else None
                if run:
                    out.append((d, run))
    return sorted((d, a, b, f) for d, (a, b, f) in out)


@pytest.mark.parametrize("seed", range(3))
def test_repeated_spans_match_brute_force(spark, seed):
    r = random.Random(seed)
    passages = [[f"p{seed}q{j}z{i}" for i in range(r.randrange(10, 40))] for j in range(6)]
    docs = []
    for d in range(40):
        w = []
        for _ in range(r.randrange(0, 6)):
            w += [f"u{r.randrange(10**9)}" for _ in range(r.randrange(0, 25))]
            p = r.choice(passages)
            a = r.randrange(0, max(1, len(p) - 8))
            w += p[a : a + r.randrange(5, 40)]
        docs.append((d, " ".join(w)))
    docs += [(100 + d, t) for d, t in docs[:6]]  # whole copies
    docs += [(200, "ab " * 60), (201, "ab cd " * 40)]  # texts that repeat themselves
    got = H.rows(substrings.repeated_spans(H.documents(spark, docs), span=8), "doc_id", "start_word", "end_word", "first")
    assert got == _brute_repeats(docs, 8)


def test_repeated_spans_match_sql_and_handle_every_case(spark):
    passage = H.prose(50, 70)
    rows = [(i, f"{H.prose(60 + i, 40)}\n{passage}\n{H.prose(80 + i, 30)}") for i in range(5)]
    docs = H.documents(spark, [*rows, (9, H.prose(99, 49)), (10, H.prose(99, 49)), (11, H.prose(98, 50)), (12, H.prose(98, 50))])
    got = H.same_as_sql(substrings.repeated_spans(docs), substrings._ORACLE, documents=docs)
    assert [(d, b - a) for d, a, b, first in got if not first] == [(1, 70), (2, 70), (3, 70), (4, 70), (12, 50)]
    cut = {r["doc_id"]: r for r in substrings.drop_repeats(H.with_clashes(docs)).collect()}
    assert 12 not in cut and cut[11]["text"] == H.prose(98, 50) and cut[9]["text"] == cut[10]["text"]
    assert H.words(cut[3]["text"]) == H.words(f"{H.prose(63, 40)} {H.prose(83, 30)}")
    assert cut[3]["n_chars"] == len(cut[3]["text"]) and cut[0]["text"] == rows[0][1]

    odd = H.awkward(spark)
    found = H.rows(substrings.repeated_spans(H.with_clashes(odd)), "doc_id", "start_word", "end_word", "first")
    assert found == [(4, 0, 60_000, True), (5, 0, 60_000, False)]
    left = substrings.drop_repeats(odd)
    assert left.columns == odd.columns and left.count() == odd.count() - 1
    assert substrings.repeated_spans(odd.limit(0)).count() == 0
    assert substrings.drop_repeats(odd.limit(0)).count() == 0


BY_WORDS = {"measure": tokens.word_count}


def test_mixing_matches_sql_and_handles_every_case(spark):
    docs = H.awkward(spark).unionByName(H.documents(spark, [(100 + i, H.prose(i, 5 + i % 40), "en", f"s{i % 3}") for i in range(120)]))
    H.same_as_sql(mixing.mix(docs, **BY_WORDS), mixing.BY_WORDS, documents=docs)
    rates = {r["source"]: r["rate"] for r in mixing.repetition_rates(docs, {"s0": 3.0, "s1": 1.0, None: 1.0}, budget=10_000, **BY_WORDS).collect()}
    assert rates["s2"] == 0.0 and rates["a"] == 0.0 and rates[None] > 0
    counts = {r["source"]: r["tokens"] for r in mixing.repetition_rates(docs, **BY_WORDS).collect()}
    assert rates["s0"] * counts["s0"] == pytest.approx(6000) and rates["s1"] * counts["s1"] == pytest.approx(2000)
    out = mixing.mix(H.with_clashes(docs), {"s0": 3.0, "s1": 1.0, None: 1.0}, budget=10_000, **BY_WORDS)
    assert out.columns.count("copy") == 1 and out.filter("source in ('s2', 'a')").count() == 0
    for r in out.groupBy("doc_id").agg({"copy": "max"}).filter("doc_id >= 100").collect():
        rate = rates[f"s{(r['doc_id'] - 100) % 3}"]
        assert r[1] in (int(rate), int(rate) + 1)
    assert mixing.mix(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, {"s0": -1.0})


def test_mixing_beyond_the_broadcast_bound_gives_the_same(spark, monkeypatch):
    docs = H.documents(spark, [(i, H.prose(i, 5 + i), "en", f"s{i % 7}") for i in range(60)])
    want = H.rows(mixing.mix(docs), "doc_id", "copy")
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 2)
    assert H.rows(mixing.mix(docs), "doc_id", "copy") == want


def test_mixing_is_by_tokens(spark):
    """The whole query by the definition, one document at a time."""
    import hashlib

    rows = [(i, H.prose(i, 3 + i % 50) + (" 漢字" * (i % 5)), "en", ["a", "b", "b", None, "c"][i % 5]) for i in range(90)] + [(90, None, "en", "a"), (91, "", "en", "empty")]
    docs = H.documents(spark, rows)
    count, _ = tokens.counter(f"{tokens.TOKENIZERS}/{tokens.VOCABULARY}")
    sums = {}
    for _, t, _, source in rows:
        sums[source] = sums.get(source, 0) + count([t or ""])[0]
    share = sum(sums.values()) / sum(n**0.5 for n in sums.values() if n)
    want = []
    for d, _, _, source in rows:
        rate = sums[source] ** 0.5 * share / sums[source] if sums[source] else 1.0
        draw = int(hashlib.md5(f"{mixing.SEED}|{d}".encode()).hexdigest()[:12], 16) / 2**48
        want += [(d, k + 1) for k in range(int(rate) + (draw < rate - int(rate)))]
    assert H.rows(mixing.mix(docs), "doc_id", "copy") == sorted(want)


@pytest.fixture()
def everything_is_hot(monkeypatch):
    """Keys of three rows and more are hot, and all rows are looked at."""
    monkeypatch.setattr(skew, "SHARE", 1.0)
    monkeypatch.setattr(skew, "HOT", 3)
    from attestra.llm import graph

    monkeypatch.setattr(graph, "HOT", 3)


def test_aggregates_of_a_hot_group_are_right_and_its_rows_spread(spark):
    from pyspark.sql import functions as F

    rows = spark.range(0, 25_000, 1, 8).select("id", F.when(F.col("id") % 5 > 0, F.lit(7)).otherwise(F.col("id")).alias("k"))
    hot = skew.hot_keys(skew.sample(rows), ["k"])
    assert [r["k"] for r in hot.collect()] == [7]
    got = skew.with_groups(rows, ["k"], hot, n=F.count("*"), least=F.min("id"))
    assert got.count() == 25_000
    assert {(r["k"], r["n"], r["least"]) for r in got.filter("k in (7, 5, 10)").distinct().collect()} == {(7, 20_000, 1), (5, 1, 5), (10, 1, 10)}
    most = got.groupBy(F.spark_partition_id().alias("p")).count().agg({"count": "max"}).first()[0]
    assert most < 10_000


def test_near_duplicates_of_hot_groups_are_the_same(spark, monkeypatch, everything_is_hot):
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    base = [H.prose(i, 60) for i in range(12)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, base[0]) for i in range(30)] + [(200 + 10 * i + j, _near_copy(t, 31 * i + j, 3)) for i, t in enumerate(base[:6]) for j in range(6)]
    w = H.prose(7, 300).split()
    for step in range(8):
        rows.append((500 + step, " ".join(w)))
        w[step * 30 : step * 30 + 30] = [f"s{step}x{i}" for i in range(30)]
    docs = H.documents(spark, rows)
    H.same_as_sql(near_dedup.near_duplicates(docs), near_dedup._ORACLE, documents=docs)


def test_blocks_of_a_bucket_give_each_pair_once_met(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    rows = [(k, 100 * k + i, i % 3) for k in (1, 2) for i in range(17)]
    mixed = spark.createDataFrame(rows, "key bigint, doc_id bigint, root bigint")
    want = sorted((a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and a[2] != b[2])
    assert H.rows(near_dedup._pairs(mixed, None), "a", "b") == want


def test_repeated_spans_of_hot_passages_are_the_same(spark, everything_is_hot):
    r = random.Random(9)
    passage = [f"p{i}" for i in range(40)]
    docs = []
    for d in range(60):
        w = [f"u{r.randrange(10**9)}" for _ in range(r.randrange(0, 12))]
        a = r.randrange(0, 20)
        docs.append((d, " ".join(w + passage[a : a + r.randrange(8, 30)] + [f"v{r.randrange(3)}"] + passage[:15])))
    docs += [(100 + d, docs[0][1]) for d in range(20)]
    got = H.rows(substrings.repeated_spans(H.documents(spark, docs), span=8), "doc_id", "start_word", "end_word", "first")
    assert got == _brute_repeats(docs, 8)


def test_a_text_in_most_rows(spark):
    """20,000 of 25,000 rows are one text: results are whole, and no task holds all its rows."""
    from pyspark.sql import functions as F

    text = H.prose(3, 60)
    docs = spark.range(0, 25_000, 1, 8).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 5 > 0, F.lit(text)).otherwise(F.concat(F.lit("other "), F.expr("array_join(transform(sequence(1, 12), i -> md5(concat(id, ':', i))), ' ')"))).alias("text"))
    groups = near_dedup.near_duplicates(docs)
    assert groups.groupBy("group_id").count().collect() == [(1, 20_000)]
    spans = substrings.repeated_spans(docs)
    assert spans.groupBy("start_word", "end_word", "first").count().orderBy("first").collect() == [(0, 60, False, 19_999), (0, 60, True, 1)]


def test_texts_that_share_an_id_are_numbered_in_the_order_of_their_md5(spark):
    import hashlib

    docs = H.documents(spark, [(1, H.prose(i, 5)) for i in range(300)] + [(1, H.prose(0, 5)), (2, "x"), (None, "y")])
    src, again = substrings._versions(docs, "doc_id", "text")
    want = sorted({H.prose(i, 5) for i in range(300)}, key=lambda t: hashlib.md5(t.encode()).hexdigest())
    got = {(r["doc_id"], r["ver"]): r["text"] for r in src.collect()}
    assert again and got == {**{(1, i): t for i, t in enumerate(want)}, (2, 0): "x"}


def test_media_round_trip(spark):
    r = random.Random(5)
    video, audio = bytes(r.randrange(256) for _ in range(10_000)), b"sound" * 30
    data = media.write_container(video, audio, b"avc1")
    (v, a), error = media.describe(data)
    assert error is None and (v["codec"], a["codec"], v["kind"], a["kind"]) == ("avc1", "mp4a", "vide", "soun")
    assert v["samples"] == 20 and v["duration"] == pytest.approx(20 * 3000 / 90000)
    assert [data[k["first_byte"] : k["end_byte"]] for k in v["keyframes"]] == [video[0:512], video[6144:6656]]
    assert b"".join(data[k["first_byte"] : k["end_byte"]] for k in a["keyframes"]) == audio


def test_media_boxes_of_every_form():
    import struct

    video = media.write_track(7, b"vide", b"hev1", 1000, 40, [10, 20, 30, 40, 50], [5000, 6000], 3, [0, 3])
    moov = struct.pack(">I4sQ", 1, b"moov", 16 + len(video)) + video  # a 64-bit size
    free = struct.pack(">I4s", 12, b"free") + b"...."
    uuid = struct.pack(">I4s", 24, b"uuid") + b"u" * 16
    tail = struct.pack(">I4s", 0, b"mdat") + b"\0" * 7000  # to the end
    (t,), error = media.describe(free + uuid + moov + tail)
    assert error is None and t["track"] == 7 and t["duration"] == pytest.approx(0.2)
    assert t["keyframes"] == [{"first_byte": 5000, "end_byte": 5010}, {"first_byte": 6000, "end_byte": 6040}]


def test_media_handles_every_case(spark):
    good = media.write_container(b"x" * 3000, b"", b"avc1")
    cut = [good[:n] for n in range(0, len(good), 37)]
    files = spark.createDataFrame([(1, good, 1), (1, good, 2), (2, None, 3), (3, b"", 4), (4, b"not a container at all", 5), (None, good, 6), *[(100 + i, c, 0) for i, c in enumerate(cut)]], "id bigint, content binary, tracks int")
    got = media.media_columns(files, "id").collect()
    assert len(got) == files.count()
    by = {}
    for r in got:
        by.setdefault(r["id"], []).append(r)
    assert by[2][0]["tracks"] is None and by[2][0]["error"] is None
    assert by[3][0]["error"] and by[4][0]["error"] and all(by[100 + i][0]["error"] for i in range(len(cut)))
    assert len(by[1]) == 2 and by[None][0]["tracks"][1]["samples"] == 0
    assert media.media_columns(files.limit(0), "id").count() == 0


def _track_box(*tables):
    return media._box(b"moov", media._box(b"trak", media._box(b"mdia", *tables[:-1], media._box(b"minf", media._box(b"stbl", tables[-1])))))


def test_no_file_fails_the_job(spark):
    import struct

    bomb = _track_box(media._full(b"stsz", struct.pack(">II", 8, 2**32 - 1)))
    deep = b""
    for _ in range(3000):
        deep = media._box(b"mdia", deep)
    stts = media._full(b"stts", struct.pack(">I", 3), struct.pack(">II", 2**32 - 1, 2**32 - 1) * 3)
    overflow = _track_box(media._full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 1000, 0, 0, 0)), stts)
    long_file = media.write_container(b"v" * 6_000_000, b"a" * 1_000_000, b"avc1")
    files = spark.createDataFrame([(1, bomb), (2, media._box(b"moov", media._box(b"trak", deep))), (3, overflow), (4, long_file), (5, None)], "id int, content binary")
    got = {r["id"]: r for r in media.media_columns(files, "id").collect()}
    assert got[1]["tracks"] is None and "larger than the file" in got[1]["error"]
    assert got[2]["error"] is None and got[2]["tracks"][0]["samples"] == 0
    assert got[3]["tracks"][0]["duration"] == pytest.approx(3 * (2**32 - 1) ** 2 / 1000)
    video, audio = got[4]["tracks"]
    assert len(video["keyframes"]) == -(-video["samples"] // 12) and len(audio["keyframes"]) == audio["samples"] == 62_500
    assert audio["keyframes"][-1]["end_byte"] - video["keyframes"][0]["first_byte"] == 7_000_000
    assert got[5]["tracks"] is None and got[5]["error"] is None


def test_samples_of_one_size_and_empty_chunks():
    import struct

    tables = media._box(b"stbl", media._full(b"stsz", struct.pack(">II", 7, 5)), media._full(b"stsc", struct.pack(">I", 3), struct.pack(">9I", 1, 2, 1, 2, 0, 1, 3, 3, 1)), media._full(b"stco", struct.pack(">4I", 3, 400, 450, 500)), media._full(b"stss", struct.pack(">4I", 3, 1, 2, 4)))
    moov = media._box(b"moov", media._box(b"trak", media._box(b"mdia", media._box(b"minf", tables))))
    (t,), error = media.describe(moov + media._box(b"mdat", b"\0" * 600))
    assert error is None and t["samples"] == 5
    assert [k["first_byte"] for k in t["keyframes"]] == [400, 407, 507] and t["keyframes"][0]["end_byte"] == 407
