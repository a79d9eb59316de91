"""Repeated passages: compaction of a de Bruijn graph of words.

Edges are all runs of SPAN words, nodes the runs of SPAN - 1.  A node is a branch if its
occurrences differ in the word before or after.  Each branch of a text is joined with the
next one: the path between them holds edges that occur at the same places throughout, and
is compacted to one stretch, with the coordinates of its first occurrence.  Every stretch is
then joined with the one at its source, and their words compared.

What keeps this small, at any size of input, and changes nothing in the result:

* copies of a whole text are found by a 128-bit hash and stand behind their first one;
* an edge is a candidate only if its anchor, the least of the hashes of its shorter runs of
  ANCHOR words, occurs twice in the corpus; equal edges have equal anchors.  One anchor
  serves about a dozen edges, and only texts with repeated anchors go on.

A passage, or a text, may occur in a third of all documents: such hot anchors, nodes and
groups of copies are spread over tasks (skew.py).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestra.llm import kernels as K
from attestra.llm.skew import hot_keys, sample, split, with_groups
from attestra.llm.tables import documents_only, free_name, kept, release, table

SPAN = 50


def _anchor_length(span: int) -> int:
    return max(1, span // 2)


def _anchors(words: K.Words, h: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the selected anchors, offsets by text, anchor number in its text of each edge, edge offsets by text, text of each edge)."""
    short = _anchor_length(span)
    runs, at = K.windows(h, words.first, short)
    edges = np.maximum(words.counts - span + 1, 0)
    e_at = np.zeros(len(edges) + 1, np.int64)
    np.cumsum(edges, out=e_at[1:])
    doc = np.repeat(np.arange(len(edges)), edges)
    chosen = K.sliding_argmin(runs, span - short + 1)[np.arange(e_at[-1]) - e_at[doc] + at[doc]]
    # edges of one text choose anchors from left to right, so a change is a new one
    fresh = np.ones(len(chosen), bool)
    fresh[1:] = (np.diff(chosen) != 0) | (np.diff(doc) != 0)
    number = np.cumsum(fresh) - 1
    a_at = np.searchsorted(doc[fresh], np.arange(len(edges) + 1))
    return runs[chosen[fresh]], a_at, number - a_at[doc], e_at, doc


def _scan(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in K.byte_slices(batches, "text"):
            words = K.Words(*K.utf8_parts(part.column(2)))
            h = words.hashes()
            anchors, at, _, _, _ = _anchors(words, h, span)
            keep = pa.array(words.counts >= span)
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(anchors.view(np.int64)))
            first, second = K.whole(h, words.first), K.whole(K.mix64(h + np.uint64(1)), words.first)
            columns = [part.column(0), part.column(1), pa.array(first.view(np.int64)), pa.array(second.view(np.int64)), pa.array(words.counts), lists]
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in columns], ["doc_id", "ver", "h1", "h2", "n_words", "anchors"])

    return run


def _nodes(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in K.byte_slices(batches, "text"):
            words = K.Words(*K.utf8_parts(part.column(2)))
            h = words.hashes()
            anchors, a_at, number, e_at, doc = _anchors(words, h, span)
            hot = np.zeros(len(anchors), bool)
            lists = part.column(3)
            hot[lists.flatten().to_numpy() + np.repeat(a_at[:-1], np.diff(lists.offsets.to_numpy()))] = True
            candidate = hot[number + a_at[doc]]
            # node i of a text lies left of its edge i; a text has one node more than edges
            node, n_at = K.windows(h, words.first, span - 1)
            left = np.arange(e_at[-1]) - e_at[doc] + n_at[doc]
            wanted = np.zeros(len(node), bool)
            wanted[left[candidate]] = True
            wanted[left[candidate] + 1] = True
            at = np.flatnonzero(wanted)
            owner = np.searchsorted(n_at, at, "right") - 1
            t = at - n_at[owner]
            word = words.first[owner] + t
            token = np.maximum(h, np.uint64(1))  # 0 stands for no word
            before = np.where(t > 0, token[np.maximum(word - 1, 0)], 0).astype(np.uint64)
            past = word + span - 1
            after = np.where(past < words.first[owner + 1], token[np.minimum(past, len(token) - 1)], 0).astype(np.uint64)
            pos = (part.column(1).to_numpy()[owner] << 32) | t
            columns = [pa.array(node[at].view(np.int64)), part.column(0).take(pa.array(owner)), pa.array(pos), pa.array(before.view(np.int64)), pa.array(after.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["node", "doc_id", "pos", "before", "after"])

    return run


def _digests(span: int):
    """The digest of the words of each stretch (column spans, of structs of start, edges and the source's place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in K.byte_slices(batches, "text"):
            data, offsets = K.utf8_parts(part.column(2))
            words = K.Words(data, offsets)
            raw = data.tobytes()
            spans = part.column(3)
            flat = spans.flatten()
            owner = np.repeat(np.arange(part.num_rows), np.diff(spans.offsets.to_numpy()))
            start, edges = flat.field("start").to_numpy(), flat.field("edges").to_numpy()
            a = words.starts[words.first[owner] + start]
            b = words.ends[words.first[owner] + start + edges + span - 2]
            found = [hashlib.blake2b(b" ".join(raw[x:y].split()), digest_size=16).digest() for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            take = pa.array(owner)
            columns = [part.column(0).take(take), part.column(1).take(take), flat.field("start"), flat.field("edges"), flat.field("source_id"), flat.field("source_pos"), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ver", "start", "edges", "source_id", "source_pos", "digest"])

    return run


def _versions(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, bool]:
    """(doc_id, ver, text) without null ids, and whether ids repeat.

    Texts that share an id get numbers, in the order of their md5; rows that share both are one.
    """
    src = documents_only(docs, doc_id, text).select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")).filter("doc_id is not null")
    n = src.groupBy("doc_id").count().agg(F.max("count")).first()[0]
    if (n or 0) <= 1:
        return src.select("doc_id", F.lit(0).cast("bigint").alias("ver"), "text"), False
    # numbered by cells of 1/4096 of the md5 range, so that no doc_id is one task
    texts = src.select("doc_id", F.md5(F.col("text").cast("binary")).alias("m")).distinct().withColumn("cell", F.substring("m", 1, 3))
    cells = texts.groupBy("doc_id", "cell").agg(F.count("*").alias("n"))
    cells = cells.withColumn("before", F.sum("n").over(Window.partitionBy("doc_id").orderBy("cell")) - F.col("n")).drop("n")
    inside = F.row_number().over(Window.partitionBy("doc_id", "cell").orderBy("m"))
    numbers = texts.withColumn("r", inside).join(cells, ["doc_id", "cell"]).select("doc_id", "m", (F.col("before") + F.col("r") - 1).alias("ver"))
    marked = src.withColumn("m", F.md5(F.col("text").cast("binary"))).dropDuplicates(["doc_id", "m"])
    return marked.join(numbers, ["doc_id", "m"]).select("doc_id", "ver", "text"), True


def _branches(texts: DataFrame, span: int) -> DataFrame:
    """(doc_id, pos, before, n, source) of every node that is a branch or ends a text.

    n is how often the edge into the node occurs, source the least (doc_id, pos) of the node there.
    """
    schema = "node bigint, doc_id bigint, pos bigint, before bigint, after bigint"
    nodes = texts.mapInArrow(_nodes(span), schema)
    hot = hot_keys(sample(texts).mapInArrow(_nodes(span), schema), ["node"])
    warm = None
    if hot is not None:
        nodes, warm = split(nodes, hot, ["node"])
    nodes = nodes.repartition("node")  # one shuffle for both windows
    edge, node = Window.partitionBy("node", "before"), Window.partitionBy("node")
    place = F.struct("doc_id", "pos")
    differ = lambda c, over=None: (F.min(c).over(over) != F.max(c).over(over))
    found = nodes.select("*", F.count("*").over(edge).alias("n"), F.min(place).over(edge).alias("source"), (differ("before", node) | differ("after", node)).alias("branch"))
    found = found.filter("before = 0 or after = 0 or branch").select("doc_id", "pos", "before", "n", "source")
    if warm is None:
        return found
    # the same by aggregation and joins: the rows of a hot node are nowhere together
    edges = kept(warm.groupBy("node", "before").agg(F.count("*").alias("n"), F.min(place).alias("source"), F.min("after").alias("low"), F.max("after").alias("high")), "hot-edges")
    ends = edges.groupBy("node").agg(F.min("before").alias("b1"), F.max("before").alias("b2"), F.min("low").alias("a1"), F.max("high").alias("a2"))
    ends = ends.filter("b1 <> b2 or a1 <> a2 or b1 = 0 or a1 = 0").select("node")
    stats = kept(edges.join(ends, "node").select("node", "before", "n", "source"), "hot-ends")
    return found.unionByName(warm.join(stats, ["node", "before"]).select("doc_id", "pos", "before", "n", "source"))


def _stretches(src: DataFrame, span: int) -> DataFrame:
    """(doc_id, ver, start, edges, first): maximal runs of repeated edges of which all, or none, are first occurrences."""
    low = F.lit((1 << 32) - 1).cast("bigint")
    scanned = kept(src.mapInArrow(_scan(span), "doc_id bigint, ver bigint, h1 bigint, h2 bigint, n_words bigint, anchors array<bigint>"), "anchors")

    # whole copies
    prints, same = scanned.select("doc_id", "ver", "n_words", "h1", "h2"), ["h1", "h2", "n_words"]
    members = with_groups(prints, same, hot_keys(sample(prints), same), lead=F.min(F.struct("doc_id", "ver")), copies=F.count("*")).filter("copies > 1")
    members = kept(members.select("doc_id", "ver", "n_words", (F.struct("doc_id", "ver") == F.col("lead")).alias("leads")), "copies")
    followers = members.filter("not leads")

    # anchors that occur twice, by text
    listed = lambda s: s.join(followers.select("doc_id", "ver"), ["doc_id", "ver"], "left_anti").select("doc_id", "ver", F.posexplode("anchors").alias("number", "anchor"))
    each = with_groups(listed(scanned), ["anchor"], hot_keys(listed(sample(scanned)), ["anchor"]), n=F.count("*"))
    again = each.filter("n > 1").groupBy("doc_id", "ver").agg(F.collect_list("number").alias("hot"))
    texts = kept(src.join(again, ["doc_id", "ver"]).select("doc_id", "ver", "text", "hot"), "texts")
    release(scanned)

    ends = _branches(texts, span)
    none = F.col("before") == 0
    ends = ends.select("doc_id", F.shiftright("pos", 32).alias("ver"), F.col("pos").bitwiseAND(low).alias("t"), F.when(none, 0).otherwise(F.col("n")).alias("n"), F.when(~none, F.col("source")).alias("source"))
    # a text with copies is repeated from its first edge to its last, whether or not these are candidates
    led = members.filter("leads")
    around = led.select("doc_id", "ver", F.explode(F.array(F.lit(0).cast("bigint"), F.col("n_words") - (span - 1))).alias("t"), F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("struct<doc_id:bigint,pos:bigint>").alias("source"))
    ends = ends.unionByName(around).groupBy("doc_id", "ver", "t").agg(F.max("n").alias("n"), F.max("source").alias("source"))
    ends = ends.withColumn("number", F.row_number().over(Window.partitionBy("doc_id", "ver").orderBy("t")))
    ends = kept(ends, "ends")
    # compaction: the path to a branch starts at the branch before it
    starts = ends.select("doc_id", "ver", (F.col("number") + 1).alias("number"), F.col("t").alias("start"))
    paths = ends.join(starts, ["doc_id", "ver", "number"]).withColumn("edges", F.col("t") - F.col("start"))
    paths = kept(paths.join(led.select("doc_id", "ver", F.lit(True).alias("led")), ["doc_id", "ver"], "left").filter("n > 1 or led").select("doc_id", "ver", "start", "edges", F.coalesce("n", F.lit(0)).alias("n"), "source", F.coalesce("led", F.lit(False)).alias("led")), "paths")
    release(ends)

    # compare each path's words with those at its source: the place of the last edge's source, less the length
    repeated = paths.filter("n > 1").select("doc_id", "ver", F.struct("start", "edges", F.col("source.doc_id").alias("source_id"), (F.col("source.pos") - F.col("edges")).alias("source_pos")).alias("x"))
    lists = repeated.groupBy("doc_id", "ver").agg(F.collect_list("x").alias("spans"))
    digests = texts.select("doc_id", "ver", "text").join(lists, ["doc_id", "ver"]).mapInArrow(_digests(span), "doc_id bigint, ver bigint, start bigint, edges bigint, source_id bigint, source_pos bigint, digest binary")
    is_source = (F.col("doc_id") == F.col("source_id")) & (F.shiftleft("ver", 32).bitwiseOR(F.col("start")) == F.col("source_pos"))
    digests = kept(digests.withColumn("first", is_source), "digests")
    wanted = digests.filter("first").select("source_id", "source_pos", "edges", F.col("digest").alias("wanted"))
    checked = digests.join(wanted, ["source_id", "source_pos", "edges"]).filter("digest = wanted").select("doc_id", "ver", "start", "edges", "first")
    # what is repeated in copies only is first in the text that leads them
    alone = paths.filter("n <= 1 and led").select("doc_id", "ver", "start", "edges", F.lit(True).alias("first"))
    whole = followers.select("doc_id", "ver", F.lit(0).cast("bigint").alias("start"), (F.col("n_words") - (span - 1)).alias("edges"), F.lit(False).alias("first"))
    every = checked.unionByName(alone).unionByName(whole)
    order = Window.partitionBy("doc_id", "ver").orderBy("start")
    new = (F.lag("first").over(order).isNull()) | (F.lag("first").over(order) != F.col("first")) | (F.lag(F.col("start") + F.col("edges")).over(order) != F.col("start"))
    islands = every.withColumn("new", new.cast("int")).withColumn("island", F.sum("new").over(order))
    found = kept(islands.groupBy("doc_id", "ver", "island").agg(F.min("start").alias("start"), F.sum("edges").alias("edges"), F.first("first").alias("first")).drop("island"), "stretches")
    for done in (members, texts, paths, digests):
        release(done)
    return found


def repeated_spans(docs: DataFrame, span: int = SPAN, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start_word, end_word, first): the passages of at least ``span`` words that occur more than once.

    A run of ``span`` words is repeated if the same words follow each other at another place
    of the corpus, in the same text or another; white space doesn't count, capitals do.  Of
    its occurrences the one with the least (doc_id, place) is first.  A row is a maximal
    stretch [start_word, end_word) covered by consecutive repeated runs that are all first
    (``first``) or all not.

    Defined cases: rows with a null doc_id are left out; null, empty and short texts have no
    passages; rows that repeat both doc_id and text are one document, texts that share a
    doc_id are documents of their own, in the order of their md5; an empty table gives no
    rows; other columns are ignored.  There is no bound on lengths or occurrences.
    """
    if span < 2:
        raise ValueError("span must be at least 2 words")
    src, _ = _versions(docs, doc_id, text)
    found = _stretches(src, span)
    return found.select("doc_id", F.col("start").alias("start_word"), (F.col("start") + F.col("edges") + span - 1).alias("end_word"), "first")


def _cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """The texts without the words of their spans, [start, end) each; null where no word is left, or spans are null."""
    data, offsets = K.utf8_parts(texts)
    words = K.Words(data, offsets)
    flat = spans.flatten()
    lengths = pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False)
    base = words.first[np.repeat(np.arange(len(texts)), lengths)]
    gone = np.zeros(len(words.starts) + 1, np.int64)
    np.add.at(gone, base + flat.field("start").to_numpy(), 1)
    np.add.at(gone, base + flat.field("end").to_numpy(), -1)
    gone = np.cumsum(gone[:-1]) > 0
    # a word goes with the white space after it
    until = np.r_[words.starts[1:], len(data)]
    until[words.first[1:][words.counts > 0] - 1] = offsets[1:][words.counts > 0]
    drop = np.zeros(len(data) + 1, np.int64)
    np.add.at(drop, words.starts[gone], 1)
    np.add.at(drop, until[gone], -1)
    stay = np.cumsum(drop[:-1]) == 0
    kept_bytes = np.zeros(len(data) + 1, np.int64)
    np.cumsum(stay, out=kept_bytes[1:])
    left = np.zeros(len(gone) + 1, np.int64)
    np.cumsum(~gone, out=left[1:])
    none = (left[words.first[1:]] == left[words.first[:-1]]) | spans.is_null().to_numpy(zero_copy_only=False)
    out = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(kept_bytes[offsets]), pa.py_buffer(data[stay]))
    return pc.if_else(pa.array(none), pa.scalar(None, pa.large_string()), out).cast(pa.string())


def drop_repeats(docs: DataFrame, span: int = SPAN, doc_id: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """docs without the passages that repeated_spans() finds not to be first; all columns, ``n_chars`` counted anew where a text was cut.

    A document of which no word is left goes.  Rows with a null doc_id or text stay as they are.
    """
    src, again = _versions(docs, doc_id, text)
    id_, ver, spans, md5, new = (free_name(c, docs) for c in ("id", "ver", "spans", "md5", "new"))
    lost = _stretches(src, span).filter("not first").groupBy("doc_id", "ver").agg(F.collect_list(F.struct("start", (F.col("start") + F.col("edges") + span - 1).alias("end"))).alias("spans"))
    lost = lost.select(F.col("doc_id").alias(id_), F.col("ver").alias(ver), F.col("spans").alias(spans))
    same = F.col(f"`{doc_id}`").cast("bigint") == F.col(f"`{id_}`")
    if again:
        numbers = src.select(F.col("doc_id").alias(id_), F.col("ver").alias(ver), F.md5(F.col("text").cast("binary")).alias(md5))
        lost = lost.join(numbers, [id_, ver])
        same = same & (F.md5(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary")) == F.col(f"`{md5}`"))

    # called nondeterministic below, so that the filter on its result doesn't evaluate it a second time
    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return _cut(texts, spans)

    old, changed = F.col(f"`{text}`").cast("string"), F.col(f"`{spans}`").isNotNull()
    joined = docs.join(lost, same, "left").withColumn(new, cut.asNondeterministic()(F.when(changed, old), F.col(f"`{spans}`"))).filter(~changed | F.col(f"`{new}`").isNotNull())

    def column(c: str):
        if c == text:
            return F.when(changed, F.col(f"`{new}`")).otherwise(F.col(f"`{c}`")).alias(c)
        if c == n_chars:
            return F.when(changed, F.length(F.col(f"`{new}`")).cast(docs.schema[c].dataType)).otherwise(F.col(f"`{c}`")).alias(c)
        return F.col(f"`{c}`")

    return joined.select(*[column(c) for c in docs.columns])


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"))


_ORACLE = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(text, '{K.WORD_CLASS}') AS ws FROM documents),
e AS (SELECT doc_id, ws, unnest(range(0, len(ws) - {SPAN - 1})) AS i FROM d WHERE len(ws) >= {SPAN}),
h AS (SELECT doc_id, i, md5(array_to_string(ws[i + 1:i + {SPAN}], ' ')) AS h FROM e),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) = 1 AS is_first FROM h),
r AS (SELECT doc_id, i, is_first, i - row_number() OVER (PARTITION BY doc_id, is_first ORDER BY i) AS island FROM c WHERE n > 1)
SELECT doc_id, min(i)::BIGINT AS start_word, (max(i) + {SPAN})::BIGINT AS end_word, is_first AS "first" FROM r GROUP BY doc_id, is_first, island
"""

QUERIES = {"op7_substrings": op7_substrings}
ORACLE = {"op7_substrings": _ORACLE}
