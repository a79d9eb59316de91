"""Queries on splits of the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.functions.text import fingerprint, normalize_text
from attestra.operators import leakage as L
from attestra.operators import similarity as S
from attestra.sources.tables import split_documents, table

# on these tables ß is the one character whose folded form isn't its small form
_NORMAL = "trim(regexp_replace(replace(lower({0}), 'ß', 'ss'), '\\s+', ' ', 'g'))"
_SPLIT = "train AS (SELECT * FROM documents WHERE doc_id % 5 <> 0), test AS (SELECT * FROM documents WHERE doc_id % 5 = 0)"
_LOUD = "loud AS (SELECT * REPLACE (CASE WHEN doc_id % 2 = 0 THEN upper(text) ELSE replace(text, ' ', '  ') END AS text) FROM test)"


def _loud(test: DataFrame) -> DataFrame:
    """The test rows in capitals or with doubled spaces, so that only normalisation finds them."""
    return test.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.upper("text")).otherwise(F.replace("text", F.lit(" "), F.lit("  "))))


def split_exact_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = split_documents(spark, sf_dir)
    return L.overlap(train, test, ["text"]).select("doc_id", "lang", "source")


def split_normalized_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = split_documents(spark, sf_dir)
    return L.overlap(train, _loud(test), ["text"], normalize=True).select("doc_id")


def split_normalized_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = split_documents(spark, sf_dir)
    return L.normalized_only(train, _loud(test), ["text"]).select("doc_id")


def split_group_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = split_documents(spark, sf_dir)
    return L.group_overlap(train, test, "lang")


def split_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.duplicates(table(spark, sf_dir, "documents"), ["text", "lang"])


def leakage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = split_documents(spark, sf_dir)
    return L.leakage_summary(train, test, ["text"], group="source", label="lang")


def overlap_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five overlapping rows, as the report shows them."""
    return split_exact_overlap(spark, sf_dir).orderBy("doc_id").limit(5)


def cross_split_exact_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("split", F.when(F.col("doc_id") % 5 == 0, "test").when(F.col("doc_id") % 5 == 1, "validation").otherwise("train"))
    return L.exact_pairs(docs, "doc_id", "split", "text")


def row_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", fingerprint(["lang", "source"]).alias("fingerprint"), F.sha2(normalize_text("text"), 256).alias("normal_sha256"))


def near_match_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = split_documents(spark, sf_dir)
    return S.best_matches(train, test, "doc_id", "doc_id", "text", 0.8, "token_jaccard_v1")


def _turns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(questions, answers) of the conversations."""
    turns = table(spark, sf_dir, "conversations").withColumn("id", F.concat_ws(":", "conv_id", "turn"))
    return turns.filter("role = 'user'"), turns.filter("role <> 'user'")


def near_match_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each answer in the conversations the question most like it, by words or trigrams."""
    return S.best_matches(*_turns(spark, sf_dir), "id", "id", "text", 0.4, "hybrid_lexical_v1")


def near_match_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each answer in the conversations the question most like it, in word order."""
    return S.best_matches(*_turns(spark, sf_dir), "id", "id", "text", 0.3, "ordered_tokens_v1")


def near_match_hybrid_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each test document the train document most like it, by words or trigrams.  Its SQL would compare all pairs; tests hold it against brute force."""
    train, test = split_documents(spark, sf_dir)
    return S.best_matches(train, test, "doc_id", "doc_id", "text", 0.9, "hybrid_lexical_v1")


def near_match_ordered_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each test document the train document most like it, in word order."""
    train, test = split_documents(spark, sf_dir)
    return S.best_matches(train, test, "doc_id", "doc_id", "text", 0.8, "ordered_tokens_v1")


def near_match_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = split_documents(spark, sf_dir)
    return S.scored_pairs(train, test, "doc_id", "doc_id", "text", 0.8)


def _corpus(spark: SparkSession, n_train: int, n_test: int, common: str) -> tuple[DataFrame, DataFrame]:
    """Generated rows: every other test row is a train row, and ``common`` stands before all of them."""
    words = lambda i, *forms: F.concat_ws(" ", *([F.lit(common)] if common else []), *[F.concat(F.lit(w), x(i).cast("string")) for w, x in forms])
    known = lambda i: words(i, ("topic", lambda i: i % 97), ("sample", lambda i: i), ("measurement", lambda i: i * 17 + 3))
    novel = lambda i: words(i, ("novel", lambda i: i), ("independent", lambda i: i), ("unseen", lambda i: i * 19 + 5))
    i = F.col("id")
    train = spark.range(n_train).select("id", known(i).alias("text"))
    return train, spark.range(n_test).select("id", F.when(i % 2 == 0, known(i * 37 % n_train)).otherwise(novel(i)).alias("text"))


def join_counters_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of 10,000 x 1,000 generated rows, where few rows share a token."""
    return S.join_counters(*_corpus(spark, 10_000, 1_000, ""), "id", "id", "text")


def join_counters_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of 2,000 x 200 generated rows that all share a token."""
    return S.join_counters(*_corpus(spark, 2_000, 200, "shared"), "id", "id", "text")


def near_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test documents with a near copy in train, but for those equal to a train document after normalisation."""
    train, test = split_documents(spark, sf_dir)
    return S.near_overlap(train, test, "doc_id", "doc_id", "text", 0.8, "token_jaccard_v1")


def cross_split_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("split", F.when(F.col("doc_id") % 5 == 0, "test").when(F.col("doc_id") % 5 == 1, "validation").otherwise("train"))
    return S.cross_split_near(docs, "doc_id", "split", "text", 0.9, "token_jaccard_v1")


_TOKENS = "regexp_extract_all(" + _NORMAL.format("text") + ", '[\\p{L}\\p{N}\\p{M}_]+')"
_WORDS = "trim(regexp_replace(regexp_replace(" + _NORMAL.format("text") + ", '[^\\p{L}\\p{N}\\p{M}_\\s]+', ' ', 'g'), '\\s+', ' ', 'g'))"
_PAIRS = """c AS (SELECT x.doc_id AS test_id, y.doc_id AS train_id, count(*) AS k FROM u x JOIN u y ON x.g = y.g AND x.doc_id % 5 = 0 AND y.doc_id % 5 <> 0 GROUP BY 1, 2)"""



def _counters(n_train: int, n_test: int, common: str) -> str:
    known = f"['{common}', 'topic' || ({{0}} % 97), 'sample' || {{0}}, 'measurement' || ({{0}} * 17 + 3)]"
    return f"""WITH a AS (SELECT i, {known.format("i")} AS f FROM range({n_train}) r(i)),
b AS (SELECT i, CASE WHEN i % 2 = 0 THEN {known.format(f"(i * 37 % {n_train})")} ELSE ['{common}', 'novel' || i, 'independent' || i, 'unseen' || (i * 19 + 5)] END AS f FROM range({n_test}) r(i)),
u AS (SELECT i, unnest(list_filter(f, lambda x: x <> '')) AS g FROM a), v AS (SELECT i, unnest(list_filter(f, lambda x: x <> '')) AS g FROM b),
c AS (SELECT u.i, v.i AS j, count(*) AS m FROM u JOIN v USING (g) GROUP BY 1, 2)
SELECT ({n_train} * {n_test})::BIGINT AS exhaustive, count(*) AS candidates, sum((2.0 * m / {8 if common else 6} >= 0.8)::INT)::BIGINT AS scored FROM c"""


QUERIES = {f.__name__: f for f in (split_exact_overlap, split_normalized_overlap, split_normalized_only, split_group_overlap, split_duplicates, leakage_summary, overlap_examples, cross_split_exact_pairs, row_fingerprints, near_match_jaccard, near_match_hybrid, near_match_ordered, near_match_hybrid_documents, near_match_ordered_documents, near_match_counters, join_counters_sparse, join_counters_common, near_overlap, cross_split_near)}
ORACLE = {
    "split_exact_overlap": f"WITH {_SPLIT} SELECT doc_id, lang, source FROM test WHERE text IN (SELECT text FROM train)",
    "split_normalized_overlap": f"WITH {_SPLIT}, {_LOUD} SELECT doc_id FROM loud WHERE {_NORMAL.format('text')} IN (SELECT {_NORMAL.format('text')} FROM train)",
    "split_normalized_only": f"WITH {_SPLIT}, {_LOUD} SELECT doc_id FROM loud WHERE {_NORMAL.format('text')} IN (SELECT {_NORMAL.format('text')} FROM train) AND text NOT IN (SELECT text FROM train)",
    "split_group_overlap": f"WITH {_SPLIT} SELECT lower(lang) AS group_value FROM train INTERSECT SELECT lower(lang) FROM test",
    "split_duplicates": "SELECT coalesce(sum(n - 1), 0)::BIGINT AS duplicate_rows FROM (SELECT count(*) AS n FROM documents GROUP BY text, lang)",
    "leakage_summary": f"""WITH {_SPLIT},
e AS (SELECT count(*) AS n FROM test WHERE text IN (SELECT text FROM train)),
o AS (SELECT count(*) AS n FROM test WHERE {_NORMAL.format('text')} IN (SELECT {_NORMAL.format('text')} FROM train)),
g AS (SELECT count(*) AS n FROM (SELECT source FROM train INTERSECT SELECT source FROM test))
SELECT (SELECT count(*) FROM train) AS train_rows, t.n AS test_rows, e.n AS exact_overlap, o.n AS normalized_overlap, o.n - e.n AS normalized_only,
  (SELECT coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM train GROUP BY text)) AS train_duplicates,
  (SELECT coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM test GROUP BY text)) AS test_duplicates,
  e.n / t.n AS exact_rate, o.n / t.n AS normalized_rate, g.n AS group_overlap FROM (SELECT count(*) AS n FROM test) t, e, o, g""",
    "overlap_examples": f"WITH {_SPLIT} SELECT doc_id, lang, source FROM test WHERE text IN (SELECT text FROM train) ORDER BY doc_id LIMIT 5",
    "cross_split_exact_pairs": f"""WITH d AS (SELECT doc_id, {_NORMAL.format('text')} AS t, CASE doc_id % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS s FROM documents)
SELECT l.doc_id AS left_position, r.doc_id AS right_position, l.s AS left_split, r.s AS right_split FROM d l JOIN d r ON l.t = r.t AND l.doc_id < r.doc_id AND l.s <> r.s""",
    "row_fingerprints": f"""SELECT doc_id, sha256('["' || lang || '","' || source || '"]') AS fingerprint, sha256({_NORMAL.format('text')}) AS normal_sha256 FROM documents""",
    "near_match_jaccard": f"""WITH s AS (SELECT doc_id, list_distinct({_TOKENS}) AS f FROM documents), u AS (SELECT doc_id, unnest(f) AS g FROM s), {_PAIRS},
j AS (SELECT test_id, train_id, k / (len(a.f) + len(b.f) - k) AS similarity FROM c JOIN s a ON a.doc_id = test_id JOIN s b ON b.doc_id = train_id)
SELECT test_id, train_id, similarity FROM j WHERE similarity >= 0.8 QUALIFY row_number() OVER (PARTITION BY test_id ORDER BY similarity DESC, train_id) = 1""",
    "near_match_hybrid": f"""WITH s AS (SELECT conv_id || ':' || turn AS id, role <> 'user' AS is_test, list_distinct({_TOKENS}) AS f, ' ' || {_WORDS} || ' ' AS w FROM conversations),
t AS (SELECT id, is_test, f, CASE WHEN length(w) < 5 THEN [] ELSE list_distinct(list_transform(range(1, length(w) - 1), lambda i: substring(w, i, 3))) END AS h FROM s),
u AS (SELECT id, is_test, 't' || unnest(f) AS g FROM t UNION ALL SELECT id, is_test, 'g' || unnest(h) FROM t),
c AS (SELECT x.id AS test_id, y.id AS train_id, sum((x.g[1] = 't')::INT) AS k, sum((x.g[1] = 'g')::INT) AS m FROM u x JOIN u y ON x.g = y.g AND x.is_test AND NOT y.is_test GROUP BY 1, 2),
j AS (SELECT test_id, train_id, greatest(k / (len(a.f) + len(b.f) - k), CASE WHEN len(a.h) + len(b.h) > 0 THEN 2.0::DOUBLE * m / (len(a.h) + len(b.h)) ELSE 0 END) AS similarity FROM c JOIN t a ON a.id = test_id JOIN t b ON b.id = train_id)
SELECT test_id, train_id, similarity FROM j WHERE similarity >= 0.4::DOUBLE QUALIFY row_number() OVER (PARTITION BY test_id ORDER BY similarity DESC, train_id) = 1""",
    "near_match_counters": f"""WITH s AS (SELECT doc_id, {_TOKENS} AS f FROM documents), e AS (SELECT doc_id, unnest(f) AS g FROM s), u AS (SELECT doc_id, g, count(*) AS n FROM e GROUP BY 1, 2),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(least(x.n, y.n)) AS m FROM u x JOIN u y ON x.g = y.g AND x.doc_id % 5 = 0 AND y.doc_id % 5 <> 0 GROUP BY 1, 2)
SELECT (SELECT count(*) FROM s WHERE doc_id % 5 = 0 AND len(f) > 0) * (SELECT count(*) FROM s WHERE doc_id % 5 <> 0) AS exhaustive,
  sum((2.0 * m / (len(l.f) + len(r.f)) >= 0.8)::INT)::BIGINT AS scored FROM c JOIN s l ON l.doc_id = a JOIN s r ON r.doc_id = b""",
    "join_counters_sparse": _counters(10_000, 1_000, ""),
    "join_counters_common": _counters(2_000, 200, "shared"),
    "near_overlap": f"""WITH s AS (SELECT doc_id, {_NORMAL.format('text')} AS t, list_distinct({_TOKENS}) AS f FROM documents), u AS (SELECT doc_id, unnest(f) AS g FROM s), {_PAIRS},
j AS (SELECT test_id, train_id, k / (len(a.f) + len(b.f) - k) AS similarity FROM c JOIN s a ON a.doc_id = test_id JOIN s b ON b.doc_id = train_id WHERE a.t NOT IN (SELECT t FROM s WHERE doc_id % 5 <> 0))
SELECT test_id, train_id, similarity FROM j WHERE similarity >= 0.8 QUALIFY row_number() OVER (PARTITION BY test_id ORDER BY similarity DESC, train_id) = 1""",
    "cross_split_near": f"""WITH s AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS p, {_NORMAL.format('text')} AS t, list_distinct({_TOKENS}) AS f FROM documents), u AS (SELECT doc_id, p, unnest(f) AS g FROM s),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, x.p AS pa, y.p AS pb, count(*) AS k FROM u x JOIN u y ON x.g = y.g AND x.p < y.p GROUP BY 1, 2, 3, 4),
j AS (SELECT c.*, k / (len(l.f) + len(r.f) - k) AS similarity, l.t <> r.t AS differ FROM c JOIN s l ON l.doc_id = a JOIN s r ON r.doc_id = b),
m AS (SELECT * FROM j WHERE similarity >= 0.9 QUALIFY row_number() OVER (PARTITION BY pa, pb, b ORDER BY similarity DESC, a) = 1)
SELECT ['train', 'validation', 'test'][pa + 1] AS left_split, a AS left_block, ['train', 'validation', 'test'][pb + 1] AS right_split, b AS right_block, similarity FROM m WHERE differ""",
}
