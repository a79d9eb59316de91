"""Queries on features, ranking, artifacts and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.functions import text as T
from attestra.functions.stats import sigmoid
from attestra.operators import artifacts as A
from attestra.operators import features as X
from attestra.operators import split as P
from attestra.operators import study as S
from attestra.sources.tables import table


def word_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.word_counts(table(spark, sf_dir, "conversations").withColumn("id", F.concat_ws(":", "conv_id", "turn")), "id", "text")


def idf_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.idf(word_features(spark, sf_dir), table(spark, sf_dir, "conversations"), 2000)


def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = word_features(spark, sf_dir)
    return X.tfidf(counts, X.idf(counts, table(spark, sf_dir, "conversations"), 2000), "id")


def character_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.character_counts(table(spark, sf_dir, "benchmark"), "item_id", "text")


def word_features_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.word_counts(table(spark, sf_dir, "documents"), "doc_id", "text", unique=True)


def idf_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the 20,000 commonest features."""
    return X.idf(word_features_documents(spark, sf_dir), table(spark, sf_dir, "documents"))


def tfidf_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.tfidf(word_features_documents(spark, sf_dir), idf_documents(spark, sf_dir), "doc_id")


def character_features_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.character_counts(table(spark, sf_dir, "documents"), "doc_id", "text", unique=True)


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn with the one before it."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    before = t.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("before"))
    return t.join(before, ["conv_id", "turn"])


def lexical_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("conv_id", "turn", T.lexical_overlap(F.col("before"), F.col("text")).alias("overlap"))


def numeric_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("conv_id", "turn", T.numeric_consistency(F.col("before"), F.col("text")).alias("consistency"))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as claims, suppliers as candidates of the same region, features from their columns."""
    n = table(spark, sf_dir, "nation")
    s = table(spark, sf_dir, "supplier").join(n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("r")), "s_nationkey")
    c = n.select(F.col("n_nationkey").alias("claim_id"), F.col("n_regionkey").alias("r"))
    same = (F.col("claim_id") == F.col("s_nationkey")).cast("double")
    return c.join(s, "r").select("claim_id", F.col("s_suppkey").alias("artifact_id"), same.alias("same_metric"), F.greatest(F.lit(0.0), F.col("s_acctbal") / 10000.0).alias("grade"), (F.col("s_suppkey") % 5 / 4.0).alias("completeness"))


def ranker_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = 1.5 * F.col("same_metric") + 0.7 * F.col("grade") + 0.4 * F.col("completeness") - 1.0
    return X.rank(_candidates(spark, sf_dir).withColumn("score", sigmoid(z)), "claim_id", "artifact_id").select("claim_id", "artifact_id", "score", "rank")


def ranking_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each nation's least supplier of its own stands."""
    own = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("claim_id")).agg(F.min("s_suppkey").alias("artifact_id"))
    ranked = ranker_scores(spark, sf_dir)
    claims = ranked.select("claim_id").distinct()
    return S.ranking_quality(claims.join(own.join(ranked, ["claim_id", "artifact_id"]).select("claim_id", "rank"), "claim_id", "left"))


def artifact_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _paths(spark, sf_dir)
    return p.select("page_id", A.role(F.col("path")).alias("role"))


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files: the path from the url and a name by number."""
    name = F.expr("case page_id % 6 when 0 then 'predictions.csv' when 1 then 'metrics.json' when 2 then 'README.md' when 3 then 'tests/report.md' when 4 then 'model.bin' else 'eval_scores.csv' end")
    host = F.regexp_extract("url", r"^https?://([^/]+)/", 1)
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^https?://[^/]+/([a-z]+)", 1).alias("repository"), F.concat_ws("/", host, F.col("page_id").cast("string"), name).alias("path"), F.octet_length("html").alias("size"))


def artifact_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to twenty files a repository, none over 20,000 bytes; the limits are the feature."""
    return A.select(_paths(spark, sf_dir), "repository", "path", "size", 20, 20_000).select("page_id", "role", "reason")


def hash_ranked_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.hash_ranked(table(spark, sf_dir, "pages").withColumn("site", F.regexp_extract("url", r"^https?://[^/]+/([a-z]+)", 1)), "site", "url", 5).select("page_id", "site", "rank")


def owner_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.assign(table(spark, sf_dir, "customer"), "c_mktsegment", "c_nationkey", 7)


def lineage_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as repositories, their segments as domains; those of one phone class in a segment share a lineage, and blocks tie some classes."""
    c = table(spark, sf_dir, "customer")
    repositories = c.select(F.col("c_custkey").alias("repository"), F.col("c_mktsegment").alias("domain"), F.concat_ws(":", "c_mktsegment", (F.col("c_custkey") % 29).cast("string")).alias("lineage"))
    blocks = c.filter("c_custkey % 29 in (3, 7, 11)").select(F.col("c_custkey").alias("repository"), F.concat_ws(":", F.lit("tied"), "c_mktsegment").alias("lineage"))
    return P.owner_disjoint(repositories, "repository", "domain", "lineage", 11, blocks=blocks)


_TURNS = "t AS (SELECT a.conv_id, a.turn, lower(b.text) AS p, lower(a.text) AS q, b.text AS bt, a.text AS at_ FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1)"
_SETS = "list_distinct(list_filter(string_split_regex({0}, '\\s+'), lambda x: length(x) > 1))"
_CANDIDATES = """c AS (SELECT n.n_nationkey AS claim_id, s_suppkey AS artifact_id, 1.0::DOUBLE / (1.0::DOUBLE + exp(-(1.5::DOUBLE * (n.n_nationkey = s_nationkey)::INT + 0.7::DOUBLE * greatest(0.0::DOUBLE, s_acctbal / 10000.0::DOUBLE) + 0.4::DOUBLE * (s_suppkey % 5 / 4.0::DOUBLE) - 1.0::DOUBLE))) AS score
FROM nation n JOIN nation m ON n.n_regionkey = m.n_regionkey JOIN supplier ON s_nationkey = m.n_nationkey),
r AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, artifact_id)::INT AS rank FROM c)"""
_PATHS = """f AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+/([a-z]+)', 1) AS repository, regexp_extract(url, '^https?://([^/]+)/', 1) || '/' || page_id || '/' || CASE page_id % 6 WHEN 0 THEN 'predictions.csv' WHEN 1 THEN 'metrics.json' WHEN 2 THEN 'README.md' WHEN 3 THEN 'tests/report.md' WHEN 4 THEN 'model.bin' ELSE 'eval_scores.csv' END AS path, strlen(html) AS size FROM pages),
k AS (SELECT *, CASE page_id % 6 WHEN 0 THEN 'predictions' WHEN 1 THEN 'metrics' WHEN 2 THEN 'report' WHEN 5 THEN 'metrics' END AS role FROM f)"""

_ML = "trim(regexp_replace(regexp_replace(replace(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\\s+', ' ', 'g')), '−', '-'), '(^|[^\\p{L}\\p{N}\\p{M}_.])[-+]?\\d+(?:[.,]\\d+)*%?', '\\1<num>', 'g'), '\\s+', ' ', 'g'))"
_WORDS = f"""s AS (SELECT conv_id || ':' || turn AS id, regexp_extract_all({_ML}, '<num>|[\\p{{L}}\\p{{N}}\\p{{M}}_]+') AS w FROM conversations),
u AS (SELECT id, 'w1:' || unnest(w) AS feature FROM s UNION ALL SELECT id, unnest(list_transform(range(1, len(w)), lambda i: 'w2:' || w[i] || ' ' || w[i + 1])) FROM s),
n AS (SELECT id, feature, count(*) AS n FROM u GROUP BY 1, 2),
d AS (SELECT feature, count(*) AS df FROM n GROUP BY 1 ORDER BY df DESC, feature LIMIT 2000),
i AS (SELECT feature, df, ln((1.0::DOUBLE + (SELECT count(*) FROM conversations)) / (1.0::DOUBLE + df)) + 1.0::DOUBLE AS idf FROM d)"""

#: One seat each, then one after the other to the split that lacks most of its share.
_SEATS = """n AS (SELECT domain, count(*) AS n FROM r GROUP BY 1),
t AS (SELECT domain, n, 1 AS a, 1 AS b, 1 AS c FROM n UNION ALL
  SELECT domain, n, a + (w = 1)::INT, b + (w = 2)::INT, c + (w = 3)::INT FROM (SELECT *, CASE WHEN n * 0.6::DOUBLE - a >= n * 0.2::DOUBLE - b AND n * 0.6::DOUBLE - a >= n * 0.2::DOUBLE - c THEN 1 WHEN n * 0.2::DOUBLE - b >= n * 0.2::DOUBLE - c THEN 2 ELSE 3 END AS w FROM t WHERE a + b + c < n)),
s AS (SELECT domain, a, b, c FROM t WHERE a + b + c = n)"""

QUERIES = {f.__name__: f for f in (word_features, idf_top, tfidf_weights, character_features, word_features_documents, idf_documents, tfidf_documents, character_features_documents, lexical_overlap, numeric_consistency, ranker_scores, ranking_mrr, artifact_roles, artifact_selection, hash_ranked_sample, owner_split, lineage_split)}
ORACLE = {
    "word_features": f"WITH {_WORDS} SELECT id, feature, n FROM n",
    "idf_top": f"WITH {_WORDS} SELECT feature, df, idf FROM i",
    "tfidf_weights": f"WITH {_WORDS}, r AS (SELECT id, feature, (1.0::DOUBLE + ln(n)) * idf AS w FROM n JOIN i USING (feature)) SELECT id, feature, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM r",
    "character_features": f"WITH p AS (SELECT item_id, ' ' || {_ML} || ' ' AS t FROM benchmark), u AS (SELECT item_id, k, unnest(range(1, length(t) - k + 2)) AS i, t FROM p, (SELECT unnest([3, 4, 5]) AS k)) SELECT item_id, 'c' || k || ':' || substring(t, i, k) AS feature, count(*) AS n FROM u GROUP BY 1, 2",
    "lexical_overlap": f"WITH {_TURNS}, s AS (SELECT conv_id, turn, {_SETS.format('p')} AS a, {_SETS.format('q')} AS b FROM t), k AS (SELECT *, len(list_intersect(a, b)) AS k FROM s) SELECT conv_id, turn, CASE WHEN len(a) + len(b) - k > 0 THEN k / (len(a) + len(b) - k) ELSE 0 END AS overlap FROM k",
    "numeric_consistency": f"WITH {_TURNS}, s AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(bt, '(\\d+(?:[.,]\\d+)?)', 1)) AS a, list_distinct(regexp_extract_all(at_, '(\\d+(?:[.,]\\d+)?)', 1)) AS b FROM t) SELECT conv_id, turn, CASE WHEN len(a) > 0 THEN len(list_intersect(a, b)) / len(a) ELSE 1 END AS consistency FROM s",
    "ranker_scores": f"WITH {_CANDIDATES} SELECT * FROM r",
    "ranking_mrr": f"""WITH {_CANDIDATES}, o AS (SELECT s_nationkey AS claim_id, min(s_suppkey) AS artifact_id FROM supplier GROUP BY 1), q AS (SELECT c.claim_id, r.rank FROM (SELECT DISTINCT claim_id FROM r) c LEFT JOIN (SELECT * FROM o JOIN r USING (claim_id, artifact_id)) r ON r.claim_id = c.claim_id)
SELECT count(*) AS cases, avg(coalesce((rank <= 1)::INT, 0)) AS recall_at_1, avg(coalesce((rank <= 3)::INT, 0)) AS recall_at_3, avg(coalesce(1.0::DOUBLE / rank, 0)) AS mrr FROM q""",
    "artifact_roles": f"WITH {_PATHS} SELECT page_id, role FROM k",
    "artifact_selection": f"""WITH {_PATHS}, o AS (SELECT *, row_number() OVER (PARTITION BY repository, size <= 20000 ORDER BY CASE role WHEN 'report' THEN 0 WHEN 'metrics' THEN 1 ELSE 2 END, len(string_split(path, '/')), lower(path), path) AS r FROM k WHERE role IS NOT NULL)
SELECT page_id, role, CASE WHEN size > 20000 THEN 'oversized' WHEN r > 20 THEN 'artifact_limit' END AS reason FROM o""",
    "hash_ranked_sample": "WITH p AS (SELECT page_id, url, regexp_extract(url, '^https?://[^/]+/([a-z]+)', 1) AS site FROM pages) SELECT page_id, site, (row_number() OVER (PARTITION BY site ORDER BY sha256(url), url))::INT AS rank FROM p QUALIFY rank <= 5",
    "owner_split": f"""WITH RECURSIVE g AS (SELECT DISTINCT c_mktsegment AS domain, c_nationkey AS k FROM customer), r AS (SELECT domain, k, row_number() OVER (PARTITION BY domain ORDER BY sha256('7:' || k), k) AS r FROM g), {_SEATS}
SELECT domain AS c_mktsegment, k AS c_nationkey, CASE WHEN r <= a THEN 'train' WHEN r <= a + b THEN 'validation' ELSE 'test' END AS split FROM r JOIN s USING (domain)""",
    "lineage_split": f"""WITH RECURSIVE q AS (SELECT c_custkey AS repository, c_mktsegment AS domain, CASE WHEN c_custkey % 29 IN (3, 7, 11) THEN 3 ELSE c_custkey % 29 END AS c FROM customer),
p AS (SELECT repository, domain, min(repository) OVER (PARTITION BY domain, c) AS component FROM q), g AS (SELECT DISTINCT domain, component AS k FROM p),
r AS (SELECT domain, k, row_number() OVER (PARTITION BY domain ORDER BY sha256('11:' || k), k) AS r FROM g), {_SEATS}
SELECT p.domain, p.repository, p.component, CASE WHEN r <= a THEN 'train' WHEN r <= a + b THEN 'validation' ELSE 'test' END AS split FROM p JOIN r ON r.domain = p.domain AND r.k = p.component JOIN s ON s.domain = p.domain""",
}
