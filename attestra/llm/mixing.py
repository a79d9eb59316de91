"""Mixing sources to target weights.

Tokens are summed per source; a source's repetition rate is what its target
share of the budget asks for, over what it has.  A document is emitted floor(rate)
times, and once more if its seeded hash falls below the fraction that is left.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm.kernels import WORD_CLASS
from attestra.llm.tables import documents_only, free_name, kept, table
from attestra.llm.tokens import token_length

ALPHA = 0.5
SEED = 11
#: Up to so many sources, their rates are broadcast; beyond, they are joined by a salted shuffle.
BROADCAST_SOURCES = 20_000
SALTS = 64


def repetition_rates(docs: DataFrame, weights: Mapping[str | None, float] | None = None, alpha: float = ALPHA, budget: float | None = None, measure: Callable[[Column], Column] = token_length, source: str = "source", text: str = "text") -> DataFrame:
    """(source, tokens, rate) of each source.

    ``weights`` are target weights by source, in any scale; without them a source weighs
    tokens ** alpha.  ``budget`` is the number of tokens wanted, as many as there are by
    default.  ``measure`` tells how many tokens a text has; by default those of token_counts().

    Defined cases: a null source is a source like any other; a source that ``weights``
    doesn't name has the rate 0; a source without tokens takes no share and has the rate 1
    if its weight isn't 0, else 0; an empty table has no sources.
    """
    spark = docs.sparkSession
    if weights is not None and any(w < 0 for w in weights.values()):
        raise ValueError("a target weight is negative")
    tokens = documents_only(docs, source, text).groupBy(F.col(f"`{source}`").cast("string").alias("source")).agg(F.sum(measure(F.col(f"`{text}`").cast("string"))).alias("tokens"))
    if weights is None:
        tokens = tokens.withColumn("weight", F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(float(alpha)))).otherwise(1.0))
    elif weights:
        given = spark.createDataFrame([(k, float(w)) for k, w in weights.items()], "name string, weight double")
        tokens = tokens.join(given, F.col("source").eqNullSafe(F.col("name")), "left").select("source", "tokens", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    else:
        tokens = tokens.withColumn("weight", F.lit(0.0))
    tokens = kept(tokens, "sources")
    full = tokens.filter("tokens > 0").agg(F.sum("weight").alias("w"), F.sum("tokens").alias("t")).first()
    wanted = float(budget if budget is not None else full["t"] or 0)
    share = wanted / full["w"] if full["w"] else 0.0
    rate = F.when(F.col("tokens") > 0, F.col("weight") * F.lit(share) / F.col("tokens")).otherwise((F.col("weight") > 0).cast("double"))
    return tokens.select("source", "tokens", rate.alias("rate"))


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, alpha: float = ALPHA, budget: float | None = None, seed: int = SEED, measure: Callable[[Column], Column] = token_length, source: str = "source", text: str = "text", doc_id: str = "doc_id", copy: str | None = "copy") -> DataFrame:
    """Each row of docs as often as its source's rate says, with all its columns, and its number from 1 on in the column ``copy``.

    The text is never shuffled unless there are over BROADCAST_SOURCES sources.

    Defined cases, besides those of repetition_rates(): rows with a null doc_id share one
    draw; rows that repeat a doc_id have the same draw and are emitted each for itself;
    null and empty texts count no tokens and are emitted at their source's rate; a column
    of docs that is called like ``copy`` is replaced; an empty table gives no rows.
    """
    rates = repetition_rates(docs, weights, alpha, budget, measure, source, text)
    named_source, named_rate, salt, times, number = (free_name(c, docs) for c in ("source_", "rate", "salt", "times", "number"))
    named = rates.select(F.col("source").alias(named_source), F.col("rate").alias(named_rate))
    same = F.col(f"`{source}`").cast("string").eqNullSafe(F.col(f"`{named_source}`"))
    if rates.count() <= BROADCAST_SOURCES:
        joined = docs.join(F.broadcast(named), same)
    else:
        salted = docs.withColumn(salt, F.pmod(F.xxhash64(F.col(f"`{doc_id}`"), F.col(f"`{text}`")), F.lit(SALTS)))
        named = named.withColumn(f"_{salt}", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.join(named, same & (F.col(f"`{salt}`") == F.col(f"`_{salt}`")))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    rate = F.col(f"`{named_rate}`")
    out = joined.withColumn(times, (F.floor(rate) + (draw < rate - F.floor(rate)).cast("bigint")).cast("int")).filter(F.col(f"`{times}`") > 0)
    out = out.withColumn(number, F.explode(F.sequence(F.lit(1), F.col(f"`{times}`"))))
    if copy is None:
        return out.select(*[F.col(f"`{c}`") for c in docs.columns])
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != copy.lower()], F.col(f"`{number}`").alias(copy))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


#: mix() by words, for which ``measure`` is word_count: SQL has no tokenizer.
BY_WORDS = f"""
WITH d AS (SELECT *, len(regexp_extract_all(text, '{WORD_CLASS}')) AS words FROM documents),
s AS (SELECT source, sum(words)::DOUBLE AS tokens FROM d GROUP BY source),
t AS (SELECT sum(sqrt(tokens)) AS w, sum(tokens) AS t FROM s WHERE tokens > 0),
r AS (SELECT source, CASE WHEN tokens > 0 THEN sqrt(tokens) * (t.t / t.w) / tokens ELSE 1 END AS rate FROM s, t),
n AS (SELECT d.*, (floor(rate) + (('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT / 281474976710656.0 < rate - floor(rate))::INT)::BIGINT AS times
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, text, lang, source, n_chars, unnest(range(1, times + 1))::INT AS copy FROM n WHERE times > 0
"""

QUERIES = {"op8_mixing": op8_mixing}
ORACLE: dict[str, str] = {}
