"""Text normalisation, tokens, n-grams and similarity as column expressions.

Normalisation needs NFKC and full case folding, which Spark lacks, so it is an Arrow
function, of one text at a time; all that follows from a normalised text is native.
"""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

METHODS = ("token_jaccard_v1", "hybrid_lexical_v1", "ordered_tokens_v1")
NUMBER = r"[-+−]?\d[\d,]*(?:\.\d+)?%?"


def normalized(value: str | None) -> str | None:
    """Compatibility form, case folded, white space collapsed and trimmed."""
    return None if value is None else " ".join(unicodedata.normalize("NFKC", value).casefold().split())


@F.arrow_udf(StringType())
def normalize_text(values: pa.Array) -> pa.Array:
    return pa.array((normalized(x.as_py()) for x in values), pa.string())


def ordered_tokens(normal: Column) -> Column:
    """Word tokens of a normalised text, in order."""
    return F.regexp_extract_all(normal, F.lit(r"(?U)(\w+)"), 1)


def tokens(normal: Column) -> Column:
    return F.array_distinct(ordered_tokens(normal))


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body and its lambdas name it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _runs(text: Column, size: int, prefix: str = "") -> Column:
    """All runs of ``size`` characters.  Cut from an array of characters: substring() looks for its place from the start of the text each time."""

    def runs(c: Column) -> Column:
        one = lambda i: F.concat(*([F.lit(prefix)] if prefix else []), *[F.get(c, i + k) for k in range(size)])
        return F.when(F.size(c) >= size, F.transform(F.sequence(F.lit(0), F.size(c) - size), one)).otherwise(F.array().cast("array<string>"))

    return _let(F.regexp_extract_all(text, F.lit(r"(?s)(.)"), 1), runs)


def character_ngrams(normal: Column, size: int = 3) -> Column:
    """Distinct n-grams of the padded text with signs read as spaces; none for texts shorter than ``size``."""
    words = F.trim(F.regexp_replace(F.regexp_replace(normal, r"(?U)[^\w\s]+", " "), r"(?U)\s+", " "))

    def grams(w: Column) -> Column:
        return F.when(F.length(w) >= size, F.array_distinct(_runs(F.concat(F.lit(" "), w, F.lit(" ")), size))).otherwise(F.array().cast("array<string>"))

    return _let(words, grams)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 where both are empty."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either > 0, both / either).otherwise(0.0)


def dice(a: Column, b: Column) -> Column:
    total = F.size(a) + F.size(b)
    return F.when(total > 0, 2.0 * F.size(F.array_intersect(a, b)) / total).otherwise(0.0)


def jaccard_bound(a: Column, b: Column) -> Column:
    """What the Jaccard similarity of sets of these sizes can't exceed."""
    return F.when((a > 0) | (b > 0), F.least(a, b) / F.greatest(a, b)).otherwise(0.0)


def dice_bound(a: Column, b: Column) -> Column:
    return F.when(a + b > 0, 2.0 * F.least(a, b) / (a + b)).otherwise(0.0)


@F.pandas_udf(DoubleType())
def ordered_similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    """Matching-block ratio of two token lists; not symmetric."""
    return pd.Series([SequenceMatcher(None, list(a), list(b), autojunk=False).ratio() for a, b in zip(left, right, strict=True)])


def occurrences(sequence: Column) -> Column:
    """Tokens with their running number, so that a multiset is a set: the k-th a is a, k."""
    numbered = lambda t: F.transform(F.sequence(F.lit(1), t["n"].cast("int")), lambda k: F.concat_ws("\x01", t["feature"], k))
    return F.coalesce(F.flatten(F.transform(tally(sequence), numbered)), F.array().cast("array<string>"))


def fingerprint(columns: list[str]) -> Column:
    """SHA-256 of the compact JSON array of the values."""
    return F.sha2(F.to_json(F.array(*[F.col(f"`{c}`").cast("string") for c in columns])), 256)


def normalize_ml(normal: Column) -> Column:
    """A normalised text with the minus sign plain and each number read as <num>."""
    plain = F.regexp_replace(normal, "−", "-")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"(?U)(?<![\w.])[-+]?\d+(?:[.,]\d+)*%?", "<num>"), r"(?U)\s+", " "))


def ml_words(normal: Column) -> Column:
    """Words of a text of normalize_ml(), <num> as one."""
    return F.regexp_extract_all(normal, F.lit(r"(?U)(<num>|\w+)"), 1)


def tally(values: Column) -> Column:
    """Array of (feature, n), each distinct value once, by sorting within the row."""

    def ends(s: Column) -> Column:
        last = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == F.size(s)) | (F.get(s, i) != F.get(s, i - 1)))
        each = _let(last, lambda e: F.transform(e, lambda i, k: F.struct(F.get(s, i - 1).alias("feature"), (i - F.coalesce(F.get(e, k - 1), F.lit(0))).cast("bigint").alias("n"))))
        return F.when(F.size(s) > 0, each)

    return _let(F.sort_array(values), ends)


def lexical_overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of the white-space tokens longer than one character, small letters."""
    long = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda x: F.length(x) > 1))
    return jaccard(long(a), long(b))


def numbers(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"(\d+(?:[.,]\d+)?)"), 1))


def numeric_consistency(a: Column, b: Column) -> Column:
    """Share of a's numbers that b has; 1 where a has none."""
    return F.when(F.size(numbers(a)) > 0, F.size(F.array_intersect(numbers(a), numbers(b))) / F.size(numbers(a))).otherwise(1.0)
