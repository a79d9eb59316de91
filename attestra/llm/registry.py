"""The queries and SQL of this package, for the entry module."""

from __future__ import annotations

from attestra.llm import fingerprints, language, media, mixing, near_dedup, packing, quality, sharding, substrings, tokens

MODULES = (fingerprints, sharding, near_dedup, packing, language, tokens, substrings, mixing, media, quality)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: q for m in MODULES for k, q in m.ORACLE.items()}
