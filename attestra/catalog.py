"""All registered queries outside the corpus operators, with their SQL."""

from __future__ import annotations

from attestra.plans import audit, claims, detection, features, leakage, metrics, study

MODULES = (leakage, metrics, detection, study, claims, audit, features)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: q for m in MODULES for k, q in m.ORACLE.items()}
