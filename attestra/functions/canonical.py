"""Canonical JSON and its digest: sorted keys, no spaces, finite numbers only."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def canonical_json(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def digest(payload: dict, blank: str | None = None, without: tuple[str, ...] = ()) -> str:
    """SHA-256 of the payload with one field blank and some left out."""
    kept = {k: ("" if k == blank else v) for k, v in payload.items() if k not in without}
    return hashlib.sha256(canonical_json(kept).encode()).hexdigest()


@F.pandas_udf(StringType())
def canonical_digest(documents: pd.Series) -> pd.Series:
    """The digest of each JSON object; keys may come in any order."""
    return documents.map(lambda t: digest(json.loads(t)), na_action="ignore")
