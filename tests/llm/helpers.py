"""Small documents with every awkward case, and the comparison of a query with its SQL."""

from __future__ import annotations

import random
import re

import duckdb

SPACE = re.compile(r"[ \t\n\x0b\f\r]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use inside, and names that differ from the documents' own only by their use.
CLASHES = {"key": "int", "group_id": "int", "bands": "string", "copy": "int", "ver": "int", "start": "string", "keep": "string", "rate": "double", "cell": "int", "h1": "int", "gone": "int", "language": "int", "id": "int", "spans": "int", "md5": "int", "new": "string", "rate_": "int", "source_": "int", "salt": "int", "times": "int", "number": "int", "n": "int", "_gone": "string", "__n": "int", "__spans": "int", "__new": "int", "__language": "int", "__gone": "int", "__mix_times": "int"}


def words(text: str | None) -> list[str]:
    return [w for w in SPACE.split(text or "") if w]


def prose(seed: int, n: int, vocabulary: int = 4000) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary):x}" for _ in range(n))


def documents(spark, rows):
    """rows: (doc_id, text[, lang, source])."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1]) if r[1] is not None else None) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(None).cast(t).alias(c) for c, t in CLASHES.items()])


def awkward(spark):
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows."""
    long_text = prose(1, 60_000)
    return spark.createDataFrame(
        [
            (None, "no id here", "en", "a", 1),
            (1, None, "en", "a", None),
            (2, "", None, None, 0),
            (3, " \n\t ", "en", "a", 4),
            (4, long_text, "en", "b", len(long_text)),
            (5, long_text, "en", "b", len(long_text)),
            (6, "one", "en", "b", 3),
            (7, "one", "en", "b", 3),
            (8, prose(2, 120), None, "b", 1),
            (8, prose(2, 120), None, "b", 1),
            (8, prose(3, 120), "en", None, 1),
            (9, "straße 漢字 🎵 é", "de", "c", 12),
            (None, None, None, None, None),
        ],
        SCHEMA,
    )


def rows(df, *columns):
    got = [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
    return sorted(got, key=lambda r: tuple((x is not None, str(type(x)), x) if not isinstance(x, (list, dict)) else (True, "", str(x)) for x in r))


def oracle(sql: str, **tables):
    """Rows of DuckDB SQL over the given Spark data frames, and its columns in order."""
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    return con.sql(sql)


def same_as_sql(df, sql: str, **tables):
    found = oracle(sql, **tables)
    columns = found.columns
    assert sorted(columns) == sorted(df.columns)
    got = rows(df.select(*columns))
    want = sorted([tuple(r) for r in found.fetchall()], key=lambda r: tuple((x is not None, str(type(x)), x) for x in r))
    assert got == want
    return got
