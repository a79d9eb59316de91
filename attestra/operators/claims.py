"""Quantitative claims in reports, and their comparison with evidence.

The core grammar (metric, separator, number, percent sign) is native.  extract() adds
exponents, units, further prose layers, Markdown and HTML tables and tab-separated lines, in
an Arrow-batched function, behind a native test for digits.  The README names the layers
that are missing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions import names as N

CLAIM = "line int, metric string, value double, raw_text string, context map<string,string>"
_SEPARATOR = r"(?:\s*[:=]\s*|\s+(?:is|was|of|at|reached|составила|составил)\s+(?:of\s+)?|\s+)"
_NUMBER = r"([-−]?\d+(?:[.,]\d+)*)\s*(%)?"
CORE = rf"(?i)\b({N.PATTERN}){_SEPARATOR}{_NUMBER}"
#: CORE with the names as a tree, and the same for a match of it: there the name is at the start, so no other is.
_SEARCH = rf"(?i)\b({N.TREE}){_SEPARATOR}{_NUMBER}"
_CLAIM = rf"(?i)^({N.TREE}){_SEPARATOR}{_NUMBER}"


def parse_number(raw: Column) -> Column:
    """1,234 as 1234 where commas group thousands, else a comma as the decimal sign."""
    plain = F.replace(raw, F.lit("−"), F.lit("-"))
    grouped = plain.rlike(r"^-?[1-9]\d{0,2}(,\d{3})+(\.\d+)?$")
    return F.when(grouped, F.replace(plain, F.lit(","), F.lit(""))).otherwise(F.replace(plain, F.lit(","), F.lit("."))).try_cast("double")


def normalize_value(metric: Column, value: Column, percent: Column) -> Column:
    """Percentages, and values of unit-interval metrics between 1 and 100, as shares."""
    return F.when(percent | (N.is_unit_interval(metric) & (F.abs(value) > 1.0) & (F.abs(value) <= 100.0)), value / 100.0).otherwise(value)


def duration_seconds(value: Column, unit: Column) -> Column:
    u = F.lower(unit)
    return F.when(u == "ns", value / 1e9).when(u.isin("us", "µs", "μs"), value / 1e6).when(u.isin("ms", "msec"), value / 1e3).when(u.isin("min", "minutes"), value * 60.0).when(u.isin("h", "hours"), value * 3600.0).otherwise(value)


def memory_mb(value: Column, unit: Column) -> Column:
    u = F.lower(unit)
    return F.when(u.isin("kb", "kib"), value / 1024.0).when(u.isin("gb", "gib"), value * 1024.0).otherwise(value)


def core_claims(reports: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, position, metric, value) by the core grammar, line by line; native.

    A line is searched once, and each of its claims is taken apart by one further match.
    """
    lines = spread(reports.select(key, text), key).filter(F.col(text).rlike(r"\d")).select(key, F.posexplode(F.split(text, "\n")).alias("line", "body")).filter(F.col("body").rlike(r"\d"))
    each = lines.select(key, "line", F.posexplode(F.regexp_extract_all("body", F.lit(_SEARCH), 0)).alias("position", "claim"))
    part = F.split(F.regexp_replace("claim", _CLAIM, "$1\u0001$2\u0001$3"), "\u0001")  # a claim is names, spaces, signs and digits
    each = each.select(key, "line", "position", part.alias("part"))
    metric = N.canonical_column(F.col("part")[0])
    value = normalize_value(metric, parse_number(F.col("part")[1]), F.col("part")[2] == "%")
    return each.select(key, (F.col("line") + 1).alias("line"), "position", metric.alias("metric"), value.alias("value"))


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows by key over all cores: a few MB of reports are one split of a file, and yet minutes of work."""
    s = rows.sparkSession
    return rows.repartition(max(4 * s.sparkContext.defaultParallelism, int(s.conf.get("spark.sql.shuffle.partitions"))), key)


class _Tables(HTMLParser):
    """Rows of cells of all tables, with their lines."""

    def __init__(self):
        super().__init__()
        self.rows: list[tuple[int, list[str]]] = []
        self._cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append((self.getpos()[0], []))
        elif tag in ("td", "th") and self.rows:
            self._cell = []

    def handle_data(self, data):
        if self._cell is not None:
            self._cell.append(data)

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self._cell is not None:
            self.rows[-1][1].append(" ".join("".join(self._cell).split()))
            self._cell = None


_DIGIT = re.compile(r"\d")
_DIGITS = r"[-−]?\d+(?:[.,]\d+)*(?:e[-+−]?\d+)?"
_TIME = r"nanoseconds?|ns|microseconds?|us|µs|μs|milliseconds?|msec|ms|seconds?|secs?|s|minutes?|mins?|hours?|h"
_DURATIONS = {"n": 1e-9, "u": 1e-6, "µ": 1e-6, "μ": 1e-6, "mic": 1e-6, "ms": 1e-3, "mil": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}
_MEMORY = {"kb": 1 / 1024, "kib": 1 / 1024, "mb": 1.0, "mib": 1.0, "gb": 1024.0, "gib": 1024.0}
_COUNT = r"(?<![\w.,])([1-9]\d{0,2}(?:,\d{3})+|[1-9]\d*)"
_PROSE = re.compile(rf"(?i)\b({N.TREE}){_SEPARATOR}({_DIGITS})\s*(?:(%)|({_TIME}|[kmg]i?b)\b)?")
_CELL = re.compile(rf"^\s*[*_`]*({_DIGITS})\s*(%)?\s*({_TIME}|kb|mb|gb)?\s*[*_`]*(?:\s*(?:±|\+/-).*)?$", re.I)
_COCO = re.compile(rf"(?i)Average\s+(Precision|Recall)\s+\((?:AP|AR)\)\s+@\[\s*IoU=([0-9.:]+)\s*\|\s*area=\s*(\w+)\s*\|[^]]*\]\s*=\s*({_DIGITS})")
_DURATION = re.compile(rf"(?i)(?:processing\s+time\s*[:=]|complet(?:e|ed|ing)(?:\s+the\s+(?:test|run))?\s+in)\s*({_DIGITS})\s*({_TIME}|m)\b")
_SPEEDUP = re.compile(rf"(?i)({_DIGITS})\s*(?:[x×]\s+faster\b|(%)?\s+speedup\b)")
_SPEEDUP_RANGE = re.compile(rf"(?i)\bbeats?\b[^\n]*?\bby\s+({_DIGITS})\s*[–—-]\s*({_DIGITS})\s*%")
_MEMORY_CHANGE = re.compile(rf"(?i)\b(?:cuts?|reduces?)\s+(?:resident\s+)?memory\b[^\n]*?\bto\s+(?:about|around|~)?\s*({_DIGITS})\s*(kb|mb|gb)\b[^\n]*?\bfrom\s+(?:about|around|~)?\s*({_DIGITS})\s*(kb|mb|gb)\b")
_VRAM = re.compile(rf"(?i)(?:peak(?:\s+(?:GPU|device))?\s+(?:memory|VRAM)|peak\s+of)\D{{0,24}}?({_DIGITS})\s*(kb|mb|gb)\s+(?:GPU\s+)?VRAM\b")
_TESTS = re.compile(rf"{_COUNT}\s+(?:(Python|TypeScript)(?:\s+[Tt]ests)?|(?:(?:passing|successful)\s+)?(?:unit\s+)?[Tt]ests)\b")
_PASSED = re.compile(rf"(?i){_COUNT}\s+passed\b[^\n]{{0,40}}\b(?:skipped|failed)\b")
_RANKED = re.compile(rf"(?i)(?<!\w)(map|mar|mrr|mndcg|ndcg|precision|recall)\s*@\s*([1-9]\d*)(?:\s*(?:=|:)\s*|\s+)({_DIGITS})\s*(%)?")


def _seconds(unit: str) -> float:
    u = unit.lower()
    return _DURATIONS.get(u[:3]) or _DURATIONS.get(u[:2]) or _DURATIONS[u[0]]


def number(raw: str) -> float:
    raw, e, power = raw.replace("−", "-").lower().partition("e")
    if e:
        return float(f"{number(raw)!r}e{power}")
    if re.fullmatch(r"-?[1-9]\d{0,2}(,\d{3})+(\.\d+)?", raw):
        return float(raw.replace(",", ""))
    raw = raw.replace(",", ".")
    return float(raw) if raw.count(".") <= 1 else float("nan")


def _share(metric: str, value: float, percent: bool) -> float:
    return value / 100 if percent or (metric in N.UNIT_INTERVAL and 1 < abs(value) <= 100) else value


def _cell(metric: str, cell: str) -> float | None:
    m = _CELL.match(cell)
    if not m:
        return None
    value = number(m[1])
    if m[3] and m[3].lower() not in _MEMORY and metric.endswith("_seconds"):
        value *= _seconds(m[3])
    return _share(metric, value, bool(m[2]))


def _table(header: list[str], rows: list[tuple[int, list[str], str]]) -> Iterator[tuple]:
    """Claims of a table: metrics in the header, or in the first column if the header has none."""
    metrics = [N.family(re.sub(r"[*_`]|\([^)]*\)", "", h)) for h in header]
    for line, cells, raw in rows:
        if any(metrics[1:]) or (metrics and metrics[0]):
            context = {h.strip(): c.strip()[:200] for h, m, c in zip(header, metrics, cells) if m is None and c.strip() and h.strip()}
            found = [(m, c, context) for m, c in zip(metrics, cells) if m]
        else:
            m = N.family(re.sub(r"[*_`]", "", cells[0])) if cells else None
            found = [(m, c, {"system": h.strip()}) for h, c in zip(header[1:], cells[1:])] if m else []
        for m, c, context in found:
            value = _cell(m, c)
            if value is not None and value == value:
                yield line, m, value, raw, context


def _split(line: str) -> list[str] | None:
    if "|" not in line:
        return None
    cells = [c.strip() for c in re.split(r"(?<!\\)\|", line.strip().strip("|"))]
    return cells if len(cells) >= 2 else None


def _prose(body: str) -> Iterator[tuple[str, float, dict]]:
    """(metric, value, context) of a line outside tables.  All forms have a digit; one is looked for where some word of it is there."""
    if not _DIGIT.search(body):
        return
    low = body.lower()
    all_ = not body.isascii()  # some other letters count as small ones of the words
    may = lambda *words: all_ or any(w in low for w in words)
    if may("average") and (m := _COCO.search(body)):
        if m[3].lower() == "all":
            yield ("ar" if m[1].lower() == "recall" else {"0.50:0.95": "map50_95", "0.50": "map50", "0.75": "map75"}.get(m[2], "ap")), number(m[4]), {}
        return
    for m in _DURATION.finditer(body) if may("processing", "complet") else ():
        yield "runtime_seconds", number(m[1]) * _seconds(m[2]), {}
    for m in _SPEEDUP.finditer(body) if may("faster", "speedup") else ():
        yield "speedup", number(m[1]) / (100 if m[2] else 1), {}
    for m in _SPEEDUP_RANGE.finditer(body) if may("beat") else ():
        yield "speedup_range_low", number(m[1].lstrip("-−")) / 100, {}
        yield "speedup_range_high", number(m[2].lstrip("-−")) / 100, {}
    for m in _MEMORY_CHANGE.finditer(body) if may("memory") else ():
        yield "memory_mb", number(m[1]) * _MEMORY[m[2].lower()], {"state": "after"}
        yield "memory_mb", number(m[3]) * _MEMORY[m[4].lower()], {"state": "before"}
    for m in _VRAM.finditer(body) if may("vram") else ():
        yield "memory_mb", number(m[1]) * _MEMORY[m[2].lower()], {}
    for m in _TESTS.finditer(body) if may("python", "typescript", "tests") else ():
        yield "test_count", number(m[1]), {"scope": m[2] or "total"}
    for m in _PASSED.finditer(body) if may("passed") else ():
        yield "test_count", number(m[1]), {"scope": "total"}
    for m in _RANKED.finditer(body) if may("@") else ():
        value = number(m[3])
        yield f"{m[1].lower()}_{m[2]}", value / 100 if m[4] or 1 < abs(value) <= 100 else value, {}
    for m in _PROSE.finditer(body):
        metric = N.canonical(m[1])
        value, unit = number(m[2]), (m[4] or "").lower()
        if unit in _MEMORY:
            value *= _MEMORY[unit] if metric.endswith("_mb") else 1
        elif unit and metric.endswith("_seconds"):
            value *= _seconds(unit)
        yield metric, _share(metric, value, bool(m[3])), {}


def claims(text: str) -> list[tuple]:
    """(line, metric, value, raw_text, context) of all layers, by line."""
    out: list[tuple] = []
    html = "<" in text
    masked = re.sub(r"(?is)<table\b.*?</table>", lambda m: "\n" * m[0].count("\n"), text) if html else text
    for m in re.finditer(r"(?is)<table\b.*?</table>", text) if html else ():
        start = text.count("\n", 0, m.start())
        parser = _Tables()
        parser.feed(m[0])
        rows = [(start + n, cells) for n, cells in parser.rows if cells]
        if len(rows) > 1:
            out += _table(rows[0][1], [(n, c, " | ".join(c)) for n, c in rows[1:]])
    lines = masked.split("\n")
    used: set[int] = set()
    i = 0
    while i + 1 < len(lines):
        header, rule = _split(lines[i]), _split(lines[i + 1])
        if header and rule and len(header) == len(rule) and all(re.fullmatch(r":?-{2,}:?", c) for c in rule):
            used |= {i, i + 1}
            j = i + 2
            rows = []
            while j < len(lines) and (cells := _split(lines[j])):
                used.add(j)
                if len(cells) == len(header):
                    rows.append((j + 1, cells, lines[j].strip()))
                j += 1
            out += _table(header, rows)
            i = j
        else:
            i += 1
    i = 0
    while i < len(lines):
        header = lines[i].split("\t")
        if i in used or len(header) < 2 or not any(N.family(h) for h in header):
            i += 1
            continue
        j = i + 1
        while j < len(lines) and j not in used and len(cells := lines[j].split("\t")) == len(header):
            if any(N.family(h) and N.family(c) and not re.search(r"\d", c.split()[-1]) for h, c in zip(header, cells)):
                break  # the header of another table
            j += 1
        found = list(_table(header, [(k + 1, lines[k].split("\t"), lines[k]) for k in range(i + 1, j)]))
        if found:
            used |= set(range(i, j))
            out += found
        i = j if found else i + 1
    seen = set()
    for k, body in enumerate(lines):
        if k in used:
            continue
        for metric, value, context in _prose(body):
            if value == value and (k, metric, value) not in seen:
                seen.add((k, metric, value))
                out.append((k + 1, metric, value, body.strip(), context))
    return sorted(out, key=lambda c: c[0])


def extract(reports: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, metric, value, raw_text, context) of every claim of every report."""
    kind = reports.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, *c) for k, t in zip(b[key], b[text]) for c in claims(t)]
            yield pd.DataFrame(rows, columns=[key, "line", "metric", "value", "raw_text", "context"])

    return spread(reports.select(key, text), key).filter(F.col(text).rlike(r"\d")).mapInPandas(run, f"{key} {kind}, {CLAIM}")


def contexts_compatible(a: Column, b: Column) -> Column:
    """No shared key, or all shared keys have the same value but for case and space."""
    shared = F.array_intersect(F.map_keys(a), F.map_keys(b))
    return F.forall(shared, lambda k: F.lower(F.trim(F.try_element_at(a, k))) == F.lower(F.trim(F.try_element_at(b, k))))


def check(claimed: DataFrame, evidence: DataFrame, key: str, tolerance: float = 0.005) -> DataFrame:
    """Every claim with its evidence on (key, metric): status, observed, difference, tolerance, evidence_level, display_kind.

    verified against recomputed evidence, supported against reported, mismatch where they
    differ by over the tolerance, no_evidence without a metric or with a context that
    conflicts.  The difference has no sign.
    """
    e = evidence.select(F.col(key).alias("__k"), F.col("metric").alias("__m"), F.col("value").alias("observed"), "evidence_level", F.col("context").alias("__c"))
    j = claimed.join(e, (F.col(key) == F.col("__k")) & (F.col("metric") == F.col("__m")), "left")
    some = F.coalesce(F.col("__m").isNotNull() & contexts_compatible(F.col("context"), F.col("__c")), F.lit(False))
    difference = F.abs(F.col("value") - F.col("observed"))
    status = F.when(~some, "no_evidence").when(~(difference <= tolerance), "mismatch").when(F.col("evidence_level") == "recomputed", "verified").otherwise("supported")
    only = lambda c: F.when(some, c)
    kind = F.when(N.is_unit_interval(F.col("metric")), "percentage").otherwise("scalar")
    return j.select(*claimed.columns, status.alias("status"), only(F.col("observed")).alias("observed"), only(difference).alias("difference"), F.lit(tolerance).alias("tolerance"), only(F.col("evidence_level")).alias("evidence_level"), kind.alias("display_kind"))
