"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Features are hashed n-grams of small letters, weighted by their relative frequency in the
text and by an idf counted over all documents.  Weights are learnt by follow-the-
regularised-leader with elastic-net penalties, which leaves most of them zero, and
probabilities are calibrated by a temperature.  There is no bias, so a text without known
n-grams has even odds and is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm.kernels import byte_slices, mix64
from attestra.llm.tables import documents_only, free_name, table

ORDERS = (1, 2, 3)
BITS = 16
#: At most so many labelled rows of each language, and so many in all, are used for training: those with the least hashes of doc_id and text.
SAMPLE, SAMPLE_ALL = 1500, 30_000
MIN_CONFIDENCE = 0.5
_SLICE_BYTES = 1 << 18
_SCALE = 100.0


def grams(texts: pa.Array, orders: tuple[int, ...] = ORDERS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Features of all n-grams of all texts, and the text that each is from; only n-grams with a letter in them count.

    Runs of other characters than letters are read as one space, and a text has one before and after it.
    """
    texts = pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string()))
    around = pa.scalar("\n", pa.large_string())
    texts = pc.binary_join_element_wise(around, texts, around, pa.scalar("", pa.large_string()))
    n = len(texts)
    points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.zeros(n + 1, np.int64)
    np.cumsum(pc.utf8_length(texts).to_numpy(), out=first[1:])
    # letters: small ASCII ones and whatever lies beyond the Latin signs
    letter = ((points >= 97) & (points <= 122)) | ((points >= 0xC0) & (points != 0xD7) & (points != 0xF7) & ~((points >= 0x2000) & (points < 0x2C00)))
    doc = np.repeat(np.arange(n), np.diff(first))
    code = np.where(letter, points, 32)
    keep = letter.copy()
    keep[1:] |= letter[:-1] | (doc[1:] != doc[:-1])
    if len(keep):
        keep[0] = True
    code, doc, letter = code[keep].astype(np.uint64), doc[keep], letter[keep]
    out, owner = [], []
    for k in orders:
        m = len(code) - k + 1
        if m <= 0:
            continue
        h = np.full(m, np.uint64(k))
        solid = np.zeros(m, bool)
        for j in range(k):
            h = h * np.uint64(0x100000001B3) + code[j : j + m]
            solid |= letter[j : j + m]
        ok = solid & (doc[:m] == doc[k - 1 :])
        out.append((mix64(h[ok]) >> np.uint64(64 - bits)).astype(np.int64))
        owner.append(doc[:m][ok])
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(owner)


def _frequencies(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, count) of the distinct pairs, in order."""
    f, d = grams(texts, bits=bits)
    key, count = np.unique(d << bits | f, return_counts=True)
    return key >> bits, key & ((1 << bits) - 1), count


def document_frequencies(docs: DataFrame, text: str = "text", bits: int = BITS) -> tuple[np.ndarray, int]:
    """In how many documents of the whole table each feature occurs, and the number of documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << bits, np.int64), 0
        for part in byte_slices(batches, "text", _SLICE_BYTES):
            f, d = grams(part.column(0), bits=bits)
            n += part.num_rows
            step = 64  # documents that share one table of what occurs
            by = np.argsort(d, kind="stable")
            f, d = f[by], d[by]
            for s in range(0, part.num_rows, step):
                a, b = np.searchsorted(d, [s, s + step])
                seen = np.zeros((step, 1 << bits), bool)
                seen[d[a:b] - s, f[a:b]] = True
                total += np.add.reduce(seen.view(np.uint8), axis=0, dtype=np.uint8)  # at most 64
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, there]), pa.array(np.r_[n, total[there]])], ["feature", "n"])

    src = documents_only(docs, text).select(F.col(f"`{text}`").cast("string").alias("text"))
    # at most 2**bits rows
    rows = src.mapInArrow(run, "feature bigint, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(1 << bits, np.int64)
    real = rows[rows["feature"] >= 0]
    df[real["feature"].to_numpy()] = real["n"].to_numpy()
    return df, int(rows.loc[rows["feature"] < 0, "n"].sum())


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # features x languages, the idf included
    temperature: float
    bits: int = BITS

    def logits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Uncalibrated logits of each text, and its number of n-grams."""
        f, d = grams(texts, bits=self.bits)
        n = np.bincount(d, minlength=len(texts))
        z = np.stack([np.bincount(d, self.weights[f, c], minlength=len(texts)) for c in range(len(self.languages))], axis=1)
        return z * (_SCALE / np.maximum(n, 1))[:, None], n

    def probabilities(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        z, n = self.logits(texts)
        return softmax(z / self.temperature), n


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, features: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.3, l2: float = 0.5, epochs: int = 3, seed: int = 5) -> np.ndarray:
    """Weights (features x classes) by FTRL-proximal, one example at a time, each class with its own rates."""
    z = np.zeros((features, classes))
    n = np.zeros((features, classes))
    order = np.random.default_rng(seed)
    weigh = lambda zz, nn: np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(nn)) / alpha + l2))
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            f, x = rows[i]
            if not len(f):
                continue
            zz, nn = z[f], n[f]
            w = weigh(zz, nn)
            p = softmax((x @ w)[None, :])[0]
            p[labels[i]] -= 1.0
            g = x[:, None] * p[None, :]
            more = nn + g * g
            z[f] = zz + g - (np.sqrt(more) - np.sqrt(nn)) / alpha * w
            n[f] = more
    return weigh(z, n)


def temperature(z: np.ndarray, labels: np.ndarray) -> float:
    """The temperature in [0.05, 20] that makes held-out labels likeliest; by golden section in its logarithm."""
    if not len(z):
        return 1.0

    def loss(t: float) -> float:
        s = z / np.exp(t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(labels)), labels]).mean())

    a, b, r = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = b - r * (b - a), a + r * (b - a)
        if loss(c) <= loss(d):
            b = d
        else:
            a = c
    return float(np.exp((a + b) / 2))


def train(docs: DataFrame, sample: int = SAMPLE, sample_all: int = SAMPLE_ALL, bits: int = BITS, doc_id: str = "doc_id", text: str = "text", label: str = "lang") -> Model:
    """A model of the languages in ``label``.

    The idf is counted over all documents.  Weights and temperature are fitted on at most
    ``sample`` labelled rows of each language, and about ``sample_all`` in all, shared evenly
    (a fifth of them, held out, for the temperature): those with the least hashes of doc_id
    and text, whole texts.  Equal rows count once.  Rows with a null label or doc_id, or
    without letters, are not used; a table without usable rows gives a model of no languages.
    """
    df, total = document_frequencies(docs, text, bits)
    idf = np.log((1.0 + total) / (1.0 + df))
    id_, body = F.col(f"`{doc_id}`"), F.col(f"`{text}`").cast("string")
    src = documents_only(docs, *dict.fromkeys([doc_id, text, label])).filter(id_.isNotNull() & F.col(f"`{label}`").isNotNull())
    src = src.select(F.xxhash64(id_, body).alias("h"), id_.cast("string").alias("i"), F.col(f"`{label}`").cast("string").alias("label"), body.alias("text"))
    counts = {r["label"]: r["count"] for r in src.groupBy("label").count().collect()}
    languages = sorted(counts)
    sample = max(1, min(sample, sample_all // max(1, len(languages))))
    # hashes are even, so a cut at 1.1 of the share and a rank among those below it take the least `sample`
    share = F.lit(None).cast("double")
    for name in languages:
        share = F.when(F.col("label") == name, min(1.0, (1.1 * sample + 200) / counts[name])).otherwise(share)
    below = (F.col("h").cast("double") / F.lit(2.0**64) + 0.5) <= share
    # rows that are equal have one hash, all below the cut or none: they count once
    chosen = src.filter(below).dropDuplicates(["h", "i", "label"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, "text", _SLICE_BYTES):
            d, f, c = _frequencies(part.column(3), bits)
            at = np.searchsorted(d, np.arange(part.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(v.astype(np.int32))) for v in (f, c)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), *lists], ["h", "i", "label", "features", "counts"])

    rows, labels, seen = [], [], dict.fromkeys(languages, 0)
    if languages:
        # at most languages x (1.1 x sample + 200) rows, give or take chance, of 2**bits features each at most; as flat Arrow columns, not Python numbers
        got = chosen.mapInArrow(run, "h bigint, i string, label string, features array<int>, counts array<int>").toArrow().combine_chunks()
        keys = list(zip(got.column("h").to_pylist(), got.column("i").to_pylist(), strict=True))
        label = got.column("label").to_pylist()
        flat = []
        for name in ("features", "counts"):
            column = got.column(name).combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.int32()))
            column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
            flat.append((column.offsets.to_numpy(), column.values.to_numpy()))
        (at, features), (_, tally) = flat
        for r in sorted(range(got.num_rows), key=lambda r: (*keys[r], label[r])):
            f = features[at[r] : at[r + 1]]
            if seen[label[r]] >= sample or not len(f):
                continue
            seen[label[r]] += 1
            c = tally[at[r] : at[r + 1]].astype(np.float32)
            rows.append((f, c / c.sum() * idf[f].astype(np.float32) * np.float32(_SCALE)))
            labels.append(languages.index(label[r]))
    if not rows:
        return Model([], np.zeros((1 << bits, 0), np.float32), 1.0, bits)
    y = np.asarray(labels, np.int64)
    held = np.arange(len(rows)) % 5 == 4
    fit = np.flatnonzero(~held)
    w = ftrl([rows[i] for i in fit], y[fit], len(languages), 1 << bits)
    z = np.array([x @ w[f] for f, x in (rows[i] for i in np.flatnonzero(held))]).reshape(-1, len(languages))
    return Model(languages, (w * idf[:, None]).astype(np.float32), temperature(z, y[held]), bits)


def identify(docs: DataFrame, model: Model, min_confidence: float = MIN_CONFIDENCE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, language, confidence, keep) of every row of docs; no shuffle.

    ``confidence`` is the calibrated probability of the likeliest language.  ``keep`` is
    false, a rejection, where it is under ``min_confidence`` or the text has no letters.

    Defined cases: null, empty and letterless texts have a null language, the confidence 0
    and are rejected, and so are all texts if the model has no languages; the first language
    by name wins a tie; rows that repeat a doc_id or have none give a row each; an empty
    table gives no rows; other columns are ignored.
    """
    src = documents_only(docs, doc_id, text).select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return _scored(src, model, min_confidence)


def _scored(src: DataFrame, model: Model, min_confidence: float) -> DataFrame:
    # the weights are 2**bits x languages floats, a few MB; each executor fetches them once
    shared = src.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in byte_slices(batches, "text", _SLICE_BYTES):
            at = part.schema.get_field_index("text")
            rest = [part.column(i) for i in range(part.num_columns) if i != at]
            names = [x for x in part.schema.names if x != "text"]
            rows = part.num_rows
            if m.languages:
                p, n = m.probabilities(part.column(at))
                best, known = p.argmax(axis=1), n > 0
                sure = np.where(known, p.max(axis=1), 0.0)
            else:
                best, known, sure = np.zeros(rows, int), np.zeros(rows, bool), np.zeros(rows)
            language = pa.array([m.languages[b] if k else None for b, k in zip(best, known, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*rest, language, pa.array(sure), pa.array(known & (sure >= min_confidence))], [*names, "language", "confidence", "keep"])

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "text")
    return src.mapInArrow(run, f"{head}, language string, confidence double, keep boolean")


def filter_language(docs: DataFrame, min_confidence: float = MIN_CONFIDENCE, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """The rows of docs whose text identify() keeps, with all their columns, ``label`` set to the language found.

    The columns of docs may be anything; they pass through the scoring as they are.
    """
    model = train(docs, sample, doc_id=doc_id, text=text, label=label)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    # called nondeterministic below, so that the filter on its result doesn't evaluate it a second time
    @F.arrow_udf("struct<language:string,keep:boolean>")
    def found(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for column in texts:
            batch = pa.RecordBatch.from_arrays([column], ["text"])
            language, keep = [], []
            for part in byte_slices([batch], "text", _SLICE_BYTES):
                if not m.languages:
                    language += [None] * part.num_rows
                    keep += [False] * part.num_rows
                    continue
                p, n = m.probabilities(part.column(0))
                good = (n > 0) & (p.max(axis=1) >= min_confidence)
                language += [m.languages[b] for b in p.argmax(axis=1)]
                keep += good.tolist()
            yield pa.StructArray.from_arrays([pa.array(language, pa.string()), pa.array(keep, pa.bool_())], ["language", "keep"])

    name = free_name("language", docs)
    scored = docs.withColumn(name, found.asNondeterministic()(F.col(f"`{text}`").cast("string"))).filter(F.col(f"`{name}`")["keep"])
    return scored.select(*[F.col(f"`{name}`")["language"].cast(docs.schema[c].dataType).alias(c) if c == label else F.col(f"`{c}`") for c in docs.columns])


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))


QUERIES = {"op5_language": op5_language}
ORACLE: dict[str, str] = {}
