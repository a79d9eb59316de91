"""Quality classifier: regularised quadratic discriminant on document statistics.

Each class of labelled documents is a normal distribution of transformed statistics; its
covariance is shrunk towards the pooled one, and that towards its mean variance.  A
document's score is the difference of the two log-densities, Mahalanobis distances by
Cholesky factors that are computed once and sent to the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm import kernels as K
from attestra.llm.tables import documents_only, kept, table

#: Share of the pooled covariance in a class's, and of the mean variance in the result.
TO_POOLED, TO_DIAGONAL = 0.2, 0.02
FEATURES = ("words", "word_length", "word_spread", "letters", "capitals", "digits", "signs", "lines", "new_words", "new_pairs", "one_sign_words", "long_words")
_SLICE_BYTES = 1 << 19
#: Shares and means are those of the text and PRIOR ordinary words, so that a text of a few words is not an outlier.
PRIOR, PRIOR_LENGTH, PRIOR_SPREAD = 8.0, 5.0, 3.0
_LETTER, _CAPITAL, _DIGIT, _SIGN = 1, 2, 3, 4
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = _SIGN
_KIND[48:58] = _DIGIT
_KIND[97:123] = _LETTER
_KIND[128:] = _LETTER
_KIND[65:91] = _CAPITAL


def _distinct(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """How many distinct values each document has."""
    if not len(values):
        return np.zeros(n)
    # documents go into the low bits: equal values of one document are neighbours once sorted
    key = np.sort(K.mix64(values ^ K.mix64(doc.astype(np.uint64) + np.uint64(1))) >> np.uint64(24) | doc.astype(np.uint64) << np.uint64(40))
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    return np.bincount((key[fresh] >> np.uint64(40)).astype(np.int64), minlength=n).astype(float)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The transformed statistics (documents x FEATURES) of whole texts, given as bytes and offsets; blank texts have zeros."""
    n = len(offsets) - 1
    words = K.Words(data, offsets)
    counts = words.counts.astype(float)
    some = counts + PRIOR
    kind = _KIND[data]

    def per_text(mask: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int64)
        np.cumsum(mask, out=sums[1:])
        return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(float)

    letters, capitals, digits, signs = (per_text(kind == k) for k in (_LETTER, _CAPITAL, _DIGIT, _SIGN))
    letters += PRIOR * PRIOR_LENGTH
    solid = letters + capitals + digits + signs
    lines = per_text(data == 10)
    doc = np.repeat(np.arange(n), words.counts)
    length = (words.ends - words.starts).astype(float)
    mean = (np.bincount(doc, length, minlength=n) + PRIOR * PRIOR_LENGTH) / some
    squares = np.bincount(doc, length * length, minlength=n) + PRIOR * (PRIOR_LENGTH**2 + PRIOR_SPREAD**2)
    spread = np.sqrt(np.maximum(squares / some - mean * mean, 0))
    h = words.hashes(fold=True)
    pairs, at = K.windows(h, words.first, 2)
    pair_doc = np.repeat(np.arange(n), np.diff(at))
    n_pairs = np.diff(at) + PRIOR
    sign_sum = np.zeros(len(data) + 1, np.int64)
    np.cumsum(kind == _SIGN, out=sign_sum[1:])
    bare = (sign_sum[words.ends] - sign_sum[words.starts]) == words.ends - words.starts
    out = np.stack(
        [
            np.log1p(counts),
            np.log1p(mean),
            np.log1p(spread),
            np.sqrt(letters / solid),
            np.sqrt(capitals / solid),
            np.sqrt(digits / solid),
            np.sqrt(signs / solid),
            np.sqrt(lines / some),
            # type counts grow with less than the length; the power takes that out for the most part
            (_distinct(h, doc, n) + PRIOR) / some**0.85,
            (_distinct(pairs, pair_doc, n) + PRIOR) / n_pairs,
            np.sqrt(np.bincount(doc, bare, minlength=n) / some),
            np.sqrt(np.bincount(doc, length > 12, minlength=n) / some),
        ],
        axis=1,
    )
    out[counts == 0] = 0.0
    return out


def _features(src: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of src and the list of statistics of its column text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in K.byte_slices(batches, "text", _SLICE_BYTES):
            x = statistics(*K.utf8_parts(part.column(part.schema.get_field_index("text"))))
            at = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * len(FEATURES))
            yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(k)) for k in keep), pa.ListArray.from_arrays(at, pa.array(x.ravel()))], [*keep, "x"])

    head = ", ".join(f"{k} {src.schema[k].dataType.simpleString()}" for k in keep)
    return src.mapInArrow(run, f"{head}, x array<double>")


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors, log-determinants and log-priors of class 0 and class 1; without both classes, none."""

    means: np.ndarray | None = None
    inverse: np.ndarray | None = None
    log_det: np.ndarray | None = None
    log_prior: np.ndarray | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        """log p(x, 1) - log p(x, 0)."""
        if self.means is None:
            return np.full(len(x), np.nan)
        d = []
        for k in (0, 1):
            y = (x - self.means[k]) @ self.inverse[k].T
            d.append(self.log_prior[k] - 0.5 * ((y * y).sum(axis=1) + self.log_det[k]))
        return d[1] - d[0]


def discriminant(n: np.ndarray, s: np.ndarray, ss: np.ndarray, to_pooled: float = TO_POOLED, to_diagonal: float = TO_DIAGONAL) -> Discriminant:
    """From each class's count, sum of x and sum of x xT."""
    if (n < 2).any():
        return Discriminant()
    p = s.shape[1]
    means = s / n[:, None]
    scatter = ss - n[:, None, None] * means[:, :, None] * means[:, None, :]
    pooled = scatter.sum(axis=0) / max(n.sum() - 2, 1)
    inverse, log_det = [], []
    for k in (0, 1):
        c = (1 - to_pooled) * scatter[k] / (n[k] - 1) + to_pooled * pooled
        # towards the diagonal of the pooled variances, so that statistics keep their scales
        c = (1 - to_diagonal) * c + to_diagonal * np.diag(np.maximum(np.diag(pooled), 1e-6))
        low = np.linalg.cholesky((c + c.T) / 2)
        inverse.append(np.linalg.solve(low, np.eye(p)))
        log_det.append(2 * np.log(np.diag(low)).sum())
    return Discriminant(means, np.array(inverse), np.array(log_det), np.log(n / n.sum()))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", to_pooled: float = TO_POOLED, to_diagonal: float = TO_DIAGONAL) -> Discriminant:
    """The discriminant of label 1 against 0, from every labelled document.

    Only statistics are joined with labels, never texts, and each task sends back a count, a
    sum and a sum of products by class.  Labels other than 0 and 1 and null ids are left out;
    a doc_id that is repeated on either side counts for each pair.
    """
    src = _read(docs, doc_id, text).filter("doc_id is not null")
    return _fit(_features(src, ["doc_id"]), _marks(labels, doc_id, label), to_pooled, to_diagonal)


def _marks(labels: DataFrame, doc_id: str, label: str) -> DataFrame:
    return documents_only(labels, doc_id, label).select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("label")).filter("label in (0, 1) and doc_id is not null")


def _fit(features: DataFrame, marks: DataFrame, to_pooled: float, to_diagonal: float) -> Discriminant:
    p = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, ss = np.zeros(2), np.zeros((2, p)), np.zeros((2, p, p))
        for b in batches:
            y = b.column(0).to_numpy(zero_copy_only=False)
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
            for k in (0, 1):
                z = x[y == k]
                n[k] += len(z)
                s[k] += z.sum(axis=0)
                ss[k] += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(n), pa.array(list(s)), pa.array([m.ravel() for m in ss])], ["label", "n", "s", "ss"])

    joined = features.join(marks, "doc_id").select("label", "x")
    n, s, ss = np.zeros(2), np.zeros((2, p)), np.zeros((2, p, p))
    sums = joined.mapInArrow(run, "label int, n double, s array<double>, ss array<double>")
    # a few kB a task; sorted, so that the sums don't depend on the order in which tasks end
    for r in sorted(sums.filter("n > 0").collect(), key=lambda r: (r["label"], r["n"], r["s"])):
        k = r["label"]
        n[k] += r["n"]
        s[k] += r["s"]
        ss[k] += np.reshape(r["ss"], (p, p))
    return discriminant(n, s, ss, to_pooled, to_diagonal)


def _read(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return documents_only(docs, doc_id, text).select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))


def classify(docs: DataFrame, model: Discriminant, threshold: float = 0.0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, keep) of every row of docs: the log-odds of quality, and whether they reach ``threshold``.

    Defined cases: null, empty and blank texts say nothing of quality: their score is null
    and keep is false; so is every score, and keep true for texts with words, if the labels
    didn't have two documents of either class; a statistic that is the same in all of a class
    takes part by the pooled variance; rows that repeat a doc_id or have none give a row
    each; an empty table gives no rows; other columns are ignored.
    """
    return _scored(_features(_read(docs, doc_id, text), ["doc_id"]), model, threshold)


def _scored(features: DataFrame, model: Discriminant, threshold: float) -> DataFrame:
    shared = features.sparkSession.sparkContext.broadcast(model)  # a few kB, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            words = x[:, 0] > 0
            score = np.where(words, shared.value.scores(x), np.nan)
            unknown = np.isnan(score)
            keep = words & (unknown | (score >= threshold))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score, mask=unknown), pa.array(keep)], ["doc_id", "score", "keep"])

    return features.mapInArrow(run, f"doc_id {features.schema['doc_id'].dataType.simpleString()}, score double, keep boolean")


def fit_and_classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.0, doc_id: str = "doc_id", text: str = "text", label: str = "quality", to_pooled: float = TO_POOLED, to_diagonal: float = TO_DIAGONAL) -> DataFrame:
    """classify() of docs by fit() on docs and labels; each text is read once, and its statistics kept for both."""
    features = kept(_features(_read(docs, doc_id, text), ["doc_id"]), "statistics")
    return _scored(features, _fit(features.filter("doc_id is not null"), _marks(labels, doc_id, label), to_pooled, to_diagonal), threshold)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit_and_classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op10_quality": op10_quality}
ORACLE: dict[str, str] = {}
