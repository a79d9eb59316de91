"""Token counts by public tokenizers, in Arrow functions that return lengths only.

Each call encodes a slice of about SLICE_BYTES of text, and texts over PART_BYTES are cut
where no token can reach across, so memory stays level whatever the lengths of texts.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm.kernels import WORD_CLASS, byte_slices
from attestra.llm.tables import documents_only, table

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
SLICE_BYTES = 1 << 20
PART_CHARS = 1 << 15
#: How byte-level BPE vocabularies cut a text before merging: contractions, words, numbers, signs, white space.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Where two characters of unlike kinds meet and the left one isn't white space; but for an apostrophe before a letter.
_SAFE = {
    "byte": regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])"),
    "space": regex.compile(r"(?<=[^\s\u2581])(?= [^\s\u2581])"),
}
_LOADED: dict[str, Callable[[list[str]], list[int]]] = {}


def parts(text: str, limit: int = PART_CHARS, kind: str = "byte") -> list[str]:
    """Cuts of text whose token counts add up to the whole's.

    ``byte``: no token of any kind in PATTERN reaches from a letter to a digit or sign, from
    a digit to a letter or sign, from a sign to a letter or digit (an apostrophe may go with
    the letters after it), or from anything else into white space.  ``space``: vocabularies
    that join a text's words by a mark of their own, and put one before the first, are cut
    before a single space, which the mark of the next part stands for.  Each part is the
    shortest that has ``limit`` characters and ends at such a place; a text without one
    stays whole.
    """
    out, start = [], 0
    while len(text) - start > limit:
        found = _SAFE[kind].search(text, start + limit)
        if found is None:
            break
        out.append(text[start : found.start()])
        start = found.start() + (kind == "space")
    out.append(text[start:])
    return out


def _tiktoken(path: str) -> Callable[[list[str]], list[int]]:
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    encode = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda texts: [len(encode(t)) for t in texts]


def _tokenizers(path: str) -> Callable[[list[str]], list[int]]:
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda texts: [len(e) for e in t.encode_batch_fast(texts, add_special_tokens=False)]


def _sentencepiece(path: str) -> Callable[[list[str]], list[int]]:
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(x) for x in p.encode(texts, num_threads=1)]


def counter(path: str) -> tuple[Callable[[list[str]], list[int]], str]:
    """A function from texts to token counts, and the kind of places where long texts may be cut for it; loaded once a process."""
    byte_level = path.endswith(".tiktoken") or path.rsplit("/", 1)[-1].startswith("byte_bpe")
    if path not in _LOADED:
        load = _tiktoken if path.endswith(".tiktoken") else _sentencepiece if path.endswith(".model") else _tokenizers
        _LOADED[path] = load(path)
    return _LOADED[path], "byte" if byte_level else "space"


def count_texts(texts: list[str | None], path: str, limit: int = PART_CHARS) -> list[int]:
    """Tokens of each text; null has 0."""
    count, kind = counter(path)
    pieces, owner = [], []
    for i, t in enumerate(texts):
        for p in (parts(t, limit, kind) if t and len(t) > limit else [t or ""]):
            pieces.append(p)
            owner.append(i)
    out = [0] * len(texts)
    for i, n in zip(owner, count(pieces), strict=True):
        out[i] += n
    return out


def token_length(text: Column, vocabulary: str = VOCABULARY, folder: str = TOKENIZERS) -> Column:
    """The number of tokens of a text, as token_counts() has it, as a column; 0 for null."""
    path = f"{folder.rstrip('/')}/{vocabulary}"

    @F.arrow_udf("bigint")
    def lengths(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        for column in columns:
            found: list[int] = []
            for b in byte_slices([pa.RecordBatch.from_arrays([column], ["text"])], "text", SLICE_BYTES):
                found += count_texts(b.column(0).to_pylist(), path)
            yield pa.array(found, pa.int64())

    return lengths(text)


def word_count(text: Column) -> Column:
    """The number of words of a text, as a column; 0 for null.  A measure for callers who need no tokenizer."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_CLASS)), F.lit(0)).cast("bigint")


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, folder: str = TOKENIZERS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of every row of docs; no shuffle, and only these two columns are read.

    ``folder`` must be the same on all executors.  Texts over PART_CHARS characters are cut
    at safe boundaries; see parts().

    Defined cases: null and empty texts have 0 tokens; the strings of special tokens count
    as ordinary text; rows that repeat a doc_id or have none give a row each; an empty table
    gives no rows; other columns are ignored.
    """
    path = f"{folder.rstrip('/')}/{vocabulary}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        for b in byte_slices(batches, "text", SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count_texts(b.column(1).to_pylist(), path), pa.int64())], ["doc_id", "n_tokens"])

    src = documents_only(docs, doc_id, text).select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_tokens bigint")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


QUERIES = {"op6_token_counts": op6_token_counts}
ORACLE: dict[str, str] = {}
