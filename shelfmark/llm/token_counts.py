"""Token counts through a digest cache.

A text's digest (SHA-256 of its normalised bytes) and the tokenizer's digest (SHA-256 of its file, library
version and options) name a count that is stored once. Texts are joined to the cache by both digests; only
distinct misses are encoded, and their counts are appended.

Normalisation never changes a count: null becomes empty, nothing else. Cases: null and empty texts count 0
bytes and what the tokenizer gives for an empty text; a very long text is encoded alone and whole; a null doc_id stays
null and has its count; repeated rows give a row each, of one count; an empty table gives an
empty result; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import put, text_chunks, text_of, work_dir

MARK = "▁"
#: Words kept in a worker's memory, and the longest of them.
MEMO_WORDS, MEMO_LENGTH = 400_000, 64

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"


def tokenizer_digest(path: str, pattern: str | None = None) -> str:
    """Names a tokenizer's version: file bytes, library and its version, split pattern."""
    library = {".json": "tokenizers", ".model": "sentencepiece", ".tiktoken": "tiktoken"}[Path(path).suffix]
    version = getattr(__import__(library), "__version__", "")
    return hashlib.sha256(Path(path).read_bytes() + f"\0{library}\0{version}\0{pattern}".encode()).hexdigest()


class PieceCounter:
    """Counts of a sentencepiece model.

    No piece of such a vocabulary goes on past the end of a word (it holds no marker after another character),
    so a merge never crosses that place and a text's count is the sum of its words' counts. The library counts
    each distinct word; a worker remembers words. Where a vocabulary has other pieces, or a text holds the marker
    character itself, the library gets the whole text.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = map(self.model.id_to_piece, range(self.model.get_piece_size()))
        plain = self.model.encode("a b") == self.model.encode("a") + self.model.encode("b") and self.model.encode("a  b") != self.model.encode("a b")
        self.by_word = plain and not any(MARK in p.lstrip(MARK) for p in pieces)
        self.memo: dict[str, int] = {}

    def _whole(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]

    def _parts(self, text: str) -> list[str]:
        """Words without the one space that the model puts before each; further spaces stay with the word."""
        if "  " not in text and text[:1] != " " and text[-1:] != " ":
            return text.split(" ")
        first, *rest = re.findall(r"^ *[^ ]*| +[^ ]*", text) or [""]
        return [first, *(x[1:] for x in rest)]

    def counts(self, texts: list[str]) -> list[int]:
        if not self.by_word:
            return self._whole(texts)
        split = [self._parts(x) if x and MARK not in x else None for x in texts]
        words = set().union(*(x for x in split if x))
        if len(self.memo) > MEMO_WORDS:
            self.memo = {}
        memo = self.memo
        new = [w for w in words if w not in memo]
        memo.update(zip(new, self._whole(new), strict=True))
        memo[""] = 1  # a space with no word after it: the marker alone
        out = [sum(map(memo.__getitem__, parts)) if parts is not None else self._whole([text])[0] if text else 0 for text, parts in zip(texts, split, strict=True)]
        for w in new:
            if len(w) > MEMO_LENGTH:
                del memo[w]
        return out


class JsonCounter:
    """Counts of a tokenizers file: no added tokens, special strings as the library's default has it."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x.ids) for x in self.model.encode_batch(texts, add_special_tokens=False)]


class RankCounter:
    """Counts of a tiktoken rank file under a split pattern."""

    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
        self.model = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def counts(self, texts: list[str]) -> list[int]:
        return [len(self.model.encode_ordinary(x)) for x in texts]


_loaded: dict[tuple[str, str | None], PieceCounter | JsonCounter | RankCounter] = {}


def counter(path: str, pattern: str | None = None) -> PieceCounter | JsonCounter | RankCounter:
    """The counter of a tokenizer file; a Python worker loads it once."""
    if (path, pattern) not in _loaded:
        kind = Path(path).suffix
        _loaded[path, pattern] = PieceCounter(path) if kind == ".model" else JsonCounter(path) if kind == ".json" else RankCounter(path, pattern)
    return _loaded[path, pattern]


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_bytes (UTF-8), n_tokens.

    cache_path: a Parquet cache that runs share and append to; None starts an empty one in the work folder.
    Two runs that append the same digest at once do no harm: a digest is read once.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer_path, pattern)
    cache_path = cache_path or work_dir(spark, "token-cache")
    digest = F.unhex(F.sha2(text_of(text_col), 256))
    wanted = docs.select(digest.alias("digest"), text_of(text_col).alias("text")).groupBy("digest").agg(F.first("text").alias("text"))
    known = _cached(spark, cache_path, version)
    if known is not None:
        wanted = wanted.join(known, "digest", "left_anti")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = counter(tokenizer_path, pattern)
        for part, texts in text_chunks(batches, "text"):
            n = pa.array(encoder.counts(texts), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("digest"), pa.array([version] * len(n), pa.string()), n], ["digest", "tokenizer", "n_tokens"])

    wanted.mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    # a table of its own, so that both sides of the join are plain exchanges and Spark can split a text of very many copies
    counts = put(_cached(spark, cache_path, version), work_dir(spark, "token-counts"))
    keyed = docs.select(F.col(id_col).alias("doc_id"), digest.alias("digest"), F.octet_length(text_of(text_col)).cast("long").alias("n_bytes"))
    return keyed.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens")


def _cached(spark, cache_path: str, version: str) -> DataFrame | None:
    """Stored counts of one tokenizer version, each digest once; None where there is no cache yet."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache_path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == version)
    return stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
