"""A corpus pipeline: language, near duplicates, repeated passages, source mix, pieces.

Each stage gets what its predecessor kept, written as Parquet and read again. All but the last return the columns of
documents. Stages that join by doc_id take it as the key of a document: the first one drops rows without a doc_id.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import langid, mixing, ngram_join, pieces, suffix_dedup
from shelfmark.llm.common import put, work_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MODEL = "piece_bpe_32k.model"
#: A document whose likeliest language has a lower posterior than this belongs to none.
LEAST_SCORE = 0.5
#: A passage goes if it repeats, holds over 50 words, and so has about this many bytes at least, in words of three letters.
PASSAGE_BYTES, PASSAGE_WORDS = 192, 51


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in which a learned language is found; others (no letter, no clear language) go."""
    docs = docs.where("doc_id is not null").select(COLUMNS)
    found = langid.identify(docs, public_tokenizers.path(MODEL), keep=COLUMNS)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles at 0.8, the one with the smallest doc_id stays."""
    first = ngram_join.jaccard_join(docs, 5, 80).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that also stand elsewhere out of the texts: runs of repeated 192-byte strings, of over 50 words."""
    cut = suffix_dedup.remove_repeats(docs, ["doc_id", "lang", "source"], PASSAGE_BYTES, PASSAGE_WORDS)
    return cut.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.char_length("kept").cast("long").alias("n_chars"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, 0 to 3 times."""
    taken = mixing.mix(docs).where("copies > 0").select("doc_id", "copies")
    return docs.join(taken, "doc_id").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, ids (pieces of the whole text), n_pieces."""
    encoded = pieces.encode(docs, public_tokenizers.path(MODEL), ["doc_id", "source", "lang"])
    return encoded.withColumn("n_pieces", F.size("ids").cast("long"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("source mix", source_mix),
    ("SentencePiece encoding", encode),
]

#: SQL can't express the stages; tests compare them with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = put(stage(spark, docs, sf_dir), work_dir(spark, "pipeline-" + name.replace(" ", "-")))
    return docs
