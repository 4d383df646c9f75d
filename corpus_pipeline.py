"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns the rows it keeps,
with the columns of documents; the last one returns the packed pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sweepframe.llm import common, decontam, langid, packing, secret_scan, simhash

#: Least share of the best language among the likelihoods of all.
LEAST_LANGUAGE_SCORE = 0.5
#: How many times the bits a byte of a language's own texts a text may take, and how many bytes' worth of such bits beyond that, whatever its length.
MOST_LANGUAGE_RATE, SPARE_BYTES = 2.0, 8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, those whose best language is no better than a guess, and
    those in none of the learned languages: their bytes take far more bits than the language's own.

    The language model learns from all of docs' labelled rows."""
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    judged = langid.annotate(docs, model, pred_as="__lang", score_as="__score", rate_as="__rate")
    own = (F.col("__rate") - MOST_LANGUAGE_RATE) * F.octet_length("text") <= SPARE_BYTES
    kept = judged.filter((F.col("__lang") != langid.UNKNOWN) & (F.col("__score") >= LEAST_LANGUAGE_SCORE) & own)
    return kept.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, the one with the smallest doc_id.

    Texts are near copies if the sets of their five-word shingles are alike to 0.8 or more; SimHash
    finds the candidates. Rows are told apart by doc_id and text, so rows without doc_id and other
    texts under a kept doc_id stay."""
    return simhash.deduplicate(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages out of texts and drops documents that mostly consist of them."""
    return decontam.remove(docs, common.table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in texts; no document goes."""
    return secret_scan.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens."""
    import public_tokenizers

    return packing.digest(docs, public_tokenizers.path("word_bpe_49k.json"), " ~ ")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark_passages", benchmark_passages), ("secrets", secrets), ("packed", packed)]

#: SQL can't express these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
