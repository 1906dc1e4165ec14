"""A training corpus from ``documents``: five stages, each on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``docs``. Stages are handed Parquet, written by the one before. Columns that documents have besides
``doc_id`` and ``text`` are carried along, whatever they are called; an empty table passes every stage
and leaves an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lithos.llm import bpe, decontam, secrets, simhash, toxicity
from lithos.llm.registry import bounded, fold_of, vocabulary
from lithos.llm.store import written
from lithos.sources.tables import read_table


@bounded
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows predicted toxic go; the classifier learns from the labelled rows of ``docs``. A null or empty
    text is scored as one without words; rows with a null id are scored and never learned from; repeated
    rows share their fate; without labels of both kinds every row stays."""
    learned = fold_of("doc_id", 5) != 0
    labels = read_table(spark, sf_dir, "labels").where(learned)
    return toxicity.without_toxic(docs, "text", toxicity.fit(docs.where(learned), labels, "doc_id", "text", "toxic"))


@bounded
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: 4-word shingles, 4 bits. It is the one with the smallest
    id, a null id only where there is no other; of equal rows one. Null, empty and blank texts are a group."""
    return simhash.one_of_each(docs, "doc_id", "text", 4, 4)


@bounded
def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and empty texts hold none and stay; null or empty items
    match nothing (items without a word); ids play no part."""
    return decontam.without_leaks(docs, "text", read_table(spark, sf_dir, "benchmark"), "item_id", "text")


@bounded
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the text are replaced by their kind; every document stays. Null texts stay null, and
    ``n_chars``, where there is one, is counted anew where the text has changed."""
    return secrets.redact(docs, "text", "n_chars" if "n_chars" in docs.columns else None)


@bounded
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document, with digests of ids and decoded text. A null text has the ids
    of an empty one, none; repeated rows and null ids each give their row."""
    return bpe.encode_decode(docs, "doc_id", "text", *vocabulary(), ids=True).drop("decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark),
    ("secret_scan", redact_secrets),
    ("byte_bpe", encode),
]

#: No SQL form: trained scores and fingerprints; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each intermediate is written to the shared checkpoint folder."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
