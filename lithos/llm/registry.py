"""Queries of the training-data operators on the driver's tables: thin calls with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lithos.llm import (
    bpe, decontam, embeddings, hard_negatives, html, ngram, secrets, sharding, simhash, suffixes, toxicity, warc,
    whitening,
)
from lithos.llm.store import bounded_batches
from lithos.sources.tables import read_table

#: Rank file of the byte-level vocabulary, by its name among the public tokenizers.
VOCABULARY = "byte_bpe_50k.tiktoken"


def fold_of(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % n


def vocabulary() -> tuple[list[bytes], str]:
    import public_tokenizers

    return bpe.read_ranks(public_tokenizers.path(VOCABULARY)), public_tokenizers.PATTERN


def q_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; labels of held-out documents are not read."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    learned = fold_of("doc_id", 5) != 0
    model = toxicity.fit(docs.where(learned), labels.where(learned), "doc_id", "text", "toxic")
    held = F.coalesce(fold_of("doc_id", 5) == 0, F.lit(True)).alias("held_out")
    return toxicity.score(docs, "doc_id", "text", model).select(
        "doc_id", held, "score", "predicted", "language", "logit")


def q_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document, and what they decode to, as digests."""
    return bpe.encode_decode(read_table(spark, sf_dir, "documents"), "doc_id", "text", *vocabulary())


def q_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secrets.scan(read_table(spark, sf_dir, "documents"), "doc_id", "text")


def q_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and near-duplicate component of every document: 4-word shingles, 4 bits."""
    found = simhash.cluster(read_table(spark, sf_dir, "documents"), ["doc_id"], "doc_id", "text", 4, 4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def q_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes; equal texts share a shard."""
    found = sharding.shards(read_table(spark, sf_dir, "documents"), "doc_id", "text", 24)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"))


def q_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents hold, verbatim or edited."""
    return decontam.leaks(read_table(spark, sf_dir, "documents"), "doc_id", "text",
                          read_table(spark, sf_dir, "benchmark"), "item_id", "text")


def q_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at cosine 0.95 and components of every vector."""
    return embeddings.near_duplicates(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.95)


def q_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = html.extract(read_table(spark, sf_dir, "pages"), ["page_id", "url"], "url", "html")
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


def q_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bigram and unigram log probabilities of every document, from the documents not held out."""
    return ngram.score(read_table(spark, sf_dir, "documents"), "doc_id", "text", fold_of("doc_id", 7) == 2)


def q_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that repeat across documents."""
    return suffixes.repeated(read_table(spark, sf_dir, "documents"), "doc_id", "text", 50, within=False)


def q_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened coordinates of every vector on up to 32 components."""
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 32)


def q_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; every seventh label is first moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", label,
                               F.col("vec_id") % 100 == 0)


def q_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back. ``pages`` names no capture time: the id in seconds
    stands in for it."""
    found = warc.round_trip(read_table(spark, sf_dir, "pages"), "page_id", "url", "html", F.timestamp_seconds("page_id"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def bounded(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The query in a session whose Arrow batches are bounded."""
    @wraps(query)
    def run(spark: SparkSession, *args) -> DataFrame:
        bounded_batches(spark)
        return query(spark, *args)

    return run


QUERIES = {name: bounded(query) for name, query in {
    "op1_toxicity": q_toxicity,
    "op2_repeated_passages": q_suffixes,
    "op3_lm_scoring": q_ngram,
    "op4_byte_bpe": q_bpe,
    "op5_simhash": q_simhash,
    "op6_embedding_near_dedup": q_embeddings,
    "op7_sharding": q_sharding,
    "op8_secret_scan": q_secrets,
    "op9_decontamination": q_decontamination,
    "op10_html_extraction": q_html,
    "op11_embedding_whitening": q_whitening,
    "op12_hard_negatives": q_hard_negatives,
    "op13_warc": q_warc,
}.items()}

_MINED = """
WITH r AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, c.vec_id AS id, c.label, CAST(list_inner_product(a.x, c.x) AS BIGINT) AS score
  FROM (SELECT DISTINCT * FROM r WHERE vec_id % 100 = 0) a JOIN r c ON c.vec_id <> a.vec_id AND len(c.x) = len(a.x)),
p AS (
  SELECT anchor_id, own, id AS positive_id, score AS positive_score FROM s WHERE label = own
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (
  SELECT p.anchor_id, p.positive_id, s.id AS negative_id, p.positive_score, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> p.own
   AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

# base32: every 5 hex digits are 4 letters
_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
g AS (SELECT *, count(*) OVER (PARTITION BY body) AS n, max(page_id) OVER (PARTITION BY body) AS top FROM p)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (
    (CAST('0x' || substr(hex, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN n = 1 OR page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN n > 1 AND page_id <> top THEN top END AS refers_to
FROM g
"""

#: DuckDB SQL where SQL can express a query.
SQL: dict[str, str] = {"op12_hard_negatives": _MINED, "op13_warc": _WARC}
