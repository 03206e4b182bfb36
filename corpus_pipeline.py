"""From documents to tokens: the stages of a training corpus, each on what the one before kept.

Every stage takes (spark, docs, sf_dir) and returns the columns of documents, but for the
last, which returns token ids and digests per document. `run` writes each stage's rows to the
shared folder and reads them again, so a lost executor costs no earlier stage.

Null and empty texts fail the quality rules. A stage reads the five columns of documents and
no others; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemine.llm import byte_bpe, compression_bands, line_dedup, mixing, ngram_join
from pagemine.llm.common import staged

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the word rules or the compression bands reject go."""
    return compression_bands.accepted(docs, COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that at least ten documents hold go; n_chars follows the text."""
    kept = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 of their 5-word n-grams, the smallest id stays.

    Documents without an id take one from their text. Rows repeated with id and text stay once.
    """
    rows = docs.select(*COLUMNS, F.coalesce(F.col("doc_id"), F.xxhash64("text")).alias("_id"))
    found = ngram_join.near_duplicates(rows.select(F.col("_id").alias("doc_id"), "text"), size=5, percent=80)
    first = staged(found.where("doc_id = component_id").select(F.col("doc_id").alias("_id")).distinct(), "first_of_group")
    kept = rows.join(first, "_id", "left_semi").withColumn("_text", F.xxhash64("text"))
    return kept.dropDuplicates(["_id", "_text"]).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for."""
    return mixing.emitted(docs.select(*COLUMNS))


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256, decoded_sha256."""
    return byte_bpe.encode_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode_bytes),
]

#: Compression ratios and merges by rank have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = staged(stage(spark, docs, sf_dir), f"stage{number}")
    return docs
