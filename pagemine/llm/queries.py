"""The numbered operators with production parameters on their whole tables, as opN queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemine.llm import (
    byte_bpe,
    centroid_clusters,
    compression_bands,
    embedding_dedup,
    html_style_tree,
    license_scan,
    line_dedup,
    mixing,
    ngram_join,
    piece_bpe,
    quality_crf,
    source_divergence,
    warc_index,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_crf(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    model = quality_crf.train(docs, _table(spark, sf_dir, "labels"))
    return quality_crf.score_documents(docs, model)


def op2_license_scan(spark, sf_dir):
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents")).drop("blocks")


def op3_embedding_dedup(spark, sf_dir):
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op4_html_style_tree(spark, sf_dir):
    return html_style_tree.extract_main_text(_table(spark, sf_dir, "pages"))


def op5_byte_bpe(spark, sf_dir):
    found = byte_bpe.encode_documents(_table(spark, sf_dir, "documents"), with_ids=False)
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op6_line_dedup(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op7_ngram_join(spark, sf_dir):
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"), size=3, percent=90)


def op8_compression_bands(spark, sf_dir):
    found = compression_bands.quality_rules(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "reason")


def op9_mixing(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mixed(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def op10_warc_index(spark, sf_dir):
    return warc_index.archive_pages(_table(spark, sf_dir, "pages")).drop("url")


def op11_sentencepiece(spark, sf_dir):
    found = piece_bpe.encode_documents(_table(spark, sf_dir, "documents"), with_ids=False)
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op12_centroid_clusters(spark, sf_dir):
    return centroid_clusters.clusters(_table(spark, sf_dir, "embeddings"))


def op13_source_divergence(spark, sf_dir):
    return source_divergence.audit(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_line_crf": op1_line_crf,
    "op2_license_scan": op2_license_scan,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_html_style_tree": op4_html_style_tree,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_line_dedup": op6_line_dedup,
    "op7_ngram_join": op7_ngram_join,
    "op8_compression_bands": op8_compression_bands,
    "op9_mixing": op9_mixing,
    "op10_warc_index": op10_warc_index,
    "op11_sentencepiece": op11_sentencepiece,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_source_divergence": op13_source_divergence,
}
