"""Registered queries of the subpackage: every operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadlens.catalog import Query
from loadlens.llm import (
    bm25, decontaminate, language, line_templates, merkle, minhash, mixing, nbsvm, passages,
    repair, simhash, suffixes, warc)
from loadlens.sources.store import PLAIN_READS


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, read without the direct buffers that threads keep at the size of a column chunk."""
    return spark.read.option(*PLAIN_READS).parquet(f"{sf_dir}/documents.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents by two-word shingles."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), k=2)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents, with the best window."""
    return decontaminate.matches(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("text_hash")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of every page, with their linkage and content."""
    records = warc.derivatives(warc.responses(_table(spark, sf_dir, "pages")))
    names = {"WARC-Type": "warc_type", "WARC-Record-ID": "record_id",
             "WARC-Refers-To": "refers_to", "WARC-Target-URI": "target_uri",
             "WARC-Block-Digest": "block_digest", "Content-Type": "content_type"}
    return records.select(
        "page_id", *(warc.header(n).alias(c) for n, c in names.items()),
        F.octet_length("block").cast("long").alias("content_length"),
        F.col("block").cast("string").alias("content"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return nbsvm.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for the words of every hundredth document."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    queries = docs.filter("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id")
    return bm25.top_k(docs, queries, 10)


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that documents have in common."""
    return passages.repeated_passages(_documents(spark, sf_dir))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the number of lines dropped and the digest of what is left."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_templates.drop_recurring_lines(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_lines", "n_dropped", "n_chars_dropped",
        F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document and the number of its single-language spans."""
    return language.identify(_table(spark, sf_dir, "documents")).select(
        F.col("doc_id").cast("long").alias("doc_id"), "held_out", "lang_pred", "score",
        F.size("spans").cast("long").alias("n_spans"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of every document."""
    return mixing.mix(mixing.sized(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")))


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that repeat an earlier document, and the digest of the rest."""
    return suffixes.repeated_bytes(_table(spark, sf_dir, "documents")).drop("spans")


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and inclusion proof of every document, checked after tampering."""
    return merkle.manifest(_table(spark, sf_dir, "documents")).drop("path")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation after damage."""
    conversations = _table(spark, sf_dir, "conversations")
    return repair.repaired(repair.damaged(conversations), conversations)


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents by fingerprints of three-word shingles."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_minhash": Query(op1_minhash),
    "op2_decontamination": Query(op2_decontamination),
    "op3_warc": Query(op3_warc),
    "op4_quality": Query(op4_quality),
    "op5_bm25": Query(op5_bm25),
    "op6_passages": Query(op6_passages),
    "op7_line_dedup": Query(op7_line_dedup, line_templates.SQL),
    "op8_language": Query(op8_language),
    "op9_mixing": Query(op9_mixing, mixing.SQL),
    "op10_suffixes": Query(op10_suffixes),
    "op11_manifest": Query(op11_manifest, merkle.SQL),
    "op12_repair": Query(op12_repair, repair.SQL),
    "op13_simhash": Query(op13_simhash),
}
