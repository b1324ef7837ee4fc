"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import centroids, chat_format, embedding_dedup, license_scan, near_dedup, packing, ppm, secrets, sentencepiece_codec, sharding, source_audit, toxicity, vp_search
from weftline.llm.pipeline_stages import packed_digest


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, their CRC-32 as little-endian 32-bit numbers, and whether decoding gives the text again."""
    return sentencepiece_codec.digest(_table(spark, sf_dir, "documents"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", F.round("severity", 6).alias("severity"), F.round("toxic_probability", 6).alias("toxic_probability"), "severity_grade", (F.col("toxic_probability") >= model.reject).alias("toxic"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_chats(_table(spark, sf_dir, "conversations"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.sha2(F.to_binary(secrets.digest(secrets.KINDS[:3]), F.lit("utf-8")), 256)
    return found.select("doc_id", *map(count, secrets.KINDS), base.alias("base_sha256"), secrets.digest().alias("spans"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digest(packing.pack_documents(_table(spark, sf_dir, "documents")))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(_table(spark, sf_dir, "documents").select("doc_id", "n_chars"))


def op10_vp_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "embeddings")
    return vp_search.nearest(table, table.where("vec_id % 100 = 0"))


def op11_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(_table(spark, sf_dir, "documents"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sentencepiece,
        op2_near_dedup,
        op3_embedding_dedup,
        op4_toxicity,
        op5_chat_format,
        op6_secret_scan,
        op7_packing,
        op8_license_scan,
        op9_sharding,
        op10_vp_search,
        op11_ppm,
        op12_source_audit,
        op13_centroids,
    )
}

#: Of the others tests hold brute-force versions, exact round trips or held-out accuracy.
ORACLES: dict[str, str] = {
    "op2_near_dedup": near_dedup.ORACLE,
    "op3_embedding_dedup": embedding_dedup.ORACLE,
    "op5_chat_format": chat_format.ORACLE,
    "op10_vp_search": vp_search.ORACLE,
    "op12_source_audit": source_audit.ORACLE,
    "op13_centroids": centroids.ORACLE,
}
