"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir) and works on all of ``docs``."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import near_dedup, packing, secrets, toxicity
from weftline.llm.shared import index_of

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _with_plain_names(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, over a table whose other columns can't clash with anything; they come back under their own names."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        there = {c.lower() for c in docs.columns}
        at = {index_of(docs, c): c for c in COLUMNS if c in there}
        plain = docs.toDF(*[at.get(i, f"_other{i}") for i in range(len(docs.columns))])
        return stage(spark, plain, sf_dir).select(plain.columns).toDF(*docs.columns)

    return run


@_with_plain_names
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of being toxic is below what held-out labelled rows ask for.

    Null and empty texts have no features and stay if such a text is below it; repeated
    rows share a decision; no documents give none.  Other columns stay, whatever their names.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).where(F.col("toxic_probability") < model.reject)


@_with_plain_names
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest id.

    Null and empty texts resemble nothing and stay, as do rows without an id; of rows that
    repeat an id and a text one stays.  Other columns stay, whatever their names.
    """
    return near_dedup.keep_first(docs)


@_with_plain_names
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced; n_chars is that of the new text.

    Null and empty texts stay as they are, and so does n_chars where nothing is replaced;
    each repeated row is replaced alike.  Other columns stay, whatever their names.
    """
    found = secrets.find_secrets(docs, spans_column="_spans", redacted_column="_redacted")
    changed = F.size("_spans") > 0
    n_chars = F.when(changed, F.length("_redacted").cast("long")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    out = found.withColumn("text", F.col("_redacted"))
    if n_chars is not None:
        out = out.withColumn("n_chars", n_chars)
    return out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences, as query op7 returns them: null texts are empty, rows of one id are packed one by one."""
    return packed_digest(packing.pack_documents(docs))


def packed_digest(pieces: DataFrame) -> DataFrame:
    length = (F.octet_length("ids") / 4).cast("long")
    return pieces.select("doc_id", "start", length.alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss_tokens")
