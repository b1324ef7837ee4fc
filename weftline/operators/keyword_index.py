"""A positional index of keywords: which term stands where, as a table in buckets of terms that grows by documents."""

from __future__ import annotations

import zlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.fuzzy_index import similar_pairs
from weftline.sources.catalog import append_new

#: Folders that terms are dealt into, and tasks that write a folder's part of an append: a frequent term is spread over all of them.
BUCKETS, WRITERS = 64, 4
#: What a document is listed under as such, at place -1: no word is empty.
DOCUMENT = ""


def _bucket(term: Column) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(BUCKETS)).cast("int")


def words_of(text: Column | str) -> Column:
    """A text's words, split at white space; none of null and blank ones."""
    t = F.regexp_replace(F.col(text) if isinstance(text, str) else text, r"^\s+|\s+$", "")
    return F.filter(F.split(F.coalesce(t, F.lit("")), r"\s+"), lambda w: w != "")


def add_texts(rows: DataFrame, key: str, text: str, path: str) -> int:
    """Adds the texts whose key the index at ``path`` lacks; returns the number of its new rows, one for each word and one for each text.

    Keys are unique, and rows without one are left out; a text without words is known as
    indexed, but under no term.  The index has term (in lower case), pos (from 0) and
    doc; each term is in one folder, sorted, so that a search reads one folder, and of
    its files the row groups of the term.  It is one append of one table: what a stopped
    job left undone is done by the next call.
    """
    own = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("doc"), F.col(text).alias("_text"))
    known = F.lit(DOCUMENT).alias("term"), F.lit(-1).alias("pos")
    try:
        there = read(rows.sparkSession, path).where((F.col("term") == DOCUMENT) & (F.col("_bucket") == zlib.crc32(b"") % BUCKETS)).select("doc")
        own = own.join(there, "doc", "left_anti")
    except NoIndex:
        pass
    said = own.select("doc", F.posexplode(words_of("_text")).alias("pos", "term")).select("doc", F.lower("term").alias("term"), "pos").unionByName(own.select("doc", *known))
    dealt = said.withColumn("_bucket", _bucket(F.col("term"))).repartition("_bucket", F.pmod(F.xxhash64("doc"), F.lit(WRITERS))).sortWithinPartitions("_bucket", "term", "doc", "pos")
    return append_new(dealt, path, (), by=("_bucket",))


class NoIndex(FileNotFoundError):
    """There is no index at a path."""


def read(spark: SparkSession, path: str) -> DataFrame:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raise NoIndex(path) from e


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """term, n, n_docs of all terms, counted within their folders."""
    return read(spark, path).where(F.col("term") != DOCUMENT).groupBy("term").agg(F.count("*").alias("n"), F.count_distinct("doc").alias("n_docs"))


def find(spark: SparkSession, path: str, terms: Sequence[str] | DataFrame) -> DataFrame:
    """term, doc, pos of all places of the terms, given as they are or as a table with ``term``; case is ignored.

    Given terms name the folders to read; those of a table are looked up while it runs.
    """
    index = read(spark, path).where(F.col("term") != DOCUMENT)
    if isinstance(terms, DataFrame):
        asked = terms.select(F.lower("term").alias("term")).where("term is not null").distinct().withColumn("_bucket", _bucket(F.col("term")))
        return index.join(asked, ["_bucket", "term"], "left_semi").select("term", "doc", "pos")
    lower = sorted({t.lower() for t in terms})
    return index.where(F.col("_bucket").isin(sorted({zlib.crc32(t.encode()) % BUCKETS for t in lower})) & F.col("term").isin(lower)).select("term", "doc", "pos")


def find_similar(spark: SparkSession, path: str, needles: DataFrame, needle: str, threshold: float = 0.75) -> DataFrame:
    """needle, term, similarity, doc, pos: places of all terms as similar to a needle (in lower case) as ``threshold`` by edits; the vocabulary is searched, not the texts."""
    asked = needles.select(F.lower(needle).alias("_needle")).distinct()
    alike = similar_pairs(asked, vocabulary(spark, path), "_needle", "term", threshold)
    return find(spark, path, alike).join(alike, "term").select(F.col("_needle").alias(needle), "term", "similarity", "doc", "pos")


def in_context(hits: DataFrame, rows: DataFrame, key: str, text: str, window: int = 5) -> DataFrame:
    """key, pos, keyword, left_context, right_context of hits (doc, pos), from the texts that have any."""
    places = hits.groupBy(F.col("doc").alias(key)).agg(F.collect_set("pos").alias("_at"))
    found = rows.select(key, F.col(text).alias("_text")).join(places, key).select(key, words_of("_text").alias("_w"), F.explode("_at").alias("pos"))
    left = F.slice("_w", F.greatest(F.col("pos") - window, F.lit(0)) + 1, F.least(F.col("pos"), F.lit(window)))
    return found.select(key, "pos", F.get("_w", F.col("pos")).alias("keyword"), F.array_join(left, " ").alias("left_context"), F.array_join(F.slice("_w", F.col("pos") + 2, F.lit(window)), " ").alias("right_context"))


def distinct_contexts(hits: DataFrame, key: str) -> DataFrame:
    """keyword, left_context, right_context, n, first: hits that read alike, in lower case, as one, with their number and smallest key."""
    same = [F.lower(c).alias(c) for c in ("keyword", "left_context", "right_context")]
    return hits.groupBy(*same).agg(F.count("*").alias("n"), F.min(key).alias("first"))


def coverage_report(classified: DataFrame, category: str = "category", weight: str | None = None, other: str = "other") -> DataFrame:
    """category, n, share, classified: each category's rows (or sum of ``weight``), its share of all, and whether it isn't ``other``; null counts as other."""
    n = F.count("*") if weight is None else F.coalesce(F.sum(weight), F.lit(0))
    sums = classified.groupBy(F.coalesce(F.col(category), F.lit(other)).alias("category")).agg(n.alias("n"))
    whole = sums.agg(F.sum("n").alias("_all"))
    return sums.crossJoin(F.broadcast(whole)).select("category", "n", F.try_divide(F.col("n"), F.col("_all")).alias("share"), (F.col("category") != other).alias("classified"))
