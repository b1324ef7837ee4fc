"""Tagged text, mark-up and archives as tables."""

from __future__ import annotations

import io
import json
import tarfile
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def bio_sentences(spark: SparkSession, path: str) -> DataFrame:
    """sentence, pos, token, tag of token-per-line files: a blank line ends a sentence, token and tag are separated by a space or tab.

    Sentences are split by the reader, so a file is read in parallel only where it is split into several files.
    """
    blocks = spark.read.option("lineSep", "\n\n").text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("sentence"), "value")
    lines = blocks.select("file", "sentence", F.posexplode(F.filter(F.split("value", "\r?\n"), lambda x: F.trim(x) != "")).alias("pos", "line"))
    parts = F.split(F.trim("line"), r"[ \t]+")
    return lines.select("file", "sentence", "pos", F.element_at(parts, 1).alias("token"), F.when(F.size(parts) > 1, F.element_at(parts, -1)).otherwise(F.lit("O")).alias("tag"))


def bio_spans(tokens: DataFrame, *keys: str) -> DataFrame:
    """Spans of BIO tags: keys, kind, first, last, text. A span begins at B-, or at an I- that doesn't go on with the kind before."""
    w = Window.partitionBy(*keys).orderBy("pos")
    tagged = tokens.withColumn("kind", F.when(F.col("tag").rlike("^[BI]-"), F.substring_index("tag", "-", -1)))
    begins = F.col("kind").isNotNull() & (F.col("tag").startswith("B-") | ~F.col("kind").eqNullSafe(F.lag("kind").over(w)))
    numbered = tagged.withColumn("span", F.sum(begins.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("kind is not null")
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), " ")
    return numbered.groupBy(*keys, "span", "kind").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), words.alias("text")).drop("span")


def tag_texts(df: DataFrame, html_column: str, tags: Sequence[str]) -> DataFrame:
    """``df`` with a row for each element of the given tags: tag, surface (its text, tags taken out, collapsed); elements don't nest."""
    parts = []
    for tag in tags:
        found = F.regexp_extract_all(html_column, F.lit(f"(?s)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}>"), F.lit(1))
        parts.append(df.select("*", F.lit(tag).alias("tag"), F.explode(found).alias("surface")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("surface", F.trim(F.regexp_replace(F.regexp_replace("surface", "<[^>]*>", " "), r"\s+", " ")))


def region_text(regions: str, lines: str = "lines", text: str = "text"):
    """The text of nested regions: their lines' texts, joined by line feeds, as a column."""
    return F.array_join(F.flatten(F.transform(regions, lambda r: F.transform(r[lines], lambda x: x[text]))), "\n")


def zip_members(spark: SparkSession, path: str, suffix: str = ".xml") -> DataFrame:
    """archive, member, text of the archives at ``path``: each archive is a task, its members stream out one by one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in sorted(z.namelist()):
                        if member.endswith(suffix):
                            yield pd.DataFrame({"archive": [name], "member": [member], "text": [z.read(member).decode("utf-8", "replace")]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, member string, text string")


def tar_json_members(spark: SparkSession, path: str, wanted: Sequence[str] | None = None) -> DataFrame:
    """archive, member, json of gzipped tar archives of JSON files; with ``wanted`` only members whose name without suffix is among them, and a scan ends with the last."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                left = None if wanted is None else set(wanted)
                with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as tar:
                    for member in tar:
                        stem = member.name.rpartition("/")[2].removesuffix(".json")
                        if not member.isfile() or not member.name.endswith(".json") or (left is not None and stem not in left):
                            continue
                        file = tar.extractfile(member)
                        raw = json.dumps(json.load(file)) if file else None
                        yield pd.DataFrame({"archive": [name], "member": [stem], "json": [raw]})
                        if left is not None:
                            left.discard(stem)
                            if not left:
                                break

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, member string, json string")


def paragraph_map(*prioritised: DataFrame) -> DataFrame:
    """paragraph_id to resolution_id of several tables, that of the first table which knows the paragraph (its smallest)."""
    rows = prioritised[0].select("paragraph_id", "resolution_id", F.lit(0).alias("priority"))
    for k, df in enumerate(prioritised[1:], 1):
        rows = rows.unionByName(df.select("paragraph_id", "resolution_id", F.lit(k).alias("priority")))
    return rows.where("paragraph_id is not null").groupBy("paragraph_id").agg(F.min(F.struct("priority", "resolution_id"))["resolution_id"].alias("resolution_id"))
