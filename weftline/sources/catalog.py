"""Named datasets: a manifest maps a name to a tier, a path and a format; reading and writing by suffix."""

from __future__ import annotations

import json
import os
import time
import tomllib
import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Under which name columns carry their table's provenance, and what follows the path of the file beside it.
PROVENANCE, BESIDE = "provenance", ".provenance.json"


class DatasetNotFound(KeyError):
    """No dataset of that name, or none of its paths exists."""


class TierUnavailable(RuntimeError):
    """A tier's root or the file that shows that it is mounted is missing."""


def _merged(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    out = dict(base)
    for key, value in over.items():
        out[key] = _merged(out[key], value) if isinstance(value, Mapping) and isinstance(out.get(key), Mapping) else value
    return out


def _remote(path: str) -> bool:
    return "://" in path and not path.startswith("file://")


@dataclass(frozen=True)
class Catalog:
    """Datasets and tiers; later manifests override earlier ones key by key, and ``DATASET_ROOT_<TIER>`` a tier's root."""

    spark: SparkSession
    tiers: Mapping[str, Mapping[str, Any]] = field(default_factory=dict)
    datasets: Mapping[str, Mapping[str, Any]] = field(default_factory=dict)

    @classmethod
    def load(cls, spark: SparkSession, *manifests: str, env: Mapping[str, str] | None = None) -> Catalog:
        merged: dict[str, Any] = {}
        for path in manifests:
            if os.path.exists(path):
                with open(path, "rb") as f:
                    merged = _merged(merged, tomllib.load(f))
        env = os.environ if env is None else env
        for tier in merged.get("tiers", {}):
            if root := env.get(f"DATASET_ROOT_{tier.upper()}"):
                merged["tiers"][tier]["root"] = root
        return cls(spark, merged.get("tiers", {}), merged.get("datasets", {}))

    def resolve(self, name: str, must_exist: bool = True) -> str:
        """The dataset's path; a path on a remote store isn't probed."""
        if name not in self.datasets:
            raise DatasetNotFound(name)
        entry = self.datasets[name]
        tier = self.tiers.get(entry.get("tier", ""), {})
        root = tier.get("root", "")
        if root and not _remote(root):
            if not os.path.isdir(root) or (tier.get("mount_check") and not os.path.exists(os.path.join(root, tier["mount_check"]))):
                raise TierUnavailable(f"{entry.get('tier')}: {root}")
        path = f"{root.rstrip('/')}/{entry['path']}" if root else entry["path"]
        if must_exist and not _remote(path) and not os.path.exists(path):
            raise DatasetNotFound(f"{name}: {path}")
        return path

    def read(self, name: str, schema: T.StructType | str | None = None) -> DataFrame:
        return read(self.spark, self.resolve(name), schema)

    def write(self, df: DataFrame, name: str, **provenance: Any) -> str:
        """Writes a dataset in the format of its suffix, with a provenance record beside it, and in Parquet's and ORC's footers.

        Phase, parent and description are the manifest's, where it has them; others may be given.
        """
        path = self.resolve(name, must_exist=False)
        entry = self.datasets[name]
        known = {k: entry[k] for k in ("phase", "parent", "description") if entry.get(k)}
        write(df, path, **{**provenance, **known, "name": name})
        return path

    def check(self) -> list[dict[str, Any]]:
        """Of each dataset its name, path and state: ok, missing or tier unavailable."""
        out = []
        for name in self.datasets:
            try:
                out.append({"name": name, "path": self.resolve(name), "state": "ok"})
            except TierUnavailable as e:
                out.append({"name": name, "path": str(e), "state": "tier unavailable"})
            except DatasetNotFound as e:
                out.append({"name": name, "path": str(e), "state": "missing"})
        return out


def first_existing(paths: Sequence[str]) -> str:
    """The first of several local paths that exists."""
    for path in paths:
        if os.path.exists(path):
            return path
    raise DatasetNotFound(", ".join(paths))


def separator(spark: SparkSession, path: str) -> str:
    """Tab, semicolon or comma: that which the first line holds most often."""
    head = spark.read.text(path).limit(1).collect()
    line = head[0][0] if head else ""
    return max("\t;,", key=line.count)


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def provenance(df: DataFrame) -> dict[str, Any] | None:
    """The record that a table's columns carry from where it was written; null if none does."""
    return next((json.loads(f.metadata[PROVENANCE]) for f in df.schema if PROVENANCE in f.metadata), None)


def with_provenance(df: DataFrame, record: Mapping[str, Any] | None) -> DataFrame:
    """``df`` with a record on each column, so that it survives a selection; earlier ones, which are of what it was made from, go."""
    text = None if record is None else json.dumps(record, sort_keys=True)
    columns = []
    for f in df.schema:
        kept = {k: v for k, v in f.metadata.items() if k != PROVENANCE}
        columns.append(F.col("`" + f.name.replace("`", "``") + "`").alias(f.name, metadata=kept if text is None else {**kept, PROVENANCE: text}))
    return df.select(*columns)


def read(spark: SparkSession, path: str, schema: T.StructType | str | None = None, header: bool = True) -> DataFrame:
    """A table by its path's suffix: parquet, orc, jsonl, json (one document), csv and tsv, also gzipped, xml, otherwise lines of text."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    kind = path.lower().removesuffix(".gz").rpartition(".")[2]
    if kind in ("parquet", "orc"):
        df = reader.format(kind).load(path)
        if provenance(df) and not _exists(spark, path + BESIDE):
            warnings.warn(f"provenance in the footer, but none beside the table: {path}", stacklevel=2)
        return df
    if kind in ("jsonl", "ndjson"):
        return reader.json(path)
    if kind == "json":
        return reader.option("multiLine", True).json(path)
    if kind == "tsv":
        return reader.csv(path, sep="\t", header=header)
    if kind == "csv":
        return reader.csv(path, sep=separator(spark, path), header=header, multiLine=True, escape='"')
    if kind == "xml":
        return reader.format("xml").option("rowTag", "row").load(path)
    return spark.read.text(path)


def write(df: DataFrame, path: str, mode: str = "error", **provenance: Any) -> None:
    """A table in the format of its suffix (Parquet without one).

    Provenance, and when, with which columns and how many rows it was written, goes into
    ``<path>.provenance.json`` beside it, and but for the rows, which are counted while
    they are written, into the footers of Parquet files, as metadata of the columns.
    """
    kind = path.lower().removesuffix(".gz").rpartition(".")[2]
    record = None
    if provenance:
        record = {"written_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "schema": df.schema.simpleString(), "columns": df.columns, **{k: v for k, v in provenance.items() if v is not None}}
    seen = Observation()
    out = with_provenance(df, record)
    writer = (out.observe(seen, F.count(F.lit(1)).alias("rows")) if record else out).write.mode(mode)
    if kind in ("jsonl", "ndjson", "json"):
        writer.json(path)
    elif kind in ("csv", "tsv"):
        writer.csv(path, sep="\t" if kind == "tsv" else ",", header=True)
    elif kind == "orc":
        writer.orc(path)
    else:
        writer.parquet(path)
    if record:
        record["rows"] = seen.get["rows"]
        df.sparkSession.createDataFrame([(json.dumps(record, sort_keys=True),)], "value string").coalesce(1).write.mode(mode).text(path + BESIDE)


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """``df``; raises ValueError if it lacks a column."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def first_column(df: DataFrame, *names: str, default: Any = None):
    """The first of several columns that a table of unstable schema has, as a coalesce over all that it has."""
    have = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*have, F.lit(default)) if have else F.lit(default)


def append_new(df: DataFrame, path: str, keys: Sequence[str], by: Sequence[str] = ()) -> int:
    """Appends the rows whose key the table at ``path`` lacks (without keys all rows), in folders ``by`` columns; so a stopped job can be run again. Returns the rows written.

    Of the table only keys are read, and of these only those that ``df`` has are kept and
    joined; rows are counted while they are written.  For a stream see ``incremental.ingest``,
    which doesn't read what is there.
    """
    spark = df.sparkSession
    if keys and _exists(spark, path):
        there = spark.read.parquet(path).select(*keys).join(df.select(*keys).distinct(), list(keys), "left_semi")
        df = df.join(there.distinct(), list(keys), "left_anti")
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("append").partitionBy(*by).parquet(path)
    return seen.get["rows"]


def within_envelope(df: DataFrame, date_column: str, dates: DataFrame, other: str, days: int = 30) -> DataFrame:
    """Rows within ``days`` of the span of another table's dates: two scalars, so that the filter reaches the scan."""
    low, high = dates.agg(F.min(other), F.max(other)).first()
    if low is None:
        return df.where(F.lit(False))
    return df.where(F.col(date_column).between(F.date_sub(F.lit(low), days), F.date_add(F.lit(high), days)))


def attendance_years(df: DataFrame) -> DataFrame:
    """id and its years (array), of an attendance table whose columns vary: rows marked absent are left out."""
    ident = first_column(df, "cons_id_str", "delegate_id", "unified_id").cast("string")
    present = first_column(df, "presence_value", "present", default="1").cast("string")
    year = first_column(df, "year").cast("string")
    dated = F.coalesce(first_column(df, "date", "session_date").cast("string"), first_column(df, "pattern").cast("string"))
    value = F.coalesce(F.nullif(F.regexp_extract(F.coalesce(year, F.lit("")), r"(\d{4})", 1), F.lit("")), F.nullif(F.regexp_extract(F.coalesce(dated, F.lit("")), r"(\d{4})", 1), F.lit("")))
    rows = df.select(ident.alias("id"), value.try_cast("int").alias("year"), F.lower(present).alias("present"))
    return rows.where("id is not null and year is not null").where(~F.col("present").isin("0", "0.0", "false", "absent", "")).groupBy("id").agg(F.array_sort(F.collect_set("year")).alias("years"))
