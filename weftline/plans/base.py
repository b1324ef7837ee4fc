"""What the query modules share: registration, tables, and the projection of the standard tables onto the domain."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its own name, with the SQL that must give the same rows."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokens(df: DataFrame, key: str, text: str = "text", least: int = 3) -> DataFrame:
    """key, term: distinct words of ``least`` characters or more, in lower case, split at what isn't a letter or digit of ASCII or beyond."""
    words = F.split(F.lower(F.col(text)), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return df.select(key, F.explode(F.array_distinct(words)).alias("term")).where(F.length("term") >= least)


#: The same in SQL, of a table with a key and a text.
def tokens_sql(name: str, key: str, least: int = 3) -> str:
    return f"(SELECT DISTINCT {key}, term FROM (SELECT {key}, unnest(string_split_regex(lower(text), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS term FROM {name}) WHERE length(term) >= {least})"


#: Sessions: conversations with their turns in order; items that begin in lower case go on with the turn before.
DAY = "CAST(o_orderdate AS DATE)"
