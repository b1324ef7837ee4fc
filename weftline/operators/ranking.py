"""Top-k, seeded samples and splits, all with total orders."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.ordered import running_totals


def top_k(rows: DataFrame, group: Sequence[str], k: int, score: str, *ties: Column | str) -> DataFrame:
    """The k best-scored rows of each group with ``rank`` from 1; Spark keeps k of a group in a task before it shuffles."""
    n = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(score), *ties))
    return rows.withColumn("rank", n).where(F.col("rank") <= k)


def wide(ranked: DataFrame, keys: Sequence[str], k: int, candidate: str, score: str) -> DataFrame:
    """One row for each key with cand_1 ... cand_k and score_1 ... score_k."""
    cells = []
    for i in range(1, k + 1):
        cells += [F.max(F.when(F.col("rank") == i, F.col(candidate))).alias(f"cand_{i}"), F.coalesce(F.max(F.when(F.col("rank") == i, F.col(score))), F.lit(0.0)).alias(f"score_{i}")]
    return ranked.groupBy(*keys).agg(*cells)


def natural_order(identifier: str) -> list[Column]:
    """Sort keys of an id by its numbers, then the id itself."""
    numbers = F.regexp_extract_all(identifier, F.lit(r"(\d+)"), F.lit(1))
    return [F.transform(numbers, lambda x: x.try_cast("long")), F.col(identifier)]


def seeded(key: str, seed: str) -> Column:
    """A pseudo-random order that other engines can repeat: MD5 of seed and key."""
    return F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))


def stratified_pick(rows: DataFrame, stratum: str, key: str, quotas: Mapping[str, int] | int, seed: str = "") -> DataFrame:
    """The first rows of each stratum by seeded order, up to its quota; strata without one have none."""
    n = F.row_number().over(Window.partitionBy(stratum).orderBy(seeded(key, seed), key))
    if isinstance(quotas, int):
        limit = F.lit(quotas)
    else:
        limit = F.coalesce(*[F.when(F.col(stratum) == s, F.lit(q)) for s, q in quotas.items()], F.lit(0))
    return rows.withColumn("_n", n).where(F.col("_n") <= limit).drop("_n")


def hash_split(rows: DataFrame, key: str, shares: Sequence[tuple[str, float]], seed: str = "") -> DataFrame:
    """Rows with ``split``, by the key alone, so that a key's rows stay together."""
    x = F.conv(F.substring(seeded(key, seed), 1, 8), 16, 10).cast("double") / float(1 << 32)
    out, upto = F.lit(None).cast("string"), 0.0
    for name, share in shares:
        upto += share
        out = F.coalesce(out, F.when(x < upto, F.lit(name)))
    return rows.withColumn("split", F.coalesce(out, F.lit(shares[-1][0])))


def leaking_keys(rows: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys that are in more than one split; a sound split has none."""
    return rows.groupBy(key).agg(F.count_distinct(split).alias("n_splits")).where("n_splits > 1")


def held_out(rows: DataFrame, group: Sequence[str], divergence: str, key: str, share: float = 0.3) -> DataFrame:
    """Rows with ``held_out``: of each group the most divergent, a share rounded half-even, one at least."""
    w = Window.partitionBy(*group)
    n = F.row_number().over(w.orderBy(F.desc(divergence), key))
    most = F.greatest(F.lit(1), F.bround(F.count("*").over(w) * share, 0).cast("long"))
    return rows.withColumn("held_out", n <= most)


def chronological_split(rows: DataFrame, date: str, key: str, train: float = 0.7, validate: float = 0.15) -> DataFrame:
    """Rows with ``split`` train, dev or test by position after sorting by date and key: the first floor(train n), the next floor(validate n), the rest.

    Positions come from counts per date, so that no task sorts all rows: only ties within a date are ranked.
    """
    per = rows.groupBy(F.col(date).alias("_date")).agg(F.count("*").alias("_n"))
    starts = running_totals(per, ["_date"], {"_before": "_n"}).crossJoin(F.broadcast(per.agg(F.sum("_n").alias("_total"))))
    placed = rows.join(starts, F.col(date).eqNullSafe(F.col("_date")))
    k = F.col("_before") + F.row_number().over(Window.partitionBy(date).orderBy(key)) - 1
    a, b = F.floor(F.col("_total") * train), F.floor(F.col("_total") * validate)
    return placed.withColumn("_k", k).withColumn("split", F.when(F.col("_k") < a, "train").when(F.col("_k") < a + b, "dev").otherwise("test")).drop("_k", "_before", "_date", "_total")


def gate(rows: DataFrame, baseline: str, candidate: str) -> DataFrame:
    """Head to head on held-out rows: counts of rows each is right on, and whether the candidate is right at least as often."""
    out = rows.agg(F.count("*").alias("n"), F.count_if(baseline).alias("baseline_right"), F.count_if(candidate).alias("candidate_right"))
    return out.withColumn("passes", F.col("candidate_right") >= F.col("baseline_right"))
