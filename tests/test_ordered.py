"""Ranks, running totals and pair counts by ranges of an order: against all pairs, and without one task for all."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import aggregates, ordered, ranking


def _tau(points):
    concordant = discordant = tx = ty = 0
    for k, (x1, y1) in enumerate(points):
        for x2, y2 in points[:k]:
            s = (x1 - x2) * (y1 - y2)
            concordant, discordant, tx, ty = concordant + (s > 0), discordant + (s < 0), tx + (x1 == x2), ty + (y1 == y2)
    pairs = len(points) * (len(points) - 1) // 2
    root = ((pairs - tx) * (pairs - ty)) ** 0.5
    return pairs, concordant, discordant, pytest.approx((concordant - discordant) / root) if root else None


def test_tau_is_that_of_all_pairs(spark):
    rng = random.Random(9)
    groups = {g: [(rng.randint(0, size), rng.randint(0, size)) for _ in range(rng.randint(1, 70))] for g, size in [("a", 3), ("b", 50), (None, 9), ("d", 0), ("e", 1000)]}
    rows = [(g, x, y) for g, own in groups.items() for x, y in own] + [("a", None, 1), ("f", 1, None), ("g", 1, 1)]
    got = {r.g: r[1:] for r in aggregates.kendall_tau(spark.createDataFrame(rows, "g string, x int, y int").repartition(5), ["g"], "x", "y").collect()}
    assert got == {g: _tau(own) for g, own in groups.items() if len(own) > 1}


def test_tau_of_a_million_rows(spark):
    rows = spark.range(1_000_000).select(F.lit(1).alias("g"), "id", (F.lit(1_000_000) - F.col("id") + F.when(F.col("id") % 2 == 0, 2).otherwise(0)).alias("y"))
    out = aggregates.kendall_tau(rows, ["g"], "id", "y").first()
    # an even row has the value of the odd one two before it, or next to it, and so on: counted by numpy
    y = 1_000_000 - np.arange(1_000_000) + np.where(np.arange(1_000_000) % 2 == 0, 2, 0)
    rank = np.argsort(np.lexsort((np.arange(len(y)), y)), kind="stable")
    assert out.discordant == int(ordered.greater_before(rank, np.ones(len(y), dtype=np.int64)).sum())
    assert out.pairs == 1_000_000 * 999_999 // 2 and -1 <= out.tau < -0.99


def test_greater_before_counts_inversions():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 17, 64, 100):
        rank, weight = rng.permutation(n), rng.integers(1, 5, n)
        assert ordered.greater_before(rank, weight).tolist() == [int(weight[:k][rank[:k] > rank[k]].sum()) for k in range(n)]


def test_running_totals_over_ranges(spark):
    rows = spark.createDataFrame([(k * 7 % 101, k) for k in range(101)] + [(None, 1000)], "o int, v int").repartition(7)
    got = {r.o: (r.before, r.rank) for r in ordered.running_totals(rows, ["o"], {"before": "v", "rank": F.lit(1)}).collect()}
    so_far = 0
    for rank, (o, v) in enumerate([(None, 1000), *sorted((k * 7 % 101, k) for k in range(101))]):
        assert got[o] == (so_far, rank)
        so_far += v
    assert ordered.running_totals(rows.limit(0), ["o"], {"before": "v"}).isEmpty()


@pytest.mark.parametrize("plan", ["correlations", "effect_size", "chronological_split"])
def test_no_window_takes_all_rows_in_one_task(spark, plan):
    rows = spark.range(1000).select("id", (F.col("id") % 2).alias("label"), (F.col("id") % 37).alias("v"))
    out = {"correlations": lambda: aggregates.correlations(rows, "id", "v"), "effect_size": lambda: aggregates.effect_size(rows, "label", "v"), "chronological_split": lambda: ranking.chronological_split(rows, "v", "id")}[plan]()
    lines = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    windows = [line for line in lines if "Window [" in line]
    # what is computed, by what it is parted, and how it is ordered
    assert windows and all(line.count("], [") == 2 for line in windows)
