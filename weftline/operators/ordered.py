"""Orders over a whole table without one task that sorts it: range partitions, their totals, and what is within them."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints, which all machines share: the one that the session names; in local mode one of its own will do."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        spark.sparkContext.setCheckpointDir(where or tempfile.mkdtemp(prefix="weftline-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def running_totals(rows: DataFrame, order: Sequence[str], totals: dict[str, str | Column]) -> DataFrame:
    """``rows`` with, for each new column of ``totals``, the sum of its expression over all rows before in ``order`` (nulls first), 0 for the first.

    Rows of equal order are summed in any order among themselves: make it unique.  Each
    range of the order is summed in its own task; of each range only its totals, a row,
    reach the driver, which adds them up.
    """
    parts = {f"_t{k}": F.col(x) if isinstance(x, str) else x for k, x in enumerate(totals.values())}
    ranged = cut(rows.withColumns(parts).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sums = {r["_part"]: r for r in ranged.groupBy("_part").agg(*[F.sum(c).alias(c) for c in parts]).collect()}
    offsets, so_far = [], {c: 0 for c in parts}
    for part in sorted(sums):
        offsets.append((part, *so_far.values()))
        so_far = {c: x + (sums[part][c] or 0) for c, x in so_far.items()}
    kinds = dict(ranged.groupBy("_part").agg(*[F.sum(c).alias(c) for c in parts]).dtypes)
    schema = "_part int, " + ", ".join(f"{c}_before {kinds[c]}" for c in parts)
    before = F.broadcast(rows.sparkSession.createDataFrame(offsets, schema))  # a row for each range
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = ranged.join(before, "_part").withColumns({out: F.coalesce(F.sum(c).over(w), F.lit(0)) + F.col(f"{c}_before") for out, c in zip(totals, parts, strict=True)})
    return within.drop("_part", *parts, *[f"{c}_before" for c in parts])


def greater_before(rank: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each element the weight of those before it whose rank (distinct, below their number) is greater.

    Two ranks part at the highest bit in which they differ: the greater has it.  So for
    each bit, among elements alike above it, those without it count those with it before them.
    """
    out = np.zeros(len(rank), dtype=np.int64)
    for bit in range(max(0, len(rank) - 1).bit_length()):
        block = rank >> (bit + 1)
        order = np.argsort(block, kind="stable")
        has = (rank[order] >> bit & 1).astype(bool)
        seen = np.cumsum(np.where(has, weight[order], 0))
        start = np.flatnonzero(np.concatenate(([True], block[order][1:] != block[order][:-1])))
        base = np.repeat(np.where(start > 0, seen[start - 1], 0), np.diff(np.append(start, len(order))))
        out[order] += np.where(has, 0, seen - base)
    return out


def _rank(*keys: np.ndarray) -> np.ndarray:
    """Each row's place in the order of the keys, the first one the most important."""
    order = np.lexsort(keys[::-1])
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.arange(len(order))
    return out


def _crossed(frame: pd.DataFrame, group: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each row how much weight of its group is at a smaller x and a greater y."""
    at = _rank(group, x, y)
    order = np.argsort(at, kind="stable")
    above = _rank(group, y, x)
    out = np.empty(len(frame), dtype=np.int64)
    out[order] = greater_before(above[order], frame["_w"].to_numpy()[order])
    return out


def discordant_pairs(points: DataFrame, group: Sequence[str], x: str, y: str, weight: str) -> DataFrame:
    """group, discordant: of each group's distinct points, each ``weight`` times, the pairs with a smaller x and a greater y.

    Ranges of x are taken apart in their own tasks, and then ranges of y; of pairs that
    share neither, the cells (range of x, range of y) know enough.  So no pair is made,
    and no task holds more than a range, or a group's cells.  Groups are told apart by 64-bit hashes.
    """
    names = [f"_g{k}" for k in range(len(group))]
    key = F.struct(*[F.lit(0)], *[F.col(g) for g in group])
    own = points.select(F.xxhash64(key).alias("_h"), *[F.col(g).alias(n) for g, n in zip(group, names, strict=True)], F.col(x).alias("_x"), F.col(y).alias("_y"), F.col(weight).cast("long").alias("_w"))
    kinds = dict(own.dtypes)
    by_group = ", ".join(["_h bigint", *[f"{n} {kinds[n]}" for n in names]])

    def whole(frames: Iterator[pd.DataFrame]) -> pd.DataFrame | None:
        got = [f for f in frames if len(f)]
        return pd.concat(got, ignore_index=True) if got else None

    def codes(frame: pd.DataFrame, column: str) -> np.ndarray:
        return np.unique(frame[column].to_numpy(), return_inverse=True)[1]

    def by_x(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        if (frame := whole(frames)) is not None:
            crossed = _crossed(frame, codes(frame, "_h"), codes(frame, "_x"), codes(frame, "_y"))
            yield frame.assign(_p=TaskContext.get().partitionId(), _d=crossed * frame["_w"].to_numpy())

    def by_y(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        if (frame := whole(frames)) is not None:
            h, p, a, b = codes(frame, "_h"), frame["_p"].to_numpy().astype(np.int64), codes(frame, "_x"), codes(frame, "_y")
            # pairs of this range of y, but for those that were in one range of x
            cell = h * (p.max() + 1) + p
            crossed = _crossed(frame, h, a, b) - _crossed(frame, cell, a, b)
            frame = frame.assign(_d=frame["_d"] + crossed * frame["_w"].to_numpy(), _q=TaskContext.get().partitionId())
            yield frame.groupby(["_h", *names, "_p", "_q"], dropna=False, as_index=False)[["_w", "_d"]].sum()[["_h", *names, "_p", "_q", "_w", "_d"]]

    def by_cell(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if (frame := whole(frames)) is not None:
            # cells of one range of x, or of y, are done: only those apart in both are counted here
            crossed = _crossed(frame, codes(frame, "_h"), frame["_p"].to_numpy(), frame["_q"].to_numpy())
            frame = frame.assign(_d=frame["_d"] + crossed * frame["_w"].to_numpy())
            yield frame.groupby(["_h", *names], dropna=False, as_index=False)["_d"].sum()[["_h", *names, "_d"]]

    ranged = cut(own.repartitionByRange("_h", "_x", "_y").mapInPandas(by_x, f"{by_group}, _x {kinds['_x']}, _y {kinds['_y']}, _w long, _p int, _d long"))
    cells = cut(ranged.repartitionByRange("_h", "_y", "_x").mapInPandas(by_y, f"{by_group}, _p int, _q int, _w long, _d long"))
    sums = cells.repartition("_h").mapInPandas(by_cell, f"{by_group}, _d long")
    return sums.groupBy(*names).agg(F.sum("_d").alias("discordant")).select(*[F.col(n).alias(g) for n, g in zip(names, group, strict=True)], "discordant")
