"""Ordered sequences as window expressions: axes, runs with tolerance, gaps, segments, brackets, stitching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordinal(rows: DataFrame, group: Sequence[str], *order: Column | str, name: str = "ordinal") -> DataFrame:
    """Positions from 0 within groups."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1)


def first_n(rows: DataFrame, group: Sequence[str], n: int, *order: Column | str) -> DataFrame:
    k = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("_k", k).where(F.col("_k") <= n).drop("_k")


def cumulative_axis(rows: DataFrame, group: Sequence[str], order: Sequence[str], length: str, gap: int = 0) -> DataFrame:
    """``char_start``: the lengths, and ``gap`` for each, of the rows before."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("char_start", F.coalesce(F.sum(F.coalesce(F.col(length), F.lit(0)) + gap).over(w), F.lit(0)).cast("long"))


def neighbour_median_drift(days: DataFrame, day: str, value: str, group: Sequence[str] = (), window: int = 3, threshold: float = 10, eligible: Column | None = None) -> DataFrame:
    """Each day against the median of the days within ``window`` calendar days, itself excluded.

    Adds neighbour_median, neighbour_count, abs_dev, drift_flag and drift_direction
    (spike, dip, none); only ``eligible`` days are flagged.  Neighbours are found by
    joining on the 2 x window shifted days.
    """
    shifts = F.array(*[F.lit(k) for k in range(-window, window + 1) if k])
    around = days.select(*group, F.col(day).alias("_d"), F.col(value).alias("_v"), F.explode(shifts).alias("_k")).select(*group, F.date_add("_d", F.col("_k")).alias(day), "_v")
    stats = around.where("_v is not null").groupBy(*group, day).agg(F.median("_v").alias("neighbour_median"), F.count("*").alias("neighbour_count"))
    out = days.join(stats, [*group, day], "left").withColumn("neighbour_count", F.coalesce("neighbour_count", F.lit(0)))
    out = out.withColumn("abs_dev", F.abs(F.col(value) - F.col("neighbour_median")))
    flag = F.coalesce(F.col("abs_dev") >= threshold, F.lit(False)) & (F.lit(True) if eligible is None else eligible)
    direction = F.when(flag & (F.col(value) > F.col("neighbour_median")), "spike").when(flag & (F.col(value) < F.col("neighbour_median")), "dip").otherwise("none")
    return out.withColumn("drift_flag", flag).withColumn("drift_direction", direction)


def run_lengths(rows: DataFrame, group: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Maximal runs of one value in order: group, run (from 1), value, n_rows, first and last of the first order column."""
    w = Window.partitionBy(*group).orderBy(*order)
    change = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    marked = rows.withColumn("_change", change).withColumn("run", F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*group, "run", value).agg(F.count("*").alias("n_rows"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))


def backward_steps(rows: DataFrame, group: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Per group: rows, steps, and steps on which the value falls."""
    before = F.lag(value).over(Window.partitionBy(*group).orderBy(*order))
    stepped = rows.withColumn("_before", before)
    return stepped.groupBy(*group).agg(F.count("*").alias("n_rows"), F.count("_before").alias("n_steps"), F.count_if(F.col(value) < F.col("_before")).alias("n_backward"))


def complementary_pairs(rows: DataFrame, group: Sequence[str], order: Sequence[str], deviation: str, least: float) -> DataFrame:
    """Adjacent rows whose deviations have opposite signs and are both ``least`` at least: the row and what came before it."""
    w = Window.partitionBy(*group).orderBy(*order)
    out = rows.withColumn("previous_deviation", F.lag(deviation).over(w))
    return out.where((F.col(deviation) * F.col("previous_deviation") < 0) & (F.least(F.abs(deviation), F.abs("previous_deviation")) >= least))


def solid_runs(days: DataFrame, day: str, solid: str, max_gap: int = 0, group: Sequence[str] = (), sums: Sequence[str] = ()) -> DataFrame:
    """Maximal runs of solid days that tolerate ``max_gap`` successive other days of the series; they begin and end solid.

    group, run, start_date, end_date, calendar_days, n_session_days, n_solid_days,
    n_non_solid_days, and the sums over all days of a run.  The gap counts days of the
    series, the length calendar days.
    """
    if max_gap < 0:
        raise ValueError("max_gap must not be negative")
    w = Window.partitionBy(*group).orderBy(day)
    up_to = w.rowsBetween(Window.unboundedPreceding, 0)
    numbered = days.withColumn("_k", F.row_number().over(w)).withColumns({f"_sum_{c}": F.sum(F.coalesce(F.col(c), F.lit(0))).over(up_to) for c in sums})
    kept = numbered.where(F.col(solid))
    apart = F.col("_k") - F.lag("_k").over(w) - 1
    run = F.sum(F.coalesce((apart > max_gap).cast("int"), F.lit(1))).over(up_to)
    out = kept.withColumn("run", run).groupBy(*group, "run").agg(
        F.min(day).alias("start_date"),
        F.max(day).alias("end_date"),
        (F.max("_k") - F.min("_k") + 1).cast("long").alias("n_session_days"),
        F.count("*").alias("n_solid_days"),
        *[(F.max(f"_sum_{c}") - F.min(F.col(f"_sum_{c}") - F.coalesce(F.col(c), F.lit(0)))).alias(f"{c}_in_run") for c in sums],
    )
    return out.withColumn("calendar_days", (F.datediff("end_date", "start_date") + 1).cast("long")).withColumn("n_non_solid_days", F.col("n_session_days") - F.col("n_solid_days"))


#: Lengths from which runs are counted, the main one, and the target of spans and days at it.
RUN_LENGTHS, MAIN_LENGTH, TARGET = (7, 14, 30, 60), 30, (6, 180)


def run_summary(runs: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """n_runs, longest_calendar_days, at each of RUN_LENGTHS the spans and the days covered, and whether TARGET is met."""
    at = []
    for n in RUN_LENGTHS:
        long = F.col("calendar_days") >= n
        at += [F.count_if(long).alias(f"n_spans_{n}"), F.coalesce(F.sum(F.when(long, F.col("calendar_days"))), F.lit(0)).cast("long").alias(f"days_{n}")]
    out = runs.groupBy(*group).agg(F.count("*").alias("n_runs"), F.coalesce(F.max("calendar_days"), F.lit(0)).alias("longest_calendar_days"), *at)
    return out.withColumn("target_met", (F.col(f"n_spans_{MAIN_LENGTH}") >= TARGET[0]) & (F.col(f"days_{MAIN_LENGTH}") >= TARGET[1]))


def solid_gaps(days: DataFrame, day: str, solid: str, kind: str, kinds: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """The gaps between successive solid days: left and right date, days of the series and of the calendar between, dominant_class.

    The dominant class is the most frequent ``kind`` of the days between, of equals the
    first in ``kinds``; ``adjacent_solid`` if there are none.  Days before the first and
    after the last solid day belong to no gap.
    """
    w = Window.partitionBy(*group).orderBy(day)
    up_to = w.rowsBetween(Window.unboundedPreceding, 0)
    after = w.rowsBetween(1, Window.unboundedFollowing)
    marked = days.withColumn("_left", F.last(F.when(F.col(solid), F.col(day)), ignorenulls=True).over(up_to)).withColumn("_right", F.first(F.when(F.col(solid), F.col(day)), ignorenulls=True).over(after))
    inside = marked.where("_left is not null and _right is not null")
    label = F.coalesce(F.col(kind), F.lit("other"))
    counts = inside.where(~F.col(solid)).groupBy(*group, "_left", "_right", label.alias("_class")).agg(F.count("*").alias("_n"))
    rank = F.coalesce(*[F.when(F.col("_class") == k, F.lit(i)) for i, k in enumerate(kinds)], F.lit(99))
    best = counts.groupBy(*group, "_left", "_right").agg(F.min(F.struct((-F.col("_n")).alias("n"), rank.alias("r"), F.col("_class").alias("c")))["c"].alias("_best"), F.sum("_n").alias("_total"))
    pairs = inside.where(F.col(solid)).select(*group, "_left", "_right")
    out = pairs.join(best, [*group, "_left", "_right"], "left")
    return out.select(
        *group,
        F.col("_left").alias("left_date"),
        F.col("_right").alias("right_date"),
        F.coalesce("_total", F.lit(0)).cast("long").alias("n_between"),
        (F.datediff("_right", "_left") - 1).cast("long").alias("calendar_gap_days"),
        F.coalesce("_best", F.lit("adjacent_solid")).alias("dominant_class"),
    )


def runs_under_bridge(days: DataFrame, day: str, solid: str, kind: str, bridged: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Gapless solid runs as if other days of the ``bridged`` kinds weren't in the series."""
    kept = days.where(F.col(solid) | ~F.coalesce(F.col(kind).isin(*bridged), F.lit(False)))
    return solid_runs(kept, day, solid, 0, group)


def landmark_segments(rows: DataFrame, group: Sequence[str], order: Sequence[str], landmark: str, isolate: str | None = None) -> DataFrame:
    """Rows with ``segment``, which begins anew at each landmark; with ``isolate`` such rows are segments of their own."""
    w = Window.partitionBy(*group).orderBy(*order)
    begins = F.col(landmark)
    if isolate:
        begins = begins | F.col(isolate) | F.coalesce(F.lag(isolate).over(w), F.lit(False))
    marked = rows.withColumn("_begins", F.coalesce(begins, F.lit(False)).cast("int"))
    return marked.withColumn("segment", F.sum("_begins").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_begins")


def pin_brackets(rows: DataFrame, group: Sequence[str], order: Sequence[str], pin: str) -> DataFrame:
    """The gaps between successive pins of a sequence: left_pin, right_pin, n_items between, n_slots between, and their class.

    tight: none of either; determined: as many slots as items; deficit: fewer slots;
    surplus: more; non_monotone: the right pin isn't after the left one; an open end
    is ``head`` or ``tail``.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    up_to = w.rowsBetween(Window.unboundedPreceding, 0)
    block = F.count(F.col(pin)).over(up_to)
    marked = rows.withColumn("_block", block)
    per = marked.groupBy(*group, "_block").agg(F.max(pin).alias("left_pin"), F.count_if(F.col(pin).isNull()).alias("n_items"))
    per = per.withColumn("right_pin", F.lead("left_pin").over(Window.partitionBy(*group).orderBy("_block")))
    slots = F.col("right_pin") - F.col("left_pin") - 1
    kind = (
        F.when(F.col("left_pin").isNull(), "head")
        .when(F.col("right_pin").isNull(), "tail")
        .when(slots < 0, "non_monotone")
        .when((slots == 0) & (F.col("n_items") == 0), "tight")
        .when(slots == F.col("n_items"), "determined")
        .when(slots < F.col("n_items"), "deficit")
        .otherwise("surplus")
    )
    return per.select(*group, F.col("_block").alias("bracket"), "left_pin", "right_pin", "n_items", slots.alias("n_slots"), kind.alias("bracket_class"))


def forced_pairs(items: DataFrame, slots: DataFrame, keys: Sequence[str], item_order: Sequence[str], slot_order: Sequence[str]) -> DataFrame:
    """Items and slots of each key paired by position."""
    a = items.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*item_order)))
    b = slots.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*slot_order)))
    return a.join(b, [*keys, "_k"]).drop("_k")


def known_point_gaps(points: DataFrame, group: Sequence[str], item: str, slot: str, items: str, slots: str) -> DataFrame:
    """Counted gaps of a chain of known points with sentinels (-1, -1) and (items, slots): from and to, and what lies between.

    ``points`` has a row for each point (a null item for a group without any), and the
    group's numbers of items and slots.
    """
    ends = points.select(*group, items, slots).distinct()
    chain = points.where(F.col(item).isNotNull()).select(*group, F.col(item).alias("i"), F.col(slot).alias("s"))
    chain = chain.unionByName(ends.select(*group, F.lit(-1).alias("i"), F.lit(-1).alias("s"))).unionByName(ends.select(*group, F.col(items).alias("i"), F.col(slots).alias("s"))).distinct()
    w = Window.partitionBy(*group).orderBy("i", "s")
    stepped = chain.select("*", F.lead("i").over(w).alias("next_i"), F.lead("s").over(w).alias("next_s")).where("next_i is not null")
    return stepped.select(*group, "i", "s", "next_i", "next_s", (F.col("next_i") - F.col("i") - 1).alias("n_items"), (F.col("next_s") - F.col("s") - 1).alias("n_slots"))


def stitch(rows: DataFrame, group: Sequence[str], order: Sequence[str], text: str, continues: Column) -> DataFrame:
    """Fragments joined to the one before while ``continues`` holds; a group's first row always begins one: group, stitched, text, n_fragments."""
    w = Window.partitionBy(*group).orderBy(*order)
    begins = (~F.coalesce(continues, F.lit(False)) | (F.row_number().over(w) == 1)).cast("int")
    marked = rows.withColumn("_begins", begins).withColumn("stitched", F.sum("_begins").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    items = F.array_sort(F.collect_list(F.struct(*order, F.coalesce(text, F.lit("")).alias("_t"))))
    return marked.groupBy(*group, "stitched").agg(F.array_join(F.transform(items, lambda x: x["_t"]), " ").alias(text), F.count("*").alias("n_fragments"))


def anchor_dates(days: DataFrame, day: str, anchor: str, group: Sequence[str] = ()) -> DataFrame:
    """A row for each calendar day from the first to the last anchored day, with the anchor that holds, and the next one."""
    w = Window.partitionBy(*group).orderBy(day)
    known = days.where(F.col(anchor).isNotNull()).select(*group, day, anchor, F.lead(day).over(w).alias("_next"), F.lead(anchor).over(w).alias("next_anchor"))
    until = F.coalesce(F.date_sub("_next", 1), F.col(day))
    spread = known.withColumn("_day", F.explode(F.sequence(F.col(day), until)))
    return spread.select(*group, F.col("_day").alias(day), anchor, "next_anchor", F.datediff("_day", day).alias("days_since"))
