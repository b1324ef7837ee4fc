"""Aggregations: weights, correlations, effect sizes, summaries and ceilings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.ordered import cut, discordant_pairs, running_totals


def idf_weights(rows: DataFrame, name: str, smoothed: bool = False) -> DataFrame:
    """name, frequency, idf = ln(rows / frequency), null names being rows too; smoothed: ln((rows + 1) / (frequency + 1)) + 1.

    The number of rows is the sum of the frequencies: no second scan.
    """
    counts = rows.groupBy(name).agg(F.count("*").alias("frequency"))
    total = counts.agg(F.sum("frequency").alias("_rows"))
    f = F.col("frequency")
    idf = F.ln((F.col("_rows") + 1) / (f + 1)) + 1 if smoothed else F.ln(F.col("_rows") / f)
    return counts.where(F.col(name).isNotNull()).crossJoin(F.broadcast(total)).select(name, "frequency", idf.alias("idf"))


def ordered_text(rows: DataFrame, group: Sequence[str], order: Sequence[str], text: str, glue: str = " ") -> DataFrame:
    """The texts of each group in order, joined; nulls are left out."""
    items = F.array_sort(F.collect_list(F.struct(*order, text)))
    return rows.where(F.col(text).isNotNull()).groupBy(*group).agg(F.array_join(F.transform(items, lambda x: x[text]), glue).alias(text), F.count("*").alias("n_parts"))


def ordered_unique(column: str) -> Column:
    """Aggregate: the sorted distinct values."""
    return F.array_sort(F.collect_set(column))


def most_frequent(rows: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """The most frequent value of each group, of equally frequent ones the smallest; and its count."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("n"))
    n = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("n"), value) if group else Window.orderBy(F.desc("n"), value))
    return counts.withColumn("_n", n).where("_n = 1").drop("_n")


def share(condition: Column) -> Column:
    """Aggregate: the share of rows for which a condition holds, nulls counting as not; null without rows."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def quantile_at(column: str, q: float) -> Column:
    """Aggregate: the value at index floor(q * n), capped, of the sorted values."""
    values = F.array_sort(F.collect_list(column))
    return F.try_element_at(values, F.least(F.floor(F.size(values) * q).cast("int") + 1, F.size(values)))


def average_ranks(rows: DataFrame, column: str, out: str, group: Sequence[str] = ()) -> DataFrame:
    """Ranks from 1, tied values sharing their mean rank."""
    by = Window.partitionBy(*group).orderBy(column)
    same = Window.partitionBy(*group, column)
    return rows.withColumn(out, F.rank().over(by) + (F.count("*").over(same) - 1) / 2.0)


def correlations(rows: DataFrame, x: str, y: str) -> DataFrame:
    """n, pearson and spearman of the rows where neither is null.  Ranks come from counts of distinct values, summed up by ranges: no task sorts all of them."""
    pairs = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))

    def ranks(c: str) -> DataFrame:
        counts = running_totals(pairs.groupBy(c).agg(F.count("*").alias("n")), [c], {"before": "n"})
        return counts.select(c, (F.col("before") + (F.col("n") + 1) / 2.0).alias(f"r{c}"))

    ranked = pairs.join(ranks("x"), "x").join(ranks("y"), "y")
    return ranked.agg(F.count("*").alias("n"), F.corr("x", "y").alias("pearson"), F.corr("rx", "ry").alias("spearman"))


def lag1_autocorrelation(rows: DataFrame, order: str, value: str, group: Sequence[str] = ()) -> DataFrame:
    """The correlation of a series with itself one step later."""
    before = F.lag(value).over(Window.partitionBy(*group).orderBy(order))
    lagged = rows.withColumn("_before", before).where("_before is not null")
    return lagged.groupBy(*group).agg(F.corr(F.col(value).cast("double"), F.col("_before").cast("double")).alias("lag1"), F.count("*").alias("n"))


def kendall_tau(rows: DataFrame, group: Sequence[str], x: str, y: str) -> DataFrame:
    """Kendall's tau-b within groups: pairs, concordant, discordant, tau; null where a side is all ties.

    Rows with a null x or y take no part, and a group of one row has no result.  Equal rows
    are counted first; the rest is counting of inversions, n log n in all, by ranges.
    """
    points = cut(rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*group, F.col(x).alias("_px"), F.col(y).alias("_py")).groupBy(*group, "_px", "_py").agg(F.count("*").alias("_n")))

    def tied(by: Sequence[str], out: str) -> DataFrame:
        sizes = points.groupBy(*group, *by).agg(F.sum("_n").alias("_m"))
        return sizes.groupBy(*group).agg(F.sum(F.expr("_m * (_m - 1) div 2")).alias(out))

    out = tied([], "pairs").where("pairs > 0")
    for by, name in ((["_px"], "_tx"), (["_py"], "_ty"), (["_px", "_py"], "_txy")):
        out = _beside(out, tied(by, name), group)
    out = _beside(out, discordant_pairs(points, group, "_px", "_py", "_n"), group)
    concordant = F.col("pairs") - F.col("_tx") - F.col("_ty") + F.col("_txy") - F.col("discordant")
    root = F.sqrt((F.col("pairs") - F.col("_tx")).cast("double") * (F.col("pairs") - F.col("_ty")).cast("double"))
    return out.withColumn("concordant", concordant).select(*group, "pairs", "concordant", "discordant", F.when(root > 0, (F.col("concordant") - F.col("discordant")) / root).alias("tau"))


def _beside(a: DataFrame, b: DataFrame, group: Sequence[str]) -> DataFrame:
    """Columns of both, by groups, of which nulls are one too."""
    b = b.withColumnsRenamed({g: f"_b{k}" for k, g in enumerate(group)})
    same = F.lit(True)
    for k, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_b{k}"))
    return a.join(b, same).drop(*[f"_b{k}" for k in range(len(group))])


def effect_size(rows: DataFrame, label: str, value: str) -> DataFrame:
    """Positive (label 1) against negative (label 0) values: counts, medians, common-language effect size and the best Youden threshold.

    The effect size is the chance that a positive value exceeds a negative one, ties
    half, from counts of distinct values; the threshold is the smallest value with the
    largest J = true positives' share less false positives' share of values >= it.
    """
    known = rows.where(F.col(label).isin(0, 1) & F.col(value).isNotNull())
    counts = known.groupBy(F.col(value).alias("v")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q"))
    steps = running_totals(counts, ["v"], {"p_below": "p", "q_below": "q"})
    totals = counts.agg(F.sum("p").alias("np"), F.sum("q").alias("nq"))
    scored = steps.crossJoin(F.broadcast(totals)).withColumn("j", (F.col("np") - F.col("p_below")) / F.col("np") - (F.col("nq") - F.col("q_below")) / F.col("nq"))
    return scored.agg(
        F.max("np").alias("n_positive"),
        F.max("nq").alias("n_negative"),
        (F.sum(F.col("p") * (F.col("q_below") + F.col("q") / 2.0)) / (F.max("np") * F.max("nq"))).alias("effect_size"),
        F.max("j").alias("youden_j"),
        F.max_by("v", F.struct("j", -F.col("v"))).alias("threshold"),
    )


def date_difference_summary(rows: DataFrame, difference: str, group: Sequence[str] = ()) -> DataFrame:
    """n, shares of differences of 0 and of at most 1, 3 and 7 days, mean, median and maximum of the absolute difference."""
    d = F.abs(F.col(difference))
    return (
        rows.where(F.col(difference).isNotNull())
        .groupBy(*group)
        .agg(
            F.count("*").alias("n"),
            share(d == 0).alias("same_day"),
            *[share(d <= k).alias(f"within_{k}") for k in (1, 3, 7)],
            F.avg(d).alias("mean_days"),
            F.median(d).alias("median_days"),
            F.max(d).alias("max_days"),
        )
    )


def pigeonhole_ceiling(days: DataFrame, items: str, slots: str, group: Sequence[str] = ()) -> DataFrame:
    """How many items can stand alone: the sum over days of the smaller of items and slots, the items, the share, and days without slots."""
    least = F.least(F.coalesce(items, F.lit(0)), F.coalesce(slots, F.lit(0)))
    out = days.groupBy(*group).agg(F.sum(least).alias("ceiling"), F.sum(items).alias("items"), F.count_if(F.coalesce(slots, F.lit(0)) == 0).alias("days_without_slots"))
    return out.withColumn("ceiling_share", F.try_divide("ceiling", "items"))


def pigeonhole_floor(items: Column, slots: Column) -> Column:
    """How many items the fullest slot must hold at least."""
    return F.ceil(F.try_divide(items, slots))


def edge_weights(edges: DataFrame, keys: Sequence[str] = ("src", "dst", "type", "source"), weight: str = "weight") -> DataFrame:
    """The summed weight and the number of equal edges."""
    return edges.groupBy(*keys).agg(F.sum(weight).alias(weight), F.count("*").alias("n"))


def coverage_grid(facts: DataFrame, rows: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """A count for each combination of the rows' and the columns' values that occur, zero where none: dimensions, not facts, are crossed."""
    counts = facts.groupBy(*rows, *columns).agg(F.count("*").alias("n"))
    grid = facts.select(*rows).distinct().crossJoin(facts.select(*columns).distinct())
    return grid.join(counts, [*rows, *columns], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def bucket_shares(rows: DataFrame, bucket: str, weight: str) -> DataFrame:
    """Of each bucket its rows and weight, and the shares of both in the whole."""
    sums = rows.groupBy(bucket).agg(F.count("*").alias("gaps"), F.sum(weight).alias("items"))
    whole = sums.agg(F.sum("gaps").alias("_g"), F.sum("items").alias("_i"))
    return sums.crossJoin(F.broadcast(whole)).select(bucket, "gaps", "items", F.try_divide("gaps", "_g").alias("gap_share"), F.try_divide("items", "_i").alias("item_share"))


def verdict_summary(pairs: DataFrame, verdicts: DataFrame, key: str, verdict: str, score: str) -> DataFrame:
    """Counts and mean scores by verdict, pairs without one as ``unjudged`` and verdicts without a pair as ``orphan``."""
    joined = pairs.select(key, score).join(verdicts.select(key, verdict).withColumn("_v", F.lit(True)), key, "full_outer")
    label = F.when(F.col(score).isNull(), "orphan").when(F.col("_v").isNull(), "unjudged").otherwise(F.col(verdict).cast("string"))
    return joined.groupBy(label.alias("verdict")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"))


def labelled_union(**views: DataFrame) -> DataFrame:
    """Several views of like columns as one, with ``source``, the view's name."""
    out = None
    for name, df in views.items():
        part = df.withColumn("source", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def structure_evidence_grid(rows: DataFrame, structured: Column, evidence: Column) -> DataFrame:
    """structure (yes, no) by evidence (none, some, strong: 0, 1 to 2, 3 and more): n."""
    s, e = F.when(structured, "yes").otherwise("no"), F.when(F.coalesce(evidence, F.lit(0)) <= 0, "none").when(evidence <= 2, "some").otherwise("strong")
    return rows.groupBy(s.alias("structure"), e.alias("evidence")).agg(F.count("*").alias("n"))
