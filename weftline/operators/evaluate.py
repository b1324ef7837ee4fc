"""Metrics that judge placements, links and spans."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.ordered import cut

#: Paragraphs an item may extend over, and the share of a day's items that must stand apart.
MOST_EXTENT, SOLID_SHARE = 3, 0.5


def _scores(tp: Column, n_ref: Column, n_hyp: Column) -> dict[str, Column]:
    """Precision, recall and F1; all 1 where both sides are empty, 0 where one is."""
    empty = (n_ref == 0) & (n_hyp == 0)
    p, r = F.coalesce(F.try_divide(tp, n_hyp), F.lit(0.0)), F.coalesce(F.try_divide(tp, n_ref), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2.0 * tp, n_ref + n_hyp), F.lit(0.0))
    return {k: F.when(empty, 1.0).otherwise(v) for k, v in (("precision", p), ("recall", r), ("f1", f1))}


def boundary_scores(ref: DataFrame, hyp: DataFrame, groups: DataFrame, group: Sequence[str], position: str) -> DataFrame:
    """Exact boundary scores of each group: tp, fp, fn, precision, recall, f1, exact_count. Repeated positions match as often as both sides have them."""
    g = list(group)
    a, b = ref.groupBy(*g, position).agg(F.count("*").alias("_r")), hyp.groupBy(*g, position).agg(F.count("*").alias("_h"))
    both = a.join(b, [*g, position], "full_outer").select(*g, F.coalesce("_r", F.lit(0)).alias("_r"), F.coalesce("_h", F.lit(0)).alias("_h"))
    sums = both.groupBy(*g).agg(F.sum(F.least("_r", "_h")).alias("tp"), F.sum("_r").alias("_r"), F.sum("_h").alias("_h"))
    out = groups.select(*g).distinct().join(sums, g, "left").na.fill(0, ["tp", "_r", "_h"])
    return out.select(*g, "tp", (F.col("_h") - F.col("tp")).alias("fp"), (F.col("_r") - F.col("tp")).alias("fn"), *[v.alias(k) for k, v in _scores(F.col("tp"), F.col("_r"), F.col("_h")).items()], (F.col("_r") == F.col("_h")).alias("exact_count"))


def matched_within(ref: Sequence[int], hyp: Sequence[int], tolerance: int) -> int:
    """How many of the sorted hyp, one by one, find an unused ref within the tolerance, each taking the nearest (the earlier of equals)."""
    free = sorted(ref)
    n = 0
    for h in sorted(hyp):
        near = [(abs(h - r), k) for k, r in enumerate(free) if abs(h - r) <= tolerance]
        if near:
            free.pop(min(near)[1])
            n += 1
    return n


def tolerant_boundary_scores(ref: DataFrame, hyp: DataFrame, group: str, position: str, tolerance: int) -> DataFrame:
    """As ``boundary_scores``, matching greedily within a tolerance; one kernel call holds a group's boundaries."""
    kind = dict(ref.dtypes)[group]

    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        tp = matched_within(a[position].tolist(), b[position].tolist(), tolerance)
        return pd.DataFrame({group: [key[0]], "tp": [tp], "n_ref": [len(a)], "n_hyp": [len(b)]})

    counts = ref.groupBy(group).cogroup(hyp.groupBy(group)).applyInPandas(run, f"{group} {kind}, tp long, n_ref long, n_hyp long")
    return counts.select("*", *[v.alias(k) for k, v in _scores(F.col("tp"), F.col("n_ref"), F.col("n_hyp")).items()])


def pk_windowdiff(ref: DataFrame, hyp: DataFrame, sizes: DataFrame, group: Sequence[str], position: str) -> DataFrame:
    """group, k, p_k, window_diff of boundaries in sequences of ``length`` units (sizes: group, length).

    k is half the mean reference segment, rounded half-even, at least 1.  Windows are
    counted from running sums at each unit; a sequence of one unit scores 0, and one
    not longer than k is a single window.
    """
    g = list(group)

    def marks(df: DataFrame, name: str) -> DataFrame:
        inside = df.join(sizes, g).where((F.col(position) >= 0) & (F.col(position) < F.col("length")))
        return inside.select(*g, F.col(position).alias("u")).distinct().withColumn(name, F.lit(1))

    n_ref = ref.groupBy(*g).agg(F.count("*").alias("_n"))
    half = F.bround(F.col("length") / (F.coalesce("_n", F.lit(0)) + 1) / 2.0, 0)
    base = sizes.join(n_ref, g, "left").withColumn("k", F.greatest(F.lit(1), half.cast("int")))
    units = base.where("length > 1").withColumn("u", F.explode(F.sequence(F.lit(0), (F.col("length") - 1).cast("int"))))
    marked = units.join(marks(ref, "r"), [*g, "u"], "left").join(marks(hyp, "h"), [*g, "u"], "left").na.fill(0, ["r", "h"])
    w = Window.partitionBy(*g).orderBy("u").rowsBetween(Window.unboundedPreceding, 0)
    run = marked.withColumn("_r", F.sum("r").over(w)).withColumn("_h", F.sum("h").over(w))
    # the window that begins at i holds units i .. i + k - 1: sums up to there less sums up to i - 1
    ends = run.select(*g, "k", "length", (F.col("u") + 1).alias("i"), "_r", "_h").unionByName(base.where("length > 1").select(*g, "k", "length", F.lit(0).alias("i"), F.lit(0).cast("long").alias("_r"), F.lit(0).cast("long").alias("_h")))
    stop = ends.select(*g, (F.col("i") - F.least("k", "length")).alias("i"), F.col("_r").alias("_r2"), F.col("_h").alias("_h2"))
    windows = ends.where(F.col("i") < F.greatest(F.col("length") - F.col("k"), F.lit(1))).join(stop, [*g, "i"])
    a, b = F.col("_r2") - F.col("_r"), F.col("_h2") - F.col("_h")
    out = windows.groupBy(*g).agg(F.avg(((a == 0) != (b == 0)).cast("double")).alias("p_k"), F.avg((a != b).cast("double")).alias("window_diff"))
    return base.select(*g, F.when(F.col("length") > 1, F.col("k")).otherwise(1).alias("k")).join(out, g, "left").na.fill(0.0, ["p_k", "window_diff"])


def corpus_summary(scores: DataFrame) -> DataFrame:
    """Micro scores from summed counts, macro means, and the share of groups with the exact number of boundaries."""
    sums = scores.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.avg("f1").alias("macro_f1"), F.avg(F.col("exact_count").cast("double")).alias("exact_count_rate"), F.count("*").alias("n_groups"))
    micro = _scores(F.col("tp"), F.col("tp") + F.col("fn"), F.col("tp") + F.col("fp"))
    return sums.select("n_groups", "tp", "fp", "fn", *[v.alias(f"micro_{k}") for k, v in micro.items()], "macro_f1", "exact_count_rate")


def pair_backtest(gold: DataFrame, decided: DataFrame, keys: Sequence[str], verdict: str) -> DataFrame:
    """Judged pairs (verdict true or false) against the pairs that an alignment proposes: precision on judged ones, coverage, abstention."""
    joined = gold.join(decided.select(*keys).distinct().withColumn("_p", F.lit(True)), list(keys), "left").withColumn("_p", F.coalesce("_p", F.lit(False)))
    out = joined.agg(F.count("*").alias("judged"), F.count_if("_p").alias("proposed"), F.count_if(F.col("_p") & F.col(verdict)).alias("right"), F.count_if(F.col(verdict)).alias("positive"))
    return out.select("judged", "proposed", "right", F.try_divide("right", "proposed").alias("precision"), F.try_divide("right", "positive").alias("recall"), (1 - F.try_divide("proposed", "judged")).alias("abstention"))


def link_metrics(ranked: DataFrame, gold: DataFrame, query: str, candidate: str, bands: Sequence[str] = ()) -> DataFrame:
    """Shares of gold queries whose right candidate is among the first 1, 3 and 5, the mean gap between the first two scores, by band."""
    right = ranked.join(gold.select(query, F.col(candidate).alias("_gold")), query).where(F.col(candidate) == F.col("_gold")).groupBy(query).agg(F.min("rank").alias("_rank"))
    pair = ranked.groupBy(query).agg((F.max(F.when(F.col("rank") == 1, F.col("score"))) - F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("score"))), F.lit(0.0))).alias("_gap"))
    rows = gold.join(right, query, "left").join(pair, query, "left")
    hit = lambda k: F.avg(F.coalesce((F.col("_rank") <= k).cast("double"), F.lit(0.0))).alias(f"top_{k}")
    return rows.groupBy(*bands).agg(F.count("*").alias("n"), hit(1), hit(3), hit(5), F.avg("_gap").alias("mean_gap"))


def exact_span_scores(ref: DataFrame, hyp: DataFrame, keys: Sequence[str]) -> DataFrame:
    """tp, n_ref, n_hyp and scores of spans that agree in all keys, as multisets."""
    a, b = ref.groupBy(*keys).agg(F.count("*").alias("_r")), hyp.groupBy(*keys).agg(F.count("*").alias("_h"))
    sums = a.join(b, list(keys), "full_outer").agg(
        F.coalesce(F.sum(F.least(F.coalesce("_r", F.lit(0)), F.coalesce("_h", F.lit(0)))), F.lit(0)).alias("tp"), F.coalesce(F.sum("_r"), F.lit(0)).alias("n_ref"), F.coalesce(F.sum("_h"), F.lit(0)).alias("n_hyp")
    )
    return sums.select("*", *[v.alias(k) for k, v in _scores(F.col("tp"), F.col("n_ref"), F.col("n_hyp")).items()])


def overlapping_span_matches(ref: DataFrame, hyp: DataFrame, group: str, start: str = "start", end: str = "end") -> DataFrame:
    """group, tp, n_ref, n_hyp: each hyp span in order takes the first unused ref span that it overlaps."""
    kind = dict(ref.dtypes)[group]

    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        free = sorted(zip(a[start], a[end], strict=True))
        tp = 0
        for s, e in sorted(zip(b[start], b[end], strict=True)):
            for k, (x, y) in enumerate(free):
                if s < y and e > x:
                    free.pop(k)
                    tp += 1
                    break
        return pd.DataFrame({group: [key[0]], "tp": [tp], "n_ref": [len(a)], "n_hyp": [len(b)]})

    return ref.groupBy(group).cogroup(hyp.groupBy(group)).applyInPandas(run, f"{group} {kind}, tp long, n_ref long, n_hyp long")


def separated_items(placed: DataFrame, day: Sequence[str], start: str, end: str) -> DataFrame:
    """Items with ``separated``: nothing else of the day starts there, and no more than MOST_EXTENT paragraphs are covered, the end included."""
    n = F.count("*").over(Window.partitionBy(*day, start))
    fits = F.col(start).isNotNull() & (n == 1) & (F.col(end) - F.col(start) + 1 <= MOST_EXTENT)
    return placed.withColumn("separated", F.coalesce(fits, F.lit(False)))


def solid_days(placed: DataFrame, day: Sequence[str], start: str, end: str, items: DataFrame, signal: str) -> DataFrame:
    """Each day of ``items`` (day, signal) with separated_count, separated_share (0 without a signal) and is_solid."""
    counts = separated_items(placed, day, start, end).groupBy(*day).agg(F.count_if("separated").alias("separated_count"))
    out = items.join(counts, list(day), "left").withColumn("separated_count", F.coalesce("separated_count", F.lit(0)))
    out = out.withColumn("separated_share", F.coalesce(F.try_divide("separated_count", signal), F.lit(0.0)))
    return out.withColumn("is_solid", F.col("separated_share") >= SOLID_SHARE)


def axis_metrics(cells: DataFrame, sizes: DataFrame, group: Sequence[str], band: int = 1) -> DataFrame:
    """Of each group's score grid (cells: group, i, j, score; sizes: group, n, m): mean on and off the diagonal, margin, and the share of the score within ``band`` of it."""
    on = F.abs(F.col("i") - F.col("j")) <= 0
    near = F.abs(F.col("i") - F.col("j")) <= band
    sums = cells.groupBy(*group).agg(F.sum(F.when(on, F.col("score"))).alias("_on"), F.sum("score").alias("_all"), F.sum(F.when(near, F.col("score"))).alias("_near"))
    out = sizes.join(sums, list(group), "left").na.fill(0.0, ["_on", "_all", "_near"])
    d = F.least("n", "m")
    diagonal, rest = F.try_divide("_on", d), F.try_divide(F.col("_all") - F.col("_on"), F.col("n") * F.col("m") - d)
    return out.select(*group, diagonal.alias("diagonal_mean"), rest.alias("off_mean"), (diagonal - F.coalesce(rest, F.lit(0.0))).alias("margin"), F.coalesce(F.try_divide("_near", "_all"), F.lit(0.0)).alias("band_share"))


def neighbourhood_score(cells: DataFrame, group: Sequence[str]) -> DataFrame:
    """Cells with the summed score of their eight neighbours, by a join on the shifted cells."""
    shifts = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b])
    around = cells.select(*group, F.explode(shifts).alias("s"), "i", "j", "score").select(*group, (F.col("i") + F.col("s.a")).alias("i"), (F.col("j") + F.col("s.b")).alias("j"), "score")
    sums = around.groupBy(*group, "i", "j").agg(F.sum("score").alias("neighbours"))
    return cells.join(sums, [*group, "i", "j"], "left").na.fill(0.0, ["neighbours"])


def placement_accuracy(pairs: DataFrame, gold: str, predicted: str, group: Sequence[str] = ()) -> DataFrame:
    """Shares placed exactly and within one, mean and median displacement."""
    d = F.abs(F.col(gold) - F.col(predicted))
    return pairs.groupBy(*group).agg(F.count(d).alias("n"), F.avg((d == 0).cast("double")).alias("exact"), F.avg((d <= 1).cast("double")).alias("within_one"), F.avg(d).alias("mean_displacement"), F.median(d).alias("median_displacement"))


def loss_reason(start: Column, extent: Column, sharing: Column) -> Column:
    """Why an item isn't separated: unplaced, shared_start or extent; null if it is."""
    return F.when(start.isNull(), "unplaced").when(sharing > 1, "shared_start").when(extent > MOST_EXTENT, "extent")


def collisions(claims: DataFrame, session: str, date: str) -> DataFrame:
    """Sessions that more than one date claims: session, n_dates, first_date, last_date."""
    return claims.where(F.col(session).isNotNull()).groupBy(session).agg(F.count_distinct(date).alias("n_dates"), F.min(date).alias("first_date"), F.max(date).alias("last_date")).where("n_dates > 1")


def collision_crosstab(days: DataFrame, claims: DataFrame, session: str, date: str, weak: str) -> DataFrame:
    """collides, weak, n: days by whether any of their sessions collides and by a flag of theirs."""
    hit = claims.join(collisions(claims, session, date).select(session), session, "left_semi").select(date).distinct().withColumn("collides", F.lit(True))
    out = days.join(hit, date, "left").withColumn("collides", F.coalesce("collides", F.lit(False)))
    return out.groupBy("collides", F.col(weak).alias("weak")).agg(F.count("*").alias("n"))


def invariant_violations(days: DataFrame, items: str, nihil: str) -> DataFrame:
    """Days on which nothing was done but items are counted, or the reverse."""
    return days.where((F.col(nihil) & (F.col(items) > 0)) | (~F.col(nihil) & (F.coalesce(items, F.lit(0)) == 0)))


def fold_groups(axis: DataFrame, fold: str, order: Sequence[str], length: str, gap: int = 1) -> DataFrame:
    """Sequences of a fold laid end to end: rows with ``fold_start``, the lengths and gaps of the fold's sequences before."""
    w = Window.partitionBy(fold).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return axis.withColumn("fold_start", F.coalesce(F.sum(F.col(length) + gap).over(w), F.lit(0)).cast("long"))


def lumped_positions(cuts: DataFrame, group: Sequence[str], position: str) -> DataFrame:
    """Distinct positions, with how many cuts stand on each."""
    return cuts.where(F.col(position).isNotNull()).groupBy(*group, position).agg(F.count("*").alias("n_cuts"))


def thinned_anchors(anchors: DataFrame, group: Sequence[str], order: Sequence[str], keep_every: int) -> DataFrame:
    """Every ``keep_every``-th anchor, from the first."""
    k = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1
    return anchors.withColumn("_k", k).where(F.col("_k") % keep_every == 0).drop("_k")


def anchor_obstruction(anchors: DataFrame, group: Sequence[str], e: str, a: str) -> DataFrame:
    """Anchors with ``obstruction``: backward or repeated against the one before, else null."""
    before = F.lag(a).over(Window.partitionBy(*group).orderBy(e))
    return anchors.withColumn("obstruction", F.when(F.col(a) < before, "backward").when(F.col(a) == before, "repeated"))


def overlapping_intervals(spans: DataFrame, keys: Sequence[str], ident: str, start: str = "start", end: str = "end") -> DataFrame:
    """Pairs (smaller id first) of spans of one key that overlap, as half-open intervals.

    Each span is compared with those that begin before it ends only, through buckets of
    fixed width that it touches; a pair is found in the first bucket that both touch.
    """
    width = 64
    dealt = spans.select(*keys, F.col(ident).alias("id"), F.col(start).alias("s"), F.col(end).alias("e")).where("e > s")
    dealt = dealt.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("s") / width), F.floor((F.col("e") - 1) / width)))).withColumn("_first", F.floor(F.col("s") / width))
    other = dealt.select(*keys, "_cell", F.col("id").alias("id2"), F.col("s").alias("s2"), F.col("e").alias("e2"), F.col("_first").alias("_first2"))
    pairs = dealt.join(other, [*keys, "_cell"]).where("id < id2 and s < e2 and e > s2").where(F.col("_cell") == F.greatest("_first", "_first2"))
    return pairs.select(*keys, F.col("id").alias("a"), F.col("id2").alias("b"))


def inconsistent_boundaries(spans: DataFrame, surface: str, length: str) -> DataFrame:
    """Surfaces that are marked with more than one length: surface, n_lengths, n."""
    return spans.groupBy(surface).agg(F.count_distinct(length).alias("n_lengths"), F.count("*").alias("n")).where("n_lengths > 1")


def text_mismatches(spans: DataFrame, text: str, start: str, end: str, surface: str) -> DataFrame:
    """Spans whose text isn't what stands at their offsets."""
    return spans.where(~F.substring(F.col(text), F.col(start) + 1, F.col(end) - F.col(start)).eqNullSafe(F.col(surface)))


def partial_coverage(spans: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", most: int = 5) -> DataFrame:
    """Neighbouring spans with a gap of 0 to ``most`` characters: what may be one span cut in two."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    return spans.withColumn("gap", F.lead(start).over(w) - F.col(end)).where(F.col("gap").between(0, most))


def graph_tables(links: DataFrame, left: tuple[str, str], right: tuple[str, str], kind: str, weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type, degree) and edges (src, dst, type, weight) of a link table; ids carry their type."""
    (a, a_type), (b, b_type) = left, right
    src, dst = F.concat_ws(":", F.lit(a_type), F.col(a).cast("string")), F.concat_ws(":", F.lit(b_type), F.col(b).cast("string"))
    rows = links.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(src.alias("src"), dst.alias("dst"), (F.col(weight) if weight else F.lit(1)).alias("w"))
    edges = rows.groupBy("src", "dst").agg(F.sum("w").alias("weight")).withColumn("type", F.lit(kind))
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")))
    return ends.groupBy("id").agg(F.count("*").alias("degree")).withColumn("type", F.substring_index("id", ":", 1)), edges


def review_queue(pairs: DataFrame, verdicts: DataFrame, keys: Sequence[str], score: str, bonus: float = 5.0) -> DataFrame:
    """Pairs without a rejection, approved ones with ``bonus``, unjudged ones first by score."""
    v = verdicts.select(*keys, F.col("verdict").alias("_v"))
    out = pairs.join(v, list(keys), "left").where(F.coalesce(F.col("_v") != "reject", F.lit(True)))
    return out.withColumn("priority", F.col(score) + F.when(F.col("_v") == "approve", bonus).otherwise(0.0)).withColumn("judged", F.col("_v").isNotNull()).drop("_v")


#: Rows of a group whose pairs are compared within an expression; larger groups are counted by ranges.
SMALL_GROUP = 64


def _small_tau(points: Column) -> tuple[Column, Column]:
    """Pairs and Kendall's tau-b of an array of (x, y) without nulls, which no shuffle or row is needed for."""

    def ordered_pairs(gain: Callable[[Column, Column], Column]) -> Column:
        within = lambda p: F.aggregate(points, F.lit(0), lambda t, q: t + gain(p, q))
        return F.aggregate(points, F.lit(0), lambda s, p: s + within(p))

    n = F.size(points).cast("long")
    by_x, by_y = (ordered_pairs(lambda p, q, c=c: F.when(p[c] < q[c], 1).otherwise(0)) for c in ("x", "y"))
    agree = ordered_pairs(lambda p, q: F.when(p["x"] < q["x"], F.when(p["y"] < q["y"], 1).when(p["y"] > q["y"], -1).otherwise(0)).otherwise(0))
    root = F.sqrt(by_x.cast("double") * by_y.cast("double"))
    return (n * (n - 1) / 2).cast("long"), F.when(root > 0, agree / root)


def order_agreement(pairs: DataFrame, group: Sequence[str], band: str, x: str, y: str) -> DataFrame:
    """group, band, pairs, tau, and control_tau against a derangement: each item's order paired with that of the item half a group on.

    Groups of at most SMALL_GROUP rows are gathered once and compared in place, which
    takes one shuffle; larger ones, if there are any, by ranges (see ``kendall_tau``).
    """
    from weftline.operators.aggregates import kendall_tau

    g = [*group, band]
    large = pairs.groupBy(*g).agg(F.count("*").alias("_n")).where(F.col("_n") > SMALL_GROUP)
    some = not large.isEmpty()
    rows = pairs.select(*g, F.col(x).alias("_ox"), F.col(y).alias("_oy"))
    other = lambda df: df.withColumnsRenamed({c: f"_b{j}" for j, c in enumerate(g)})
    same = F.lit(True)
    for j, c in enumerate(g):
        same = same & F.col(c).eqNullSafe(F.col(f"_b{j}"))
    if some:
        large = cut(other(large.select(*g)))
        many, rows = cut(rows.join(large, same, "left_semi")), rows.join(large, same, "left_anti")
    gathered = rows.groupBy(*g).agg(F.sort_array(F.collect_list(F.struct(F.col("_ox").alias("x"), F.col("_oy").alias("y")))).alias("_v")).where(F.size("_v") > 1)
    n = F.size("_v")
    moved = F.transform("_v", lambda p, i: F.struct(p["x"].alias("x"), F.get("_v", (i - F.floor(n / 2).cast("int") + n) % n)["y"].alias("y")))
    known = lambda v: F.filter(v, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    # the names must be new: within lambdas "_v" would mean a column of that name made here
    both = gathered.select(*g, known("_v").alias("_own"), known(moved).alias("_moved")).where(F.size("_own") > 1)
    (n_pairs, tau), control = _small_tau(F.col("_own")), _small_tau(F.col("_moved"))[1]
    small = both.select(*g, n_pairs.alias("pairs"), tau.alias("tau"), control.alias("control_tau"))
    if not some:
        return small

    k = F.row_number().over(Window.partitionBy(*g).orderBy("_ox", "_oy")) - 1
    numbered = many.select(*g, "_ox", "_oy", k.alias("_k"), F.count("*").over(Window.partitionBy(*g)).alias("_n"))
    shifted = numbered.select(*g, ((F.col("_k") + F.floor(F.col("_n") / 2)) % F.col("_n")).alias("_at"), F.col("_oy").alias("_other"))
    paired = numbered.drop("_oy").join(other(shifted), same & (F.col("_k") == F.col("_at"))).select(*g, "_ox", "_other")
    control = kendall_tau(paired, g, "_ox", "_other").select(*g, F.col("tau").alias("control_tau"))
    apart = kendall_tau(many, g, "_ox", "_oy").join(other(control), same, "left")
    return small.unionByName(apart.select(*g, "pairs", "tau", "control_tau"))
