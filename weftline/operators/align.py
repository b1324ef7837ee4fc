"""Alignment and segmentation of ordered sequences: windows where they suffice, small grouped kernels where steps depend on steps."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Penalty of a gap, least similarity of a diagonal without overlap, score from which a row is an anchor.
GAP, LEAST_SIMILARITY, ANCHOR = 0.1, 0.35, 2.0
#: Bonus of a pin, penalty a paragraph off the expected offset, bonus of the same date, weight of persons.
PIN, OFFSET, SAME_DATE, PERSON = 50.0, 0.35, 2.0, 0.2
#: What a full hit and a paragraph's drift weigh in a gap.
PHRASE_WEIGHT, DISPERSION_WEIGHT = 3.0, 1.0


def best_chain(i: np.ndarray, j: np.ndarray, weight: np.ndarray, n: int, m: int) -> list[tuple[int, int]]:
    """Of n rows and m columns the cells (i, j, a whole ``weight`` each) of the heaviest chain that rises in both, from its last cell to its first.

    Of equally heavy chains it is the one of the alignment that from the end prefers to
    take a cell, then to skip a row.  Cells meet in a tree of running maxima over the
    columns: c cells take c log m steps, and no table is held.
    """
    kept = np.flatnonzero(weight >= 0)
    kept = kept[np.lexsort((j[kept], i[kept]))]
    rows, columns, weights = i[kept].tolist(), j[kept].tolist(), weight[kept].tolist()
    tree, total = [0] * (m + 1), [0] * len(kept)
    at = 0
    while at < len(kept):
        end = at
        while end < len(kept) and rows[end] == rows[at]:
            best, x = 0, columns[end]
            while x:
                best = max(best, tree[x])
                x &= x - 1
            total[end] = best + weights[end]
            end += 1
        for c in range(at, end):
            x = columns[c] + 1
            while x <= m:
                tree[x] = max(tree[x], total[c])
                x += x & -x
        at = end
    of_total: dict[int, list[int]] = {}
    for c, t in enumerate(total):
        of_total.setdefault(t, []).append(c)  # rows ascend, and columns within a row
    out, left, row, column = [], max(total, default=0), n - 1, m - 1
    while row >= 0 and column >= 0:
        inside = [c for c in of_total.get(left, ()) if rows[c] <= row and columns[c] <= column]
        here = [c for c in inside if columns[c] == column]
        if not left:  # nothing is gained any more: rows are skipped, but for cells that cost nothing
            inside = here
        if not inside:
            break
        c = here[-1] if here else max(c for c in inside if rows[c] == rows[inside[0]])
        out.append((rows[c], columns[c]))
        left, row, column = left - weights[c], rows[c] - 1, columns[c] - 1
    return out


def alignment_steps(chain: list[tuple[int, int]], n: int, m: int) -> list[tuple[int | None, int | None]]:
    """The alignment that has the pairs of ``chain`` (from the last to the first): before each pair its columns alone, then its rows alone."""
    out: list[tuple[int | None, int | None]] = []
    for a, b in [*chain, (-1, -1)]:
        out += [(x, None) for x in range(n - 1, a, -1)] + [(None, x) for x in range(m - 1, b, -1)]
        if a >= 0:
            out.append((a, b))
        n, m = a, b
    return out[::-1]


#: Scores are compared in millionths, so that equal ones are equal whatever the order of their sums.
MILLIONTHS = 1_000_000


def needleman_wunsch(match: np.ndarray, allowed: np.ndarray, gap: float = GAP) -> list[tuple[int | None, int | None]]:
    """Pairs of the best global alignment; a diagonal needs ``allowed``; of equal moves the diagonal, then a skipped row, wins."""
    n, m = match.shape
    i, j = np.nonzero(allowed)
    return alignment_steps(best_chain(i, j, np.rint((match[i, j] + 2 * gap) * MILLIONTHS).astype(np.int64), n, m), n, m)


def _weighed(own: pd.DataFrame, n: int, m: int, semantic_weight: float, least_similarity: float, expected: float | None) -> pd.DataFrame:
    """Of n rows and m columns the cells that may be matched, from the ``cells`` of one group, with what matching them scores: i, j, match."""
    own = own[(own["i"] < n) & (own["j"] < m)].drop_duplicates(["i", "j"], keep="last")
    solid = own["overlap"] + own["places"] + own["orgs"]
    overlap = solid + np.where(solid > 0, PERSON * own["persons"], 0.0)
    pinned = own["pinned"].astype(bool)
    fits = (overlap > 0) | ((own["similarity"] >= least_similarity) & (semantic_weight > 0))
    # a pinned row has its pin or nothing, whatever else it overlaps with
    held = own["i"].isin(own.loc[pinned, "i"])
    allowed = np.where(held, pinned, fits & ~own["blocked"].astype(bool))
    aside = own["offset_gap"].abs()
    if expected is not None:
        aside = aside + (own["j"] - expected - own["i"]).abs()
    match = overlap + semantic_weight * own["similarity"] + PIN * pinned - OFFSET * aside + SAME_DATE * own["same_date"].astype(bool)
    return pd.DataFrame({"i": own["i"].astype(int), "j": own["j"].astype(int), "match": match})[allowed.astype(bool)]


def nw_align(cells: DataFrame, sizes: DataFrame, group: str, semantic_weight: float = 0.0, gap: float = GAP, least_similarity: float = LEAST_SIMILARITY) -> DataFrame:
    """group, step, i, j of each group's global alignment (null: skipped).

    ``cells`` has group, i, j of the pairs that have any of: overlap, or by type places,
    orgs and persons (these scaled, and only beside one of the others); similarity,
    which counts with ``semantic_weight``; same_date, which adds SAME_DATE; pinned,
    which adds PIN and rules out all else in its row; blocked; offset_gap, the distance
    from the expected place, which costs OFFSET each.  ``sizes`` has group, n, m and
    optionally expected, the j of row 0, from which every pair's distance is counted.
    A pair may be matched if it overlaps or is similar enough, and isn't blocked; of
    repeated pairs one counts.  Gaps cost ``gap`` for each row and column, so a pair gains
    its score and two gaps, and the best alignment is the heaviest chain of pairs: a kernel
    call holds one group's cells, not its table, and steps grow with their number.
    """
    given = dict(similarity=0.0, overlap=0.0, places=0.0, orgs=0.0, persons=0.0, pinned=False, blocked=False, same_date=False, offset_gap=0.0)
    cells = cells.select(group, "i", "j", *[F.coalesce(F.col(c), F.lit(v)).alias(c) if c in cells.columns else F.lit(v).alias(c) for c, v in given.items()])
    if "expected" not in sizes.columns:
        sizes = sizes.withColumn("expected", F.lit(None).cast("double"))

    def run(key: tuple, size: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(size):
            return pd.DataFrame({group: [], "step": [], "i": [], "j": []})
        n, m, expected = int(size["n"].iloc[0]), int(size["m"].iloc[0]), size["expected"].iloc[0]
        cells = _weighed(own, n, m, semantic_weight, least_similarity, None if pd.isna(expected) else float(expected))
        weight = np.rint((cells["match"].to_numpy(dtype=float) + 2 * gap) * MILLIONTHS).astype(np.int64)
        pairs = alignment_steps(best_chain(cells["i"].to_numpy(), cells["j"].to_numpy(), weight, n, m), n, m)
        return pd.DataFrame(
            {group: [key[0]] * len(pairs), "step": range(len(pairs)), "i": pd.array([a for a, _ in pairs], dtype="Int64"), "j": pd.array([b for _, b in pairs], dtype="Int64")}
        )

    kind = dict(sizes.dtypes)[group]
    return sizes.groupBy(group).cogroup(cells.groupBy(group)).applyInPandas(run, f"{group} {kind}, step long, i long, j long")


def segment_align(cells: DataFrame, segments: DataFrame, group: str, gap: float = GAP) -> DataFrame:
    """group, i, j: the pairs within segments whose first and whose last rows and columns are pinned to each other.

    ``segments`` has group, i0, i1, j0, j1, ends included; one of a single row has the pair (i0, j0), one whose columns don't rise has none.
    """
    named = segments.withColumn("_segment", F.concat_ws("/", F.col(group).cast("string"), "i0", "i1", "j0", "j1")).dropDuplicates(["_segment"])
    long = named.where("i1 > i0 and j1 > j0")
    inside = cells.join(long, group).where(F.col("i").between(F.col("i0"), F.col("i1")) & F.col("j").between(F.col("j0"), F.col("j1")))
    moved = inside.withColumns({"i": F.col("i") - F.col("i0"), "j": F.col("j") - F.col("j0")}).drop(group, "i0", "i1", "j0", "j1")
    last = (F.col("i1") - F.col("i0"), F.col("j1") - F.col("j0"))
    zero = F.lit(0).cast("long")
    ends = long.select("_segment", F.explode(F.array(F.struct(zero.alias("i"), zero.alias("j")), F.struct(last[0].cast("long").alias("i"), last[1].cast("long").alias("j")))).alias("e"))
    pins = ends.select("_segment", "e.i", "e.j", F.lit(True).alias("_pin"))
    moved = moved.join(pins, ["_segment", "i", "j"], "full_outer").withColumn("pinned", F.coalesce("_pin", F.lit(False))).drop("_pin")
    found = nw_align(moved, long.select("_segment", (last[0] + 1).alias("n"), (last[1] + 1).alias("m")), "_segment", gap=gap).where("i is not null and j is not null")
    found = found.join(long, "_segment").select(group, (F.col("i") + F.col("i0")).cast("long").alias("i"), (F.col("j") + F.col("j0")).cast("long").alias("j"))
    return found.unionByName(named.where("i1 = i0").select(group, F.col("i0").cast("long").alias("i"), F.col("j0").cast("long").alias("j"))).distinct()


def align_by_tri_anchors(cells: DataFrame, anchors: DataFrame, group: str, pins: DataFrame | None = None, gap: float = GAP) -> DataFrame:
    """group, i, j: alignment from a group's first to its last anchor, by way of the middle one if there is one; ``pins`` (group, i, j) go before.

    ``anchors`` is what ``tri_anchors`` gives; groups without a first and a last anchor have pins alone.
    """
    at = {role: F.first(F.when(F.col("role") == role, F.struct("i", "j")), ignorenulls=True) for role in ("first", "middle", "last")}
    roles = anchors.groupBy(group).agg(*[x.alias(role) for role, x in at.items()]).where("first is not null and last is not null")
    ends = F.array_compact(F.array("first", "middle", "last"))
    stops = roles.select(group, ends.alias("e")).select(group, F.explode(F.zip_with(F.slice("e", F.lit(1), F.size("e") - 1), F.slice("e", F.lit(2), F.size("e") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("s"))
    segments = stops.select(group, F.col("s.a.i").alias("i0"), F.col("s.b.i").alias("i1"), F.col("s.a.j").alias("j0"), F.col("s.b.j").alias("j1")).where("i1 > i0 and j1 > j0")
    found = segment_align(cells, segments, group, gap)
    if pins is None:
        return found
    pins = pins.select(group, F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"))
    return found.join(pins.select(group, "i").distinct(), [group, "i"], "left_anti").unionByName(pins)


def typed_score(places: Column, orgs: Column, persons: Column) -> Column:
    """Places and organisations in full, persons scaled; persons alone count only with one of the others."""
    solid = F.coalesce(places, F.lit(0.0)) + F.coalesce(orgs, F.lit(0.0))
    return F.when(solid > 0, solid + PERSON * F.coalesce(persons, F.lit(0.0))).otherwise(F.lit(0.0))


def tiered_milestones(rows: DataFrame, cells: DataFrame, group: Sequence[str], threshold: float = ANCHOR, several: bool = True) -> DataFrame:
    """Each row i of ``rows`` (group, i, m) with its place j, tier and score.

    A row's best cell (group, i, j, score; the first of equals) makes it an anchor from
    ``threshold`` on, unless its j falls behind an earlier one (or, without ``several``,
    repeats it).  Others lie between, before or after anchors: on their page, on the
    left one of two neighbours, interpolated half-even, in step with the last or the
    next anchor, or nowhere.  All of it is window expressions.
    """
    g = list(group)
    best = cells.where("score > 0").groupBy(*g, "i").agg(F.max_by(F.struct("j", "score"), F.struct(F.col("score"), -F.col("j"))).alias("b")).where(F.col("b.score") >= threshold)
    w = Window.partitionBy(*g).orderBy("i")
    seen = F.max("_a").over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = rows.join(best, [*g, "i"], "left").withColumn("_a", F.col("b.j"))
    keeps = F.col("_a") >= F.coalesce(seen, F.lit(-1)) if several else F.col("_a") > F.coalesce(seen, F.lit(-1))
    out = out.withColumn("_anchor", F.when(keeps, F.struct(F.col("i").alias("i"), F.col("_a").alias("j"))))
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    out = out.withColumn("_l", F.last("_anchor", ignorenulls=True).over(back)).withColumn("_r", F.first("_anchor", ignorenulls=True).over(ahead))
    li, lj, ri, rj = F.col("_l.i"), F.col("_l.j"), F.col("_r.i"), F.col("_r.j")
    between = F.bround(lj + (F.col("i") - li) / (ri - li) * (rj - lj), 0).cast("int")
    is_anchor, both = F.col("_anchor").isNotNull(), F.col("_l").isNotNull() & F.col("_r").isNotNull()
    tier = (
        F.when(is_anchor, "tier1_anchor")
        .when(both & (lj == rj), "tier2_merged_page")
        .when(both & (rj - lj == 1), "tier2_adjacent")
        .when(both, "tier2_interpolated")
        .when(F.col("_l").isNotNull(), "tier3_tail")
        .when(F.col("_r").isNotNull(), "tier3_head_template")
        .otherwise("tier3_unanchored")
    )
    j = (
        F.when(is_anchor, F.col("_a"))
        .when(both & (rj - lj <= 1), lj)
        .when(both, between)
        .when(F.col("_l").isNotNull(), F.least(F.col("m") - 1, lj + (F.col("i") - li)))
        .when(F.col("_r").isNotNull(), F.greatest(F.lit(0), rj - (ri - F.col("i"))))
    )
    return out.select(*g, "i", j.cast("int").alias("j"), tier.alias("tier"), F.when(is_anchor, F.col("b.score")).otherwise(F.lit(0.0)).alias("score"))


def even_positions(low: Column, high: Column, count: Column, rank: Column) -> Column:
    """Where the rank-th (from 1) of ``count`` items between two anchors stands without evidence: the optimum of the gap's programme in closed form."""
    return (low + F.floor(rank * (high - low) / (count + 1))).cast("int")


def place_between_anchors(groups: DataFrame, anchors: DataFrame, group: Sequence[str]) -> DataFrame:
    """group, e, position of items 1 .. k_e - 1 on an axis of ``axis`` places, from anchors (group, e, a), without other evidence.

    Anchors outside 0 < e < k_e or 0 <= a < axis are left out, of equal e the smallest a
    counts, and ones that fall back are clipped to the largest a before.
    """
    g = list(group)
    sizes = groups.select(*g, "k_e", "axis")
    known = anchors.join(sizes, g).where("e > 0 and e < k_e and a >= 0 and a < axis").groupBy(*g, "e", "k_e", "axis").agg(F.min("a").alias("a"))
    w = Window.partitionBy(*g).orderBy("e")
    clipped = known.withColumn("a", F.least(F.max("a").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.col("axis") - 1))
    ends = sizes.select(*g, F.lit(0).alias("e"), "k_e", "axis", F.lit(0).alias("a")).unionByName(sizes.select(*g, F.col("k_e").alias("e"), "k_e", "axis", F.col("axis").alias("a")))
    chain = clipped.unionByName(ends).withColumn("_e", F.lead("e").over(w)).withColumn("_a", F.lead("a").over(w)).where("_e is not null")
    count = F.col("_e") - F.col("e") - 1
    inner = chain.where(count > 0).select("*", F.explode(F.sequence(F.lit(1), count.cast("int"))).alias("rank"))
    placed = inner.select(*g, (F.col("e") + F.col("rank")).cast("int").alias("e"), even_positions(F.col("a"), F.col("_a"), count, F.col("rank")).alias("position"))
    return placed.unionByName(clipped.select(*g, F.col("e").cast("int").alias("e"), F.col("a").cast("int").alias("position")))


def best_positions(low: int, high: int, count: int, scores: dict[int, float] | None = None, phrase: float = PHRASE_WEIGHT, dispersion: float = DISPERSION_WEIGHT) -> list[int]:
    """``count`` non-decreasing positions from ``low`` up to before ``high`` that earn most: evidence less the distance from an even split.

    Of equal placements the last item goes to the earliest position, then the one before it.

    An item that is due later never gains more by going back than one due before it, so
    each item's own earliest best position is in order already, and no table of items by
    positions is needed.  Of positions up to where an item is due the best is that of the
    largest bonus + dispersion * position, of those from there on that of the largest
    bonus - dispersion * position: two running maxima serve all items.
    """
    if dispersion < 0:
        raise ValueError("items can't be rewarded for distance")
    if count <= 0:
        return []
    size = max(low, high - 1) + 1 - low
    bonus, places = np.zeros(size), np.arange(size)
    for p, score in (scores or {}).items():
        if 0 <= p - low < size:
            bonus[p - low] = phrase * score
    rising, falling = bonus + dispersion * places, (bonus - dispersion * places)[::-1]
    top = np.maximum.accumulate(rising)
    before = np.maximum.accumulate(np.where(np.concatenate(([True], rising[1:] > top[:-1])), places, 0))
    # from the end an equal value is an earlier position, and so the better one
    top = np.maximum.accumulate(falling)
    after = size - 1 - np.maximum.accumulate(np.where(np.concatenate(([True], falling[1:] >= top[:-1])), places, 0))[::-1]
    due = np.arange(1, count + 1) * (high - low) // (count + 1)
    at = np.clip(due, 0, size - 1)
    value = lambda k: bonus[k] - dispersion * np.abs(k - due)
    return (low + np.where(value(before[at]) >= value(after[at]), before[at], after[at])).tolist()


def place_with_evidence(gaps: DataFrame, evidence: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, rank, position of the best placement in each gap (keys, low, high, count), given evidence (keys, position, score)."""
    kinds = dict(gaps.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", rank int, position int"

    def run(key: tuple, gap: pd.DataFrame, seen: pd.DataFrame) -> pd.DataFrame:
        if not len(gap):
            return pd.DataFrame(columns=[*keys, "rank", "position"])
        scores = dict(zip(seen["position"].astype(int), seen["score"].astype(float), strict=True))
        got = best_positions(int(gap["low"].iloc[0]), int(gap["high"].iloc[0]), int(gap["count"].iloc[0]), scores)
        return pd.DataFrame({**{k: [v] * len(got) for k, v in zip(keys, key, strict=True)}, "rank": range(1, len(got) + 1), "position": got})

    return gaps.groupBy(*keys).cogroup(evidence.groupBy(*keys)).applyInPandas(run, schema)


def interpolate_or_abstain(groups: DataFrame, anchors: DataFrame, group: Sequence[str]) -> DataFrame:
    """group, status, reason, e, position: strict interpolation between anchors and the ends, or an abstention.

    Abstains where the axis is shorter than the items, or where anchors don't rise strictly.
    """
    g = list(group)
    w = Window.partitionBy(*g).orderBy("e")
    ranked = anchors.groupBy(*g, "e").agg(F.min("a").alias("a"))
    falls = ranked.withColumn("_d", F.col("a") - F.lag("a").over(w)).groupBy(*g).agg(F.max((F.col("_d") <= 0).cast("int")).alias("_falls"))
    judged = groups.join(falls, g, "left").withColumn(
        "reason", F.when(F.col("axis") < F.col("k_e"), "axis shorter than items").when(F.col("_falls") == 1, "anchors not increasing")
    )
    sound = judged.where("reason is null").select(*g, "k_e", "axis")
    placed = place_between_anchors(sound, anchors, group).withColumn("status", F.lit("predicted")).withColumn("reason", F.lit(None).cast("string"))
    refused = judged.where("reason is not null").select(*g, F.lit("abstained").alias("status"), "reason")
    return placed.unionByName(refused, allowMissingColumns=True)


def snap_to_hits(cuts: DataFrame, hits: DataFrame, group: Sequence[str], reach: int) -> DataFrame:
    """Cuts (group, e, position) moved to the nearest hit (group, position, score) within ``reach``, where that keeps their order.

    Of hits equally near the better, then the earlier, is taken.  A cut is moved only if
    it stays behind what the cut before it became; that depends on each step, so the
    ordered candidates are folded within one expression for each group.
    """
    g = list(group)
    spread = cuts.withColumn("_at", F.explode(F.sequence(F.col("position") - reach, F.col("position") + reach)))
    near = spread.join(hits.select(*g, F.col("position").alias("_at"), "score"), [*g, "_at"])
    best = near.groupBy(*g, "e").agg(F.min(F.struct(F.abs(F.col("_at") - F.col("position")), -F.col("score"), F.col("_at").alias("at")))["at"].alias("_hit"))
    items = cuts.join(best, [*g, "e"], "left").groupBy(*g).agg(F.array_sort(F.collect_list(F.struct("e", "position", "_hit"))).alias("items"))
    step_type = "struct<last:int,out:array<struct<e:int,position:int,snapped:boolean>>>"
    zero = F.from_json(F.lit('{"last": -1, "out": []}'), step_type)

    def step(s: Column, x: Column) -> Column:
        fits = x["_hit"].isNotNull() & (x["_hit"] > s["last"])
        to = F.when(fits, x["_hit"]).otherwise(F.greatest(x["position"], s["last"])).cast("int")
        entry = F.struct(x["e"].cast("int").alias("e"), to.alias("position"), F.coalesce(fits, F.lit(False)).alias("snapped"))
        return F.struct(to.alias("last"), F.concat(s["out"], F.array(entry)).alias("out")).cast(step_type)

    folded = items.select(*g, F.explode(F.aggregate("items", zero, step)["out"]).alias("x"))
    return folded.select(*g, "x.e", "x.position", "x.snapped")


def uniform_cuts(length: Column, count: Column) -> Column:
    """Array of count - 1 cuts that split a length evenly, rounded down."""
    return F.when(count > 1, F.transform(F.sequence(F.lit(1), (count - 1).cast("int")), lambda k: F.floor(k * length / count).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def proportional_cuts(rows: DataFrame, group: Sequence[str], order: Sequence[str], size: str, length: str) -> DataFrame:
    """Rows with ``cut``, where each begins if the group's ``length`` is shared out by size, rounded half-even; 0 for the first."""
    w = Window.partitionBy(*group).orderBy(*order)
    before = F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = F.sum(size).over(Window.partitionBy(*group))
    return rows.withColumn("cut", F.bround(F.coalesce(F.try_divide(before * F.col(length), whole), F.lit(0.0)), 0).cast("long"))


def interior_cuts(spans: DataFrame, group: Sequence[str], start: str, end: str, cuts: int) -> DataFrame:
    """group, k, cut: sorted spans split into cuts + 1 runs of nearly equal number, cut in the middle of the gap between them."""
    w = Window.partitionBy(*group).orderBy(start, end)
    n = F.count("*").over(Window.partitionBy(*group))
    numbered = spans.withColumn("_k", F.row_number().over(w)).withColumn("_n", n).withColumn("_next", F.lead(start).over(w))
    ks = numbered.where(F.col("_n") > cuts).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(cuts))))
    at = ks.where(F.col("_k") == F.floor(F.col("k") * F.col("_n") / (cuts + 1)))
    return at.select(*group, "k", F.floor((F.col(end) + F.col("_next")) / 2).cast("long").alias("cut"))


def zip_align(items: DataFrame, slots: DataFrame, day: Sequence[str], item_order: Sequence[str], slot_order: Sequence[str]) -> DataFrame:
    """Items and slots of a day paired by position, with confidence 0.9 if the day has as many of both, else 0.55."""
    def numbered(df: DataFrame, order: Sequence[str], n: str) -> DataFrame:
        return df.withColumn("position", F.row_number().over(Window.partitionBy(*day).orderBy(*order))).withColumn(n, F.count("*").over(Window.partitionBy(*day)))

    pairs = numbered(items, item_order, "_a").join(numbered(slots, slot_order, "_b"), [*day, "position"])
    return pairs.withColumn("confidence", F.when(F.col("_a") == F.col("_b"), 0.9).otherwise(0.55)).drop("_a", "_b")


def mention_alignment(flat: Sequence[str], enriched: Sequence[str]) -> tuple[list[tuple[int, int]], float]:
    """Pairs in order that leave no enriched mention alone, and their cost: 1 for each flat mention left out, 1 for each unequal pair.

    Without so many flat mentions there are no pairs, and the cost is infinite, as it is
    with flat mentions and no enriched one.  Of equal costs the pairs that come latest.
    """
    n, m = len(flat), len(enriched)
    if m > n or (n and not m):
        return [], math.inf
    differ = np.array([[a != b for b in enriched] for a in flat], dtype=float).reshape(n, m)
    cost = np.concatenate(([0.0], np.full(m, np.inf)))
    paired = np.zeros((n, m), dtype=bool)
    for i in range(n):
        left_out, together = cost + 1, cost[:-1] + differ[i]
        paired[i] = together <= left_out[1:]
        cost = np.concatenate((left_out[:1], np.minimum(left_out[1:], together)))
    out, j = [], m
    for i in range(n - 1, -1, -1):
        if j and paired[i, j - 1]:
            j -= 1
            out.append((i, j))
    return out[::-1], float(cost[m])


def align_mentions(flat: DataFrame, enriched: DataFrame, group: str, pos: str, mention: str) -> DataFrame:
    """group, cost, i, j (places by ``pos``) of each group's mention alignment; a group without pairs has one row of nulls."""
    kind = dict(flat.dtypes)[group]

    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values(pos), b.sort_values(pos)
        pairs, cost = mention_alignment(a[mention].tolist(), b[mention].tolist())
        i, j = ([int(a[pos].iloc[i]) for i, _ in pairs], [int(b[pos].iloc[j]) for _, j in pairs]) if pairs else ([None], [None])
        return pd.DataFrame({group: [key[0]] * len(i), "cost": [cost] * len(i), "i": pd.array(i, dtype="Int64"), "j": pd.array(j, dtype="Int64")})

    return flat.groupBy(group).cogroup(enriched.groupBy(group)).applyInPandas(run, f"{group} {kind}, cost double, i long, j long")


def tri_anchors(cells: DataFrame, sizes: DataFrame, group: Sequence[str], least: float = ANCHOR) -> DataFrame:
    """group, role (first, middle, last), i, j, score: the first and the last qualifying row, and the best in the middle third; only if they rise.

    ``cells`` has group, i, j, score and optionally pinned, whose rows go before others of their role; ``sizes`` has group, n.
    """
    g = list(group)
    pinned = F.col("pinned") if "pinned" in cells.columns else F.lit(False)
    good = cells.join(sizes, g).withColumn("_pin", F.coalesce(pinned, F.lit(False)).cast("int")).where((F.col("score") >= least) | (F.col("_pin") == 1))
    row = F.struct(F.col("i").alias("i"), F.col("j").alias("j"), F.col("score").alias("score"))
    middle = (F.col("i") * 3 >= F.col("n")) & (F.col("i") * 3 < 2 * F.col("n"))
    picked = good.groupBy(*g).agg(
        F.min_by(row, F.struct(-F.col("_pin"), F.col("i"), -F.col("score"), F.col("j"))).alias("first"),
        F.min_by(row, F.struct((~middle).cast("int"), -F.col("_pin"), -F.col("score"), F.col("i"), F.col("j"))).alias("middle"),
        F.min_by(row, F.struct(-F.col("_pin"), -F.col("i"), -F.col("score"), F.col("j"))).alias("last"),
        F.max(middle.cast("int")).alias("_any"),
    )
    roles = F.array(
        F.struct(F.lit("first").alias("role"), F.col("first").alias("x")),
        F.struct(F.lit("middle").alias("role"), F.when(F.col("_any") == 1, F.col("middle")).alias("x")),
        F.struct(F.lit("last").alias("role"), F.col("last").alias("x")),
    )
    rises = lambda a, b: (F.col(f"{a}.i") < F.col(f"{b}.i")) & (F.col(f"{a}.j") <= F.col(f"{b}.j"))
    out = picked.select(*g, F.explode(roles).alias("r"), rises("first", "last").alias("_ends"), (rises("first", "middle") & rises("middle", "last")).alias("_mid"))
    kept = out.where("r.x is not null").where((F.col("r.role") == "first") | F.col("_ends")).where((F.col("r.role") != "middle") | F.col("_mid"))
    return kept.select(*g, "r.role", "r.x.i", "r.x.j", "r.x.score")


def chain_sessions(sessions: DataFrame, cells: DataFrame, chain: str, gap: float = GAP) -> DataFrame:
    """Sessions of a chain aligned one after another, each expected to start where the one before ended: chain, session, i, j.

    ``sessions`` has chain, session, rank, n, start, m (its slots' range); ``cells`` has
    chain, session, i, j, overlap.  What one session leaves is the next one's expected
    offset, so a chain is one kernel call; chains run in parallel.
    """
    kind = dict(sessions.dtypes)[chain]

    def run(key: tuple, own: pd.DataFrame, seen: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        border = None
        by = dict(iter(seen.groupby("session")))
        for s in own.sort_values("rank").itertuples():
            n, m = int(s.n), int(s.m)
            match, allowed = np.zeros((n, m)), np.zeros((n, m), dtype=bool)
            expected = 0 if border is None else max(0, border + 1 - int(s.start))
            for c in by.get(s.session, seen.iloc[:0]).itertuples():
                if c.i < n and c.j < m:
                    match[c.i, c.j] = c.overlap - OFFSET * abs((c.j - expected) - c.i) * (0.0 if border is None else 1.0)
                    allowed[c.i, c.j] = c.overlap > 0
            pairs = [(i, j) for i, j in needleman_wunsch(match, allowed, gap) if i is not None and j is not None]
            out += [(key[0], s.session, i, j) for i, j in pairs]
            if pairs:
                border = int(s.start) + pairs[-1][1]
        return pd.DataFrame(out, columns=[chain, "session", "i", "j"])

    return sessions.groupBy(chain).cogroup(cells.groupBy(chain)).applyInPandas(run, f"{chain} {kind}, session string, i long, j long")


def paragraph_ranges(items: DataFrame, predictions: DataFrame, day: str, ordinal: str, items_per_day: str) -> DataFrame:
    """Items with paragraph_start and paragraph_end from their day's cuts: the i-th item goes from cut i - 1 (0 for the first) up to cut i (the last place for the last), the end included.

    ``predictions`` has day, status, k_e, axis, cuts (sorted array); other than predicted ones, and those for another number of items, give nulls.
    """
    p = predictions.where("status = 'predicted'").select(day, F.col("k_e").alias("_k"), F.col("axis").alias("_axis"), "cuts")
    out = items.join(p, day, "left")
    fits = F.col("_k") == F.col(items_per_day)
    start = F.when(F.col(ordinal) == 0, F.lit(0)).otherwise(F.try_element_at("cuts", F.col(ordinal).cast("int")))
    end = F.when(F.col(ordinal) == F.col(items_per_day) - 1, F.col("_axis") - 1).otherwise(F.try_element_at("cuts", (F.col(ordinal) + 1).cast("int")))
    return out.withColumn("paragraph_start", F.when(fits, start)).withColumn("paragraph_end", F.when(fits, end)).drop("_k", "_axis", "cuts")
