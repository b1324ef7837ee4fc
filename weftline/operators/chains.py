"""Chains of sessions: ranked by what is known of them, and aligned so that each goes on where the one before it ended."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.align import GAP, nw_align
from weftline.operators.ordered import cut, running_totals

#: Fixed value: precision from which a session is locked.
LOCK = 0.65
#: Verdicts that count.
VERDICTS = ("correct", "false_positive", "uncertain")


def rank_sessions(labelled: DataFrame, session: str, verdict: str, margins: DataFrame | None = None) -> DataFrame:
    """session, correct, false_positive, uncertain, precision, mean_margin, rank (from 1), locked: sessions by precision, then mean margin, then name.

    Other verdicts count nothing, but their session is listed, with precision 0; rows
    without a session are left out.  ``margins`` (session, margin) may have several rows
    of a session; a session without any goes as 0 and is given null.  Ranks are found by
    ranges of the order, not in one task.
    """
    counts = labelled.where(F.col(session).isNotNull()).groupBy(session).agg(*[F.count_if(F.col(verdict) == v).alias(v) for v in VERDICTS])
    total = F.col("correct") + F.col("false_positive") + F.col("uncertain")
    out = counts.withColumn("precision", F.coalesce(F.round(F.try_divide(F.col("correct"), total), 4), F.lit(0.0)))
    if margins is None:
        out = out.withColumn("mean_margin", F.lit(None).cast("double"))
    else:
        out = out.join(margins.groupBy(session).agg(F.round(F.avg("margin"), 4).alias("mean_margin")), session, "left")
    out = out.withColumn("_p", -F.col("precision")).withColumn("_m", -F.coalesce("mean_margin", F.lit(0.0)))
    ranked = running_totals(out, ["_p", "_m", session], {"rank": F.lit(1)})
    return ranked.withColumn("rank", F.col("rank") + 1).withColumn("locked", F.col("precision") >= LOCK).drop("_p", "_m")


def align_chains(sessions: DataFrame, cells: DataFrame, pins: DataFrame | None = None, blocked: DataFrame | None = None, rejected: DataFrame | None = None, gap: float = GAP) -> DataFrame:
    """chain, session, i, j, place, pinned, expected: the pairs of each session, aligned with the expectation that its chain goes on where it was left.

    ``sessions`` has chain, session (unique), rank (unique in a chain), n, m, and start,
    the place of slot 0 in the chain; ``cells`` session, i, j and what ``nw_align`` takes.
    ``pins``, ``blocked`` and ``rejected`` have session, i, j: a pin rules out all else in
    its row, blocked pairs aren't matched, and rejected ones are taken out of what came of it.
    ``place`` is start + j; ``expected`` the slot at which item 0 was expected, null
    where no earlier session of the chain has a pair.  Sessions without a name are left out.

    All sessions are aligned at once; then each looks up the last place of the nearest
    one before it that has pairs, and those whose expectation has changed are aligned
    again, until none has.  After k rounds the first k sessions of each chain are what
    a walk along the chain gives, so this ends, and with the same pairs; only how many
    have changed reaches the driver.
    """
    key = ["session", "i", "j"]
    known = sessions.where("session is not null").select("chain", "session", "rank", "n", "m", "start")
    if blocked is not None:
        cells = cells.join(blocked.select(*key).distinct(), key, "left_anti")
    if pins is not None:
        cells = cells.join(pins.select(*key).distinct().withColumn("pinned", F.lit(True)), key, "full_outer").withColumn("pinned", F.coalesce("pinned", F.lit(False)))
    cells = cut(cells)

    def aligned(some: DataFrame) -> DataFrame:
        own = cells.join(some.select("session"), "session", "left_semi")
        pairs = nw_align(own, some, "session", gap=gap).where("i is not null and j is not null").select(*key)
        return pairs if rejected is None else pairs.join(rejected.select(*key).distinct(), key, "left_anti")

    state = cut(known.withColumn("expected", F.lit(None).cast("double")))
    pairs = cut(aligned(state))
    before = Window.partitionBy("chain").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        ends = pairs.groupBy("session").agg(F.max("j").alias("_end"))
        left = state.join(ends, "session", "left").withColumn("_left", F.last(F.col("start") + F.col("_end"), ignorenulls=True).over(before))
        now = left.withColumn("_now", (F.col("_left") + 1 - F.col("start")).cast("double"))
        state = cut(now.withColumn("_changed", ~F.col("_now").eqNullSafe(F.col("expected"))).withColumn("expected", F.col("_now")).drop("_end", "_left", "_now"))
        changed = state.where("_changed").drop("_changed")
        state = state.drop("_changed")
        if changed.isEmpty():
            break
        pairs = cut(pairs.join(changed.select("session"), "session", "left_anti").unionByName(aligned(changed)))
    out = pairs.join(state, "session")
    if pins is not None:
        out = out.join(pins.select(*key).distinct().withColumn("pinned", F.lit(True)), key, "left")
    else:
        out = out.withColumn("pinned", F.lit(False))
    return out.select("chain", "session", "i", "j", (F.col("start") + F.col("j")).alias("place"), F.coalesce("pinned", F.lit(False)).alias("pinned"), "expected")


def borders(pairs: DataFrame) -> DataFrame:
    """chain, session, first_i, first_place, last_i, last_place of each session that has pairs."""
    first, last = F.min(F.struct("i", "place")), F.max(F.struct("i", "place"))
    out = pairs.groupBy("chain", "session").agg(first.alias("a"), last.alias("b"))
    return out.select("chain", "session", F.col("a.i").alias("first_i"), F.col("a.place").alias("first_place"), F.col("b.i").alias("last_i"), F.col("b.place").alias("last_place"))
