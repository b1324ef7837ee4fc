"""Which session of the text stream belongs to which date: evidence ledger, unique claims, resolution by precedence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.ordered import cut

from weftline.operators.joins import neighbour_candidates


def status_code(trusted: Column, exact: Column, previous: Column | None = None, following: Column | None = None) -> Column:
    """T or A for one or several trusted sessions, E or X for one or several of the exact date, else -1, +1 or ? for a single or several neighbours, else N.

    All are arrays; without neighbours given, a day without a session of its own is N.
    """
    n_trusted, n_exact = F.size(trusted), F.size(exact)
    out = F.when(n_trusted == 1, "T").when(n_trusted > 1, "A").when(n_exact == 1, "E").when(n_exact > 1, "X")
    if previous is not None and following is not None:
        a, b = F.size(previous), F.size(following)
        out = out.when((a == 1) & (b == 0), "-1").when((a == 0) & (b == 1), "+1").when(a + b > 0, "?")
    return out.otherwise("N")


def date_ledger(items: DataFrame, sessions: DataFrame, trusted: DataFrame) -> DataFrame:
    """One row for each (inventory, date) of ``items`` (inventory, date, item), with all candidates and a status code.

    ``sessions`` has inventory, date, session (a row for each record), ``trusted``
    inventory, date, session, item of confirmed links.  Rows without a date or an
    inventory are left out.  No ambiguous row is given a session.
    """
    key = ["inventory", "date"]
    known = "inventory is not null and date is not null"
    none = F.array().cast("array<string>")
    base = items.where(known).groupBy(*key).agg(F.count("*").alias("n_items"), F.array_sort(F.collect_set("item")).alias("items"))
    links = trusted.where(known).groupBy(*key).agg(F.array_sort(F.collect_set("session")).alias("trusted_sessions"), F.count("*").alias("n_trusted_links"), F.count_distinct("item").alias("n_trusted_items"))
    exact = sessions.where(known).groupBy(*key).agg(F.array_sort(F.collect_set("session")).alias("exact_sessions"), F.count("*").alias("n_records"))
    out = base.join(links, key, "left").join(exact, key, "left")
    out = out.withColumns({c: F.coalesce(c, none) for c in ("trusted_sessions", "exact_sessions")}).na.fill(0, ["n_trusted_links", "n_trusted_items", "n_records"])

    def near(days: int) -> DataFrame:
        moved = sessions.where(known).select("inventory", F.date_add("date", -days).alias("date"), "session")
        return moved.groupBy(*key).agg(F.array_sort(F.collect_set("session")).alias("before" if days < 0 else "after"))

    out = out.join(near(-1), key, "left").join(near(1), key, "left").withColumns({c: F.coalesce(c, none) for c in ("before", "after")})
    code = status_code(F.col("trusted_sessions"), F.col("exact_sessions"), F.col("before"), F.col("after"))
    return out.withColumn("status_code", code).withColumn("session_date_key", F.concat(F.lit("session-"), F.col("inventory").cast("string"), F.lit("|"), F.col("date").cast("string")))


def mutual_best(pairs: DataFrame, left: str, right: str, score: str) -> DataFrame:
    """Pairs that are the best of both their ends, by score and then by both keys: a round of the greedy claim."""
    a = F.row_number().over(Window.partitionBy(left).orderBy(F.desc(score), left, right))
    b = F.row_number().over(Window.partitionBy(right).orderBy(F.desc(score), left, right))
    return pairs.withColumn("_a", a).withColumn("_b", b).where("_a = 1 and _b = 1").drop("_a", "_b")


def greedy_claims(pairs: DataFrame, left: str, right: str, score: str, low_confidence: str | None = None) -> DataFrame:
    """Each left and each right key claimed once, the best pair first: left, right, score.

    Pairs are totally ordered by score, then left, then right key; then taking mutual
    best pairs round after round gives what one pass over the sorted pairs would, and
    each round is two ranked shuffles, however many pairs there are.  Rounds end when no
    pair is left; each is written out, to cut lineage.  Pairs of low confidence never claim.
    """
    rest = pairs.where(~F.col(low_confidence)) if low_confidence else pairs
    rest = cut(rest.groupBy(left, right).agg(F.max(score).alias(score)))
    out = None
    while not rest.isEmpty():
        taken = cut(mutual_best(rest, left, right, score))
        out = taken if out is None else out.unionByName(taken)
        rest = cut(rest.join(taken.select(left), left, "left_anti").join(taken.select(right), right, "left_anti"))
    return rest if out is None else out


def resolve_days(ledger: DataFrame, decisions: DataFrame, claims: DataFrame, scored: DataFrame, recoverable: DataFrame) -> DataFrame:
    """Each ledger row's day_status, resolved_session and resolution_source, by precedence.

    A single trusted or exact session; a human decision; a claimed candidate (``claims``:
    session_date_key, session; ``scored``: session_date_key, nihil); for N rows whether a
    session lies within reach (``recoverable``: session_date_key, offset); else uncertain.
    """
    key = "session_date_key"
    rows = (
        ledger.join(decisions.select(key, F.col("session").alias("_human"), F.lit(True).alias("_decided")), key, "left")
        .join(claims.select(key, F.col("session").alias("_claimed")), key, "left")
        .join(scored.select(key, F.col("nihil").alias("_nihil"), F.lit(True).alias("_scored")).dropDuplicates([key]), key, "left")
        .join(recoverable.select(key, F.col("offset").alias("_offset")), key, "left")
    )
    direct = F.when(F.col("status_code") == "T", F.element_at("trusted_sessions", 1)).when(F.col("status_code") == "E", F.element_at("exact_sessions", 1))
    missing = F.col("status_code") == "N"
    rules = [
        (direct.isNotNull(), "resolved_auto", direct, "ledger_direct"),
        (F.col("_decided"), "resolved_manual", F.col("_human"), "human_decision"),
        (F.col("_nihil"), "nihil_actum", None, "candidate_scoring"),
        (F.col("_claimed").isNotNull(), "resolved_auto", F.col("_claimed"), "candidate_scoring"),
        (missing & F.col("_offset").isNull(), "missing_htr", None, "ledger_n_status_no_recovery"),
        (missing & F.col("_scored"), "uncertain", None, "candidate_scoring_low_confidence"),
        (missing, "uncertain", None, "ledger_n_status_recoverable_wider_window"),
        (F.lit(True), "uncertain", None, "no_confident_source"),
    ]

    def ladder(values: Sequence[Column | None]) -> Column:
        out = None
        for (fits, *_), value in zip(rules, values, strict=True):
            fits, value = F.coalesce(fits, F.lit(False)), F.lit(None).cast("string") if value is None else value
            out = F.when(fits, value) if out is None else out.when(fits, value)
        return out

    return rows.select(ledger["*"], ladder([F.lit(r[1]) for r in rules]).alias("day_status"), ladder([r[2] for r in rules]).alias("resolved_session"), ladder([F.lit(r[3]) for r in rules]).alias("resolution_source"))


def select_status(candidates: DataFrame, keys: Sequence[str], status: str, session: str) -> DataFrame:
    """Of each day's status rows the best: human over automatic over nothing done over missing over uncertain; equal ranks with different sessions are ambiguous."""
    rank = F.when(F.col(status) == "resolved_manual", 0).when(F.col(status) == "resolved_auto", 1).when(F.col(status) == "nihil_actum", 2).when(F.col(status) == "missing_htr", 3).otherwise(4)
    ranked = candidates.withColumn("_rank", rank)
    best = F.min("_rank").over(Window.partitionBy(*keys))
    top = ranked.withColumn("_best", best).where("_rank = _best")
    out = top.groupBy(*keys).agg(F.count_distinct(session).alias("_n"), F.min(session).alias(session), F.min(status).alias(status))
    tied = F.col("_n") > 1
    return out.select(*keys, F.when(tied, "ambiguous").otherwise(F.col(status)).alias(status), F.when(~tied, F.col(session)).alias(session))


#: Ranks of alignment tiers; others come last.
TIER_RANK = {"tier1_anchor": 0, "tier2_interpolated": 1, "tier2_adjacent": 2, "tier2_merged_page": 3, "tier3_head_template": 4, "tier3_tail": 5}


def alignment_score(tier: Column, overlap: Column) -> Column:
    """The tier's rank less a tenth of the overlap within 0 and 1, not below 0: the lower, the better."""
    rank = F.coalesce(*[F.when(tier == t, F.lit(float(r))) for t, r in TIER_RANK.items()], F.lit(6.0))
    return F.greatest(F.lit(0.0), rank - F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(overlap, F.lit(0.0)))) * 0.1)


def nonsolid_class(solid: Column, invariant_ok: Column, nihil: Column, status: Column, signal: Column) -> Column:
    """Why a day isn't solid, the first reason that holds; null for solid days."""
    return (
        F.when(solid, None)
        .when(~invariant_ok, "v_violation")
        .when(nihil, "nihil_actum")
        .when(status == "missing_htr", "missing_htr")
        .when((status == "resolved_auto") | (F.coalesce(signal, F.lit(0)) > 0), "weak_separation")
        .otherwise("other")
    )


__all__ = ["alignment_score", "date_ledger", "greedy_claims", "mutual_best", "neighbour_candidates", "nonsolid_class", "resolve_days", "select_status", "status_code"]
