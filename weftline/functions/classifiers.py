"""Enumerated classes of items, days, gaps and verdicts, as Column functions; a class is the first rule that holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds and markers that results must agree with.
SHORT_TEXT = 100
NO_DECISION = r"(?i)\b(geen resolutie|geen besluit|vereist geen|geen beslissing)\b"
NIHIL = r"(?i)^\s*nihil\s+actum\b"
CONTINUES = r"(?i)^(?:ende|nochte|daerop|mits|waerop|gelyck|verstaen\s+dat|wert\s+goetgevonden|voorts|vorders|belangende|sonder)\b"
OPENS = r"(?i)^(?:Ontfangen|Is\s+ge|Op(?:t)?|Gehoort|Gelesen|Synde|Alsoo|Staende|Presentibus|Nihil)"
LONGEST_FRAGMENT = 250
SOLID_SHARE, SEVERE_COLLAPSE, NEARLY_DETERMINED = 0.5, 7, 2
SHIFT_AUTOCORRELATION, SHIFT_COMPLEMENTARY = -0.3, 0.4
LARGE_GAP, REDESIGN = 0.15, 0.40
VERDICTS = {"0": "correct", "1": "false_positive", "?": "uncertain"}
SUMMARY_FIELDS = ("kind", "actor", "subject", "action_or_decision", "is_receipt_or_no_decision", "is_session_opening", "is_continuation", "evidence_quote", "uncertainty")


def match_kind(places: Column, orgs: Column) -> Column:
    """both, places_only, orgs_only or none, by whether two arrays hold anything."""
    p, o = F.coalesce(F.size(places) > 0, F.lit(False)), F.coalesce(F.size(orgs) > 0, F.lit(False))
    return F.when(p & o, "both").when(p, "places_only").when(o, "orgs_only").otherwise("none")


def bridge_kind(place: Column, org: Column, person: Column) -> Column:
    """The kinds that hold, joined by +; none if none does."""
    parts = F.concat_ws("+", F.when(place, "place"), F.when(org, "org"), F.when(person, "person"))
    return F.when(parts == "", "none").otherwise(parts)


def is_nihil(text: Column) -> Column:
    return F.coalesce(text.rlike(NIHIL), F.lit(False))


def short_item(text: Column) -> Column:
    """no_decision_marker, short_text or null."""
    t = F.coalesce(text, F.lit(""))
    return F.when(t.rlike(NO_DECISION), "no_decision_marker").when(F.length(t).between(1, SHORT_TEXT - 1), "short_text")


def segmentation(items: Column, records: Column) -> Column:
    return F.when(items == records, "matched_count").when(records < items, "under_segmented").otherwise("over_segmented")


def position_stratum(length: Column, initial: Column) -> Column:
    return F.concat_ws("_", length, F.when(initial, "initial").otherwise("non_initial"))


def structural_ceiling(signal: Column, paragraphs: Column) -> Column:
    """The share of a day's items that can stand apart at best."""
    return F.when((signal <= 0) | (paragraphs <= 0), 0.0).otherwise(F.least(F.lit(1.0), paragraphs / signal))


def headroom(ceiling: Column) -> Column:
    return F.when(ceiling < SOLID_SHARE, "structurally_capped").otherwise("headroom_available")


def collapse_cause(items: Column, paragraphs: Column) -> Column:
    forced = (paragraphs <= 0) | (F.ceil(F.try_divide(items, paragraphs)) >= SEVERE_COLLAPSE)
    return F.when(forced, "pigeonhole_forced").when(paragraphs < items, "axis_requires_repeats").otherwise("room_on_axis")


def shift_signature(autocorrelation: Column, complementary: Column, mean_residual: Column) -> Column:
    shift = F.coalesce(autocorrelation <= SHIFT_AUTOCORRELATION, F.lit(False)) | F.coalesce(complementary >= SHIFT_COMPLEMENTARY, F.lit(False))
    unknown = autocorrelation.isNull() & complementary.isNull()
    return F.when(shift, "shift_candidate").when(unknown, "inconclusive").when(mean_residual > 0, "uniform_shortfall").otherwise("inconclusive")


def bottleneck(oracle: Column, real: Column) -> Column:
    return F.when(oracle < REDESIGN, "algorithm_redesign").when(oracle - real >= LARGE_GAP, "tier_a_d_evidence").otherwise("tier_p_placement")


def gap_bucket(items: Column) -> Column:
    return F.when(items == 0, "determined").when(items <= NEARLY_DETERMINED, "nearly_determined").otherwise("open")


def is_continuation(text: Column) -> Column:
    """Whether a fragment goes on with what stood before: it begins in lower case or with a connective, or is short and doesn't open formally."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return (t != "") & (t.rlike(r"^\p{Ll}") | t.rlike(CONTINUES) | (~t.rlike(OPENS) & (F.length(t) < LONGEST_FRAGMENT)))


def formulaic(text: Column, opening: str = OPENS, closing: str = r"(?i)(?:goetgevonden|verstaen|gedaen|versocht)", tail: int = 150) -> tuple[Column, Column]:
    """Whether a text begins with an opening formula, and whether a closing one is among its last characters."""
    return F.coalesce(F.trim(text).rlike(opening), F.lit(False)), F.coalesce(F.right(text, F.lit(tail)).rlike(closing), F.lit(False))


def verdict(value: Column) -> Column:
    """The label of a verdict code; other texts stay, other numbers are null."""
    v = value.cast("string")
    known = F.coalesce(*[F.when(v == k, F.lit(x)) for k, x in VERDICTS.items()])
    return F.coalesce(known, F.when(~v.rlike(r"^-?\d+$"), v))


def selected_session(status: Column, trusted: Column, exact: Column, nearby_ambiguous: Column) -> tuple[Column, Column]:
    """The session that a single trusted or exact candidate gives, otherwise why there is none."""
    own = F.when(status == "T", trusted).when(status == "E", exact)
    one = F.size(own) == 1
    reason = (
        F.when(one, None)
        .when(own.isNotNull(), "invalid_unique_evidence")
        .when(status.isin("-1", "+1"), "nearby_policy_pending")
        .when(status.isin("A", "X", "?") | F.coalesce(nearby_ambiguous, F.lit(False)), "ambiguous_session_candidates")
        .otherwise("no_supported_session_candidate")
    )
    return F.when(one, F.element_at(own, 1)), reason


def positional_score(initial: Column, order: Column) -> Column:
    """1 for a session's first item, 2 for others, and up to 0.1 by its place in the session; the lower, the better."""
    place = F.when(F.coalesce(order, F.lit(0)) == 0, 999).otherwise(order)
    return F.when(initial, 1.0).otherwise(2.0) + F.least(F.lit(1.0), place / 100.0) * 0.1


def formula_score(opens: Column, closes: Column, alignment: Column) -> Column:
    """The alignment score less 1 with both formulas, less 0.3 with the opening one, plus 1 without."""
    return alignment + F.when(opens.isNotNull() & closes.isNotNull(), -1.0).when(opens.isNotNull(), -0.3).otherwise(1.0)


def position_evidence(best_match: Column) -> Column:
    """A match score of 0 to 100 as a bonus up to 1."""
    return F.least(F.lit(1.0), best_match / 100.0)


def summary_gate(json: Column, fields: Sequence[str] = SUMMARY_FIELDS) -> tuple[Column, Column]:
    """Whether a structured record has an evidence quote of more than 3 characters, and whether it has all fields."""
    keys = F.json_object_keys(json)
    quote = F.trim(F.coalesce(F.get_json_object(json, "$.evidence_quote"), F.lit("")))
    missing = F.array_except(F.array(*map(F.lit, fields)), keys)
    return F.coalesce(F.length(quote) > 3, F.lit(False)), F.coalesce(F.size(missing) == 0, F.lit(False))


def tiebreak_band(score: Column, low: float = 0.20, high: float = 0.55) -> Column:
    """Whether a best score is neither clear nor hopeless, so that a second opinion is worth asking for."""
    return (score > low) & (score < high)
