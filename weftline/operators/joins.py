"""Joins that link two descriptions: date bands, priority cascades, name variants, containment, precedence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import normalize_text
from weftline.operators.dictionary import normalised_pairs

#: Shorter needles aren't sought within texts, shorter words not as words.
LEAST_SUBSTRING, LEAST_WORD = 3, 4
#: Characters of a fingerprint of one or two words by which candidates are found.
LEAST_GRAM = 12


def one_to_one(left: DataFrame, right: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """A join whose keys must be unique on both sides; the first repeated key, if any, raises when the result is computed."""

    def unique(df: DataFrame) -> DataFrame:
        n = F.count("*").over(Window.partitionBy(*keys))
        checked = F.when(n > 1, F.raise_error(F.concat(F.lit("repeated key: "), F.to_json(F.struct(*keys))))).otherwise(F.lit(True))
        return df.withColumn("_one", checked.cast("boolean")).where("_one").drop("_one")

    return unique(left).join(unique(right), list(keys), how)


def date_band_join(left: DataFrame, right: DataFrame, left_date: str, right_date: str, days: int, on: Sequence[str] = (), hook_date: str | None = None) -> DataFrame:
    """Pairs whose dates differ by ``days`` at most, with date_diff_days, and with ``hook_date`` the nearer of the two dates and date_match_source.

    Days are dealt out in cells of 2 x days + 1: a left row is in the cell of its day, a
    right row in the one or two that its band touches (for either date), so that the
    join is one on equal cells, and on the columns ``on``.
    """
    width, epoch = 2 * days + 1, F.lit("1970-01-01").cast("date")

    def cell(day: Column, shift: int) -> Column:
        return F.floor((F.datediff(day, epoch) + shift) / width)

    dates = [F.col(d) for d in (right_date, *([hook_date] if hook_date else []))]
    cells = F.array_compact(F.array_distinct(F.array(*[cell(d, shift) for d in dates for shift in (-days, days)])))
    pairs = left.withColumn("_cell", cell(F.col(left_date), 0)).join(right.withColumn("_cell", F.explode(cells)), ["_cell", *on]).drop("_cell")
    gap = F.least(*[F.coalesce(F.abs(F.datediff(F.col(left_date), d)), F.lit(1 << 30)) for d in dates], F.lit(1 << 30))
    pairs = pairs.where(gap <= days)
    near = F.abs(F.datediff(left_date, right_date))
    if not hook_date:
        return pairs.withColumn("date_diff_days", near)
    hook = F.abs(F.datediff(left_date, hook_date))
    far = F.lit(1 << 30)
    return pairs.withColumn("date_diff_days", F.least(F.coalesce(near, far), F.coalesce(hook, far))).withColumn("date_match_source", F.when(F.coalesce(near, far) <= F.coalesce(hook, far), "flat").otherwise("hook"))


def period_join(rows: DataFrame, periods: DataFrame, date: str, start: str, end: str, how: str = "inner", on: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Rows with the periods [start, end] that hold their date: periods are dealt out by the months that they touch, so that the join is one on equal months, and on the pairs of columns ``on``."""
    month = F.trunc(F.col(date).cast("date"), "MM")
    spread = periods.withColumn("_month", F.explode(F.sequence(F.trunc(F.col(start).cast("date"), "MM"), F.trunc(F.col(end).cast("date"), "MM"), F.expr("interval 1 month"))))
    inside = F.col(date).cast("date").between(F.col(start).cast("date"), F.col(end).cast("date"))
    left = rows.withColumn("_on", month)
    same = F.col("_on") == F.col("_month")
    for a, b in on:
        same = same & (F.col(a) == F.col(b))
    return left.join(spread, same & inside, how).drop("_on", "_month")


def keep_first(rows: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    """Of the rows of each key the first in ``order``, which should be total."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def union_by_priority(stages: Sequence[tuple[str, DataFrame]], keys: Sequence[str], *ties: Column | str) -> DataFrame:
    """The union of stages, each with ``match_kind``; of a key only what the earliest stage emits, and of that the first by ``ties``."""
    out = None
    for priority, (kind, df) in enumerate(stages):
        part = df.withColumn("match_kind", F.lit(kind)).withColumn("_priority", F.lit(priority))
        out = part if out is None else out.unionByName(part)
    return keep_first(out, keys, "_priority", *ties).drop("_priority")


def contained_names(texts: DataFrame, names: DataFrame, block: Sequence[str], text: str = "text", name: str = "name") -> DataFrame:
    """(text row, name) pairs of one block where the normalised name of LEAST_SUBSTRING letters or more stands anywhere in the normalised text."""
    held = normalised_pairs(texts, names, block, text, name, LEAST_SUBSTRING)
    return held.join(names.withColumn("_needle", normalize_text(name)), [*block, "_needle"]).drop("_needle")


def word_matches(texts: DataFrame, names: DataFrame, block: Sequence[str] = (), text: str = "text", word: str = "word") -> DataFrame:
    """Pairs where a word of LEAST_WORD letters or more is a whole word of the text: both sides as words, joined on equality."""
    said = texts.withColumn("_word", F.explode(F.array_distinct(F.split(normalize_text(text), r"[^\p{L}\p{N}]+")))).where(F.length("_word") >= LEAST_WORD)
    return said.join(names.withColumn("_word", normalize_text(word)), ["_word", *block]).drop("_word")


def surfaces_for_labels(surfaces: DataFrame, label: str = "label", entity: str = "entity") -> DataFrame:
    """label, surface: all labels that any entity of the label has, itself included."""
    pairs = surfaces.select(F.col(entity).alias("e"), F.col(label).alias("label")).where("e is not null and label is not null").distinct()
    return pairs.join(pairs.withColumnRenamed("label", "surface"), "e").select("label", "surface").distinct()


def nearest_offset(left: DataFrame, right: DataFrame, left_day: str, right_day: str, offsets: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    """Each left row with the right rows of the first offset, in the order given, at which there are any; ``offset`` is null where there are none."""
    tried = F.array(*[F.struct(F.lit(k).alias("rank"), F.lit(o).alias("offset")) for k, o in enumerate(offsets)])
    probe = left.withColumn("_row", F.monotonically_increasing_id()).withColumn("_try", F.explode(tried)).withColumn("_day", F.date_add(left_day, F.col("_try.offset")))
    hits = probe.join(right.withColumn("_day", F.col(right_day)), ["_day", *keys]).withColumn("offset", F.col("_try.offset"))
    best = F.min("_try.rank").over(Window.partitionBy(left_day, *keys))
    found = hits.withColumn("_best", best).where(F.col("_try.rank") == F.col("_best")).drop("_best", "_try", "_row", "_day")
    missing = left.join(found.select(left_day, *keys).distinct(), [left_day, *keys], "left_anti")
    return found.unionByName(missing, allowMissingColumns=True)


def by_absolute_offset(days: int) -> list[int]:
    """0, -1, 1, -2, 2, ..."""
    return [0, *(s * k for k in range(1, days + 1) for s in (-1, 1))]


def neighbour_candidates(rows: DataFrame, day: str, item: str) -> DataFrame:
    """day, exact, previous, following: sorted distinct items of each day of ``rows`` and of the days before and after it."""
    per_day = rows.where(F.col(item).isNotNull()).groupBy(F.col(day).alias("day")).agg(F.array_sort(F.collect_set(item)).alias("items"))
    empty = F.array().cast("array<string>")

    def shifted(k: int, name: str) -> DataFrame:
        return per_day.select(F.date_add("day", -k).alias("day"), F.col("items").alias(name))

    days = rows.select(F.col(day).alias("day")).where("day is not null").distinct()
    out = days.join(per_day.withColumnRenamed("items", "exact"), "day", "left").join(shifted(-1, "previous"), "day", "left").join(shifted(1, "following"), "day", "left")
    return out.select("day", *[F.coalesce(c, empty).alias(c) for c in ("exact", "previous", "following")])


def pair_overlap(left: DataFrame, right: DataFrame, left_id: str, right_id: str, item: str, block: Sequence[str] = ()) -> DataFrame:
    """Pairs that share an item: both ids, shared (sorted distinct items), n_shared."""
    a, b = left.select(left_id, item, *block).distinct(), right.select(right_id, item, *block).distinct()
    return a.join(b, [item, *block]).groupBy(left_id, right_id, *block).agg(F.array_sort(F.collect_set(item)).alias("shared")).withColumn("n_shared", F.size("shared"))


def anti_compare(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """The keys that only one table has, with side: old_only or new_only."""
    a, b = old.select(*keys).distinct(), new.select(*keys).distinct()
    return a.join(b, list(keys), "left_anti").withColumn("side", F.lit("old_only")).unionByName(b.join(a, list(keys), "left_anti").withColumn("side", F.lit("new_only")))


def fingerprint_matches(flat: DataFrame, raw: DataFrame, block: str, flat_id: str, flat_text: str, raw_id: str, raw_text: str, size: int = 150, least: int = 30) -> DataFrame:
    """flat_id with its raw_id, or null, and status: matched, ambiguous, missing or too_short.

    The first ``size`` characters of the normalised text are sought anywhere in the
    normalised raw texts of the block.  A print's ends may stand within words of the
    raw text, so candidates share an inner part of it: three inner words, or one of a
    print of three or four words, or the first LEAST_GRAM characters of a print of
    fewer words.  Only hashes of these and ids are spread out; a raw text is fetched
    once for each candidate pair.
    """
    prints = flat.select(F.col(block).alias("_block"), F.col(flat_id).alias(flat_id), F.substring(normalize_text(flat_text), 1, size).alias("_print"))
    own = F.split("_print", " ")
    kind = F.when(F.size(own) >= 5, 3).when(F.size(own) >= 3, 1).otherwise(0)
    gram = min(LEAST_GRAM, least)
    key = F.when(kind == 3, F.xxhash64(F.get(own, 1), F.get(own, 2), F.get(own, 3))).when(kind == 1, F.xxhash64(F.get(own, 1))).otherwise(F.xxhash64(F.substring("_print", 1, gram)))
    keyed = prints.where(F.length("_print") >= least).select("_block", flat_id, "_print", kind.alias("_kind"), key.alias("_key"))
    hay = raw.select(F.col(block).alias("_block"), F.col(raw_id).alias(raw_id), normalize_text(raw_text).alias("_hay"))
    # taken apart once, below what spreads it out
    cut, words = hay.withColumn("_words", F.split("_hay", " ")), F.col("_words")
    to = lambda n: F.greatest(n, F.lit(0))
    grams = {
        3: F.transform(F.slice(F.sequence(F.lit(0), F.size(words)), F.lit(1), to(F.size(words) - 2)), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))),
        1: F.transform(words, lambda w: F.xxhash64(w)),
        0: F.transform(F.slice(F.sequence(F.lit(1), F.length("_hay") + 1), F.lit(1), to(F.length("_hay") - gram + 1)), lambda i: F.xxhash64(F.substring(F.col("_hay"), i, F.lit(gram)))),
    }
    pairs = None
    for k, keys in grams.items():
        asked = keyed.where(F.col("_kind") == k).select("_block", "_key", flat_id)
        # raw texts of blocks without prints of this kind are not taken apart
        spread = cut.join(asked.select("_block").distinct(), "_block", "left_semi").select("_block", raw_id, F.explode(F.array_distinct(keys)).alias("_key"))
        part = spread.join(asked, ["_block", "_key"]).select("_block", flat_id, raw_id)
        pairs = part if pairs is None else pairs.unionByName(part)
    found = pairs.distinct().join(keyed.select("_block", flat_id, "_print"), ["_block", flat_id]).join(hay, ["_block", raw_id]).where(F.col("_hay").contains(F.col("_print")))
    counted = found.groupBy("_block", flat_id).agg(F.count_distinct(raw_id).alias("_n"), F.min(raw_id).alias("_raw"))
    out = prints.join(counted, ["_block", flat_id], "left")
    status = F.when(F.length("_print") < least, "too_short").when(F.col("_n") == 1, "matched").when(F.col("_n") > 1, "ambiguous").otherwise("missing")
    return out.select(F.col("_block").alias(block), flat_id, F.when(status == "matched", F.col("_raw")).alias(raw_id), status.alias("status"))


def unique_containers(items: DataFrame, containers: DataFrame, block: Sequence[str], item: str, text: str, container_id: str) -> DataFrame:
    """Items with the id of the single container of their block that holds their normalised text; null if there is none or several."""
    hits = normalised_pairs(containers.select(*block, container_id, F.col(text).alias("_text")), items, block, "_text", item)
    one = hits.groupBy(*block, "_needle").agg(F.count_distinct(container_id).alias("_n"), F.min(container_id).alias("_c"))
    found = items.withColumn("_needle", normalize_text(item)).join(one, [*block, "_needle"], "left")
    return found.withColumn(container_id, F.when(F.col("_n") == 1, F.col("_c"))).drop("_n", "_c", "_needle")


def first_available(*choices: tuple[str, Column]) -> tuple[Column, Column]:
    """Of named choices the first that isn't null: its value and its name (null if there is none)."""
    name = F.coalesce(*[F.when(value.isNotNull(), F.lit(label)) for label, value in choices])
    return F.coalesce(*[value for _, value in choices]), name


def pools_by_priority(days: DataFrame, stages: Sequence[DataFrame], day: str, item: str) -> DataFrame:
    """Each day's items from the first of several (day, item) tables that has any for it, with ``pool``, that table's number."""
    out = None
    for k, df in enumerate(stages):
        part = df.select(day, item).withColumn("pool", F.lit(k))
        out = part if out is None else out.unionByName(part)
    best = F.min("pool").over(Window.partitionBy(day))
    return out.join(days.select(day).distinct(), day, "left_semi").withColumn("_best", best).where("pool = _best").drop("_best").distinct()


def latest_per_key(log: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    """The last entry of each key: last write wins."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c).desc() if isinstance(c, str) else c for c in order]))
    return log.withColumn("_n", n).where("_n = 1").drop("_n")


def overlay_decisions(rows: DataFrame, decisions: DataFrame, key: str, candidates: str, chosen: str = "chosen", status: str = "status") -> DataFrame:
    """Rows with the decision on them: final, decided_by (human or automatic), and violation, null if the decision is sound.

    A decision's status must be the row's, and what it chooses one of the row's candidates; a violating decision isn't applied.
    """
    d = decisions.select(F.col(key), F.col(chosen).alias("_chosen"), F.col(status).alias("_status"), F.lit(True).alias("_made"))
    out = rows.join(d, key, "left")
    wrong = (
        F.when(F.col("_made").isNull(), None)
        .when(~F.col("_status").eqNullSafe(F.col(status)), "status differs")
        .when(F.col("_chosen").isNotNull() & ~F.coalesce(F.array_contains(candidates, F.col("_chosen")), F.lit(False)), "not a candidate")
    )
    sound = F.col("_made").isNotNull() & wrong.isNull()
    final = F.when(sound, F.col("_chosen")).when(F.size(candidates) == 1, F.element_at(candidates, 1))
    by = F.when(sound, "human").when(final.isNotNull(), "automatic")
    return out.withColumn("final", final).withColumn("decided_by", by).withColumn("violation", wrong).drop("_chosen", "_status", "_made")


def evidence_sources(rows: DataFrame, key: str, lists: Sequence[str], item: str = "item") -> DataFrame:
    """key, item, sources: of each item in any of several list columns the sorted names of the columns that hold it."""
    entries = F.flatten(F.array(*map(_tagged, lists)))
    return rows.select(key, F.explode(entries).alias("e")).groupBy(key, F.col("e.item").alias(item)).agg(F.array_sort(F.collect_set("e.source")).alias("sources"))


def _tagged(column: str) -> Column:
    return F.transform(F.coalesce(F.col(column), F.array().cast("array<string>")), lambda x: F.struct(x.alias("item"), F.lit(column).alias("source")))


def locate_offsets(offsets: DataFrame, parts: DataFrame, group: str, offset: str, pos: str, length: str, gap: int = 1) -> DataFrame:
    """Offsets in a stream of parts joined by ``gap`` characters, with the part's ``pos`` and the offset within it.

    A part holds the offsets from its start up to the next part's start; the stream's
    end belongs to the last part, and what lies beyond is null.
    """
    w = Window.partitionBy(group).orderBy(pos)
    start = F.coalesce(F.sum(F.col(length) + gap).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = F.lead(pos).over(w).isNull()
    axis = parts.select(F.col(group).alias("_group"), F.col(pos).alias("_pos"), start.alias("_start"), (F.col(length) + F.when(last, 1).otherwise(gap)).alias("_size"))
    inside = (F.col(group) == F.col("_group")) & (F.col(offset) >= F.col("_start")) & (F.col(offset) < F.col("_start") + F.col("_size"))
    out = offsets.join(axis, inside, "left")
    return out.withColumn(pos, F.col("_pos")).withColumn("offset_in_part", F.col(offset) - F.col("_start")).drop("_group", "_pos", "_start", "_size")


def label_intervals(tokens: DataFrame, spans: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """Tokens with ``inside``: whether they overlap any span of their key, both being half-open."""
    s = spans.select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e"))
    hits = tokens.join(s, list(keys)).where((F.col(start) < F.col("_e")) & (F.col(end) > F.col("_s"))).select(*keys, start, end).distinct().withColumn("inside", F.lit(True))
    return tokens.join(hits, [*keys, start, end], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))


def blocked_links(rejected: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Rejected (item, resolution) pairs as (item, paragraph) pairs: a resolution stands for all its paragraphs."""
    return rejected.join(paragraphs, "resolution_id").select("item", "paragraph_id").distinct()
