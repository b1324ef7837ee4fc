"""Training pairs, aliases, chain judgements and anchor harvest reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import corrected_offset
from weftline.operators.joins import keep_first


def training_pairs(annotations: DataFrame, entities: DataFrame, dates: DataFrame, paragraph: str = "paragraph_id") -> DataFrame:
    """Annotated spans with their entity's name and their paragraph's date: paragraph, entity, name, tag_text, start, end, date.

    Offsets are texts: ones that aren't whole numbers drop out, others are shifted and
    kept at 0 at least.  Spans without an entity or a date drop out; repeated (paragraph,
    entity, start, end) are kept once.
    """
    a = annotations.withColumn("start", corrected_offset("offset")).withColumn("end", corrected_offset("end")).where("start is not null and end is not null")
    out = a.join(entities.select(F.col("id").alias("entity"), "name"), "entity").join(dates.select(paragraph, "date"), paragraph)
    return keep_first(out, [paragraph, "entity", "start", "end"], "tag_text").select(paragraph, "entity", "name", "tag_text", "start", "end", "date")


def alias_table(pins: DataFrame, persons: DataFrame, overlap: DataFrame) -> DataFrame:
    """Of each person of a pinned item (pins: item, paragraph; persons: item, person, name; overlap: item, paragraph, person, surface, tag_text): pin_count and the sorted surfaces and tag texts that confirmed pins show."""
    own = pins.join(persons, "item")
    seen = overlap.select("item", "paragraph", "person", F.nullif(F.trim("surface"), F.lit("")).alias("surface"), F.nullif(F.trim("tag_text"), F.lit("")).alias("tag_text"))
    shown = own.join(seen, ["item", "paragraph", "person"], "left").groupBy("person").agg(F.array_sort(F.collect_set("surface")).alias("surfaces"), F.array_sort(F.collect_set("tag_text")).alias("tag_texts"))
    counts = own.groupBy("person").agg(F.count("*").alias("pin_count"), F.min("name").alias("name"))
    return counts.join(shown, "person")


def chain_judgement(gold: DataFrame, proposed: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Judged (item, place) pairs against a chain's proposals: judged, proposed, matches, match rate of proposed ones and of all."""
    rows = gold.join(proposed.select("item", F.col("place").alias("_place")), "item", "left")
    out = rows.groupBy(*group).agg(F.count("*").alias("judged"), F.count("_place").alias("proposed"), F.count_if(F.col("_place") == F.col("place")).alias("matches"))
    return out.withColumn("precision", F.try_divide("matches", "proposed")).withColumn("match_rate", F.try_divide("matches", "judged"))


def density_report(anchors: DataFrame, channel: str, day: str, position: str) -> DataFrame:
    """Of each channel its anchors, days, distinct positions and anchors a day."""
    out = anchors.groupBy(channel).agg(F.count("*").alias("anchors"), F.count_distinct(day).alias("days"), F.count_distinct(day, position).alias("positions"))
    return out.withColumn("per_day", F.col("anchors") / F.col("days"))


def supply_gain(anchors: DataFrame, abstained: DataFrame, day: str) -> DataFrame:
    """How many of the days that were abstained on have an anchor: abstained, supplied, share."""
    days = abstained.select(day).distinct()
    has = days.join(anchors.select(day).distinct().withColumn("_has", F.lit(True)), day, "left")
    return has.agg(F.count("*").alias("abstained"), F.count("_has").alias("supplied")).withColumn("share", F.try_divide("supplied", "abstained"))


def pin_ladder(pairs: DataFrame, explicit: Column, automatic: Column, first_anchor: Column, paragraphs: Column) -> DataFrame:
    """Pairs with paragraph and source: an explicit pin, an automatic one if it is of the resolution's paragraphs, its first anchor, its first paragraph."""
    inside = F.when(F.array_contains(paragraphs, automatic), automatic)
    first = F.try_element_at(paragraphs, F.lit(1))
    value = F.coalesce(explicit, inside, first_anchor, first)
    source = F.when(explicit.isNotNull(), "explicit").when(inside.isNotNull(), "automatic").when(first_anchor.isNotNull(), "anchor").when(first.isNotNull(), "first_paragraph")
    return pairs.withColumn("paragraph", value).withColumn("source", source)


def pinned_records(sources: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """The union of pin tables, of each key that of the first table that has it."""
    out = None
    for k, df in enumerate(sources):
        part = df.withColumn("_source", F.lit(k))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("_source"))
    return out.withColumn("_n", n).where("_n = 1").drop("_n", "_source")


def ngram_candidates(texts: DataFrame, names: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """key, name, span, exact: word n-grams of a text as long as a name that share a word with it, and whether one is the name itself.

    A name found as it stands has that span only.
    """
    n = names.select(F.lower(F.trim(name)).alias("name")).where("name <> ''").distinct().withColumn("_words", F.split("name", r"\s+")).withColumn("_n", F.size("_words"))
    t = texts.select(key, F.split(F.lower(F.trim(text)), r"\s+").alias("_tokens"))
    at = t.select(key, "_tokens", F.posexplode("_tokens").alias("_pos", "_word"))
    hits = at.join(n.select("name", "_n", F.posexplode("_words").alias("_i", "_word")), "_word")
    spread = hits.withColumn("_from", F.explode(F.sequence(F.greatest(F.col("_pos") - F.col("_n") + 1, F.lit(0)), F.col("_pos"))))
    spans = spread.where(F.col("_from") + F.col("_n") <= F.size("_tokens")).select(key, "name", F.array_join(F.slice("_tokens", F.col("_from") + 1, F.col("_n")), " ").alias("span")).distinct()
    exact = F.max((F.col("span") == F.col("name")).cast("int")).over(Window.partitionBy(key, "name")) == 1
    return spans.withColumn("exact", exact).where(~F.col("exact") | (F.col("span") == F.col("name")))


def stacked(rows: DataFrame, confidence: str, threshold: float = 80) -> tuple[DataFrame, DataFrame]:
    """Rows that a first classifier is sure of, and those that a second one should see."""
    sure = F.coalesce(F.col(confidence) >= threshold, F.lit(False))
    return rows.where(sure), rows.where(~sure)


def tolerance_sweep(pairs: DataFrame, difference: str, tolerances: Sequence[int], group: Sequence[str] = ()) -> DataFrame:
    """Of each tolerance the pairs within it and their share: one scan, a count for each."""
    d = F.abs(F.col(difference))
    counts = pairs.groupBy(*group).agg(F.count("*").alias("_all"), *[F.count_if(d <= t).alias(f"_{t}") for t in tolerances])
    rows = F.array(*[F.struct(F.lit(t).alias("tolerance"), F.col(f"_{t}").alias("pairs")) for t in tolerances])
    return counts.select(*group, "_all", F.explode(rows).alias("x")).select(*group, "x.tolerance", "x.pairs", F.try_divide("x.pairs", "_all").alias("share"))
