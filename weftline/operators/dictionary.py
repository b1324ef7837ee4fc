"""Many names in many texts: which strings of a dictionary stand anywhere in which texts, without comparing all with all.

A dictionary of a counted, small size goes to all tasks, where an automaton reads each
text once, whatever the number of names.  A larger one is dealt out: each name is kept
under the rarest of its grams, a text asks for those of its own grams that any name is
kept under, and only then are the two compared.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

import ahocorasick
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.fuzzy import pairwise, partial_ratio
from weftline.functions.text import normalize_text

#: The most names, and characters of all of them, that go to all tasks.
SMALL_NAMES, SMALL_CHARS = 1 << 17, 1 << 22
#: Lengths of grams; a name is kept under grams of the longest that it has.
GRAMS = (8, 4, 2, 1)

#: The broadcast of this worker's automaton, and the automaton.
_built: list = [None, None]


def _automaton(names: Broadcast) -> ahocorasick.Automaton:
    if _built[0] is not names:
        automaton = ahocorasick.Automaton()
        for name in names.value:
            automaton.add_word(name, name)
        automaton.make_automaton()
        _built[:] = [names, automaton]
    return _built[1]


def _found(names: Broadcast):
    """Of a text the distinct names that stand in it."""

    def run(texts: pd.Series) -> pd.Series:
        automaton = _automaton(names)
        return pd.Series([sorted({name for _, name in automaton.iter(t)}) if t else [] for t in texts], dtype=object)

    return F.pandas_udf(run, "array<string>")


def _all_grams(s: Column, size: int) -> Column:
    """The distinct runs of ``size`` characters."""
    places = F.filter(F.sequence(F.lit(1), F.length(s) + 1), lambda i: i <= F.length(s) - size + 1)
    return F.array_distinct(F.transform(places, lambda i: F.substring(s, i, F.lit(size))))


def _dealt(texts: DataFrame, names: DataFrame) -> DataFrame:
    """_key, _needle of texts (_key, _hay, both unique) and names (_needle, unique), by the rarest gram of each name."""
    size = F.lit(GRAMS[-1])
    for g in sorted(GRAMS):
        size = F.when(F.length("_needle") >= g, g).otherwise(size)
    sized = names.withColumn("_size", size)
    said = asked = None
    for g in GRAMS:
        own = sized.where(F.col("_size") == g).select("_needle", F.explode(_all_grams(F.col("_needle"), g)).alias("_gram"))
        asked = own if asked is None else asked.unionByName(own)
        # grams that no name has go no further
        spread = texts.select("_key", F.explode(_all_grams(F.col("_hay"), g)).alias("_gram")).join(own.select("_gram").distinct(), "_gram", "left_semi")
        said = spread if said is None else said.unionByName(spread)
    often = said.groupBy("_gram").agg(F.count("*").alias("_often"))
    # a name with a gram that no text has stands in none
    weighed = asked.join(often, "_gram", "left").groupBy("_needle").agg(F.min_by("_gram", F.struct("_often", "_gram")).alias("_gram"), F.bool_and(F.col("_often").isNotNull()).alias("_may"))
    met = said.join(weighed.where("_may").select("_gram", "_needle"), "_gram").select("_key", "_needle")
    return met.join(texts, "_key").where(F.col("_hay").contains(F.col("_needle"))).select("_key", "_needle")


def held_names(texts: DataFrame, text: Column | str, names: DataFrame, name: Column | str, into: str = "_needle", small: tuple[int, int] = (SMALL_NAMES, SMALL_CHARS)) -> DataFrame:
    """Rows of ``texts``, each once for every distinct name that stands anywhere in its text, with that name as ``into``.

    Strings are compared as they are.  Null and empty names stand in nothing, null texts
    hold nothing; rows that repeat give rows that repeat.  Up to ``small`` (names,
    characters in all) the names go to all tasks, and no text is shuffled.
    """
    hay = F.col(text) if isinstance(text, str) else text
    known = names.select((F.col(name) if isinstance(name, str) else name).alias("_needle")).where("_needle <> ''").distinct()
    count, size = known.agg(F.count("*"), F.coalesce(F.sum(F.length("_needle")), F.lit(0))).first()
    if count == 0:
        return texts.withColumn(into, F.lit(None).cast("string")).where(F.lit(False))
    if count <= small[0] and size <= small[1]:
        sent = texts.sparkSession.sparkContext.broadcast(sorted(r._needle for r in known.collect()))
        return texts.withColumn(into, F.explode(_found(sent)(F.coalesce(hay, F.lit("")))))
    keyed = texts.withColumn("_key", F.sha2(hay, 256))
    once = keyed.select("_key", hay.alias("_hay")).where("_key is not null").dropDuplicates(["_key"])
    return keyed.join(_dealt(once, known).withColumnRenamed("_needle", into), "_key").drop("_key")


def confirm_names(shortlist: DataFrame, texts: DataFrame, names: DataFrame, text_id: str, text: str, name_id: str, name: str, threshold: float = 85) -> DataFrame:
    """text_id, name_id, match_method (exact, fuzzy), match_score: of shortlisted pairs those whose name, in lower case, stands in the text, or whose best window of the text reaches the ratio.

    ``shortlist`` has text_id and name_id; pairs that repeat count once, and those without
    a text or a name give nothing.  The ratio is only taken where the name doesn't stand.
    """
    pairs = shortlist.select(text_id, name_id).distinct()
    pairs = pairs.join(names.select(name_id, F.lower(name).alias("_name")).where("_name <> ''"), name_id).join(texts.select(text_id, F.lower(text).alias("_text")).where("_text <> ''"), text_id)
    exact = F.col("_text").contains(F.col("_name"))
    held = pairs.withColumn("_exact", exact)
    sure = held.where("_exact").select(text_id, name_id, F.lit("exact").alias("match_method"), F.lit(100.0).alias("match_score"))
    near = held.where("not _exact").withColumn("match_score", pairwise(partial(partial_ratio, least=threshold), "_name", "_text")).where(F.col("match_score") >= threshold)
    return sure.unionByName(near.select(text_id, name_id, F.lit("fuzzy").alias("match_method"), "match_score")).groupBy(text_id, name_id).agg(F.min("match_method").alias("match_method"), F.max("match_score").alias("match_score"))


def normalised_pairs(texts: DataFrame, names: DataFrame, block: Sequence[str], text: str, name: str, least: int = 1) -> DataFrame:
    """Rows of texts with ``_needle``, a normalised name of their block of ``least`` characters or more that stands in their normalised text."""
    known = names.select(*block, normalize_text(name).alias("_needle")).where(F.length("_needle") >= least).distinct()
    return held_names(texts, normalize_text(text), known, "_needle").join(known, [*block, "_needle"], "left_semi")
