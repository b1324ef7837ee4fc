"""Pairs of strings alike by edits, from an inverted index that loses none, and phrases in texts up to spelling.

Edits can't touch everything: of k + 1 segments of a string, k edits leave one as it
is, and little moved.  So strings within k edits share a segment, at a place that the
edits before and after it allow, and an equality join on (lengths, segment) finds all
pairs.  For ratios by common subsequence it is characters that must be shared: of two
strings sorted by how rare their characters are, the beginnings meet.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.fuzzy import levenshtein_similarity, pairwise, token_set_ratio
from weftline.functions.text import normalize_text

#: Guards bounds against rounding: a pair too many is measured, none is lost.
_EPS = 1e-9
#: Characters of a phrase's segment that are looked up in texts, and of a cell in which windows are found.
PART, CELL = 8, 32


def _edits(a: Column, b: Column, threshold: float) -> Column:
    """The most edits between strings of lengths a and b that are as alike as ``threshold``."""
    return F.floor(F.greatest(a, b) * (1 - threshold) + _EPS).cast("int")


def _lengths(n: Column, threshold: float) -> Column:
    """The lengths that a string as alike to one of length n may have."""
    return F.sequence(F.ceil(n * threshold - _EPS).cast("int"), F.floor(n / threshold + _EPS).cast("int"))


def _segments(n: Column, k: Column) -> Column:
    """Place (from 0) and length of k + 1 segments of about the same length."""
    base, rest = F.floor(n / (k + 1)).cast("int"), n % (k + 1)
    at = lambda i: (i * base + F.greatest(F.lit(0), i - (k + 1 - rest))).cast("int")
    return F.transform(F.sequence(F.lit(0), k), lambda i: F.struct(i.alias("i"), at(i).alias("at"), (at(i + 1) - at(i)).alias("size")))


def similar_pairs(left: DataFrame, right: DataFrame, a: str, b: str, threshold: float = 0.85) -> DataFrame:
    """a, b, similarity: all pairs of distinct strings whose Levenshtein similarity (1 less edits over the longer length) reaches the threshold.

    Null is like nothing, empty strings are alike.  ``threshold`` must be above one half:
    below it strings without a common character may be alike.  A pair meets once for each
    segment that it shares; it is measured there, and only alike pairs are shuffled on.
    """
    if not 0.5 < threshold <= 1:
        raise ValueError("the threshold must be above one half, and one at most")
    if a.lower() == b.lower():
        raise ValueError("both columns need names of their own")
    n = F.length("_s")
    own = right.select(F.col(b).cast("string").alias("_s")).where("_s is not null").distinct()
    kept = own.withColumn("_n", n).select(F.col("_s").alias(b), F.col("_n").alias("_b"), F.explode(_lengths(n, threshold)).alias("_a"), F.col("_s"))
    kept = kept.withColumn("_k", _edits(F.col("_a"), F.col("_b"), threshold)).select(b, "_a", "_b", "_s", F.explode(_segments(F.col("_b"), F.col("_k"))).alias("_x"))
    kept = kept.select(b, "_a", "_b", F.col("_x.i").alias("_i"), F.expr("substring(_s, _x.at + 1, _x.size)").alias("_part"))

    asked = left.select(F.col(a).cast("string").alias("_s")).where("_s is not null").distinct()
    asked = asked.select(F.col("_s").alias(a), "_s", n.alias("_a"), F.explode(_lengths(n, threshold)).alias("_b"))
    asked = asked.withColumn("_k", _edits(F.col("_a"), F.col("_b"), threshold)).select(a, "_a", "_b", "_k", "_s", F.explode(_segments(F.col("_b"), F.col("_k"))).alias("_x"))
    # edits before a segment move it by as many places at most, and so do those after it, counted from the end
    first = F.expr("greatest(0, _x.at - _x.i, _x.at + _a - _b - (_k - _x.i))")
    last = F.expr("least(_a - _x.size, _x.at + _x.i, _x.at + _a - _b + (_k - _x.i))")
    places = asked.select(a, "_a", "_b", "_x", "_s", first.alias("_first"), last.alias("_last")).where("_first <= _last")
    parts = F.array_distinct(F.transform(F.expr("sequence(_first, greatest(_first, _last))"), lambda p: F.substring(F.col("_s"), p + 1, F.col("_x.size"))))
    places = places.select(a, "_a", "_b", F.col("_x.i").alias("_i"), F.explode(parts).alias("_part"))
    met = places.join(kept, ["_a", "_b", "_i", "_part"]).withColumn("similarity", levenshtein_similarity(a, b))
    return met.where(F.col("similarity") >= threshold).select(a, b, "similarity").distinct()


def _marked(s: Column) -> Column:
    """A string's characters, each with how many like it are before: as many marks are shared as characters are."""
    letters = F.array_sort(F.split(s, ""))
    seen = F.transform(letters, lambda c, i: F.struct(c.alias("c"), (i - F.array_position(letters, c) + 1).alias("n")))
    return F.transform(seen, lambda x: F.concat(x["c"], x["n"].cast("string")))


def token_set_pairs(forms: DataFrame, labels: DataFrame, form: str, label: str, threshold: float = 70) -> DataFrame:
    """form, label, fuzzy_score: all pairs of distinct strings whose token set ratio reaches the threshold (0 to 100, above 0).

    A pair that shares a word meets there.  Of one that doesn't, at least a share
    r = threshold / 200 of the characters of both is common, so r / (1 - r) of either's,
    and it meets at one of the rarest characters of either.  Nulls and strings without
    words are like nothing.
    """
    if not 0 < threshold <= 100:
        raise ValueError("the threshold must be above 0, and 100 at most")
    share = threshold / 200
    least = share / (1 - share)

    def read(df: DataFrame, c: str) -> DataFrame:
        words = F.array_sort(F.array_distinct(F.filter(F.split(F.col(c), r"\s+"), lambda w: w != "")))
        rows = df.select(F.col(c).cast("string").alias(c)).where(F.col(c).isNotNull()).distinct().withColumn("_words", words).where(F.size("_words") > 0)
        return rows.withColumn("_n", F.length(F.array_join("_words", " "))).withColumn("_marks", _marked(F.array_join("_words", " ")))

    a, b = read(forms, form), read(labels, label)
    each = [x.select(F.explode("_marks").alias("_mark")) for x in (a, b)]
    rarity = each[0].unionByName(each[1]).groupBy("_mark").agg(F.count("*").alias("_often"))

    def rarest(x: DataFrame, c: str) -> DataFrame:
        # as many marks as leave fewer than must be shared
        most = F.col("_n") - F.ceil(F.col("_n") * least - _EPS) + 1
        placed = x.select(c, "_n", F.explode("_marks").alias("_mark")).join(rarity, "_mark")
        return placed.withColumn("_at", F.row_number().over(Window.partitionBy(c).orderBy("_often", "_mark"))).where(F.col("_at") <= most).select(c, "_mark")

    wordwise = a.select(form, F.explode("_words").alias("_w")).join(b.select(label, F.explode("_words").alias("_w")), "_w").select(form, label)
    left = rarest(a, form).join(a.select(form, F.col("_n").alias("_na"), F.col("_marks").alias("_ma")), form)
    right = rarest(b, label).join(b.select(label, F.col("_n").alias("_nb"), F.col("_marks").alias("_mb")), label)
    common = F.size(F.array_intersect("_ma", "_mb")) + _EPS >= (F.col("_na") + F.col("_nb")) * share
    near = (F.col("_na") + _EPS >= F.col("_nb") * least) & (F.col("_nb") + _EPS >= F.col("_na") * least)
    met = left.join(right, "_mark").where(near & common).select(form, label)
    scored = wordwise.unionByName(met).distinct().withColumn("fuzzy_score", pairwise(token_set_ratio, form, label))
    return scored.where(F.col("fuzzy_score") >= threshold)


def _words_of(context: int):
    """Of a text's words the number, the place of the first character, the word's length, and ``context`` characters from there on (all of the word, and one more, at least)."""

    def run(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            at, rows = 0, []
            for k, word in enumerate(text.split(" ")):
                rows.append({"word_start": k, "start": at, "size": len(word), "context": text[at : at + max(context, len(word) + 1 + PART)]})
                at += len(word) + 1
            out.append(rows)
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "array<struct<word_start:int,start:int,size:int,context:string>>")


#: Up to so many phrases, of so many characters in all, every task has them all; more are joined by their segments.
FEW_PHRASES, FEW_CHARACTERS = 1 << 15, 1 << 21
#: Classes of characters that are counted, and places that are compared at a time.
_CLASSES, _AT_ONCE = 32, 1 << 16


def _rolling(codes: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all runs of ``size`` characters."""
    out = np.zeros(max(0, len(codes) - size + 1), dtype=np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + len(out)] + np.uint64(1)
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4").astype(np.uint64)


def _spread(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each k the numbers first[k], first[k] + 1, .. of which there are n[k]: their k, and they themselves."""
    k = np.repeat(np.arange(len(n)), n)
    return k, np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def _windows_like(phrases: list[str], segments: list[tuple[int, int, int, str]], threshold: float):
    """Of a text the windows that may be one of ``phrases`` up to spelling: all that hold a segment (phrase, place, edits, characters) where edits allow it, and whose length and characters allow it, too."""
    sizes = np.array([len(p) for p in phrases])
    counts = np.array([p.count(" ") + 1 for p in phrases])
    bags = np.stack([np.bincount((_codes(p) % _CLASSES).astype(int), minlength=_CLASSES) for p in phrases])
    by_size: dict[int, list[tuple[int, int, int, int]]] = {}
    for p, at, edits, part in segments:
        by_size.setdefault(len(part), []).append((int(_rolling(_codes(part), len(part))[0]), p, at, edits))
    tables = []
    for size, rows in sorted(by_size.items()):
        rows.sort()
        hashes, first, n = np.unique(np.array([r[0] for r in rows], dtype=np.uint64), return_index=True, return_counts=True)
        tables.append((size, hashes, first, n, *np.array([r[1:] for r in rows]).T))

    def read(text: str) -> list[dict]:
        codes = _codes(text)
        blanks = np.flatnonzero(codes == 32)
        starts, ends = np.concatenate(([0], blanks + 1)), np.append(blanks, len(codes))
        # characters before each word, by class
        place = np.searchsorted(starts, np.arange(len(codes)), side="right")
        before = np.zeros((len(starts) + 1, _CLASSES), dtype=np.int32)
        np.add.at(before, (place, (codes % _CLASSES).astype(int)), 1)
        before = np.cumsum(before, axis=0, dtype=np.int32)
        seen = []
        for size, hashes, first, n, phrase, at, edits in tables:
            own = _rolling(codes, size)
            slot = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
            hit = np.flatnonzero(hashes[slot] == own)
            if not len(hit):
                continue
            total = np.cumsum(n[slot[hit]])
            for part in np.split(hit, np.searchsorted(total, np.arange(_AT_ONCE, total[-1], _AT_ONCE))):
                k, entry = _spread(first[slot[part]], n[slot[part]])
                begin, who = part[k] - at[entry], phrase[entry]
                low, high = np.searchsorted(starts, begin - edits[entry]), np.searchsorted(starts, begin + edits[entry], side="right")
                k, word = _spread(low, high - low)
                who = who[k]
                fits = word + counts[who] <= len(starts)
                who, word = who[fits], word[fits]
                last = word + counts[who] - 1
                length = ends[last] - starts[word]
                longer = np.maximum(length, sizes[who])
                near = np.abs(length - sizes[who]) <= longer * (1 - threshold) + _EPS
                pair = np.unique(who[near] * len(starts) + word[near])
                who, word = pair // len(starts), pair % len(starts)
                last = word + counts[who] - 1
                longer = np.maximum(ends[last] - starts[word], sizes[who])
                # the blank after the last word is counted with it, but at a text's end
                bag = before[last + 1] - before[word]
                bag[:, 32 % _CLASSES] -= last + 1 < len(starts)
                bag = bag - bags[who]
                apart = np.maximum(np.maximum(bag, 0).sum(axis=1), np.maximum(-bag, 0).sum(axis=1))
                seen.append(pair[apart <= longer * (1 - threshold) + _EPS])
        found = np.unique(np.concatenate(seen)).tolist() if seen else []
        out = []
        for pair in found:
            who, word = divmod(pair, len(starts))
            a, b = int(starts[word]), int(ends[word + counts[who] - 1])
            out.append({"phrase": phrases[who], "word_start": word, "start": a, "window": text[a:b]})
        return out

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([read(text) for text in texts], dtype=object)

    return F.pandas_udf(run, "array<struct<phrase:string,word_start:int,start:int,window:string>>")


def phrase_windows(rows: DataFrame, key: str, text: str, phrases: DataFrame, phrase: str, threshold: float = 0.85) -> DataFrame:
    """key, phrase, word_start, start, end, similarity: all windows of as many words as a phrase whose Levenshtein similarity with it reaches the threshold.

    Texts and phrases are normalised; word_start counts words, start and end (exclusive)
    characters of the normalised text, from 0.  Null and empty phrases and texts have no
    hits; rows that repeat a key and a text count once.  A phrase is cut into one segment
    more than a window so alike can have edits; the beginnings of the segments are looked
    up among the texts' characters, and windows that can hold them there are measured.
    Up to FEW_PHRASES phrases go to all tasks, where texts are searched in place; more
    are joined with the characters of the texts.
    """
    if not 0.5 < threshold <= 1:
        raise ValueError("the threshold must be above one half, and one at most")
    n = F.length("phrase")
    p = phrases.select(normalize_text(phrase).alias("phrase")).where("phrase <> ''").distinct()
    # a window is so long at most, and so many edits away
    most = F.floor(F.floor(n / threshold + _EPS) * (1 - threshold) + _EPS).cast("int")
    cut = p.select("phrase", F.size(F.split("phrase", " ")).alias("_words"), n.alias("_n"), most.alias("_k"), F.explode(_segments(n, most)).alias("_x"))
    cut = cut.select("phrase", "_words", "_n", "_k", F.col("_x.at").alias("_at"), F.expr(f"substring(phrase, _x.at + 1, least(_x.size, {PART}))").alias("_part"))
    normal = rows.select(F.col(key).alias("_key"), normalize_text(text).alias("_text")).where("_text <> ''").distinct()
    amount = p.agg(F.count("*").alias("n"), F.coalesce(F.sum(n), F.lit(0)).alias("characters")).first()
    if 0 < amount.n <= FEW_PHRASES and amount.characters <= FEW_CHARACTERS:
        few = cut.select("phrase", "_k", "_at", "_part").collect()  # bounded by both limits
        names = sorted({r["phrase"] for r in few})
        number = {name: k for k, name in enumerate(names)}
        like = _windows_like(names, [(number[r["phrase"]], r["_at"], r["_k"], r["_part"]) for r in few], threshold)
        met = normal.select("_key", F.explode(like("_text")).alias("_w")).select("_key", "_w.*").withColumn("similarity", levenshtein_similarity("window", "phrase"))
        met = met.where(F.col("similarity") >= threshold)
        return met.select(F.col("_key").alias(key), "phrase", "word_start", "start", (F.col("start") + F.length("window")).alias("end"), "similarity").distinct()
    about = cut.agg(F.max("_n").alias("longest"), F.collect_set(F.length("_part")).alias("sizes")).first()  # PART sizes at most
    longest = math.floor((about.longest or 0) / threshold + _EPS) + 1

    words = normal.select("_key", F.xxhash64("_text").alias("_row"), F.explode(_words_of(longest)("_text")).alias("_w")).select("_key", "_row", "_w.*")
    each = words.select("_key", "_row", "start", "context", F.explode(F.sequence(F.lit(0), F.col("size"))).alias("_c"))
    parts = F.array(*[F.expr(f"substring(context, _c + 1, {size})") for size in sorted(about.sizes)]) if about.sizes else F.array(F.lit(""))
    parts = each.select("_key", "_row", (F.col("start") + F.col("_c")).alias("_p"), F.explode(F.array_distinct(parts)).alias("_part"))
    hits = parts.join(cut, "_part")
    # where the phrase may begin: as far from the segment as edits can move it, by cells of characters
    begin = F.col("_p") - F.col("_at")
    spans = hits.select(F.col("_key"), "_row", "phrase", "_words", "_n", (begin - F.col("_k")).alias("_from"), (begin + F.col("_k")).alias("_to")).where("_to >= 0")
    cell = lambda c: F.floor(F.col(c) / CELL).cast("int")
    spans = spans.distinct().withColumn("_cell", F.explode(F.sequence(cell("_from"), cell("_to"))))
    starts = words.select(F.col("_key").alias("_key2"), "_row", "word_start", "start", "context", cell("start").alias("_cell"))
    met = spans.join(starts, ["_row", "_cell"]).where(F.col("_key").eqNullSafe(F.col("_key2")) & F.col("start").between(F.col("_from"), F.col("_to")))
    window = F.call_function("substring_index", F.substring("context", 1, longest), F.lit(" "), F.col("_words"))
    measured = met.select("_key", "phrase", "word_start", "start", "_words", window.alias("_window"))
    near = F.abs(F.length("_window") - F.length("phrase")) <= F.greatest(F.length("_window"), F.length("phrase")) * (1 - threshold) + _EPS
    measured = measured.where(near & (F.size(F.split("_window", " ")) == F.col("_words"))).withColumn("similarity", levenshtein_similarity("_window", "phrase"))
    found = measured.where(F.col("similarity") >= threshold)
    return found.select(F.col("_key").alias(key), "phrase", "word_start", "start", (F.col("start") + F.length("_window")).alias("end"), "similarity").distinct()
