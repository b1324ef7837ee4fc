"""Rule and similarity classification of short texts, and keywords in context."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import normalize_text, strip_punctuation
from weftline.operators.fuzzy_index import phrase_windows, similar_pairs, token_set_pairs
from weftline.operators.linking import char_terms, document_frequencies, term_counts, weighted


def rule_class(text: Column, rules: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """The class of the first pattern that is found in a text; ``default`` if none is."""
    out = None
    for pattern, name in rules:
        found = text.rlike(pattern)
        out = F.when(found, F.lit(name)) if out is None else out.when(found, F.lit(name))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def fuzzy_class(forms: DataFrame, labels: DataFrame, form: str, label: str, threshold: float = 70) -> DataFrame:
    """form, label, fuzzy_score: the label (the first of equals) most alike by token set ratio, none below the threshold.

    Distinct forms are compared with all labels that can reach it (``fuzzy_index.token_set_pairs``).
    """
    best = F.row_number().over(Window.partitionBy(form).orderBy(F.desc("fuzzy_score"), label))
    return token_set_pairs(forms, labels, form, label, threshold).withColumn("_n", best).where("_n = 1").drop("_n")


def tfidf_class(forms: DataFrame, labels: DataFrame, form: str, label: str, least: float = 0.15) -> DataFrame:
    """form, label, tfidf_score: the label (the first of equals) with the largest character n-gram cosine, from ``least`` on."""
    known = labels.select(label).where(F.col(label).isNotNull()).distinct()
    counts = term_counts(known, label, char_terms(label))
    idf = document_frequencies(counts, known)
    store = weighted(counts, idf, label)
    asked = forms.select(form).where(F.col(form).isNotNull()).distinct()
    q = weighted(term_counts(asked, form, char_terms(form)), idf, form, weight="wq")
    scores = q.join(store, "term").groupBy(form, label).agg(F.sum(F.col("wq") * F.col("w")).alias("tfidf_score")).where(F.col("tfidf_score") >= least)
    best = F.row_number().over(Window.partitionBy(form).orderBy(F.desc(F.round("tfidf_score", 9)), label))
    return scores.withColumn("_n", best).where("_n = 1").drop("_n")


def cascade(rows: DataFrame, text: str, labels: DataFrame, label: str, category: str, rules: Sequence[tuple[str, str]], use_store: bool = True) -> DataFrame:
    """Rows with canonical, method (tfidf, keyword, fuzzy, other) and score: each distinct form is classified once.

    First the label store, then the rules in order, then the nearest label by words, else ``other``.
    """
    forms = rows.select(strip_punctuation(text).alias("form")).distinct()
    out = forms
    if use_store:
        out = out.join(tfidf_class(forms, labels, "form", label).withColumnRenamed(label, "_t"), "form", "left")
    else:
        out = out.withColumn("_t", F.lit(None).cast("string")).withColumn("tfidf_score", F.lit(None).cast("double"))
    out = out.withColumn("_k", rule_class(F.col("form"), rules))
    rest = out.where("_t is null and _k is null").select("form")
    out = out.join(fuzzy_class(rest, labels, "form", label).withColumnRenamed(label, "_f"), "form", "left")
    method = F.when(F.col("_t").isNotNull(), "tfidf").when(F.col("_k").isNotNull(), "keyword").when(F.col("_f").isNotNull(), "fuzzy").otherwise("other")
    score = F.when(method == "tfidf", F.bround(F.col("tfidf_score") * 100, 0)).when(method == "keyword", 100.0).when(method == "fuzzy", F.col("fuzzy_score")).otherwise(0.0)
    named = out.select("form", F.coalesce("_t", "_k", "_f", F.lit("other")).alias("canonical"), method.alias("method"), score.cast("int").alias("score"))
    categories = labels.select(F.col(label).alias("canonical"), F.col(category).alias("category")).dropDuplicates(["canonical"])
    named = named.join(categories, "canonical", "left").withColumn("category", F.coalesce("category", F.lit("other")))
    return rows.withColumn("form", strip_punctuation(text)).join(named, "form")


def vocabulary(rows: DataFrame, text: str) -> DataFrame:
    """form, n: distinct normalised forms."""
    return rows.groupBy(strip_punctuation(text).alias("form")).agg(F.count("*").alias("n"))


def kwic(tokens: DataFrame, group: Sequence[str], pos: str, token: str, keyword: Column, window: int = 5) -> DataFrame:
    """group, pos, keyword, left_context, right_context of each token for which ``keyword`` holds."""
    w = Window.partitionBy(*group).orderBy(pos)
    left = F.array_join(F.collect_list(token).over(w.rowsBetween(-window, -1)), " ")
    right = F.array_join(F.collect_list(token).over(w.rowsBetween(1, window)), " ")
    return tokens.withColumn("left_context", left).withColumn("right_context", right).where(keyword).select(*group, pos, F.col(token).alias("keyword"), "left_context", "right_context")


def kwic_texts(rows: DataFrame, key: str, text: str, keyword: Callable[[Column], Column], window: int = 5) -> DataFrame:
    """key, pos, keyword, left_context, right_context of each word of a text for which ``keyword`` holds: texts are taken apart in place, and only the hits spread out."""
    words = rows.select(key, F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\s+").alias("_w"))
    hits = words.withColumn("pos", F.explode(F.filter(F.sequence(F.lit(0), F.size("_w") - 1), lambda i: keyword(F.get("_w", i)))))
    left, right = F.slice("_w", F.greatest(F.col("pos") - window, F.lit(0)) + 1, F.least(F.col("pos"), F.lit(window))), F.slice("_w", F.col("pos") + 2, F.lit(window))
    return hits.select(key, "pos", F.get("_w", F.col("pos")).alias("keyword"), F.array_join(left, " ").alias("left_context"), F.array_join(right, " ").alias("right_context"))


def context_search(contexts: DataFrame, needle: str) -> DataFrame:
    """Keyword rows in whose left or right context a text occurs."""
    n = needle.lower()
    return contexts.where(F.lower("left_context").contains(n) | F.lower("right_context").contains(n))


def method_report(classified: DataFrame) -> DataFrame:
    """method, category, n and its share."""
    sums = classified.groupBy("method", "category").agg(F.count("*").alias("n"))
    whole = sums.agg(F.sum("n").alias("_all"))
    return sums.crossJoin(F.broadcast(whole)).select("method", "category", "n", (F.col("n") / F.col("_all")).alias("share"))


def scan_rules(rows: DataFrame, key: str, text: str, rules: Sequence[tuple[str, str]], window: int = 5) -> DataFrame:
    """key, rule, start, end, surface, left_context, right_context of all rule matches; one within a match of an earlier rule is left out."""
    kind = dict(rows.dtypes)[key]
    compiled = [(name, re.compile(pattern, re.IGNORECASE)) for pattern, name in rules]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [key, "rule", "start", "end", "surface", "left_context", "right_context"]
        for frame in batches:
            out = []
            for k, t in zip(frame[key], frame[text], strict=True):
                taken: list[tuple[int, int]] = []
                for name, pattern in compiled:
                    for m in pattern.finditer(t or ""):
                        a, b = m.span()
                        if a == b or any(s <= a and b <= e for s, e in taken):
                            continue
                        taken.append((a, b))
                        out.append((k, name, a, b, m[0], " ".join(t[:a].rsplit(None, window)[-window:] if a else []), " ".join(t[b:].split(None, window)[:window])))
            yield pd.DataFrame(out, columns=columns)

    return rows.select(key, text).mapInPandas(run, f"{key} {kind}, rule string, start long, end long, surface string, left_context string, right_context string")


def proximity_hits(rows: DataFrame, key: str, text: str, first: str, second: str, within: int = 60, buffer: int = 80) -> DataFrame:
    """key, offset of each match of ``first`` from offset ``buffer`` on with a match of ``second`` within the ``within`` characters from its start."""
    kind = dict(rows.dtypes)[key]
    a, b = re.compile(first, re.IGNORECASE), re.compile(second, re.IGNORECASE)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = [(k, m.start()) for k, t in zip(frame[key], frame[text], strict=True) for m in a.finditer(t or "") if m.start() >= buffer and b.search(t[m.start() : m.start() + within])]
            yield pd.DataFrame(out, columns=[key, "offset"])

    return rows.select(key, text).mapInPandas(run, f"{key} {kind}, offset long")


def locate_spans(rows: DataFrame, key: str, text: str, needle: str) -> DataFrame:
    """key, needle, start, end of all occurrences, in any case and with any white space between words, not overlapping."""
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for k, t, n in zip(frame[key], frame[text], frame[needle], strict=True):
                words = (n or "").split()
                if words:
                    out += [(k, n, *m.span()) for m in re.finditer(r"\s+".join(map(re.escape, words)), t or "", re.IGNORECASE)]
            yield pd.DataFrame(out, columns=[key, needle, "start", "end"])

    return rows.select(key, text, needle).mapInPandas(run, f"{key} {kind}, {needle} string, start long, end long")


def merged_spans(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Spans of each key with overlapping ones merged."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce((F.col("start") >= before).cast("int"), F.lit(1))
    numbered = spans.withColumn("_b", begins).withColumn("_g", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_g")


def parse_markers(rows: DataFrame, key: str, text: str, markers: dict[str, str]) -> DataFrame:
    """key, ordinal, base_offset, kind of inline markers in order; offsets count the text without markers. ``markers`` maps kinds to literals."""
    kind = dict(rows.dtypes)[key]
    pattern = re.compile("|".join(f"(?P<{n}>{re.escape(m)})" for n, m in markers.items()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for k, t in zip(frame[key], frame[text], strict=True):
                gone = 0
                for i, m in enumerate(pattern.finditer(t or "")):
                    out.append((k, i, m.start() - gone, m.lastgroup))
                    gone += len(m[0])
            yield pd.DataFrame(out, columns=[key, "ordinal", "base_offset", "kind"])

    return rows.select(key, text).mapInPandas(run, f"{key} {kind}, ordinal int, base_offset long, kind string")


def phrase_hits(rows: DataFrame, key: str, text: str, phrases: DataFrame, phrase: str, threshold: float = 0.85) -> DataFrame:
    """Windows of texts that are phrases up to spelling: see ``fuzzy_index.phrase_windows``."""
    return phrase_windows(rows, key, text, phrases, phrase, threshold)


def fuzzy_tokens(tokens: DataFrame, names: DataFrame, token: str, name: str, threshold: float = 0.85) -> DataFrame:
    """token, name, similarity of distinct tokens and names that are alike by Levenshtein: see ``fuzzy_index.similar_pairs``."""
    return similar_pairs(tokens, names, token, name, threshold)
