"""Retrieval by TF-IDF: term tables, sparse cosines, temporal gates, top-k links; and sparse or dense similarity."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.ranking import top_k

#: Weights of the two cosines, least score, boost of an attested year, years of tolerance, candidates.
CHAR_WEIGHT, WORD_WEIGHT, LEAST_SCORE, BOOST, TOLERANCE, TOP_K = 0.6, 0.4, 0.1, 0.1, 0, 5
#: Vectors of a block of queries and of rows, and queries of one product of matrices.
QUERY_BLOCK, ROW_BLOCK, PRODUCT_ROWS = 4096, 1 << 15, 256


def word_terms(text: Column | str, least: int = 1, most: int = 2) -> Column:
    """Word n-grams of a text in lower case; words are runs of two or more word characters."""
    t = F.col(text) if isinstance(text, str) else text
    words = F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit(r"(?U)(\b\w\w+\b)"), F.lit(1))
    return F.flatten(F.array(*[_grams(words, n) for n in range(least, most + 1)]))


def _grams(words: Column, n: int) -> Column:
    made = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))
    return F.when(F.size(words) >= n, made).otherwise(F.array().cast("array<string>"))


def char_terms(text: Column | str, least: int = 2, most: int = 4) -> Column:
    """Character n-grams within words padded with a space on either side; a padded word shorter than n counts once, for the first such n only."""
    t = F.col(text) if isinstance(text, str) else text
    words = F.filter(F.split(F.lower(F.coalesce(t, F.lit(""))), r"(?U)\s+"), lambda w: w != "")

    def grams(word: Column) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        size = F.length(padded)

        def of(n: Column) -> Column:
            return F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substring(padded, i, n))

        lengths = F.filter(F.sequence(F.lit(least), F.lit(most)), lambda n: (n <= size) | (n == F.greatest(F.lit(least), size + 1)))
        return F.flatten(F.transform(lengths, of))

    return F.flatten(F.transform(words, grams))


def term_counts(docs: DataFrame, key: str, terms: Column) -> DataFrame:
    """key, term, tf."""
    return docs.select(key, F.explode(terms).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def document_frequencies(counts: DataFrame, docs: DataFrame) -> DataFrame:
    """term, idf = ln((1 + documents) / (1 + documents with the term)) + 1; documents without terms count too."""
    total = docs.agg(F.count("*").alias("_docs"))
    df = counts.groupBy("term").agg(F.count("*").alias("_df"))
    return df.crossJoin(F.broadcast(total)).select("term", (F.ln((1 + F.col("_docs")) / (1 + F.col("_df"))) + 1).alias("idf"))


def weighted(counts: DataFrame, idf: DataFrame, key: str, sublinear: bool = False, weight: str = "w") -> DataFrame:
    """key, term, weight: tf (or 1 + ln tf) times idf, each key's to length one; terms without idf are left out."""
    tf = F.ln("tf") + 1 if sublinear else F.col("tf")
    raw = counts.join(idf, "term").select(key, "term", (tf * F.col("idf")).alias(weight))
    norm = F.sqrt(F.sum(F.col(weight) * F.col(weight)).over(Window.partitionBy(key)))
    return raw.withColumn(weight, F.col(weight) / norm)


def store(docs: DataFrame, key: str, text: str) -> dict[str, DataFrame]:
    """The two weighted term tables of a dictionary, and their idf tables: char, word, char_idf, word_idf."""
    out = {}
    for name, terms in (("char", char_terms(text)), ("word", word_terms(text))):
        counts = term_counts(docs, key, terms)
        out[f"{name}_idf"] = document_frequencies(counts, docs)
        out[name] = weighted(counts, out[f"{name}_idf"], key)
    return out


def cosines(queries: DataFrame, query_key: str, text: str, made: dict[str, DataFrame], key: str, kind: str) -> DataFrame:
    """query_key, key, cosine of the pairs that share a term: a join on terms, summed."""
    terms = char_terms(text) if kind == "char" else word_terms(text)
    q = weighted(term_counts(queries, query_key, terms), made[f"{kind}_idf"], query_key, weight="wq")
    return q.join(made[kind], "term").groupBy(query_key, key).agg(F.sum(F.col("wq") * F.col("w")).alias(f"{kind}_cosine"))


def dual_scores(queries: DataFrame, query_key: str, text: str, made: dict[str, DataFrame], key: str) -> DataFrame:
    """query_key, key, score = CHAR_WEIGHT x character cosine + WORD_WEIGHT x word cosine."""
    char, word = (cosines(queries, query_key, text, made, key, kind) for kind in ("char", "word"))
    both = char.join(word, [query_key, key], "full_outer")
    zero = F.lit(0.0)
    return both.select(query_key, key, (CHAR_WEIGHT * F.coalesce("char_cosine", zero) + WORD_WEIGHT * F.coalesce("word_cosine", zero)).alias("score"))


def temporal_weight(year: Column, low: Column, high: Column, tolerance: int = TOLERANCE) -> Column:
    """1 within [low, high], null bounds being open; beyond it 0, or with a tolerance falling to 0 linearly. A null year has weight 0 against any bound."""
    before = F.greatest(F.coalesce(low - year, F.lit(0)), F.lit(0))
    after = F.greatest(F.coalesce(year - high, F.lit(0)), F.lit(0))
    unknown = year.isNull() & (low.isNotNull() | high.isNotNull())
    far = F.greatest(before, after)
    near = F.when(far == 0, 1.0).otherwise(0.0) if tolerance <= 0 else F.greatest(1 - far / float(tolerance), F.lit(0.0))
    return F.when(unknown, 0.0).otherwise(near)


def link(
    queries: DataFrame,
    entities: DataFrame,
    query_key: str,
    text: str,
    year: str,
    key: str,
    name: str,
    low: str,
    high: str,
    attended: DataFrame | None = None,
    k: int = TOP_K,
    tolerance: int = TOLERANCE,
    least: float = LEAST_SCORE,
    boost: float = BOOST,
) -> DataFrame:
    """The k best entities of each query: query_key, rank, key, score (4 digits); candidates below ``least`` are left out.

    ``attended`` (key, year) multiplies the score of an entity attested in the query's year by 1 + ``boost``.
    """
    scores = dual_scores(queries, query_key, text, store(entities, key, name), key)
    rows = scores.join(queries.select(query_key, F.col(year).alias("_year")), query_key).join(entities.select(key, F.col(low).alias("_low"), F.col(high).alias("_high")), key)
    score = F.col("score") * temporal_weight(F.col("_year"), F.col("_low"), F.col("_high"), tolerance)
    if attended is not None and boost > 0:
        hit = attended.select(key, F.col("year").alias("_year"), F.lit(True).alias("_hit")).distinct()
        rows = rows.join(hit, [key, "_year"], "left")
        score = score * F.when(F.col("_hit"), 1 + boost).otherwise(1.0)
    kept = rows.withColumn("score", score).where(F.col("score") >= least)
    return top_k(kept, [query_key], k, "score", key).select(query_key, "rank", key, F.round("score", 4).alias("score"))


def overlap_scores(left: DataFrame, right: DataFrame, left_key: str, right_key: str, term: str, weights: DataFrame) -> DataFrame:
    """left_key, right_key, score = the summed idf of shared terms (1 for terms without one), n_shared."""
    a, b = left.select(left_key, term).distinct(), right.select(right_key, term).distinct()
    known = a.join(weights.select(term, "idf"), term, "left").withColumn("idf", F.coalesce("idf", F.lit(1.0)))
    return known.join(b, term).groupBy(left_key, right_key).agg(F.sum("idf").alias("score"), F.count("*").alias("n_shared"))


def similarity_matrix(left: DataFrame, right: DataFrame, group: Sequence[str], left_key: str, right_key: str, text: str) -> DataFrame:
    """group, both keys, similarity of each pair of a group that shares a term: 0.4 word (1, 2) + 0.6 character (3, 5) cosine, sublinear, 0 to 1.

    The corpus of each group's idf is both its sides.
    """
    sides = left.select(*group, F.lit("l").alias("side"), F.col(left_key).cast("string").alias("key"), text).unionByName(right.select(*group, F.lit("r").alias("side"), F.col(right_key).cast("string").alias("key"), text))
    total = sides.groupBy(*group).agg(F.count("*").alias("_docs"))
    out = None
    for share, terms in ((0.4, word_terms(text)), (0.6, char_terms(text, 3, 5))):
        counts = sides.select(*group, "side", "key", F.explode(terms).alias("term")).groupBy(*group, "side", "key", "term").agg(F.count("*").alias("tf"))
        df = counts.groupBy(*group, "term").agg(F.count("*").alias("_df")).join(total, list(group))
        raw = counts.join(df, [*group, "term"]).select(*group, "side", "key", "term", ((F.ln("tf") + 1) * (F.ln((1 + F.col("_docs")) / (1 + F.col("_df"))) + 1)).alias("w"))
        unit = raw.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*group, "side", "key"))))
        a, b = unit.where("side = 'l'").select(*group, "term", F.col("key").alias(left_key), F.col("w").alias("wl")), unit.where("side = 'r'").select(*group, "term", F.col("key").alias(right_key), F.col("w").alias("wr"))
        part = a.join(b, [*group, "term"]).groupBy(*group, left_key, right_key).agg((share * F.sum(F.col("wl") * F.col("wr"))).alias("s"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(*group, left_key, right_key).agg(F.least(F.greatest(F.sum("s"), F.lit(0.0)), F.lit(1.0)).alias("similarity"))


def dense_cosine(a: str, b: str) -> Column:
    """Cosine of two arrays in double precision; null if either is null or zero."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)

    def norm(c: str) -> Column:
        return F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))

    return F.try_divide(dot, norm(a) * norm(b))


def candidate_score(same_day: Column, places: Column, persons: Column, orgs: Column, types: Column, day_diff: Column) -> Column:
    """10000 for the same day, 300 a place, 100 a person, 100 an organisation, 1 a type, less 50 a day of difference."""
    return F.when(same_day, 10000).otherwise(0) + 300 * places + 100 * persons + 100 * orgs + types - 50 * F.abs(day_diff)


def ranked_sessions(pairs: DataFrame, row: str, session: str, overlap: str, similarity: str, floor: float = 5.0) -> DataFrame:
    """row, ranked: array of (session, overlap, similarity, combined, low_confidence), the best first; and the best one's values.

    combined = overlap + similarity; confidence is low up to an overlap of ``floor``.
    """
    entry = F.struct(
        (-(F.col(overlap) + F.col(similarity))).alias("negative"), F.col(session).alias("session"), F.col(overlap).alias("overlap"), F.col(similarity).alias("similarity"), (F.col(overlap) <= floor).alias("low_confidence")
    )
    out = pairs.groupBy(row).agg(F.array_sort(F.collect_list(entry)).alias("ranked"))
    top = F.element_at("ranked", 1)
    return out.select(row, "ranked", top["session"].alias("top_session"), (-top["negative"]).alias("top_score"), top["low_confidence"].alias("low_confidence"))


def half_up(x: Column, digits: int) -> Column:
    """A value of at least 0 rounded to digits as SQL engines round doubles: scaled, a half added, and cut; not by the decimal form that is printed."""
    return F.floor(x * 10.0**digits + 0.5) / 10.0**digits


def jaccard_best(pairs: DataFrame, left_key: str, right_key: str, score: Column, day_diff: Column, least: float = 0.1, digits: int = 9) -> DataFrame:
    """Each left row's best partner by score less a penalty for days apart (0, 0.15 for one, 0.5 beyond), if above ``least``; ties to the smaller right key.

    Scores are compared to ``digits`` digits, so that shares which are equal but for the last bits are ties.
    """
    penalty = F.when(F.abs(day_diff) == 0, 0.0).when(F.abs(day_diff) == 1, 0.15).otherwise(0.5)
    scored = pairs.withColumn("score", half_up(score * (1 - penalty), digits)).where(F.col("score") > least)
    return top_k(scored, [left_key], 1, "score", right_key).drop("rank")


def dense_topk(queries: DataFrame, rows: DataFrame, query_key: str, key: str, vector: str, k: int, digits: int = 9) -> DataFrame:
    """query_key, rank, key, cosine (``digits`` digits): each query's k nearest other rows by cosine in double precision, ties to the smaller key.

    Queries and rows are dealt into blocks of about QUERY_BLOCK and ROW_BLOCK by hashes of
    their keys, and each pair of blocks is one product of matrices, of which k rows a
    query go on.  Vectors that are null, zero, of another length than the first query's,
    or hold null or non-finite components take no part; a row is never its own query's answer.
    Keys of queries are unique, rows of one key are answers each for itself.
    """
    sound = F.col("_v").isNotNull() & (F.size("_v") > 0) & ~F.exists("_v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("_v", lambda x: x != 0)

    def read(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col(name).alias(name), F.col(vector).cast("array<double>").alias("_v")).where(F.col(name).isNotNull()).where(sound)

    asked, known = read(queries, query_key), read(rows, key)
    first = asked.select(F.size("_v").alias("n")).first()
    schema = f"{query_key} {dict(asked.dtypes)[query_key]}, {key} {dict(known.dtypes)[key]}, cosine double"
    if first is None:
        return rows.sparkSession.createDataFrame([], schema).select(query_key, F.lit(0).alias("rank"), key, "cosine")
    asked, known = asked.where(F.size("_v") == first.n), known.where(F.size("_v") == first.n)
    across, down = -(-asked.count() // QUERY_BLOCK), max(1, -(-known.count() // ROW_BLOCK))
    block = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("_a", block(query_key, across)).withColumn("_b", every(down)).groupBy("_a", "_b")
    right = known.withColumn("_b", block(key, down)).withColumn("_a", every(across)).groupBy("_a", "_b")

    def units(vectors: pd.Series) -> np.ndarray:
        out = np.stack(vectors.to_list())
        # scaled first, so that squares neither overflow nor vanish
        out = out / np.abs(out).max(axis=1, keepdims=True)
        return out / np.linalg.norm(out, axis=1, keepdims=True)

    def product(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(q) and len(r):
            r = r.sort_values(key, kind="stable")
            names, b = r[key].to_numpy(), units(r["_v"])
            for at in range(0, len(q), PRODUCT_ROWS):
                part = q.iloc[at : at + PRODUCT_ROWS]
                scores = np.round(units(part["_v"]) @ b.T, digits)
                for name, own in zip(part[query_key], scores, strict=True):
                    own[names == name] = -np.inf
                    # all that reach the k-th best, so that ties go by key
                    least = np.partition(own, -k)[-k] if len(own) > k else -np.inf
                    kept = np.flatnonzero((own >= least) & (own > -np.inf))
                    kept = kept[np.argsort(-own[kept], kind="stable")][:k]
                    parts.append(pd.DataFrame({query_key: name, key: names[kept], "cosine": own[kept] + 0.0}))
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({c: [] for c in (query_key, key, "cosine")})

    best = left.cogroup(right).applyInPandas(product, schema)
    return top_k(best, [query_key], k, "cosine", key).select(query_key, "rank", key, "cosine")
