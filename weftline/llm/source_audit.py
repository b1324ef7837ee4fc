"""Divergence of sources within each language: relational from the terms of whole texts to ranks.

Terms (runs of ASCII letters and characters beyond ASCII) are taken out of some megabytes of text at a time and counted there by
group, so that only counts are shuffled, and compared as
integer shares of each group: every group of a language gives every kept term, and
groups of one language meet term by term.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.shared import give_back, map_batches, materialised, picked, salted_join

#: What ends a term: runs of ASCII characters other than letters.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of text counted at once, more only for one longer text; what a row counts for besides; rows of counts in a batch.
CHUNK, ROW, BATCH = 16 << 20, 32, 1 << 16
#: Documents of a language that a term must be in, terms reported for a group, and what shares are out of.
LEAST, TOP, WHOLE = 10, 10, 1_000_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: For each byte what it is in a term: letters lower-cased, bytes beyond ASCII as they are, 0 for what ends one.
_BYTES = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 0 for b in range(256)], dtype=np.uint8)
_COUNTS = "lang string, source string, term string, n long, docs long"


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The same rows, dealt anew into batches of at most ``most`` bytes of text, each row with ROW more, or of one row."""
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False).astype(np.int64) + ROW)
        at = 0
        while at < len(ends):
            before = ends[at - 1] if at else 0
            to = int(np.searchsorted(ends, before + most - size, "right"))
            if to <= at and not held:
                to = at + 1
            if to > at:
                held.append(batch.slice(at, to - at))
                size += int(ends[to - 1] - before)
            if to < len(ends):
                yield pa.concat_batches(held)
                held, size = [], 0
            at = max(at, to)
    if held:
        yield pa.concat_batches(held)


def _terms(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts in their order, and how many each text has."""
    text = text.cast(pa.large_binary())
    _, ends, data = text.buffers()
    ends = np.frombuffer(ends, dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(data or b"", dtype=np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    letters = _BYTES[data]
    inside = letters != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    opens = ends[:-1][ends[:-1] < len(data)]
    first[opens] = inside[opens]
    per_text = np.diff(np.searchsorted(np.flatnonzero(first), ends))
    letters = letters[inside]
    starts = np.append(np.flatnonzero(first[inside]), len(letters)).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(letters)]), per_text


def counted(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Of each lang, source and term in rows of lang, source and text: how often it occurs (n), and in how many rows (docs)."""
    terms, per_text = _terms(rows["text"])
    coded = terms.dictionary_encode()
    langs, sources = (rows[c].dictionary_encode() for c in ("lang", "source"))
    group = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
    # rows numbered by group, so that a sorted number of term and row has the terms of each group side by side
    order = np.argsort(group, kind="stable")
    number = np.empty_like(order)
    number[order] = np.arange(len(order))
    seen = coded.indices.to_numpy().astype(np.int64) * len(order) + np.repeat(number, per_text)
    seen.sort()
    once = np.flatnonzero(np.diff(seen, prepend=-1))
    term, row = np.divmod(seen[once], max(1, len(order)))
    group = group[order][row]
    new = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(group, prepend=-1) != 0))
    lang, source = np.divmod(group[new], max(1, len(sources.dictionary)))
    n, docs = np.diff(once[new], append=len(seen)), np.diff(new, append=len(once))
    for at in range(0, len(new), BATCH):
        part = slice(at, at + BATCH)
        names = langs.dictionary.take(pa.array(lang[part])), sources.dictionary.take(pa.array(source[part])), coded.dictionary.take(pa.array(term[new[part]]))
        yield pa.record_batch([*names, pa.array(n[part]), pa.array(docs[part])], names=["lang", "source", "term", "n", "docs"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _chunks(batches, CHUNK):
        yield from counted(rows)
    give_back()


def _share(n: str, total: str, terms: str) -> Column:
    """1 + floor(WHOLE * (n + 2) / (total + 2 * terms)), exactly: counts of the largest corpora exceed 64 bits once multiplied."""
    return F.expr(f"1 + (cast({n} + 2 as decimal(20,0)) * {WHOLE}) div cast({total} + 2 * {terms} as decimal(20,0))")


def _gap(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def audit(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", source_column: str = "source", least: int = LEAST, top: int = TOP) -> DataFrame:
    """How each (lang, source) group differs from each other of its lang, and by which terms from the lang as a whole.

    Columns: lang, source, part, item, value long, rank int.  Part ``pair`` has a row for
    each other source of the lang: item is its name, value the sum over all kept terms of
    floor((p - q)^2 / (p + q)), p and q the shares of the term in both groups.  Part
    ``term`` has the ``top`` kept terms that the group has and whose share p exceeds the
    lang's q, by the same measure.  Ranks are by value descending, then item ascending by
    bytes.  A lang keeps the terms that at least ``least`` of its rows hold.

    Nulls in any of the three columns count as ''.  Each row is a document, repeated or
    not.  A lang without kept terms has pairs of value 0 and no terms; a lang with one
    source has no pairs; no rows give no rows.  Other columns are ignored, whatever their
    names.

    Each text is read once.  Counts are summed before each shuffle, so hot sources and langs don't stand out; a
    lang's groups meet its terms in shares of bounded size, and groups meet each other
    term by term, each pair once.
    """
    rows = picked(docs, text=text_column, lang=lang_column, source=source_column).select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    groups = materialised(rows.select("lang", "source").distinct(), "audit-groups")
    # a term's counts meet once: by term and lang, which serves the sums by source and those over all sources
    dealt = map_batches(rows.select("lang", "source", "text"), _counted, _COUNTS).repartition("term", "lang")
    counts = dealt.groupBy("term", "lang", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    whole = Window.partitionBy("term", "lang")
    counts = counts.select("lang", "source", "term", "n", F.sum("n").over(whole).alias("lang_n"), F.sum("docs").over(whole).alias("lang_docs"))
    counts = materialised(counts.where(F.col("lang_docs") >= least).drop("lang_docs"), "audit-counts")
    kept = materialised(counts.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n")), "audit-terms")

    about = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    known = materialised(groups.join(about, "lang").join(totals, ["lang", "source"], "left").withColumn("total", F.coalesce("total", F.lit(0))), "audit-totals")
    dense = salted_join(kept, known, "lang", "term", kept.count()).join(counts.drop("lang_n"), ["lang", "source", "term"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    shares = dense.select("lang", "source", "term", "n", _share("n", "total", "terms").alias("p"), _share("lang_n", "lang_total", "terms").alias("q"))
    shares = materialised(shares, "audit-shares")

    other = shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("other_p"))
    met = shares.select("lang", "term", "source", "p").join(other, ["lang", "term"]).where("source < item")
    once = met.groupBy("lang", "source", "item").agg(F.sum(_gap("p", "other_p")).alias("value"))
    both = once.unionByName(once.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    pairs = groups.join(groups.withColumnRenamed("source", "item"), "lang").where("source <> item")
    pairs = pairs.join(both, ["lang", "source", "item"], "left").withColumn("value", F.coalesce("value", F.lit(0)))

    own = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = F.row_number().over(own).alias("rank")
    by_pair = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", ranked)
    by_term = shares.where("n > 0 and p > q").select("lang", "source", F.col("term").alias("item"), _gap("p", "q").alias("value"))
    by_term = by_term.select("lang", "source", F.lit("term").alias("part"), "item", "value", ranked).where(F.col("rank") <= top)
    return by_pair.unionByName(by_term).select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), "rank")


ORACLE = rf"""WITH rows AS MATERIALIZED (
    SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{BETWEEN.replace('[', '[^', 1)}') AS terms FROM documents),
groups AS (SELECT DISTINCT lang, source FROM rows),
found AS MATERIALIZED (SELECT id, lang, source, term, count(*) AS n FROM (SELECT id, lang, source, unnest(terms) AS term FROM rows) GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, term, sum(n)::HUGEINT AS lang_n FROM found GROUP BY lang, term HAVING count(*) >= {LEAST}),
counts AS (SELECT lang, source, term, sum(n)::HUGEINT AS n FROM found GROUP BY lang, source, term),
dense AS MATERIALIZED (SELECT lang, source, term, coalesce(n, 0) AS n, lang_n FROM groups JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
sums AS (SELECT lang, source, sum(n)::HUGEINT AS total, count(*)::HUGEINT AS terms, sum(lang_n)::HUGEINT AS lang_total FROM dense GROUP BY lang, source),
shares AS MATERIALIZED (SELECT lang, source, term, n, 1 + ({WHOLE} * (n + 2)) // (total + 2 * terms) AS p, 1 + ({WHOLE} * (lang_n + 2)) // (lang_total + 2 * terms) AS q
    FROM dense JOIN sums USING (lang, source)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
WHERE part = 'pair' OR rank <= {TOP}"""
