"""Retrieval, alignment and evaluation over the standard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.text import jaccard, normalize_text
from weftline.operators import align, chains, evaluate, ledger, linking, ranking
from weftline.operators.aggregates import edge_weights, idf_weights
from weftline.plans.base import query, table, tokens, tokens_sql
from weftline.plans.series_queries import DAILY, daily


@query(f"""
WITH d AS {tokens_sql('documents', 'doc_id')}, b AS {tokens_sql('benchmark', 'item_id')},
i AS (SELECT term, ln((SELECT count(*) FROM d) / count(*)) AS idf FROM d GROUP BY term),
s AS (SELECT item_id, doc_id, round(sum(idf), 6) AS score, count(*) AS n_shared FROM b JOIN d USING (term) JOIN i USING (term) GROUP BY item_id, doc_id)
SELECT item_id, doc_id, score, n_shared, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM s) WHERE r <= 3
""")
def overlap_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IDF-weighted word overlap: the three documents nearest to each benchmark item."""
    d, b = tokens(table(spark, sf_dir, "documents"), "doc_id"), tokens(table(spark, sf_dir, "benchmark"), "item_id")
    # only terms that the benchmark has are dealt out; their weights count all rows
    shared = d.join(b.select("term").distinct(), "term", "left_semi")
    weights = shared.groupBy("term").agg(F.count("*").alias("n")).crossJoin(F.broadcast(d.agg(F.count("*").alias("all")))).select("term", F.ln(F.col("all") / F.col("n")).alias("idf"))
    scores = linking.overlap_scores(b, shared, "item_id", "doc_id", "term", weights).withColumn("score", F.round("score", 6))
    return ranking.top_k(scores, ["item_id"], 3, "score", "doc_id")


def _cosine_sql(grams: str) -> str:
    """Cosines between part names (dictionary) and their texts with ' old' appended, of given n-gram lists."""
    return f"""
e AS (SELECT DISTINCT p_name AS name FROM part), q AS (SELECT name AS query, name || ' old' AS text FROM e),
dt AS (SELECT name, term, count(*) AS tf FROM (SELECT name, unnest({grams.format(t='name')}) AS term FROM e) GROUP BY ALL),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM e)) / (1 + count(*))) + 1 AS idf FROM dt GROUP BY term),
dw AS (SELECT name, term, tf * idf AS w FROM dt JOIN idf USING (term)), dn AS (SELECT name, sqrt(sum(w * w)) AS n FROM dw GROUP BY name),
qt AS (SELECT query, term, count(*) AS tf FROM (SELECT query, unnest({grams.format(t='text')}) AS term FROM q) GROUP BY ALL),
qw AS (SELECT query, term, tf * idf AS w FROM qt JOIN idf USING (term)), qn AS (SELECT query, sqrt(sum(w * w)) AS n FROM qw GROUP BY query),
cos AS (SELECT query, name, sum(qw.w * dw.w) / max(qn.n) / max(dn.n) AS c FROM qw JOIN dw USING (term) JOIN qn USING (query) JOIN dn USING (name) GROUP BY query, name)"""


_WORD = "list_concat(string_split({t}, ' '), [string_split({t}, ' ')[i] || ' ' || string_split({t}, ' ')[i + 1] FOR i IN range(1, len(string_split({t}, ' ')))])"


@query(f"WITH {_cosine_sql(_WORD)} SELECT query, name, round(c, 6) AS cosine FROM cos WHERE c >= 0.2")
def tfidf_word_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    asked = entities.select(F.col("name").alias("query"), F.concat("name", F.lit(" old")).alias("text"))
    made = linking.store(entities, "name", "name")
    return linking.cosines(asked, "query", "text", made, "name", "word").where("word_cosine >= 0.2").select("query", "name", F.round("word_cosine", 6).alias("cosine"))


_CHAR = "flatten([flatten([[substr(' ' || w || ' ', i, n) FOR i IN range(1, length(w) + 4 - n)] FOR n IN [2, 3, 4]]) FOR w IN string_split({t}, ' ')])"


@query(f"WITH {_cosine_sql(_CHAR)} SELECT query, name, round(c, 6) AS cosine FROM cos WHERE c >= 0.2")
def tfidf_charwb_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    asked = entities.select(F.col("name").alias("query"), F.concat("name", F.lit(" old")).alias("text"))
    made = linking.store(entities, "name", "name")
    return linking.cosines(asked, "query", "text", made, "name", "char").where("char_cosine >= 0.2").select("query", "name", F.round("char_cosine", 6).alias("cosine"))


@query(f"""
WITH w AS (WITH {_cosine_sql(_WORD)} SELECT query, name, c FROM cos), h AS (WITH {_cosine_sql(_CHAR)} SELECT query, name, c FROM cos),
b AS (SELECT p_name AS name, min(p_size) + 1600 AS low, max(p_size) + 1600 AS high FROM part GROUP BY p_name),
a AS (SELECT DISTINCT p_name AS name, 1600 + p_size AS year FROM part),
s AS (SELECT coalesce(h.query, w.query) AS query, coalesce(h.name, w.name) AS name, 0.6 * coalesce(h.c, 0) + 0.4 * coalesce(w.c, 0) AS s FROM h FULL JOIN w ON h.query = w.query AND h.name = w.name),
y AS (SELECT DISTINCT p_name AS query, 1600 + length(p_name) * 3 AS year FROM part),
f AS (SELECT s.query, s.name, s.s * (CASE WHEN y.year BETWEEN b.low AND b.high THEN 1.0 ELSE 0.0 END) * (CASE WHEN a.name IS NOT NULL THEN 1.1 ELSE 1.0 END) AS score FROM s JOIN y USING (query) JOIN b ON b.name = s.name LEFT JOIN a ON a.name = s.name AND a.year = y.year)
SELECT query, CAST(r AS INTEGER) AS rank, name, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, name) AS r FROM f WHERE score >= 0.1) WHERE r <= 5
""")
def dual_link_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The linking query: dual cosines, hard temporal gate, boost of attested years, five best."""
    parts = table(spark, sf_dir, "part").withColumn("year", 1600 + F.col("p_size"))
    entities = parts.groupBy(F.col("p_name").alias("name")).agg(F.min("year").alias("low"), F.max("year").alias("high"))
    asked = entities.select(F.col("name").alias("query"), F.concat("name", F.lit(" old")).alias("text"), (1600 + F.length("name") * 3).alias("year"))
    made = linking.store(entities, "name", "name")
    scores = linking.dual_scores(asked, "query", "text", made, "name").join(asked.select("query", "year"), "query").join(entities, "name")
    hit = parts.select(F.col("p_name").alias("name"), "year", F.lit(True).alias("hit")).distinct()
    rows = scores.join(hit, ["name", "year"], "left")
    score = F.col("score") * linking.temporal_weight(F.col("year"), F.col("low"), F.col("high")) * F.when(F.col("hit"), 1 + linking.BOOST).otherwise(1.0)
    kept = rows.withColumn("raw", score).where(F.col("raw") >= linking.LEAST_SCORE).withColumn("order", F.round("raw", 9))
    return ranking.top_k(kept, ["query"], linking.TOP_K, "order", "name").select("query", "rank", "name", F.round("raw", 4).alias("score"))


@query("""
WITH w AS (SELECT c_custkey, c_custkey % 40 + 1980 AS year, c_nationkey + 1985 AS low, c_nationkey + 1990 AS high FROM customer)
SELECT c_custkey, round(greatest(1 - greatest(greatest(low - year, 0), greatest(year - high, 0)) / 10.0, 0), 6) AS weight FROM w
""")
def temporal_gate_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    year, low, high = F.col("c_custkey") % 40 + 1980, F.col("c_nationkey") + 1985, F.col("c_nationkey") + 1990
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(linking.temporal_weight(year, low, high, 10), 6).alias("weight"))


@query("""
WITH q AS (SELECT vec_id AS query_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 100 = 0), d AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT query_id, vec_id, round(list_cosine_similarity(q.e, d.e), 6) AS cosine FROM q, d WHERE query_id <> vec_id)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, cosine FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS r FROM s) WHERE r <= 3
""")
def dense_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "embeddings")
    q = d.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    return linking.dense_topk(q, d, "query_id", "vec_id", "embedding", 3, digits=6)


def _similarity_sql(kind: str, share: float, grams: str) -> str:
    """Weighted cosines (sublinear, smooth idf) of names and labels of a brand, by given n-gram lists."""
    return f"""
c_{kind} AS (SELECT b, side, k, term, count(*) AS tf FROM (SELECT b, side, k, unnest({grams.format(t='k')}) AS term FROM s) GROUP BY ALL), f_{kind} AS (SELECT b, term, count(*) AS df FROM c_{kind} GROUP BY ALL),
w_{kind} AS (SELECT b, side, k, term, (ln(tf) + 1) * (ln((1 + docs) / (1 + df)) + 1) AS w FROM c_{kind} JOIN f_{kind} USING (b, term) JOIN n USING (b)),
u_{kind} AS (SELECT b, side, k, term, w / sqrt(sum(w * w) OVER (PARTITION BY b, side, k)) AS w FROM w_{kind}),
p_{kind} AS (SELECT x.b, x.k AS name, y.k AS label, {share} * sum(x.w * y.w) AS s FROM u_{kind} x JOIN u_{kind} y ON x.b = y.b AND x.term = y.term AND x.side = 'l' AND y.side = 'r' GROUP BY ALL)"""


@query(f"""
WITH s AS (SELECT DISTINCT p_brand AS b, 'l' AS side, p_name AS k FROM part UNION ALL SELECT DISTINCT p_brand, 'r', lower(p_type) || ' ' || p_name FROM part), n AS (SELECT b, count(*) AS docs FROM s GROUP BY b),
{_similarity_sql('word', 0.4, _WORD)}, {_similarity_sql('char', 0.6, _CHAR.replace("[2, 3, 4]", "[3, 4, 5]"))}
SELECT b AS p_brand, name, label, round(least(greatest(sum(s), 0), 1), 6) AS similarity FROM (SELECT * FROM p_word UNION ALL SELECT * FROM p_char) GROUP BY ALL
""")
def text_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names against types with names, within a brand."""
    part = table(spark, sf_dir, "part")
    left, right = part.select("p_brand", F.col("p_name").alias("text")).distinct(), part.select("p_brand", F.concat(F.lower("p_type"), F.lit(" "), "p_name").alias("text")).distinct()
    out = linking.similarity_matrix(left.withColumn("name", F.col("text")), right.withColumn("label", F.col("text")), ["p_brand"], "name", "label", "text")
    return out.withColumn("similarity", F.round("similarity", 6))


@query("""
WITH q AS (SELECT vec_id AS query_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 100 = 0), d AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT query_id, q.label AS gold, d.label AS got, vec_id, round(list_cosine_similarity(q.e, d.e), 9) AS score FROM q, d WHERE query_id <> vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s),
h AS (SELECT query_id, min(rank) FILTER (gold = got) AS first, max(score) FILTER (rank = 1) - max(score) FILTER (rank = 2) AS gap FROM r WHERE rank <= 5 GROUP BY query_id)
SELECT count(*) AS n, round(avg(CASE WHEN first <= 1 THEN 1.0 ELSE 0.0 END), 6) AS top_1, round(avg(CASE WHEN first <= 3 THEN 1.0 ELSE 0.0 END), 6) AS top_3, round(avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0.0 END), 6) AS top_5, round(avg(gap), 6) AS mean_gap FROM h
""")
def linking_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    q = d.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    ranked = linking.dense_topk(q, d, "query_id", "vec_id", "embedding", 5).join(d.select("vec_id", "label"), "vec_id")
    out = evaluate.link_metrics(ranked.withColumnRenamed("cosine", "score"), q.select("query_id", "label"), "query_id", "label")
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("top_1", "top_3", "top_5", "mean_gap")])


@query(f"""
WITH d AS {tokens_sql('documents', 'doc_id', 8)}, b AS {tokens_sql('benchmark', 'item_id', 8)},
dc AS (SELECT doc_id, count(*) AS n FROM d GROUP BY 1), bc AS (SELECT item_id, count(*) AS n FROM b GROUP BY 1),
p AS (SELECT item_id, doc_id, count(*) AS k FROM b JOIN d USING (term) GROUP BY ALL),
s AS (SELECT item_id, doc_id, round(k / (dc.n + bc.n - k) * (1 - CASE abs(item_id - doc_id) % 3 WHEN 0 THEN 0 WHEN 1 THEN 0.15 ELSE 0.5 END), 9) AS score FROM p JOIN dc USING (doc_id) JOIN bc USING (item_id))
SELECT item_id, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM s WHERE score > 0.1) WHERE r = 1
""")
def jaccard_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, b = tokens(table(spark, sf_dir, "documents"), "doc_id", least=8), tokens(table(spark, sf_dir, "benchmark"), "item_id", least=8)
    dc, bc = d.groupBy("doc_id").agg(F.count("*").alias("nd")), b.groupBy("item_id").agg(F.count("*").alias("nb"))
    pairs = b.join(d, "term").groupBy("item_id", "doc_id").agg(F.count("*").alias("k")).join(dc, "doc_id").join(bc, "item_id")
    share = F.col("k") / (F.col("nd") + F.col("nb") - F.col("k"))
    best = linking.jaccard_best(pairs, "item_id", "doc_id", share, F.abs(F.col("item_id") - F.col("doc_id")) % 3)
    return best.select("item_id", "doc_id", linking.half_up(F.col("score"), 6).alias("score"))


@query("""
WITH a AS (SELECT p_partkey, string_split(p_name, ' ') AS x, list_value(split_part(p_name, ' ', 1), lower(p_type)) AS y FROM part)
SELECT p_partkey, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) AS jaccard FROM a
""")
def set_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("p_name", " ")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(jaccard(words, F.array(F.element_at(words, 1), F.lower("p_type"))), 6).alias("jaccard"))


def _cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Conversations as sessions: user turns are items i, assistant turns slots j; the words that both hold are their overlap."""
    turns = table(spark, sf_dir, "conversations").withColumn("k", F.floor(F.col("turn") / 2).cast("int")).withColumn("key", F.col("conv_id") * 100 + F.col("turn"))
    sizes = turns.groupBy("conv_id").agg((F.max(F.when(F.col("role") == "user", F.col("k"))) + 1).alias("n"), (F.max(F.when(F.col("role") != "user", F.col("k"))) + 1).alias("m")).where("m is not null")
    t = tokens(turns, "key", least=4).join(turns.select("key", "conv_id", "k", "role"), "key")
    weights = idf_weights(t, "term").select("term", "idf")
    a = t.where("role = 'user'").select("conv_id", F.col("k").alias("i"), "term")
    b = t.where("role <> 'user'").select("conv_id", F.col("k").alias("j"), "term")
    cells = a.join(b, ["conv_id", "term"]).join(weights, "term").groupBy("conv_id", "i", "j").agg(F.round(F.sum("idf"), 6).alias("score"))
    return cells, sizes


_CELLS = f"""
u AS (SELECT conv_id, turn // 2 AS k, role, conv_id * 100 + turn AS key, text FROM conversations),
t AS (SELECT conv_id, k, role, term FROM {tokens_sql('u', 'key', 4)} JOIN u USING (key)),
w AS (SELECT term, ln((SELECT count(*) FROM t) / count(*)) AS idf FROM t GROUP BY term),
cells AS (SELECT a.conv_id, a.k AS i, b.k AS j, round(sum(idf), 6) AS score FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.term = b.term AND a.role = 'user' AND b.role <> 'user' JOIN w ON w.term = a.term GROUP BY ALL),
sizes AS (SELECT conv_id, max(k) FILTER (role = 'user') + 1 AS n, max(k) FILTER (role <> 'user') + 1 AS m FROM u GROUP BY conv_id HAVING max(k) FILTER (role <> 'user') IS NOT NULL)"""


@query(f"""
WITH {_CELLS},
b AS (SELECT conv_id, i, j, score FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, i ORDER BY score DESC, j) AS r FROM cells) WHERE r = 1 AND score >= 12),
r AS (SELECT s.conv_id, x.i, m FROM sizes s, (SELECT unnest(range(0, 60)) AS i) x WHERE x.i < n),
o AS (SELECT r.*, b.j AS a, b.score, max(b.j) OVER (PARTITION BY r.conv_id ORDER BY r.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM r LEFT JOIN b ON b.conv_id = r.conv_id AND b.i = r.i),
k AS (SELECT *, a IS NOT NULL AND a >= coalesce(seen, -1) AS anchor FROM o),
e AS (SELECT *, max(CASE WHEN anchor THEN i END) OVER p AS li, max(CASE WHEN anchor THEN a END) OVER p AS lj, min(CASE WHEN anchor THEN i END) OVER f AS ri, min(CASE WHEN anchor THEN a END) OVER f AS rj FROM k WINDOW p AS (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY conv_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
x AS (SELECT *, lj + (i - li) / (ri - li) * (rj - lj) AS v FROM e)
SELECT conv_id, CAST(i AS INTEGER) AS i,
  CAST(CASE WHEN anchor THEN a WHEN lj IS NOT NULL AND rj IS NOT NULL AND rj - lj <= 1 THEN lj WHEN lj IS NOT NULL AND rj IS NOT NULL THEN (CASE WHEN abs(v - floor(v) - 0.5) < 1e-9 THEN 2 * round(v / 2) ELSE round(v) END) WHEN lj IS NOT NULL THEN least(m - 1, lj + i - li) WHEN rj IS NOT NULL THEN greatest(0, rj - (ri - i)) END AS INTEGER) AS j,
  CASE WHEN anchor THEN 'tier1_anchor' WHEN lj IS NOT NULL AND rj IS NOT NULL AND lj = rj THEN 'tier2_merged_page' WHEN lj IS NOT NULL AND rj IS NOT NULL AND rj - lj = 1 THEN 'tier2_adjacent' WHEN lj IS NOT NULL AND rj IS NOT NULL THEN 'tier2_interpolated' WHEN lj IS NOT NULL THEN 'tier3_tail' WHEN rj IS NOT NULL THEN 'tier3_head_template' ELSE 'tier3_unanchored' END AS tier,
  CAST(CASE WHEN anchor THEN score ELSE 0.0 END AS DOUBLE) AS score
FROM x
""")
def tiered_milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, sizes = _cells(spark, sf_dir)
    rows = sizes.select("conv_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"), "m")
    return align.tiered_milestones(rows, cells, ["conv_id"], threshold=12)


def _nw_sql(weights: str) -> str:
    """Global alignments in SQL, row by row, then from the end; ``weights`` has conv_id, i, j and w in millionths, of the pairs that may be matched."""
    return f"""
WITH RECURSIVE {_CELLS}, v AS ({weights}),
g2 AS (SELECT conv_id, i, list(w ORDER BY j) AS ws FROM (SELECT conv_id, unnest(range(0, n)) AS i FROM sizes) JOIN (SELECT conv_id, unnest(range(0, m)) AS j FROM sizes) USING (conv_id) LEFT JOIN v USING (conv_id, i, j) GROUP BY conv_id, i),
d AS (SELECT conv_id, 0::BIGINT AS i, list_transform(range(0, m + 1), lambda x: 0::BIGINT) AS r, n, m FROM sizes
  UNION ALL SELECT conv_id, i + 1, list_transform(range(1, m + 2), lambda k: list_max(c[1:k])), n, m
  FROM (SELECT d.conv_id, d.i, d.n, d.m, list_transform(range(0, d.m + 1), lambda j: greatest(d.r[j + 1], CASE WHEN j > 0 AND g2.ws[j] IS NOT NULL THEN d.r[j] + g2.ws[j] ELSE 0 END)) AS c FROM d JOIN g2 ON d.conv_id = g2.conv_id AND d.i = g2.i WHERE d.i < d.n)),
e AS (SELECT x.conv_id, x.i, x.r, y.r AS up, g2.ws FROM d x LEFT JOIN d y ON x.conv_id = y.conv_id AND x.i = y.i + 1 LEFT JOIN g2 ON x.conv_id = g2.conv_id AND g2.i = x.i - 1),
p AS (SELECT conv_id, n::BIGINT AS i, m::BIGINT AS j, 0::BIGINT AS back, NULL::BIGINT AS a, NULL::BIGINT AS b FROM sizes
  UNION ALL SELECT conv_id, CASE WHEN move = 2 THEN i ELSE i - 1 END, CASE WHEN move = 1 THEN j ELSE j - 1 END, back + 1, CASE WHEN move = 2 THEN NULL ELSE i - 1 END, CASE WHEN move = 1 THEN NULL ELSE j - 1 END
  FROM (SELECT p.*, CASE WHEN p.i > 0 AND p.j > 0 AND e.ws[p.j] IS NOT NULL AND e.up[p.j] + e.ws[p.j] = e.r[p.j + 1] THEN 0 WHEN p.i > 0 AND (p.j = 0 OR e.up[p.j + 1] = e.r[p.j + 1]) THEN 1 ELSE 2 END AS move FROM p JOIN e ON p.conv_id = e.conv_id AND p.i = e.i WHERE p.i > 0 OR p.j > 0))
SELECT conv_id, max(back) OVER (PARTITION BY conv_id) - back AS step, a AS i, b AS j FROM p WHERE back > 0
"""


@query(_nw_sql("SELECT conv_id, i, j, CAST(round((score + 0.2) * 1000000) AS BIGINT) AS w FROM cells WHERE score > 0"))
def nw_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Global alignment of user and assistant turns of each conversation."""
    cells, sizes = _cells(spark, sf_dir)
    return align.nw_align(cells.withColumnRenamed("score", "overlap"), sizes, "conv_id")


@query(_nw_sql("""SELECT conv_id, i, j, CAST(round((score + 0.2 + 50 * pinned - 0.35 * abs(j - i - 1) + 2 * same_date) * 1000000) AS BIGINT) AS w FROM (
  SELECT conv_id, i, j, coalesce(score, 0.0) AS score, CAST(i = 0 AND j = 1 AS INTEGER) AS pinned, CAST((i + 2 * j) % 3 = 0 AS INTEGER) AS same_date, (i + j) % 5 = 4 AS blocked
  FROM cells FULL JOIN (SELECT conv_id, 0 AS i, 1 AS j FROM sizes WHERE m > 1) USING (conv_id, i, j)) WHERE CASE WHEN i = 0 AND conv_id IN (SELECT conv_id FROM sizes WHERE m > 1) THEN pinned = 1 ELSE score > 0 AND NOT blocked END"""))
def nw_align_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with hints: the first turn is pinned to the second answer, some pairs are blocked or of one date, and answers are expected one on."""
    cells, sizes = _cells(spark, sf_dir)
    pins = sizes.where("m > 1").select("conv_id", F.lit(0).alias("i"), F.lit(1).alias("j"), F.lit(True).alias("pinned"))
    i, j = F.col("i"), F.col("j")
    cells = cells.withColumnRenamed("score", "overlap").join(pins, ["conv_id", "i", "j"], "full_outer")
    cells = cells.withColumns({"blocked": (i + j) % 5 == 4, "same_date": (i + 2 * j) % 3 == 0})
    return align.nw_align(cells, sizes.withColumn("expected", F.lit(1.0)), "conv_id")


@query()
def tri_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, sizes = _cells(spark, sf_dir)
    return align.tri_anchors(cells, sizes.select("conv_id", "n"), ["conv_id"], 12)


@query()
def tri_anchor_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns aligned from a conversation's first to its last anchor by way of the middle one, its opening turns pinned to each other."""
    cells, sizes = _cells(spark, sf_dir)
    anchors = align.tri_anchors(cells, sizes.select("conv_id", "n"), ["conv_id"], 12)
    pins = sizes.where("n > 0 and m > 0").select("conv_id", F.lit(0).alias("i"), F.lit(0).alias("j"))
    return align.align_by_tri_anchors(cells.withColumnRenamed("score", "overlap"), anchors, "conv_id", pins)


@query("""
WITH f AS (SELECT o_custkey % 1000 AS g, o_orderkey, o_orderpriority AS x, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS k, o_custkey FROM orders),
flat AS (SELECT o_custkey, list(x ORDER BY k) AS xs FROM f WHERE k < 9 GROUP BY o_custkey), rich AS (SELECT o_custkey, list(x ORDER BY k) AS ys FROM f WHERE k < 9 AND k % 2 = 1 GROUP BY o_custkey),
b AS (SELECT o_custkey, xs, ys, len(xs) AS n, len(ys) AS m, unnest(range(0, 1 << len(xs))) AS mask FROM flat JOIN rich USING (o_custkey)),
t AS (SELECT *, list_filter(range(0, n), lambda i: (mask >> i) & 1 = 1) AS used FROM b WHERE bit_count(mask) = m),
c AS (SELECT *, n - m + len(list_filter(range(1, m + 1), lambda j: xs[used[j] + 1] <> ys[j])) AS cost FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY cost, mask DESC) AS best FROM c)
SELECT o_custkey, CAST(cost AS DOUBLE) AS cost, unnest(used) AS i, unnest(range(0, m)) AS j FROM r WHERE best = 1
""")
def mention_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The priorities of a customer's first nine orders as flat mentions, every second one of them as enriched mentions: what deletion alone explains."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    flat = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderpriority").alias("x"), (F.row_number().over(w) - 1).alias("k")).where("k < 9")
    enriched = flat.where("k % 2 = 1").select("o_custkey", "x", ((F.col("k") - 1) / 2).cast("int").alias("k"))
    return align.align_mentions(flat, enriched, "o_custkey", "k", "x").where("i is not null")


@query()
def chain_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten conversations as a chain of sessions, each expected to go on where the one before ended."""
    cells, sizes = _cells(spark, sf_dir)
    sessions = sizes.select(F.floor(F.col("conv_id") / 10).alias("chain"), F.col("conv_id").cast("string").alias("session"), F.col("conv_id").alias("rank"), "n", (F.col("conv_id") * 8).alias("start"), "m")
    own = cells.select(F.floor(F.col("conv_id") / 10).alias("chain"), F.col("conv_id").cast("string").alias("session"), "i", "j", F.col("score").alias("overlap"))
    return align.chain_sessions(sessions, own, "chain")


def _chain_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """Fifty conversations as a chain of sessions, and their cells; pinned, blocked and rejected pairs are the best overlap of some."""
    cells, sizes = _cells(spark, sf_dir)
    w = Window.partitionBy("chain").orderBy("conv_id")
    rows = sizes.withColumn("chain", F.floor(F.col("conv_id") / 50)).withColumn("start", F.coalesce(F.sum("m").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sessions = rows.select("chain", F.col("conv_id").alias("session"), F.col("conv_id").alias("rank"), "n", "m", "start")
    own = cells.select(F.col("conv_id").alias("session"), "i", "j", F.col("score").alias("overlap"))
    best = own.groupBy("session").agg(F.max(F.struct("overlap", "i", "j")).alias("x")).select("session", "x.i", "x.j")
    some = [best.where(F.col("session") % 9 == k) for k in (2, 5, 8)]
    return sessions, own, *some


@query()
def session_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations aligned along their chains, with pinned, blocked and rejected pairs."""
    return chains.align_chains(*_chain_tables(spark, sf_dir))


@query("""
WITH c AS (SELECT source, count(*) FILTER (quality = 1 AND toxic = 0) AS correct, count(*) FILTER (toxic = 1) AS false_positive, count(*) FILTER (quality = 0 AND toxic = 0) AS uncertain FROM labels JOIN documents USING (doc_id) WHERE source IS NOT NULL GROUP BY source),
p AS (SELECT *, coalesce(round(correct / nullif(correct + false_positive + uncertain, 0), 4), 0) AS precision FROM c)
SELECT source, correct, false_positive, uncertain, precision, row_number() OVER (ORDER BY precision DESC, source) AS rank, precision >= 0.65 AS locked FROM p
""")
def session_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources ranked by the share of their labelled documents that are good and not toxic."""
    labelled = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    verdict = F.when(F.col("toxic") == 1, "false_positive").when((F.col("quality") == 1) & (F.col("toxic") == 0), "correct").when((F.col("quality") == 0) & (F.col("toxic") == 0), "uncertain")
    return chains.rank_sessions(labelled.withColumn("verdict", verdict), "source", "verdict").drop("mean_margin")


@query(f"""
WITH d AS (SELECT day, n_items AS k_e, greatest(n_slots, 1) AS axis FROM {DAILY}),
a AS (SELECT day, k_e, axis, 1 AS e, axis // 2 AS a FROM d WHERE k_e > 2 UNION ALL SELECT day, k_e, axis, 3, axis // 3 FROM d WHERE k_e > 4),
c AS (SELECT day, k_e, axis, e, least(max(a) OVER (PARTITION BY day ORDER BY e), axis - 1) AS a FROM a WHERE a < axis),
u AS (SELECT * FROM c UNION ALL SELECT day, k_e, axis, 0, 0 FROM d UNION ALL SELECT day, k_e, axis, k_e, axis FROM d),
g AS (SELECT *, lead(e) OVER (PARTITION BY day ORDER BY e) AS e2, lead(a) OVER (PARTITION BY day ORDER BY e) AS a2 FROM u),
p AS (SELECT day, e + r AS e, a + (r * (a2 - a)) // (e2 - e) AS position FROM g, (SELECT unnest(range(1, 200)) AS r) WHERE r < e2 - e)
SELECT day, CAST(e AS INTEGER) AS e, CAST(position AS INTEGER) AS position FROM p UNION ALL SELECT day, CAST(e AS INTEGER), CAST(a AS INTEGER) FROM c
""")
def closed_form_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = daily(spark, sf_dir).select("day", F.col("n_items").alias("k_e"), F.greatest("n_slots", F.lit(1)).alias("axis"))
    anchors = d.where("k_e > 2").select("day", F.lit(1).alias("e"), F.floor(F.col("axis") / 2).cast("int").alias("a")).unionByName(d.where("k_e > 4").select("day", F.lit(3).alias("e"), F.floor(F.col("axis") / 3).cast("int").alias("a")))
    return align.place_between_anchors(d, anchors, ["day"])


@query()
def gap_dp_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days' items placed among their line items, drawn to positions with large quantities."""
    d = daily(spark, sf_dir).where("n_items > 1 and n_slots > 0").select("day", F.lit(0).alias("low"), F.col("n_slots").cast("int").alias("high"), (F.col("n_items") - 1).cast("int").alias("count"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("day"), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    k = F.row_number().over(Window.partitionBy("day").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")) - 1
    evidence = lines.select("day", k.alias("position"), F.when(F.col("l_quantity") > 45, 1.0).otherwise(0.0).alias("score")).where("score > 0")
    return align.place_with_evidence(d, evidence.join(d.select("day"), "day", "left_semi"), ["day"])


@query(f"""
WITH c AS (SELECT CAST(l_shipdate AS DATE) AS day, count(*) AS n FROM lineitem GROUP BY 1),
o AS (SELECT CAST(o_orderdate AS DATE) AS day, o_orderkey, row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_orderkey) AS position, count(*) OVER (PARTITION BY CAST(o_orderdate AS DATE)) AS k FROM orders),
l AS (SELECT CAST(l_shipdate AS DATE) AS day, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY CAST(l_shipdate AS DATE) ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS position FROM lineitem)
SELECT o.day, CAST(o.position AS INTEGER) AS position, o_orderkey, l_orderkey, CAST(CASE WHEN k = c.n THEN 0.9 ELSE 0.55 END AS DOUBLE) AS confidence FROM o JOIN l ON o.day = l.day AND o.position = l.position JOIN c ON c.day = o.day
""")
def zip_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day"), "o_orderkey")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("day"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    pairs = align.zip_align(orders, lines, ["day"], ["o_orderkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"])
    return pairs.select("day", "position", "o_orderkey", "l_orderkey", "confidence")


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's orders, spread evenly over its line items: day, e, start, stop."""
    d = daily(spark, sf_dir).where("n_slots > 0").select("day", F.col("n_items").alias("k_e"), F.col("n_slots").alias("axis"))
    items = d.select("day", "k_e", "axis", F.explode(F.sequence(F.lit(0), (F.col("k_e") - 1).cast("int"))).alias("e"))
    start = F.floor(F.col("e") * F.col("axis") / F.col("k_e")).cast("int")
    stop = F.when(F.col("e") == F.col("k_e") - 1, F.col("axis") - 1).otherwise(F.floor((F.col("e") + 1) * F.col("axis") / F.col("k_e"))).cast("int")
    return items.select("day", "e", start.alias("start"), stop.alias("stop"))


_PLACED = f"""d AS (SELECT day, n_items, n_slots FROM {DAILY}), i AS (SELECT day, n_items AS k, n_slots AS axis, r AS e FROM d, (SELECT unnest(range(0, 200)) AS r) WHERE r < n_items AND n_slots > 0),
placed AS (SELECT day, e, (e * axis) // k AS start, CASE WHEN e = k - 1 THEN axis - 1 ELSE ((e + 1) * axis) // k END AS stop FROM i)"""


@query(f"""
WITH {_PLACED}, s AS (SELECT day, count(*) OVER (PARTITION BY day, start) = 1 AND stop - start + 1 <= 3 AS separated FROM placed), c AS (SELECT day, count(*) FILTER (separated) AS n FROM s GROUP BY day)
SELECT d.day, d.n_items, coalesce(n, 0) AS separated_count, round(coalesce(n, 0) / d.n_items, 6) AS separated_share, coalesce(n, 0) / d.n_items >= 0.5 AS is_solid FROM d LEFT JOIN c ON c.day = d.day
""")
def separated_solid(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = daily(spark, sf_dir).select("day", "n_items")
    out = evaluate.solid_days(_placed(spark, sf_dir), ["day"], "start", "stop", days, "n_items")
    return out.select("day", "n_items", "separated_count", F.round("separated_share", 6).alias("separated_share"), "is_solid")


def _cuts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Turns' starts in words as reference cuts, evenly spread ones as predicted, and the conversations' lengths."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(F.split("text", " ")).alias("words"))
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    ref = turns.withColumn("position", F.sum("words").over(w)).where("position is not null").select("conv_id", F.col("position").cast("long").alias("position"))
    sizes = turns.groupBy("conv_id").agg(F.sum("words").alias("length"), F.count("*").alias("n"))
    hyp = sizes.where("n > 1").select("conv_id", F.explode(align.uniform_cuts(F.col("length"), F.col("n"))).alias("position"))
    return ref, hyp, sizes.select("conv_id", "length")


_CUTS = """t AS (SELECT conv_id, turn, length(text) - length(replace(text, ' ', '')) + 1 AS words FROM conversations),
ref AS (SELECT conv_id, position FROM (SELECT conv_id, sum(words) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS position FROM t) WHERE position IS NOT NULL),
sizes AS (SELECT conv_id, CAST(sum(words) AS BIGINT) AS length, count(*) AS n FROM t GROUP BY conv_id),
hyp AS (SELECT conv_id, (k * length) // n AS position FROM sizes, (SELECT unnest(range(1, 100)) AS k) WHERE k < n)"""


@query(f"""
WITH {_CUTS}, m AS (SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(r, 0) AS r, coalesce(h, 0) AS h FROM (SELECT conv_id, position, count(*) AS r FROM ref GROUP BY ALL) a FULL JOIN (SELECT conv_id, position, count(*) AS h FROM hyp GROUP BY ALL) b ON a.conv_id = b.conv_id AND a.position = b.position),
s AS (SELECT conv_id, CAST(sum(least(r, h)) AS BIGINT) AS tp, CAST(sum(r) AS BIGINT) AS r, CAST(sum(h) AS BIGINT) AS h FROM m GROUP BY conv_id),
f AS (SELECT z.conv_id, coalesce(tp, 0) AS tp, coalesce(r, 0) AS r, coalesce(h, 0) AS h FROM sizes z LEFT JOIN s ON s.conv_id = z.conv_id)
SELECT conv_id, tp, h - tp AS fp, r - tp AS fn, CASE WHEN r + h = 0 THEN 1.0 WHEN h = 0 THEN 0.0 ELSE round(tp / h, 6) END AS "precision", CASE WHEN r + h = 0 THEN 1.0 WHEN r = 0 THEN 0.0 ELSE round(tp / r, 6) END AS recall, CASE WHEN r + h = 0 THEN 1.0 ELSE round(2.0 * tp / (r + h), 6) END AS f1, r = h AS exact_count FROM f
""")
def boundary_prf_tol0(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, hyp, sizes = _cuts(spark, sf_dir)
    out = evaluate.boundary_scores(ref, hyp, sizes, ["conv_id"], "position")
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query()
def boundary_prf_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, hyp, _ = _cuts(spark, sf_dir)
    return evaluate.tolerant_boundary_scores(ref, hyp, "conv_id", "position", 5)


@query(f"""
WITH {_CUTS}, b AS (SELECT z.conv_id, length, greatest(1, (CASE WHEN abs(x - floor(x) - 0.5) < 1e-9 THEN 2 * round(x / 2) ELSE round(x) END)) AS k FROM (SELECT s.conv_id, s.length, s.length / (coalesce(c, 0) + 1) / 2.0 AS x FROM sizes s LEFT JOIN (SELECT conv_id, count(*) AS c FROM ref GROUP BY conv_id) q ON q.conv_id = s.conv_id) z),
u AS (SELECT b.conv_id, k, length, i FROM b, (SELECT unnest(range(0, 20000)) AS i) WHERE i < greatest(length - k, 1) AND length > 1),
dr AS (SELECT DISTINCT conv_id, position FROM ref), dh AS (SELECT DISTINCT conv_id, position FROM hyp),
n AS (SELECT u.conv_id, u.i, (SELECT count(*) FROM dr WHERE dr.conv_id = u.conv_id AND position >= i AND position < i + least(k, length)) AS r, (SELECT count(*) FROM dh WHERE dh.conv_id = u.conv_id AND position >= i AND position < i + least(k, length)) AS h FROM u)
SELECT b.conv_id, CAST(CASE WHEN length > 1 THEN k ELSE 1 END AS INTEGER) AS k, round(coalesce(p, 0), 6) AS p_k, round(coalesce(w, 0), 6) AS window_diff FROM b LEFT JOIN (SELECT conv_id, avg(CASE WHEN (r = 0) <> (h = 0) THEN 1.0 ELSE 0.0 END) AS p, avg(CASE WHEN r <> h THEN 1.0 ELSE 0.0 END) AS w FROM n GROUP BY conv_id) x ON x.conv_id = b.conv_id
""")
def pk_windowdiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, hyp, sizes = _cuts(spark, sf_dir)
    out = evaluate.pk_windowdiff(ref, hyp, sizes, ["conv_id"], "position")
    return out.select("conv_id", "k", F.round("p_k", 6).alias("p_k"), F.round("window_diff", 6).alias("window_diff"))


@query("""
WITH c AS (SELECT user_id AS session, CAST(ts AS DATE) AS date FROM events WHERE event_type = 'signup'), x AS (SELECT session FROM c GROUP BY session HAVING count(DISTINCT date) > 1),
h AS (SELECT DISTINCT date FROM c WHERE session IN (SELECT session FROM x)), d AS (SELECT CAST(ts AS DATE) AS date, count(*) < 400 AS weak FROM events GROUP BY 1)
SELECT h.date IS NOT NULL AS collides, weak, count(*) AS n FROM d LEFT JOIN h ON h.date = d.date GROUP BY 1, 2
""")
def collision_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("date", F.col("ts").cast("date"))
    days = events.groupBy("date").agg((F.count("*") < 400).alias("weak"))
    claims = events.where("event_type = 'signup'").select(F.col("user_id").alias("session"), "date")
    return evaluate.collision_crosstab(days, claims, "session", "date", "weak")


@query("""
WITH s AS (SELECT conv_id, turn AS id, turn * 30 AS s, turn * 30 + length(text) % 97 AS e FROM conversations)
SELECT a.conv_id, a.id AS a, b.id AS b FROM s a JOIN s b ON a.conv_id = b.conv_id AND a.id < b.id AND a.s < b.e AND a.e > b.s WHERE a.e > a.s AND b.e > b.s
""")
def interval_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("turn") * 30).alias("start"), (F.col("turn") * 30 + F.length("text") % 97).alias("end"))
    return evaluate.overlapping_intervals(spans, ["conv_id"], "turn")


_LINKS = "(SELECT 'type:' || p_type AS src, 'brand:' || p_brand AS dst, p_size AS w FROM part)"


@query(f"SELECT id, count(*) AS degree, split_part(id, ':', 1) AS type FROM (SELECT src AS id FROM (SELECT DISTINCT src, dst FROM {_LINKS}) UNION ALL SELECT dst FROM (SELECT DISTINCT src, dst FROM {_LINKS})) GROUP BY id")
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.graph_tables(table(spark, sf_dir, "part"), ("p_type", "type"), ("p_brand", "brand"), "sold_as", "p_size")[0]


@query(f"SELECT src, dst, CAST(sum(w) AS BIGINT) AS weight, 'sold_as' AS type FROM {_LINKS} GROUP BY src, dst")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.graph_tables(table(spark, sf_dir, "part"), ("p_type", "type"), ("p_brand", "brand"), "sold_as", "p_size")[1]


@query("SELECT o_orderpriority AS src, o_orderstatus AS dst, 'has' AS type, 'orders' AS source, round(sum(o_totalprice), 2) AS weight, count(*) AS n FROM orders GROUP BY 1, 2")
def edge_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("src"), F.col("o_orderstatus").alias("dst"), F.lit("has").alias("type"), F.lit("orders").alias("source"), F.col("o_totalprice").alias("weight"))
    return edge_weights(edges).withColumn("weight", F.round("weight", 2))


@query()
def greedy_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items and documents claim one another once, the best-scored pair first."""
    d, b = tokens(table(spark, sf_dir, "documents"), "doc_id", least=8), tokens(table(spark, sf_dir, "benchmark"), "item_id", least=8)
    scores = linking.overlap_scores(b, d, "item_id", "doc_id", "term", idf_weights(d, "term")).withColumn("score", F.round("score", 6))
    return ledger.greedy_claims(scores, "item_id", "doc_id", "score")


@query("""
SELECT l.doc_id, CASE WHEN length(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) = 0 THEN 'empty' WHEN toxic = 1 THEN 'reject' WHEN quality = 1 THEN 'approve' ELSE 'unjudged' END AS verdict FROM labels l JOIN documents d ON d.doc_id = l.doc_id
""")
def normal_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    verdict = F.when(F.length(normalize_text("text")) == 0, "empty").when(F.col("toxic") == 1, "reject").when(F.col("quality") == 1, "approve").otherwise("unjudged")
    return rows.select("doc_id", verdict.alias("verdict"))
