"""Joins over the standard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import joins
from weftline.plans.base import query, table, tokens, tokens_sql


def _days(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as summaries and line items as records, both with their day."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", F.col("o_orderdate").cast("date").alias("o_day"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("l_day"))
    return orders, lines


@query("""
SELECT o_orderkey, l_linenumber, CAST(abs(date_diff('day', o_day, l_day)) AS BIGINT) AS date_diff_days, count(*) AS n
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_day FROM orders) JOIN (SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS l_day FROM lineitem) ON o_orderkey = l_orderkey
WHERE abs(date_diff('day', o_day, l_day)) <= 30 GROUP BY ALL
""")
def date_band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = _days(spark, sf_dir)
    pairs = joins.date_band_join(orders.withColumn("key", F.col("o_orderkey")), lines.withColumn("key", F.col("l_orderkey")), "o_day", "l_day", 30, ["key"])
    return pairs.groupBy("o_orderkey", "l_linenumber", F.col("date_diff_days").cast("long").alias("date_diff_days")).agg(F.count("*").alias("n"))


@query("""
WITH p AS (SELECT user_id, min(CAST(ts AS DATE)) AS start_day, min(CAST(ts AS DATE)) + 6 AS end_day FROM events WHERE event_type = 'signup' GROUP BY user_id)
SELECT event_id, p.user_id AS period_user FROM events JOIN p ON CAST(ts AS DATE) BETWEEN start_day AND end_day AND events.user_id = p.user_id
""")
def range_period_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("date").alias("day"))
    periods = events.where("event_type = 'signup'").groupBy(F.col("user_id").alias("period_user")).agg(F.min("day").alias("start_day")).withColumn("end_day", F.date_add("start_day", 6))
    return joins.period_join(events, periods, "day", "start_day", "end_day", on=[("user_id", "period_user")]).select("event_id", "period_user")


@query("""
WITH names AS (SELECT DISTINCT p_brand AS block, p_name AS name, split_part(p_name, ' ', 2) AS word FROM part),
lines AS (SELECT p_partkey AS id, p_brand AS block, CASE WHEN p_size <= 25 THEN p_name ELSE lower(p_type) || ' ' || p_name END AS label FROM part),
c AS (SELECT id, name, 0 AS pr, 'canonical' AS match_kind FROM lines JOIN names USING (block) WHERE label = name),
s AS (SELECT id, name, 1, 'substring' FROM lines JOIN names USING (block) WHERE contains(label, name)),
w AS (SELECT id, name, 2, 'word' FROM lines JOIN names USING (block) WHERE length(word) >= 4 AND list_contains(string_split(label, ' '), word)),
u AS (SELECT * FROM c UNION ALL SELECT * FROM s UNION ALL SELECT * FROM w)
SELECT id, name, match_kind FROM (SELECT *, row_number() OVER (PARTITION BY id, name ORDER BY pr) AS r FROM u) WHERE r = 1
""")
def priority_cascade_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names sought in the texts of their brand: equal, contained, by their last word."""
    part = table(spark, sf_dir, "part")
    names = part.select(F.col("p_brand").alias("block"), F.col("p_name").alias("name")).distinct().withColumn("word", F.element_at(F.split("name", " "), 2))
    label = F.when(F.col("p_size") <= 25, F.col("p_name")).otherwise(F.concat(F.lower("p_type"), F.lit(" "), "p_name"))
    lines = part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("block"), label.alias("label"))
    canonical = lines.join(names.withColumn("label", F.col("name")), ["block", "label"]).select("id", "name")
    substring = joins.contained_names(lines, names, ["block"], "label", "name").select("id", "name")
    word = joins.word_matches(lines, names, ["block"], "label", "word").select("id", "name")
    return joins.union_by_priority([("canonical", canonical), ("substring", substring), ("word", word)], ["id", "name"])


@query("""
SELECT DISTINCT a.p_name AS label, b.p_name AS surface FROM part a JOIN part b ON a.p_brand = b.p_brand
""")
def variant_expansion_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.surfaces_for_labels(table(spark, sf_dir, "part"), "p_name", "p_brand")


@query("""
WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderstatus = 'F'), s AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS found FROM orders WHERE o_orderpriority = '1-URGENT'),
o AS (SELECT unnest([0, -1, 1, -2, 2, -3, 3]) AS off, generate_subscripts([0, -1, 1, -2, 2, -3, 3], 1) AS r),
h AS (SELECT day, off, found, row_number() OVER (PARTITION BY day ORDER BY r) AS k FROM d, o JOIN s ON found = day + off)
SELECT d.day, CAST(h.off AS INTEGER) AS "offset", h.found FROM d LEFT JOIN h ON d.day = h.day AND k = 1
""")
def nearest_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, _ = _days(spark, sf_dir)
    days = orders.where("o_orderstatus = 'F'").select(F.col("o_day").alias("day")).distinct()
    found = orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_day").alias("found")).distinct()
    return joins.nearest_offset(days, found, "day", "found", joins.by_absolute_offset(3)).select("day", "offset", "found")


@query("""
WITH s AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, o_orderpriority AS p FROM orders),
j AS (SELECT d.day, (SELECT string_agg(p, ',' ORDER BY p) FROM s WHERE s.day = d.day) AS exact, (SELECT string_agg(p, ',' ORDER BY p) FROM s WHERE s.day = d.day - 1) AS previous, (SELECT string_agg(p, ',' ORDER BY p) FROM s WHERE s.day = d.day + 1) AS following FROM (SELECT DISTINCT day FROM s) d)
SELECT day, coalesce(exact, '') AS exact, coalesce(previous, '') AS previous, coalesce(following, '') AS following FROM j
""")
def neighbour_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day"), "o_orderpriority")
    out = joins.neighbour_candidates(orders, "day", "o_orderpriority")
    return out.select("day", *[F.array_join(c, ",").alias(c) for c in ("exact", "previous", "following")])


@query(f"""
WITH t AS {tokens_sql('documents', 'doc_id')}, a AS (SELECT DISTINCT term FROM t JOIN documents USING (doc_id) WHERE lang = 'en'), b AS (SELECT DISTINCT term FROM t JOIN documents USING (doc_id) WHERE lang <> 'en')
SELECT term, 'old_only' AS side FROM a WHERE term NOT IN (SELECT term FROM b) UNION ALL SELECT term, 'new_only' FROM b WHERE term NOT IN (SELECT term FROM a)
""")
def anti_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return joins.anti_compare(tokens(docs.where("lang = 'en'"), "doc_id"), tokens(docs.where("lang <> 'en'"), "doc_id"), "term")


_NORMAL = "lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))"


@query(f"""
WITH p AS (SELECT item_id, substr({_NORMAL}, 1, 150) AS p FROM benchmark), d AS (SELECT doc_id, {_NORMAL} AS t FROM documents),
h AS (SELECT item_id, count(DISTINCT doc_id) AS n, min(doc_id) AS doc_id FROM p JOIN d ON contains(t, p) AND length(p) >= 30 GROUP BY item_id)
SELECT p.item_id, CASE WHEN n = 1 THEN h.doc_id END AS doc_id, CASE WHEN length(p) < 30 THEN 'too_short' WHEN n = 1 THEN 'matched' WHEN n > 1 THEN 'ambiguous' ELSE 'missing' END AS status
FROM p LEFT JOIN h ON p.item_id = h.item_id
""")
def fingerprint_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = table(spark, sf_dir, "benchmark").select("item_id", "text", F.lit(1).alias("block"))
    raw = table(spark, sf_dir, "documents").select("doc_id", "text", F.lit(1).alias("block"))
    return joins.fingerprint_matches(flat, raw, "block", "item_id", "text", "doc_id", "text").select("item_id", "doc_id", "status")


@query(f"""
WITH d AS {tokens_sql('documents', 'doc_id', 8)}, b AS {tokens_sql('benchmark', 'item_id', 8)}
SELECT item_id, doc_id, string_agg(term, ',' ORDER BY term) AS shared, count(*) AS n_shared FROM b JOIN d USING (term) GROUP BY item_id, doc_id HAVING count(*) >= 3
""")
def pair_overlap_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, b = tokens(table(spark, sf_dir, "documents"), "doc_id", least=8), tokens(table(spark, sf_dir, "benchmark"), "item_id", least=8)
    pairs = joins.pair_overlap(b, d, "item_id", "doc_id", "term").where("n_shared >= 3")
    return pairs.select("item_id", "doc_id", F.array_join("shared", ",").alias("shared"), F.col("n_shared").cast("long").alias("n_shared"))


@query("""
WITH d AS (SELECT doc_id, n_chars, list_value(source, lang) AS c FROM documents), l AS (SELECT * FROM labels)
SELECT doc_id, CASE WHEN made AND choice IN (source, lang) THEN choice END AS final, CASE WHEN made AND choice IN (source, lang) THEN 'human' END AS decided_by, CASE WHEN made AND choice NOT IN (source, lang) THEN 'not a candidate' END AS violation
FROM (SELECT d.doc_id, d.source, d.lang, l.doc_id IS NOT NULL AS made, CASE WHEN l.toxic = 1 THEN 'none' ELSE d.lang END AS choice FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
""")
def decision_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.array("source", "lang").alias("candidates"), F.lit("open").alias("status"))
    labels = table(spark, sf_dir, "labels").join(docs.select("doc_id", "lang"), "doc_id")
    made = labels.select("doc_id", F.when(F.col("toxic") == 1, "none").otherwise(F.col("lang")).alias("chosen"), F.lit("open").alias("status"))
    return joins.overlay_decisions(docs, made, "doc_id", "candidates").select("doc_id", "final", "decided_by", "violation")


@query("""
WITH u AS (SELECT p_partkey, p_brand AS item, 'brand' AS source FROM part UNION ALL SELECT p_partkey, p_type, 'type' FROM part UNION ALL SELECT p_partkey, unnest(string_split(p_name, ' ')), 'words' FROM part UNION ALL SELECT p_partkey, lower(p_type), 'words' FROM part)
SELECT p_partkey, item, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM u GROUP BY p_partkey, item
""")
def evidence_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.array("p_brand").alias("brand"), F.array("p_type").alias("type"), F.concat(F.split("p_name", " "), F.array(F.lower("p_type"))).alias("words"))
    return joins.evidence_sources(rows, "p_partkey", ["brand", "type", "words"]).select("p_partkey", "item", F.array_join("sources", ",").alias("sources"))


@query("""
WITH p AS (SELECT conv_id, turn, length(text) AS n, sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn) - length(text) - 1 AS start, turn = max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations),
o AS (SELECT DISTINCT conv_id, unnest([0, 57, 200, 801, 100000]) AS at FROM conversations)
SELECT o.conv_id, CAST(o.at AS BIGINT) AS at, p.turn, CAST(o.at - p.start AS BIGINT) AS offset_in_part FROM o LEFT JOIN p ON o.conv_id = p.conv_id AND o.at >= p.start AND o.at < p.start + p.n + 1
""")
def offset_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("size"))
    offsets = turns.select("conv_id").distinct().withColumn("at", F.explode(F.array(*[F.lit(x).cast("long") for x in (0, 57, 200, 801, 100000)])))
    return joins.locate_offsets(offsets, turns, "conv_id", "at", "turn", "size").select("conv_id", "at", "turn", "offset_in_part")


@query("""
WITH t AS (SELECT conv_id, turn, (turn * 10) AS start, (turn * 10 + 8) AS "end" FROM conversations), s AS (SELECT conv_id, turn * 25 + 3 AS s, turn * 25 + 12 AS e FROM conversations WHERE role = 'user')
SELECT t.conv_id, t.start, t."end", EXISTS (SELECT 1 FROM s WHERE s.conv_id = t.conv_id AND t.start < s.e AND t."end" > s.s) AS inside FROM t
""")
def interval_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    t = turns.select("conv_id", (F.col("turn") * 10).alias("start"), (F.col("turn") * 10 + 8).alias("end"))
    s = turns.where("role = 'user'").select("conv_id", (F.col("turn") * 25 + 3).alias("start"), (F.col("turn") * 25 + 12).alias("end"))
    return joins.label_intervals(t, s, ["conv_id"]).select("conv_id", "start", "end", "inside")


@query("""
SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1
""")
def last_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.latest_per_key(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


@query("""
SELECT o_orderkey, coalesce(CASE WHEN o_orderpriority = '1-URGENT' THEN c_mktsegment END, CASE WHEN o_orderstatus = 'F' THEN n_name END, 'none') AS value,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 'segment' WHEN o_orderstatus = 'F' THEN 'nation' ELSE 'default' END AS source
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
""")
def precedence_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = F.broadcast(table(spark, sf_dir, "nation"))  # 25 rows at any scale
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    value, source = joins.first_available(
        ("segment", F.when(F.col("o_orderpriority") == "1-URGENT", F.col("c_mktsegment"))), ("nation", F.when(F.col("o_orderstatus") == "F", F.col("n_name"))), ("default", F.lit("none"))
    )
    return rows.select("o_orderkey", value.alias("value"), source.alias("source"))
