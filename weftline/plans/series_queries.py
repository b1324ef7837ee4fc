"""Aggregates, series and samples over the standard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import aggregates, ledger, ranking, sequences
from weftline.plans.base import query, table, tokens, tokens_sql
from weftline.streaming import incremental


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """day, n_items, n_slots, is_solid, kind: per order day the orders, the line items shipped, and whether there are at least 6 orders."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count("*").alias("n_items"), F.count_if(F.col("o_orderstatus") == "F").alias("n_final"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("day")).agg(F.count("*").alias("n_slots"))
    out = orders.join(lines, "day", "left").withColumn("n_slots", F.coalesce("n_slots", F.lit(0)))
    kind = F.when(F.col("n_final") == 0, "none_final").when(F.col("n_items") <= 3, "few").otherwise("other")
    return out.withColumn("is_solid", F.col("n_items") >= 6).withColumn("kind", F.when(~F.col("is_solid"), kind))


DAILY = """(SELECT o.day, n_items, n_final, coalesce(n_slots, 0) AS n_slots, n_items >= 6 AS is_solid,
    CASE WHEN n_items >= 6 THEN NULL WHEN n_final = 0 THEN 'none_final' WHEN n_items <= 3 THEN 'few' ELSE 'other' END AS kind
  FROM (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n_items, count(*) FILTER (o_orderstatus = 'F') AS n_final FROM orders GROUP BY 1) o
  LEFT JOIN (SELECT CAST(l_shipdate AS DATE) AS day, count(*) AS n_slots FROM lineitem GROUP BY 1) l ON o.day = l.day)"""


@query(f"""
WITH t AS {tokens_sql('documents', 'doc_id')}, c AS (SELECT term, count(*) AS frequency FROM t GROUP BY term), n AS (SELECT count(*) AS n FROM t)
SELECT term, frequency, round(ln(n / frequency), 6) AS idf, round(ln((n + 1) / (frequency + 1)) + 1, 6) AS smoothed FROM c, n
""")
def idf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tokens(table(spark, sf_dir, "documents"), "doc_id")
    plain = aggregates.idf_weights(t, "term").select("term", "frequency", F.round("idf", 6).alias("idf"))
    return plain.join(aggregates.idf_weights(t, "term", smoothed=True).select("term", F.round("idf", 6).alias("smoothed")), "term")


@query("SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text, count(*) AS n_parts FROM conversations GROUP BY conv_id")
def ordered_string_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.ordered_text(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "text")


@query(f"""
SELECT CAST(year(day) AS INTEGER) AS year, CAST(sum(least(n_items, n_slots)) AS BIGINT) AS ceiling, CAST(sum(n_items) AS BIGINT) AS items, count(*) FILTER (n_slots = 0) AS days_without_slots, round(sum(least(n_items, n_slots)) / sum(n_items), 6) AS ceiling_share
FROM {DAILY} GROUP BY 1
""")
def ceiling_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aggregates.pigeonhole_ceiling(daily(spark, sf_dir).withColumn("year", F.year("day")), "n_items", "n_slots", ["year"])
    return out.withColumn("ceiling_share", F.round("ceiling_share", 6))


@query("""
SELECT o_orderpriority, count(*) AS n, round(avg(CASE WHEN d = 0 THEN 1.0 ELSE 0.0 END), 6) AS same_day, round(avg(CASE WHEN d <= 1 THEN 1.0 ELSE 0.0 END), 6) AS within_1, round(avg(CASE WHEN d <= 3 THEN 1.0 ELSE 0.0 END), 6) AS within_3, round(avg(CASE WHEN d <= 7 THEN 1.0 ELSE 0.0 END), 6) AS within_7,
       round(avg(d), 6) AS mean_days, CAST(median(d) AS DOUBLE) AS median_days, CAST(max(d) AS BIGINT) AS max_days
FROM (SELECT o_orderpriority, abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) AS d FROM orders JOIN lineitem ON o_orderkey = l_orderkey) GROUP BY 1
""")
def daterange_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    pairs = pairs.select("o_orderpriority", F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date")).cast("long").alias("d"))
    out = aggregates.date_difference_summary(pairs, "d", ["o_orderpriority"])
    return out.select("o_orderpriority", "n", *[F.round(c, 6).alias(c) for c in ("same_day", "within_1", "within_3", "within_7", "mean_days")], "median_days", "max_days")


@query("SELECT event_type, " + ", ".join(f"count(*) FILTER (isodow(ts) = {d + 1}) AS d{d}" for d in range(7)) + " FROM events GROUP BY event_type")
def crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").select("event_type", F.concat(F.lit("d"), F.weekday("ts").cast("string")).alias("day"))
    return days.groupBy("event_type").pivot("day", [f"d{d}" for d in range(7)]).agg(F.count(F.lit(1))).na.fill(0)


@query("""
WITH x AS (SELECT CAST(n_chars AS DOUBLE) AS x, CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) AS y FROM documents),
r AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM x)
SELECT count(*) AS n, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM r
""")
def correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("n_chars", (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))).alias("spaces"))
    out = aggregates.correlations(rows, "n_chars", "spaces")
    return out.select("n", F.round("pearson", 6).alias("pearson"), F.round("spearman", 6).alias("spearman"))


@query(f"""
WITH s AS (SELECT n_items AS v, lag(n_items) OVER (ORDER BY day) AS b FROM {DAILY}) SELECT round(corr(CAST(v AS DOUBLE), CAST(b AS DOUBLE)), 6) AS lag1, count(*) AS n FROM s WHERE b IS NOT NULL
""")
def lag1_autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.lag1_autocorrelation(daily(spark, sf_dir), "day", "n_items").select(F.round("lag1", 6).alias("lag1"), "n")


@query("""
WITH t AS (SELECT conv_id, turn AS x, length(text) AS y FROM conversations),
p AS (SELECT a.conv_id, sign(a.x - b.x) * sign(a.y - b.y) AS s, a.x = b.x AS tx, a.y = b.y AS ty FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.x < b.x),
c AS (SELECT conv_id, count(*) AS pairs, count(*) FILTER (s > 0) AS concordant, count(*) FILTER (s < 0) AS discordant, count(*) FILTER (tx) AS tx, count(*) FILTER (ty) AS ty FROM p GROUP BY conv_id)
SELECT conv_id, pairs, concordant, discordant, CASE WHEN (pairs - tx) * (pairs - ty) > 0 THEN round((concordant - discordant) / sqrt(CAST(pairs - tx AS DOUBLE) * (pairs - ty)), 6) END AS tau FROM c
""")
def kendall_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("x"), F.length("text").alias("y"))
    return aggregates.kendall_tau(rows, ["conv_id"], "x", "y").withColumn("tau", F.round("tau", 6))


@query("""
WITH r AS (SELECT toxic, n_chars AS v FROM labels JOIN documents USING (doc_id)),
c AS (SELECT v, count(*) FILTER (toxic = 1) AS p, count(*) FILTER (toxic = 0) AS q FROM r GROUP BY v),
s AS (SELECT v, p, q, coalesce(sum(p) OVER w, 0) AS pb, coalesce(sum(q) OVER w, 0) AS qb, sum(p) OVER () AS np, sum(q) OVER () AS nq FROM c WINDOW w AS (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
j AS (SELECT *, (np - pb) / np - (nq - qb) / nq AS j FROM s)
SELECT CAST(max(np) AS BIGINT) AS n_positive, CAST(max(nq) AS BIGINT) AS n_negative, round(sum(p * (qb + q / 2.0)) / (max(np) * max(nq)), 6) AS effect_size, round(max(j), 6) AS youden_j FROM j
""")
def effect_size_youden(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select("toxic", "n_chars")
    out = aggregates.effect_size(rows, "toxic", "n_chars")
    return out.select("n_positive", "n_negative", F.round("effect_size", 6).alias("effect_size"), F.round("youden_j", 6).alias("youden_j"))


@query(f"""
WITH d AS {DAILY}
SELECT a.day, CAST(a.n_items AS BIGINT) AS n_items, CAST(median(b.n_items) AS DOUBLE) AS neighbour_median, count(b.day) AS neighbour_count,
       coalesce(abs(a.n_items - median(b.n_items)) >= 5, false) AS drift_flag, CASE WHEN abs(a.n_items - median(b.n_items)) >= 5 AND a.n_items > median(b.n_items) THEN 'spike' WHEN abs(a.n_items - median(b.n_items)) >= 5 THEN 'dip' ELSE 'none' END AS drift_direction
FROM d a LEFT JOIN d b ON b.day BETWEEN a.day - 3 AND a.day + 3 AND b.day <> a.day GROUP BY a.day, a.n_items
""")
def neighbor_median_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sequences.neighbour_median_drift(daily(spark, sf_dir).select("day", "n_items"), "day", "n_items", threshold=5)
    return out.select("day", "n_items", F.col("neighbour_median").cast("double").alias("neighbour_median"), "neighbour_count", "drift_flag", "drift_direction")


@query("""
SELECT conv_id, turn, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start FROM conversations
""")
def cumulative_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("size"))
    return sequences.cumulative_axis(rows, ["conv_id"], ["turn"], "size", 1).select("conv_id", "turn", "char_start")


def _runs_sql(gap: int, source: str = DAILY) -> str:
    return f"""
WITH n AS (SELECT *, row_number() OVER (ORDER BY day) AS k, sum(n_items) OVER (ORDER BY day) AS s FROM {source}),
b AS (SELECT *, CASE WHEN k - lag(k) OVER (ORDER BY day) - 1 <= {gap} THEN 0 ELSE 1 END AS brk FROM n WHERE is_solid),
r AS (SELECT *, sum(brk) OVER (ORDER BY day) AS run FROM b)
SELECT CAST(run AS BIGINT) AS run, min(day) AS start_date, max(day) AS end_date, CAST(max(k) - min(k) + 1 AS BIGINT) AS n_session_days, count(*) AS n_solid_days, CAST(max(s) - min(s - n_items) AS BIGINT) AS n_items_in_run,
       CAST(date_diff('day', min(day), max(day)) + 1 AS BIGINT) AS calendar_days, CAST(max(k) - min(k) + 1 - count(*) AS BIGINT) AS n_non_solid_days
FROM r GROUP BY run"""


@query(_runs_sql(0))
def solid_runs_gap0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.solid_runs(daily(spark, sf_dir), "day", "is_solid", 0, sums=["n_items"])


@query(_runs_sql(1))
def solid_runs_gap1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.solid_runs(daily(spark, sf_dir), "day", "is_solid", 1, sums=["n_items"])


@query(_runs_sql(2))
def solid_runs_gap2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.solid_runs(daily(spark, sf_dir), "day", "is_solid", 2, sums=["n_items"])


@query(f"""
SELECT count(*) AS n_runs, CAST(coalesce(max(calendar_days), 0) AS BIGINT) AS longest_calendar_days, {", ".join(f"count(*) FILTER (calendar_days >= {n}) AS n_spans_{n}, CAST(coalesce(sum(calendar_days) FILTER (calendar_days >= {n}), 0) AS BIGINT) AS days_{n}" for n in (7, 14, 30, 60))},
       count(*) FILTER (calendar_days >= 30) >= 6 AND coalesce(sum(calendar_days) FILTER (calendar_days >= 30), 0) >= 180 AS target_met
FROM ({_runs_sql(2)})
""")
def solid_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.run_summary(sequences.solid_runs(daily(spark, sf_dir), "day", "is_solid", 2))


@query(f"""
WITH d AS {DAILY}, s AS (SELECT day AS l, lead(day) OVER (ORDER BY day) AS r FROM d WHERE is_solid),
c AS (SELECT l, r, kind, count(*) AS n, CASE kind WHEN 'none_final' THEN 0 WHEN 'few' THEN 1 ELSE 2 END AS o FROM s JOIN d ON day > l AND day < r GROUP BY l, r, kind),
b AS (SELECT l, r, kind, sum(n) OVER (PARTITION BY l) AS total, row_number() OVER (PARTITION BY l ORDER BY n DESC, o) AS k FROM c)
SELECT s.l AS left_date, s.r AS right_date, CAST(coalesce(total, 0) AS BIGINT) AS n_between, CAST(date_diff('day', s.l, s.r) - 1 AS BIGINT) AS calendar_gap_days, coalesce(kind, 'adjacent_solid') AS dominant_class
FROM s LEFT JOIN b ON s.l = b.l AND k = 1 WHERE s.r IS NOT NULL
""")
def solid_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.solid_gaps(daily(spark, sf_dir), "day", "is_solid", "kind", ["none_final", "few", "other"])


@query(_runs_sql(0, f"(SELECT * FROM {DAILY} WHERE is_solid OR kind <> 'few')").replace("CAST(max(s) - min(s - n_items) AS BIGINT) AS n_items_in_run,", ""))
def bridge_counterfactual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.runs_under_bridge(daily(spark, sf_dir), "day", "is_solid", "kind", ["few"])


@query("""
WITH c AS (SELECT user_id, event_id, event_type, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS ch, ts FROM events),
r AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM c)
SELECT user_id, CAST(run AS BIGINT) AS run, event_type, count(*) AS n_rows, min(ts) AS "first", max(ts) AS "last" FROM r GROUP BY user_id, run, event_type
""")
def run_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.run_lengths(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")


@query("""
SELECT user_id, count(*) AS n_rows, count(b) AS n_steps, count(*) FILTER (value < b) AS n_backward FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) GROUP BY user_id
""")
def lag_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.backward_steps(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value")


@query("""
SELECT event_id, user_id, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS segment FROM events
""")
def landmark_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("landmark", F.col("event_type") == "signup")
    return sequences.landmark_segments(rows, ["user_id"], ["ts", "event_id"], "landmark").select("event_id", "user_id", "segment")


@query("""
WITH e AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'signup' THEN CAST(floor(value) AS BIGINT) END AS pin FROM events),
b AS (SELECT *, count(pin) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS bracket FROM e),
p AS (SELECT user_id, bracket, max(pin) AS left_pin, count(*) FILTER (pin IS NULL) AS n_items FROM b GROUP BY user_id, bracket),
n AS (SELECT *, lead(left_pin) OVER (PARTITION BY user_id ORDER BY bracket) AS right_pin FROM p)
SELECT user_id, bracket, left_pin, right_pin, n_items, right_pin - left_pin - 1 AS n_slots, CASE WHEN left_pin IS NULL THEN 'head' WHEN right_pin IS NULL THEN 'tail' WHEN right_pin - left_pin - 1 < 0 THEN 'non_monotone' WHEN right_pin - left_pin - 1 = 0 AND n_items = 0 THEN 'tight' WHEN right_pin - left_pin - 1 = n_items THEN 'determined' WHEN right_pin - left_pin - 1 < n_items THEN 'deficit' ELSE 'surplus' END AS bracket_class FROM n
""")
def bracket_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("pin", F.when(F.col("event_type") == "signup", F.floor("value").cast("long")))
    return sequences.pin_brackets(rows, ["user_id"], ["ts", "event_id"], "pin")


@query("""
WITH f AS (SELECT conv_id, turn, text, CASE WHEN row_number() OVER (PARTITION BY conv_id ORDER BY turn) > 1 AND (role = 'assistant' AND turn % 4 = 1) THEN 0 ELSE 1 END AS b FROM conversations),
g AS (SELECT *, sum(b) OVER (PARTITION BY conv_id ORDER BY turn) AS stitched FROM f)
SELECT conv_id, CAST(stitched AS BIGINT) AS stitched, string_agg(text, ' ' ORDER BY turn) AS text, count(*) AS n_fragments FROM g GROUP BY conv_id, stitched
""")
def stitch_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.stitch(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "text", (F.col("role") == "assistant") & (F.col("turn") % 4 == 1))


@query("""
SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('seed' || CAST(doc_id AS VARCHAR)), doc_id) AS k FROM documents) WHERE k <= CASE lang WHEN 'en' THEN 20 WHEN 'de' THEN 5 ELSE 10 END
""")
def stratified_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.stratified_pick(table(spark, sf_dir, "documents"), "lang", "doc_id", {"en": 20, "de": 5, "fr": 10, "es": 10}, "seed").select("doc_id", "lang")


@query("""
SELECT doc_id, source, k <= greatest(1, CASE WHEN abs(n * 0.3 - floor(n * 0.3) - 0.5) < 1e-9 THEN 2 * round(n * 0.3 / 2) ELSE round(n * 0.3) END) AS held_out
FROM (SELECT doc_id, source, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents)
""")
def held_out_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.held_out(table(spark, sf_dir, "documents"), ["source"], "n_chars", "doc_id").select("doc_id", "source", "held_out")


@query("""
SELECT o_orderkey, CASE WHEN k < floor(n * 0.7) THEN 'train' WHEN k < floor(n * 0.7) + floor(n * 0.15) THEN 'dev' ELSE 'test' END AS split
FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS k, count(*) OVER () AS n FROM orders)
""")
def chrono_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.chronological_split(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey").select("o_orderkey", "split")


@query("""
SELECT CASE WHEN d.doc_id IS NULL THEN 'orphan' WHEN l.doc_id IS NULL THEN 'unjudged' ELSE CAST(toxic AS VARCHAR) END AS verdict, count(*) AS n, round(avg(n_chars), 6) AS mean_score
FROM (SELECT doc_id, n_chars FROM documents WHERE lang = 'en') d FULL JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1
""")
def verdict_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aggregates.verdict_summary(table(spark, sf_dir, "documents").where("lang = 'en'"), table(spark, sf_dir, "labels"), "doc_id", "toxic", "n_chars")
    return out.withColumn("mean_score", F.round("mean_score", 6))


@query("""
WITH g AS (SELECT event_type, u FROM (SELECT DISTINCT event_type FROM events), (SELECT DISTINCT user_id AS u FROM events))
SELECT g.event_type, g.u AS user_id, count(event_id) AS n FROM g LEFT JOIN events e ON e.event_type = g.event_type AND e.user_id = g.u GROUP BY g.event_type, g.u
""")
def coverage_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.coverage_grid(table(spark, sf_dir, "events"), ["event_type"], ["user_id"])


@query("""
WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang) SELECT source, lang, n FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS k FROM c) WHERE k = 1
""")
def most_frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.most_frequent(table(spark, sf_dir, "documents"), ["source"], "lang")


@query("""
WITH s AS (SELECT l_returnflag AS bucket, count(*) AS gaps, CAST(sum(l_linenumber) AS BIGINT) AS items FROM lineitem GROUP BY 1)
SELECT bucket, gaps, items, round(gaps / sum(gaps) OVER (), 6) AS gap_share, round(items / sum(items) OVER (), 6) AS item_share FROM s
""")
def bucket_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("bucket"), "l_linenumber")
    return aggregates.bucket_shares(rows, "bucket", "l_linenumber").withColumns({c: F.round(c, 6) for c in ("gap_share", "item_share")})


@query("""
WITH l AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM l)
SELECT min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, user_id, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k
""")
def session_window_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.sessions(table(spark, sf_dir, "events"), "ts", "30 minutes", ["user_id"], F.round(F.sum("value"), 4).alias("total"))


@query("""
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n FROM events GROUP BY ALL
""")
def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.tumbling_counts(table(spark, sf_dir, "events"), "ts", "1 hour", ["event_type"])


@query("""
WITH i AS (SELECT c_nationkey AS inventory, CAST(o_orderdate AS DATE) AS date, CAST(o_orderkey AS VARCHAR) AS item FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'),
s AS (SELECT s_nationkey AS inventory, CAST(l_shipdate AS DATE) AS date, 's' || s_suppkey AS session FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_linenumber = 1),
t AS (SELECT c_nationkey AS inventory, CAST(o_orderdate AS DATE) AS date, 't' || (o_orderkey % 3) AS session, CAST(o_orderkey AS VARCHAR) AS item FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT'),
b AS (SELECT inventory, date, count(*) AS n_items FROM i GROUP BY 1, 2),
tt AS (SELECT inventory, date, string_agg(DISTINCT session, ',' ORDER BY session) AS x, count(DISTINCT session) AS c, count(*) AS n FROM t GROUP BY 1, 2),
ss AS (SELECT inventory, date, string_agg(DISTINCT session, ',' ORDER BY session) AS x, count(DISTINCT session) AS c, count(*) AS n FROM s GROUP BY 1, 2)
SELECT b.inventory, b.date, b.n_items, coalesce(tt.x, '') AS trusted, coalesce(ss.x, '') AS exact, coalesce(tt.n, 0) AS n_trusted_links, coalesce(ss.n, 0) AS n_records,
       CASE WHEN tt.c = 1 THEN 'T' WHEN tt.c > 1 THEN 'A' WHEN ss.c = 1 THEN 'E' WHEN ss.c > 1 THEN 'X' WHEN coalesce(p.c, 0) = 1 AND coalesce(f.c, 0) = 0 THEN '-1' WHEN coalesce(p.c, 0) = 0 AND coalesce(f.c, 0) = 1 THEN '+1' WHEN coalesce(p.c, 0) + coalesce(f.c, 0) > 0 THEN '?' ELSE 'N' END AS status_code
FROM b LEFT JOIN tt ON tt.inventory = b.inventory AND tt.date = b.date LEFT JOIN ss ON ss.inventory = b.inventory AND ss.date = b.date LEFT JOIN ss p ON p.inventory = b.inventory AND p.date = b.date - 1 LEFT JOIN ss f ON f.inventory = b.inventory AND f.date = b.date + 1
""")
def date_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    day = F.col("o_orderdate").cast("date").alias("date")
    items = orders.where("o_orderstatus = 'F'").select(F.col("c_nationkey").alias("inventory"), day, F.col("o_orderkey").cast("string").alias("item"))
    trusted = orders.where("o_orderpriority = '1-URGENT'").select(F.col("c_nationkey").alias("inventory"), day, F.concat(F.lit("t"), (F.col("o_orderkey") % 3).cast("string")).alias("session"), F.col("o_orderkey").cast("string").alias("item"))
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    sessions = lines.select(F.col("s_nationkey").alias("inventory"), F.col("l_shipdate").cast("date").alias("date"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("session"))
    out = ledger.date_ledger(items, sessions, trusted)
    return out.select("inventory", "date", "n_items", F.array_join("trusted_sessions", ",").alias("trusted"), F.array_join("exact_sessions", ",").alias("exact"), "n_trusted_links", "n_records", "status_code")
