"""Enumerated classes, training data and reports over the standard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import classifiers
from weftline.operators import training
from weftline.plans.base import query, table
from weftline.plans.series_queries import DAILY, daily


@query(f"""
SELECT day, CASE WHEN n_items = n_slots THEN 'matched_count' WHEN n_slots < n_items THEN 'under_segmented' ELSE 'over_segmented' END AS segmentation,
       CASE WHEN (CASE WHEN n_slots <= 0 THEN 0.0 ELSE least(1.0, n_slots / n_items) END) < 0.5 THEN 'structurally_capped' ELSE 'headroom_available' END AS headroom,
       CASE WHEN n_slots <= 0 OR ceil(n_items / n_slots) >= 7 THEN 'pigeonhole_forced' WHEN n_slots < n_items THEN 'axis_requires_repeats' ELSE 'room_on_axis' END AS cause,
       CASE WHEN n_items - 1 = 0 THEN 'determined' WHEN n_items - 1 <= 2 THEN 'nearly_determined' ELSE 'open' END AS bucket FROM {DAILY}
""")
def day_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, slots = F.col("n_items"), F.col("n_slots")
    return daily(spark, sf_dir).select(
        "day",
        classifiers.segmentation(items, slots).alias("segmentation"),
        classifiers.headroom(classifiers.structural_ceiling(items, slots)).alias("headroom"),
        classifiers.collapse_cause(items, slots).alias("cause"),
        classifiers.gap_bucket(items - 1).alias("bucket"),
    )


@query("""
SELECT conv_id, turn, CASE WHEN length(text) BETWEEN 1 AND 99 THEN 'short_text' END AS short_item,
       trim(text) <> '' AND (regexp_matches(trim(text), '^\\p{Ll}') OR (NOT regexp_matches(trim(text), '^(?i)(Ontfangen|Is\\s+ge|Opt?|Gehoort|Gelesen|Synde|Alsoo|Staende|Presentibus|Nihil)') AND length(trim(text)) < 250) OR regexp_matches(trim(text), '^(?i)(ende|nochte|daerop|mits|waerop|gelyck|verstaen\\s+dat|wert\\s+goetgevonden|voorts|vorders|belangende|sonder)\\b')) AS continues
FROM conversations
""")
def turn_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", classifiers.short_item(text).alias("short_item"), classifiers.is_continuation(text).alias("continues"))


@query("SELECT doc_id, CASE WHEN toxic = 0 THEN 'correct' ELSE 'false_positive' END AS verdict FROM labels")
def verdict_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", classifiers.verdict(F.col("toxic")).alias("verdict"))


@query("""
SELECT event_type AS channel, count(*) AS anchors, count(DISTINCT CAST(ts AS DATE)) AS days, count(DISTINCT (CAST(ts AS DATE), user_id)) AS positions, round(count(*) / count(DISTINCT CAST(ts AS DATE)), 6) AS per_day FROM events GROUP BY 1
""")
def anchor_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("channel"), F.col("ts").cast("date").alias("day"), "user_id")
    return training.density_report(rows, "channel", "day", "user_id").withColumn("per_day", F.round("per_day", 6))


@query("""
WITH d AS (SELECT o_orderpriority AS p, abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) AS d FROM orders JOIN lineitem ON o_orderkey = l_orderkey), t AS (SELECT unnest([0, 1, 7, 30, 365]) AS tolerance)
SELECT p AS o_orderpriority, CAST(tolerance AS INTEGER) AS tolerance, count(*) FILTER (d <= tolerance) AS pairs, round(count(*) FILTER (d <= tolerance) / count(*), 6) AS share FROM d, t GROUP BY p, tolerance
""")
def tolerance_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    pairs = pairs.select("o_orderpriority", F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date")).alias("d"))
    return training.tolerance_sweep(pairs, "d", [0, 1, 7, 30, 365], ["o_orderpriority"]).withColumn("share", F.round("share", 6))


@query("""
WITH n AS (SELECT DISTINCT lower(trim(p_name)) AS name, string_split_regex(lower(trim(p_name)), '\\s+') AS ws FROM part WHERE trim(p_name) <> ''),
t AS (SELECT DISTINCT p_partkey, string_split_regex(trim(lower(p_type) || ' ' || lower(p_name)), '\\s+') AS ts FROM part), z AS (SELECT DISTINCT len(ws) AS k FROM n),
s AS (SELECT DISTINCT p_partkey, k, array_to_string(ts[i : i + k - 1], ' ') AS span, ts[i : i + k - 1] AS words FROM (SELECT p_partkey, ts, k, unnest(range(1, len(ts) - k + 2)) AS i FROM t, z)),
w AS (SELECT name, len(ws) AS k, unnest(ws) AS word FROM n), u AS (SELECT p_partkey, k, span, unnest(words) AS word FROM s),
c AS (SELECT DISTINCT p_partkey, name, span, span = name AS exact FROM u JOIN w USING (k, word))
SELECT p_partkey, name, span, bool_or(exact) OVER (PARTITION BY p_partkey, name) AS exact FROM c QUALIFY NOT bool_or(exact) OVER (PARTITION BY p_partkey, name) OR exact
""")
def ngram_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-word spans of part names that share a word with the dictionary's names."""
    part = table(spark, sf_dir, "part")
    return training.ngram_candidates(part.select("p_partkey", F.concat_ws(" ", F.lower("p_type"), "p_name").alias("text")), part.select("p_name"), "p_partkey", "text", "p_name")
