"""Operators that no other query reaches, each over whole standard tables, with the SQL that must agree.

Remainders of ids make up attributes that the standard tables lack (a decision, a
claim, a status); all rows are judged by them, none is left out to save work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import classifiers, text
from weftline.operators import aggregates, align, evaluate, joins, ledger, linking, ranking, sequences, training
from weftline.plans.base import ORACLES, query, table
from weftline.plans.link_queries import _cuts

_HONORIFIC = r"(?i)\b(mr|meester|monsr?|de\s+heer|ds|dr|prof|ra.?dt)\.?(\s|$)"
_NOBLE = r"(?i)\b((?:heere?|hertog|grave|graeve|graaf|marquis|vrouwe?|jonkheer|jhr|de\s+jonge)\.?)(?:\s|$)"
_FULL_NAME = "CASE c_custkey % 4 WHEN 0 THEN 'Mr. Jan van ' || c_mktsegment WHEN 1 THEN 'de heer ' || c_name || ' hertog van Gelre' WHEN 2 THEN 'Jhr. ' || c_mktsegment || ', ' || c_name ELSE 'Dr Prof. ' || c_name END"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn("day", F.col("o_orderdate").cast("date"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


@query("""
SELECT c.nationkey, n_customers, n_suppliers FROM (SELECT c_nationkey AS nationkey, count(*) AS n_customers FROM customer GROUP BY 1) c JOIN (SELECT s_nationkey AS nationkey, count(*) AS n_suppliers FROM supplier GROUP BY 1) s ON c.nationkey = s.nationkey
""")
def one_to_one_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count("*").alias("n_customers"))
    suppliers = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count("*").alias("n_suppliers"))
    return joins.one_to_one(customers, suppliers, "nationkey")


@query("""
WITH i AS (SELECT DISTINCT p_brand, split_part(p_name, ' ', 1) AS word FROM part)
SELECT i.p_brand, i.word, CASE WHEN count(DISTINCT p_partkey) = 1 THEN min(p_partkey) END AS p_partkey FROM i LEFT JOIN part p ON p.p_brand = i.p_brand AND contains(lower(p_name), lower(word)) GROUP BY ALL
""")
def unique_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    items = part.select("p_brand", F.split("p_name", " ")[0].alias("word")).distinct()
    return joins.unique_containers(items, part, ["p_brand"], "word", "p_name", "p_partkey")


@query("""
WITH l AS (SELECT o_orderkey AS k, 'k' || o_orderkey AS session_date_key, ['T', 'E', 'N', 'X'][o_orderkey % 4 + 1] AS status_code, o_custkey AS c FROM orders),
x AS (SELECT session_date_key, status_code, 'h' || c AS human, 'c' || c AS claimed, CASE status_code WHEN 'T' THEN 't' || c WHEN 'E' THEN 'e' || c END AS direct, k % 5 = 0 AS decided, k % 7 = 0 AS has_claim, k % 3 = 0 AS scored, k % 6 = 0 AS nihil, k % 11 < 6 AS reach FROM l)
SELECT session_date_key, status_code,
    CASE WHEN direct IS NOT NULL THEN 'resolved_auto' WHEN decided THEN 'resolved_manual' WHEN nihil THEN 'nihil_actum' WHEN has_claim THEN 'resolved_auto' WHEN status_code = 'N' AND NOT reach THEN 'missing_htr' ELSE 'uncertain' END AS day_status,
    CASE WHEN direct IS NOT NULL THEN direct WHEN decided THEN human WHEN nihil THEN NULL WHEN has_claim THEN claimed END AS resolved_session,
    CASE WHEN direct IS NOT NULL THEN 'ledger_direct' WHEN decided THEN 'human_decision' WHEN nihil OR has_claim THEN 'candidate_scoring' WHEN status_code = 'N' AND NOT reach THEN 'ledger_n_status_no_recovery'
        WHEN status_code = 'N' AND scored THEN 'candidate_scoring_low_confidence' WHEN status_code = 'N' THEN 'ledger_n_status_recoverable_wider_window' ELSE 'no_confident_source' END AS resolution_source FROM x
""")
def resolve_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.element_at(F.array(*map(F.lit, "TENX")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    rows = _orders(spark, sf_dir).select(F.col("o_orderkey").alias("k"), F.concat(F.lit("k"), "o_orderkey").alias("session_date_key"), code.alias("status_code"), F.col("o_custkey").alias("c"))
    book = rows.select("session_date_key", "status_code", F.array(F.concat(F.lit("t"), "c")).alias("trusted_sessions"), F.array(F.concat(F.lit("e"), "c")).alias("exact_sessions"))
    decisions = rows.where("k % 5 = 0").select("session_date_key", F.concat(F.lit("h"), "c").alias("session"))
    claims = rows.where("k % 7 = 0").select("session_date_key", F.concat(F.lit("c"), "c").alias("session"))
    scored = rows.where("k % 3 = 0").select("session_date_key", (F.col("k") % 6 == 0).alias("nihil"))
    reach = rows.where("k % 11 < 6").select("session_date_key", F.lit(1).alias("offset"))
    return ledger.resolve_days(book, decisions, claims, scored, reach).select("session_date_key", "status_code", "day_status", "resolved_session", "resolution_source")


@query("""
WITH c AS (SELECT CAST(o_orderdate AS DATE) AS day, o_orderkey % 5 AS r, 's' || (o_custkey % 3) AS session FROM orders), b AS (SELECT *, min(r) OVER (PARTITION BY day) AS best FROM c),
g AS (SELECT day, best, count(DISTINCT session) AS n, min(session) AS session FROM b WHERE r = best GROUP BY day, best)
SELECT day, CASE WHEN n > 1 THEN 'ambiguous' ELSE ['resolved_manual', 'resolved_auto', 'nihil_actum', 'missing_htr', 'uncertain'][best + 1] END AS status, CASE WHEN n = 1 THEN session END AS session FROM g
""")
def select_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ("resolved_manual", "resolved_auto", "nihil_actum", "missing_htr", "uncertain")))
    rows = _orders(spark, sf_dir).select("day", F.element_at(names, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("status"), F.concat(F.lit("s"), (F.col("o_custkey") % 3).cast("string")).alias("session"))
    return ledger.select_status(rows, ["day"], "status", "session")


@query("""
WITH s AS (SELECT CAST(o_orderdate AS DATE) AS day, o_custkey, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END AS pool FROM orders)
SELECT DISTINCT day, o_custkey, CAST(pool AS INTEGER) AS pool FROM (SELECT *, min(pool) OVER (PARTITION BY day) AS best FROM s) WHERE pool = best
""")
def pools_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir)
    stages = [rows.where("o_orderpriority = '1-URGENT'"), rows.where("o_orderpriority = '2-HIGH'"), rows.where("o_orderpriority not in ('1-URGENT', '2-HIGH')")]
    return joins.pools_by_priority(rows, stages, "day", "o_custkey")


@query("""
WITH x AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN l_partkey END AS e, l_suppkey AS a, CASE WHEN l_linestatus = 'F' THEN l_partkey + 1 END AS f, CASE WHEN l_quantity > 10 THEN [l_partkey + 2, l_suppkey * (l_linenumber % 2)] ELSE [] END AS p FROM lineitem)
SELECT l_orderkey, l_linenumber, coalesce(e, CASE WHEN list_contains(p, a) THEN a END, f, p[1]) AS paragraph,
    CASE WHEN e IS NOT NULL THEN 'explicit' WHEN list_contains(p, a) THEN 'automatic' WHEN f IS NOT NULL THEN 'anchor' WHEN len(p) > 0 THEN 'first_paragraph' END AS source FROM x
""")
def pin_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.col("l_partkey")
    paragraphs = F.when(F.col("l_quantity") > 10, F.array(part + 2, F.col("l_suppkey") * (F.col("l_linenumber") % 2))).otherwise(F.array().cast("array<bigint>"))
    pairs = _lines(spark, sf_dir)
    out = training.pin_ladder(pairs, F.when(F.col("l_returnflag") == "R", part), F.col("l_suppkey"), F.when(F.col("l_linestatus") == "F", part + 1), paragraphs)
    return out.select("l_orderkey", "l_linenumber", "paragraph", "source")


@query("""
SELECT n_nationkey AS nation, coalesce(s, c, n_nationkey) AS pin FROM nation LEFT JOIN (SELECT s_nationkey, min(s_suppkey) + 1000000 AS s FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey LEFT JOIN (SELECT c_nationkey, min(c_custkey) + 2000000 AS c FROM customer GROUP BY 1) ON c_nationkey = n_nationkey
""")
def pinned_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").cast("int").alias("nation")).agg((F.min("s_suppkey") + 1000000).alias("pin"))
    customers = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("int").alias("nation")).agg((F.min("c_custkey") + 2000000).alias("pin"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("nation"), F.col("n_nationkey").cast("long").alias("pin"))
    return training.pinned_records([suppliers, customers, nations], ["nation"])


@query("""
WITH x AS (SELECT o_orderstatus = 'F' AS s, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS e FROM orders)
SELECT CASE WHEN s THEN 'yes' ELSE 'no' END AS structure, CASE WHEN e <= 0 THEN 'none' WHEN e <= 2 THEN 'some' ELSE 'strong' END AS evidence, count(*) AS n FROM x GROUP BY 1, 2
""")
def structure_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _lines(spark, sf_dir).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("e"))
    return aggregates.structure_evidence_grid(_orders(spark, sf_dir).join(counts, "o_orderkey", "left"), F.col("o_orderstatus") == "F", F.col("e"))


@query("""
SELECT nation, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(*) AS n FROM (SELECT c_nationkey AS nation, 'buyer' AS source FROM customer UNION ALL SELECT s_nationkey, 'seller' FROM supplier) GROUP BY nation
""")
def labelled_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = aggregates.labelled_union(buyer=table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")), seller=table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation")))
    return both.groupBy("nation").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.count("*").alias("n"))


@query("""
WITH p AS (SELECT DISTINCT l_orderkey, l_linenumber AS i, 2 * l_linenumber AS s FROM lineitem WHERE l_returnflag = 'N' UNION SELECT DISTINCT l_orderkey, -1, -1 FROM lineitem UNION SELECT DISTINCT l_orderkey, 10, 20 FROM lineitem),
c AS (SELECT *, lead(i) OVER w AS next_i, lead(s) OVER w AS next_s FROM p WINDOW w AS (PARTITION BY l_orderkey ORDER BY i, s))
SELECT l_orderkey, CAST(i AS INTEGER) AS i, CAST(s AS INTEGER) AS s, CAST(next_i AS INTEGER) AS next_i, CAST(next_s AS INTEGER) AS next_s, CAST(next_i - i - 1 AS INTEGER) AS n_items, CAST(next_s - s - 1 AS INTEGER) AS n_slots FROM c WHERE next_i IS NOT NULL
""")
def known_point_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.when(F.col("l_returnflag") == "N", F.col("l_linenumber"))
    points = _lines(spark, sf_dir).select("l_orderkey", known.alias("item"), (2 * known).alias("slot"), F.lit(10).alias("items"), F.lit(20).alias("slots"))
    return sequences.known_point_gaps(points, ["l_orderkey"], "item", "slot", "items", "slots")


@query("""
WITH x AS (SELECT c_nationkey, 'v' || (c_custkey % 12) || '-p' || c_custkey AS id FROM customer)
SELECT c_nationkey, id, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY CAST(regexp_extract_all(id, '[0-9]+') AS BIGINT[]), id) AS INTEGER) AS place FROM x
""")
def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    ident = F.concat(F.lit("v"), (F.col("c_custkey") % 12).cast("string"), F.lit("-p"), F.col("c_custkey").cast("string"))
    rows = table(spark, sf_dir, "customer").select("c_nationkey", ident.alias("id"))
    return sequences.ordinal(rows, ["c_nationkey"], *ranking.natural_order("id"), name="place").withColumn("place", F.col("place") + 1)


@query("""
SELECT o_orderkey, CASE WHEN x < 0.7 THEN 'train' WHEN x < 0.85 THEN 'dev' ELSE 'test' END AS split FROM (SELECT o_orderkey, CAST('0x' || substr(md5('s1' || o_custkey), 1, 8) AS BIGINT) / 4294967296.0 AS x FROM orders)
""")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.hash_split(_orders(spark, sf_dir), "o_custkey", [("train", 0.7), ("dev", 0.15), ("test", 0.15)], "s1").select("o_orderkey", "split")


@query("SELECT o_custkey, count(DISTINCT o_orderstatus) AS n_splits FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def leaking_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.leaking_keys(_orders(spark, sf_dir), "o_custkey", "o_orderstatus")


@query("""
SELECT count(*) AS n, count(*) FILTER (l_discount >= 0.05) AS baseline_right, count(*) FILTER (l_tax >= 0.04) AS candidate_right, count(*) FILTER (l_tax >= 0.04) >= count(*) FILTER (l_discount >= 0.05) AS passes FROM lineitem
""")
def head_to_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.gate(_lines(spark, sf_dir).select((F.col("l_discount") >= 0.05).alias("a"), (F.col("l_tax") >= 0.04).alias("b")), "a", "b")


@query(f"""
WITH t AS (SELECT c_custkey, regexp_replace({_FULL_NAME}, '{_HONORIFIC}', ' \\2', 'g') AS bare, {_FULL_NAME} AS name FROM customer)
SELECT c_custkey, bare, lower(trim(regexp_extract(bare, '{_NOBLE}', 1))) AS noble,
    lower(CASE WHEN contains(name, ',') THEN trim(split_part(name, ',', 1)) ELSE regexp_extract(name, '[^ ]+$') END) AS family, CASE WHEN length(regexp_extract(name, '[^ ]+$')) >= 8 THEN lower(regexp_extract(name, '[^ ]+$')) END AS surname FROM t
""")
def name_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.expr(_FULL_NAME).alias("name"))
    return rows.select("c_custkey", text.strip_honorifics("name").alias("bare"), text.noble_title("name").alias("noble"), text.family_key("name").alias("family"), text.surname_token("name", 8).alias("surname"))


@query("""
WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS k, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
t AS (SELECT doc_id, k, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS t FROM l)
SELECT doc_id, CAST(k AS INTEGER) AS line, length(t) BETWEEN 3 AND 80 AND regexp_matches(t, '[A-Za-zÀ-ÿ]') AND NOT regexp_matches(t, '\\p{Nd}') AND len(regexp_extract_all(t, '[A-Za-zÀ-ÿ'']+(?:-[A-Za-zÀ-ÿ'']+)?')) BETWEEN 1 AND 8 AS name FROM t
""")
def looks_like_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    return lines.select("doc_id", "line", text.looks_like_name("t").alias("name"))


@query("""
WITH x AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '["a ' || event_id || '", "b"]' WHEN 1 THEN ' plain ' || event_type WHEN 2 THEN 'NaN' ELSE '  ' END AS v FROM events)
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'a ' || event_id || '|b' WHEN 1 THEN trim(v) ELSE '' END AS parts FROM x
""")
def parse_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.expr("CASE event_id % 4 WHEN 0 THEN '[\"a ' || event_id || '\", \"b\"]' WHEN 1 THEN ' plain ' || event_type WHEN 2 THEN 'NaN' ELSE '  ' END")
    return table(spark, sf_dir, "events").select("event_id", F.array_join(text.parse_paragraphs(v), "|").alias("parts"))


@query("""
SELECT p_partkey, '(?i)\\b' || replace(replace(regexp_replace(regexp_replace(lower(p_type || ' ' || p_name), 'ij|y', chr(1), 'g'), '[ij]', '[ij]', 'g'), chr(1), '(?:ij|y)'), ' ', '\\s+') || '\\b' AS pattern FROM part
""")
def name_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.name_regex(F.concat_ws(" ", "p_type", "p_name")).alias("pattern"))


@query("""
SELECT event_id, props AS found, event_type = 'purchase' AS affirmed, greatest(try_cast(regexp_extract(props, '[0-9]+') AS INTEGER) - 2, 0) AS number,
    CASE WHEN event_id % 2 = 0 THEN greatest(CAST(event_id AS INTEGER) - 2, 0) END AS shifted FROM events
""")
def answer_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read from a model's or a person's answer: the JSON object in it, whether it affirms, its offsets."""
    e = table(spark, sf_dir, "events")
    answer = F.concat(F.lit("so } "), "props", F.lit(' and {"not": "this"}'))
    said = F.when(F.col("event_type") == "purchase", " yes, it is").otherwise("yesterday")
    offset = F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")).otherwise(F.concat(F.lit("x"), F.col("event_id").cast("string")))
    number = text.corrected_offset(F.regexp_extract("props", "[0-9]+", 0))
    return e.select("event_id", text.first_json_object(answer).alias("found"), text.affirmative(said).alias("affirmed"), number.alias("number"), text.corrected_offset(offset).alias("shifted"))


@query("""
SELECT doc_id, coalesce(regexp_matches(trim(text), '^(?:The|In|To|An)'), false) AS opens, coalesce(regexp_matches(right(text, 150), '(?i)(?:license|the\\.)'), false) AS closes FROM documents
""")
def formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    opens, closes = classifiers.formulaic(F.col("text"), "^(?:The|In|To|An)", r"(?i)(?:license|the\.)")
    return table(spark, sf_dir, "documents").select("doc_id", opens.alias("opens"), closes.alias("closes"))


@query("""
WITH x AS (SELECT l_orderkey, l_linenumber, ['T', 'E', '-1', 'A', 'N', '?', '+1'][l_linenumber] AS status, CASE WHEN l_suppkey % 2 = 0 THEN ['t'] ELSE ['t', 'u'] END AS t, CASE WHEN l_partkey % 2 = 0 THEN ['e'] ELSE [] END AS e, l_returnflag = 'R' AS near FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN status = 'T' AND len(t) = 1 THEN 't' WHEN status = 'E' AND len(e) = 1 THEN 'e' END AS session,
    CASE WHEN (status = 'T' AND len(t) = 1) OR (status = 'E' AND len(e) = 1) THEN NULL WHEN status IN ('T', 'E') THEN 'invalid_unique_evidence' WHEN status IN ('-1', '+1') THEN 'nearby_policy_pending' WHEN status IN ('A', 'X', '?') OR near THEN 'ambiguous_session_candidates' ELSE 'no_supported_session_candidate' END AS reason FROM x
""")
def selected_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, ("T", "E", "-1", "A", "N", "?", "+1"))), F.col("l_linenumber"))
    trusted = F.when(F.col("l_suppkey") % 2 == 0, F.array(F.lit("t"))).otherwise(F.array(F.lit("t"), F.lit("u")))
    exact = F.when(F.col("l_partkey") % 2 == 0, F.array(F.lit("e"))).otherwise(F.array().cast("array<string>"))
    rows = _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", status.alias("s"), trusted.alias("t"), exact.alias("e"), (F.col("l_returnflag") == "R").alias("near"))
    session, reason = classifiers.selected_session(*map(F.col, ("s", "t", "e", "near")))
    return rows.select("l_orderkey", "l_linenumber", session.alias("session"), reason.alias("reason"))


_RECORD = """CASE event_id % 3 WHEN 0 THEN '{"k": 1, "evidence_quote": " ' || event_type || ' "}' WHEN 1 THEN '{"k": 1}' ELSE '{"evidence_quote": "ab"}' END"""


@query(f"""
SELECT event_id, coalesce(length(trim(json_extract_string(j, '$.evidence_quote'))) > 3, false) AS quoted, list_has_all(json_keys(j), ['k', 'evidence_quote']) AS complete FROM (SELECT event_id, CAST({_RECORD} AS JSON) AS j FROM events)
""")
def summary_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    quoted, complete = classifiers.summary_gate(F.expr(_RECORD), ("k", "evidence_quote"))
    return table(spark, sf_dir, "events").select("event_id", quoted.alias("quoted"), complete.alias("complete"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, CAST(CASE WHEN l_returnflag = 'R' THEN 10000 ELSE 0 END + 300 * l_linenumber + 100 * l_suppkey + 100 * (l_partkey % 3) + l_partkey % 5 - 50 * abs(date_diff('day', DATE '1997-01-01', CAST(l_shipdate AS DATE))) AS BIGINT) AS score FROM lineitem
""")
def candidate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1997-01-01").cast("date"))
    score = linking.candidate_score(F.col("l_returnflag") == "R", F.col("l_linenumber"), F.col("l_suppkey"), F.col("l_partkey") % 3, F.col("l_partkey") % 5, days)
    return _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", score.cast("long").alias("score"))


@query("""
WITH p AS (SELECT l_orderkey, l_suppkey, sum(l_quantity) AS o, CAST(count(*) AS DOUBLE) AS s FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY o + s DESC, l_suppkey) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM p)
SELECT l_orderkey, l_suppkey AS top_session, o + s AS top_score, o <= 5 AS low_confidence, n AS n_ranked FROM r WHERE k = 1
""")
def ranked_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _lines(spark, sf_dir).groupBy("l_orderkey", "l_suppkey").agg(F.sum("l_quantity").alias("o"), F.count("*").cast("double").alias("s"))
    out = linking.ranked_sessions(pairs, "l_orderkey", "l_suppkey", "o", "s")
    return out.select("l_orderkey", "top_session", "top_score", "low_confidence", F.size("ranked").cast("long").alias("n_ranked"))


@query("""
WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, max(event_id) AS anchor FROM events WHERE event_type = 'purchase' GROUP BY 1, 2), n AS (SELECT *, lead(day) OVER w AS nd, lead(anchor) OVER w AS next_anchor FROM d WINDOW w AS (PARTITION BY user_id ORDER BY day))
SELECT user_id, day + CAST(k AS INTEGER) AS day, anchor, next_anchor, CAST(k AS INTEGER) AS days_since FROM (SELECT *, unnest(range(0, coalesce(date_diff('day', day, nd), 1))) AS k FROM n)
""")
def anchor_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").where("event_type = 'purchase'").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.max("event_id").alias("anchor"))
    return sequences.anchor_dates(days, "day", "anchor", ["user_id"])


@query("""
WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber WHEN 1 THEN 0.0 WHEN 2 THEN 1.0 WHEN 3 THEN 4.0 ELSE 6.0 END AS r, l_discount * 20 AS o FROM lineitem), a AS (SELECT *, greatest(0.0, r - greatest(0.0, least(1.0, o)) * 0.1) AS alignment FROM x)
SELECT l_orderkey, l_linenumber, l_partkey, round(alignment, 6) AS alignment, round(CASE WHEN l_linenumber = 1 THEN 1.0 ELSE 2.0 END + least(1.0, CASE WHEN l_partkey % 50 = 0 THEN 999 ELSE l_partkey % 50 END / 100.0) * 0.1, 6) AS positional,
    round(alignment + CASE WHEN l_partkey % 2 = 0 AND l_linenumber % 2 = 0 THEN -1.0 WHEN l_partkey % 2 = 0 THEN -0.3 ELSE 1.0 END, 6) AS formula, round(least(1.0, o * 80 / 100.0), 6) AS evidence FROM a
""")
def placement_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, part, overlap = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_discount") * 20
    tier = F.when(n == 1, "tier1_anchor").when(n == 2, "tier2_interpolated").when(n == 3, "tier3_head_template").otherwise("elsewhere")
    alignment = ledger.alignment_score(tier, overlap)
    formula = classifiers.formula_score(F.when(part % 2 == 0, 1), F.when(n % 2 == 0, 1), alignment)
    scores = {"alignment": alignment, "positional": classifiers.positional_score(n == 1, part % 50), "formula": formula, "evidence": classifiers.position_evidence(overlap * 80)}
    return _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", *[F.round(c, 6).alias(k) for k, c in scores.items()])


_ITEMS = "(SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_orderkey) - 1 AS e, count(*) OVER (PARTITION BY CAST(o_orderdate AS DATE)) AS n FROM orders)"


@query(f"""
SELECT o_orderkey, CASE WHEN dayofmonth(day) % 3 = 0 OR dayofmonth(day) % 3 = 1 AND n > 1 THEN NULL WHEN e = 0 THEN 0 ELSE 2 * e END AS paragraph_start,
    CASE WHEN dayofmonth(day) % 3 = 0 OR dayofmonth(day) % 3 = 1 AND n > 1 THEN NULL WHEN e = n - 1 THEN 2 * n - 1 ELSE 2 * (e + 1) END AS paragraph_end FROM {_ITEMS}
""")
def paragraph_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of which a third is abstained on, and a third is predicted for one item, whatever there are."""
    items = sequences.ordinal(_orders(spark, sf_dir).select("o_orderkey", "day"), ["day"], "o_orderkey", name="e")
    days = items.groupBy("day").agg(F.count("*").alias("n"))
    third = F.dayofmonth("day") % 3
    predictions = days.select(
        "day", F.when(third == 0, "abstained").otherwise("predicted").alias("status"), F.when(third == 1, F.lit(1)).otherwise(F.col("n")).alias("k_e"), (2 * F.col("n")).alias("axis"),
        F.when(F.col("n") > 1, F.transform(F.sequence(F.lit(1).cast("long"), F.col("n") - 1), lambda k: 2 * k)).otherwise(F.array().cast("array<bigint>")).alias("cuts"),
    )
    return align.paragraph_ranges(items.join(days, "day"), predictions, "day", "e", "n").select("o_orderkey", "paragraph_start", "paragraph_end")


@query("""
SELECT doc_id, array_to_string([CAST(floor(k * n_chars / (doc_id % 5 + 1)) AS BIGINT) FOR k IN range(1, doc_id % 5 + 1)], ',') AS cuts FROM documents
""")
def uniform_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = align.uniform_cuts(F.col("n_chars"), F.col("doc_id") % 5 + 1)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(cuts.cast("array<string>"), ",").alias("cuts"))


@query("""
WITH t AS (SELECT conv_id, turn, length(text) AS size FROM conversations), w AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY conv_id ORDER BY turn, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size) OVER (PARTITION BY conv_id) AS whole FROM t)
SELECT conv_id, turn, CAST(size AS BIGINT) AS size, CAST(coalesce(round_even(CAST(before * 1000 AS DOUBLE) / nullif(whole, 0), 0), 0) AS BIGINT) AS cut FROM w
""")
def proportional_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("size"), F.lit(1000).alias("whole"))
    return align.proportional_cuts(turns, ["conv_id"], ["turn", "size"], "size", "whole").select("conv_id", "turn", "size", "cut")


@query("""
WITH s AS (SELECT user_id, event_id AS a, event_id + 3 AS b, row_number() OVER w AS k, count(*) OVER (PARTITION BY user_id) AS n, lead(event_id) OVER w AS nx FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, CAST(c AS INTEGER) AS k, CAST(floor((b + nx) / 2) AS BIGINT) AS cut FROM s, (SELECT unnest([1, 2, 3]) AS c) WHERE n > 3 AND k = floor(c * n / 4)
""")
def interior_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("a"), (F.col("event_id") + 3).alias("b"))
    return align.interior_cuts(spans, ["user_id"], "a", "b", 3)


@query("""
SELECT count(*) AS judged, count(*) FILTER (p) AS proposed, count(*) FILTER (p AND v) AS "right", round(count(*) FILTER (p AND v) / nullif(count(*) FILTER (p), 0), 6) AS precision, round(count(*) FILTER (p AND v) / nullif(count(*) FILTER (v), 0), 6) AS recall, round(1 - count(*) FILTER (p) / count(*), 6) AS abstention
FROM (SELECT toxic = 1 AS v, n_chars % 2 = 0 AS p FROM labels JOIN documents USING (doc_id))
""")
def pair_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    gold = table(spark, sf_dir, "labels").join(docs.select("doc_id"), "doc_id").select("doc_id", (F.col("toxic") == 1).alias("v"))
    out = evaluate.pair_backtest(gold, docs.where("n_chars % 2 = 0"), ["doc_id"], "v")
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "abstention")})


@query("""
WITH a AS (SELECT l_suppkey, l_linenumber, count(*) FILTER (l_returnflag = 'N') AS r, count(*) FILTER (l_returnflag = 'A') AS h FROM lineitem GROUP BY 1, 2), s AS (SELECT CAST(sum(least(r, h)) AS BIGINT) AS tp, CAST(sum(r) AS BIGINT) AS n_ref, CAST(sum(h) AS BIGINT) AS n_hyp FROM a)
SELECT tp, n_ref, n_hyp, round(tp / n_hyp, 6) AS precision, round(tp / n_ref, 6) AS recall, round(2 * tp / (n_ref + n_hyp), 6) AS f1 FROM s
""")
def exact_span_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    out = evaluate.exact_span_scores(lines.where("l_returnflag = 'N'"), lines.where("l_returnflag = 'A'"), ["l_suppkey", "l_linenumber"])
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


_CELLS = "(SELECT l_returnflag AS g, l_linenumber - 1 AS i, l_suppkey % 7 AS j, CAST(count(*) AS DOUBLE) AS score FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL)"


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).where("l_linestatus = 'O'").groupBy(F.col("l_returnflag").alias("g"), (F.col("l_linenumber") - 1).alias("i"), (F.col("l_suppkey") % 7).alias("j")).agg(F.count("*").cast("double").alias("score"))


@query(f"""
WITH s AS (SELECT g, coalesce(sum(score) FILTER (i = j), 0) AS d, sum(score) AS a, coalesce(sum(score) FILTER (abs(i - j) <= 1), 0) AS b FROM {_CELLS} GROUP BY g)
SELECT g, round(d / 7, 6) AS diagonal_mean, round((a - d) / 42, 6) AS off_mean, round(d / 7 - (a - d) / 42, 6) AS margin, round(b / a, 6) AS band_share FROM s
""")
def axis_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir)
    sizes = cells.select("g").distinct().select("g", F.lit(7).alias("n"), F.lit(7).alias("m"))
    return evaluate.axis_metrics(cells, sizes, ["g"]).withColumns({c: F.round(c, 6) for c in ("diagonal_mean", "off_mean", "margin", "band_share")})


@query(f"""
WITH c AS {_CELLS} SELECT c.g, c.i, c.j, c.score, coalesce(sum(o.score), 0) AS neighbours FROM c LEFT JOIN c o ON o.g = c.g AND abs(o.i - c.i) <= 1 AND abs(o.j - c.j) <= 1 AND (o.i <> c.i OR o.j <> c.j) GROUP BY ALL
""")
def neighbourhood_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.neighbourhood_score(_cells(spark, sf_dir), ["g"])


@query("""
SELECT l_returnflag, count(*) AS n, round(avg(CASE WHEN d = 0 THEN 1.0 ELSE 0.0 END), 6) AS exact, round(avg(CASE WHEN d <= 1 THEN 1.0 ELSE 0.0 END), 6) AS within_one, round(avg(d), 6) AS mean_displacement, median(d) AS median_displacement FROM (SELECT l_returnflag, abs(l_linenumber - l_suppkey % 7) AS d FROM lineitem) GROUP BY 1
""")
def placement_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _lines(spark, sf_dir).select("l_returnflag", F.col("l_linenumber").alias("a"), (F.col("l_suppkey") % 7).alias("b"))
    return evaluate.placement_accuracy(pairs, "a", "b", ["l_returnflag"]).withColumns({c: F.round(c, 6) for c in ("exact", "within_one", "mean_displacement")})


@query("""
SELECT o_orderkey, n, nothing FROM (SELECT o_orderkey, o_orderstatus = 'P' AS nothing, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n FROM orders) WHERE nothing = (n > 0)
""")
def invariant_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _lines(spark, sf_dir).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    days = _orders(spark, sf_dir).join(counts, "o_orderkey", "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n"), (F.col("o_orderstatus") == "P").alias("nothing"))
    return evaluate.invariant_violations(days, "n", "nothing")


@query("""
SELECT doc_id, source, CAST(coalesce(sum(n_chars + 1) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS fold_start FROM documents
""")
def fold_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.fold_groups(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "source", ["doc_id"], "n_chars").drop("n_chars")


@query("SELECT l_orderkey, l_suppkey, count(*) AS n_cuts FROM lineitem GROUP BY 1, 2")
def lumped_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.lumped_positions(_lines(spark, sf_dir), ["l_orderkey"], "l_suppkey")


@query("""
WITH k AS (SELECT user_id, event_id, CAST(floor(value) AS BIGINT) % 20 AS a, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM events), t AS (SELECT *, lag(a) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM k WHERE k % 3 = 0)
SELECT user_id, event_id, a, CASE WHEN a < b THEN 'backward' WHEN a = b THEN 'repeated' END AS obstruction FROM t
""")
def thinned_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchors = table(spark, sf_dir, "events").select("user_id", "event_id", (F.floor("value") % 20).alias("a"))
    return evaluate.anchor_obstruction(evaluate.thinned_anchors(anchors, ["user_id"], ["event_id"], 3), ["user_id"], "event_id", "a")


@query("SELECT p_name, count(DISTINCT p_size) AS n_lengths, count(*) AS n FROM part GROUP BY 1 HAVING count(DISTINCT p_size) > 1")
def inconsistent_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.inconsistent_boundaries(table(spark, sf_dir, "part"), "p_name", "p_size")


@query("SELECT p_partkey FROM part WHERE substr(p_name, p_size % 3 + 1, 2) <> substr(p_name, 1, 2)")
def text_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("p_size") % 3
    spans = table(spark, sf_dir, "part").select("p_partkey", "p_name", start.alias("a"), (start + 2).alias("b"), F.substring("p_name", 1, 2).alias("s"))
    return evaluate.text_mismatches(spans, "p_name", "a", "b", "s").select("p_partkey")


@query("""
SELECT event_id, gap FROM (SELECT event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) - event_id - 2 AS gap FROM events) WHERE gap BETWEEN 0 AND 5
""")
def partial_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") + 2).alias("end"))
    return evaluate.partial_coverage(spans, ["user_id"], "event_id", "end").select("event_id", "gap")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity + CASE WHEN toxic = 0 THEN 5 ELSE 0 END, 6) AS priority, doc_id IS NOT NULL AS judged FROM lineitem LEFT JOIN labels ON doc_id = l_partkey WHERE coalesce(toxic, 0) = 0
""")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("l_partkey"), F.when(F.col("toxic") == 0, "approve").otherwise("reject").alias("verdict"))
    return evaluate.review_queue(_lines(spark, sf_dir), verdicts, ["l_partkey"], "l_quantity").select("l_orderkey", "l_linenumber", "l_partkey", F.round("priority", 6).alias("priority"), "judged")


@query("""
WITH a AS (SELECT l_orderkey AS p, l_partkey AS e, 'x' || l_linenumber AS tag, l_suppkey * 3 AS s FROM lineitem WHERE l_returnflag <> 'R'), k AS (SELECT *, row_number() OVER (PARTITION BY p, e, s ORDER BY tag) AS k FROM a)
SELECT p AS paragraph_id, e AS entity, p_name AS name, tag AS tag_text, CAST(greatest(s - 2, 0) AS INTEGER) AS start, CAST(greatest(s + 2, 0) AS INTEGER) AS "end", CAST(o_orderdate AS DATE) AS date FROM k JOIN part ON p_partkey = e JOIN orders ON o_orderkey = p WHERE k = 1
""")
def training_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("l_suppkey") * 3
    shown = lambda c: F.when(F.col("l_returnflag") == "R", "none").otherwise(c.cast("string"))
    notes = _lines(spark, sf_dir).select(F.col("l_orderkey").alias("paragraph_id"), F.col("l_partkey").alias("entity"), F.concat(F.lit("x"), "l_linenumber").alias("tag_text"), shown(s).alias("offset"), shown(s + 4).alias("end"))
    entities = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return training.training_pairs(notes, entities, _orders(spark, sf_dir).select(F.col("o_orderkey").alias("paragraph_id"), F.col("day").alias("date")))


@query("""
WITH g AS (SELECT o_orderkey, o_orderpriority AS p, o_custkey % 10 AS place FROM orders), x AS (SELECT p, place, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 10 END AS proposed FROM g)
SELECT p, count(*) AS judged, count(proposed) AS proposed, count(*) FILTER (proposed = place) AS matches, round(count(*) FILTER (proposed = place) / nullif(count(proposed), 0), 6) AS precision, round(count(*) FILTER (proposed = place) / count(*), 6) AS match_rate FROM x GROUP BY p
""")
def chain_judgement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir)
    gold = rows.select(F.col("o_orderkey").alias("item"), F.col("o_orderpriority").alias("p"), (F.col("o_custkey") % 10).alias("place"))
    proposed = rows.where("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("item"), (F.col("o_orderkey") % 10).alias("place"))
    return training.chain_judgement(gold, proposed, ["p"]).withColumns({c: F.round(c, 6) for c in ("precision", "match_rate")})


@query("""
SELECT p_brand AS person, count(*) AS pin_count, min(p_type) AS name, string_agg(DISTINCT CASE WHEN p_size % 2 = 0 THEN p_name END, ';' ORDER BY CASE WHEN p_size % 2 = 0 THEN p_name END) AS surfaces FROM part GROUP BY 1
""")
def alias_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), (F.col("p_partkey") * 2).alias("paragraph"), F.col("p_brand").alias("person"), F.col("p_type").alias("name"), F.concat(F.lit(" "), "p_name").alias("surface"), F.lit(" ").alias("tag_text"), "p_size")
    seen = part.where("p_size % 2 = 0")
    out = training.alias_table(part.select("item", "paragraph"), part.select("item", "person", "name"), seen)
    return out.select("person", "pin_count", "name", F.nullif(F.array_join("surfaces", ";"), F.lit("")).alias("surfaces"))


@query("""
WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderstatus = 'F'), a AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem)
SELECT count(*) AS abstained, count(a.day) AS supplied, round(count(a.day) / count(*), 6) AS share FROM d LEFT JOIN a ON a.day = d.day
""")
def supply_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchors = _lines(spark, sf_dir).select(F.col("l_shipdate").cast("date").alias("day"))
    return training.supply_gain(anchors, _orders(spark, sf_dir).where("o_orderstatus = 'F'"), "day").withColumn("share", F.round("share", 6))


@query("""
SELECT o_custkey, CAST(n AS INTEGER) AS n, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS n FROM orders) WHERE n < 3
""")
def first_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequences.first_n(_orders(spark, sf_dir), ["o_custkey"], 3, "o_orderdate", "o_orderkey")
    return sequences.ordinal(rows, ["o_custkey"], "o_orderdate", "o_orderkey", name="n").select("o_custkey", "n", "o_orderkey")


def _reason() -> Column:
    start = F.when(F.col("l_returnflag") == "R", F.lit(None)).otherwise(F.col("l_suppkey"))
    return evaluate.loss_reason(start, F.col("l_partkey") % 40, F.col("l_linenumber") % 3)


@query(f"""
SELECT l_linestatus, CASE WHEN l_returnflag = 'R' THEN 'unplaced' WHEN l_linenumber % 3 > 1 THEN 'shared_start' WHEN l_partkey % 40 > {evaluate.MOST_EXTENT} THEN 'extent' END AS reason, count(*) AS n FROM lineitem GROUP BY 1, 2
""")
def loss_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).groupBy("l_linestatus", _reason().alias("reason")).agg(F.count("*").alias("n"))


#: Scores of a corpus from those of its groups, rounded as the groups' query rounds them.
@query(f"""
WITH s AS ({ORACLES["boundary_prf_tol0"]})
SELECT count(*) AS n_groups, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, round(sum(tp) / sum(tp + fp), 6) AS micro_precision, round(sum(tp) / sum(tp + fn), 6) AS micro_recall, round(2 * sum(tp) / sum(2 * tp + fp + fn), 6) AS micro_f1,
    round(avg(f1), 6) AS macro_f1, round(avg(CASE WHEN exact_count THEN 1.0 ELSE 0.0 END), 6) AS exact_count_rate FROM s
""")
def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, hyp, sizes = _cuts(spark, sf_dir)
    scores = evaluate.boundary_scores(ref, hyp, sizes, ["conv_id"], "position").withColumn("f1", F.round("f1", 6))
    out = evaluate.corpus_summary(scores)
    return out.withColumns({c: F.round(c, 6) for c in ("micro_precision", "micro_recall", "micro_f1", "macro_f1", "exact_count_rate")})


def _tau_sql(rows: str) -> str:
    return f"""(SELECT g, band, pairs, CASE WHEN (pairs - tx) * (pairs - ty) > 0 THEN (c - d) / sqrt(CAST(pairs - tx AS DOUBLE) * (pairs - ty)) END AS tau FROM (
        SELECT a.g, a.band, count(*) AS pairs, count(*) FILTER (sign(a.x - b.x) * sign(a.y - b.y) > 0) AS c, count(*) FILTER (sign(a.x - b.x) * sign(a.y - b.y) < 0) AS d, count(*) FILTER (a.x = b.x) AS tx, count(*) FILTER (a.y = b.y) AS ty
        FROM {rows} a JOIN {rows} b ON a.g = b.g AND a.band = b.band AND a.id < b.id GROUP BY a.g, a.band))"""


@query(f"""
WITH p AS (SELECT l_orderkey AS g, l_returnflag AS band, l_suppkey AS x, l_partkey AS y, row_number() OVER w - 1 AS id, count(*) OVER (PARTITION BY l_orderkey, l_returnflag) AS n FROM lineitem WINDOW w AS (PARTITION BY l_orderkey, l_returnflag ORDER BY l_suppkey, l_partkey)),
m AS (SELECT p.g, p.band, p.x, o.y, p.id FROM p JOIN p o ON o.g = p.g AND o.band = p.band AND p.id = (o.id + o.n // 2) % o.n)
SELECT t.g AS l_orderkey, t.band AS l_returnflag, t.pairs, round(t.tau, 6) AS tau, round(u.tau, 6) AS control_tau FROM {_tau_sql("p")} t LEFT JOIN {_tau_sql("m")} u ON u.g = t.g AND u.band = t.band
""")
def order_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.order_agreement(_lines(spark, sf_dir), ["l_orderkey"], "l_returnflag", "l_suppkey", "l_partkey")
    return out.withColumns({c: F.round(c, 6) for c in ("tau", "control_tau")})


_PERSONS = "CASE c_custkey % 3 WHEN 0 THEN 'Mr. Pieter ende Jan' WHEN 1 THEN 'Anna; Maria' ELSE '' END || ' ENDE dr. ' || lower(c_mktsegment)"


@query(f"""
SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'pieter|jan|' WHEN 1 THEN 'anna|maria|' ELSE '' END || replace(replace(replace(lower(c_mktsegment), 'ch', 'g'), 'c', 'k'), 'y', 'ij') AS persons FROM customer
""")
def split_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(text.split_persons(F.expr(_PERSONS)), "|").alias("persons"))
