"""Normalisation, parsing and sources over the standard tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import fuzzy, text
from weftline.operators import classify, dictionary, keyword_index
from weftline.operators.ordered import shared_folder
from weftline.plans.base import query, table, tokens, tokens_sql
from weftline.sources import markup


@query("""
SELECT doc_id, md5(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS normal_md5,
       CAST(length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS BIGINT) AS normal_length
FROM documents
""")
def norm_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    normal = text.normalize_text("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(normal).alias("normal_md5"), F.length(normal).cast("long").alias("normal_length"))


_SPELL_STEPS = [("ae", "aa"), ("eij", "ij"), ("ey", "ij"), ("uij", "ui"), ("uy", "ui"), ("ckx", "ks"), ("cks", "ks"), ("x", "ks"), ("kk", "k"), ("ck", "k"), ("ngh", "ng"), ("gh", "g"), ("sch", "s\x01"), ("ch", "g"), ("s\x01", "sch"), ("c", "k"), ("ph", "f"), ("y", "ij")]


def _spell_sql(column: str) -> str:
    # long-s words don't occur in part names; the look-behind is spelt with a placeholder, which c -> k must not reach
    out = f"lower({column})"
    for a, b in _SPELL_STEPS:
        a, b = a.replace("\x01", "#"), b.replace("\x01", "#")
        if (a, b) == ("s#", "sch"):
            continue
        out = f"replace({out}, '{a}', '{b}')"
    return f"replace({out}, 's#', 'skh')"


@query(f"SELECT p_partkey, p_name, trim(regexp_replace({_spell_sql('p_name')}, '\\s+', ' ', 'g')) AS normal FROM part")
def norm_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", text.normalize_name("p_name").alias("normal"))


@query("""
SELECT c_custkey, 'N' || length(regexp_extract(c_name, '^[A-Za-z]+', 0)) || ' # D' || length(regexp_extract(c_name, '[0-9]+$', 0)) AS masked FROM customer
""")
def mask_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", text.mask_name("c_name").alias("masked"))


@query("""
SELECT doc_id, CAST(k AS BIGINT) AS line, part FROM (
    SELECT doc_id, generate_subscripts(parts, 1) - 1 AS k, unnest(parts) AS part
    FROM (SELECT doc_id, string_split_regex(text, '\\n|; ?|, ?') AS parts FROM documents)
) WHERE trim(part) <> ''
""")
def split_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n|; ?|, ?")).alias("line", "part"))
    return parts.where("trim(part) <> ''").select("doc_id", F.col("line").cast("long").alias("line"), "part")


@query("""
SELECT s_suppkey, CAST(regexp_extract(id, 'session-([0-9]+)', 1) AS INTEGER) AS inventory, CAST(regexp_extract(id, 'num-([0-9]+)', 1) AS INTEGER) AS num, CAST(regexp_extract(id, 'resolution-([0-9]+)', 1) AS INTEGER) AS resolution
FROM (SELECT s_suppkey, 'session-' || s_nationkey || '-num-' || s_suppkey || '-resolution-' || CAST(CAST(regexp_extract(s_name, '#0*([0-9]+)', 1) AS INTEGER) AS VARCHAR) AS id FROM supplier)
""")
def id_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.regexp_extract("s_name", "#0*([0-9]+)", 1).cast("int").cast("string")
    ident = F.concat(F.lit("session-"), F.col("s_nationkey").cast("string"), F.lit("-num-"), F.col("s_suppkey").cast("string"), F.lit("-resolution-"), number)
    parts = table(spark, sf_dir, "supplier").select("s_suppkey", text.session_parts(ident).alias("p"))
    return parts.select("s_suppkey", "p.inventory", "p.num", "p.resolution")


@query("""
SELECT o_orderkey, try_cast(raw AS DATE) AS day, CAST(date_diff('day', DATE '1997-01-01', try_cast(raw AS DATE)) AS BIGINT) AS days, CAST(year(try_cast(raw AS DATE)) AS INTEGER) AS year
FROM (SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN strftime(o_orderdate, '%Y') || '-02-29' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS raw FROM orders)
""")
def date_validate_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("-02-29"))).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    day = text.iso_date(raw)
    return table(spark, sf_dir, "orders").select("o_orderkey", day.alias("day"), F.datediff(day, F.lit("1997-01-01").cast("date")).cast("long").alias("days"), F.year(day).alias("year"))


@query("""
WITH w AS (SELECT doc_id, string_split(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), ' ') AS ws FROM documents),
p AS (SELECT doc_id, array_to_string(ws[1:n], ' ') AS phrase, n FROM w, (SELECT unnest([2, 3, 4, 5]) AS n) WHERE n <= len(ws))
SELECT phrase, CAST(n AS INTEGER) AS n_words, count(*) AS frequency FROM p GROUP BY phrase, n HAVING count(*) >= 5
""")
def opening_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrases = table(spark, sf_dir, "documents").select(F.explode(text.leading_phrases("text")).alias("phrase"))
    return phrases.groupBy("phrase").agg(F.count("*").alias("frequency")).where("frequency >= 5").select("phrase", F.size(F.split("phrase", " ")).alias("n_words"), "frequency")


@query("""
SELECT page_id, 'a' AS tag, trim(regexp_replace(regexp_replace(s, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS surface FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<a(?:\\s[^>]*)?>(.*?)</a>', 1)) AS s FROM pages)
UNION ALL
SELECT page_id, 'p', trim(regexp_replace(regexp_replace(s, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<p(?:\\s[^>]*)?>(.*?)</p>', 1)) AS s FROM pages)
""")
def markup_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.tag_texts(table(spark, sf_dir, "pages").select("page_id", "html"), "html", ["a", "p"]).select("page_id", "tag", "surface")


_CLASSES = [("GNU|General Public", "gpl"), ("Apache License", "apache"), ("CC BY", "creative_commons"), ("(?i)licen[sc]e", "licence"), ("\\|", "table"), ("[0-9]{3,}", "numbers")]


@query("SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{c}'" for p, c in _CLASSES) + " ELSE 'prose' END AS class FROM documents")
def rule_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", classify.rule_class(F.col("text"), _CLASSES, "prose").alias("class"))


_KWIC = """
WITH t AS (SELECT doc_id, generate_subscripts(ws, 1) - 1 AS pos, unnest(ws) AS token FROM (SELECT doc_id, string_split_regex(trim(text), '\\s+') AS ws FROM documents)),
c AS (SELECT doc_id, pos, token,
    coalesce(string_agg(token, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), '') AS left_context,
    coalesce(string_agg(token, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), '') AS right_context FROM t)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, token AS keyword, left_context, right_context FROM c WHERE regexp_matches(lower(token), '^licen')
"""


@query(_KWIC)
def kwic_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.kwic_texts(table(spark, sf_dir, "documents"), "doc_id", "text", lambda w: F.lower(w).rlike("^licen"))


@query()
def scan_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule matches with context, those within an earlier rule's match left out; offsets need a scanner, so there is no SQL."""
    return classify.scan_rules(table(spark, sf_dir, "documents"), "doc_id", "text", [("licensed under the [A-Z][A-Za-z]+ [A-Za-z]+", "named"), ("licen[sc]e[d]?", "licence")])


@query()
def proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.proximity_hits(table(spark, sf_dir, "documents"), "doc_id", "text", "licensed", "license", 60, 80)


@query()
def cascade_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names against the types of a small dictionary: store, rules, fuzzy words, other."""
    labels = table(spark, sf_dir, "part").select(F.col("p_name").alias("label"), F.col("p_type").alias("category")).groupBy("label").agg(F.min("category").alias("category"))
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return classify.cascade(rows, "p_name", labels, "label", "category", [("ring$", "ring"), ("^blue", "blue")])


@query("""
WITH names AS (SELECT DISTINCT p_name FROM part)
SELECT a.p_name AS name, b.p_name AS other, CAST(levenshtein(a.p_name, b.p_name) AS INTEGER) AS edits, round(1 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name)), 6) AS similarity
FROM names a, names b WHERE a.p_name < b.p_name AND split_part(a.p_name, ' ', 2) = split_part(b.p_name, ' ', 2)
""")
def name_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select("p_name").distinct().withColumn("last", F.element_at(F.split("p_name", " "), 2))
    a, b = names.select(F.col("p_name").alias("name"), "last"), names.select(F.col("p_name").alias("other"), "last")
    pairs = a.join(b, "last").where("name < other")
    return pairs.select("name", "other", F.levenshtein("name", "other").alias("edits"), F.round(fuzzy.levenshtein_similarity("name", "other"), 6).alias("similarity"))


@query(r"""
WITH items AS (SELECT item_id, string_split(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), ' ') AS ws FROM benchmark),
p AS (SELECT DISTINCT array_to_string(ws[i : i + 5], ' ') AS phrase, len(ws[i : i + 5]) AS k FROM (SELECT ws, unnest(range(1, len(ws) + 1, 6)) AS i FROM items) WHERE array_to_string(ws[i : i + 5], ' ') <> ''),
d AS (SELECT DISTINCT doc_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS t FROM documents),
w AS (SELECT doc_id, i, k, array_to_string(ws[i : i + k - 1], ' ') AS w, CASE WHEN i = 1 THEN 0 ELSE length(array_to_string(ws[1 : i - 1], ' ')) + 1 END AS a
      FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM (SELECT doc_id, string_split(t, ' ') AS ws FROM d WHERE t <> ''), (SELECT DISTINCT k FROM p)))
SELECT doc_id, phrase, CAST(i - 1 AS INTEGER) AS word_start, CAST(a AS INTEGER) AS start, CAST(a + length(w) AS INTEGER) AS "end", round(1 - levenshtein(w, phrase) / greatest(length(w), length(phrase)), 6) AS similarity
FROM w JOIN p USING (k) WHERE abs(length(w) - length(phrase)) <= 0.150000001 * greatest(length(w), length(phrase)) AND 1 - levenshtein(w, phrase) / greatest(length(w), length(phrase)) >= 0.85
""")
def phrase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where benchmark items, six words at a time, stand in documents, up to spelling."""
    words = F.split(text.normalize_text("text"), " ")
    sixes = F.transform(F.sequence(F.lit(1), F.size(words), F.lit(6)), lambda i: F.array_join(F.slice(words, i, 6), " "))
    phrases = table(spark, sf_dir, "benchmark").select(F.explode(sixes).alias("phrase"))
    hits = classify.phrase_hits(table(spark, sf_dir, "documents"), "doc_id", "text", phrases, "phrase")
    return hits.withColumn("similarity", F.round("similarity", 6))


#: DuckDB's levenshtein counts bytes: each character beyond ASCII becomes one that lower-case text hasn't.
_FOREIGN = "(SELECT string_agg(DISTINCT c, '') FROM (SELECT unnest(string_split(lower(text), '')) AS c FROM documents) WHERE c > '~')"
_STAND_INS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'"
_WORDS = "SELECT DISTINCT unnest(string_split_regex(lower(text), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS"


@query(f"""
WITH f AS MATERIALIZED (SELECT {_FOREIGN} AS f), a AS (SELECT token, translate(token, f, {_STAND_INS}) AS x FROM ({_WORDS} token FROM documents), f), b AS (SELECT name, translate(name, f, {_STAND_INS}) AS y FROM ({_WORDS} name FROM benchmark), f)
SELECT token, name, round(CASE WHEN token = '' THEN 1.0 ELSE 1 - levenshtein(x, y) / greatest(length(token), length(name)) END, 6) AS similarity FROM a, b
WHERE abs(length(token) - length(name)) <= 0.150000001 * greatest(length(token), length(name)) AND (token = name OR 1 - levenshtein(x, y) / greatest(length(token), length(name)) >= 0.85)
""")
def fuzzy_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents that are words of benchmark items up to spelling, of any length."""
    words = [tokens(table(spark, sf_dir, name), key, least=0).select(F.col("term").alias(c)) for name, key, c in (("documents", "doc_id", "token"), ("benchmark", "item_id", "name"))]
    return classify.fuzzy_tokens(*words, "token", "name").withColumn("similarity", F.round("similarity", 6))


def _lcs_sql(a: str, b: str) -> str:
    """Length of the longest common subsequence of two strings of at most 62 characters: one bit for each character of the first, one step for each of the second."""
    full = f"((1::HUGEINT << length({a})) - 1)"
    mask = f"list_sum(list_transform(range(1, length({a}) + 1), lambda i: CASE WHEN {a}[i] = c THEN 1::HUGEINT << (i - 1) ELSE 0::HUGEINT END))::HUGEINT"
    masks = f"list_transform(string_split({b}, ''), lambda c: {mask})"
    return f"(length({a}) - bit_count(list_reduce({masks}, lambda row, m: ((row + (row & m)) | (row - (row & m))) & {full}, {full})))"


@query(f"""
WITH a AS ({_WORDS} form FROM benchmark), b AS (SELECT DISTINCT label FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS label FROM part UNION {_WORDS} label FROM conversations)),
p AS (SELECT form, label, length(form) + length(label) AS n FROM a, b WHERE form <> '' AND label <> ''),
s AS (SELECT form, label, 200.0 * {_lcs_sql("form", "label")} / n AS s FROM p WHERE least(length(form), length(label)) >= 0.35 * n)
SELECT form, label, round(s, 6) AS fuzzy_score FROM s WHERE s >= 70 QUALIFY row_number() OVER (PARTITION BY form ORDER BY s DESC, label) = 1
""")
def fuzzy_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each word of benchmark items the word of conversations and part names that is most alike, by the ratio of what both have in common."""
    forms = tokens(table(spark, sf_dir, "benchmark"), "item_id", least=0).select(F.col("term").alias("form"))
    said = tokens(table(spark, sf_dir, "conversations"), "conv_id", least=0).select(F.col("term").alias("label"))
    labels = said.unionByName(table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("label")))
    return classify.fuzzy_class(forms, labels, "form", "label").withColumn("fuzzy_score", F.round("fuzzy_score", 6))


@query("""
WITH p AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS f, split_part(p_name, ' ', 2) AS g FROM part),
o AS (SELECT *, replace(replace(replace(replace(replace(replace(g, 'ij', 'y'), 'ck', 'k'), 'ae', 'a'), 'oe', 'u'), 'th', 't'), 'ou', 'u') AS old FROM p),
v AS (SELECT p_partkey, unnest([
        {'label': 'drop_voornaam', 'band': 'near_canonical', 'q': 'van ' || g}, {'label': 'drop_voornaam_and_tv', 'band': 'moderate', 'q': g},
        {'label': 'initial_surname', 'band': 'moderate', 'q': f[1] || '. ' || g}, {'label': 'drop_tv', 'band': 'moderate', 'q': f || ' ' || g},
        {'label': 'historical_spelling', 'band': 'distant', 'q': 'van ' || old}, {'label': 'historical_bare_surname', 'band': 'outlier', 'q': old}], recursive := true) FROM o)
SELECT p_partkey, label, band, """ + _spell_sql("q") + """ AS query FROM v
""")
def name_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.split("p_name", " ")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.explode(text.variants(F.element_at(parts, 1), F.lit("van"), F.element_at(parts, 2))).alias("v"))
    return rows.select("p_partkey", "v.label", "v.band", "v.query")


@query()
def divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").groupBy("p_type").agg(F.array_join(F.array_sort(F.collect_set("p_name")), ";").alias("forms"))
    rows = table(spark, sf_dir, "part").select("p_name", "p_type").distinct().withColumn("variant", F.concat(F.lit("old "), F.col("p_name"))).join(names, "p_type")
    d = rows.withColumn("divergence", fuzzy.pairwise(fuzzy.divergence, "variant", "forms"))
    return d.select("p_name", "p_type", "divergence", fuzzy.divergence_band("divergence").alias("band"))


#: Words of six letters or more of the benchmark, as names to look for.
_NAMES = "(SELECT DISTINCT term AS name FROM " + tokens_sql("benchmark", "item_id", 6) + ")"


@query(f"""
SELECT name, count(DISTINCT doc_id) AS n_docs, min(doc_id) AS first_doc FROM {_NAMES} n JOIN documents d ON contains(lower(d.text), name) GROUP BY name
""")
def names_in_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's words wherever they stand in documents, within words, too."""
    names = tokens(table(spark, sf_dir, "benchmark"), "item_id", least=6).select("term").distinct()
    held = dictionary.held_names(table(spark, sf_dir, "documents").select("doc_id", "text"), F.lower("text"), names, "term", into="name")
    return held.groupBy("name").agg(F.count_distinct("doc_id").alias("n_docs"), F.min("doc_id").alias("first_doc"))


@query()
def confirmed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three words of each benchmark item, sought up to spelling in the documents that share a word of twelve letters or more with it."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    shortlist = tokens(docs, "doc_id", least=12).join(tokens(items, "item_id", least=12), "term")
    names = items.select("item_id", F.substring_index("text", " ", 3).alias("name"))
    out = dictionary.confirm_names(shortlist, docs, names, "doc_id", "text", "item_id", "name", threshold=75)
    return out.withColumn("match_score", F.round("match_score", 6))


def _index(spark: SparkSession, sf_dir: str) -> str:
    """Where documents were just indexed."""
    path = f"{shared_folder(spark)}/keywords-{uuid.uuid4().hex}"
    keyword_index.add_texts(table(spark, sf_dir, "documents"), "doc_id", "text", path)
    return path


@query(_KWIC)
def kwic_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As kwic_context, from an index of keywords: the vocabulary says which terms are meant, their folders where they stand."""
    path = _index(spark, sf_dir)
    terms = keyword_index.vocabulary(spark, path).where("term LIKE 'licen%'")
    return keyword_index.in_context(keyword_index.find(spark, path, terms), table(spark, sf_dir, "documents"), "doc_id", "text")


@query("""
WITH w AS (SELECT doc_id, lower(unnest(string_split_regex(trim(text), '\\s+'))) AS term FROM documents), v AS (SELECT DISTINCT term FROM w WHERE term <> ''),
n AS (SELECT unnest(['license', 'copyright', 'password']) AS needle), a AS (SELECT needle, term, 1 - levenshtein(needle, term) / greatest(length(needle), length(term)) AS s FROM n, v WHERE 1 - levenshtein(needle, term) / greatest(length(needle), length(term)) >= 0.7)
SELECT needle, term, round(s, 6) AS similarity, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM a JOIN w USING (term) GROUP BY ALL
""")
def kwic_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of terms up to spelling, from the index."""
    needles = spark.createDataFrame([(w,) for w in ("license", "copyright", "password")], "needle string")
    hits = keyword_index.find_similar(spark, _index(spark, sf_dir), needles, "needle", 0.7)
    return hits.groupBy("needle", "term", F.round("similarity", 6).alias("similarity")).agg(F.count("*").alias("n"), F.count_distinct("doc").alias("n_docs"))


@query("""
WITH w AS (SELECT lower(unnest(string_split_regex(trim(text), '\\s+'))) AS term FROM documents), c AS (SELECT CASE WHEN term LIKE 'licen%' THEN 'licence' WHEN term LIKE 'copy%' THEN 'copyright' WHEN regexp_matches(term, '^[0-9]+[.,]?$') THEN 'number' ELSE 'other' END AS category FROM w WHERE term <> '')
SELECT category, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, category <> 'other' AS classified FROM c GROUP BY category
""")
def keyword_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of all words the classes of keywords cover, by the index's vocabulary."""
    term = F.col("term")
    category = F.when(term.like("licen%"), "licence").when(term.like("copy%"), "copyright").when(term.rlike("^[0-9]+[.,]?$"), "number").otherwise("other")
    words = keyword_index.vocabulary(spark, _index(spark, sf_dir)).withColumn("category", category)
    return keyword_index.coverage_report(words, weight="n").withColumn("share", F.round("share", 6))
