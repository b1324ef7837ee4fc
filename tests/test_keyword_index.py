"""The index of keywords against a scan, as it grows."""

import pytest
from pyspark.sql import functions as F

from weftline.operators import classify, keyword_index


def test_the_index_grows_by_documents_and_agrees_with_a_scan(spark, tmp_path):
    path = str(tmp_path / "index")
    texts = [(1, "De raad  van\nState"), (2, ""), (3, None), (4, " raad "), (None, "raad"), (5, "Raed en RAAD, " + "x " * 5000 + "raad")]
    rows = spark.createDataFrame(texts, "k int, t string")
    with pytest.raises(keyword_index.NoIndex):
        keyword_index.read(spark, path)
    assert keyword_index.add_texts(rows.where("k < 4"), "k", "t", path) == 4 + 3
    assert keyword_index.add_texts(rows, "k", "t", path) == 1 + 1 + 5004 + 1
    assert keyword_index.add_texts(rows, "k", "t", path) == 0 and keyword_index.add_texts(rows.limit(0), "k", "t", path) == 0
    hits = keyword_index.find(spark, path, ["RAAD", "nowhere"])
    assert sorted((r.term, r.doc, r.pos) for r in hits.collect()) == [("raad", 1, 1), ("raad", 4, 0), ("raad", 5, 5003)]
    scan = classify.kwic_texts(rows.where("k is not null"), "k", "t", lambda w: F.lower(w) == "raad", 2)
    both = [sorted(map(tuple, x.collect())) for x in (scan, keyword_index.in_context(hits, rows, "k", "t", 2))]
    assert both[0] == both[1] and len(both[0]) == 3
    table = keyword_index.find(spark, path, spark.createDataFrame([("raad",), ("Raad",), (None,)], "term string"))
    assert sorted(map(tuple, table.collect())) == sorted(map(tuple, hits.collect()))
    words = {r.term: (r.n, r.n_docs) for r in keyword_index.vocabulary(spark, path).collect()}
    assert words == {"de": (1, 1), "raad": (3, 3), "van": (1, 1), "state": (1, 1), "raed": (1, 1), "en": (1, 1), "raad,": (1, 1), "x": (5000, 1)}
    near = keyword_index.find_similar(spark, path, spark.createDataFrame([("Raad",)], "q string"), "q", 0.75)
    assert sorted((r.q, r.term, r.doc, r.pos) for r in near.collect()) == [("raad", "raad", 1, 1), ("raad", "raad", 4, 0), ("raad", "raad", 5, 5003), ("raad", "raad,", 5, 2), ("raad", "raed", 5, 0)]


def test_a_search_reads_its_folder_alone(spark, tmp_path):
    path = str(tmp_path / "index")
    keyword_index.add_texts(spark.range(50).select("id", F.concat(F.lit("w"), F.col("id").cast("string")).alias("t")), "id", "t", path)
    out = keyword_index.find(spark, path, ["w7"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_bucket" in plan and "EqualTo(term,w7)" in plan
    assert len(out.inputFiles()) == 1 or len(set(spark.read.parquet(path).where(F.col("term") == "w7").select("_bucket").collect())) == 1


def test_reports(spark):
    rows = spark.createDataFrame([("a", 2), ("other", 5), (None, 1)], "category string, n int")
    assert sorted(map(tuple, keyword_index.coverage_report(rows, weight="n").collect())) == [("a", 2, 0.25, True), ("other", 6, 0.75, False)]
    assert sorted(map(tuple, keyword_index.coverage_report(rows).select("category", "n").collect())) == [("a", 1), ("other", 2)]
    assert keyword_index.coverage_report(rows.limit(0)).isEmpty()
    hits = spark.createDataFrame([(2, "Raad", "de", ""), (1, "raad", "De", ""), (3, "raad", "het", "")], "k int, keyword string, left_context string, right_context string")
    assert sorted(map(tuple, keyword_index.distinct_contexts(hits, "k").collect())) == [("raad", "de", "", 2, 1), ("raad", "het", "", 1, 3)]
