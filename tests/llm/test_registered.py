"""The registered queries of the subpackage: against their SQL twins, or for whole results."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tests.compare import difference
from weftline.llm import queries

SMOKE = __spark_entry__.SMOKE


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_agrees_with_sql(spark, name):
    assert difference(queries.QUERIES[name](spark, SMOKE), queries.ORACLES[name], SMOKE) == ""


@pytest.mark.parametrize("name", ["op1_sentencepiece", "op4_toxicity", "op6_secret_scan", "op9_sharding"])
def test_query_has_a_row_for_each_document(spark, name):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet").select("doc_id")
    found = queries.QUERIES[name](spark, SMOKE).select("doc_id")
    assert found.count() == docs.count() and found.exceptAll(docs).isEmpty()


def test_packing_query_covers_every_document(spark):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet").select("doc_id")
    pieces = queries.QUERIES["op7_packing"](spark, SMOKE).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("whole"))
    assert pieces.where("n <> whole").isEmpty() and pieces.count() == docs.count()
