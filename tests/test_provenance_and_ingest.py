"""Provenance in footers, and appends and streams that keep each key once."""

import json
import warnings

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from weftline.sources import catalog
from weftline.streaming import incremental


def test_provenance_is_in_the_footer_and_beside(spark, tmp_path):
    out = str(tmp_path / "t.parquet")
    rows = spark.range(7).select("id", F.lit("x").alias("a.b`c"), F.col("id").alias("kept", metadata={"unit": "m"}))
    catalog.write(rows, out, script="s", phase=None, parent="p")
    read = catalog.read(spark, out)
    for df in (read, read.select("kept")):
        record = catalog.provenance(df)
        assert record["script"] == "s" and record["parent"] == "p" and "phase" not in record and record["columns"] == ["id", "a.b`c", "kept"]
    assert read.schema["kept"].metadata["unit"] == "m"
    beside = json.loads(spark.read.text(out + catalog.BESIDE).first().value)
    assert beside["rows"] == 7 and beside["script"] == "s"
    part = next((tmp_path / "t.parquet").glob("part-*.parquet"))
    fields = json.loads(pq.read_schema(part).metadata[b"org.apache.spark.sql.parquet.row.metadata"])["fields"]
    assert all(json.loads(f["metadata"][catalog.PROVENANCE])["script"] == "s" for f in fields)


def test_what_is_made_from_a_table_doesnt_carry_its_provenance(spark, tmp_path):
    first, second, third = (str(tmp_path / f"{k}.parquet") for k in range(3))
    catalog.write(spark.range(3), first, script="one")
    catalog.write(catalog.read(spark, first), second, script="two")
    catalog.write(catalog.read(spark, first), third)
    assert catalog.provenance(catalog.read(spark, second))["script"] == "two"
    assert catalog.provenance(catalog.read(spark, third)) is None


def test_a_footer_without_a_record_beside_it_warns(spark, tmp_path):
    out, moved = str(tmp_path / "t.parquet"), tmp_path / "moved.parquet"
    catalog.write(spark.range(3), out, script="one")
    (tmp_path / "t.parquet").rename(moved)
    with pytest.warns(UserWarning, match="none beside"):
        catalog.read(spark, str(moved))
    catalog.write(spark.range(3), out)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        catalog.read(spark, out)


def test_the_manifest_says_what_it_knows(spark, tmp_path):
    manifest = tmp_path / "m.toml"
    manifest.write_text(f'[tiers.a]\nroot = "{tmp_path}"\n[datasets.x]\ntier = "a"\npath = "x.parquet"\nphase = "frozen"\nparent = "raw"\n')
    c = catalog.Catalog.load(spark, str(manifest), env={})
    c.write(spark.range(0), "x", parent="other", description="given")
    record = catalog.provenance(c.read("x"))
    assert (record["name"], record["phase"], record["parent"], record["description"]) == ("x", "frozen", "raw", "given")


def test_appends_of_known_keys_alone_and_of_none(spark, tmp_path):
    out = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert [catalog.append_new(df, out, ["k"]) for df in (rows, rows, rows.limit(0))] == [2, 0, 0]
    assert spark.read.parquet(out).count() == 2


def _more(spark, path, rows):
    spark.createDataFrame(rows, "k int, ts timestamp").coalesce(1).write.mode("append").parquet(path)


def _at(hour):
    return __import__("datetime").datetime(2024, 1, 1 + hour // 24, hour % 24)


def test_a_stream_knows_its_keys_without_the_table(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    _more(spark, src, [(k, _at(0)) for k in range(100)])
    schema = spark.read.parquet(src).schema
    run = lambda: incremental.ingest(incremental.read_stream(spark, src, schema), out, cp, ["k"], lambda s: s.where("k <> 7"))
    query = run()
    query.awaitTermination()
    assert spark.read.parquet(out).count() == 99
    # what is there is moved away: it isn't read
    (tmp_path / "out").rename(tmp_path / "moved")
    _more(spark, src, [(99, _at(1)), (100, _at(1)), (100, _at(1)), (7, _at(1))])
    query = run()
    query.awaitTermination()
    assert [r.k for r in spark.read.parquet(out).collect()] == [100]
    assert query.recentProgress[0]["numInputRows"] == 4 and query.recentProgress[0]["stateOperators"][0]["numRowsTotal"] == 100


def test_a_repeated_batch_overwrites_itself(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    _more(spark, src, [(1, _at(0)), (2, _at(0))])
    schema = spark.read.parquet(src).schema
    run = lambda: incremental.ingest(incremental.read_stream(spark, src, schema), out, cp, ["k"]).awaitTermination()
    run()
    # as if the driver had been lost after the batch's rows were written, and before it was noted as done
    for f in (tmp_path / "cp" / "commits").iterdir():
        f.unlink()
    _more(spark, src, [(2, _at(1)), (3, _at(1))])
    run()
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_state_forgets_keys_older_than_the_delay(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    _more(spark, src, [(1, _at(0)), (1, _at(0)), (2, _at(30))])
    schema = spark.read.parquet(src).schema
    run = lambda: incremental.ingest(incremental.read_stream(spark, src, schema), out, cp, ["k"], within=("ts", "2 hours")).awaitTermination()
    run()
    _more(spark, src, [(2, _at(31)), (1, _at(40))])
    run()
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == [1, 1, 2]
