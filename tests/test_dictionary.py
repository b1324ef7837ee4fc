"""Names in texts: both ways against all pairs, and the partial ratio against all windows."""

import random
import re

import pytest

from weftline.functions import fuzzy
from weftline.operators import dictionary, joins
from weftline.plans import registry


def _strings(rng, n, low, high, letters="abc \U0001f600"):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(low, high))) for _ in range(n)]


@pytest.mark.parametrize("small", [(dictionary.SMALL_NAMES, dictionary.SMALL_CHARS), (0, 0)], ids=["to all tasks", "dealt out"])
def test_held_names_are_those_of_all_pairs(spark, small):
    rng = random.Random(3)
    texts = [*_strings(rng, 60, 0, 60), "", None, "abc" * 3000]
    texts += texts[:5]
    names = [*_strings(rng, 50, 1, 12), "a", "abcabcabca", "zzz", "", None, "a"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(4)
    got = sorted((r.id, r._needle) for r in dictionary.held_names(rows, "text", spark.createDataFrame([(n,) for n in names], "n string"), "n", small=small).collect())
    assert got == sorted((k, n) for k, t in enumerate(texts) for n in {x for x in names if x} if n in (t or ""))
    assert dictionary.held_names(rows, "text", spark.createDataFrame([], "n string"), "n", small=small).isEmpty()
    assert dictionary.held_names(rows.limit(0), "text", spark.createDataFrame([("a",)], "n string"), "n", small=small).isEmpty()


def test_no_join_without_keys(spark):
    rows = spark.createDataFrame([(k, f"x{k} y", k % 2) for k in range(5)], "id int, t string, b int").repartition(2)
    for out in (joins.contained_names(rows, rows.selectExpr("b", "t AS name"), ["b"], "t"), dictionary.held_names(rows, "t", rows, "t", small=(0, 0))):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_blocks_keep_names_apart(spark):
    texts = spark.createDataFrame([(1, "De  Raad van State"), (2, "de raad"), (None, "de raad")], "b int, text string")
    names = spark.createDataFrame([(1, "de raad", 7), (1, "DE RAAD", 8), (2, "state", 9), (1, "st", 10), (None, "raad", 11)], "b int, name string, k int")
    assert sorted((r.b, r.k) for r in joins.contained_names(texts, names, ["b"]).collect()) == [(1, 7), (1, 8)]


def _partial(a, b):
    a, b = sorted((a, b), key=len)
    if not a:
        return 0.0 if b else 100.0
    return max(fuzzy.ratio(a, b[max(0, i) : i + len(a)]) for i in range(1 - len(a), len(b)))


def test_partial_ratio_is_that_of_all_windows():
    rng = random.Random(5)
    for _ in range(500):
        a, b = _strings(rng, 2, 0, rng.choice((4, 12, 40)), "abcd")
        best = _partial(a, b)
        assert fuzzy.partial_ratio(a, b) == best
        for least in (50, 85, 100):
            assert fuzzy.partial_ratio(a, b, least) == (best if best >= least else 0.0)


def test_confirmed_names(spark):
    texts = spark.createDataFrame([(1, "De heer van Carlile, tot Utrecht"), (2, ""), (3, None), (1, "De heer van Carlile, tot Utrecht")], "t int, x string")
    names = spark.createDataFrame([(10, "UTRECHT"), (11, "Carlisle"), (12, "Amsterdam"), (13, None), (14, "")], "n int, name string")
    every = spark.createDataFrame([(t, n) for t in (1, 2, 3, 4, None) for n in (10, 11, 12, 13, 14, 15, None)] * 2, "t int, n int")
    got = {(r.t, r.n): (r.match_method, r.match_score) for r in dictionary.confirm_names(every, texts, names, "t", "x", "n", "name").collect()}
    assert got == {(1, 10): ("exact", 100.0), (1, 11): ("fuzzy", pytest.approx(_partial("carlisle", "de heer van carlile, tot utrecht")))}


def test_confirmed_names_query_is_that_of_all_windows(spark):
    smoke = "/root/testdata/sf0.001"
    got = {(r.doc_id, r.item_id): r for r in registry.QUERIES["confirmed_names"](spark, smoke).collect()}
    docs, items = ({r[0]: r.text.lower() for r in spark.read.parquet(f"{smoke}/{t}.parquet").select(k, "text").collect() if r.text} for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    words = [{k: {w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", t) if len(w) >= 12} for k, t in side.items()} for side in (docs, items)]
    want = {}
    for d, text in docs.items():
        for i, item in items.items():
            if words[0][d] & words[1][i] and (score := fuzzy.partial_ratio(" ".join(item.split(" ")[:3]), text)) >= 75:
                want[d, i] = pytest.approx(score, abs=1e-6)
    assert {k: r.match_score for k, r in got.items()} == want and want
