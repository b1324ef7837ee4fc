"""The inverted index of segments and rare characters: no pair at or above the threshold is lost, whatever the edits."""

import random

import pytest

from weftline.functions.fuzzy import token_set_ratio
from weftline.operators import classify, fuzzy_index


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def _alike(a, b):
    return 1.0 if a == b else 1 - _edits(a, b) / max(len(a), len(b))


def _changed(rng, s, letters):
    for _ in range(rng.randint(0, 3)):
        k = rng.choice([0, 0, len(s), rng.randint(0, len(s))])  # often at an end
        s = rng.choice([s[:k] + rng.choice(letters) + s[k:], s[: max(0, k - 1)] + s[k:], s[:k] + rng.choice(letters) + s[k + 1 :]])
    return s


@pytest.mark.parametrize("threshold", [0.6, 0.8, 0.85, 1.0])
def test_no_similar_pair_is_lost(spark, threshold):
    rng = random.Random(int(threshold * 100))
    letters = "abcdé😀"
    names = ["", "a", "ab", "xxabcdefghij", *["".join(rng.choice(letters) for _ in range(rng.randint(1, 22))) for _ in range(60)]]
    words = [*names[:20], "abcdefghij", "ba", *[_changed(rng, rng.choice(names), letters) for _ in range(120)]]
    left, right = (spark.createDataFrame([(x,) for x in [*rows, *rows[:3], None]], f"{c} string") for rows, c in ((words, "token"), (names, "name")))
    got = {(r.token, r.name): r.similarity for r in classify.fuzzy_tokens(left, right, "token", "name", threshold).collect()}
    want = {(a, b): _alike(a, b) for a in set(words) for b in set(names) if _alike(a, b) >= threshold}
    assert got == pytest.approx(want) and len(want) > 20


def test_pairs_that_were_lost_before(spark):
    one = lambda x, c: spark.createDataFrame([(x,)], f"{c} string")
    assert classify.fuzzy_tokens(one("xxabcdefghij", "t"), one("abcdefghij", "n"), "t", "n", 0.8).count() == 1
    assert classify.fuzzy_class(one("kolland", "f"), one("holland", "l"), "f", "l").first().fuzzy_score == pytest.approx(100 * 12 / 14)
    assert [(r.word_start, r.start, r.end) for r in classify.phrase_hits(spark.createDataFrame([(1, "  de  Kolland ")], "k int, t string"), "k", "t", one("holland", "p"), "p").collect()] == [(1, 3, 10)]


@pytest.mark.parametrize("threshold", [40, 70, 95, 100])
def test_no_pair_by_token_set_ratio_is_lost(spark, threshold):
    rng = random.Random(threshold)
    make = lambda: " ".join("".join(rng.choice("abcde") for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(1, 4)))
    labels = ["a", "kolland", *[make() for _ in range(50)]]
    forms = ["holland", "  ", "", *[_changed(rng, rng.choice(labels), "abcde ") for _ in range(50)], *[" ".join(sorted(rng.choice(labels).split())) for _ in range(10)]]
    left, right = (spark.createDataFrame([(x,) for x in [*rows, None]], f"{c} string") for rows, c in ((forms, "f"), (labels, "l")))
    got = {(r.f, r.l): r.fuzzy_score for r in fuzzy_index.token_set_pairs(left, right, "f", "l", threshold).collect()}
    want = {(a, b): token_set_ratio(a, b) for a in set(forms) for b in set(labels) if token_set_ratio(a, b) >= threshold}
    assert got == pytest.approx(want) and want


def test_few_phrases_make_no_row_of_a_character(spark, monkeypatch):
    rng = random.Random(3)
    words = ["de", "raad", "van", "state", "é😀", "a", "geresolveert"]
    texts = spark.createDataFrame([(k, " ".join(rng.choice(words) for _ in range(60))) for k in range(20)], "k int, t string")
    phrases = spark.createDataFrame([(" ".join(rng.choice(words) for _ in range(rng.randint(1, 6))),) for _ in range(20)], "p string")
    read = lambda: classify.phrase_hits(texts, "k", "t", phrases, "p")
    few = read()
    assert few._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
    monkeypatch.setattr(fuzzy_index, "FEW_PHRASES", 0)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, read().collect())) and not few.isEmpty()


@pytest.mark.parametrize("threshold", [0.7, 0.85])
def test_no_phrase_is_lost_and_places_are_right(spark, threshold):
    rng = random.Random(int(threshold * 100))
    words = ["de", "raad", "van", "state", "holland", "é😀", "a", "geresolveert"]
    phrases = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 6))) for _ in range(25)]
    texts = [" ".join([rng.choice(words), _changed(rng, rng.choice(phrases), "aeé"), rng.choice(words), *[rng.choice(words) for _ in range(rng.randint(0, 40))]]) for _ in range(40)]
    rows = [*enumerate(texts), (7, texts[7]), (98, ""), (99, None)]
    got = classify.phrase_hits(spark.createDataFrame(rows, "k int, t string"), "k", "t", spark.createDataFrame([(p,) for p in [*phrases, "", None]], "p string"), "p", threshold).collect()
    want = set()
    for k, t in enumerate(texts):
        own = t.lower().split()
        for p in set(phrases):
            n = len(p.split())
            for i in range(len(own) - n + 1):
                w = " ".join(own[i : i + n])
                if _alike(w, p) >= threshold:
                    want.add((k, p, i, len(" ".join(own[:i])) + (i > 0), len(" ".join(own[: i + n]))))
    assert {(r.k, r.phrase, r.word_start, r.start, r.end) for r in got} == want and len(got) == len(want) > 40


def test_nothing_is_like_nothing(spark):
    none = lambda c: spark.createDataFrame([], f"{c} string")
    assert classify.fuzzy_tokens(none("a"), none("b"), "a", "b").isEmpty() and classify.fuzzy_class(none("a"), none("b"), "a", "b").isEmpty()
    assert classify.phrase_hits(spark.createDataFrame([(1, "x")], "k int, t string"), "k", "t", none("p"), "p").isEmpty()
    with pytest.raises(ValueError):
        fuzzy_index.similar_pairs(none("a"), none("b"), "a", "b", 0.5)
