"""Partial matching, source divergence and weighted clustering: against plain Python, and at their edges."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from weftline.llm import centroids, ppm, source_audit

DOCS = "doc_id long, text string, lang string, source string"


def _lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def _log_probability(text, counts):
    """Coded symbol by symbol: counts has for each context a Counter of what followed."""
    coded = [*_lower(text).encode(), "end"]
    out = 0.0
    for i, symbol in enumerate(coded):
        before = tuple((["edge"] * ppm.ORDER + coded[:i])[-ppm.ORDER :])
        ruled_out = set()
        for order in range(ppm.ORDER, -1, -1):
            left = {x: n for x, n in counts[before[ppm.ORDER - order :]].items() if x not in ruled_out}
            total = sum(left.values())
            if symbol in left:
                out += math.log10((2 * left[symbol] - 1) / (2 * total))
                break
            if left:
                out += math.log10(len(left) / (2 * total))
            ruled_out |= set(left)
        else:
            out -= math.log10(257 - len(ruled_out))
    return out


def _plain_scores(rows):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts, words = defaultdict(Counter), Counter()
    for i, text in rows:
        if held(i):
            continue
        coded = [*_lower(text).encode(), "end"]
        for k, symbol in enumerate(coded):
            before = (["edge"] * ppm.ORDER + coded[:k])[-ppm.ORDER :]
            for order in range(ppm.ORDER + 1):
                counts[tuple(before[ppm.ORDER - order :])][symbol] += 1
        words.update([*re.findall("[^\x20\x09-\x0d]+", _lower(text)), None])
    total, kinds = sum(words.values()), len(words)
    out = []
    for i, text in rows:
        own = [*re.findall("[^\x20\x09-\x0d]+", _lower(text)), None]
        base = sum(math.log10((words[w] + 1) / (total + kinds + 1)) for w in own)
        out.append((i, held(i), len(own), sum(words[w] > 0 for w in own), total, base, _log_probability(text, counts)))
    return out


def _same_scores(got, rows):
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], r[6])
    got, want = sorted(map(tuple, got), key=key), sorted(_plain_scores(rows), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=1e-8) and a[6] == pytest.approx(b[6], abs=1e-8)


TEXTS = ["The cat sat on the mat", "the CAT  sat\ton the hat\n", "", None, "Ünïcödé 猫が座る 😺", " ", "abracadabra " * 40, "zq", "the cat sat on the mat", "\x1c odd\x0b spaces ", "x" * 500]


def test_scores_are_those_of_coding_symbol_by_symbol(spark):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(33)] + [(None, "the null cat"), (5, "again"), (5, "again")]
    got = ppm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert any(r.held_out for r in got)
    _same_scores(got, rows)


def test_scores_do_not_depend_on_blocks_pieces_or_merging(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i * j) % 17}" for j in range(60))) for i in range(40)]
    monkeypatch.setattr(ppm, "BLOCK", 256)
    _same_scores(ppm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect(), rows)
    whole = list(ppm.grams_of(*_bytes(["abc", "", "defghij"])))
    monkeypatch.setattr(ppm, "PIECE", 4)
    parts = list(ppm.grams_of(*_bytes(["abc", "", "defghij"])))
    assert len(parts) > 1 and np.array_equal(np.concatenate([p[0] for p in parts]), whole[0][0])
    assert [t for p in parts for t in np.repeat(p[1], np.diff(np.append(p[2], len(p[0]))))] == [0] * 4 + [1] + [2] * 8


def _bytes(texts):
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    return data, np.cumsum([0, *map(len, texts)])


def test_probabilities_of_what_may_follow_add_up_to_one_at_most():
    grams = np.concatenate([g for g, _, _ in ppm.grams_of(*_bytes(["abracadabra", "abra", "cad"]))])
    keys, n = ppm.summed(grams, np.ones(len(grams), dtype=np.int64))
    few = ppm.levels(*ppm.summed(ppm.low(keys, ppm.STEM - 1), n), ppm.STEM - 1, 0)
    trie = [*few, *ppm.levels(keys, n, ppm.ORDER, ppm.STEM, few[-1])]
    for context in {int(g) >> 8 for g in keys} | {0x6162, 0xFFFFFFFFFF}:
        total = (10 ** ppm.costs(np.array([context << 8 | b for b in range(256)], dtype=np.uint64), trie)).sum()
        assert 0.97 < total <= 1 + 1e-12  # the 257th symbol never comes


def test_scores_of_nothing_and_with_clashing_names(spark):
    assert ppm.score(spark.createDataFrame([], "doc_id long, text string")).isEmpty()
    clashing = spark.createDataFrame([(1, "a b", "x", 2, 3.0, "t")], "doc_id long, text string, TEXT string, block long, score double, held_out string")
    _same_scores(ppm.score(clashing).collect(), [(1, "a b")])
    only_held = ppm.score(spark.createDataFrame([(1, "ab", True)], "doc_id long, text string, test boolean"), held_out_column="test").first()
    assert (only_held.n_known, only_held.train_tokens) == (0, 0)
    assert only_held.score == pytest.approx(-3 * math.log10(257)) and only_held.base_score == 0.0


def _plain_audit(rows):
    rows = [(t or "", g or "", s or "") for t, g, s in rows]
    terms = [re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", _lower(t)) for t, _, _ in rows]
    out = []
    for lang in {g for _, g, _ in rows}:
        mine = [(x, s) for x, (_, g, s) in zip(terms, rows, strict=True) if g == lang]
        documents = Counter(t for x, _ in mine for t in set(x))
        kept = {t for t, n in documents.items() if n >= source_audit.LEAST}
        groups = {s: Counter() for _, s in mine}
        for x, s in mine:
            groups[s].update(t for t in x if t in kept)

        def shares(c, kept=kept):
            return {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}

        p = {s: shares(c) for s, c in groups.items()}
        q = shares(sum(groups.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in groups:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in groups if o != s]
            top = [(t, f(p[s][t], q[t])) for t in kept if groups[s][t] > 0 and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", top, source_audit.TOP)):
                ordered = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ordered)]
    return out


def test_audit_is_that_of_plain_counting(spark):
    words = ["Alpha", "beta", "gamma9", "Ünter", "émile", "猫", "don't", "x_y", "𝔘𝔫𝔦", "İstanbul", "rare"]
    rows = []
    for i in range(120):
        text = " ".join(words[(i * k + k * k) % (5 + i % 7)] for k in range(i % 9))
        rows.append((None if i % 31 == 0 else text, [None, "", "de", "fr"][i % 4], [None, "a", "b", "hot", "hot", "hot", ""][i % 7]))
    rows += [("lonely words here", "it", "only"), (None, "es", "s1"), ("", "es", "s2")]
    got = source_audit.audit(spark.createDataFrame(rows, "text string, lang string, source string"))
    assert sorted(map(tuple, got.collect())) == sorted(_plain_audit(rows))
    assert dict(got.dtypes)["value"] == "bigint" and dict(got.dtypes)["rank"] == "int"


def test_audit_of_nothing_and_with_clashing_names(spark):
    assert source_audit.audit(spark.createDataFrame([], "text string, lang string, source string")).isEmpty()
    rows = [("a b", "x", "s", 1, "n", 2)] * 12 + [("a c", "x", "t", 1, "n", 2)] * 12
    got = source_audit.audit(spark.createDataFrame(rows, "text string, lang string, source string, n int, TEXT string, term int"))
    assert sorted(map(tuple, got.collect())) == sorted(_plain_audit([r[:3] for r in rows]))


def test_audit_reads_each_text_once(spark):
    read = spark.sparkContext.accumulator(0)

    def through(text):
        read.add(1)
        return text

    rows = [(f"alpha beta w{'xyz'[i % 3]}", "de", "ab"[i % 2]) for i in range(60)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").withColumn("text", F.udf(through)("text"))
    assert sorted(map(tuple, source_audit.audit(docs).collect())) == sorted(_plain_audit(rows))
    assert read.value == len(rows)


def test_terms_are_counted_alike_in_chunks_of_any_size(monkeypatch):
    monkeypatch.setattr(source_audit, "BATCH", 3)
    texts = ["", "a", "Ab9ab", "b\x00É猫", "猫 𝔘Z", "  ", "ab", "ab AB a", "\n", "é", "tail"]
    rows = [(["de", ""][i % 2], ["s", "", "t"][i % 3], texts[i * i % 11]) for i in range(70)]
    n, docs = Counter(), Counter()
    for lang, source, text in rows:
        found = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", _lower(text))
        n.update((lang, source, t) for t in found)
        docs.update((lang, source, t) for t in set(found))
    whole = pa.record_batch([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=["lang", "source", "text"])
    for most in (1, 40, 300, 10**6):
        chunks = list(source_audit._chunks(iter([whole.slice(0, 33), whole.slice(33, 0), whole.slice(33)]), most))
        assert [r for c in chunks for r in c.to_pylist()] == whole.to_pylist()
        got = [r for c in chunks for part in source_audit.counted(c) for r in part.to_pylist()]
        for expected, column in ((n, "n"), (docs, "docs")):
            total = Counter()
            for r in got:
                total[r["lang"], r["source"], r["term"]] += r[column]
            assert total == expected


def test_audit_counts_beyond_64_bits(spark):
    p = spark.createDataFrame([(10**13, 3 * 10**13, 5)], "n long, total long, terms long").select(source_audit._share("n", "total", "terms").alias("p")).first().p
    assert p == 1 + 10**9 * (10**13 + 2) // (3 * 10**13 + 10)


def _plain_clusters(rows, rounds=10):
    fine = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(fine, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    at = [v for _, v in order[:8]]

    def place(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(at))

    for _ in range(rounds):
        where = [place(v)[1] for _, v in fine]
        for k in range(len(at)):
            own = [v for (_, v), w in zip(fine, where, strict=True) if w == k]
            if own:
                at[k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    last = [place(v) for _, v in fine]
    own = Counter()
    for d, k in last:
        own[k] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return [(i, k, d, own[k], sum(own.values()), digest[k]) for (i, _), (d, k) in zip(fine, last, strict=True)]


def _order(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))


def test_clusters_are_those_of_plain_rounds(spark):
    rng = np.random.default_rng(7)
    rows = [(i, (rng.integers(-3, 4, 64) / 7 + i % 5).tolist()) for i in range(90)]
    hot = rows[3][1]
    rows += [(1000 + i, hot) for i in range(700)]  # one vector, most rows
    rows += [(7, rows[1][1]), (7, rows[2][1]), (None, hot), (None, [0.0] * 64), (2000, [-0.0] * 64)]
    bad = [(3000, None), (3001, []), (3002, [1.0] * 63), (3003, [float("nan")] + [0.0] * 63), (3004, [None] + [0.0] * 63), (3005, [float("-inf")] * 64), (3006, [1.0] * 65)]
    for kind in ("float", "double"):
        frame = spark.createDataFrame(rows + bad, f"vec_id long, embedding array<{kind}>")
        stored = rows if kind == "double" else [(i, np.float32(v).astype(float).tolist()) for i, v in rows]
        assert _order(centroids.cluster(frame).collect()) == _order(_plain_clusters(stored))


def test_clusters_of_few_of_none_and_with_clashing_names(spark):
    schema = "vec_id long, embedding array<double>, VEC_ID string, key int, n string, cluster int"
    assert centroids.cluster(spark.createDataFrame([], schema)).isEmpty()
    rows = [(i, [float(i % 2)] * 64, "x", 1, "y", 9) for i in range(3)]
    got = centroids.cluster(spark.createDataFrame(rows, schema))
    assert _order(got.collect()) == _order(_plain_clusters([r[:2] for r in rows]))
    assert got.dtypes == [("vec_id", "bigint"), ("cluster", "int"), ("distance", "bigint"), ("cluster_inertia", "bigint"), ("inertia", "bigint"), ("centroid_sha256", "string")]
    with pytest.raises(Exception, match="not within"):
        centroids.cluster(spark.createDataFrame([Row(vec_id=1, embedding=[1e9] * 64)])).collect()


def test_sums_of_a_round_are_exact_beyond_64_bits(spark):
    v = [(1 << 27) - 1] * 64
    distinct = spark.createDataFrame([(1 << 40, v), (1, [0] * 64)], "n long, vector array<long>")
    (mean,) = centroids._moved(distinct, np.zeros((1, 64), dtype=np.int64))
    assert mean.tolist() == [(((1 << 27) - 1) << 40) // ((1 << 40) + 1)] * 64
