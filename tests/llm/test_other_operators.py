"""Vectors, chats, shards, licences and the pipeline against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from weftline.llm import chat_format, embedding_dedup, license_scan, packing, sharding, vp_search

VECTORS = "vec_id long, embedding array<float>"


def vectors(seed=2, n=300, d=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype(np.float32)
    for k in range(0, n, 5):
        x[k + 1] = x[k] + rng.normal(size=d).astype(np.float32) * 0.15
        x[k + 2] = x[k + 1] + rng.normal(size=d).astype(np.float32) * 0.15
    x[10], x[20], x[30] = x[0], x[0], 2 * x[0]
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    return rows + [(1000, None), (1001, []), (1002, [0.0] * d), (1003, [None] + [1.0] * (d - 1)), (1004, [float("nan")] + [1.0] * (d - 1)), (1005, [float("inf")] * d), (None, x[0].tolist())]


def good(rows):
    out = []
    for i, v in rows:
        if i is not None and v and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0):
            out.append((i, np.array(v, dtype=np.float64)))
    return out


def test_embedding_links_agree_with_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 32)
    rows = vectors()
    table = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 AS n_links", "'x' AS print")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicate_vectors(table, miss=1e-7).collect()}
    known = good(rows)
    unit = np.array([v / np.linalg.norm(v) for _, v in known])
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    ids = np.array([i for i, _ in known])
    least = ids.copy()
    while True:
        new = np.array([min([least[k], *least[near[k]]]) for k in range(len(ids))])
        if (new == least).all():
            break
        least = new
    for k, i in enumerate(ids):
        assert got[i].n_links == near[k].sum(), i
        assert got[i].component_id == least[k] and got[i].kept == (least[k] == i)
    for i in range(1000, 1006):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[None].component_id is None and got[None].kept
    assert embedding_dedup.near_duplicate_vectors(spark.createDataFrame([], VECTORS)).count() == 0


def test_vectors_of_one_id_are_one_node_whatever_they_hold(spark):
    rng = np.random.default_rng(8)
    a, b, c = rng.normal(size=(3, 16)).tolist()
    rows = [(5, a), (5, b), (9, a), (3, b), (7, [x * 2 for x in a]), (8, c), (8, None), (2, c), (6, [0.0] * 16)]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_duplicate_vectors(spark.createDataFrame(rows, VECTORS)).collect())
    assert got == [(2, 1, 2), (3, 1, 3), (5, 1, 3), (5, 2, 3), (6, 0, 6), (7, 2, 3), (8, 0, 2), (8, 1, 2), (9, 2, 3)]


def test_recall_of_hyperplane_tables_at_the_threshold():
    rng, d, pairs = np.random.default_rng(4), 64, 2000
    x = rng.normal(size=(pairs, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    aside = rng.normal(size=(pairs, d))
    aside -= (aside * x).sum(axis=1, keepdims=True) * x
    y = 0.9 * x + math.sqrt(1 - 0.81) * aside / np.linalg.norm(aside, axis=1, keepdims=True)
    bits, tables = embedding_dedup.tables_for(100_000)
    planes = rng.normal(size=(d, bits * tables))
    same = ((x @ planes > 0) == (y @ planes > 0)).reshape(pairs, tables, bits).all(axis=2).any(axis=1)
    assert same.mean() >= 0.99


def test_more_tables_for_more_vectors():
    for rows in (10, 10_000, 10_000_000):
        bits, tables = embedding_dedup.tables_for(rows)
        assert (1 - (1 - np.arccos(0.9) / np.pi) ** bits) ** tables <= embedding_dedup.MISS


@pytest.mark.parametrize("factor", [1.0, 1.3])
def test_vantage_points_find_the_nearest(spark, monkeypatch, factor):
    monkeypatch.setattr(vp_search, "SHARD", 100)
    monkeypatch.setattr(vp_search, "QUERIES", 4)
    monkeypatch.setattr(vp_search, "LEAF", 16)
    rows = vectors() + [(7, vectors()[8][1])]
    table = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 AS score")
    got = vp_search.nearest(table, table.where("vec_id % 10 = 0"), factor=factor).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    known = good(rows)
    first = {}
    for i, v in known:
        first[i] = min(first.get(i, v.tolist()), v.tolist())
    hits = total = 0
    for q in [i for i in first if i % 10 == 0]:
        want = sorted((float(np.sqrt(((v - first[q]) ** 2).sum())), i) for i, v in known if i != q)[:10]
        mine = sorted(by[q], key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 11))
        if factor == 1.0:
            assert np.allclose([r.score for r in mine], [s for s, _ in want], atol=1e-12)
            assert [r.vec_id for r in mine] == [i for _, i in want]
        hits += len({r.vec_id for r in mine} & {i for _, i in want})
        total += 10
    assert hits / total >= 0.9
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0])], VECTORS)
    assert [(r.query_id, r.rank, r.vec_id) for r in vp_search.nearest(few, few.where("vec_id = 0")).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]
    none = spark.createDataFrame([], VECTORS)
    assert vp_search.nearest(none, none).count() == 0
    assert vp_search.nearest(few.limit(1), few.where("vec_id = 0")).count() == 0


def test_relaxed_trees_measure_less():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 6))
    tree = vp_search.Tree(x, 32)
    ids = np.arange(3000)
    exact, all_ = vp_search.search(tree, ids, x[:20], ids[:20], 10, 1.0)
    loose, few = vp_search.search(tree, ids, x[:20], ids[:20], 10, 2.0)
    brute = np.sort(np.sqrt(((x[:20, None] - x[None]) ** 2).sum(axis=2)), axis=1)[:, 1:11]
    assert np.allclose(exact.far, brute)
    assert few < all_ < 20 * 3000
    assert np.mean([len(set(a) & set(b)) for a, b in zip(exact.ids, loose.ids, strict=True)]) >= 7


def test_copies_on_both_sides_of_a_median_all_count():
    for seed in range(40):
        rng = np.random.default_rng(seed)
        centre, way = rng.normal(size=(2, 64))
        x = np.concatenate([centre + s * 10 * way + rng.normal(size=(200, 64)) * abs(s) for s in (-1, 0, 1)])[rng.permutation(600)]
        copies = np.flatnonzero((x == centre).all(axis=1))
        found, _ = vp_search.search(vp_search.Tree(x, 16), np.arange(600), x[copies[-1:]], copies[-1:], 10, 1.0)
        assert found.ids[0].tolist() == copies[:10].tolist() and not found.far.any(), seed


CHATS = "conv_id long, turn long, role string, text string"


def brute_chats(rows):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t, r, x))
    key = lambda t: (t[0] is not None, t[0] or 0, t[1] is not None, t[1] or "", t[2] is not None, t[2] or "")
    whole = {c: tuple((r, x) for _, r, x in sorted(ts, key=key)) for c, ts in by.items()}
    kept = {}
    for c, ts in whole.items():
        if any(len(o) > len(ts) and o[: len(ts)] == ts for o in whole.values()):
            continue
        kept.setdefault(ts, []).append(c)
    return {min((c for c in cs if c is not None), default=None): "".join(f"<|im_start|>{r or ''}\n{x or ''}<|im_end|>\n" for r, x in ts) for ts, cs in kept.items()}


def test_chats_collapse_to_the_longest_snapshots(spark):
    rng = random.Random(1)
    rows = []
    for c in range(40):
        base = random.Random(c // 4)
        turns = [(k, ["user", "assistant"][k % 2], f"t{base.randint(0, 9)}") for k in range(8)]
        rows += [(c, *t) for t in turns[: rng.randint(1, 8)]]
    rows += [(100, 0, None, None), (101, 0, None, ""), (102, 0, "", None), (103, None, "user", "x"), (103, 0, "user", "y"), (104, 0, "user", "same"), (104, 0, "user", "same"), (None, 0, "user", "nobody"), (105, 0, "user", "t" * 500)]
    table = spark.createDataFrame(rows, CHATS).selectExpr("*", "1 AS part", "2 AS n_turns")
    got = chat_format.format_chats(table).collect()
    assert {r.conv_id: r.rendered for r in got} == brute_chats(rows)
    assert len(got) == len(brute_chats(rows)) and {r.part for r in got} == {0}
    parted = chat_format.format_chats(table, part_chars=40).orderBy("conv_id", "part").collect()
    joined = {}
    for r in parted:
        joined[r.conv_id] = joined.get(r.conv_id, "") + r.rendered
    assert joined == brute_chats(rows) and max(r.part for r in parted) > 0
    assert chat_format.format_chats(spark.createDataFrame([], CHATS)).count() == 0


def brute_lookup(shards, slots):
    order = {s: [(sharding._number(s, "offset") + j * (sharding._number(s, "skip") % (slots - 1) + 1)) % slots for j in range(slots)] for s in shards}
    taken, at, table = set(), Counter(), [None] * slots
    while len(taken) < slots:
        for s in sorted(shards):
            if len(taken) == slots:
                break
            while order[s][at[s]] in taken:
                at[s] += 1
            table[order[s][at[s]]] = s
            taken.add(order[s][at[s]])
    return table


def test_lookup_table_agrees_with_brute_force_and_moves_little():
    shards = [f"s{k}" for k in range(7)]
    table = [shards[i] for i in sharding.lookup_table(shards, 509)]
    assert table == brute_lookup(shards, 509)
    assert max(Counter(table).values()) - min(Counter(table).values()) <= 1
    fewer = [shards[:-1][i] for i in sharding.lookup_table(shards[:-1], 509)]
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != "s6")
    assert moved / 509 < 0.25
    for bad in ((["a", "a"], 509), ([], 509), (["a"], 510)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def test_placement_is_by_key_and_spreads_hot_ones(spark, tmp_path):
    rows = [(k, "hot" if k % 3 == 0 else f"c{k}") for k in range(900)] + [(None, None), (1, "c1"), (2000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string").selectExpr("*", "'x' AS shard", "1 AS slot")
    by_key = sharding.place(docs, "source").collect()
    assert len(by_key) == len(rows)
    assert len({r.shard for r in by_key if r.source == "hot"}) == 1
    table = sharding.lookup_table(sharding.SHARDS)
    assert all(r.shard == sharding.SHARDS[table[r.slot]] for r in by_key)
    spread = sharding.place(docs, "source", spread_by="doc_id").collect()
    assert len(spread) == len(rows)
    assert len({r.shard for r in spread if r.source == "hot"}) > 20
    sharding.write_shards(sharding.place(docs), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)
    assert sharding.place(spark.createDataFrame([], "doc_id long"), spread_by="doc_id").count() == 0


def brute_licences(rows, model):
    out = {}
    for i, text in rows:
        lines = (text or "").split("\n")
        low = [license_scan._ascii_lower(x) for x in lines]
        has = [sum(bool(re.search(rf"(?<![a-z0-9]){re.escape(t)}(?![a-z0-9])", x)) for t in model.triggers) for x in low]
        at = [k for k, h in enumerate(has) if h]
        # a longer trigger hides those within it
        rich = {k: len({m[0] for m in re.finditer(license_scan._holds(model), low[k])}) > 1 for k in at}
        stretches = []
        for k in at:
            last = stretches[-1][1] if stretches else -9
            if rich[k] and rich.get(last) and (k - last == 1 or (k - last == 2 and lines[k - 1].strip(" "))):
                stretches[-1][1] = k
            else:
                stretches.append([k, k])
        for k, last in stretches:
            grams = license_scan.ngrams("\n".join(lines[k : last + 1]))
            score = np.array(model.bias) + sum((np.array(w) for g, w in model.weights.items() if g in grams), np.zeros(len(model.families)))
            c = int(np.argmax(score))
            probability = 1 / (1 + np.exp(-score[c]))
            if probability >= model.least:
                share = max(license_scan.template_share(grams, license_scan.ngrams(t)) for t in license_scan.TEMPLATES[model.families[c]])
                out[i, k] = (model.families[c], round(float(probability), 6), round(share, 6), share >= license_scan.CONFIRM)
    return out


def test_licences_agree_with_brute_force_and_known_families(spark):
    rng = random.Random(2)
    prose = [" ".join(rng.choices(["the", "of", "is", "and", "shore", "ering", "version", "work", "under", "free"], k=rng.randint(3, 30))) for _ in range(300)]
    rows = [(k, "\n".join(prose[3 * k : 3 * k + 3])) for k in range(100)]
    planted = {}
    for c, (family, templates) in enumerate(license_scan.TEMPLATES.items()):
        for t, template in enumerate(templates):
            rows.append((200 + 10 * c + t, f"{prose[c]}\n{template}\n{prose[c + 1]}"))
            planted[200 + 10 * c + t] = family
    for k, family in enumerate(("mit", "gpl-3.0", "bsd")):
        words = license_scan.TEMPLATES[family][1].split()
        wrapped = "\n".join(" ".join(words[j : j + 9]) for j in range(0, len(words), 9))
        rows.append((400 + k, f"{prose[0]}\n\n{wrapped}\n\n{prose[1]}"))
        planted[400 + k] = family
    rows += [(500, None), (501, ""), (502, "\n\n"), (503, "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0."), (503, "x"), (504, "licence " * 2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS family", "'x' AS line", "'y' AS Doc")
    model = license_scan.train(docs)
    got = license_scan.scan(docs, model=model).collect()
    mine = {(r.doc_id, r.paragraph): (r.family, r.probability, r.template_share, r.confirmed) for r in got}
    want = brute_licences(rows, model)
    assert mine.keys() == want.keys()
    for k, (family, p, share, sure) in want.items():
        assert mine[k][0] == family and abs(mine[k][1] - p) < 2e-6 and abs(mine[k][2] - share) < 2e-6 and mine[k][3] == sure
    found = {i: f for (i, _), (f, *_, sure) in mine.items() if sure}
    assert not {i: (f, found.get(i)) for i, f in planted.items() if found.get(i) != f}
    assert found.get(503) == "apache-2.0" and not [i for i in found if i < 200]
    assert license_scan.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pipeline_agrees_with_its_operators_run_by_hand(spark, tmp_path):
    rng = random.Random(9)
    calm, rude = [f"calm{k}" for k in range(300)], ["brute", "oaf", "lout"]
    rows, labels = [], []
    for k in range(240):
        words = rng.choices(calm, k=rng.randint(20, 90))
        if k % 6 == 0:
            words += rng.choices(rude, k=4)
        rows.append((k, " ".join(words), "en", "s", len(" ".join(words))))
        labels.append((k, 1, int(k % 6 == 0)))
    rows += [(300 + k, rows[k][1], "en", "s", 1) for k in range(1, 6)]
    rows += [(400, "the password=abcdef123 of calm things that calm people write", "en", "s", 60), (401, None, "en", "s", None), (402, "", None, None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    kept = {r.doc_id: r for r in docs.collect()}
    assert not [k for k in range(0, 240, 6) if k in kept]
    assert all(k in kept for k in range(240) if k % 6)
    assert not [300 + k for k in range(1, 6) if 300 + k in kept] and {401, 402} <= kept.keys()
    assert kept[400].text == "the [SECRET] of calm things that calm people write" and kept[400].n_chars == len(kept[400].text)
    pieces = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(pieces.doc_id) == set(kept)
    by_hand = packing.pack_documents(docs).toPandas()
    assert pieces.length.sum() == by_hand.ids.map(len).sum() // 4
