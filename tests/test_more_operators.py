"""Hand-computed cases of the operators that no registered query covers."""

import datetime as dt
import io
import itertools
import json
import math
import random
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from weftline.functions import classifiers
from weftline.operators import aggregates, align, classify, evaluate, joins, ledger, linking, ordered, ranking, sequences, training
from weftline.sources import catalog, markup

D = dt.date(1626, 1, 1)


def test_archives_and_maps(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.xml", "<p>Jan <b>Smit</b></p>")
        z.writestr("y.txt", "no")
    rows = markup.zip_members(spark, str(tmp_path / "a.zip"))
    assert [(r.member, r.surface) for r in markup.tag_texts(rows, "text", ["p"]).collect()] == [("x.xml", "Jan Smit")]
    with tarfile.open(tmp_path / "b.tar.gz", "w:gz") as t:
        for name in ("s1", "s2"):
            body = json.dumps({"regions": [{"lines": [{"text": name}, {"text": "end"}]}]}).encode()
            info = tarfile.TarInfo(f"in/{name}.json")
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
    found = markup.tar_json_members(spark, str(tmp_path / "b.tar.gz"), ["s2"])
    parsed = found.select("member", F.from_json("json", "regions array<struct<lines:array<struct<text:string>>>>").alias("j"))
    assert [tuple(r) for r in parsed.select("member", markup.region_text("j.regions").alias("t")).collect()] == [("s2", "s2\nend")]
    assert markup.tar_json_members(spark, str(tmp_path / "b.tar.gz")).count() == 2
    a = spark.createDataFrame([("p1", "r1"), (None, "r0")], "paragraph_id string, resolution_id string")
    b = spark.createDataFrame([("p1", "r9"), ("p2", "r2"), ("p2", "r3")], "paragraph_id string, resolution_id string")
    assert dict(markup.paragraph_map(a, b).collect()) == {"p1": "r1", "p2": "r2"}
    dated = spark.createDataFrame([(D,), (D + dt.timedelta(40),)], "d date")
    assert catalog.within_envelope(dated, "d", dated.limit(1), "d").count() == 1
    assert catalog.within_envelope(dated, "d", dated.limit(0), "d").count() == 0


def test_gates_and_ladders(spark):
    rows = spark.createDataFrame([("T", ["s"], [], False), ("E", [], ["x", "y"], False), ("-1", [], [], False), ("N", [], [], True), ("N", [], [], False)], "c string, t array<string>, e array<string>, a boolean")
    session, reason = classifiers.selected_session(F.col("c"), F.col("t"), F.col("e"), F.col("a"))
    assert [tuple(r) for r in rows.select(session, reason).collect()] == [("s", None), (None, "invalid_unique_evidence"), (None, "nearby_policy_pending"), (None, "ambiguous_session_candidates"), (None, "no_supported_session_candidate")]
    full = json.dumps({k: "long enough" for k in classifiers.SUMMARY_FIELDS})
    records = spark.createDataFrame([(full,), ('{"evidence_quote": "abc"}',), (None,), ("{",)], "j string")
    quote, fields = classifiers.summary_gate(F.col("j"))
    assert [tuple(r) for r in records.select(quote, fields).collect()] == [(True, True), (False, False), (False, False), (False, False)]
    opens, closes = classifiers.formulaic(F.lit("Ontfangen een missive, is goetgevonden"))
    assert tuple(spark.range(1).select(opens, closes).first()) == (True, True)
    pairs = spark.createDataFrame([("a", None, "p9", "p2", ["p1", "p2"]), ("b", "e", "p1", None, ["p1"]), ("c", None, "p1", None, ["p0", "p1"]), ("d", None, None, None, ["p7"]), ("f", None, None, None, [])], "k string, x string, au string, fa string, ps array<string>")
    got = training.pin_ladder(pairs, F.col("x"), F.col("au"), F.col("fa"), F.col("ps")).orderBy("k").collect()
    assert [(r.paragraph, r.source) for r in got] == [("p2", "anchor"), ("e", "explicit"), ("p1", "automatic"), ("p7", "first_paragraph"), (None, None)]
    one, two = spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(1, "b"), (2, "c")], "k int, v string")
    assert sorted(map(tuple, training.pinned_records([one, two], ["k"]).collect())) == [(1, "a"), (2, "c")]
    states = spark.createDataFrame([(1, "resolved_auto", "s1"), (1, "resolved_manual", "s2"), (2, "resolved_auto", "s1"), (2, "resolved_auto", "s3"), (3, "uncertain", None)], "d int, st string, se string")
    assert sorted(map(tuple, ledger.select_status(states, ["d"], "st", "se").collect())) == [(1, "resolved_manual", "s2"), (2, "ambiguous", None), (3, "uncertain", None)]


def test_more_joins(spark):
    items = spark.createDataFrame([(1, "de Raad"), (1, "zz"), (1, "en")], "b int, t string")
    holders = spark.createDataFrame([(1, "p1", "in  de raad en"), (1, "p2", "en voorts")], "b int, p string, x string")
    got = {r.t: r.p for r in joins.unique_containers(items, holders, ["b"], "t", "x", "p").collect()}
    assert got == {"de Raad": "p1", "zz": None, "en": None}
    d = spark.createDataFrame([("d1",), ("d2",), ("d3",)], "day string")
    first, second = spark.createDataFrame([("d1", "a")], "day string, item string"), spark.createDataFrame([("d1", "b"), ("d2", "c")], "day string, item string")
    assert sorted(map(tuple, joins.pools_by_priority(d, [first, second], "day", "item").collect())) == [("d1", "a", 0), ("d2", "c", 1)]
    blocked = joins.blocked_links(spark.createDataFrame([("i", "r")], "item string, resolution_id string"), spark.createDataFrame([("r", "p"), ("r", "q")], "resolution_id string, paragraph_id string"))
    assert sorted(map(tuple, blocked.collect())) == [("i", "p"), ("i", "q")]


def test_more_aggregates_and_orders(spark):
    rows = spark.createDataFrame([(True, 0), (True, 2), (False, 5), (True, None)], "s boolean, e int")
    assert {(r.structure, r.evidence): r.n for r in aggregates.structure_evidence_grid(rows, F.col("s"), F.col("e")).collect()} == {("yes", "none"): 2, ("yes", "some"): 1, ("no", "strong"): 1}
    values = spark.createDataFrame([(v,) for v in (5, 1, 9, 3)], "v int")
    assert values.agg(aggregates.quantile_at("v", 0.5).alias("q"), aggregates.quantile_at("v", 1.0).alias("m")).first() == (5, 9)
    ranks = aggregates.average_ranks(spark.createDataFrame([(1,), (2,), (2,), (9,)], "v int"), "v", "r").orderBy("v").collect()
    assert [r.r for r in ranks] == [1, 2.5, 2.5, 4]
    both = aggregates.labelled_union(a=values, b=values.withColumn("w", F.lit(1)))
    assert {r.source for r in both.collect()} == {"a", "b"}
    ids = spark.createDataFrame([("s-10-2",), ("s-9-11",), ("s-10-1",)], "i string").orderBy(*ranking.natural_order("i")).collect()
    assert [r.i for r in ids] == ["s-9-11", "s-10-1", "s-10-2"]
    judged = spark.createDataFrame([(True, False), (True, True)], "a boolean, b boolean")
    assert ranking.gate(judged, "a", "b").first().passes is False
    ranked = spark.createDataFrame([("q", 1, "x", 0.9), ("q", 2, "y", 0.5)], "q string, rank int, c string, s double")
    assert tuple(ranking.wide(ranked, ["q"], 3, "c", "s").first()) == ("q", "x", 0.9, "y", 0.5, None, 0.0)
    points = spark.createDataFrame([("g", 2, 5, 6, 20), ("h", None, None, 3, 4)], "g string, i int, s int, n int, m int")
    gaps = sequences.known_point_gaps(points, ["g"], "i", "s", "n", "m").orderBy("g", "i").collect()
    assert [(r.g, r.n_items, r.n_slots) for r in gaps] == [("g", 2, 5), ("g", 3, 14), ("h", 3, 4)]
    anchored = spark.createDataFrame([(D, "a"), (D + dt.timedelta(1), None), (D + dt.timedelta(3), "b")], "d date, a string")
    assert [(r.a, r.next_anchor) for r in sequences.anchor_dates(anchored, "d", "a").orderBy("d").collect()] == [("a", "b")] * 3 + [("b", None)]
    pairs = spark.createDataFrame([(1, 5.0), (2, -6.0), (3, -7.0), (4, 1.0)], "k int, d double")
    assert [r.k for r in sequences.complementary_pairs(pairs, [], ["k"], "d", 2).collect()] == [2]
    sweep = training.tolerance_sweep(spark.createDataFrame([(0,), (3,), (-1,)], "d int"), "d", [0, 1]).collect()
    assert [(r.tolerance, r.pairs) for r in sweep] == [(0, 1), (1, 2)]
    gain = training.supply_gain(spark.createDataFrame([(1,)], "d int"), spark.createDataFrame([(1,), (2,)], "d int"), "d").first()
    assert (gain.abstained, gain.supplied, gain.share) == (2, 1, 0.5)


def test_more_scores(spark):
    left = spark.createDataFrame([(1, "a", "de raad van state"), (1, "b", "zeeland")], "g int, l string, t string")
    right = spark.createDataFrame([(1, "x", "de raad van state"), (1, "y", "holland")], "g int, r string, t string")
    got = {(r.l, r.r): r.similarity for r in linking.similarity_matrix(left, right, ["g"], "l", "r", "t").collect()}
    assert got["a", "x"] == pytest.approx(1) and all(0 <= v <= 1 for v in got.values()) and got.get(("a", "y"), 0) < 0.2
    score = linking.candidate_score(F.lit(True), F.lit(2), F.lit(1), F.lit(1), F.lit(3), F.lit(-2))
    assert spark.range(1).select(score.alias("s")).first().s == 10000 + 600 + 100 + 100 + 3 - 100
    pairs = spark.createDataFrame([("r", "s1", 4.0, 0.5), ("r", "s2", 6.0, 0.1)], "r string, s string, o double, x double")
    best = linking.ranked_sessions(pairs, "r", "s", "o", "x").first()
    assert (best.top_session, best.top_score, best.low_confidence) == ("s2", pytest.approx(6.1), False) and best.ranked[1].low_confidence
    fuzzy = classify.fuzzy_tokens(spark.createDataFrame([("holant",), ("xyz",)], "t string"), spark.createDataFrame([("holland",)], "n string"), "t", "n", 0.7).collect()
    assert [(r.t, r.n) for r in fuzzy] == [("holant", "holland")]
    sure, unsure = training.stacked(spark.createDataFrame([(90,), (10,), (None,)], "c int"), "c")
    assert (sure.count(), unsure.count()) == (1, 2)
    pairs = training.training_pairs(
        spark.createDataFrame([("p", "e", "Jan", "5", "9"), ("p", "e", "Jan", "5", "9"), ("p", "e", "x", "?", "9"), ("q", "e", "Jan", "1", "4")], "paragraph_id string, entity string, tag_text string, offset string, end string"),
        spark.createDataFrame([("e", "Jan Smit")], "id string, name string"), spark.createDataFrame([("p", D)], "paragraph_id string, date date"),
    ).collect()
    assert [(r.start, r.end, r.name) for r in pairs] == [(3, 7, "Jan Smit")]
    judged = training.chain_judgement(spark.createDataFrame([("a", 1), ("b", 2)], "item string, place int"), spark.createDataFrame([("a", 1)], "item string, place int")).first()
    assert (judged.judged, judged.proposed, judged.matches, judged.precision, judged.match_rate) == (2, 1, 1, 1.0, 0.5)


def test_more_cuts(spark):
    rows = spark.createDataFrame([("g", 0, 1, 100), ("g", 1, 2, 100), ("g", 2, 1, 100)], "g string, k int, n int, m int")
    assert [r.cut for r in align.proportional_cuts(rows, ["g"], ["k"], "n", "m").orderBy("k").collect()] == [0, 25, 75]
    spans = spark.createDataFrame([("g", 0, 4), ("g", 10, 14), ("g", 20, 24), ("g", 30, 34)], "g string, s int, e int")
    assert [(r.k, r.cut) for r in align.interior_cuts(spans, ["g"], "s", "e", 1).collect()] == [(1, 17)]
    a = spark.createDataFrame([("g", 0, "x"), ("g", 1, "y"), ("g", 2, "z")], "g string, k int, m string")
    b = spark.createDataFrame([("g", 0, "y"), ("g", 1, "x"), ("g", 2, "z")], "g string, k int, m string")
    assert [(r.i, r.j, r.cost) for r in align.align_mentions(a, b, "g", "k", "m").orderBy("i").collect()] == [(0, 0, 2.0), (1, 1, 2.0), (2, 2, 2.0)]
    none = align.align_mentions(a.where("k = 0"), b, "g", "k", "m").collect()
    assert [(r.i, r.j, r.cost) for r in none] == [(None, None, math.inf)]
    items = spark.createDataFrame([("d", 0, 3), ("d", 1, 3), ("d", 2, 3), ("e", 0, 2)], "day string, k int, n int")
    predicted = spark.createDataFrame([("d", "predicted", 3, 10, [4, 6]), ("e", "predicted", 3, 9, [1, 2])], "day string, status string, k_e int, axis int, cuts array<int>")
    got = align.paragraph_ranges(items, predicted, "day", "k", "n").orderBy("day", "k").collect()
    assert [(r.paragraph_start, r.paragraph_end) for r in got] == [(0, 4), (4, 6), (6, 9), (None, None)]
    assert spark.range(1).select(align.typed_score(F.lit(2.0), F.lit(None).cast("double"), F.lit(10.0)).alias("s")).first().s == 4.0


def test_mentions_leave_no_enriched_one_alone():
    assert align.mention_alignment(["Holland", "Zeeland", "Utrecht"], ["Holland", "Utrecht"]) == ([(0, 0), (2, 1)], 1.0)
    assert align.mention_alignment(["Holland", "Zeeland"], ["Holland", "Vriesland", "Zeeland"]) == ([], math.inf)
    assert align.mention_alignment([], []) == ([], 0.0) and align.mention_alignment(["a"], []) == ([], math.inf)
    rng = random.Random(3)
    for _ in range(200):
        flat, enriched = (rng.choices("abc", k=rng.randint(1, 6)) for _ in range(2))
        ways = [c for c in itertools.combinations(range(len(flat)), len(enriched))]
        pairs, cost = align.mention_alignment(flat, enriched)
        costs = {c: len(flat) - len(enriched) + sum(flat[i] != y for i, y in zip(c, enriched, strict=True)) for c in ways}
        best = min(costs.values(), default=math.inf)
        assert cost == best and (not ways or tuple(i for i, _ in pairs) == max((c for c in ways if costs[c] == best), key=lambda c: c[::-1]))


def brute_alignment(n, m, match, allowed, gap):
    """The greatest score of any global alignment."""
    best = -math.inf
    for k in range(min(n, m) + 1):
        for rows in itertools.combinations(range(n), k):
            for columns in itertools.combinations(range(m), k):
                if all(allowed[i][j] for i, j in zip(rows, columns, strict=True)):
                    best = max(best, sum(match[i][j] for i, j in zip(rows, columns, strict=True)) - gap * (n + m - 2 * k))
    return best


def test_hints_steer_alignments(spark):
    """Each hint against all alignments: pins rule out the rest of a row, the same date adds, distance costs, persons count beside others alone."""
    rng = random.Random(11)
    rows, sizes = [], []
    for g in range(40):
        n, m = rng.randint(1, 4), rng.randint(1, 4)
        sizes.append((g, n, m, rng.choice([None, 0.0, 1.0])))
        for i in range(n):
            pin = rng.randrange(m) if rng.random() < 0.2 else None
            for j in range(m):
                rows.append((g, i, j, rng.choice([0.0, 0.0, 1.5]), rng.choice([0.0, 2.0]), rng.choice([0.0, 5.0]), pin == j, rng.random() < 0.2, rng.random() < 0.3))
    cells = spark.createDataFrame(rows, "g int, i int, j int, places double, orgs double, persons double, pinned boolean, blocked boolean, same_date boolean")
    got = align.nw_align(cells, spark.createDataFrame(sizes, "g int, n int, m int, expected double"), "g").collect()
    for g, n, m, expected in sizes:
        match, allowed = [[0.0] * m for _ in range(n)], [[False] * m for _ in range(n)]
        for _, i, j, places, orgs, persons, pinned, blocked, same in (r for r in rows if r[0] == g):
            solid = places + orgs
            held = any(r[6] for r in rows if r[0] == g and r[1] == i)
            allowed[i][j] = pinned if held else solid > 0 and not blocked
            match[i][j] = solid + (0.2 * persons if solid > 0 else 0.0) + 50 * pinned + 2 * same - (0.35 * abs(j - expected - i) if expected is not None else 0.0)
        own = sorted((r for r in got if r.g == g), key=lambda r: r.step)
        assert all(allowed[r.i][r.j] for r in own if r.i is not None and r.j is not None)
        score = sum(match[r.i][r.j] if r.i is not None and r.j is not None else -0.1 for r in own)
        assert score == pytest.approx(brute_alignment(n, m, match, allowed, 0.1))


def test_segments_between_anchors(spark):
    cells = spark.createDataFrame([("d", i, j, 3.0 if j == 2 * i else 0.5) for i in range(6) for j in range(11)], "g string, i int, j int, overlap double")
    segments = spark.createDataFrame([("d", 1, 4, 2, 8), ("d", 5, 5, 10, 10), ("d", 2, 3, 5, 5)], "g string, i0 int, i1 int, j0 int, j1 int")
    assert sorted((r.i, r.j) for r in align.segment_align(cells, segments, "g").collect()) == [(1, 2), (2, 4), (3, 6), (4, 8), (5, 10)]
    anchors = spark.createDataFrame([("d", "first", 0, 0), ("d", "middle", 3, 6), ("d", "last", 5, 10), ("e", "first", 0, 0)], "g string, role string, i int, j int")
    pins = spark.createDataFrame([("d", 4, 7), ("e", 1, 1)], "g string, i int, j int")
    got = sorted((r.g, r.i, r.j) for r in align.align_by_tri_anchors(cells, anchors, "g", pins).collect())
    assert got == [("d", 0, 0), ("d", 1, 2), ("d", 2, 4), ("d", 3, 6), ("d", 4, 7), ("d", 5, 10), ("e", 1, 1)]


def test_more_evaluation(spark):
    gold = spark.createDataFrame([("a", True), ("b", False), ("c", True)], "k string, v boolean")
    back = evaluate.pair_backtest(gold, spark.createDataFrame([("a",), ("b",), ("z",)], "k string"), ["k"], "v").first()
    assert (back.judged, back.proposed, back.right, back.precision, back.recall) == (3, 2, 1, 0.5, 0.5)
    ref = spark.createDataFrame([("g", 0, 5), ("g", 0, 5), ("g", 8, 9)], "g string, start int, end int")
    hyp = spark.createDataFrame([("g", 0, 5), ("g", 4, 6), ("g", 20, 30)], "g string, start int, end int")
    assert evaluate.exact_span_scores(ref, hyp, ["g", "start", "end"]).first().tp == 1
    assert evaluate.overlapping_span_matches(ref, hyp, "g").first().tp == 2
    cells = spark.createDataFrame([("g", 0, 0, 2.0), ("g", 0, 1, 1.0), ("g", 1, 1, 4.0)], "g string, i int, j int, score double")
    m = evaluate.axis_metrics(cells, spark.createDataFrame([("g", 2, 2)], "g string, n int, m int"), ["g"]).first()
    assert (m.diagonal_mean, m.off_mean, m.margin, m.band_share) == (3.0, 0.5, 2.5, 1.0)
    assert {(r.i, r.j): r.neighbours for r in evaluate.neighbourhood_score(cells, ["g"]).collect()} == {(0, 0): 5.0, (0, 1): 6.0, (1, 1): 3.0}
    acc = evaluate.placement_accuracy(spark.createDataFrame([(1, 1), (5, 6), (9, 2), (3, None)], "a int, b int"), "a", "b").first()
    assert (acc.n, acc.exact, acc.within_one, acc.median_displacement) == (3, pytest.approx(1 / 3), pytest.approx(2 / 3), 1.0)
    days = spark.createDataFrame([(True, 2), (False, 0), (False, 3)], "nihil boolean, n int")
    assert evaluate.invariant_violations(days, "n", "nihil").count() == 2
    axis = spark.createDataFrame([("f", 0, 3), ("f", 1, 5)], "f string, k int, n int")
    assert [r.fold_start for r in evaluate.fold_groups(axis, "f", ["k"], "n").orderBy("k").collect()] == [0, 4]
    cuts = spark.createDataFrame([("g", 4), ("g", 4), ("g", None)], "g string, p int")
    assert [tuple(r) for r in evaluate.lumped_positions(cuts, ["g"], "p").collect()] == [("g", 4, 2)]
    anchors = spark.createDataFrame([("g", 0, 1), ("g", 1, 1), ("g", 2, 0), ("g", 3, 8)], "g string, e int, a int")
    assert [r.e for r in evaluate.thinned_anchors(anchors, ["g"], ["e"], 2).orderBy("e").collect()] == [0, 2]
    assert [r.obstruction for r in evaluate.anchor_obstruction(anchors, ["g"], "e", "a").orderBy("e").collect()] == [None, "repeated", "backward", None]
    marked = spark.createDataFrame([("jan", 3, "xjan", 1, 4), ("jan", 4, "jany", 0, 4), ("piet", 4, "piet", 0, 4)], "s string, n int, t string, a int, b int")
    assert [r.s for r in evaluate.inconsistent_boundaries(marked, "s", "n").collect()] == ["jan"]
    assert [r.t for r in evaluate.text_mismatches(marked, "t", "a", "b", "s").collect()] == ["jany"]
    near = spark.createDataFrame([("p", 0, 4), ("p", 6, 9), ("p", 30, 31)], "p string, start int, end int")
    assert [r.gap for r in evaluate.partial_coverage(near, ["p"]).collect()] == [2]
    queue = evaluate.review_queue(spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "k string, s double"), spark.createDataFrame([("a", "approve"), ("b", "reject")], "k string, verdict string"), ["k"], "s")
    assert {r.k: (r.priority, r.judged) for r in queue.collect()} == {"a": (6.0, True), "c": (3.0, False)}
    order = spark.createDataFrame([("g", "b", k, k) for k in range(6)], "g string, band string, x int, y int")
    agreed = evaluate.order_agreement(order, ["g"], "band", "x", "y").first()
    assert agreed.tau == pytest.approx(1) and agreed.control_tau < 0
    reason = evaluate.loss_reason(F.col("s"), F.col("x"), F.col("n"))
    rows = spark.createDataFrame([(None, 1, 1), (1, 1, 2), (1, 9, 1), (1, 1, 1)], "s int, x int, n int").select(reason.alias("r")).collect()
    assert [r.r for r in rows] == ["unplaced", "shared_start", "extent", None]


def test_order_agreement_is_the_same_in_place_and_by_ranges(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(g, rng.choice("AR"), rng.choice([None, *range(5)]), rng.choice([None, *range(9)])) for g in (*range(40), None) for _ in range(rng.choice([1, 2, 3, 6, 30]))]
    order = spark.createDataFrame(rows, "g int, band string, x int, y int")
    read = lambda: sorted(((str(r.g), r.band, r.pairs, r.tau, r.control_tau) for r in evaluate.order_agreement(order, ["g"], "band", "x", "y").collect()), key=str)
    in_place = read()
    # all but the groups of one row by ranges, and some of each
    for most in (1, 4):
        monkeypatch.setattr(evaluate, "SMALL_GROUP", most)
        assert read() == in_place and len(in_place) > 30


def test_order_agreement_of_small_groups_writes_nothing_on_the_way(spark, monkeypatch):
    def never(*_):
        raise AssertionError("a checkpoint")

    for module in (aggregates, ordered, evaluate):
        monkeypatch.setattr(module, "cut", never, raising=False)
    order = spark.createDataFrame([(g, "b", k, -k) for g in range(9) for k in range(6)], "g int, band string, x int, y int")
    got = evaluate.order_agreement(order, ["g"], "band", "x", "y")
    assert {(r.pairs, r.tau) for r in got.collect()} == {(15, -1.0)} and got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
