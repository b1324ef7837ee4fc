"""Chains of sessions against a walk from session to session."""

import random

import pandas as pd

from weftline.operators import align, chains
from weftline.plans import link_queries

SESSIONS = "chain int, session int, rank int, n int, m int, start int"


def walk(sessions, cells, pins=(), blocked=(), rejected=(), gap=align.GAP):
    """session, i, j, expected by the definition, one session after the other."""
    out, left = set(), {}
    for chain, session, _, n, m, start in sorted(sessions, key=lambda s: (s[0], s[2])):
        expected = left[chain] + 1 - start if chain in left else None
        held = {(i, j): w for s, i, j, w in cells if s == session and (s, i, j) not in blocked and i < n and j < m}
        fixed = {(i, j) for s, i, j in pins if s == session and i < n and j < m}
        pinned_rows = {i for i, _ in fixed}
        weights = {}
        for i, j in held.keys() | fixed:
            if (i, j) in fixed or (i not in pinned_rows and held[i, j] > 0):
                weights[i, j] = held.get((i, j), 0) + align.PIN * ((i, j) in fixed) - (0 if expected is None else align.OFFSET * abs(j - expected - i))
        frame = pd.DataFrame([(i, j, w) for (i, j), w in weights.items()], columns=["i", "j", "w"])
        whole = ((frame["w"].astype(float) + 2 * gap) * align.MILLIONTHS).round().astype("int64").to_numpy()
        found = [p for p in align.best_chain(frame["i"].to_numpy(dtype=int), frame["j"].to_numpy(dtype=int), whole, n, m) if (session, *p) not in rejected]
        out |= {(session, i, j, expected) for i, j in found}
        if found:
            left[chain] = start + max(j for _, j in found)
    return out


def test_rounds_give_what_a_walk_gives(spark):
    rng = random.Random(4)
    sessions, cells = [], []
    for chain in range(3):
        start = 0
        for rank in range(9):
            session, n, m = chain * 100 + (rank * 5) % 9, rng.randint(1, 5), rng.randint(1, 6)
            # some begin where the one before hasn't ended
            sessions.append((chain, session, rank, n, m, max(0, start - rng.randint(0, 3))))
            start += m
            if rng.random() < 0.8:
                cells += [(session, i, j, rng.choice((0.5, 1.0, 2.0))) for i in range(n) for j in range(m) if rng.random() < 0.5]
    picks = [(s, i, j) for s, i, j, _ in cells]
    pins, blocked, rejected = ({(s, i, j) for s, i, j in rng.sample(picks, 12)} for _ in range(3))
    pins = {p for p in pins if p not in blocked}
    pins = set({(s, i): (s, i, j) for s, i, j in sorted(pins)}.values())
    key = "session int, i int, j int"
    tables = [spark.createDataFrame(sorted(x), key) for x in (pins, blocked, rejected)]
    got = chains.align_chains(spark.createDataFrame(sessions, SESSIONS), spark.createDataFrame(cells, key + ", overlap double"), *tables)
    rows = got.collect()
    assert {(r.session, r.i, r.j, r.expected) for r in rows} == walk(sessions, cells, pins, blocked, rejected)
    starts = {s[1]: s[5] for s in sessions}
    assert all(r.place == starts[r.session] + r.j and r.pinned == ((r.session, r.i, r.j) in pins) for r in rows)
    plain = chains.align_chains(spark.createDataFrame(sessions, SESSIONS), spark.createDataFrame(cells, key + ", overlap double"))
    assert {(r.session, r.i, r.j, r.expected) for r in plain.collect()} == walk(sessions, cells)
    ends = {r.session: (r.first_i, r.last_place) for r in chains.borders(got).collect()}
    assert ends == {s: (min(r.i for r in rows if r.session == s), max(r.place for r in rows if r.session == s)) for s in {r.session for r in rows}}


def test_no_sessions_and_no_cells(spark):
    one, none = spark.createDataFrame([(1, 1, 1, 2, 2, 0), (1, None, 2, 2, 2, 2)], SESSIONS), spark.createDataFrame([], "session int, i int, j int, overlap double")
    assert chains.align_chains(one, none).isEmpty() and chains.align_chains(one.limit(0), none).isEmpty()


def test_the_query_is_what_a_walk_gives(spark):
    smoke = "/root/testdata/sf0.001"
    sessions, cells, *rest = link_queries._chain_tables(spark, smoke)
    got = {(r.session, r.i, r.j, r.expected) for r in link_queries.session_chains(spark, smoke).collect()}
    assert got == walk([tuple(r) for r in sessions.collect()], [tuple(r) for r in cells.collect()], *[{tuple(r) for r in x.collect()} for x in rest]) and got


def test_ranks_and_locks(spark):
    labelled = spark.createDataFrame([("a", "correct"), ("a", "uncertain"), ("b", "correct"), ("b", "correct"), ("b", "false_positive"), ("c", "odd"), ("d", "correct"), ("e", "correct"), (None, "correct")], "s string, v string")
    margins = spark.createDataFrame([("e", 0.5), ("e", 0.25), ("d", None)], "s string, margin double")
    got = [tuple(r) for r in chains.rank_sessions(labelled, "s", "v", margins).select("s", "rank", "precision", "mean_margin", "locked").orderBy("rank").collect()]
    assert got == [("e", 1, 1.0, 0.375, True), ("d", 2, 1.0, None, True), ("b", 3, 0.6667, None, True), ("a", 4, 0.5, None, False), ("c", 5, 0.0, None, False)]
