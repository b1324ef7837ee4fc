"""Nearest rows by blocks against all pairs, whatever the blocks' sizes."""

import numpy as np
import pytest

from weftline.operators import linking


@pytest.mark.parametrize("sizes", [(4096, 1 << 15, 256), (7, 13, 3)], ids=["one block", "many blocks"])
def test_dense_topk_is_that_of_all_pairs(spark, monkeypatch, sizes):
    for name, n in zip(("QUERY_BLOCK", "ROW_BLOCK", "PRODUCT_ROWS"), sizes, strict=True):
        monkeypatch.setattr(linking, name, n)
    rng = np.random.default_rng(2)
    # few values, so that many cosines tie
    vectors = {k: rng.integers(-1, 2, 4).astype(float).tolist() for k in range(90)}
    odd = {100: None, 101: [0.0] * 4, 102: [1.0, float("nan"), 0.0, 0.0], 103: [1.0, None, 0.0, 0.0], 104: [1.0], 105: [float("inf"), 0.0, 0.0, 0.0], 106: [1e200, 1e200, 0.0, 0.0], 107: []}
    rows = spark.createDataFrame(list((vectors | odd).items()), "k long, v array<double>").repartition(3)
    queries = rows.where("k % 2 = 0").withColumnRenamed("k", "q")
    got = {}
    for r in linking.dense_topk(queries, rows, "q", "k", "v", 5).collect():
        got.setdefault(r.q, {})[r["rank"]] = (r.k, r.cosine)
    sound = {k: np.array(v) / max(map(abs, v)) for k, v in (vectors | {106: odd[106]}).items() if any(v)}
    want = {}
    for q in sound:
        if q % 2 == 0:
            scores = sorted((-round(float(sound[q] @ v / np.linalg.norm(sound[q]) / np.linalg.norm(v)), 9), k) for k, v in sound.items() if k != q)[:5]
            want[q] = {n + 1: (k, pytest.approx(-s)) for n, (s, k) in enumerate(scores)}
    assert got == want
    assert linking.dense_topk(queries.limit(0), rows, "q", "k", "v", 5).isEmpty() and linking.dense_topk(queries, rows.limit(0), "q", "k", "v", 5).isEmpty()
