"""The sparse chain against a full table, ties included."""

import random
import time

import numpy as np

from weftline.operators import align


def _full(n, m, weight):
    """Pairs of the best alignment from the whole table: of equal moves the diagonal, then a skipped row, wins."""
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + weight[i - 1, j - 1] if (i - 1, j - 1) in weight else 0)
    i, j, out = n, m, []
    while i or j:
        if i and j and (i - 1, j - 1) in weight and best[i - 1][j - 1] + weight[i - 1, j - 1] == best[i][j]:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif i and (not j or best[i - 1][j] == best[i][j]):
            i -= 1
            out.append((i, None))
        else:
            j -= 1
            out.append((None, j))
    return out[::-1]


def test_chain_is_that_of_the_whole_table():
    rng = random.Random(11)
    for trial in range(3000):
        n, m = rng.randint(0, 9), rng.randint(0, 9)
        few = rng.choice([0.1, 0.4, 0.9])
        weight = {(i, j): rng.choice([0, 0, 1, 1, 2, 3, -1, -2] if trial % 2 else [1, 2]) for i in range(n) for j in range(m) if rng.random() < few}
        cells = list(weight)
        rng.shuffle(cells)
        i, j = (np.array([c[k] for c in cells], dtype=np.int64) for k in (0, 1))
        chain = align.best_chain(i, j, np.array([weight[c] for c in cells], dtype=np.int64), n, m)
        assert align.alignment_steps(chain, n, m) == _full(n, m, weight), (n, m, weight)


def test_long_sequences_with_few_cells_take_no_table():
    rng = np.random.default_rng(4)
    n = 200_000
    i, j = rng.integers(0, n, 200_000), rng.integers(0, n, 200_000)
    began = time.process_time()
    chain = align.best_chain(i, j, rng.integers(1, 100_000, len(i)), n, n)
    assert len(chain) > 500 and time.process_time() - began < 60
    assert all(a > c and b > d for (a, b), (c, d) in zip(chain, chain[1:], strict=False))
