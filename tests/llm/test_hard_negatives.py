import math

import numpy as np
import pytest

from onomast.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, Score long, LEAF int, rank string"


def brute(rows, every=100, scale=256):
    kept = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) or abs(scale * float(np.float32(x))) >= hn.LARGEST for x in v):
            continue
        own = (label, [math.floor(scale * float(np.float32(x))) for x in v])
        kept[i] = min(kept.get(i, own), own)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i, (label, v) in kept.items():
        if i % every:
            continue
        first = sorted((-dot(v, w), j, k) for j, (k, w) in kept.items() if j != i)
        for s, j, _ in [x for x in first if x[2] == label][:5]:
            met = [(n, -t) for t, n, k in first if k != label and 80 * -s <= 100 * -t <= 100 * -s][:5]
            out += [(i, j, r + 1, n, -s, t) for r, (n, t) in enumerate(met)]
    return sorted(out)


def got(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)
    return sorted(map(tuple, hn.mine(df, **options).collect()))


def clustered(n, d=8, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, d)) * 4
    return [(i, (centres[i % 6] + rng.normal(size=d) * 0.2).astype(np.float32).tolist(), int(rng.integers(0, 3))) for i in range(n)]


ODD = [
    (None, [1.0] * 8, 1), (1000, None, 1), (1100, [1.0] * 8, None), (1200, [1.0, None], 1), (1300, [float("nan")], 1), (1400, [float("inf")], 1), (1500, [1e30], 1),
    (1600, [], 2), (1700, [2.0, 1.0], 2), (1701, [2.0, 1.0], 1), (3, [9.0] * 8, 0), (3, [9.0] * 8, 0), (-100, [-1.0] * 8, 1), (-7, [3.0] * 12, 2),
]


def test_equals_brute_force(spark, monkeypatch):
    same = [(2000 + i, [1.5] * 8, i % 2) for i in range(150)]  # one vector for a third of all rows: ties
    rows = clustered(300) + ODD + same
    monkeypatch.setattr(hn, "BLOCK", 40)
    monkeypatch.setattr(hn, "GROUP", 2)
    monkeypatch.setattr(hn, "SAMPLE", 64)
    assert got(spark, rows) == brute(rows) != []


@pytest.mark.parametrize("rows", [[], [(100, [1.0, 2.0], 1)], [(100, [1.0], 1), (1, [1.0], 1), (2, [1.0], 2), (2, [1.0], 2)]])
def test_few_rows(spark, rows):
    assert got(spark, rows) == brute(rows)


def test_node_pairs_are_dropped_in_whole_groups():
    x = np.array([v for _, v, _ in clustered(2000)])
    trees = []
    for rows in (x[::20], x):
        tree = hn.Tree.grown(rows, 32)
        leaf = tree.leaf_of(rows)
        away = np.sqrt(((rows - tree.centres[leaf]) ** 2).sum(1))
        trees.append(tree.filled([{"leaf": int(n), "radius": away[leaf == n].max(), "rows": int((leaf == n).sum())} for n in np.unique(leaf)]))
    leaf, scores = trees[0].leaf_of(x[::20]), x[::20] @ x.T
    best = np.sort(scores, 1)[:, -5]
    low, high = hn.bounds(trees[0], [{"leaf": int(n), "low": best[leaf == n].min(), "high": np.inf} for n in np.unique(leaf)])
    pairs, seen = hn.meeting(*trees, low, high)
    assert len(pairs) < 32 * 32 / 3 and seen < 2 * 32 * 32
    to = trees[1].leaf_of(x)
    for r, own in enumerate(leaf):  # no row that is looked for is lost
        assert {(own, to[c]) for c in np.flatnonzero(scores[r] >= low[own])} <= set(pairs)


def test_exact_products_and_first_of():
    big = np.array([[1 << 30, 3]], np.int64)
    assert hn.products(big, big).tolist() == [[(1 << 60) + 9]]
    at, full = hn.first_of(np.array([[5, 5, 5, 1]]), np.array([1, 2, 3, 4]), np.array([[True, False, True, True]]), 2)
    assert at.tolist() == [[0, 2]] and full.all()
