import math
import random

import numpy as np
import pytest

from gridcheck.llm import hard_negatives as H


def brute(rows, every=100, k=5):
    """(vec_id, label, vector) rows to triples, by the contract, row by row."""
    taken = []
    for i, label, v in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        taken.append((i, label, [math.floor(256 * float(x)) for x in v]))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    by = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = []
    for n, (i, label, v) in enumerate(taken):
        if i is None or i % every:
            continue
        scored = [(dot(v, w), j, other) for m, (j, other, w) in enumerate(taken) if m != n]
        for ps, pid, _ in sorted((s for s in scored if s[2] == label), key=by)[:k]:
            found = sorted((s for s in scored if s[2] != label and 80 * ps <= 100 * s[0] <= 100 * ps), key=by)[:k]
            out += [(i, pid, r + 1, nid, ps, ns) for r, (ns, nid, _) in enumerate(found)]
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, label, v, 1, "x") for i, label, v in rows], "vec_id long, label int, embedding array<float>, row long, part string")


def run(spark, rows):
    return sorted((tuple(r) for r in H.HardNegatives(frame(spark, rows)).triples().collect()), key=str)


@pytest.fixture()
def small(monkeypatch):
    """A tree of many leaves and leaves of many parts, over few rows."""
    monkeypatch.setattr(H, "LEAF_ROWS", 30)
    monkeypatch.setattr(H, "PART_ROWS", 70)
    real = H.HardNegatives._fit

    def fit(self):
        real(self)
        assert self.tree.leaves > 4 and self.first_part[-1] > self.tree.leaves

    monkeypatch.setattr(H.HardNegatives, "_fit", fit)


def test_equals_brute_force_with_clusters_copies_and_ties(spark, small):
    rng = random.Random(4)
    centres = [[rng.gauss(0, 0.5) for _ in range(6)] for _ in range(8)]
    f = lambda v: [float(np.float32(x)) for x in v]
    rows = [(i * 7, rng.randrange(4), f([x + rng.gauss(0, 0.15) for x in rng.choice(centres)])) for i in range(700)]
    hot = f(centres[0])
    rows += [(5000 + i, rng.randrange(3), hot) for i in range(250)]  # one vector of many rows
    rows += [(100, 1, hot)] * 9 + [(200, 2, hot), (200, 2, f(centres[1])), (200, 0, hot)]  # repeated rows, ids of several rows
    rows += [(None, 1, hot), (None, 2, f(centres[2])), (300, None, hot), (400, 1, None), (500, 1, [0.1, None, 0.0, 0.0, 0.0, 0.0]), (600, 1, [0.1, math.nan, 0.0, 0.0, 0.0, 0.0]), (800, 0, [math.inf] * 6)]
    rows += [(900, 1, []), (-100, 1, f([0.5, 0.25])), (-200, 0, [0.0] * 6)]
    rng.shuffle(rows)
    want = brute([(i, label, v if v is None else v + [0.0] * (6 - len(v))) for i, label, v in rows])
    assert len(want) > 500 and run(spark, rows) == want


def test_tree_leaves_out_what_cannot_match():
    """Far clusters: a narrow window reaches few leaves, and never misses a row in it."""
    rng = np.random.default_rng(1)
    x = np.floor(256 * (rng.normal(0, 3, (40, 8))[rng.integers(0, 40, 4000)] + rng.normal(0, 0.02, (4000, 8))))
    tree = H.Tree(x[:1000], 60)
    tree.learn([(at, j, i, *v) for (at, j, i), v in _ranges(tree, x).items()])
    leaf, anchors = tree.leaf_of(x), x[::97]
    best = np.sort(anchors @ x.T, axis=1)[:, -5]
    reached = {(leaf_, q) for leaf_, qs in tree.reached(anchors, best, np.full(len(anchors), 2.0**60)) for q in qs.tolist()}
    for q, row in zip(*np.nonzero(anchors @ x.T >= best[:, None])):
        assert (int(leaf[row]), int(q)) in reached
    assert len(reached) < 0.4 * len(anchors) * tree.leaves


def _ranges(tree, x):
    found = {}
    for at, j, i, low, high, n in tree.ranges(x):
        found[at, j, i] = (low, high, n)
    return found


def test_large_components_stay_whole_numbers():
    a, b = np.array([[2.0**40, 3.0]]), np.array([[2.0**20, 5.0], [-(2.0**20), 1.0]])
    assert H.products(a, b).tolist() == [[2**60 + 15, -(2**60) + 3]]


def test_empty_tables_and_tables_without_results(spark):
    rows = [(1, 1, [1.0, 2.0]), (2, 2, [2.0, 1.0])]
    assert run(spark, rows) == [] and H.HardNegatives(frame(spark, rows).limit(0)).triples().count() == 0
    assert run(spark, [(100, 1, [1.0]), (1, 1, [1.0])]) == []
    assert run(spark, [(100, 1, [0.0]), (1, 1, [1.0]), (2, 2, [1.0])]) == [(100, 1, 1, 2, 0, 0)]
