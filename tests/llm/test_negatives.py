import math

import numpy as np
import pyarrow as pa
import pytest

from emberfold.llm import negatives as n

SCHEMA = "vec_id long, embedding array<float>, label int, uid string, anchor string, scores int, pivot string"


def table(spark, rows):
    return spark.createDataFrame([(*r, None, None, None, None) for r in rows], SCHEMA)


def plain_version(rows):
    """The contract, pair by pair; rows that repeat are one."""
    kept = set()
    for k, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if k is not None and k % 7 == 0:
            label = (label + 1) % 10
        kept.add((k, label, tuple(math.floor(256 * float(np.float32(x))) for x in v)))
    out = []
    rank = lambda r: (-r[0], r[1] is None, r[1] or 0)
    for anchor in kept:
        if anchor[0] is None or anchor[0] % 100:
            continue
        score = lambda r: sum(a * b for a, b in zip(anchor[2], r[2]))
        same = sorted(((score(r), r[0]) for r in kept if r != anchor and r[1] == anchor[1]), key=rank)[:5]
        other = sorted(((score(r), r[0]) for r in kept if r[1] != anchor[1]), key=rank)
        for positive, pid in same:
            fitting = [(s, k) for s, k in other if 30 * positive <= 100 * s <= 90 * positive][:10]
            out += [(anchor[0], pid, place, k, positive, s) for place, (s, k) in enumerate(fitting, 1)]
    return sorted(out, key=str)


def vectors(count, width=8, labels=10, seed=1, spread=1.0):
    random = np.random.default_rng(seed)
    centers = random.normal(size=(6, width))
    made = centers[random.integers(0, 6, count)] + spread * random.normal(size=(count, width))
    return [(k, [float(x) for x in v], int(random.integers(0, labels))) for k, v in enumerate(made)]


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_equals_the_plain_version(spark, monkeypatch, spread):
    monkeypatch.setattr(n, "ANCHORS", 5)
    monkeypatch.setattr(n, "BLOCKS", 3)
    rows = vectors(1500, spread=spread)
    assert sorted(map(tuple, n.mine(table(spark, rows)).collect()), key=str) == plain_version(rows)


def test_odd_rows_ties_and_one_large_label(spark, monkeypatch):
    monkeypatch.setattr(n, "BLOCKS", 2)
    rows = [(k, [float(k % 3), 1.0, -0.5], 1 if k % 3 else k % 10) for k in range(320)]
    rows += rows[:40] + [(None, [2.0, 1.0, 0.0], 2), (None, [1.0, 1.0, 0.0], 1), (200, [0.5, 0.5, 0.5], 1)]
    rows += [(400, None, 1), (401, [1.0, None, 1.0], 1), (402, [float("nan"), 1.0, 1.0], 2), (403, [1.0, 1.0, 1.0], None),
             (404, [float("inf"), 0.0, 0.0], 3), (500, [], 1), (600, [1.0], 4), (700, [-1.0, -1.0, -1.0, -7.0], 5)]
    got = sorted(map(tuple, n.mine(table(spark, rows)).collect()), key=str)
    assert got == plain_version(rows)
    assert n.mine(table(spark, [])).count() == 0
    assert n.mine(table(spark, [(1, [1.0], 1), (2, [1.0], 2)])).count() == 0  # no anchor


def test_scores_that_are_not_exact_are_refused(spark):
    with pytest.raises(Exception, match="2\\^53"):
        n.mine(table(spark, [(100, [1e30], 1), (1, [1e30], 1)])).collect()


def test_bounds_hold_and_spare_most_scores():
    rows = vectors(4000, spread=0.02)
    made = pa.table({"uid": [r[0] for r in rows], "vec_id": [r[0] for r in rows], "label": [r[2] for r in rows],
                     "vector": [[math.floor(256 * x) * 1.0 for x in r[1]] for r in rows]})
    anchors = made.filter(pa.compute.equal(pa.array([r[0] % 100 == 0 for r in rows]), True))
    block = n.Block(anchors, made)
    exact = block.vectors @ block.anchors.T
    bounds = []

    def wanted(k, low, high):
        assert (low <= exact[:, k]).all() and (exact[:, k] <= high).all()
        bounds.append(k)
        return exact[:, k] > 0.9 * exact[:, k].max()

    for k, some, scores in block.walk(wanted):
        assert (scores == exact[some, k]).all()
    assert sorted(bounds) == list(range(len(anchors)))
    block.scored = 0
    found = list(n.nearest_same(block, anchors))
    assert len(found) == len(anchors) and block.scored < 0.5 * exact.size
    order, parent, distance = n.spanning_tree(block.anchors)
    assert sorted(order) == list(range(len(anchors))) and (parent < 0).sum() == 1
    place = np.argsort(order)
    assert all(place[parent[k]] < place[k] for k in range(len(anchors)) if parent[k] >= 0)
