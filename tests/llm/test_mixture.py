import itertools
import random

import pytest
from pyspark.sql import functions as F

from emberfold.llm import mixture as m

from . import odd


def test_targets_stop_at_their_bound_and_share_the_rest():
    got = m.targets([100, 10, 1000], [3, 1, 2], 1.5 * 1110, 2)
    assert got[:2] == [200, 20] and sum(got) == pytest.approx(1665)
    assert m.targets([10, 10, 10], [3, 1, 2], 45, 2) == pytest.approx([20, 25 / 3, 50 / 3])
    assert m.targets([0, 0], [3, 1], 0, 2) == [0, 0]


def slow_route(capacity, quota, repeats):
    """Best (routed words, -cost) over all splits of each pattern's use among its sources."""
    best = None
    options = []
    for p, words in capacity.items():
        options.append([x for x in itertools.product(range(words * repeats + 1), repeat=len(p)) if sum(x) <= words * repeats])
    for choice in itertools.product(*options):
        filled = dict.fromkeys(quota, 0)
        for p, x in zip(capacity, choice):
            for s, amount in zip(p, x):
                filled[s] += amount
        if all(filled[s] <= quota[s] for s in quota):
            cost = sum(sum(max(0, min(sum(x) - k * w, w)) * k for k in range(repeats)) for w, x in zip(capacity.values(), choice))
            key = (sum(filled.values()), -cost)
            best = key if best is None else max(best, key)
    return best


def test_flow_is_the_cheapest_of_the_largest():
    random.seed(8)
    for _ in range(60):
        patterns = random.sample([("a",), ("b",), ("a", "b"), ("b", "c"), ("c",)], random.randint(1, 3))
        capacity = {p: random.randint(0, 3) for p in patterns}
        quota = {s: random.randint(0, 6) for s in "abc"}
        drawn = m.route(capacity, quota, 2)
        cost = sum(max(0, drawn[p] - w) for p, w in capacity.items())
        assert (sum(drawn.values()), -cost) == slow_route(capacity, quota, 2)
        assert all(drawn[p] <= 2 * w for p, w in capacity.items())


def test_overlapping_sources_use_fresh_words_first(spark):
    rows = [(k, k, 10, ["a"]) for k in range(50)] + [(100 + k, k, 10, ["a", "b"]) for k in range(50)] + [(200, 1, 10, [])]
    sized = spark.createDataFrame(rows, "doc long, tie long, size long, pattern array<string>")
    chosen, quotas = m.select(sized, quotas={"a": 600.0, "b": 400.0})
    taken = {tuple(r.pattern): r.t for r in chosen.groupBy("pattern").agg(F.sum("taken").alias("t")).collect()}
    assert abs(taken[("a",)] - 500) <= 10 and abs(taken[("a", "b")] - 500) <= 10 and taken[()] == 0
    assert chosen.agg(F.max("uses")).first()[0] == 1


def test_mix_of_documents(spark):
    random.seed(9)
    rows = [(k, " ".join(["w"] * random.randint(0, 60)), "en", random.choice(["x", "y", "y", "y", None])) for k in range(400)]
    docs = odd.documents(spark, rows)
    got = m.mix(docs).collect()
    assert sorted(r.doc_id for r in got) == list(range(400))
    assert sorted(got) == sorted(m.mix(docs.repartition(5)).collect())
    for r in got:
        assert r.size == len(rows[r.doc_id][1].split()) and 0 <= r.taken <= 2 * r.size
    for source in ("x", "y", None):
        own = [r for r in got if rows[r.doc_id][3] == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 60
        assert own[0].source_size == sum(r.size for r in own)


def test_odd_rows(spark):
    got = m.mix(odd.documents(spark)).collect()
    assert len(got) == 13 and all(0 <= r.taken <= 2 * r.size for r in got)
    assert {r.source_size for r in got if r.doc_id in (3, 4)} == {30_000 + 2 * len(odd.PLAIN.split()) + 6}
    assert m.mix(odd.empty(spark)).count() == 0
    assert m.mix(odd.documents(spark, [(1, None, "en", "s"), (2, "", "en", None)])).count() == 2
