import random

import numpy as np

from emberfold.llm import jaccard_join as j

from . import odd


def slow_join(docs):
    sets = []
    for _, text in docs:
        w = (text or "").split()
        sets.append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    parent, links = list(range(len(docs))), [0] * len(docs)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {docs[k][0]: (docs[root(k)][0], links[k]) for k in range(len(docs))}


def near_copies(seed, n):
    random.seed(seed)
    docs, bases = [], [[f"v{random.randrange(400)}" for _ in range(random.randint(3, 160))] for _ in range(6)]
    for k in range(n):
        words = list(random.choice(bases))
        for _ in range(random.choice([0, 0, 1, 1, 2, 3])):
            words[random.randrange(len(words))] = f"e{random.randrange(50)}"
        docs.append((k, " ".join(words)))
    return docs


def test_equals_all_pairs_in_one_and_in_many_blocks(spark, monkeypatch):
    docs = near_copies(2, 150)
    expected = slow_join(docs)
    table = odd.documents(spark, [(k, t, "en", "s") for k, t in docs])
    for block in (j.BLOCK_NODES, 7):
        monkeypatch.setattr(j, "BLOCK_NODES", block)
        got = {r.doc_id: (r.class_id, r.n_links) for r in j.join(table).collect()}
        assert got == expected
    heads = {c for c, _ in expected.values()}
    assert {r.doc_id for r in j.keep_one(table).collect()} == heads


def test_sets_go_only_where_a_pair_outlasts_its_minhash_values(spark, monkeypatch):
    """A long chain of candidates in many blocks: nodes meet neighbours, not every block of their group."""
    monkeypatch.setattr(j, "BLOCK_NODES", 4)
    words = [f"w{k}" for k in range(4000)]
    docs = [(k, " ".join(words[12 * k:12 * k + 130])) for k in range(200)]  # neighbours share 118 of 130 words
    expected = slow_join(docs)
    written = {}
    plain = j.stored

    def noted(df, name, *metrics):
        out, seen = plain(df, name, *metrics)
        written[name] = seen["rows"]
        return out, seen

    monkeypatch.setattr(j, "stored", noted)
    got = {r.doc_id: (r.class_id, r.n_links) for r in j.join(odd.documents(spark, [(k, t, "en", "s") for k, t in docs])).collect()}
    assert got == expected and len({c for c, _ in expected.values()}) == 1
    assert written["outlasting"] <= 8 * len(docs)  # all pairs of the 50 blocks would take 50 copies of each


def test_one_group_of_many_near_copies(spark, monkeypatch):
    """Links of every node of a group of 5,200 texts, each a base with one word of its own: all are linked."""
    base = [f"b{k}" for k in range(60)]
    docs = [(k, " ".join([*base, f"own{k}"])) for k in range(5200)]
    got = j.join(odd.documents(spark, [(k, t, "en", "s") for k, t in docs])).groupBy(
        "class_id", "n_links", "n_text_links").count().collect()
    assert [tuple(r) for r in got] == [(0, 5199, 5199, 5200)]


def test_both_ways_to_count_agree():
    random.seed(5)
    universe = np.arange(1, 3000, dtype=np.uint64)
    block = j.Block.__new__(j.Block)
    block.codes = [np.sort(np.random.default_rng(k).choice(universe, 200, replace=False)) for k in range(40)]
    block.sizes = np.full(40, 200)
    i, k = np.nonzero(np.triu(np.ones((40, 40), bool), 1))
    truth = [len(np.intersect1d(block.codes[a], block.codes[b])) for a, b in zip(i, k)]
    assert j.common_counts(block, block, i, k).tolist() == truth
    few = slice(0, 3)
    assert j.common_counts(block, block, i[few], k[few]).tolist() == truth[few]


def test_pruning_keeps_pairs_at_the_threshold():
    least = j.least_matches()
    assert len(least) == j.HASHES // j.STEP and least == sorted(least)
    random_ = np.random.default_rng(0)
    matches = random_.random((20_000, j.HASHES)) < 0.8
    counts = matches.cumsum(axis=1)[:, j.STEP - 1 :: j.STEP]
    assert (counts >= np.array(least)).all(axis=1).mean() > 0.9999


def test_odd_rows(spark):
    docs = odd.documents(spark)
    got = [(r.doc_id, r.class_id, r.n_links) for r in j.join(docs).collect()]
    assert len(got) == 13
    linked = sorted([g for g in got if g[2]], key=str)
    assert linked == sorted([(1, 1, 3), (1, 1, 3), (2, 1, 3), (None, 1, 3)], key=str)
    kept = j.keep_one(docs)
    assert kept.columns == docs.columns
    texts = [r.text for r in kept.collect()]
    assert texts.count(odd.PLAIN) == 1 and texts.count(None) == 2 and len(texts) == 10
    assert j.join(odd.empty(spark)).count() == j.keep_one(odd.empty(spark)).count() == 0
