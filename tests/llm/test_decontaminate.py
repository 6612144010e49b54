import random

import numpy as np

from emberfold.llm import decontaminate as d

from . import odd


def slow_align(item, text):
    best, above = 0, [0] * (len(text) + 1)
    for a in item:
        row = [0]
        for k, b in enumerate(text):
            row.append(max(0, above[k] + (1 if a == b else -1), above[k + 1] - 1, row[k] - 1))
            best = max(best, row[-1])
        above = row
    return best


def test_alignment_equals_the_plain_recurrence(monkeypatch):
    random.seed(6)
    draw = np.random.default_rng(6)
    items = [draw.integers(10, 15, draw.integers(1, 30)).astype(np.uint64) for _ in range(80)]
    texts = [draw.integers(10, 15, draw.integers(1, 90)).astype(np.uint64) for _ in range(80)]
    expected = [slow_align(a.tolist(), b.tolist()) for a, b in zip(items, texts)]
    for cells in (d.CELLS, 200):
        monkeypatch.setattr(d, "CELLS", cells)
        assert d.align(items, texts).tolist() == expected


def prose(seed, n):
    draw = random.Random(seed)
    return [f"{draw.choice('bcdfg')}{draw.randrange(3000)}" for _ in range(n)]


def planted():
    items = [(k, " ".join(prose(k, 40))) for k in range(5)]
    docs = []
    for k in range(40):
        own = prose(1000 + k, 200)
        if k < 5:  # verbatim, with other case and punctuation
            own[50:50] = [w.upper() + "," for w in items[k][1].split()]
        elif k < 10:  # every seventh word changed
            own[0:0] = [w if j % 7 else f"new{j}" for j, w in enumerate(items[k - 5][1].split())]
        elif k < 15:  # words left out and put in
            words = items[k - 10][1].split()
            own += [x for j, w in enumerate(words) if j % 9 for x in ([w, "extra"] if j % 11 == 0 else [w])]
        docs.append((k, " ".join(own), "en", "s"))
    return items, docs


def test_planted_items_are_found_and_clean_documents_stay(spark):
    items, docs = planted()
    table, benchmark = odd.documents(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.score for r in d.leaks(table, benchmark).collect()}
    assert set(found) == {(k, k % 5) for k in range(15)}
    words = {k: d.normal_words(t.encode()) for k, t, *_ in docs}
    for (doc, item), score in found.items():
        wanted = d.normal_words(items[item][1].encode())
        assert abs(score - slow_align(wanted, words[doc]) / len(wanted)) < 1e-6
    assert {r.doc_id for r in d.keep_clean(table, benchmark).collect()} == set(range(15, 40))


def test_seed_of_an_item_whose_words_are_all_common(spark):
    items, _ = planted()
    docs = [(k, items[0][1] + f" tail {k}", "en", "s") for k in range(30)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert d.leaks(odd.documents(spark, docs), benchmark).count() == 30


def test_every_edited_copy_beside_a_verbatim_one_is_found(spark):
    items = [(k, " ".join(prose(40 + k, n))) for k, n in enumerate((15, 20, 33, 47, 59))]
    texts = []
    for _, text in items:
        words = text.split()
        texts.append(words)
        for step in range(4, 11):
            for start in range(step):
                texts.append([f"new{j}" if j % step == start else w for j, w in enumerate(words)])
        for step in range(2, 6):
            texts.append([x for j, w in enumerate(words) for x in ([w] if j % step else [w, f"more{j}"])])
            texts.append([w for j, w in enumerate(words) if j % step])
        texts.append(words[: len(words) // 2 + 1])
    docs = [(k, " ".join(prose(5000 + k, 20) + words + prose(9000 + k, 20)), "en", "s") for k, words in enumerate(texts)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.score for r in d.leaks(odd.documents(spark, docs), benchmark).collect()}
    hashes = d.Words().hashes
    wanted = [hashes(d.normal_words(t.encode())) for _, t in items]
    held = [hashes(d.normal_words(t.encode())) for _, t, *_ in docs]
    expected = {}
    for item, words in enumerate(wanted):
        for doc, best in enumerate(d.align([words] * len(held), held).tolist()):
            if 2 * best >= len(words):
                expected[doc, item] = round(best / len(words), 6)
    assert found == expected and len(found) > 200


def test_odd_rows(spark):
    schema = "item_id long, text string, doc string, words string"
    benchmark = spark.createDataFrame(
        [(1, odd.PLAIN, None, None), (1, odd.PLAIN, None, None), (None, odd.PLAIN, None, None), (2, None, None, None),
         (3, "", None, None), (4, "one two", None, None), (5, " ".join(odd.LONG.split()[:6000]), None, None)], schema)
    docs = odd.documents(spark)
    got = [(r.doc_id, r.item_id) for r in d.leaks(docs, benchmark).collect()]
    assert set(got) == {(k, i) for k in (1, 2, None) for i in (1, None)} | {(6, 5)}
    kept = d.keep_clean(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == 8
    none = spark.createDataFrame([], schema)
    assert d.leaks(docs, none).count() == d.leaks(odd.empty(spark), benchmark).count() == 0
    assert d.keep_clean(docs, none).count() == 13 and d.keep_clean(odd.empty(spark), none).count() == 0
