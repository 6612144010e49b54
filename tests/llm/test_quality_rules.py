import math
import random

import numpy as np
import pytest

from emberfold.llm import quality_rules as q

from . import odd


def slow_statistics(text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text)]
    windows = [tuple(words[k:k + 5]) for k in range(len(words) - 4)]
    twice = {w for w in windows if windows.count(w) > 1}
    inside = {k + j for k, w in enumerate(windows) if w in twice for j in range(5)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if __import__("re").search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dups, len(inside)


def test_statistics_equal_a_slow_version():
    random.seed(4)
    for _ in range(200):
        text = "".join(random.choice(["a ", "b ", "é# ", "ab\n", "a b a b a\n", "\x0bc", " ", "|<"])
                       for _ in range(random.randrange(60)))
        assert q.text_statistics(text.encode()) == slow_statistics(text), text


def test_long_vocabularies_are_ranked_instead_of_packed():
    words = [b"w%d" % (k % 7000) for k in range(9000)]
    assert q.repeated_words(words) == 2 * 2000
    assert q.repeated_words([b"w%d" % k for k in range(9000)]) == 0


def test_chi_square_and_consistency():
    assert q.chi_square_share(11.0705, 5) == pytest.approx(0.95, abs=1e-5)
    assert q.consistency(0.75, 5) == pytest.approx(0.75 / q.chi_square_share(6.6257, 7), abs=1e-3)


def slow_verdicts(rows):
    """The estimate of one group, on plain arrays."""
    x = []
    for n, chars, symbols, dups, repeats in rows:
        w, c = max(n, 1), max(chars, 1)
        parts = [math.log1p(n), math.log((c + 5 * q.STEADY) / (w + q.STEADY)), math.log1p(1000 * symbols / c),
                 math.log1p(dups), math.log1p(100 * repeats / w)]
        x.append([math.floor(p * q.SCALE + 0.5) for p in parts])
    x = np.array(x, float)
    quartiles = np.percentile(x, [25, 50, 75], axis=0)
    centre = quartiles[1]
    inverse = np.diag(1 / np.maximum((quartiles[2] - quartiles[0]) / (1.349 * q.SCALE), q.FLOORS) ** 2)

    def distance():
        off = (x - centre) / q.SCALE
        return np.einsum("ki,ij,kj->k", off, inverse, off)

    for _ in range(q.STEPS):
        bins = np.floor(q.BINS * np.log(distance() + 1e-3))
        edge = np.sort(bins)[math.ceil(q.SUPPORT * len(x)) - 1]
        part = x[bins <= edge]
        centre = part.mean(axis=0)
        cov = np.cov(part.T, bias=True) * q.consistency(q.SUPPORT, q.P) / q.SCALE**2
        inverse = np.linalg.inv(cov + np.diag(np.square(q.FLOORS)))
    return distance()


def test_verdicts_equal_a_plain_estimate(spark):
    random.seed(1)
    texts = []
    for k in range(120):
        words = ["".join(random.choice("abcdefgh") for _ in range(random.randint(2, 8))) for _ in range(random.randint(20, 300))]
        if k % 12 == 0:
            words = [w + "###" for w in words]
        texts.append(" ".join(words))
    docs = odd.documents(spark, [(k, t, "en", "s") for k, t in enumerate(texts)])
    got = {r.doc_id: r for r in q.rate(docs).collect()}
    expected = slow_verdicts([slow_statistics(t) for t in texts])
    for k, d in enumerate(expected):
        assert got[k].distance == pytest.approx(d, rel=1e-6, abs=1e-5)
        assert got[k].kept == (d <= q.CUT) == (k % 12 != 0)


def test_odd_rows(spark):
    got = q.rate(odd.documents(spark)).collect()
    assert len(got) == 13
    by_id = {r.doc_id: r for r in got if r.doc_id not in (1, None)}
    assert [by_id[k].base_failed for k in (3, 4, 5, 6, 7)] == [True, True, True, False, True]
    assert by_id[6].n_words == 30_000 and by_id[6].kept and by_id[6].distance is None
    kept = q.keep_good(odd.documents(spark))
    assert kept.columns == odd.documents(spark).columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 1, 2, 6]
    assert q.rate(odd.empty(spark)).count() == q.keep_good(odd.empty(spark)).count() == 0
