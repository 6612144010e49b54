import random

from emberfold.llm import common
from emberfold.llm import line_dedup as d

from . import odd


def slow_dedup(docs):
    """All runs of all documents, first places by (id, line)."""
    first = {}
    lines = {k: t.split("\n") for k, t in docs}
    runs = []
    for doc, rows in lines.items():
        real = [k for k, line in enumerate(rows) if line.split()]
        for a in range(len(real)):
            words = 0
            for b in range(a, len(real)):
                words += len(rows[real[b]].split())
                if words >= d.RUN_WORDS:
                    key = tuple(" ".join(rows[k].split()) for k in real[a : b + 1])
                    place = (doc, real[a])
                    runs.append((key, place, doc, real[a], real[b]))
                    first[key] = min(first.get(key, place), place)
    gone = {(doc, k) for key, place, doc, a, b in runs if place > first[key] for k in range(a, b + 1)}
    return {doc: "\n".join(line for k, line in enumerate(rows) if (doc, k) not in gone) for doc, rows in lines.items()}


def test_equals_all_runs(spark):
    random.seed(3)
    pool = [" ".join(f"w{random.randrange(9)}" for _ in range(random.choice([1, 5, 12, 20, 30, 60]))) for _ in range(9)]
    docs = []
    for k in range(60):
        rows = [random.choice(pool) for _ in range(random.randint(1, 9))]
        rows = [random.choice(["", r, r.replace(" ", "  ")]) if random.random() < 0.2 else r for r in rows]
        docs.append((k, "\n".join(rows)))
    got = {r.doc_id: r.text for r in d.dedup(odd.documents(spark, [(k, t, "en", "s") for k, t in docs])).collect()}
    expected = slow_dedup(docs)
    assert got == expected
    assert any(got[k] != t for k, t in docs) and any(got[k] == t for k, t in docs)


def test_passages_go_and_clean_documents_stay(spark):
    passage = " ".join(f"shared{k}" for k in range(55))
    rows = [(k, f"start of {k} is its own\n{passage}\nend of {k}", "en", "s") for k in range(5)]
    rows.append((9, " ".join(f"only{k}" for k in range(80)), "en", "s"))
    got = {r.doc_id: (r.n, r.text) for r in d.dedup(odd.documents(spark, rows), "n").collect()}
    assert got[0] == (0, rows[0][1]) and got[9] == (0, rows[5][1])
    assert all(got[k] == (1, f"start of {k} is its own\nend of {k}") for k in range(1, 5))


def test_odd_rows(spark):
    docs = odd.documents(spark)
    out = d.dedup(docs)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id or 0), r.text) for r in out.where("text is not null").collect())
    # The plain text has over 50 words: its smallest id keeps it, in both of its equal rows.
    assert [t for k, t in got if k == 1].count(odd.PLAIN) == 2
    assert [t for k, t in got if k in (0, 2)] == ["", ""]
    assert (6, odd.LONG) in got and out.where("text is null").count() == 2
    assert d.dedup(odd.empty(spark)).count() == 0


def test_joins_without_a_broadcast_beyond_the_bytes(spark, monkeypatch):
    run = "\n".join(f"line {k} " + "word " * 12 for k in range(8))
    docs = odd.documents(spark, [(k, f"{run}\nown {k}", "en", "s") for k in range(4)])
    wide = {(r.doc_id, r.text) for r in d.dedup(docs).collect()}
    monkeypatch.setattr(common, "BROADCAST_BYTES", 3 * 8 * d.SPAN_BYTES // 2)
    assert {(r.doc_id, r.text) for r in d.dedup(docs).collect()} == wide
    assert common.lookup(docs, 1, common.BROADCAST_BYTES + 1) is docs
    assert len(wide) == 4 and sum(t.startswith("line") for _, t in wide) == 1
