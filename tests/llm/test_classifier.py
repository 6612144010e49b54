import random

import numpy as np
from pyspark.sql import Row
from pyspark.sql import functions as F

from emberfold.llm import classifier as c
from emberfold.llm.common import table

from . import odd


def test_gradients_equal_differences():
    random_ = np.random.default_rng(1)
    w = {k: v.astype(float) for k, v in c.initial(random_).items()}
    block, owner, label = random_.integers(0, 256, (5, c.CHUNK)).astype(np.uint8), np.array([0, 0, 1, 1, 1]), np.array([0.0, 1.0])
    _, g = c.gradients(w, block, owner, label)
    for name, weights in w.items():
        at = np.unravel_index(np.abs(g[name]).argmax(), weights.shape)
        kept = weights[at]
        losses = []
        for weights[at] in (kept + 1e-5, kept - 1e-5):
            losses.append(c.gradients(w, block, owner, label)[0])
        weights[at] = kept
        assert abs((losses[0] - losses[1]) / 2e-5 - g[name][at]) < 1e-5 + 1e-3 * abs(g[name][at])


def test_chunks_cover_all_bytes():
    for n in (0, 1, 63, 64, 65, 511, 512, 513, 960, 961, 5000):
        data = bytes(random.Random(n).randrange(1, 256) for _ in range(n))
        found = c.chunks(data)
        joined = found[0].tobytes() + b"".join(x[c.OVERLAP :].tobytes() for x in found[1:])
        assert joined.rstrip(b"\0") == data and len(joined) - len(data) <= c.CHUNK
    assert len(c.chunks(b"x" * 100_000)) == 224


def test_score_of_a_long_text_equals_that_of_all_chunks_at_once(monkeypatch):
    w = c.initial(np.random.default_rng(3))
    text = bytes(random.Random(3).randrange(256) for _ in range(20_000))
    whole = c.score_text(w, text)
    monkeypatch.setattr(c, "SCORE_CHUNKS", 3)
    assert abs(c.score_text(w, text) - whole) < 1e-6


def test_gradients_do_not_depend_on_how_many_chunks_are_held(monkeypatch):
    random_ = np.random.default_rng(4)
    w = c.initial(random_)
    block = random_.integers(0, 256, (23, c.CHUNK)).astype(np.uint8)
    owner, label = np.repeat(np.arange(4), [1, 15, 2, 5]), np.array([0.0, 1.0, 1.0, 0.0])
    loss, whole = c.gradients(w, block, owner, label)
    for held in (1, 4, 22):
        monkeypatch.setattr(c, "SCORE_CHUNKS", held)
        again, parts = c.gradients(w, block, owner, label)
        assert abs(loss - again) < 1e-5
        assert all(np.allclose(parts[k], whole[k], rtol=1e-3, atol=1e-5) for k in whole)


def test_training_reads_every_chunk_of_every_example(monkeypatch):
    monkeypatch.setattr(c, "MIN_STEPS", 0)
    monkeypatch.setattr(c, "EPOCHS", 1)
    read, gradients = [], c.gradients
    monkeypatch.setattr(c, "gradients", lambda w, block, *rest: read.append(block.copy()) or gradients(w, block, *rest))
    examples = [(random.Random(k).randbytes(700 * k * k), k % 2) for k in range(8)]  # up to 77 chunks
    c.train(examples, 0.5)
    want = sorted(piece.tobytes() for text, _ in examples for piece in c.chunks(text))
    assert sorted(piece.tobytes() for block in read for piece in block) == want


def test_the_sample_takes_whole_texts_within_its_bytes():
    rows = [Row(doc_id=k, quality=k % 2, size=size, tie=-k) for k, size in enumerate([10, 10, 500, 60, 30, 30, 0, 200])]
    taken = c.within(rows, 100)
    assert sorted(t[0] for t in taken) == [0, 1, 3, 4, 5, 6]


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    scored = c.classify(docs, labels)
    rows = scored.join(labels, "doc_id").where("held_out").select("score", "predicted", "quality").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.93
    kept = scored.join(docs.select("doc_id"), "doc_id", "left_semi")
    assert kept.where((F.crc32(F.col("doc_id").cast("string")) % 5 == 0) != F.col("held_out")).count() == 0


def test_odd_rows(spark):
    docs = odd.documents(spark)
    labels = spark.createDataFrame(
        [(1, 1, 0), (2, 0, 0), (2, 1, 0), (None, 1, 0), (6, 0, 0), (8, None, 0), (99, 1, 0)],
        "doc_id long, quality int, toxic int")
    for known in (labels, labels.where("quality = 1"), labels.where("false")):
        got = c.classify(docs, known).collect()
        assert len(got) == 13 and all(0 <= r.score <= 1 and r.predicted == (r.score >= c.CUT) for r in got)
    assert {r.score for r in got} == {0.5}
    assert c.classify(odd.empty(spark), labels).count() == 0
