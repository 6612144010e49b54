import random

from pyspark.sql import functions as F

import corpus_pipeline
from emberfold.llm.common import stored

from . import odd
from .test_decontaminate import planted, prose


def stages(spark, docs, folder):
    out = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs.columns
        docs, _ = stored(stage(spark, docs, folder), "stage")
        if name != "mixing":
            assert docs.columns == before
        out.append(docs)
    return out


def benchmark(spark, tmp_path, items):
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_each_stage_takes_effect(spark, tmp_path):
    items, leaking = planted()
    folder = benchmark(spark, tmp_path, items)
    passage = " ".join(f"shared{k}" for k in range(60))
    docs = leaking[:20] + [
        (100, "junk " * 200, "en", "s"), (101, "few words", "en", "s"),
        (102, " ".join(prose(7, 90)) + "\n" + passage, "en", "s"), (103, " ".join(prose(8, 90)) + "\n" + passage, "en", "t"),
        (104, " ".join(prose(9, 120)), "en", "t"), (105, " ".join(prose(9, 120)[:-1] + ["changed"]), "en", "t")]
    good, lines, single, clean, mixed = stages(spark, odd.documents(spark, docs), folder)
    assert {r.doc_id for r in good.collect()} == {d[0] for d in docs} - {100, 101}
    texts = {r.doc_id: r.text for r in lines.collect()}
    assert texts[102].endswith(passage) and texts[103] == " ".join(prose(8, 90))
    assert {r.doc_id for r in single.collect()} == set(texts) - {105}
    assert {r.doc_id for r in clean.collect()} == set(range(15, 20)) | {102, 103, 104}
    taken = {r.doc_id: r.taken for r in mixed.collect()}
    assert set(taken) == set(range(15, 20)) | {102, 103, 104} and sum(taken.values()) > 0


def test_odd_rows_and_empty_tables(spark, tmp_path):
    folder = benchmark(spark, tmp_path, [(1, None), (None, "two words")])
    out = stages(spark, odd.documents(spark), folder)
    assert [df.count() for df in out][0] == 5
    assert [df.count() for df in stages(spark, odd.empty(spark), folder)] == [0] * 5


def test_run_equals_the_stages(spark, tmp_path):
    random.seed(2)
    items, docs = planted()
    folder = benchmark(spark, tmp_path, items)
    odd.documents(spark, docs).write.parquet(f"{folder}/documents.parquet")
    expected = stages(spark, odd.documents(spark, docs), folder)[-1]
    got = corpus_pipeline.run(spark, folder)
    assert sorted(got.collect()) == sorted(expected.collect())
    assert got.select(F.sum("taken")).first()[0] > 0
