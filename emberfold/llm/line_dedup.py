"""Line dedup by winnowing: delete later repeats of runs of lines that hold at least `RUN_WORDS` words.

A document is the sequence of its lines that hold a word, compared without differences in white
space. From every line starts one gram (the fewest lines with `GRAM_WORDS` words) and one window
(the fewest lines with `RUN_WORDS` words). Each window selects the smallest hash of the grams inside
it as its fingerprint (Schleimer, Wilkerson and Aiken, 2003, with windows measured in words), so any
run that is long enough to count has a fingerprint, and both copies of it select the same one.

Fingerprints at one position only are dropped first. The positions of the others are joined and
extended both ways: to every shortest run of at least `RUN_WORDS` words around a fingerprint, which
either starts with a full window or cannot lose its first line. Longer repeats are unions of these.
A run is deleted where equal lines come earlier, by document id, then text hash, then line. This
finds exactly the lines that lie in a repeated run of enough words, whichever document it repeats.

A fingerprint or run that a third of all documents share is aggregated map-side to its count and first
position. These are stored, so keys with more than a thousandth of the rows are known, at most a thousand,
and are joined back by broadcast: their rows never meet in one task.

Defined cases: null and empty texts stay as they are; lines without a word are never compared, but
go if they lie inside a deleted run; rows repeating both id and text are one document and keep the
same lines; a run may overlap its first occurrence; a document may lose all lines and then has an
empty text. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberfold.operators.joins import join_lookup
from emberfold.llm.common import doc_key, lookup, prepare, spare, stored, text_tie

RUN_WORDS = 50
SPAN_BYTES = 32  # of one span in an array of Spark
GRAM_WORDS = 25

SCHEMA = "doc long, tie long, print binary, at int, run binary, first int, last int"


def runs_of(text: bytes, run_words: int = RUN_WORDS, gram_words: int = GRAM_WORDS) -> list[tuple]:
    """(fingerprint, its line, run, first line, last line) of every shortest run of a text."""
    digests, places, words = [], [], [0]
    for place, line in enumerate(text.split(b"\n")):
        tokens = line.split()
        if tokens:
            digests.append(xxhash.xxh3_128_digest(b" ".join(tokens)))
            places.append(place)
            words.append(words[-1] + len(tokens))
    if words[-1] < run_words:
        return []
    total, n = np.array(words), len(digests)

    def digest(a: int, b: int) -> bytes:
        return digests[a] if a == b else xxhash.xxh3_128_digest(b"".join(digests[a : b + 1]))

    gram_ends = (np.searchsorted(total, total[:n] + gram_words) - 1).tolist()
    run_ends = (np.searchsorted(total, total[:n] + run_words) - 1).tolist()
    # Last line from which a run up to line b still has enough words, for b = 0 .. n - 1.
    run_starts = (np.searchsorted(total, total[1:] - run_words, side="right") - 1).tolist()
    grams: dict[int, bytes] = {}

    def gram(j: int) -> bytes:
        if j not in grams:
            grams[j] = digest(j, gram_ends[j])
        return grams[j]

    spans = {(a, e) for a, e in enumerate(run_ends) if e < n}
    spans |= {(a, b) for b, a in enumerate(run_starts) if a >= 0}
    selected: dict[int, int] = {}
    out = []
    for a, b in sorted(spans):
        if a not in selected:
            inside = [a]
            while inside[-1] + 1 < n and gram_ends[inside[-1] + 1] <= run_ends[a]:
                inside.append(inside[-1] + 1)
            selected[a] = min(inside, key=lambda j: (gram(j), -j))
        at = selected[a]
        out.append((gram(at), at, digest(a, b), places[a], places[b]))
    return out


def _list_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.int32(), pa.int32()]
    names = ["doc", "tie", "print", "at", "run", "first", "last"]
    for batch in batches:
        rows = []
        for doc, tie, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if text:
                rows += [(doc, tie, *found) for found in runs_of(text)]
        columns = zip(*rows) if rows else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def later_runs(docs: DataFrame) -> DataFrame:
    """(doc, tie, first, last): the lines of each run that repeats an earlier one."""
    texts = docs.select(doc_key().alias("doc"), text_tie().alias("tie"), F.col("text").cast("binary"))
    runs, listed = stored(texts.mapInArrow(_list_runs, SCHEMA), "runs")
    differ = [F.min(c) != F.max(c) for c in ("doc", "tie", "at")]
    rows = F.count(F.lit(1)).alias("rows")
    repeated, _ = stored(runs.groupBy("print").agg((differ[0] | differ[1] | differ[2]).alias("many"), rows).where(
        "many").select("print", "rows"), "prints")
    matched, held = stored(join_lookup(runs, repeated, "print", listed["rows"], "left_semi", "rows").select(
        "run", "doc", "tie", "first", "last"), "matched")
    place = F.struct("doc", "tie", "first")
    earliest, _ = stored(matched.groupBy("run").agg(F.min(place).alias("origin"), F.max(place).alias("end"), rows).where(
        "origin < end").select("run", "origin", "rows"), "origins")
    return join_lookup(matched, earliest, "run", held["rows"], count="rows").where(place > F.col("origin")).select(
        "doc", "tie", "first", "last")


def _without_runs(text: pd.Series, spans: pd.Series) -> pd.DataFrame:
    texts, deleted = [], []
    for t, found in zip(text, spans):
        if t is None or found is None:
            texts.append(t)
            deleted.append(0)
            continue
        lines = t.split("\n")
        edges = np.zeros(len(lines) + 1, np.int64)
        for span in found:
            edges[span["first"]] += 1
            edges[span["last"] + 1] -= 1
        gone = np.cumsum(edges[:-1]) > 0
        texts.append("\n".join(line for line, out in zip(lines, gone) if not out))
        deleted.append(int(gone.sum()))
    return pd.DataFrame({"text": texts, "lines_deleted": deleted})


def dedup(docs: DataFrame, count_column: str | None = None) -> DataFrame:
    """`docs` with later repeats cut out of `text`; `count_column` adds the number of deleted lines."""
    prepare(docs.sparkSession)
    doc, tie, spans, result = spare(docs, "run_doc", "run_tie", "run_spans", "run_result")
    cuts, seen = stored(later_runs(docs).groupBy("doc", "tie").agg(
        F.collect_set(F.struct("first", "last")).alias("spans")), "cuts", F.sum(F.size("spans")).alias("spans"))
    cuts = lookup(cuts.select(F.col("doc").alias(doc), F.col("tie").alias(tie), F.col("spans").alias(spans)), seen["rows"],
                  SPAN_BYTES * (seen["spans"] or 0))
    joined = docs.withColumns({doc: doc_key(), tie: text_tie()}).join(cuts, [doc, tie], "left")
    cut = F.pandas_udf(_without_runs, "struct<text: string, lines_deleted: int>")
    changed = joined.withColumn(result, cut(F.col("text"), F.col(spans)))
    columns = [F.col(result)["text"].alias("text") if c.lower() == "text" else F.col(f"`{c}`") for c in docs.columns]
    if count_column:
        columns.append(F.col(result)["lines_deleted"].alias(count_column))
    return changed.select(*columns)
