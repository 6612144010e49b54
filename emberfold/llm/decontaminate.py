"""Benchmark decontamination: a count of shared word pairs finds passages, Smith-Waterman alignment scores them.

Words are compared without case and ASCII punctuation. The score of a document and an item is that of
their best local alignment (match 1, mismatch and gap -1) as a share of the item's words. A document
leaks an item from `THRESHOLD` on: half of the item verbatim, or all of it with a quarter of the words
changed.

No such alignment is missed. One of m matches and e errors scores m - e >= n / 2 for an item of n words,
its matches form e + 1 runs at most, so m - e - 1 pairs of neighbouring words or more are shared, and
m + e <= n + n / 2 words of the text are spanned: `needed(n)` shared pairs within `span(n)` words. A pass
over the documents keeps the pairs that a bitmap of the benchmark's pairs lets through (`BITMAP_BITS`
bits at any benchmark size) where they lie that close for some length of item, and the words around them.
Counting them gives the frequency of every pair in the corpus. Of an item's pairs, all but the
`needed(n) - 1` most frequent become seeds: any `needed(n)` of its pairs hold one of them. Seeds joined
with the passages give pairs of passage and item; those that share enough are aligned.

A passage that a third of the documents share gives one row per document and item; the seed side of
the join is unique per code and item, and Spark splits such skewed joins.

Defined cases: null or empty texts and items match nothing, nor do items of less than `LEAST` words;
rows repeating id and text are reported as often as they occur; items with equal texts are all
reported. Empty tables give no rows.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberfold.llm.common import doc_key, lookup, prepare, real_id, split_by_keys, stored, text_tie
from emberfold.llm.words import Words, ngrams

GRAM = 2
LEAST = 4
THRESHOLD = 0.5
BAND = 1.1  # lengths of items within this factor are looked for together
BITMAP_BITS = 24
BUCKET = 32768  # bits that one row of Spark's bitmap functions holds
CELLS = 2_000_000

_SPACES = bytes.maketrans(string.punctuation.encode() + bytes(range(32)), b" " * (len(string.punctuation) + 32))


def normal_words(text: bytes) -> list[bytes]:
    return text.decode("utf-8", "replace").lower().encode().translate(_SPACES).split()


def needed(words: int) -> int:
    """Least number of pairs that a leaked item of so many words shares with the text."""
    return max((words + 1) // 2 - 1, 1)


def span(words: int) -> int:
    """Most words of the text that the alignment of a leaked item of so many words takes."""
    return words + words // 2


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = Words()
    for batch in batches:
        packed, codes = [], []
        for text in batch.column("text"):
            found = words.hashes(normal_words(text.as_py() or b""))
            packed.append(found.tobytes())
            codes.append((ngrams(found, GRAM) if len(found) >= LEAST else found[:0]).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column("item_id"), pa.array(packed, pa.binary()), pa.array(codes, pa.list_(pa.int64()))],
            names=["item_id", "item_words", "codes"])


def _bitmap(spark: SparkSession, codes: DataFrame) -> np.ndarray:
    """One flag per value of the first BITMAP_BITS bits of a code; bounded at any number of codes."""
    bit = F.shiftrightunsigned("code", 64 - BITMAP_BITS)
    rows = codes.select(bit.alias("bit")).groupBy((F.col("bit") / BUCKET).cast("long").alias("bucket")).agg(
        F.bitmap_construct_agg(F.col("bit") % BUCKET).alias("bits")).collect()
    flags = np.zeros((1 << BITMAP_BITS) // 8, np.uint8)
    for row in rows:
        at = row.bucket * BUCKET // 8
        flags[at : at + BUCKET // 8] = np.frombuffer(bytes(row.bits), np.uint8)
    return flags


def _close(at: np.ndarray, bands: list[tuple[int, int]]) -> np.ndarray:
    """Those of the places that lie in a group close enough for an item of some band (least, most words)."""
    edges = np.zeros(len(at) + 1, np.int64)
    for least, most in bands:
        some = needed(least)
        first = np.flatnonzero(at[some - 1 :] - at[: max(len(at) - some + 1, 0)] + GRAM <= span(most))
        edges[: len(at)] += np.bincount(first, minlength=len(at))
        edges -= np.bincount(first + some, minlength=len(at) + 1)
    return at[np.cumsum(edges[:-1]) > 0]


def _hits(flags: object, bands: list[tuple[int, int]]):
    """Passages around the benchmark's pairs of words where enough of them are close together."""
    margin = span(max((most for _, most in bands), default=0))
    names = ["doc", "tie", "words", "codes"]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, bits = Words(), flags.value
        shift = np.uint64(64 - BITMAP_BITS)
        for batch in batches:
            rows = []
            for doc, tie, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if not text:
                    continue
                found = words.hashes(normal_words(text))
                codes = ngrams(found, GRAM)
                bit = (codes >> shift).astype(np.int64)
                at = np.flatnonzero(bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
                at = _close(at, bands)
                if len(at):
                    for group in np.split(at, np.flatnonzero(np.diff(at) > 2 * margin) + 1):
                        low, high = max(group[0] - margin, 0), group[-1] + GRAM + margin
                        rows.append((doc, tie, found[low:high].tobytes(), np.unique(codes[group]).view(np.int64)))
            columns = zip(*rows) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return search


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> np.ndarray:
    """Best local alignment score of each item with its passage, many pairs at a time."""
    best = np.zeros(len(items), np.int32)
    sizes = [len(a) * len(b) for a, b in zip(items, passages)]
    order = sorted((k for k in range(len(items)) if sizes[k]), key=sizes.__getitem__)
    good, bad = np.int32(1), np.int32(-1)
    while order:
        # Pairs of like size share a batch, so little of it is padding.
        some = [k for k in order[-max(1, CELLS // len(passages[order[-1]])) :] if 2 * sizes[k] >= sizes[order[-1]]]
        del order[-len(some) :]
        height, width = max(len(items[k]) for k in some), max(len(passages[k]) for k in some)
        text, item = np.zeros((len(some), width), np.uint64), np.ones((len(some), height), np.uint64)
        for row, k in enumerate(some):  # the paddings never match
            text[row, : len(passages[k])] = passages[k]
            item[row, : len(items[k])] = items[k]
        steps = np.arange(1, width + 1, dtype=np.int32)
        above = np.zeros((len(some), width + 1), np.int32)
        top = np.zeros(len(some), np.int32)
        for k in range(height):
            row = above[:, :-1] + np.where(text == item[:, k, None], good, bad)
            np.maximum(row, above[:, 1:] - 1, out=row)
            np.maximum(row, 0, out=row)
            row += steps
            np.maximum.accumulate(row, axis=1, out=row)
            row -= steps
            np.maximum(top, row.max(axis=1), out=top)
            above[:, 1:] = row
        best[some] = top
    return best


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        items = [np.frombuffer(x, np.uint64) for x in batch.column("item_words").to_pylist()]
        passages = [np.frombuffer(x, np.uint64) for x in batch.column("words").to_pylist()]
        some = [k for k, (item, passage) in enumerate(zip(items, passages))
                if np.isin(ngrams(item, GRAM), ngrams(passage, GRAM)).sum() >= needed(len(item))]
        items, passages = [items[k] for k in some], [passages[k] for k in some]
        scores = align(items, passages) / np.array([len(x) for x in items], float)
        keys = batch.select(["doc", "tie", "item"]).take(pa.array(some, pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [*keys.columns, pa.array(scores, pa.float64())], names=["doc", "tie", "item", "score"])


def scores(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc, tie, item, score) of documents and items that share enough pairs, and the items by number."""
    spark = prepare(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"))
    items, seen = stored(
        items.mapInArrow(_items, "item_id long, item_words binary, codes array<long>").withColumn(
            "item", F.monotonically_increasing_id()), "items", F.sum(F.length("item_words")).alias("bytes"))
    grams = items.select("item", F.posexplode("codes").alias("at", "code"))
    flags = spark.sparkContext.broadcast(_bitmap(spark, grams))
    length = F.size("codes") + (GRAM - 1)
    bands = [(row.least, row.most) for row in items.where(F.size("codes") > 0).groupBy(
        F.floor(F.log(length) / math.log(BAND)).alias("band")).agg(
        F.min(length).alias("least"), F.max(length).alias("most")).collect()]
    texts = docs.select(doc_key().alias("doc"), text_tie().alias("tie"), F.col("text").cast("binary").alias("text"))
    passages, _ = stored(texts.mapInArrow(
        _hits(flags, bands), "doc long, tie long, words binary, codes array<long>").withColumn(
            "passage", F.monotonically_increasing_id()), "passages")
    hits = passages.select("passage", F.explode("codes").alias("code"))
    frequency = hits.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    # Any needed(n) of the n - 1 pairs of an item hold one of all but the needed(n) - 1 most frequent.
    known = grams.join(frequency, "code", "left").groupBy("item").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "at", "code"))).alias("rising"))
    pairs_of = F.size("rising")
    rarest = pairs_of - F.greatest(F.floor((pairs_of + GRAM) / 2).cast("int") - 1, F.lit(1)) + 1
    seeds = known.select("item", F.explode(F.slice("rising", F.lit(1), rarest)).alias("seed")).where(
        "seed.n > 0").select("item", "seed.code").distinct()
    seeds, counted = stored(seeds, "seeds")
    pairs = hits.join(lookup(seeds, counted["rows"]), "code").select("passage", "item").distinct()
    aligned = passages.drop("codes").join(pairs, "passage").join(
        lookup(items.select("item", "item_words"), seen["rows"], seen["bytes"]), "item")
    return aligned.select("doc", "tie", "item", "item_words", "words").mapInArrow(
        _score, "doc long, tie long, item long, score double"), items.select("item", "item_id")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id and score of every document that holds enough of an item."""
    scored, items = scores(docs, benchmark)
    found = scored.groupBy("doc", "tie", "item").agg(F.max("score").alias("score")).where(F.col("score") >= THRESHOLD)
    return found.join(items, "item").select(
        real_id("doc").alias("doc_id"), "item_id", F.round("score", 6).alias("score"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs`, with all their columns, that leak no item."""
    scored, _ = scores(docs, benchmark)
    leaking, seen = stored(scored.where(F.col("score") >= THRESHOLD).select("doc", "tie").distinct(), "leaking")
    return split_by_keys(docs, leaking, seen["rows"], "left_anti")
