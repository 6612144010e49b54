"""N-gram Jaccard join: documents whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

Documents with equal shingle sets form one node. Nodes that share a band of MinHash values are
candidates. Inside a candidate group, pairs are compared a few MinHash values at a time, and a pair
is dropped as soon as the posterior probability that its similarity reaches the threshold falls
below `TOLERANCE` (Satuluri and Parthasarathy, 2012, with a uniform prior); the pairs left are
verified exactly on the whole sets.

No table of pairs is made. Buckets become star edges, their connected components are candidate
groups, and a group is cut into blocks of bounded size. A node goes to a pair of blocks only where it
shares a band with a node of the other block; each such pair of blocks is one group of rows for
Spark. First the MinHash values alone are compared, 288 bytes a node; sets of shingles are made and
sent only for nodes with a pair that outlasts this, and only to those pairs of blocks. Verification
returns, per node, its links and one node it is connected to. Counts are summed and components of the
verified links closed afterwards, so a group of any size is spread over many tasks and nothing is
capped. A pair at exactly 0.8 shares no band with probability 3e-6, a pair at 0.85 with 1e-8.

Defined cases: words are separated by ASCII white space; a text of one to four words is one shingle;
null or empty texts have no links and a class of their own; rows with equal texts, repeated rows
too, are linked with each other; the class id is the smallest doc_id of the class (null if all are
null). An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberfold.llm.common import (
    doc_key, lookup, prepare, real_id, spare, split_by_keys, stored, text_tie)
from emberfold.llm.words import Words, ngrams
from emberfold.operators.components import connected_components
from emberfold.operators.joins import join_lookup

SHINGLE = 5
NUMERATOR, DENOMINATOR = 4, 5  # the threshold, 0.8
BANDS, ROWS = 24, 4
HASHES = BANDS * ROWS
STEP = 16
TOLERANCE = 1e-6
BLOCK_NODES = 1024
BLOCK_SHINGLES = 1_000_000
SEED = 7919

_draw = np.random.default_rng(SEED)
FACTORS = (_draw.integers(0, 1 << 31, HASHES, dtype=np.uint32) * 2 + 1).astype(np.uint32)[:, None]
OFFSETS = _draw.integers(0, 1 << 32, HASHES, dtype=np.uint32)[:, None]
BAND_FACTORS = (_draw.integers(0, 1 << 62, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1))


def least_matches() -> list[int]:
    """Matches that a pair needs after n values for the posterior to stay above the tolerance.

    Values are compared by their last byte, so unequal ones agree with probability 1/256. With a
    uniform prior on the match rate, P(rate >= r | m of n) = P(Binomial(n + 1, r) <= m).
    """
    rate = NUMERATOR / DENOMINATOR
    rate += (1 - rate) / 256
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        below, m = 0.0, -1
        while True:
            term = math.comb(n + 1, m + 1) * rate ** (m + 1) * (1 - rate) ** (n - m)
            if below + term > TOLERANCE:
                break
            below, m = below + term, m + 1
        out.append(m + 1)
    return out


def shingles(text: bytes | None, words: Words) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    found = words.hashes(text.split()) if text else np.empty(0, np.uint64)
    if not len(found):
        return found
    codes = ngrams(found, min(SHINGLE, len(found)))
    return np.unique(codes)


def sketch(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """MinHash values reduced to their last byte, and a hash of each band of them."""
    least = np.full(HASHES, np.uint32(0xFFFFFFFF))
    low = codes.astype(np.uint32)
    for a in range(0, len(low), 4096):
        np.minimum(least, (FACTORS * low[None, a : a + 4096] + OFFSETS).min(axis=1), out=least)
    mixed = least ^ (least >> np.uint32(15))
    bands = (least.reshape(BANDS, ROWS).astype(np.uint64) * BAND_FACTORS).sum(axis=1, dtype=np.uint64)
    bands ^= bands >> np.uint64(31)
    bands += np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mixed.astype(np.uint8), bands.view(np.int64)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = Words()
    for batch in batches:
        digests, sizes, marks, bands = [], [], [], []
        for text in batch.column("text"):
            codes = shingles(text.as_py(), words)
            mark, band = sketch(codes) if len(codes) else (None, None)
            sizes.append(len(codes))
            digests.append(xxhash.xxh3_128_digest(codes.tobytes()) if len(codes) else None)
            marks.append(mark.tobytes() if len(codes) else None)
            bands.append(band if len(codes) else [])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc"), batch.column("tie"), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()),
             pa.array(marks, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
            names=["doc", "tie", "digest", "size", "marks", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = Words()
    for batch in batches:
        codes = [shingles(text.as_py(), words).tobytes() for text in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(codes, pa.binary())], names=["node", "codes"])


class Block:
    """Nodes of one block: their MinHash values and bands, and their sets where `frame` has them."""

    def __init__(self, frame: pd.DataFrame) -> None:
        self.nodes = frame["node"].to_numpy(np.int64)
        self.sizes = frame["size"].to_numpy(np.int64)
        self.copies = frame["copies"].to_numpy(np.int64)
        self.marks = np.frombuffer(b"".join(frame["marks"]), np.uint8).reshape(-1, HASHES)
        self.bands = np.array(frame["bands"].tolist(), np.int64).reshape(-1, BANDS)
        self.codes = [np.frombuffer(c, np.uint64) for c in frame["codes"]] if "codes" in frame else []


def candidates(a: Block, b: Block, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that share a band and outlast the incremental comparison."""
    shared = np.zeros((len(a.nodes), len(b.nodes)), bool)
    for k in range(BANDS):
        shared |= a.bands[:, k, None] == b.bands[None, :, k]
    if same:
        shared = np.triu(shared, 1)
    small, large = np.minimum.outer(a.sizes, b.sizes), np.maximum.outer(a.sizes, b.sizes)
    i, j = np.nonzero(shared & (DENOMINATOR * small >= NUMERATOR * large))
    matches = np.zeros(len(i), np.int64)
    for k, least in enumerate(least_matches()):
        part = slice(k * STEP, (k + 1) * STEP)
        matches += (a.marks[:, part][i] == b.marks[:, part][j]).sum(axis=1)
        alive = matches >= least
        i, j, matches = i[alive], j[alive], matches[alive]
    return i, j


def common_counts(a: Block, b: Block, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Number of shingles that each pair shares."""
    if not len(i):
        return np.zeros(0, np.int64)
    left, right = np.unique(i), np.unique(j)
    pooled_a = np.concatenate([a.codes[k] for k in left])
    pooled_b = np.concatenate([b.codes[k] for k in right])
    both = np.intersect1d(np.unique(pooled_a), np.unique(pooled_b), assume_unique=True)
    by_pairs = 4e-8 * float(a.sizes[i].sum() + b.sizes[j].sum()) + 2e-5 * len(left)
    by_product = 1e-10 * len(left) * len(right) * len(both) + 3e-8 * (len(pooled_a) + len(pooled_b))
    if by_product < by_pairs:
        counts = np.zeros((len(left), len(right)), np.float32)
        rows_a = np.repeat(np.arange(len(left)), a.sizes[left])
        rows_b = np.repeat(np.arange(len(right)), b.sizes[right])
        at_a, at_b = np.searchsorted(both, pooled_a), np.searchsorted(both, pooled_b)
        in_a = both[np.minimum(at_a, len(both) - 1)] == pooled_a
        in_b = both[np.minimum(at_b, len(both) - 1)] == pooled_b
        for low in range(0, len(both), 4096):
            width = min(4096, len(both) - low)
            product = []
            for rows, at, held, n in ((rows_a, at_a, in_a, len(left)), (rows_b, at_b, in_b, len(right))):
                pick = held & (at >= low) & (at < low + width)
                dense = np.zeros((n, width), np.float32)
                dense[rows[pick], at[pick] - low] = 1
                product.append(dense)
            counts += product[0] @ product[1].T  # whole numbers below 2^24 stay exact
        return counts[np.searchsorted(left, i), np.searchsorted(right, j)].astype(np.int64)
    out = np.zeros(len(i), np.int64)
    ends = np.searchsorted(i, left, side="right")
    start = 0
    for node, end in zip(left, ends):  # i is sorted
        own, partners = a.codes[node], j[start:end]
        for low in range(0, len(partners), 256):
            some = partners[low : low + 256]
            pool = np.concatenate([b.codes[k] for k in some])
            hit = own[np.minimum(np.searchsorted(own, pool), len(own) - 1)] == pool
            offsets = np.concatenate([[0], np.cumsum(b.sizes[some])[:-1]])
            out[start + low : start + low + len(some)] = np.add.reduceat(hit.astype(np.int64), offsets)
        start = end
    return out


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of n nodes along the pairs (i, j)."""
    label = np.arange(n)
    while True:
        before = label.copy()
        least = np.minimum(label[i], label[j])
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        label = label[label]
        if np.array_equal(before, label):
            return label


def two_blocks(frame: pd.DataFrame) -> tuple[Block, Block, bool]:
    """The sides of a pair of blocks, and whether they are one block."""
    frame = frame.drop_duplicates("node").sort_values("node")
    same = bool((frame["low"] == frame["high"]).iloc[0])
    a = Block(frame[frame["block"] == frame["low"]])
    return a, a if same else Block(frame[frame["block"] == frame["high"]]), same


def outlasting(frame: pd.DataFrame) -> pd.DataFrame:
    """Nodes with a pair that the MinHash values of this pair of blocks cannot rule out."""
    a, b, same = two_blocks(frame)
    i, j = candidates(a, b, same)
    nodes = np.unique(np.concatenate([a.nodes[i], b.nodes[j]]))
    return pd.DataFrame({"component": frame["component"].iloc[0], "low": frame["low"].iloc[0],
                         "high": frame["high"].iloc[0], "node": nodes})


def compare_blocks(frame: pd.DataFrame) -> pd.DataFrame:
    """(node, root, links, set_links) of the nodes that have a link inside this pair of blocks."""
    a, b, same = two_blocks(frame)
    i, j = candidates(a, b, same)
    common = common_counts(a, b, i, j)
    linked = (NUMERATOR + DENOMINATOR) * common >= NUMERATOR * (a.sizes[i] + b.sizes[j])
    i, j = i[linked], j[linked]
    shift = 0 if same else len(a.nodes)
    nodes = a.nodes if same else np.concatenate([a.nodes, b.nodes])
    links, sets = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64)
    np.add.at(links, i, b.copies[j])
    np.add.at(links, j + shift, a.copies[i])
    sets += np.bincount(i, minlength=len(nodes)) + np.bincount(j + shift, minlength=len(nodes))
    label = roots(len(nodes), i, j + shift)
    held = sets > 0
    return pd.DataFrame({"node": nodes[held], "root": nodes[label[held]], "links": links[held], "set_links": sets[held]})


def faces(marked: DataFrame, rows: int) -> DataFrame:
    """(node, component, block, low, high): the pairs of blocks in which a node shares a band with another one.

    A group of one block is its own pair. In a larger one every node goes to its own block, and to a pair
    with another block if a node there has one of its bands. `rows` is the size of `marked`.
    """
    columns = ["node", "component", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")]
    own = marked.withColumn("other", F.col("block")).select(*columns)
    held = marked.where("blocks > 1").select("node", "component", "block", F.explode("bands").alias("band"))
    # Of a band that lies in one block only, no node leaves that block.
    spread = held.groupBy("band").agg(F.collect_set("block").alias("others"), F.count(F.lit(1)).alias("n")).where(
        F.size("others") > 1)
    away = join_lookup(held, spread, "band", BANDS * rows, count="n").select(
        "node", "component", "block", F.explode("others").alias("other")).where("block <> other").distinct()
    return own.unionByName(away.select(*columns))


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (doc, tie, digest) and nodes (digest, doc, tie, copies, links, set_links, class_doc, class_tie)."""
    prepare(docs.sparkSession)
    texts = docs.select(doc_key().alias("doc"), text_tie().alias("tie"), F.col("text").cast("binary").alias("text"))
    members, _ = stored(texts.mapInArrow(
        _sketches, "doc long, tie long, digest binary, size long, marks binary, bands array<long>").withColumn(
            "row", F.monotonically_increasing_id()), "sketches")
    # The row number is settled by the write; a node takes the number of one of its rows.
    nodes, _ = stored(members.where("digest is not null").groupBy("digest").agg(
        F.min("row").alias("node"), F.min(F.struct("doc", "tie")).alias("first"), F.count(F.lit(1)).alias("copies"),
        F.max("size").alias("size")).select("digest", "node", "first.doc", "first.tie", "copies", "size"), "nodes")
    postings = members.select("row", F.explode("bands").alias("band")).join(
        nodes.select(F.col("node").alias("row")), "row", "left_semi")
    postings, posted = stored(postings, "postings")
    buckets, _ = stored(postings.groupBy("band").agg(
        F.min("row").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    edges = join_lookup(postings, buckets, "band", posted["rows"], count="n").where("row <> least").select(
        F.col("row").alias("src"), F.col("least").alias("dst")).distinct()
    groups, seen = stored(connected_components(edges), "groups")
    placed = groups.join(nodes, "node")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_NODES, F.sum("size") / BLOCK_SHINGLES)).cast("int")
    cut, _ = stored(placed.groupBy("component").agg(blocks.alias("blocks"), F.count(F.lit(1)).alias("n")), "cuts")
    placed, _ = stored(join_lookup(placed, cut, "component", seen["rows"], count="n").select(
        "node", "component", "doc", "tie", "copies", "size", "blocks",
        F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int").alias("block")), "blocks")
    marked, _ = stored(placed.select("node", "component", "blocks", "block", "copies", "size").join(
        members.select(F.col("row").alias("node"), "marks", "bands"), "node"), "marks")
    pair = ["component", "low", "high"]
    sides = marked.drop("component", "blocks")
    left, _ = stored(faces(marked, seen["rows"]).drop("block").join(sides, "node").groupBy(*pair).applyInPandas(
        lambda frame: outlasting(frame), "component long, low int, high int, node long"), "outlasting")
    alive, living = stored(placed.join(left.select("node").distinct(), "node", "left_semi").select("doc", "tie", "node"), "alive")
    sets, _ = stored(texts.join(lookup(alive, living["rows"]), ["doc", "tie"]).select("node", "text").mapInArrow(
        _sets, "node long, codes binary"), "sets")
    compared, _ = stored(left.join(sides, "node").join(sets, "node").groupBy(*pair).applyInPandas(
        lambda frame: compare_blocks(frame), "node long, root long, links long, set_links long"), "links")
    joined = connected_components(compared.where("node <> root").select(
        F.col("node").alias("src"), F.col("root").alias("dst")))
    firsts = joined.join(nodes.select("node", "doc", "tie"), "node")
    heads = firsts.groupBy("component").agg(F.min(F.struct("doc", "tie")).alias("head"))
    final = firsts.join(heads, "component").select("node", "head")
    counts = compared.groupBy("node").agg(F.sum("links").alias("links"), F.sum("set_links").alias("set_links"))
    described = nodes.join(counts, "node", "left").join(final, "node", "left").select(
        "digest", "doc", "tie", "copies", F.coalesce("links", F.lit(0)).alias("links"),
        F.coalesce("set_links", F.lit(0)).alias("set_links"),
        F.coalesce("head.doc", "doc").alias("class_doc"), F.coalesce("head.tie", "tie").alias("class_tie"))
    described, _ = stored(described, "classes")
    return members.select("doc", "tie", "digest"), described


def join(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links (other documents), n_text_links (other shingle sets) of every row."""
    members, nodes = classes(docs)
    nodes = nodes.select("digest", "copies", "links", "set_links", "class_doc")
    return members.join(nodes, "digest", "left").select(
        real_id("doc").alias("doc_id"), real_id(F.coalesce("class_doc", "doc")).alias("class_id"),
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).alias("n_links"),
        F.coalesce("set_links", F.lit(0)).alias("n_text_links"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class, that with the smallest id and text hash; rows without words all stay."""
    members, nodes = classes(docs)
    heads = nodes.where((F.col("doc") == F.col("class_doc")) & (F.col("tie") == F.col("class_tie")))
    counted = members.where("digest is not null").groupBy("doc", "tie").agg(F.count(F.lit(1)).alias("rows"))
    others = counted.join(heads.select("doc", "tie"), ["doc", "tie"], "left_anti").select("doc", "tie")
    others, seen = stored(others, "removed")
    kept = split_by_keys(docs, others, seen["rows"], "left_anti")
    twice, again = stored(counted.where("rows > 1").join(others, ["doc", "tie"], "left_anti"), "repeated")
    if not again["rows"]:
        return kept
    doc, tie = spare(docs, "head_doc", "head_tie")
    single = split_by_keys(kept, twice, again["rows"], "left_anti")
    many = split_by_keys(kept, twice, again["rows"], "left_semi").withColumns({doc: doc_key(), tie: text_tie()})
    return single.unionByName(many.dropDuplicates([doc, tie]).drop(doc, tie))
