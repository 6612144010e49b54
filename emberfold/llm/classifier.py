"""Quality classifier: a convolutional network over bytes, written and trained in numpy.

A text is cut into overlapping chunks of `CHUNK` bytes that cover all of it. Bytes are embedded, and
learned filters of `2 * STRIDE` bytes slide over a chunk in steps of `STRIDE`; their activations are
max-pooled and averaged over the chunk, a hidden layer describes the chunk, and its units are
max-pooled and averaged over all chunks and combined into one probability. Chunks are pooled as they
come, so a text of any length takes bounded memory.

Training uses at most `SAMPLE` labelled documents of each class, those with the smallest hash of
their id, and of these as many whole texts as take `SAMPLE_BYTES`, in the order of a text hash; it reads all
chunks of each. Sizes are collected first, so the driver never holds more. Everything else covers all documents. The intercept is then moved from the balanced sample to the share of classes among all
training labels.

Defined cases: a null or empty text is one empty chunk; a null doc_id is held out and never learned
from; ids with contradicting labels are not learned from; rows repeating an id are one example.
Without labels of both classes every score is the share of label 1 (0.5 without any label). An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfold.llm.common import prepare

FOLDS = 5
CUT = 0.3
SAMPLE = 1500
SAMPLE_BYTES = 8 << 20
CHUNK, OVERLAP = 512, 64
STRIDE = 4
EMBED, FILTERS, HIDDEN = 8, 24, 16
EPOCHS, BATCH, RATE, DECAY = 10, 32, 4e-3, 1e-4
MIN_STEPS = 400
SEED = 11
SCORE_CHUNKS = 256  # chunks that are scored, or followed back in training, at once

Weights = dict[str, np.ndarray]


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(True))


def chunks(text: bytes | None) -> np.ndarray:
    """Overlapping chunks that cover the text, the last one padded with zeros."""
    data = np.frombuffer(text or b"", np.uint8)
    step = CHUNK - OVERLAP
    n = max(1, -(-(len(data) - OVERLAP) // step))
    padded = np.zeros((n - 1) * step + CHUNK, np.uint8)
    padded[: len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::step]


def initial(random: np.random.Generator) -> Weights:
    width = STRIDE * EMBED

    def normal(*shape: int, fan: int) -> np.ndarray:
        return (random.standard_normal(shape) * np.sqrt(2 / fan)).astype(np.float32)

    return {
        "embed": normal(256, EMBED, fan=2), "first": normal(width, FILTERS, fan=2 * width),
        "second": normal(width, FILTERS, fan=2 * width), "bias": np.zeros(FILTERS, np.float32),
        "hidden": normal(2 * FILTERS, HIDDEN, fan=2 * FILTERS), "hidden_bias": np.zeros(HIDDEN, np.float32),
        "out": normal(2 * HIDDEN, fan=2 * HIDDEN) * 0.3, "out_bias": np.zeros(1, np.float32),
    }


def convolve(w: Weights, block: np.ndarray) -> tuple:
    """Blocks of embedded bytes and the filters' activations; a filter spans two blocks."""
    parts = w["embed"][block].reshape(len(block), CHUNK // STRIDE, STRIDE * EMBED)
    both = parts @ np.concatenate([w["first"], w["second"]], axis=1)
    active = both[:, :-1, :FILTERS] + both[:, 1:, FILTERS:]
    active += w["bias"]
    np.maximum(active, 0, out=active)
    return parts, active


def describe(w: Weights, block: np.ndarray) -> tuple:
    parts, active = convolve(w, block)
    pooled = np.concatenate([active.max(axis=1), active.mean(axis=1)], axis=1)
    unit = np.maximum(pooled @ w["hidden"] + w["hidden_bias"], 0)
    return parts, active, pooled, unit


def probability(logit: np.ndarray | float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def gradients(w: Weights, block: np.ndarray, owner: np.ndarray, label: np.ndarray) -> tuple[float, Weights]:
    """Mean log loss of a batch of documents and its gradient; `owner` is the document of a chunk.

    Activations are held for some chunks at a time and made again on the way back, so a long document
    costs time but no memory.
    """
    parts = [slice(low, low + SCORE_CHUNKS) for low in range(0, len(block), SCORE_CHUNKS)]
    described = [describe(w, block[part]) for part in parts] if len(parts) == 1 else None
    unit = described[0][3] if described else np.concatenate([describe(w, block[part])[3] for part in parts])
    n = len(label)
    count = np.bincount(owner, minlength=n).astype(np.float32)
    starts = np.searchsorted(owner, np.arange(n))
    top = np.maximum.reduceat(unit, starts, axis=0)
    mean = np.add.reduceat(unit, starts, axis=0) / count[:, None]
    features = np.concatenate([top, mean], axis=1)
    p = probability(features @ w["out"] + w["out_bias"])
    loss = float(-np.mean(np.where(label == 1, np.log(p + 1e-9), np.log(1 - p + 1e-9))))
    error = ((p - label) / n).astype(np.float32)
    g = {k: np.zeros_like(v) for k, v in w.items()}
    g["out"], g["out_bias"] = features.T @ error, error.sum(keepdims=True)
    to_features = error[:, None] * w["out"][None, :]
    is_top = unit == top[owner]
    ties = np.add.reduceat(is_top.astype(np.float32), starts, axis=0)
    to_unit = is_top * (to_features[:, :HIDDEN] / ties)[owner] + (to_features[:, HIDDEN:] / count[:, None])[owner]
    to_unit *= unit > 0
    for k, part in enumerate(parts):
        follow_back(w, g, block[part], to_unit[part], described[k] if described else describe(w, block[part]))
    return loss, g


def follow_back(w: Weights, g: Weights, block: np.ndarray, to_unit: np.ndarray, described: tuple) -> None:
    """Add to `g` what some chunks contribute, whose features have the gradient `to_unit`."""
    parts, active, pooled, _ = described
    g["hidden"] += pooled.T @ to_unit
    g["hidden_bias"] += to_unit.sum(axis=0)
    to_pooled = to_unit @ w["hidden"].T
    positions = active.shape[1]
    to_active = np.repeat((to_pooled[:, None, FILTERS:] / positions), positions, axis=1)
    at = active.argmax(axis=1)
    rows, columns = np.arange(len(block))[:, None], np.arange(FILTERS)[None, :]
    to_active[rows, at, columns] += to_pooled[:, :FILTERS]
    to_active *= active > 0
    g["bias"] += to_active.sum(axis=(0, 1))
    width = STRIDE * EMBED
    flat = to_active.reshape(-1, FILTERS)
    g["first"] += parts[:, :-1].reshape(-1, width).T @ flat
    g["second"] += parts[:, 1:].reshape(-1, width).T @ flat
    to_parts = np.zeros_like(parts)
    to_parts[:, :-1] += to_active @ w["first"].T
    to_parts[:, 1:] += to_active @ w["second"].T
    to_bytes = to_parts.reshape(-1, EMBED)
    g["embed"] += np.stack([np.bincount(block.ravel(), to_bytes[:, k], 256) for k in range(EMBED)], axis=1)


def train(examples: list[tuple[bytes, int]], share: float) -> Weights:
    """Adam on shuffled batches; `share` is that of label 1 among all training labels."""
    random = np.random.default_rng(SEED)
    w = initial(random)
    labels = np.array([y for _, y in examples], np.float32)
    ones = float(labels.mean()) if len(labels) else 0.0
    if not 0 < ones < 1:
        w["out"][:] = 0
        w["out_bias"][:] = np.log((share + 1e-6) / (1 - share + 1e-6))
        return w
    first, second = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
    epochs = max(EPOCHS, -(-MIN_STEPS * BATCH // len(examples)))
    steps, step = epochs * -(-len(examples) // BATCH), 0
    for _ in range(epochs):
        order = random.permutation(len(examples))
        for low in range(0, len(order), BATCH):
            some = order[low : low + BATCH]
            pieces = [chunks(examples[k][0]) for k in some]
            block = np.concatenate(pieces)
            owner = np.repeat(np.arange(len(some)), [len(piece) for piece in pieces])
            _, g = gradients(w, block, owner, labels[some])
            step += 1
            rate = RATE * min(1.0, step / 20) * (1 - 0.9 * step / steps)
            for k, v in g.items():
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.999 * second[k] + 0.001 * v * v
                move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                w[k] -= (rate * (move + DECAY * w[k])).astype(np.float32)
    w["out_bias"] += np.float32(np.log(share / (1 - share)) - np.log(ones / (1 - ones)))
    return w


def score_text(w: Weights, text: bytes | None) -> float:
    pieces = chunks(text)
    top, total = np.zeros(HIDDEN, np.float32), np.zeros(HIDDEN)
    for low in range(0, len(pieces), SCORE_CHUNKS):
        unit = describe(w, pieces[low : low + SCORE_CHUNKS])[3]
        top = np.maximum(top, unit.max(axis=0))
        total += unit.sum(axis=0, dtype=float)
    features = np.concatenate([top, total / len(pieces)])
    return float(probability(features @ w["out"] + w["out_bias"][0]))


def within(rows: list, most: int) -> list[tuple]:
    """(doc_id, quality, tie) of whole texts, in an order by their hashes, that take `most` bytes of a class."""
    left, taken = {}, []
    for r in sorted(rows, key=lambda r: (r.tie, r.doc_id)):
        if r.size <= left.setdefault(r.quality, most):
            left[r.quality] -= r.size
            taken.append((r.doc_id, r.quality, r.tie))
    return taken


def fit(docs: DataFrame, labels: DataFrame) -> Weights:
    known = labels.where(~held_out() & F.col("quality").isNotNull()).groupBy("doc_id").agg(
        F.min("quality").cast("int").alias("quality"), F.max("quality").cast("int").alias("most")).where(
            "quality = most").select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    sizes = {r.quality: r.n for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    share = sizes.get(1, 0) / total if total else 0.5
    order = F.xxhash64("doc_id")
    chosen = [known.where(F.col("quality") == q).orderBy(order, "doc_id").limit(SAMPLE) for q in (0, 1)]
    sample = F.broadcast(chosen[0].unionByName(chosen[1]))  # 2 * SAMPLE rows at most
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    # Rows that share an id count as one, with the smallest text: 2 * SAMPLE rows again, without texts.
    sizes = texts.join(sample, "doc_id").groupBy("doc_id", "quality").agg(
        F.min(F.struct(F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"), F.xxhash64("text").alias("tie"))).alias("least")
    ).select("doc_id", "quality", "least.*").collect()
    taken = within(sizes, SAMPLE_BYTES)
    wanted = docs.sparkSession.createDataFrame(taken, "doc_id long, quality int, tie long")
    rows = texts.withColumn("tie", F.xxhash64("text")).join(F.broadcast(wanted), ["doc_id", "tie"]).groupBy(
        "doc_id", "quality").agg(F.first("text").alias("text")).collect()
    rows.sort(key=lambda r: r.doc_id)
    return train([(r.text, r.quality) for r in rows], share)


def _score(weights: object):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in batches:
            scores = [score_text(w, t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64())],
                names=["doc_id", "held_out", "score"])

    return score


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of `docs`."""
    spark = prepare(docs.sparkSession)
    weights = spark.sparkContext.broadcast(fit(docs, labels))  # a few thousand numbers
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"),
                       F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_score(weights), "doc_id long, held_out boolean, score double").withColumn(
        "predicted", (F.col("score") >= CUT).cast("int"))
