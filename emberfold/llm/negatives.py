"""Hard-negative mining: rows of another label that score a little below an anchor's positives.

Scores are integer inner products. Anchors are joined with all rows in blocks: a block of anchors lies near
one of a bounded number of pivots and carries a spanning tree (Prim's, over the distances of its
anchors); a block of candidates is a share of all rows. Exact scores are taken at the root only. Along an
edge of length d a score can change by no more than d times the candidate's norm, so a parent's score or
bounds give bounds of the child's. A candidate is scored exactly at an anchor only where its bounds reach
into what the anchor still looks for; otherwise its bounds go on to the child, wider by the next edge.

The first pass looks for positives: rows of the anchor's label whose upper bound reaches the lowest score
that is surely among the first POSITIVES. The second looks for negatives: rows of another label whose
bounds overlap the score window of one of the positives and reach the lowest score surely among its
first NEGATIVES. Each block gives its best rows for each anchor, as one row of arrays; these are merged
by anchor. Bounds are widened by more than floating point can err, so results are exact.

Blocks of candidates are dealt by a hash of the row, blocks of anchors are split at ANCHORS, so a label or
a pivot that holds most rows makes more blocks, not larger ones.

Defined cases: a null label or vector, and any null or non-finite component, keep a row out. Vectors of
different lengths are filled up with zeros. Rows that repeat id, label and vector are one row; other rows
with an equal id are rows of their own, in the order of a 64-bit hash that tells rows apart. A null id comes
after all others and is no anchor. Components or scores beyond what doubles hold exactly (2^53) raise an error. A positive
without a negative has no row. An empty table gives no rows. Other columns do not come back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfold.llm.common import NULL_ID, prepare, real_id, stored

ANCHOR_EVERY = 100
MOVED_EVERY = 7
LABELS = 10
SCALE = 256
POSITIVES = 5
NEGATIVES = 10
LOW_SHARE, HIGH_SHARE, WHOLE = 30, 90, 100

PIVOTS = 64
ANCHORS = 512  # of a block
CANDIDATES = 1 << 14  # of a block, about
BLOCKS = 24  # of candidates at least, so that small tables use more than one task
#: Relative error of distances and products of doubles, with room.
SLACK = 1e-9
EXACT = 1 << 53

ROW = "uid long, vec_id long, label long, vector array<double>"


def prepared(embeddings: DataFrame) -> DataFrame:
    """uid, vec_id (null: NULL_ID), label, vector of whole numbers, of the rows that take part.

    uid orders rows of equal vec_id and is otherwise of no meaning.
    """
    vector = F.col("embedding").cast("array<double>")
    usable = F.forall(vector, lambda x: F.coalesce((x == x) & (F.abs(x) < float("inf")), F.lit(False)))
    key = F.coalesce(F.col("vec_id").cast("long"), F.lit(NULL_ID))
    label = F.col("label").cast("long")
    rows = embeddings.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & usable).select(
        key.alias("vec_id"),
        F.when(F.col("vec_id").cast("long") % MOVED_EVERY == 0, F.pmod(label + 1, F.lit(LABELS))).otherwise(label).alias("label"),
        F.transform(vector, lambda x: F.floor(x * SCALE).cast("double")).alias("vector"))
    return rows.distinct().withColumn("uid", F.xxhash64("vec_id", "label", "vector"))


def is_anchor() -> Column:
    return (F.col("vec_id") != NULL_ID) & (F.col("vec_id") % ANCHOR_EVERY == 0)


# --- inside tasks -------------------------------------------------------------------------------


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows of a matrix, filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prim's tree: the order in which vectors join, the parent of each (-1: the root) and its distance."""
    n = len(vectors)
    squares = (vectors * vectors).sum(axis=1)
    parent, distance = np.full(n, -1), np.full(n, np.inf)
    order = np.zeros(n, np.int64)
    free = np.ones(n, bool)
    at = int(np.argmin(squares))
    distance[at] = 0
    for k in range(n):
        order[k] = at
        free[at] = False
        gap = np.sqrt(np.maximum(squares + squares[at] - 2 * (vectors @ vectors[at]), 0))
        closer = free & (gap < distance)
        distance[closer] = gap[closer]
        parent[closer] = at
        if k + 1 < n:
            at = int(np.argmin(np.where(free, distance, np.inf)))
    return order, parent, distance * (1 + SLACK)


def _best(scores: np.ndarray, ids: np.ndarray, uids: np.ndarray, most: int) -> np.ndarray:
    """Places of the first rows: higher scores first, then smaller ids."""
    if len(scores) > 4 * most:  # leave out what is surely not among them
        least = np.partition(scores, len(scores) - most)[len(scores) - most]
        some = np.flatnonzero(scores >= least)
        return some[np.lexsort((uids[some], ids[some], -scores[some]))[:most]]
    return np.lexsort((uids, ids, -scores))[:most]


def _scores(vectors: np.ndarray, anchor: np.ndarray, norms: np.ndarray, norm: float) -> np.ndarray:
    if len(norms) and norms.max() * norm >= EXACT:
        raise OverflowError("scores beyond 2^53 are not exact")
    return vectors @ anchor


class Block:
    """Candidates of a block, walked along the tree of a block of anchors."""

    def __init__(self, anchors: pa.Table, candidates: pa.Table) -> None:
        width = max(_width(anchors["vector"]), _width(candidates["vector"]))
        self.anchors = matrix(anchors["vector"], width)
        self.vectors = matrix(candidates["vector"], width)
        self.ids, self.uids, self.labels = (candidates[c].to_numpy() for c in ("vec_id", "uid", "label"))
        self.norms = np.sqrt((self.vectors * self.vectors).sum(axis=1)) * (1 + SLACK)
        self.sizes = np.sqrt((self.anchors * self.anchors).sum(axis=1)) * (1 + SLACK)
        self.order, self.parent, self.distance = spanning_tree(self.anchors)
        self.scored = 0

    def walk(self, wanted) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(anchor, candidates, their exact scores) for each anchor.

        `wanted(anchor, low, high)` says which candidates are scored, given bounds of their scores.
        """
        bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        children = np.bincount(self.parent[self.parent >= 0], minlength=len(self.anchors))
        for k in self.order.tolist():
            above = int(self.parent[k])
            if above < 0:
                low = high = _scores(self.vectors, self.anchors[k], self.norms, self.sizes[k])
                some = np.flatnonzero(wanted(k, low, high))
                self.scored += len(low)
                scores = low[some]
            else:
                reach = self.distance[k] * self.norms
                low, high = bounds[above][0] - reach, bounds[above][1] + reach
                children[above] -= 1
                if not children[above]:
                    del bounds[above]
                some = np.flatnonzero(wanted(k, low, high))
                self.scored += len(some)
                if 4 * len(some) > len(low):  # most of them: one product is cheaper than picking rows
                    low = high = _scores(self.vectors, self.anchors[k], self.norms, self.sizes[k])
                    scores = low[some]
                else:
                    scores = _scores(self.vectors[some], self.anchors[k], self.norms[some], self.sizes[k])
                    low[some] = high[some] = scores
            if children[k]:
                bounds[k] = (low, high)
            yield k, some, scores


def _width(column: pa.ChunkedArray) -> int:
    sizes = [np.diff(c.offsets.to_numpy()).max(initial=0) for c in column.chunks]
    return int(max(sizes, default=0))


def _at_least(high: np.ndarray, low: np.ndarray, some: np.ndarray, most: int) -> np.ndarray:
    """Of the candidates `some`, those whose upper bound reaches the lowest score surely among the first."""
    if int(some.sum()) > most:
        floor = low[some]
        some &= high >= np.partition(floor, len(floor) - most)[len(floor) - most]
    return some


def nearest_same(block: Block, anchors: pa.Table) -> Iterator[tuple]:
    """For each anchor the scores, ids and uids of its first rows of the same label in a block."""
    labels, uids = anchors["label"].to_numpy(), anchors["uid"].to_numpy()

    def wanted(k: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return _at_least(high, low, (block.labels == labels[k]) & (block.uids != uids[k]), POSITIVES)

    for k, some, scores in block.walk(wanted):
        best = _best(scores, block.ids[some], block.uids[some], POSITIVES)
        yield k, scores[best], block.ids[some][best], block.uids[some][best]


def windows(positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest score of a negative for these positive scores (empty where they cross)."""
    return -(-LOW_SHARE * positive // WHOLE), HIGH_SHARE * positive // WHOLE


def in_windows(block: Block, anchors: pa.Table) -> Iterator[tuple]:
    """For each anchor and positive the scores, ids and uids of the first negatives in a block."""
    labels = anchors["label"].to_numpy()
    spans = [windows(np.array(s, np.int64)) for s in anchors["scores"].to_pylist()]

    def wanted(k: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        other = block.labels != labels[k]
        found = np.zeros(len(other), bool)
        for least, most in zip(*spans[k]):
            some = other & (high >= least) & (low <= most)
            sure = other & (low >= least) & (high <= most)
            if int(sure.sum()) > NEGATIVES:
                floor = low[sure]
                some &= high >= np.partition(floor, len(floor) - NEGATIVES)[len(floor) - NEGATIVES]
            found |= some
        return found

    for k, some, scores in block.walk(wanted):
        for place, (least, most) in enumerate(zip(*spans[k])):
            inside = some[(scores >= least) & (scores <= most)]
            kept = scores[(scores >= least) & (scores <= most)]
            best = _best(kept, block.ids[inside], block.uids[inside], NEGATIVES)
            if len(best):
                yield k, place, kept[best], block.ids[inside][best], block.uids[inside][best]


def _positives(key, anchors: pa.Table, candidates: pa.Table) -> pa.Table:
    if not len(anchors) or not len(candidates):
        return pa.table({"anchor": [], "found": []}, POSITIVE_ROWS)
    rows = [(int(anchors["uid"][k].as_py()), _structs(*found))
            for k, *found in nearest_same(Block(anchors, candidates), anchors) if len(found[0])]
    return pa.table({"anchor": [r[0] for r in rows], "found": [r[1] for r in rows]}, POSITIVE_ROWS)


def _negatives(key, anchors: pa.Table, candidates: pa.Table) -> pa.Table:
    if not len(anchors) or not len(candidates):
        return pa.table({"anchor": [], "place": [], "found": []}, NEGATIVE_ROWS)
    rows = [(int(anchors["uid"][k].as_py()), place, _structs(*found))
            for k, place, *found in in_windows(Block(anchors, candidates), anchors)]
    return pa.table({"anchor": [r[0] for r in rows], "place": [r[1] for r in rows], "found": [r[2] for r in rows]}, NEGATIVE_ROWS)


def _structs(scores: np.ndarray, ids: np.ndarray, uids: np.ndarray) -> list[dict]:
    return [{"down": -int(s), "id": i, "uid": u} for s, i, u in zip(scores.tolist(), ids.tolist(), uids.tolist())]


#: A row found: `down` is the negated score, so that the natural order is the one wanted.
FOUND = pa.list_(pa.struct([("down", pa.int64()), ("id", pa.int64()), ("uid", pa.int64())]))
POSITIVE_ROWS = pa.schema([("anchor", pa.int64()), ("found", FOUND)])
NEGATIVE_ROWS = pa.schema([("anchor", pa.int64()), ("place", pa.int64()), ("found", FOUND)])
FOUND_SQL = "array<struct<down: long, id: long, uid: long>>"


# --- on Spark -----------------------------------------------------------------------------------


def _with_pivot(pivots: np.ndarray):
    squares = (pivots * pivots).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = matrix(batch.column("vector"), max(pivots.shape[1], _width(pa.chunked_array([batch.column("vector")]))))
            gaps = squares - 2 * (vectors[:, : pivots.shape[1]] @ pivots.T)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(gaps.argmin(axis=1), pa.int64())], names=[*batch.schema.names, "pivot"])

    return run


def anchor_blocks(rows: DataFrame) -> tuple[DataFrame, int]:
    """The anchors with their block, and the number of blocks.

    A block holds anchors of one pivot; the pivots are the PIVOTS anchors whose ids hash lowest. This
    decides only how well bounds prune.
    """
    anchors, seen = stored(rows.where(is_anchor()), "anchors")
    chosen = anchors.select(F.xxhash64("uid").alias("h"), "uid").orderBy("h", "uid").limit(PIVOTS)
    found = anchors.join(F.broadcast(chosen.select("uid")), "uid", "left_semi").orderBy("uid").select("vector").collect()
    width = max((len(r.vector) for r in found), default=1) or 1
    pivots = np.zeros((max(len(found), 1), width))
    for k, r in enumerate(found):
        pivots[k, : len(r.vector)] = r.vector
    schema = f"{ROW}, pivot long"
    dealt, _ = stored(anchors.select("uid", "vec_id", "label", "vector").mapInArrow(_with_pivot(pivots), schema), "pivots")
    counts = dealt.groupBy("pivot").agg(F.count(F.lit(1)).alias("n")).collect()  # PIVOTS rows at most
    # Small pivots share blocks, in the order of their numbers; large ones are split.
    first, parts, block, held = {}, {}, 0, 0
    for pivot, n in sorted(tuple(r) for r in counts):
        if held and held + n > ANCHORS:
            block, held = block + 1, 0
        first[pivot], parts[pivot] = block, max(1, -(-n // ANCHORS))
        block, held = (block + parts[pivot], 0) if parts[pivot] > 1 else (block, held + n)
    blocks = block + 1
    plan = rows.sparkSession.createDataFrame(
        [(p, first[p], parts[p]) for p in first], "pivot long, first_block long, parts long")
    dealt = dealt.join(F.broadcast(plan), "pivot").select(
        "uid", "vec_id", "label", "vector",
        (F.col("first_block") + F.pmod(F.xxhash64("uid"), F.col("parts"))).alias("anchor_block"))
    return stored(dealt, "anchor-blocks")[0], blocks


def _grid(anchors: DataFrame, rows: DataFrame, anchor_blocks: int, row_blocks: int, work, schema: str) -> DataFrame:
    """`work` on every block of anchors with every block of rows."""
    def numbers(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))

    left = anchors.select("*", numbers(row_blocks).alias("row_block"))
    right = rows.select("*", F.pmod(F.xxhash64(F.col("uid"), F.lit(1)), F.lit(row_blocks)).cast("long").alias("row_block"),
                        numbers(anchor_blocks).alias("anchor_block"))
    keys = ["anchor_block", "row_block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(work, schema)


def _merged(found: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The first rows of the lists found in the blocks, `most` at most."""
    return found.groupBy(*keys).agg(F.flatten(F.collect_list("found")).alias("all")).select(
        *keys, F.slice(F.array_sort("all"), 1, most).alias("found"))


def mine(embeddings: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    prepare(embeddings.sparkSession)
    rows, seen = stored(prepared(embeddings), "vectors")
    blocks = max(BLOCKS, -(-seen["rows"] // CANDIDATES))
    anchors, anchor_count = anchor_blocks(rows)
    lists = _grid(anchors, rows, anchor_count, blocks, _positives, f"anchor long, found {FOUND_SQL}")
    positives, _ = stored(_merged(lists, ["anchor"], POSITIVES), "positives")
    looking = anchors.join(positives.select(
        F.col("anchor").alias("uid"), F.transform("found", lambda f: -f["down"]).alias("scores")), "uid")
    lists = _grid(looking, rows, anchor_count, blocks, _negatives, f"anchor long, place long, found {FOUND_SQL}")
    negatives = _merged(lists, ["anchor", "place"], NEGATIVES)
    heads = positives.select("anchor", F.posexplode("found").alias("place", "positive")).withColumn(
        "place", F.col("place").cast("long"))
    names = anchors.select(F.col("uid").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    pairs = negatives.join(heads, ["anchor", "place"]).join(names, "anchor")
    return pairs.select(
        "anchor_id", real_id(F.col("positive.id")).alias("positive_id"), (-F.col("positive.down")).alias("positive_score"),
        F.posexplode("found").alias("at", "negative")).select(
        "anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"),
        real_id(F.col("negative.id")).alias("negative_id"), "positive_score",
        (-F.col("negative.down")).alias("negative_score"))


ORACLE_SQL = """
WITH usable AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
moved AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, v FROM usable),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS same,
    CAST(list_inner_product(CAST(a.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM moved a JOIN moved c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
ranked AS (
  SELECT anchor_id, positive_id, other_id AS negative_id, positive_score, score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS rank
  FROM positives JOIN (SELECT * FROM scored WHERE NOT same) USING (anchor_id)
  WHERE 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM ranked WHERE rank <= 10
"""
