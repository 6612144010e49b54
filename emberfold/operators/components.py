"""Connected components of an edge table, as alternating large-star / small-star rounds.

Method: Kiveris, Lattanzi, Mirrokni, Rastogi and Vassilvitskii, "Connected Components in MapReduce
and Beyond" (2014).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from emberfold import settings
from emberfold.operators.joins import join_lookup
from emberfold.session import written

MAX_ROUNDS = 60
CHUNK_EDGES = 1_000_000
#: What one task may take at once, where the caller asks for it: a quarter of a chunk.
WHOLE_EDGES = CHUNK_EDGES // 4


def _keep(edges: DataFrame) -> tuple[DataFrame, dict]:
    checksum = F.bit_xor(F.xxhash64("u", "v")).alias("checksum")
    return written(edges, "edges", checksum)


def _stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (u, v) of a chunk replaced by one edge per node to the smallest node it reaches there."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u):]
    root = np.arange(len(nodes))
    while True:
        a, b = root[a], root[b]
        apart = a != b
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        # Each root beside a smaller one points to some such; what points on is then shortened.
        root[np.maximum(a, b)] = np.minimum(a, b)
        while not np.array_equal(root, above := root[root]):
            root = above
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _contract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stars of chunks; few stars are carried into the next chunk, so that a place becomes one set of stars."""
    def joined(held):
        return _stars(*(np.concatenate([part[k] for part in held]) for k in (0, 1)))

    held, size = [], 0
    for frame in frames:
        held.append((frame["u"].to_numpy(), frame["v"].to_numpy()))
        size += len(frame)
        if size >= CHUNK_EDGES:
            stars = joined(held)
            held, size = [stars], len(stars[0])
            if 2 * size > CHUNK_EDGES:
                yield pd.DataFrame({"u": stars[0], "v": stars[1]})
                held, size = [], 0
    if held:
        stars = joined(held)
        yield pd.DataFrame({"u": stars[0], "v": stars[1]})


def _whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, component) of all nodes of few edges."""
    for stars in _contract(frames):
        node, component = stars["u"].to_numpy(), stars["v"].to_numpy()
        centres = np.unique(component)
        yield pd.DataFrame({"node": np.concatenate([node, centres]), "component": np.concatenate([component, centres])})


def connected_components(
    edges: DataFrame, src: str = "src", dst: str = "dst", place: Column | None = None, whole: int = 0
) -> DataFrame:
    """(node, component): every node that has an edge, with the smallest node id it can reach.

    Each task first turns chunks of its edges into stars, which keeps connectivity; `place` groups
    edges that are likely to meet, so most components close in this step. Rounds then run only over the
    centres of stars that share a node. Each round writes the edge set, so a lost executor
    repeats one round at most. Rounds end when the set stops changing, which an order-independent
    checksum taken during the write shows. Up to `whole` edges that are left by the first step, fewer than a chunk,
    go through it once more as one chunk instead, which saves rounds of small jobs.
    """
    if place is not None:
        edges = edges.repartition(place)
    pairs = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u <> v")
    stars, state = _keep(pairs.mapInPandas(_contract, pairs.schema).distinct())
    own = F.col("v").alias("component")
    if state["rows"] == 0:
        return stars.select(F.col("u").alias("node"), own)
    if state["rows"] <= min(whole, WHOLE_EDGES):
        return stars.coalesce(1).mapInPandas(_whole, "node bigint, component bigint")
    # A node takes the smallest centre of its stars; other centres, and itself if it is one, meet that centre.
    stars, _ = written(_with_low(stars, state["rows"]), "stars")
    low = stars.where("v = m").select("u", "v")
    centres = stars.select(F.col("v").alias("u")).distinct()
    apart = stars.where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
    chained = low.join(centres, "u", "left_semi")
    links, open_state = _keep(apart.unionByName(chained).distinct())
    settled = _settled(links, open_state)
    roots = settled.select(F.col("u").alias("v"), F.col("v").alias("root"))
    nodes = low.unionByName(centres.select("u", F.col("u").alias("v")).join(low, "u", "left_anti"))
    return join_lookup(nodes, roots, "v", 2 * state["rows"], "left").select(
        F.col("u").alias("node"), F.coalesce("root", "v").alias("component"))


def _settled(current: DataFrame, state: dict) -> DataFrame:
    """Stars (u, v) of whole components, by rounds over the edges `current`."""
    for _ in range(MAX_ROUNDS):
        if state["rows"] == 0:
            return current
        following, changed = _keep(_round(current, state["rows"]))
        if changed == state:
            return following
        current, state = following, changed
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def _with_low(edges: DataFrame, size: int) -> DataFrame:
    """Add `m`, the smallest neighbour of each u. A window while one task can hold any node's edges,
    otherwise a mergeable minimum and a join that splits hot nodes."""
    if size <= settings.HOT_MIN_ROWS:
        return edges.withColumn("m", F.min("v").over(W.partitionBy("u")))
    return join_lookup(edges, edges.groupBy("u").agg(F.min("v").alias("m")), "u", size)


def _round(edges: DataFrame, size: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _with_low(both, 2 * size).where("v > u").select(
        F.col("v").alias("u"), F.least("u", "m").alias("v"))
    return _with_low(large, size).select(
        F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
        F.col("m").alias("v")).distinct()
