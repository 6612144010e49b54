"""Which detections belong together: within a radius and a time window, and transitively.

No step compares detections pair by pair. Detections first collapse into slots (small cell x time
bin) in which everything is linked by construction; only the boxes of neighbouring slots are
compared, and each slot has a bounded number of neighbours however many rows it holds. Boxes decide
most pairs outright. The rest, and only where the two sides are not connected yet, are cut into
finer cells until boxes decide, so the result equals that of testing every pair.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from emberfold import settings
from emberfold.functions.geo import SpaceTimeGrid, box_distance_bounds
from emberfold.operators.components import WHOLE_EDGES, connected_components
from emberfold.operators.joins import join_lookup
from emberfold.session import written

MAX_LEVELS = 30

@dataclass
class Clusters:
    """`slots` maps slot_id to component, cluster_size and its rows `n`; the counts are known from its write."""

    grid: SpaceTimeGrid
    slots: DataFrame
    total_rows: int
    largest: int

    def label(self, detections: DataFrame) -> DataFrame:
        """Add `component` and `cluster_size` to the detections the clusters were built from."""
        keyed = detections.withColumn("slot_id", _slot(self.grid))
        return join_lookup(keyed, self.slots, "slot_id", self.total_rows, count="n").drop("slot_id")


def _slot(grid: SpaceTimeGrid) -> Column:
    return grid.slot_id(F.col("latitude"), F.col("longitude"), F.unix_seconds("observed_at"))


def _boxes(*extra: Column) -> list[Column]:
    return [
        F.min("latitude").alias("lat_min"), F.max("latitude").alias("lat_max"),
        F.min("longitude").alias("lon_min"), F.max("longitude").alias("lon_max"),
        *extra,
    ]


def build_slots(detections: DataFrame, grid: SpaceTimeGrid) -> DataFrame:
    """One row per occupied slot: row count, box and time extent. Copies and crowds collapse map-side."""
    seconds = F.unix_seconds("observed_at")
    return (
        detections.select(_slot(grid).alias("slot_id"), "latitude", "longitude", seconds.alias("t"))
        .groupBy("slot_id")
        .agg(*_boxes(F.min("t").alias("t_min"), F.max("t").alias("t_max"),
                     F.count(F.lit(1)).alias("n")))
    )


def add_runs(slots: DataFrame, grid: SpaceTimeGrid) -> DataFrame:
    """Add `node`: first slot of the unbroken run of slots in the same cell (gaps <= window).

    A cell has one slot per time bin at most, so a window partition grows with the time range only.
    """
    by_time = W.partitionBy("cell").orderBy("slot_id")
    gap = F.col("t_min") - F.lag("t_max").over(by_time)
    return (
        slots.withColumn("cell", grid.slot_cell(F.col("slot_id")))
        .withColumn("starts", F.when(F.coalesce(gap <= grid.window_s, F.lit(False)), None)
                    .otherwise(F.col("slot_id")))
        .withColumn("node", F.max("starts").over(by_time.rowsBetween(W.unboundedPreceding, 0)))
        .drop("cell", "starts")
    )


def slot_pairs(slots: DataFrame, grid: SpaceTimeGrid) -> DataFrame:
    """Neighbouring slots of different runs that may be linked, with `certain` where they surely are."""
    columns = ["slot_id", "node", "t_min", "t_max", "lat_min", "lat_max", "lon_min", "lon_max"]
    side = lambda p: [F.col(c).alias(f"{p}_{c}") for c in columns]
    bin_of = grid.slot_bin(F.col("slot_id"))
    # One side is repeated over the blocks in reach, the other over the current and previous bin.
    left = grid.reachable_blocks(
        slots.select(*side("a"), grid.lon_reach("lat_min", "lat_max").alias("a_reach"), bin_of.alias("bin")), "a_")
    right = slots.select(
        *side("b"), grid.home_block(F.col("lat_min"), F.col("lon_min")).alias("block"),
        F.explode(F.array(bin_of, bin_of - 1)).alias("bin"))
    pairs = left.join(right, ["block", "bin"]).where(
        (F.col("a_slot_id") < F.col("b_slot_id")) & (F.col("a_node") != F.col("b_node"))
        & _times_touch(grid.window_s) & _sides_touch(grid))
    lower, upper = box_distance_bounds("a_", "b_")
    return (
        pairs.where(lower <= grid.radius_km)
        .select("a_slot_id", "a_node", "b_slot_id", "b_node",
                (upper <= grid.radius_km).alias("certain"))
    )


def _times_touch(window_s: int) -> Column:
    """Some time of one side is within the window of some time of the other.

    Exact for slots: each side spans less than one window, so overlapping sides always qualify and
    disjoint ones are decided by their nearest ends.
    """
    return (F.col("b_t_min") - F.col("a_t_max") <= window_s) & (
        F.col("a_t_min") - F.col("b_t_max") <= window_s)


def _sides_touch(grid: SpaceTimeGrid) -> Column:
    """Whether boxes are near enough in latitude and in longitude: comparisons alone, before any trigonometry."""
    north = F.greatest(F.col("b_lat_min") - F.col("a_lat_max"), F.col("a_lat_min") - F.col("b_lat_max"))
    east = F.greatest(F.col("b_lon_min") - F.col("a_lon_max"), F.col("a_lon_min") - F.col("b_lon_max"))
    around = F.greatest(F.col("b_lon_max") - F.col("a_lon_min"), F.col("a_lon_max") - F.col("b_lon_min"))
    return (north <= grid.lat_reach) & ((east <= F.col("a_reach")) | (around >= 360.0 - F.col("a_reach")))


def find_clusters(
    detections: DataFrame,
    radius_km: float = settings.CLUSTER_RADIUS_KM,
    window_hours: float = settings.CLUSTER_WINDOW_HOURS,
) -> Clusters:
    """Connected components of "within radius and window" over any number of detections.

    `detections` needs latitude, longitude and observed_at. It is read once, or twice when some slot
    pairs need refining, so pass a written or cached table if it is costly to compute.
    """
    grid = SpaceTimeGrid(float(radius_km), int(window_hours * 3600))
    slots, slot_state = written(
        add_runs(build_slots(detections, grid), grid), "slots", F.sum("n").alias("detections"))
    pairs, state = written(
        slot_pairs(slots, grid), "pairs",
        F.count_if(~F.col("certain")).alias("open"))
    nodes = slots.select("node").distinct()
    links = pairs.where("certain").select(F.col("a_node").alias("src"), F.col("b_node").alias("dst"))
    labels = _label_nodes(nodes, connected_components(links, place=grid.slot_tile(F.col("src")), whole=WHOLE_EDGES), slot_state["rows"])
    if state["open"]:
        labels = _settle_open_pairs(detections, pairs, labels, grid, state, slot_state["detections"])
    labelled = join_lookup(
        slots.select("slot_id", "node", "n"), labels, "node", slot_state["rows"])
    sizes = labelled.groupBy("component").agg(F.sum("n").alias("cluster_size"))
    result = join_lookup(labelled, sizes, "component", slot_state["rows"])
    final, totals = written(
        result.select("slot_id", "component", "cluster_size", "n"), "labels",
        F.sum("n").alias("total"), F.max("cluster_size").alias("largest"))
    return Clusters(grid, final, totals["total"] or 0, totals["largest"] or 0)


def _label_nodes(nodes: DataFrame, components: DataFrame, size: int) -> DataFrame:
    return join_lookup(nodes, components, "node", size, "left").select(
        "node", F.coalesce("component", "node").alias("component"))


def _settle_open_pairs(detections, pairs, labels, grid, state, rows) -> DataFrame:
    """Decide the slot pairs whose boxes did not, between components that are still apart."""
    labels, label_state = written(labels, "labels")
    side = lambda p: labels.select(
        F.col("node").alias(f"{p}_node"), F.col("component").alias(f"{p}_component"))
    zero = F.lit(0).cast("bigint")
    open_pairs = pairs.where("NOT certain")
    open_pairs = join_lookup(open_pairs, side("a"), "a_node", state["rows"])
    open_pairs = join_lookup(open_pairs, side("b"), "b_node", state["rows"])
    frontier, state = written(
        open_pairs.where("a_component <> b_component").select(
            "a_component", "b_component",
            F.col("a_slot_id").alias("a_slot"), zero.alias("a_row"), zero.alias("a_column"),
            F.col("b_slot_id").alias("b_slot"), zero.alias("b_row"), zero.alias("b_column")),
        "frontier")
    if state["rows"] == 0:
        return labels
    points = _frontier_points(detections, frontier, grid, state["rows"], rows)
    links = None
    undecided = state["rows"]
    level = 0
    while undecided:
        level += 1
        if level > MAX_LEVELS:
            raise RuntimeError("slot pairs stayed undecided at the finest cell size")
        tested, outcome = written(
            _refine(points, frontier, grid, level), "refined",
            F.count_if(F.col("certain")).alias("linked"))
        frontier = tested.where("NOT certain").drop("certain")
        undecided = outcome["rows"] - outcome["linked"]
        if outcome["linked"]:
            found = tested.where("certain").select(
                F.col("a_component").alias("src"), F.col("b_component").alias("dst")).distinct()
            links = found if links is None else links.unionByName(found)
        if outcome["linked"] and undecided:
            # Components just joined need no further test between them.
            frontier, state = written(
                frontier.join(found, (F.col("a_component") == F.col("src"))
                              & (F.col("b_component") == F.col("dst")), "left_anti"),
                "frontier")
            undecided = state["rows"]
    if links is None:
        return labels
    merged = connected_components(links, whole=WHOLE_EDGES).select(
        F.col("node").alias("component"), F.col("component").alias("merged"))
    return join_lookup(labels, merged, "component", label_state["rows"], "left").select(
        "node", F.coalesce("merged", "component").alias("component"))


def _frontier_points(
    detections: DataFrame, frontier: DataFrame, grid: SpaceTimeGrid, pairs: int, rows: int
) -> DataFrame:
    """Distinct positions, with their time extent, of the slots in the `pairs` still open."""
    open_slots = frontier.select(F.explode(F.array("a_slot", "b_slot")).alias("slot_id")).distinct()
    keyed = detections.select(
        _slot(grid).alias("slot_id"), "latitude", "longitude", F.unix_seconds("observed_at").alias("t"))
    if 2 * pairs <= settings.BROADCAST_ROWS:
        keyed = keyed.join(F.broadcast(open_slots), "slot_id", "left_semi")
    else:
        keyed = join_lookup(keyed, open_slots, "slot_id", rows, "left_semi")
    positions = keyed.groupBy("slot_id", "latitude", "longitude").agg(
        F.min("t").alias("t_low"), F.max("t").alias("t_high"))
    return written(positions, "positions")[0]


def _refine(points: DataFrame, frontier: DataFrame, grid: SpaceTimeGrid, level: int) -> DataFrame:
    """One level finer: pairs of sub-cells that may be linked, with `certain` where they surely are."""
    row, column = grid.sub_cell(F.col("latitude"), F.col("longitude"), level)
    cells = points.withColumns({"row": row, "column": column}).groupBy("slot_id", "row", "column").agg(
        *_boxes(F.min("t_low").alias("t_min"), F.max("t_high").alias("t_max")))
    first = level == 1
    parent = lambda c: F.lit(0).cast("bigint") if first else F.floor(F.col(c) / 4).cast("bigint")

    def side(p: str) -> DataFrame:
        return cells.select(
            F.col("slot_id").alias(f"{p}_slot"),
            parent("row").alias(f"{p}_row"), parent("column").alias(f"{p}_column"),
            F.col("row").alias(f"{p}_sub_row"), F.col("column").alias(f"{p}_sub_column"),
            *[F.col(c).alias(f"{p}_{c}")
              for c in ("lat_min", "lat_max", "lon_min", "lon_max", "t_min", "t_max")])

    pairs = frontier.join(side("a"), ["a_slot", "a_row", "a_column"]).join(
        side("b"), ["b_slot", "b_row", "b_column"]).where(_times_touch(grid.window_s))
    lower, upper = box_distance_bounds("a_", "b_")
    return pairs.where(lower <= grid.radius_km).select(
        "a_component", "b_component",
        "a_slot", F.col("a_sub_row").alias("a_row"), F.col("a_sub_column").alias("a_column"),
        "b_slot", F.col("b_sub_row").alias("b_row"), F.col("b_sub_column").alias("b_column"),
        (upper <= grid.radius_km).alias("certain"))
