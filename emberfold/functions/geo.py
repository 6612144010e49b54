"""Distances, envelopes and grid keys as Column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfold.functions.numeric import exact_round, plain_number_text
from emberfold.settings import (
    CLUSTER_RADIUS_KM, CLUSTER_WINDOW_HOURS, EARTH_RADIUS_KM, ENVELOPE_BUFFER_KM, ENVELOPE_MIN_COS,
    ENVELOPE_STEPS, KM_PER_DEGREE,
)


def _half_sine_sq(degrees: Column) -> Column:
    half = F.sin(F.radians(degrees) / 2)
    return half * half


def haversine_km(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Great-circle distance between two points in degrees."""
    h = _half_sine_sq(lat_b - lat_a) + (
        F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * _half_sine_sq(lon_b - lon_a)
    )
    return F.asin(F.sqrt(h)) * (2 * EARTH_RADIUS_KM)


def box_distance_bounds(a: str, b: str) -> tuple[Column, Column]:
    """(lower, upper) great-circle distance between any point of box `a` and any of box `b`.

    `a` and `b` are column prefixes of lat_min, lat_max, lon_min and lon_max. For two single points
    both bounds are the plain haversine distance.
    """
    col = lambda side, name: F.col(side + name)
    lat_gap = F.greatest(
        F.lit(0.0), col(b, "lat_min") - col(a, "lat_max"), col(a, "lat_min") - col(b, "lat_max"))
    lat_span = F.greatest(
        col(b, "lat_max") - col(a, "lat_min"), col(a, "lat_max") - col(b, "lat_min"))
    lon_gap = F.greatest(
        F.lit(0.0), col(b, "lon_min") - col(a, "lon_max"), col(a, "lon_min") - col(b, "lon_max"))
    lon_span = F.greatest(
        col(b, "lon_max") - col(a, "lon_min"), col(a, "lon_max") - col(b, "lon_min"))
    # sin^2 of half a longitude difference rises to 180 degrees and falls after it, so its extremes
    # over a range are at the ends unless the range contains 180.
    near, far = _half_sine_sq(lon_gap), _half_sine_sq(lon_span)
    lon_low = F.least(near, far)
    lon_high = F.when((lon_gap <= 180) & (lon_span >= 180), 1.0).otherwise(F.greatest(near, far))

    def cosines(side: str) -> tuple[Column, Column]:
        low, high = F.cos(F.radians(col(side, "lat_min"))), F.cos(F.radians(col(side, "lat_max")))
        spans_equator = (col(side, "lat_min") <= 0) & (col(side, "lat_max") >= 0)
        return F.least(low, high), F.when(spans_equator, 1.0).otherwise(F.greatest(low, high))

    (a_low, a_high), (b_low, b_high) = cosines(a), cosines(b)
    lower = _half_sine_sq(lat_gap) + a_low * b_low * lon_low
    upper = _half_sine_sq(lat_span) + a_high * b_high * lon_high
    km = lambda h: F.asin(F.sqrt(F.least(h, F.lit(1.0)))) * (2 * EARTH_RADIUS_KM)
    return km(lower), km(upper)


def envelope_ring(latitude: Column, longitude: Column, radius_km: float = ENVELOPE_BUFFER_KM) -> Column:
    """The points around one detection, counter-clockwise from the westernmost.

    That order is also the convex ring of a single detection, so it needs no hull.
    """
    lat_scale = radius_km / KM_PER_DEGREE
    cosine = F.greatest(F.cos(F.radians(latitude)), F.lit(ENVELOPE_MIN_COS))
    lon_scale = radius_km / (cosine * KM_PER_DEGREE)
    first = ENVELOPE_STEPS // 2
    points = []
    for step in [*range(first, ENVELOPE_STEPS), *range(first)]:
        angle = 2 * math.pi * step / ENVELOPE_STEPS
        points.append(F.struct(
            (latitude + lat_scale * math.sin(angle)).alias("latitude"),
            (longitude + lon_scale * math.cos(angle)).alias("longitude"),
        ))
    return F.array(*points)


def rounded_ring(ring: Column, digits: int = 5) -> Column:
    return F.transform(ring, lambda p: F.named_struct(
        F.lit("latitude"), exact_round(p["latitude"], digits),
        F.lit("longitude"), exact_round(p["longitude"], digits)))


def geojson_polygon(ring: Column) -> Column:
    """Compact GeoJSON Polygon text, closed, [longitude, latitude] order."""
    pairs = F.transform(ring, lambda p: F.concat(
        F.lit("["), plain_number_text(p["longitude"]), F.lit(","),
        plain_number_text(p["latitude"]), F.lit("]")))
    # As the element of an array the texts are made once, not for each mention.
    closed = F.element_at(F.transform(F.array(pairs), lambda texts: F.when(
        (F.size(texts) > 0) & (F.element_at(texts, 1) != F.element_at(texts, -1)),
        F.concat(texts, F.slice(texts, 1, 1)),
    ).otherwise(texts)), 1)
    return F.concat(
        F.lit('{"type":"Polygon","coordinates":[['), F.array_join(closed, ","), F.lit("]]}"))


def _floor(value: Column) -> Column:
    return F.floor(value).cast("bigint")


@dataclass(frozen=True)
class SpaceTimeGrid:
    """Cells that turn "within radius and window" into equality on keys.

    A *slot* is one small cell during one window-long time bin. Its sides are a quarter radius, so
    any two detections in a slot always satisfy both limits. A *block* is a large cell (2.8 radii)
    used only as a join key: everything within reach of a slot lies in the blocks that its padded
    box touches, four at most away from the poles.
    """

    radius_km: float = CLUSTER_RADIUS_KM
    window_s: int = CLUSTER_WINDOW_HOURS * 3600

    @property
    def cell_deg(self) -> float:
        return math.degrees(self.radius_km / 4 / EARTH_RADIUS_KM)

    @property
    def rows(self) -> int:
        return math.ceil(180 / self.cell_deg)

    @property
    def row_bits(self) -> int:
        return self.rows.bit_length()

    @property
    def column_bits(self) -> int:
        return math.ceil(360 / self.cell_deg).bit_length()

    @property
    def reach_deg(self) -> float:
        # Radius plus a slot diagonal (0.354 radii), with a margin for rounding.
        return math.degrees(1.4 * self.radius_km / EARTH_RADIUS_KM)

    @property
    def lat_reach(self) -> float:
        """Degrees of latitude that linked detections can be apart, with a margin for rounding."""
        return math.degrees(self.radius_km / EARTH_RADIUS_KM) * (1 + 1e-6)

    def lon_reach(self, south: str, north: str) -> Column:
        """Degrees of longitude that a detection linked to one between two latitudes can be away; near a pole, any."""
        poleward = F.greatest(F.abs(south), F.abs(north))
        ratio = F.lit(math.sin(math.radians(self.lat_reach))) / F.cos(F.radians(poleward))
        return F.when(poleward + self.lat_reach >= 89.9, 360.0).otherwise(
            F.degrees(F.asin(F.least(ratio, F.lit(1.0)))) * (1 + 1e-6))

    @property
    def block_deg(self) -> float:
        return 2 * self.reach_deg

    @property
    def first_bin(self) -> int:
        return -62135596800 // self.window_s  # year 1

    def __post_init__(self) -> None:
        if not self.radius_km > 0 or self.window_s <= 0:
            raise ValueError("radius and window must be positive")
        if self.radius_km > 500:
            raise ValueError("radius above 500 km is not a neighbourhood")
        last_bin = 253402300800 // self.window_s - self.first_bin  # year 9999
        if last_bin.bit_length() + self.row_bits + self.column_bits > 63:
            raise ValueError("radius and window are too small for 64-bit slot keys")

    def time_bin(self, seconds: Column) -> Column:
        return _floor(seconds / self.window_s) - self.first_bin

    def row(self, latitude: Column) -> Column:
        return F.least(_floor((latitude + 90.0) / self.cell_deg), F.lit(self.rows - 1).cast("bigint"))

    def columns(self, row: Column) -> Column:
        """Cells in one row: enough that the widest parallel of the row is cut into small sides."""
        south, north = row * self.cell_deg - 90.0, (row + 1) * self.cell_deg - 90.0
        nearest = F.when((south < 0) & (north > 0), 0.0).otherwise(F.least(F.abs(south), F.abs(north)))
        return F.greatest(
            F.ceil(F.cos(F.radians(nearest)) * (360.0 / self.cell_deg)).cast("bigint"),
            F.lit(1).cast("bigint"))

    def cell_id(self, latitude: Column, longitude: Column) -> Column:
        row = self.row(latitude)
        count = self.columns(row)
        column = F.least(_floor((longitude + 180.0) / 360.0 * count), count - 1)
        return F.shiftleft(row, self.column_bits).bitwiseOR(column)

    def slot_id(self, latitude: Column, longitude: Column, seconds: Column) -> Column:
        """One BIGINT: time bin in the high bits, so ids of one cell grow with time."""
        bits = self.row_bits + self.column_bits
        return F.shiftleft(self.time_bin(seconds), bits).bitwiseOR(self.cell_id(latitude, longitude))

    def slot_cell(self, slot: Column) -> Column:
        return slot.bitwiseAND(F.lit((1 << (self.row_bits + self.column_bits)) - 1))

    def slot_bin(self, slot: Column) -> Column:
        return F.shiftright(slot, self.row_bits + self.column_bits)

    def slot_tile(self, slot: Column, log2_cells: int = 5) -> Column:
        """A square of cells around a slot, over all times: where connected slots tend to be."""
        cell = self.slot_cell(slot)
        row = F.shiftright(cell, self.column_bits + log2_cells)
        column = F.shiftright(cell.bitwiseAND(F.lit((1 << self.column_bits) - 1)), log2_cells)
        return F.shiftleft(row, 32).bitwiseOR(column)

    def sub_cell(self, latitude: Column, longitude: Column, level: int) -> tuple[Column, Column]:
        """Cell of the grid refined `level` times (each side cut in four), nested in the parent."""
        fine = float(4**level)
        count = self.columns(self.row(latitude))
        return (
            _floor((latitude + 90.0) / self.cell_deg * fine),
            _floor((longitude + 180.0) / 360.0 * count * fine),
        )

    def _block_columns(self, block_row: Column) -> Column:
        """Blocks in one block row; at least block_deg wide on its narrowest parallel."""
        south = block_row * self.block_deg - 90.0
        farthest = F.greatest(F.abs(south), F.abs(south + self.block_deg))
        width = F.cos(F.radians(F.least(farthest, F.lit(90.0)))) * (360.0 / self.block_deg)
        return F.greatest(_floor(width), F.lit(1).cast("bigint"))

    def home_block(self, latitude: Column, longitude: Column) -> Column:
        row = _floor((latitude + 90.0) / self.block_deg)
        count = self._block_columns(row)
        column = F.pmod(_floor((longitude + 180.0) / 360.0 * count), count)
        return self._block_key(row, column)

    @staticmethod
    def _block_key(row: Column, column: Column) -> Column:
        return F.shiftleft(row, 32).bitwiseOR(column)

    def reachable_blocks(self, slots: DataFrame, prefix: str = "") -> DataFrame:
        """`slots` once for every block that may hold a slot corner within reach of its box, as `block`.

        Rows, then columns are exploded from plain bounds: a lambda over both would be interpreted, with
        its trigonometry, for every block of every slot.
        """
        lat_min, lat_max = F.col(prefix + "lat_min"), F.col(prefix + "lat_max")
        lon_min, lon_max = F.col(prefix + "lon_min"), F.col(prefix + "lon_max")
        reach = self.reach_deg
        poleward = F.greatest(F.abs(lat_min), F.abs(lat_max))
        ratio = F.sin(F.radians(F.lit(reach))) / F.cos(F.radians(poleward))
        pad = F.degrees(F.asin(F.least(ratio, F.lit(1.0))))
        first = _floor((F.greatest(lat_min - reach, F.lit(-90.0)) + 90.0) / self.block_deg)
        last = _floor((F.least(lat_max + reach, F.lit(90.0)) + 90.0) / self.block_deg)
        count, west = F.col("_count"), F.col("_west")
        rows = slots.withColumns({
            "_pad": pad, "_around": poleward + reach >= 89.9, "_row": F.explode(F.sequence(first, last))})
        sides = rows.withColumn("_count", self._block_columns(F.col("_row"))).withColumn(
            "_west", F.when(F.col("_around"), F.lit(0).cast("bigint")).otherwise(
                _floor((lon_min - F.col("_pad") + 180.0) / 360.0 * count)))
        east = F.when(F.col("_around"), count - 1).otherwise(
            F.least(_floor((lon_max + F.col("_pad") + 180.0) / 360.0 * count), west + count - 1))
        return (
            sides.withColumn("_column", F.explode(F.sequence(west, east)))
            .withColumn("block", self._block_key(F.col("_row"), F.pmod(F.col("_column"), count)))
            .select(*slots.columns, "block")
        )
