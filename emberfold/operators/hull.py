"""Convex envelopes per cluster. Python only ever holds a bounded number of positions at once."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberfold.session import written
from emberfold.settings import (
    ENVELOPE_BUFFER_KM, ENVELOPE_MIN_COS, ENVELOPE_STEPS, KM_PER_DEGREE, POINT,
)

PART_POSITIONS = 4_000
RING_POSITIONS = 20_000  # of rows whose hulls are made at once, one row at least


_ANGLES = [2 * math.pi * k / ENVELOPE_STEPS for k in range(ENVELOPE_STEPS)]
_SINES, _COSINES = np.array([math.sin(a) for a in _ANGLES]), np.array([math.cos(a) for a in _ANGLES])


def _chain(sequence) -> list[tuple[float, float]]:
    """One side of a hull: points in order, without the last one and those that turn right or not at all."""
    kept = []
    for p in sequence:
        x, y = p
        while len(kept) > 1:
            (ox, oy), (ax, ay) = kept[-2], kept[-1]
            if (ax - ox) * (y - oy) - (ay - oy) * (x - ox) <= 0:
                kept.pop()
            else:
                break
        kept.append(p)
    return kept[:-1]


def convex_ring(points) -> list[tuple[float, float]]:
    """Counter-clockwise hull of (longitude, latitude) pairs from the westernmost, not closed."""
    ordered = sorted(set(points))
    if len(ordered) < 2:
        return ordered
    return _chain(ordered) + _chain(ordered[::-1])


def _circles(longitudes: np.ndarray, latitudes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longitudes and latitudes of the points around positions, one position after the other."""
    shrink = np.array([max(math.cos(math.radians(v)), ENVELOPE_MIN_COS) for v in latitudes.tolist()])
    lon_scale = ENVELOPE_BUFFER_KM / (KM_PER_DEGREE * shrink)
    lat_scale = ENVELOPE_BUFFER_KM / KM_PER_DEGREE
    lons = (longitudes[:, None] + lon_scale[:, None] * _COSINES).ravel()
    lats = (latitudes[:, None] + lat_scale * _SINES).ravel()
    return lons, lats


def _buffered(longitudes, latitudes):
    lons, lats = _circles(np.asarray(longitudes), np.asarray(latitudes))
    return zip(lons.tolist(), lats.tolist())


def _rings(longitudes: np.ndarray, latitudes: np.ndarray, sizes: np.ndarray) -> Iterator[list[tuple[float, float]]]:
    """Hull of the buffered positions of each row, which has `sizes` of them, two or more, as `convex_ring` gives it.

    The points of all rows are sorted at once. Those above the line from a row's first point to its last are on no lower
    side, those below it on no upper one: circles are wide, so no point near either side is left out.
    """
    lons, lats = _circles(longitudes, latitudes)
    row = np.repeat(np.arange(len(sizes)), sizes * ENVELOPE_STEPS)
    order = np.lexsort((lats, lons, row))
    lons, lats = lons[order], lats[order]
    new = np.ones(len(row), bool)
    new[1:] = (lons[1:] != lons[:-1]) | (lats[1:] != lats[:-1]) | (row[1:] != row[:-1])
    lons, lats, row = lons[new], lats[new], row[new]
    counts = np.bincount(row, minlength=len(sizes))
    last = (np.cumsum(counts) - 1)[row]
    first = last - counts[row] + 1
    side = (lons[last] - lons[first]) * (lats - lats[first]) - (lats[last] - lats[first]) * (lons - lons[first])
    place = np.arange(len(row))
    ends = (place == first) | (place == last)

    def sequences(kept: np.ndarray) -> Iterator[list[tuple[float, float]]]:
        points = list(zip(lons[kept].tolist(), lats[kept].tolist()))
        stops = np.cumsum(np.bincount(row[kept], minlength=len(sizes))).tolist()
        return (points[start:stop] for start, stop in zip([0, *stops], stops))

    for lower, upper in zip(sequences(ends | (side < 0)), sequences(ends | (side > 0))):
        yield _chain(lower) + _chain(upper[::-1])


def _rounded(values: np.ndarray, digits: int = 5) -> np.ndarray:
    """`numeric.exact_round`, by the same operations."""
    scale = float(10**digits)
    wide = values * 134217729.0
    high = wide - (wide - values)
    product = values * scale
    error = (high * scale - product) + (values - high) * scale
    whole = np.floor(product)
    up = (product - whole - 0.5) + error > np.where(whole % 2 != 0, -5e-324, 0.0)
    return np.where(np.abs(values) < 1e15 / scale, (whole + up) / scale, values)


@F.arrow_udf(T.ArrayType(POINT))
def _envelopes(longitudes: pa.Array, latitudes: pa.Array) -> pa.Array:
    """Hull of the buffered positions of each row, rounded; NULL rows stay NULL."""
    sizes = pc.fill_null(pc.list_value_length(longitudes), 0).to_numpy().astype(np.int64)
    lons, lats = (a.flatten().to_numpy(zero_copy_only=False) for a in (longitudes, latitudes))
    # The points around one position are its hull, counter-clockwise from the westernmost.
    single = sizes == 1
    alone = np.repeat(single, sizes)
    rounds = np.stack(_circles(lons[alone], lats[alone]), axis=1).reshape(-1, ENVELOPE_STEPS, 2)
    counts = np.where(single, ENVELOPE_STEPS, 0)
    parts, rows, start = [], np.flatnonzero(sizes > 1), 0
    lons, lats = lons[~alone], lats[~alone]
    ends = np.cumsum(sizes[rows])
    while start < len(rows):
        before = int(ends[start] - sizes[rows[start]])
        stop = max(start + 1, int(np.searchsorted(ends, before + RING_POSITIONS, side="right")))
        inside = slice(before, int(ends[stop - 1]))
        rings = list(_rings(lons[inside], lats[inside], sizes[rows[start:stop]]))
        counts[rows[start:stop]] = [len(ring) for ring in rings]
        parts.append(np.array([p for ring in rings for p in ring]))
        start = stop
    points = np.empty((int(counts.sum()), 2))
    own = np.repeat(single, counts)
    points[own] = np.roll(rounds, -(ENVELOPE_STEPS // 2), axis=1).reshape(-1, 2)
    points[~own] = np.concatenate([np.empty((0, 2)), *parts])
    points = _rounded(points)
    bounds = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    values = pa.StructArray.from_arrays([pa.array(points[:, 1].copy()), pa.array(points[:, 0].copy())], names=POINT.names)
    return pa.ListArray.from_arrays(bounds, values, mask=longitudes.is_null())


def envelope_of_lists(longitudes: Column, latitudes: Column) -> Column:
    """Ring of POINT, rounded, for arrays of positions; pass NULL where no hull is wanted."""
    return _envelopes(longitudes, latitudes)


_RING = T.StructType([
    T.StructField("component", T.LongType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("latitude", T.DoubleType()),
])


def _part_hull(frame: pd.DataFrame) -> pd.DataFrame:
    ring = convex_ring(zip(frame["longitude"].tolist(), frame["latitude"].tolist()))
    lons, lats = zip(*ring)
    return pd.DataFrame({"component": frame["component"].iloc[0], "longitude": lons, "latitude": lats})


def _part_envelope(frame: pd.DataFrame) -> pd.DataFrame:
    points = _buffered(frame["longitude"].to_numpy(), frame["latitude"].to_numpy())
    lons, lats = zip(*convex_ring(points))
    return pd.DataFrame({"component": frame["component"].iloc[0], "longitude": lons, "latitude": lats})


def _largest_group(points: DataFrame) -> int:
    sizes = points.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.max("n")).first()[0] or 0


def envelopes_of_large(members: DataFrame, part: int = PART_POSITIONS) -> DataFrame:
    """(component, boundary) for clusters of any size, as hulls of hulls.

    The positions of a cluster are spread over parts of about `part` rows, each part shrinks to its
    hull, and the hull vertices are spread again until one part per cluster is left. The hull of
    partial hulls is the hull of everything, so no task ever holds a whole cluster. A pass that drops
    less than a tenth of the largest cluster's points ends the spreading: what is left is nearly all
    of the final ring, which is one value of the result anyway.
    """
    points = members.select("component", "longitude", "latitude").distinct()
    shrink = _part_envelope
    before = None
    while True:
        points = written(points, "hull-points")[0]
        largest = _largest_group(points)
        stuck = before is not None and largest > 0.9 * before
        parts = 1 if stuck else max(1, math.ceil(largest / part))
        # The first pass adds a ring around each position, so only later ones can be compared.
        before = largest if shrink is _part_hull else None
        salt = F.pmod(F.xxhash64("longitude", "latitude"), F.lit(parts)).alias("salt")
        points = (
            points.select("component", salt, "longitude", "latitude")
            .groupBy("component", "salt").applyInPandas(shrink, _RING)
        )
        if parts == 1:
            break
        shrink = _part_hull
    # The last pass left one counter-clockwise ring per cluster, at most a few dozen vertices;
    # order it by angle around its centre, starting at the westernmost vertex.
    centre = points.groupBy("component").agg(
        F.avg("longitude").alias("cx"), F.avg("latitude").alias("cy"))
    turned = points.join(centre, "component").select(
        "component",
        F.struct(
            F.atan2(F.col("latitude") - F.col("cy"), F.col("longitude") - F.col("cx")).alias("angle"),
            "longitude", "latitude").alias("vertex"))
    rings = turned.groupBy("component").agg(
        F.array_sort(F.collect_list("vertex")).alias("ring"),
        F.min(F.struct("vertex.longitude", "vertex.latitude", "vertex.angle")).alias("first"))
    start = F.array_position(F.transform("ring", lambda v: v["angle"]), F.col("first.angle")).cast("int")
    rotated = F.concat(F.slice("ring", start, F.size("ring")), F.slice("ring", F.lit(1), start - 1))
    return rings.select("component", F.transform(rotated, lambda v: F.named_struct(
        F.lit("latitude"), v["latitude"], F.lit("longitude"), v["longitude"])).alias("boundary"))

