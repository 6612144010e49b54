"""Hourly series of clusters, and how persistent and how rising each one is.

A series is gap-filled: hours between a key's first and last detection that have none count as zero. Rows
are summed by (key, hour) before they move, so a key with most of the rows becomes one row for each of its hours.
The line through a series is fitted from mergeable sums alone; empty hours need no rows for that.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberfold.operators.normalize import instant

HOUR_S = 3600
EXACT = "decimal(38,0)"


def _hour(moment: Column) -> Column:
    """Whole hours since 1970."""
    return F.floor(F.unix_timestamp(moment) / HOUR_S).cast("long")


def hour_sums(detections: DataFrame, key: str, now: datetime, frp: str = "frp_mw") -> DataFrame:
    """(key, hour, detections, cents) of the detections up to `now`; FRP in hundredths, null as zero.

    Rows without a key or a time have no series and take no part.
    """
    kept = detections.where(F.col(key).isNotNull() & (F.col("observed_at") <= instant(now)))
    cents = F.coalesce(F.round(F.col(frp) * 100).cast("long"), F.lit(0)).cast(EXACT)
    return kept.groupBy(key, _hour(F.col("observed_at")).alias("hour")).agg(
        F.count(F.lit(1)).alias("detections"), F.sum(cents).alias("cents"))


def hourly_series(detections: DataFrame, key: str, now: datetime, frp: str = "frp_mw") -> DataFrame:
    """(key, hour_start, detections, total_frp) for every hour from a key's first detection to its last."""
    sums = hour_sums(detections, key, now, frp)
    after = F.lead("hour").over(W.partitionBy(key).orderBy("hour"))
    # Each hour with detections brings the empty ones behind it.
    filled = sums.withColumn("next", F.coalesce(after, F.col("hour") + 1)).select(
        key, "hour", "detections", "cents", F.explode(F.sequence("hour", F.col("next") - 1)).alias("at"))
    own = F.col("at") == F.col("hour")
    return filled.select(
        key, F.timestamp_seconds(F.col("at") * HOUR_S).alias("hour_start"),
        F.when(own, F.col("detections")).otherwise(0).alias("detections"),
        F.when(own, F.col("cents").cast("double") / 100).otherwise(0.0).alias("total_frp"))


def persistence(detections: DataFrame, key: str, now: datetime, frp: str = "frp_mw") -> DataFrame:
    """One row for each key: how long it lasts, its longest pause, and where its hourly FRP is heading.

    span_hours counts from the first hour to the last, active_hours those with detections, longest_pause_hours
    empty ones in a row. slope_mw_per_hour is the least-squares slope of the gap-filled series, null for one
    hour. last_24h_frp and before_24h_frp sum the 24 hours that end with the hour of `now` and the 24
    before them; change_frp is their difference.
    """
    sums = hour_sums(detections, key, now, frp)
    pause = F.col("hour") - F.lag("hour").over(W.partitionBy(key).orderBy("hour")) - 1
    end = _hour(instant(now))
    within = lambda low, high: F.sum(F.when(
        (F.col("hour") > end - high) & (F.col("hour") <= end - low), F.col("cents")).otherwise(F.lit(0).cast(EXACT)))
    raw = sums.withColumn("pause", F.coalesce(pause, F.lit(0))).groupBy(key).agg(
        F.min("hour").alias("first"), F.max("hour").alias("last"), F.count(F.lit(1)).alias("active_hours"),
        F.max("pause").alias("longest_pause_hours"), F.sum("detections").alias("detections"),
        F.sum("cents").alias("y"), F.sum(F.col("hour").cast("decimal(10,0)") * F.col("cents").cast("decimal(27,0)")).alias("hy"),
        within(0, 24).alias("recent"), within(24, 48).alias("earlier"))
    n = F.col("last") - F.col("first") + 1
    # With x = 0 .. n-1 the slope is 6 (2 sum(xy) - (n-1) sum(y)) / (n (n^2 - 1)).
    lean = 2 * (F.col("hy") - F.col("first").cast("decimal(10,0)") * F.col("y").cast("decimal(27,0)")) - (
        (n - 1).cast("decimal(10,0)") * F.col("y").cast("decimal(27,0)"))
    size = n.cast("double")
    slope = 6 * lean.cast("double") / (size * (size * size - 1)) / 100
    mw = lambda cents: cents.cast("double") / 100
    return raw.select(
        key, n.alias("span_hours"), "active_hours", "longest_pause_hours", "detections",
        mw(F.col("y")).alias("total_frp"), F.when(n > 1, slope).alias("slope_mw_per_hour"),
        mw(F.col("recent")).alias("last_24h_frp"), mw(F.col("earlier")).alias("before_24h_frp"),
        mw(F.col("recent") - F.col("earlier")).alias("change_frp"))
