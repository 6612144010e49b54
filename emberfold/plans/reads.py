"""Answers about the last days, composed from the partial statistics that the history keeps of each date.

A window of N days reads the partial rows of the dates that lie inside it, a few rows of each date, and
the detections of the two dates that its ends cut. The result equals a scan of all detections.
"""

from __future__ import annotations

from datetime import date, datetime, time, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberfold import settings
from emberfold.functions.numeric import exact_round
from emberfold.operators.normalize import instant, utc
from emberfold.sources import history as store
from emberfold.sources.history import Manifest

DAILY = "fire_daily_detections"


def _midnight(day: date) -> datetime:
    return datetime.combine(day, time(), timezone.utc)


def window_partials(
    spark: SparkSession, root: str, low: datetime, high: datetime, manifest: Manifest | None = None
) -> DataFrame:
    """Partial rows of the detections observed between two moments, both inclusive.

    A date may come as several rows; counts and sums add up, maxima compare.
    """
    low, high = utc(low), utc(high)
    manifest = manifest or store.read_manifest(spark, root)
    first = low.date() if low == _midnight(low.date()) else low.date() + timedelta(days=1)
    last = (high + timedelta(microseconds=1)).date() - timedelta(days=1)
    # Whole dates are first .. last; without any, the window's dates are read as one cut range.
    cut = [(low.date(), first - timedelta(days=1)), (last + timedelta(days=1), high.date())]
    if first > last:
        cut = [(low.date(), high.date())]
    parts = [store.read_partials(spark, root, DAILY, first, last, manifest)] if first <= last else []
    inside = F.col("observed_at").between(instant(low), instant(high))
    for start, end in cut:
        if start <= end:
            rows = store.read_history(spark, root, "fire_detections", start, end, manifest)
            parts.append(store.partials(rows.where(inside), DAILY))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _window(now: datetime, days: int) -> tuple[datetime, datetime]:
    return utc(now) - timedelta(days=days), utc(now) + timedelta(seconds=settings.FUTURE_TOLERANCE_S)


def _totals() -> list[Column]:
    mean = (F.sum("exact_frp").cast("double") + F.sum("rest_frp")) / F.sum("known_frp")
    return [
        F.coalesce(F.sum("detections"), F.lit(0)).alias("total_detections"),
        F.when(F.sum("known_frp") > 0, mean).alias("mean"), F.max("maximum_frp_mw").alias("top")]


def _rounded(totals: DataFrame, *keys: str) -> DataFrame:
    return totals.select(
        *keys, "total_detections", F.coalesce(exact_round(F.col("mean"), 2), F.lit(0.0)).alias("average_frp"),
        F.coalesce(exact_round(F.col("top"), 2), F.lit(0.0)).alias("maximum_frp"))


def rolling_summary(spark: SparkSession, root: str, now: datetime, days: list[int]) -> DataFrame:
    """days, total_detections, average_frp, maximum_frp of the last N days, for each N; zeros when there are none."""
    manifest = store.read_manifest(spark, root)
    answers = [
        _rounded(window_partials(spark, root, *_window(now, n), manifest).agg(*_totals())).select(
            F.lit(n).cast("bigint").alias("days"), "total_detections", "average_frp", "maximum_frp")
        for n in sorted(set(days))]
    whole = answers[0]
    for answer in answers[1:]:
        whole = whole.unionByName(answer)
    return whole


def rolling_by_satellite(spark: SparkSession, root: str, now: datetime, days: int) -> DataFrame:
    """The same of each satellite, most frequent first."""
    parts = window_partials(spark, root, *_window(now, days))
    return _rounded(parts.groupBy("satellite").agg(*_totals()), "satellite").orderBy(
        F.desc("total_detections"), "satellite")


def compare_periods(spark: SparkSession, root: str, now: datetime, days: int) -> DataFrame:
    """Per satellite, the last N days beside the N days before: detections, average and maximum FRP of both, and the change.

    A satellite of one period alone has zeros in the other. The moment between the periods is in the last one.
    """
    manifest = store.read_manifest(spark, root)
    low, high = _window(now, days)
    periods = {"": (low, high), "earlier_": (low - timedelta(days=days), low - timedelta(microseconds=1))}
    rows = None
    for name, (start, end) in periods.items():
        part = window_partials(spark, root, start, end, manifest).withColumn("period", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    facts = _rounded(rows.groupBy("satellite", "period").agg(*_totals()), "satellite", "period")
    value = lambda name, zero, period: F.coalesce(
        F.max(F.when(F.col("period") == period, F.col(name))), F.lit(zero)).alias(period + name)
    columns = [("total_detections", 0), ("average_frp", 0.0), ("maximum_frp", 0.0)]
    return facts.groupBy("satellite").agg(*[value(*c, p) for p in periods for c in columns]).withColumn(
        "change_detections", F.col("total_detections") - F.col("earlier_total_detections"))


def severity_history(spark: SparkSession, root: str, today: date, days: int = 7) -> DataFrame:
    """Active snapshots per severity since `today - days`, from the partial rows of the snapshot dates."""
    # Snapshots may lie ahead of `today`, as in a scan without an upper bound.
    rows = store.read_partials(spark, root, "fire_daily_clusters", today - timedelta(days=days), date.max)
    return rows.where("status = 'active'").groupBy("severity").agg(
        F.sum("snapshot_count").alias("snapshot_count")).orderBy(F.desc("snapshot_count"), "severity")
