"""Aggregates over detections and incidents. All are mergeable: one small shuffle each."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberfold.functions.numeric import exact_round, exact_sum
from emberfold.settings import PERSISTENT_HOURS


def summarize(detections: DataFrame) -> DataFrame:
    """Row count, mean and maximum FRP (2 decimals, 0 when no FRP is known) as one row."""
    raw = detections.agg(
        F.count(F.lit(1)).alias("total_detections"),
        (exact_sum(F.col("frp")) / F.count("frp")).alias("mean_frp"),
        F.max("frp").alias("max_frp"),
    )
    return raw.select(
        "total_detections",
        F.coalesce(exact_round(F.col("mean_frp"), 2), F.lit(0.0)).alias("average_frp"),
        F.coalesce(exact_round(F.col("max_frp"), 2), F.lit(0.0)).alias("maximum_frp"),
    )


def counts_by_satellite(detections: DataFrame) -> DataFrame:
    """Detections per satellite, most frequent first."""
    return (
        detections.groupBy("satellite").agg(F.count(F.lit(1)).alias("detections"))
        .orderBy(F.desc("detections"), "satellite")
    )


def collection_overview(incidents: DataFrame) -> DataFrame:
    """Cluster count, grouped detections, highest total FRP and clusters lasting six hours or more."""
    return incidents.agg(
        F.count(F.lit(1)).alias("possible_clusters"),
        F.coalesce(F.sum("detection_count"), F.lit(0)).alias("grouped_detections"),
        F.max("total_frp_mw").alias("highest_total_frp_mw"),
        F.count_if(F.col("duration_hours") >= PERSISTENT_HOURS).alias("persistent_clusters"),
    )


def severity_histogram(snapshots: DataFrame, today: date, days: int = 7) -> DataFrame:
    """Active snapshots per severity since `today - days`; the date range prunes partitions."""
    recent = (F.col("snapshot_date") >= F.lit(today - timedelta(days=days))) & (
        F.col("status") == "active")
    return (
        snapshots.where(recent).groupBy("severity").agg(F.count(F.lit(1)).alias("snapshot_count"))
        .orderBy(F.desc("snapshot_count"), "severity")
    )


def satellites_per_incident(members: DataFrame, described: DataFrame) -> DataFrame:
    """Distinct satellites of each incident in first-seen order, or 'Unknown'.

    Rows shrink to one per cluster and satellite before the few names of a cluster meet.
    """
    named = members.where(F.col("satellite").isNotNull() & (F.col("satellite") != ""))
    first = named.groupBy("component", "satellite").agg(F.min("place").alias("place"))
    names = first.groupBy("component").agg(F.array_sort(F.collect_list(F.struct("place", "satellite"))).alias("seen"))
    joined = F.array_join(F.transform("seen", lambda s: s["satellite"]), ", ")
    return described.join(names, "component", "left").select(
        "id", F.coalesce(joined, F.lit("Unknown")).alias("satellites"))
