"""The hourly snapshot job: validate, cluster, keep identities, check, upsert."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberfold import settings
from emberfold.operators import history as H
from emberfold.operators import normalize as N
from emberfold.operators.incidents import assign_clusters, describe
from emberfold.session import pin_utc, scratch, written
from emberfold.sources import history as store


class StaleSource(RuntimeError):
    """A snapshot must come from fresh data."""


@dataclass
class Batch:
    """Rows of one snapshot, already written aside, and the counts seen while writing them."""

    detections: DataFrame
    clusters: DataFrame
    members: DataFrame
    detection_rows: int
    cluster_rows: int
    merged: int


def build_batch(
    detections: DataFrame, prior_of, at: datetime
) -> Batch:
    """Snapshot rows of normalised detections; `prior_of(facts, rows)` gives earlier assignments."""
    at = H.hour_of(N.utc(at))
    members, clusters = assign_clusters(detections)
    members, state = written(H.with_ids(members), "members")
    described, _ = written(describe(members, clusters.largest).drop("first_member"), "described")
    facts, unique = written(H.first_per_id(members), "facts")
    prior = prior_of(facts, unique["rows"])
    identities, merged = H.resolve_identities(facts, H.heads_of(described), prior)
    identities, merged = written(identities, "identities")[0], written(merged, "merged")[0]
    rows, row_state = written(
        H.snapshot_rows(described, facts, identities, merged, at), "cluster-rows",
        F.count_if(F.col("status") == "merged").alias("merged"))
    records, record_state = written(
        H.detection_facts(facts, identities, at, state["rows"]), "detection-rows")
    member_rows = H.snapshot_members(facts, identities, at, state["rows"])
    return Batch(records, rows, member_rows, record_state["rows"], row_state["rows"], row_state["merged"])


def run_snapshot(
    spark: SparkSession,
    source: DataFrame,
    root: str,
    at: datetime,
    days: int = 1,
    bounds: tuple[float, float, float, float] = settings.BOUNDS,
    stale: bool = False,
    storage_limit: int | None = None,
    held: DataFrame | None = None,
) -> DataFrame:
    """Write one fresh snapshot of raw detections to the history under `root`; returns the result row.

    Nothing is written when the source is stale, empty or invalid, when a relationship check fails,
    or when the tables are at their size limit. `held` adds normalised rows of earlier batches; a row of
    `source` replaces the held one of the same detection.
    """
    pin_utc(spark)
    if stale:
        raise StaleSource("a snapshot needs fresh data")
    with scratch(spark):
        return _run(spark, source, root, at, days, bounds, storage_limit, held)


def _run(spark, source, root, at, days, bounds, storage_limit, held) -> DataFrame:
    hour = H.hour_of(N.utc(at))
    clean, report = N.normalize(source, days, at, bounds)
    if held is not None:
        new = H.with_ids(clean).select("detection_id").distinct()
        kept = H.with_ids(held).join(new, "detection_id", "left_anti")
        clean = clean.unionByName(kept.select(*clean.columns))
    clean, state = written(
        clean, "clean", F.min(F.to_date("observed_at")).alias("start"),
        F.max(F.to_date("observed_at")).alias("end"))
    if state["rows"] == 0:
        N.require_valid_rows(report)
        return _result(spark, "no_data", hour, 0, 0, 0)

    def prior_of(facts: DataFrame, rows: int) -> DataFrame:
        past = store.read_history(spark, root, "fire_detections", state["start"], state["end"])
        return H.prior_assignments(facts, past, rows)

    batch = build_batch(clean, prior_of, at)
    store.check_relationships(batch.detections, batch.clusters)
    store.check_storage(spark, root, storage_limit)
    store.upsert(spark, root, {
        "fire_clusters": batch.clusters, "fire_cluster_members": batch.members, "fire_detections": batch.detections})
    return _result(
        spark, "ingested", hour, batch.detection_rows, batch.cluster_rows, batch.merged)


def _result(spark, status, hour, detections, clusters, merged) -> DataFrame:
    return spark.range(1).select(
        F.lit(status).alias("status"), F.lit(hour).cast("timestamp").alias("snapshot_at"),
        F.lit(detections).cast("bigint").alias("detections_processed"),
        F.lit(clusters).cast("bigint").alias("cluster_snapshots_processed"),
        F.lit(merged).cast("bigint").alias("clusters_merged"))
