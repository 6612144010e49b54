"""Stable cluster identity across hourly snapshots, and the rows each snapshot adds to history."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfold import settings
from emberfold.functions.geo import geojson_polygon
from emberfold.functions.numeric import fixed_text
from emberfold.operators.bloom import likely
from emberfold.operators.incidents import iso_utc
from emberfold.operators.joins import join_lookup
from emberfold.session import written
from emberfold.settings import FIRE_CLUSTERS, FIRE_DETECTIONS, SOURCE_DATASET


def snapshot_hour(moment: Column) -> Column:
    """One key per UTC hour, so repeated runs of an hour write the same rows."""
    return F.date_trunc("hour", moment)


def hour_of(moment: datetime) -> datetime:
    return moment.replace(minute=0, second=0, microsecond=0)


def detection_id(dataset: str = SOURCE_DATASET) -> Column:
    """Identity of one physical observation, independent of the values that may change later."""
    satellite = F.regexp_replace("satellite", r"^[\p{Z}\s]+|[\p{Z}\s]+$", "")
    return F.sha2(F.concat_ws(
        "|", F.lit(dataset), satellite, iso_utc(F.col("observed_at")),
        fixed_text(F.col("latitude"), 5), fixed_text(F.col("longitude"), 5)), 256)


def first_per_id(members: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per detection_id (or other keys): the first in (time, position, satellite) order.

    A mergeable minimum, so any number of copies of one observation collapses before the shuffle.
    """
    order = ["observed_at", "latitude", "longitude", "satellite", "confidence", "frp"]
    keys = keys or ["detection_id"]
    rest = [c for c in members.columns if c not in [*order, *keys]]
    return (
        members.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("row"))
        .select(*keys, "row.*")
    )


def prior_assignments(batch_ids: DataFrame, history: DataFrame, rows: int) -> DataFrame:
    """(detection_id, prior_id) of batch detections already in history.

    `history` is a date-pruned read; a small batch is broadcast after its size is known. Of a larger
    one a Bloom filter goes to the history, so that only likely matches are shuffled to the join.
    """
    ids = batch_ids.select("detection_id").distinct()
    if rows <= settings.BROADCAST_ROWS:
        ids = F.broadcast(ids)
    else:
        history = likely(history, batch_ids, ["detection_id"], rows)
    return history.join(ids, "detection_id", "left_semi").select(
        "detection_id", F.col("cluster_id").alias("prior_id"))


def new_cluster_ids(facts: DataFrame) -> DataFrame:
    """(component, new_id): hash of the earliest member (smallest id on ties) of each component."""
    anchor = F.min(F.struct("observed_at", "detection_id"))["detection_id"]
    return facts.groupBy("component").agg(
        F.concat(F.lit("cluster-"), F.substring(F.sha2(anchor, 256), 1, 16)).alias("new_id"))


def resolve_identities(
    facts: DataFrame, heads: DataFrame, prior: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """((component, cluster_id), (component, merged_id)) of one snapshot.

    facts: component, detection_id, observed_at. heads: component, first_detected_at, incident_id.
    prior: detection_id, prior_id.

    Each earlier id belongs to the component with the smallest (first_detected_at, incident_id)
    among those holding one of its detections. A component keeps the id of its earliest assigned
    detection among the ids it owns; its other ids are merged into that one; a component that owns
    none gets a new id. Ownership per id replaces any order-dependent walk over components.
    """
    held = (
        facts.join(prior, "detection_id")
        .groupBy("component", "prior_id").agg(F.min("observed_at").alias("seen_at"))
    )
    ranked = held.join(heads, "component").withColumn(
        "rank", F.struct("first_detected_at", "incident_id", "component"))
    owners = ranked.groupBy("prior_id").agg(F.min("rank")["component"].alias("component"))
    owned = held.join(owners, ["component", "prior_id"], "left_semi")
    kept = owned.groupBy("component").agg(
        F.min(F.struct("seen_at", "prior_id"))["prior_id"].alias("kept_id"))
    identities = new_cluster_ids(facts).join(kept, "component", "left").select(
        "component", F.coalesce("kept_id", "new_id").alias("cluster_id"))
    merged = owned.join(kept, "component").where("prior_id <> kept_id").select(
        "component", F.col("prior_id").alias("merged_id"))
    return identities, merged


def collisions(identities: DataFrame, merged: DataFrame) -> DataFrame:
    """Ids claimed twice in one snapshot: a new id can equal an earlier one that lives on elsewhere."""
    claims = identities.select("cluster_id").unionByName(
        merged.select(F.col("merged_id").alias("cluster_id")))
    return claims.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("claims")).where("claims > 1")


def _moment(at: datetime | Column) -> Column:
    return at if isinstance(at, Column) else F.lit(at).cast("timestamp")


def snapshot_rows(
    described: DataFrame, facts: DataFrame, identities: DataFrame, merged: DataFrame, at: datetime | Column,
    each: Column | None = None,
) -> DataFrame:
    """Active rows of every cluster plus one tombstone per merged id, in the history schema.

    `each` is an array of snapshots, from `at` on, that have the active row; it comes back as a column, for `in_each`.
    """
    counted = facts.groupBy("component").agg(F.count(F.lit(1)).alias("distinct_members"))
    moment = _moment(at)
    whole = described.join(counted, "component").join(identities, "component").withColumn("snapshot_at", moment)
    if each is not None:
        whole = whole.withColumn("each", each)
    drawn = lambda rows: rows.withColumn("boundary", geojson_polygon(F.col("boundary")))
    further = [] if each is None else ["each"]
    shared = ["snapshot_at", "center", "boundary"]
    times = ["first_detected_at", "last_detected_at", "confidence", "trend", "severity"]
    tail = [F.lit(SOURCE_DATASET).alias("source_dataset"), F.col("snapshot_at").cast("date").alias("snapshot_date")]
    active = drawn(whole).select(
        "cluster_id", *shared, F.col("distinct_members").alias("detection_count"), "total_frp_mw", "maximum_frp_mw", *times,
        F.lit("active").alias("status"), F.lit(None).cast("string").alias("merged_into_cluster_id"),
        *tail, *further)
    tombstones = drawn(whole.join(merged, "component")).select(
        F.col("merged_id").alias("cluster_id"), *shared,
        F.lit(0).cast("bigint").alias("detection_count"), F.lit(0.0).alias("total_frp_mw"),
        F.lit(0.0).alias("maximum_frp_mw"), *times, F.lit("merged").alias("status"),
        F.col("cluster_id").alias("merged_into_cluster_id"), *tail, *([F.array("snapshot_at").alias("each")] if further else []))
    return active.unionByName(tombstones).select(*[f.name for f in FIRE_CLUSTERS], *further)


def snapshot_members(
    facts: DataFrame, identities: DataFrame, at: datetime | Column, total_rows: int, each: Column | None = None
) -> DataFrame:
    """One row per detection of a cluster in this snapshot, in the history schema; `each` as of `snapshot_rows`."""
    rows = join_lookup(facts, identities, "component", total_rows)
    further = [] if each is None else [each.alias("each")]
    return rows.select("cluster_id", _moment(at).alias("snapshot_at"), "detection_id", *further).withColumn(
        "snapshot_date", F.col("snapshot_at").cast("date"))


def in_each(rows: DataFrame) -> DataFrame:
    """Rows repeated for the snapshots of their array `each`."""
    names = [c for c in rows.columns if c != "each"]
    return rows.withColumn("snapshot_at", F.explode("each")).withColumn(
        "snapshot_date", F.col("snapshot_at").cast("date")).select(*names)


def detection_facts(
    facts: DataFrame, identities: DataFrame, at: datetime | Column, total_rows: int, first: Column | None = None
) -> DataFrame:
    """One row per distinct detection with its cluster, in the history schema; `first` came in a snapshot before."""
    moment = _moment(at)
    flags = F.col("quality_flags") if "quality_flags" in facts.columns else F.array().cast("array<string>")
    return join_lookup(facts, identities, "component", total_rows).select(
        "detection_id", "cluster_id", moment.alias("cluster_snapshot_at"), "observed_at",
        "latitude", "longitude", F.struct("latitude", "longitude").alias("position"),
        "satellite", "confidence", F.when(F.col("frp") >= 0, F.col("frp")).alias("frp_mw"),
        flags.alias("quality_flags"), F.lit(SOURCE_DATASET).alias("source_dataset"),
        (moment if first is None else first).alias("first_ingested_at"), moment.alias("last_ingested_at"),
        F.to_date("observed_at").alias("observation_date"),
    ).select(*[f.name for f in FIRE_DETECTIONS])


def heads_of(described: DataFrame) -> DataFrame:
    return described.select("component", "first_detected_at", F.col("id").alias("incident_id"))


def with_ids(members: DataFrame) -> DataFrame:
    return members.withColumn("detection_id", detection_id())


def merged_lineage(snapshots: DataFrame, rounds: int = 20) -> DataFrame:
    """(cluster_id, survivor) of merged ids, following chains of merges by doubling."""
    step = (
        snapshots.where("status = 'merged'")
        .groupBy("cluster_id").agg(F.max(F.struct("snapshot_at", "merged_into_cluster_id")).alias("last"))
        .select("cluster_id", F.col("last.merged_into_cluster_id").alias("survivor"))
    )
    current, _ = written(step, "lineage")
    for _ in range(rounds):
        onward = current.select(F.col("cluster_id").alias("survivor"), F.col("survivor").alias("next"))
        current, state = written(
            current.join(onward, "survivor", "left").select(
                "cluster_id", F.coalesce("next", "survivor").alias("survivor"),
                F.col("next").isNotNull().alias("moved")),
            "lineage", F.count_if(F.col("moved")).alias("moved"))
        current = current.drop("moved")
        if not state["moved"]:
            return current
    raise RuntimeError("merge chains form a cycle")


