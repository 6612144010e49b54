"""Incident records: one row per cluster with totals, trend, severity, identity and envelope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfold import settings
from emberfold.functions.geo import rounded_ring
from emberfold.functions.labels import severity
from emberfold.functions.numeric import exact_round, exact_sum, fixed_text
from emberfold.operators import hull
from emberfold.operators.joins import join_lookup
from emberfold.operators.links import Clusters, find_clusters
from emberfold.operators.normalize import coerce_for_clustering
from emberfold.operators.ranking import with_place
from emberfold.session import written
from emberfold.settings import DETECTION_COLUMNS

MEMBER_ORDER = ["observed_at", "latitude", "longitude", "satellite", "frp"]
INCIDENT_COLUMNS = [
    "id", "center", "boundary", "detection_count", "total_frp_mw", "maximum_frp_mw",
    "first_detected_at", "last_detected_at", "duration_hours", "confidence", "trend", "severity",
]


def iso_utc(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ssxxx")


def fingerprint() -> Column:
    """The stable source fields of one detection as text."""
    return F.concat_ws(
        ",", fixed_text(F.col("latitude"), 5), fixed_text(F.col("longitude"), 5),
        iso_utc(F.col("observed_at")), F.col("satellite"))


def assign_clusters(
    detections: DataFrame,
    radius_km: float = settings.CLUSTER_RADIUS_KM,
    window_hours: float = settings.CLUSTER_WINDOW_HOURS,
) -> tuple[DataFrame, Clusters]:
    """Every usable detection with its `component`, `cluster_size` and `place` in its cluster by time.

    Clusters of any size keep their members as such rows; no cluster is one value or one task.
    """
    labelled, clusters = label_clusters(detections, radius_km, window_hours)
    members, _ = written(with_place(labelled, ["component"], MEMBER_ORDER), "members")
    return members, clusters


def label_clusters(
    detections: DataFrame,
    radius_km: float = settings.CLUSTER_RADIUS_KM,
    window_hours: float = settings.CLUSTER_WINDOW_HOURS,
) -> tuple[DataFrame, Clusters]:
    """`assign_clusters` without places, which take an order of all rows: enough for `totals`."""
    usable, _ = written(coerce_for_clustering(detections), "usable")
    clusters = find_clusters(usable, radius_km, window_hours)
    return clusters.label(usable), clusters


def _digest_parts() -> list[Column]:
    """Order-independent digest of a cluster's fingerprints.

    Sums of hash slices merge in any order, so rows never meet in one place.
    """
    digest = F.sha2(fingerprint(), 256)
    return [
        F.sum(F.conv(F.substring(digest, 1 + 12 * i, 12), 16, 10).cast("decimal(18,0)")).alias(f"digest_{i}")
        for i in range(4)
    ]


def _total_columns() -> list[Column]:
    degrees = lambda c: F.sum(F.col(c).cast("decimal(13,10)")).cast("double") / F.count(c)
    votes = lambda name: F.count_if(F.col("confidence_normalized") == name)
    tally = F.array_max(F.array(*[
        F.struct(votes(name).alias("n"), F.lit(rank).alias("rank"), F.lit(name).alias("label"))
        for name, rank in settings.CONFIDENCE_RANK.items()]))
    return [
        F.count(F.lit(1)).alias("detection_count"),
        degrees("latitude").alias("mean_latitude"),
        degrees("longitude").alias("mean_longitude"),
        F.coalesce(exact_sum(F.col("frp")), F.lit(0.0)).alias("total_frp"),
        F.coalesce(F.max("frp"), F.lit(0.0)).alias("maximum_frp"),
        F.min("observed_at").alias("first_detected_at"),
        F.max("observed_at").alias("last_detected_at"),
        tally["label"].alias("confidence"),
        *_digest_parts(),
    ]


def cluster_aggregates(members: DataFrame) -> DataFrame:
    """One row per component, by mergeable aggregates only: a giant cluster is combined before the shuffle."""
    early = F.col("place") <= F.floor(F.col("cluster_size") / 2)
    mean = lambda half: exact_sum(F.when(half, F.col("frp"))) / F.nullif(F.count(F.when(half, F.col("frp"))), F.lit(0))
    few = F.col("cluster_size") <= hull.PART_POSITIONS
    return members.groupBy("component").agg(
        *_total_columns(),
        mean(early).alias("earlier"), mean(~early).alias("later"),
        F.min(F.struct("observed_at", "latitude", "longitude", "satellite")).alias("first_member"),
        # Positions of a bounded number of rows; larger clusters go through partial hulls.
        F.collect_set(F.when(few, F.struct("longitude", "latitude"))).alias("positions"),
    )


def incident_id() -> Column:
    """Short hash of the number of members and their digest; repeated rows count."""
    merged = F.concat_ws("|", "detection_count", *[f"digest_{i}" for i in range(4)])
    return F.concat(F.lit("incident-"), F.substring(F.sha2(merged, 256), 1, 10))


def _trend_of(distinct_times_many: Column, count: Column, earlier: Column, later: Column) -> Column:
    """Means compare only when both are known; a missing half compares as false."""
    sure = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when((count < 3) | ~distinct_times_many, "stable")
        .when(sure(earlier <= 0), F.when(sure(later > 0), "increasing").otherwise("stable"))
        .when(sure(later > earlier * settings.INCREASE_FACTOR), "increasing")
        .when(sure(later < earlier * settings.DECREASE_FACTOR), "decreasing")
        .otherwise("stable")
    )


def describe(members: DataFrame, largest: int) -> DataFrame:
    """Incident columns plus `component`, `first_member` and unrounded `total_frp`.

    `largest` is the size of the biggest cluster: where all are small, the plan has no branch for
    hulls of partial hulls. Both ways give the same envelope.
    """
    count = F.size("positions")
    lists = lambda c: F.when(count > 0, F.col("positions")[c])
    ring = hull.envelope_of_lists(lists("longitude"), lists("latitude"))
    many = F.col("first_detected_at") < F.col("last_detected_at")
    described = cluster_aggregates(members).withColumns({
        "ring": ring, "trend": _trend_of(many, F.col("detection_count"), F.col("earlier"), F.col("later"))})
    if largest > hull.PART_POSITIONS:
        large = members.where(F.col("cluster_size") > hull.PART_POSITIONS)
        described = described.join(hull.envelopes_of_large(large), "component", "left").withColumn(
            "ring", F.coalesce("ring", rounded_ring(F.col("boundary")))).drop("boundary")
    return described.select(
        "component", "first_member", "total_frp", "mean_latitude", "mean_longitude",
        *_figures(F.col("ring").alias("boundary"), F.col("trend")))


def _figures(boundary: Column | None = None, trend: Column | None = None) -> list[Column]:
    """Incident columns from totals, with those of envelope and trend where they are given."""
    hours = (F.unix_seconds("last_detected_at") - F.unix_seconds("first_detected_at")) / 3600
    return [
        incident_id().alias("id"),
        F.struct(
            exact_round(F.col("mean_latitude"), 5).alias("latitude"),
            exact_round(F.col("mean_longitude"), 5).alias("longitude")).alias("center"),
        *([] if boundary is None else [boundary]),
        F.col("detection_count"),
        exact_round(F.col("total_frp"), 2).alias("total_frp_mw"),
        exact_round(F.col("maximum_frp"), 2).alias("maximum_frp_mw"),
        F.col("first_detected_at"), F.col("last_detected_at"),
        exact_round(hours, 2).alias("duration_hours"),
        F.col("confidence"),
        *([] if trend is None else [trend]),
        severity(F.col("total_frp")).alias("severity"),
    ]


def totals(labelled: DataFrame) -> DataFrame:
    """`component` and the incident columns that need neither an envelope nor places in time order."""
    return labelled.groupBy("component").agg(*_total_columns()).select("component", *_figures())


def member_list(members: DataFrame, described: DataFrame, total_rows: int) -> DataFrame:
    """Every source row with its incident and place in time order, and its original confidence text."""
    ids = described.select("component", "id")
    return join_lookup(members, ids, "component", total_rows).select(
        "id", "place", "latitude", "longitude", "confidence", "acq_date", F.col("acq_time_text").alias("acq_time"),
        "satellite", "frp")


def incidents(
    detections: DataFrame,
    radius_km: float = settings.CLUSTER_RADIUS_KM,
    window_hours: float = settings.CLUSTER_WINDOW_HOURS,
) -> DataFrame:
    """Possible fire areas of a batch, strongest first; ties keep the order of earliest members."""
    members, clusters = assign_clusters(detections, radius_km, window_hours)
    return ranked(describe(members, clusters.largest)).select(*INCIDENT_COLUMNS)


def ranked(described: DataFrame) -> DataFrame:
    return described.orderBy(F.desc("total_frp_mw"), "first_member")


def with_rank(described: DataFrame) -> DataFrame:
    """Every incident with its `rank` in that order."""
    return with_place(described, [], [F.desc("total_frp_mw"), "first_member"], "rank")


def detection_clusters(detections: DataFrame) -> DataFrame:
    """Flat lookup: every source detection with the id of its incident, for clusters of any size."""
    members, clusters = assign_clusters(detections)
    grouped = cluster_aggregates(members).select("component", incident_id().alias("incident_id"))
    return join_lookup(members, grouped, "component", clusters.total_rows)


def spread_diagnostics(members: DataFrame, described: DataFrame) -> DataFrame:
    """Span in degrees and hours of each cluster: chained groups reach far beyond the limits."""
    spans = members.groupBy("component").agg(*[
        (F.max(c) - F.min(c)).alias(f"{c}_span") for c in ("latitude", "longitude")])
    return described.join(spans, "component").select(
        "id", "latitude_span", "longitude_span", "duration_hours", "detection_count")


def has_area() -> Column:
    """Whether an incident is drawn as an area: several detections and a real ring."""
    return (F.col("detection_count") > 1) & (F.coalesce(F.size("boundary"), F.lit(0)) >= 3)


def area_members(members: DataFrame, described: DataFrame, total_rows: int) -> DataFrame:
    """Members of all incidents, one row each, marked as part of an area or as a singleton."""
    layers = described.select(
        "component", F.col("id").alias("incident_id"),
        F.when(has_area(), "area").otherwise("singleton").alias("layer"))
    return join_lookup(members, layers, "component", total_rows).select(
        "incident_id", "layer", "latitude", "longitude", "confidence", "acq_date",
        F.col("acq_time_text").alias("acq_time"), "satellite", "frp")


def contract_violations(records: DataFrame, members: DataFrame) -> DataFrame:
    """(id, violation) for every broken rule of the incident contract; empty when all is well.

    `members` are the rows of all clusters, so the rules on members hold at any cluster size.
    """
    counted = members.groupBy("component").agg(
        F.count(F.lit(1)).alias("member_rows"), F.count_if(F.col("frp") < 0).alias("negative_rows"))
    one_of = lambda c, names: F.coalesce(F.col(c).isin(*names), F.lit(False))
    held = F.coalesce("member_rows", F.lit(0))
    rules = {
        "id_missing": F.col("id").isNotNull(),
        "ring_too_short": F.size("boundary") >= 3,
        "no_detections": held >= 1,
        "count_not_positive": F.col("detection_count") >= 1,
        "count_differs": F.col("detection_count") == held,
        "total_frp_negative": F.col("total_frp_mw") >= 0,
        "maximum_frp_negative": F.col("maximum_frp_mw") >= 0,
        "member_frp_negative": F.coalesce("negative_rows", F.lit(0)) == 0,
        "duration_negative": F.col("duration_hours") >= 0,
        "confidence_unknown_label": one_of("confidence", settings.CONFIDENCE_RANK),
        "trend_unknown_label": one_of("trend", settings.TREND_LABELS),
        "severity_unknown_label": one_of("severity", [n for n, _ in settings.SEVERITY_LEVELS]),
    }
    broken = F.array_compact(F.array(*[
        F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()]))
    return records.join(counted, "component", "left").select("id", F.explode(broken).alias("violation"))


def collection(records: DataFrame, days: int, generated_at: Column) -> DataFrame:
    """One-row envelope of a set of incidents: window, size and creation time."""
    return records.agg(F.count(F.lit(1)).alias("incident_count")).select(
        F.lit(days).alias("days"), "incident_count", generated_at.alias("generated_at"))


def public_detections(detections: DataFrame) -> DataFrame:
    return detections.select(*DETECTION_COLUMNS)
