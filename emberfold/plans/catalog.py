"""The registered queries: every operator applied to whole tables of a data directory."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberfold import settings
from emberfold.functions import geo, labels, numeric, text
from emberfold.operators import history as H
from emberfold.operators import incidents as I
from emberfold.operators import links, logs, reports, series, stats, timeline
from emberfold.operators import normalize as N
from emberfold.operators.joins import join_lookup
from emberfold.operators.ranking import with_place
from emberfold.plans import derive, reads, snapshot
from emberfold.plans.derive import DAYS, NOW
from emberfold.session import new_path, pin_utc, written
from emberfold.settings import DETECTION_COLUMNS
from emberfold.sources import detections as source
from emberfold.sources import history as store
from emberfold.streaming import ingest

AREA = (-5.0, 37.0, 3.0, 42.0)
MIDDLE = datetime(2024, 1, 16, tzinfo=timezone.utc)
FIRST_DAY, LAST_DAY = date(2024, 1, 1), date(2024, 1, 31)

_registry: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function: Callable[[SparkSession, str], DataFrame]):
    name = function.__name__.lstrip("_")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(pin_utc(spark), sf_dir)

    _registry[name] = run
    return function


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_registry)


# --- Shared inputs ------------------------------------------------------------------------------


def _events(spark, d) -> DataFrame:
    return derive.table(spark, d, "events")


def _clean(spark, d) -> DataFrame:
    return derive.detections(_events(spark, d))


def _dirty(spark, d) -> DataFrame:
    return derive.dirty_detections(_events(spark, d))


def _annotated(spark, d, days=DAYS, bounds=settings.BOUNDS) -> DataFrame:
    return N.annotate(_dirty(spark, d), days, NOW, bounds)


def _deduplicated(spark, d) -> DataFrame:
    return N.deduplicate(N.accepted_rows(_annotated(spark, d)))


def _members(spark, d):
    return I.assign_clusters(derive.detections(_events(spark, d), "user_id"))


def _described(spark, d) -> DataFrame:
    members, clusters = _members(spark, d)
    return I.describe(members, clusters.largest)


def _totals(spark, d) -> DataFrame:
    return I.totals(I.label_clusters(derive.detections(_events(spark, d), "user_id"))[0])


def _clustered(spark, d):
    members, clusters = _members(spark, d)
    return members, I.describe(members, clusters.largest), clusters.total_rows


def _stamp(name: str, alias: str | None = None):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(alias or name)


def _refused(reason: str):
    return F.coalesce(F.col("reject_reason") == reason, F.lit(False))


def _flag(name: str):
    return F.array_contains("quality_flags", name).alias(name)


# --- Sources ------------------------------------------------------------------------------------


@query
def fire_stats(spark, d):
    clean, _ = N.normalize(_clean(spark, d), DAYS, NOW)
    return stats.summarize(clean)


@query
def s01_read_csv(spark, d):
    path = new_path(spark, "csv")
    shuffled = ["event_id", *sorted(DETECTION_COLUMNS)]
    _clean(spark, d).select(*shuffled).write.csv(path, header=True)
    return source.read_detections_csv(spark, path)


@query
def s02_required_columns(spark, d):
    return source.column_presence(_dirty(spark, d))


@query
def s03_volume_guard(spark, d):
    rows = _clean(spark, d)
    actual = rows.count()

    def allowed(limit: int) -> bool:
        try:
            source.check_rows(rows, limit)
            return True
        except source.BatchTooLarge:
            return False

    return spark.createDataFrame(
        [(o, actual + o, allowed(actual + o)) for o in (-1, 0, 1)],
        "above_actual int, max_rows long, allowed boolean")


@query
def s04_all_invalid_batch(spark, d):
    rows = []
    for area, bounds in (("home", settings.BOUNDS), ("elsewhere", (100.0, -10.0, 110.0, 0.0))):
        _, report = N.normalize(_clean(spark, d), DAYS, NOW, bounds)
        counts = report.first()
        try:
            N.require_valid_rows(report)
            refused = False
        except N.InvalidBatch:
            refused = True
        rows.append((area, counts["received_rows"], counts["accepted_rows"], refused))
    return spark.createDataFrame(
        rows, "area string, received_rows long, accepted_rows long, refused boolean")


@query
def s05_area_window(spark, d):
    return source.select_area(_clean(spark, d), 7, NOW, AREA).select("event_id", "latitude", "longitude")


@query
def s06_public_projection(spark, d):
    clean, _ = N.normalize(_dirty(spark, d), DAYS, NOW)
    return I.public_detections(clean)


def _facts(spark, d, user_clusters: bool = True) -> DataFrame:
    """Detection facts without clustering: each hot spot stands for one cluster."""
    rows = derive.detections(_events(spark, d), "user_id").withColumn("detection_id", H.detection_id())
    return rows.withColumn("cluster_id", F.concat(F.lit("cluster-"), F.col("user_id").cast("string")))


def _apart(facts: DataFrame) -> DataFrame:
    """Facts that each have a key in history: events that are one observation are numbered from the second on.

    A batch may not name one key twice, but each event is a row of the results. Numbers follow the events.
    """
    placed = with_place(facts, ["detection_id"], ["event_id"], "copy")
    key = F.when(F.col("copy") > 1, F.concat_ws("#", "detection_id", "copy")).otherwise(F.col("detection_id"))
    return placed.withColumn("detection_id", key).drop("copy")


def _history_rows(facts: DataFrame, at: datetime, frp=None) -> DataFrame:
    moment = F.lit(at).cast("timestamp")
    return facts.select(
        "detection_id", "cluster_id", moment.alias("cluster_snapshot_at"), "observed_at", "latitude",
        "longitude", F.struct("latitude", "longitude").alias("position"), "satellite", "confidence",
        (F.col("frp") if frp is None else frp).alias("frp_mw"),
        F.array().cast("array<string>").alias("quality_flags"),
        F.lit(settings.SOURCE_DATASET).alias("source_dataset"),
        moment.alias("first_ingested_at"), moment.alias("last_ingested_at"),
        F.to_date("observed_at").alias("observation_date"))


def _stored_facts(spark, d) -> str:
    root = new_path(spark, "history")
    store.commit(spark, root, {"fire_detections": _history_rows(_facts(spark, d), NOW)})
    return root


@query
def s07_history_scan(spark, d):
    root = _stored_facts(spark, d)
    rows = store.read_history(spark, root, "fire_detections", date(2024, 1, 10), date(2024, 1, 19))
    return rows.select(
        "detection_id", F.col("observation_date").cast("string"), "latitude", "longitude")


# --- Validation ---------------------------------------------------------------------------------


@query
def v01_coordinates(spark, d):
    return _annotated(spark, d).select(
        "event_id", "latitude", "longitude", _refused("invalid_coordinates").alias("refused"))


@query
def v02_bounds(spark, d):
    return _annotated(spark, d, bounds=AREA).select(
        "event_id", (~_refused("invalid_coordinates")).alias("inside"))


@query
def v03_time(spark, d):
    number = _dirty(spark, d).select("event_id", numeric.parse_number(F.col("acq_time")).alias("n"))
    return number.select("event_id", N.valid_time(F.col("n")).alias("hhmm"))


@query
def v04_observed_at(spark, d):
    return _annotated(spark, d).select("event_id", _stamp("observed_at"))


@query
def v05_window(spark, d):
    return _annotated(spark, d, days=7).where(~_refused("invalid_coordinates")).select(
        "event_id", (~_refused("invalid_timestamps")).alias("inside"))


@query
def v06_text(spark, d):
    rows = text.with_compatible_text(_dirty(spark, d).select("event_id", "satellite"), ["satellite"])
    cleaned = rows.select(
        "event_id", text.clean_text(F.col("satellite_nfkc")).alias("clean"), "satellite")
    return cleaned.select(
        "event_id", F.col("clean").alias("satellite"),
        F.coalesce(F.col("clean") != F.col("satellite"), F.lit(True)).alias("changed_or_invalid"))


@query
def v07_satellite(spark, d):
    return _annotated(spark, d).select(
        "event_id", "satellite", _flag("satellite_sanitized"),
        _refused("invalid_satellites").alias("refused"))


@query
def v08_confidence(spark, d):
    return _annotated(spark, d).select("event_id", "confidence", _flag("confidence_unknown"))


@query
def v09_frp(spark, d):
    return _annotated(spark, d).select("event_id", "frp", _flag("frp_invalid"), _flag("frp_high"))


@query
def v10_quality_flags(spark, d):
    return _annotated(spark, d).select("event_id", F.array_join("quality_flags", ",").alias("flags"))


@query
def v11_deduplicate(spark, d):
    return _deduplicated(spark, d).select(
        "latitude", "longitude", "confidence", "acq_time", "satellite", "frp",
        F.array_join("quality_flags", ",").alias("flags"), _stamp("observed_at"),
        F.col("group_rows").alias("copies"))


@query
def v12_quality_report(spark, d):
    return N.normalize(_dirty(spark, d), DAYS, NOW)[1]


@query
def v13_canonical_sort(spark, d):
    """Every row with its position in canonical order."""
    return N.canonical_places(_deduplicated(spark, d)).select(*N.CANONICAL_ORDER, "place")


@query
def v14_coerce(spark, d):
    return N.coerce_for_clustering(_dirty(spark, d)).select(
        "event_id", "latitude", "longitude", "confidence_normalized",
        F.when(F.col("frp") >= 0, F.col("frp")).alias("frp"), _stamp("observed_at"))


# --- Aggregates ---------------------------------------------------------------------------------


@query
def a01_summary(spark, d):
    return stats.summarize(_deduplicated(spark, d))


@query
def a02_by_satellite(spark, d):
    return stats.counts_by_satellite(_deduplicated(spark, d))


@query
def a03_overview(spark, d):
    return stats.collection_overview(_described(spark, d))


@query
def a04_severity_histogram(spark, d):
    merged = F.col("detection_count") % 3 == 0
    rows = _described(spark, d).select(
        "severity", F.when(merged, "merged").otherwise("active").alias("status"),
        F.to_date("last_detected_at").alias("snapshot_date"))
    return stats.severity_histogram(rows, NOW.date())


@query
def a05_satellites(spark, d):
    members, described, _ = _clustered(spark, d)
    return stats.satellites_per_incident(members, described)


# --- Clustering ---------------------------------------------------------------------------------


@query
def c01_haversine(spark, d):
    km = geo.haversine_km(F.lit(40.4168), F.lit(-3.7038), F.col("latitude"), F.col("longitude"))
    return _clean(spark, d).select("event_id", F.round(km * 1e6).cast("bigint").alias("distance_mm"))


@query
def c02_linked_detections(spark, d):
    rows = _clean(spark, d)
    return links.find_clusters(rows).label(rows).select(
        "event_id", (F.col("cluster_size") > 1).alias("linked"))


@query
def c03_components(spark, d):
    rows = _clean(spark, d)
    clusters = links.find_clusters(rows)
    labelled, _ = written(clusters.label(rows).select("event_id", "component"), "labelled")
    first = labelled.groupBy("component").agg(F.min("event_id").alias("first_event_id"))
    return join_lookup(labelled, first, "component", clusters.total_rows).select(
        "event_id", "first_event_id")


@query
def c04_detection_clusters(spark, d):
    return I.detection_clusters(_clean(spark, d)).select("event_id", "incident_id")


@query
def c05_incident_id(spark, d):
    return _totals(spark, d).select("id", "detection_count")


@query
def c06_center(spark, d):
    return _totals(spark, d).select(
        "id", F.col("center.latitude").alias("center_latitude"),
        F.col("center.longitude").alias("center_longitude"))


@query
def c07_frp_totals(spark, d):
    return _totals(spark, d).select("id", "total_frp_mw", "maximum_frp_mw")


@query
def c08_time_extent(spark, d):
    return _totals(spark, d).select(
        "id", _stamp("first_detected_at"), _stamp("last_detected_at"), "duration_hours")


@query
def c09_confidence(spark, d):
    return _totals(spark, d).select("id", "confidence")


@query
def c10_trend(spark, d):
    return _described(spark, d).select("id", "trend")


@query
def c11_severity(spark, d):
    return _totals(spark, d).select("id", "severity")


@query
def c12_members(spark, d):
    return I.member_list(*_clustered(spark, d))


@query
def c13_envelope_points(spark, d):
    ring = geo.envelope_ring(F.col("latitude"), F.col("longitude"))
    points = _clean(spark, d).select("event_id", F.explode(geo.rounded_ring(ring)).alias("p"))
    unit = lambda c: F.round(F.col(f"p.{c}") * 1e5).cast("bigint")
    return points.groupBy("event_id").agg(
        F.min(unit("latitude")).alias("south"), F.max(unit("latitude")).alias("north"),
        F.min(unit("longitude")).alias("west"), F.max(unit("longitude")).alias("east"),
        F.count(F.lit(1)).alias("points"))


@query
def c14_envelope(spark, d):
    units = lambda c: F.transform("boundary", lambda p: F.round(p[c] * 1e5).cast("bigint"))
    return _described(spark, d).select(
        "id",
        F.array_min(units("latitude")).alias("south"), F.array_max(units("latitude")).alias("north"),
        F.array_min(units("longitude")).alias("west"), F.array_max(units("longitude")).alias("east"))


@query
def c15_ranked(spark, d):
    return I.with_rank(_described(spark, d)).select(
        "rank", "id", "total_frp_mw", "confidence", "trend", "severity")


@query
def c16_contract(spark, d):
    """Violations of the incident contract after faults were planted in two columns."""
    members, described, _ = _clustered(spark, d)
    faulty = described.withColumns({
        "severity": F.when(F.col("confidence") == "low", "none").otherwise(F.col("severity")),
        "duration_hours": F.when(F.col("trend") == "decreasing", -1.0).otherwise(F.col("duration_hours")),
    })
    return I.contract_violations(faulty, members)


@query
def c17_area_members(spark, d):
    return I.area_members(*_clustered(spark, d)).select(
        "incident_id", "layer", "latitude", "longitude", "acq_date", "acq_time")


def _crowd(spark, d):
    """All events on one spot, each seen by three satellites: one cluster, at any size of the table."""
    events = derive.detections(_events(spark, d), "user_id")
    satellites = F.explode(F.array(*[F.lit(n) for n in ("N20", "N21", "NPP")]))
    return events.withColumns({
        "latitude": F.lit(40.0) + F.col("event_id") % 7 / 1000, "longitude": F.lit(-3.0) + F.col("event_id") % 5 / 1000,
    }).withColumn("satellite", satellites)


@query
def c18_large_cluster(spark, d):
    """Every value of a cluster that holds all rows."""
    members, clusters = I.assign_clusters(_crowd(spark, d))
    described, _ = written(I.describe(members, clusters.largest), "described")
    held = I.member_list(members, described, clusters.total_rows).groupBy("id").agg(
        F.count(F.lit(1)).alias("members"), F.max("place").alias("last_place"))
    names = stats.satellites_per_incident(members, described)
    broken = I.contract_violations(described, members).groupBy("id").agg(F.count(F.lit(1)).alias("broken"))
    return described.join(held, "id").join(names, "id").join(broken, "id", "left").select(
        "id", "detection_count", "total_frp_mw", "trend", "members", "last_place", "satellites",
        F.coalesce("broken", F.lit(0)).alias("violations"))


# --- History ------------------------------------------------------------------------------------


@query
def h01_snapshot_hour(spark, d):
    hours = _events(spark, d).select(H.snapshot_hour(F.col("ts").cast("timestamp")).alias("snapshot_at"))
    return hours.groupBy("snapshot_at").agg(F.count(F.lit(1)).alias("events")).select(
        _stamp("snapshot_at"), "events")


@query
def h02_detection_id(spark, d):
    return _clean(spark, d).select("event_id", H.detection_id().alias("detection_id"))


@query
def h03_first_per_id(spark, d):
    rows = H.with_ids(N.accepted_rows(_annotated(spark, d)))
    return H.first_per_id(rows).select("detection_id", "confidence", "frp")


@query
def h04_prior_assignments(spark, d):
    root = new_path(spark, "history")
    facts = _facts(spark, d)
    earlier = facts.where(F.col("observed_at") < F.lit(MIDDLE))
    store.commit(spark, root, {"fire_detections": _history_rows(earlier, NOW)})
    past = store.read_history(spark, root, "fire_detections", date(2024, 1, 10), LAST_DAY)
    return H.prior_assignments(facts, past, facts.count())


def _identities(spark, d):
    members, clusters = _members(spark, d)
    members, state = written(H.with_ids(members), "members")
    described, _ = written(I.describe(members, clusters.largest).drop("first_member"), "described")
    facts = H.first_per_id(members)
    prior = facts.where(F.col("observed_at") < F.lit(MIDDLE)).select(
        "detection_id", F.concat_ws(
            "-", F.lit("cluster"), "user_id", F.floor(F.hour("observed_at") / 12)).alias("prior_id"))
    identities, merged = H.resolve_identities(facts, H.heads_of(described), prior)
    return described, facts, identities, merged, state["rows"]


@query
def h05_new_cluster_id(spark, d):
    described, facts, *_ = _identities(spark, d)
    return H.new_cluster_ids(facts).join(H.heads_of(described), "component").select(
        "incident_id", "new_id")


@query
def h06_identity(spark, d):
    described, _, identities, *_ = _identities(spark, d)
    return identities.join(H.heads_of(described), "component").select("incident_id", "cluster_id")


@query
def h07_active_snapshots(spark, d):
    described, facts, identities, merged, _ = _identities(spark, d)
    rows = H.snapshot_rows(described, facts, identities, merged, NOW)
    return rows.where("status = 'active'").select(
        "cluster_id", "detection_count",
        "total_frp_mw", "maximum_frp_mw", "confidence", "trend", "severity", "status")


@query
def h07_snapshot_members(spark, d):
    _, facts, identities, _, rows = _identities(spark, d)
    return H.snapshot_members(facts, identities, NOW, rows).select("cluster_id", "detection_id")


@query
def h08_merged_snapshots(spark, d):
    described, facts, identities, merged, _ = _identities(spark, d)
    rows = H.snapshot_rows(described, facts, identities, merged, NOW)
    return rows.where("status = 'merged'").select(
        "cluster_id", "merged_into_cluster_id", "detection_count", "total_frp_mw", "severity",
        _stamp("first_detected_at"))


@query
def h09_detection_facts(spark, d):
    _, facts, identities, _, rows = _identities(spark, d)
    return H.detection_facts(facts, identities, NOW, rows).select(
        "detection_id", "cluster_id", F.col("observation_date").cast("string"), "latitude",
        "longitude", "satellite", "confidence", "frp_mw")


@query
def h10_geojson(spark, d):
    ring = geo.rounded_ring(geo.envelope_ring(F.col("latitude"), F.col("longitude")))
    return _clean(spark, d).select("event_id", geo.geojson_polygon(ring).alias("boundary"))


@query
def h11_relationships(spark, d):
    """A batch with planted faults: repeated detections, repeated and missing cluster rows."""
    facts = _facts(spark, d)
    detections = facts.unionByName(facts.where("event_id % 61 = 0")).withColumn(
        "cluster_snapshot_at", F.lit(NOW).cast("timestamp"))
    seen = lambda satellite: facts.where(F.col("satellite") == satellite).select("cluster_id").distinct()
    clusters = seen("NPP").unionByName(seen("NPP").join(seen("N20"), "cluster_id", "left_semi"))
    return store.relationship_violations(
        detections, clusters.withColumn("snapshot_at", F.lit(NOW).cast("timestamp")))


@query
def h12_upsert_clusters(spark, d):
    root = new_path(spark, "history")
    daily = _facts(spark, d).groupBy("cluster_id", F.to_date("observed_at").alias("snapshot_date")).agg(
        F.count(F.lit(1)).alias("detection_count"), F.max("frp").alias("maximum_frp_mw"),
        F.min("observed_at").alias("first_detected_at"), F.max("observed_at").alias("last_detected_at"))

    def rows(df: DataFrame, severity: str, dataset: str) -> DataFrame:
        values = {f.name: F.lit(None).cast(f.dataType) for f in settings.FIRE_CLUSTERS
                  if f.name not in df.columns}
        values.update(
            snapshot_at=F.col("snapshot_date").cast("timestamp"), severity=F.lit(severity),
            status=F.lit("active"), source_dataset=F.lit(dataset))
        return df.withColumns(values)

    early = daily.where(F.col("snapshot_date") < F.lit(MIDDLE.date()))
    store.upsert(spark, root, {"fire_clusters": written(rows(early, "low", "first"), "early")[0]})
    store.upsert(spark, root, {"fire_clusters": written(rows(daily, "high", "second"), "daily")[0]})
    return store.read_history(spark, root, "fire_clusters", FIRST_DAY, LAST_DAY).select(
        "cluster_id", F.col("snapshot_date").cast("string"), "detection_count", "maximum_frp_mw",
        "source_dataset", "severity")


@query
def h13_upsert_detections(spark, d):
    root = new_path(spark, "history")
    facts = _apart(_facts(spark, d))
    early = facts.where(F.col("observed_at") < F.lit(MIDDLE)).withColumn("cluster_id", F.lit("cluster-old"))
    first = datetime(2024, 1, 30, tzinfo=timezone.utc)
    store.upsert(spark, root, {"fire_detections": written(_history_rows(early, first), "early")[0]})
    store.upsert(spark, root, {"fire_detections": written(_history_rows(facts, NOW, F.col("frp") + 1), "later")[0]})
    return store.read_history(spark, root, "fire_detections", FIRST_DAY, LAST_DAY).select(
        F.substring_index("detection_id", "#", 1).alias("detection_id"), "cluster_id", "frp_mw", F.col("observation_date").cast("string"),
        _stamp("first_ingested_at"), _stamp("last_ingested_at"))


# --- Reads of the last days ---------------------------------------------------------------------

READ_AT = datetime(2024, 1, 30, 15, 30, tzinfo=timezone.utc)


def _corrected(spark, d) -> str:
    """A history whose first values were all too high and half of which was corrected by an upsert."""
    root = new_path(spark, "history")
    facts = _apart(_facts(spark, d))
    store.commit(spark, root, {"fire_detections": _history_rows(facts, READ_AT, F.col("frp") * 2)})
    right = _history_rows(facts.where("event_id % 2 = 0"), NOW)
    store.upsert(spark, root, {"fire_detections": written(right, "right")[0]})
    return root


@query
def t07_history_rolling(spark, d):
    return reads.rolling_summary(spark, _corrected(spark, d), READ_AT, [1, 3, 7, 30])


@query
def a02_history_satellites(spark, d):
    return reads.rolling_by_satellite(spark, _corrected(spark, d), READ_AT, 10)


@query
def a06_period_comparison(spark, d):
    return reads.compare_periods(spark, _corrected(spark, d), READ_AT, 9)


@query
def h20_hourly_series(spark, d):
    return series.hourly_series(_facts(spark, d), "cluster_id", READ_AT, "frp").withColumn("hour_start", _stamp("hour_start"))


@query
def h20_persistence(spark, d):
    return series.persistence(_facts(spark, d), "cluster_id", READ_AT, "frp")


@query
def a04_history_severity(spark, d):
    """Snapshots of every day and hot spot, all low and active until an upsert says better."""
    root = new_path(spark, "history")
    daily = _facts(spark, d).groupBy("cluster_id", F.to_date("observed_at").alias("snapshot_date")).agg(
        F.count(F.lit(1)).alias("detection_count"), F.max("frp").alias("maximum_frp_mw"))
    held = {f.name: F.lit(None).cast(f.dataType) for f in settings.FIRE_CLUSTERS if f.name not in daily.columns}
    rows = daily.withColumns(held | {
        "snapshot_at": F.col("snapshot_date").cast("timestamp"), "severity": F.lit("low"), "status": F.lit("active")})
    store.commit(spark, root, {"fire_clusters": rows})
    better = rows.withColumns({
        "severity": labels.severity(F.col("maximum_frp_mw")),
        "status": F.when(F.col("detection_count") % 3 == 0, "merged").otherwise("active")})
    store.upsert(spark, root, {"fire_clusters": written(better, "better")[0]})
    return reads.severity_history(spark, root, MIDDLE.date())


@query
def h14_json_batches(spark, d):
    rows = _facts(spark, d).select(
        "detection_id", "observed_at", "latitude", "longitude", "frp",
        F.array("satellite", "confidence").alias("tags"))
    pages = store.encode_json_pages(rows, "detection_id", rows.count())
    return store.decode_json_pages(pages, rows.schema).select(
        "detection_id", _stamp("observed_at"), "latitude", "longitude", "frp",
        F.array_join("tags", ",").alias("tags"))


def _per_day(spark, root) -> DataFrame:
    return store.read_history(spark, root, "fire_detections", FIRST_DAY, LAST_DAY).groupBy(
        F.col("observation_date").cast("string").alias("observation_date"))


@query
def h15_retention(spark, d):
    root = _stored_facts(spark, d)
    count = F.count(F.lit(1))
    before, _ = written(_per_day(spark, root).agg(count.alias("rows_before")), "before")
    listed = store.expire_partitions(spark, root, "fire_detections", LAST_DAY, days=15)
    store.expire_partitions(spark, root, "fire_detections", LAST_DAY, days=15, dry_run=False)
    after = _per_day(spark, root).agg(count.alias("rows_after"))
    expired = F.col("observation_date").isin([x.isoformat() for x in listed])
    return before.join(after, "observation_date", "left").select(
        "observation_date", expired.alias("expired"), "rows_before",
        F.coalesce("rows_after", F.lit(0)).alias("rows_after"))


@query
def h16_size_guard(spark, d):
    root = _stored_facts(spark, d)
    held = store.read_history(spark, root, "fire_detections", FIRST_DAY, LAST_DAY).count()

    def refused(limit: int) -> bool:
        try:
            store.check_storage(spark, root, limit)
            return False
        except store.StorageLimit:
            return True

    return spark.createDataFrame(
        [("one_byte", refused(1), held), ("default", refused(settings.STORAGE_GUARD_BYTES), held)],
        "limit_name string, refused boolean, rows_held long")


@query
def h17_schema_evolution(spark, d):
    root = new_path(spark, "history")
    rows = _history_rows(_facts(spark, d), NOW)
    old = F.col("observed_at") < F.lit(MIDDLE)
    store.commit(spark, root, {"fire_detections": rows.where(old).drop("quality_flags")})
    store.commit(spark, root, {"fire_detections": rows.where(~old)})
    return _per_day(spark, root).agg(
        F.count(F.lit(1)).alias("detections"),
        F.count_if(F.col("quality_flags").isNull()).alias("without_flags"))


@query
def h18_layout(spark, d):
    root = _stored_facts(spark, d)
    return _per_day(spark, root).agg(
        F.count(F.lit(1)).alias("detections"), F.count_distinct("cluster_id").alias("clusters"))


@query
def h19_snapshot_job(spark, d):
    root = new_path(spark, "history")
    return snapshot.run_snapshot(spark, _clean(spark, d), root, NOW, DAYS).withColumn(
        "snapshot_at", _stamp("snapshot_at"))


# --- Report labels ------------------------------------------------------------------------------


def _labelled(spark, d) -> DataFrame:
    return reports.label_detections(_clean(spark, d))


def _spots(spark, d) -> DataFrame:
    """One row per hot spot and day, shaped like incidents as far as the labels need."""
    daily = derive.detections(_events(spark, d), "user_id").groupBy("user_id", "acq_date").agg(
        F.count(F.lit(1)).alias("n"), numeric.exact_sum(F.col("frp")).alias("total_frp_mw"),
        ((F.unix_seconds(F.max("observed_at")) - F.unix_seconds(F.min("observed_at"))) / 3600)
        .alias("duration_hours"),
        F.max("observed_at").alias("last_detected_at"))
    trends = F.array(F.lit("increasing"), F.lit("stable"), F.lit("decreasing"), F.lit(None))
    with_trend = daily.withColumn("trend", trends[(F.col("n") % 4).cast("int")])
    return reports.label_incidents(with_trend, N.instant(NOW))


@query
def p01_intensity(spark, d):
    return _labelled(spark, d).select("event_id", "intensity")


@query
def p02_cluster_level(spark, d):
    return _spots(spark, d).select("user_id", "acq_date", "level_label")


@query
def p03_time_label(spark, d):
    return _labelled(spark, d).select("event_id", "time_label", "observed_label")


@query
def p04_confidence_label(spark, d):
    return _dirty(spark, d).select(
        "event_id", labels.confidence_label(F.col("confidence")).alias("confidence_label"))


@query
def p05_frp_label(spark, d):
    return _annotated(spark, d).select("event_id", labels.frp_label(F.col("frp")).alias("frp_label"))


@query
def p06_coordinates_label(spark, d):
    return _labelled(spark, d).select("event_id", "coordinates_label")


@query
def p07_detection_key(spark, d):
    return _labelled(spark, d).select("event_id", "detection_key")


@query
def p08_duration_label(spark, d):
    return _spots(spark, d).select("user_id", "acq_date", "duration_label")


@query
def p09_trend_label(spark, d):
    return _spots(spark, d).select("user_id", "acq_date", "trend_label")


@query
def p10_age_label(spark, d):
    return _spots(spark, d).select("user_id", "acq_date", "age_label")


# --- Streams and time ---------------------------------------------------------------------------


def _event_stream(spark, d) -> DataFrame:
    return (
        spark.readStream.schema(_events(spark, d).schema)
        .option("pathGlobFilter", "events.parquet").parquet(d)
    )


@query
def t01_stream_snapshots(spark, d):
    """Hourly snapshots of a window of one day, from a stream that brings the month in two parts."""
    landing, root = new_path(spark, "landing"), new_path(spark, "history")
    derive.detections(_events(spark, d)).repartitionByRange(2, "observed_at").write.parquet(landing)
    stream = spark.readStream.schema(spark.read.parquet(landing).schema).option("maxFilesPerTrigger", 1).parquet(landing)
    ingest.start_snapshots(
        stream, root, new_path(spark, "offsets"), 1, clock=lambda: NOW, availableNow=True).awaitTermination()
    rows = store.read_history(spark, root, "fire_clusters", FIRST_DAY, LAST_DAY).where("status = 'active'")
    return rows.groupBy(_stamp("snapshot_at")).agg(
        F.count(F.lit(1)).alias("clusters"), F.sum("detection_count").alias("detections"),
        F.max("detection_count").alias("largest"),
        F.sum(F.round(F.col("total_frp_mw") * 100).cast("long")).alias("frp_cents"))


@query
def t02_stream_dedup(spark, d):
    rows = N.annotate(derive.dirty_detections(_event_stream(spark, d)), DAYS, NOW)
    path = new_path(spark, "dedup")
    (
        ingest.deduplicate_stream(N.accepted_rows(rows)).select("detection_id")
        .writeStream.format("parquet").option("path", path)
        .option("checkpointLocation", new_path(spark, "offsets"))
        .trigger(availableNow=True).start().awaitTermination()
    )
    return spark.read.parquet(path)


@query
def t03_quarantine(spark, d):
    good, bad = new_path(spark, "accepted"), new_path(spark, "rejected")
    ingest.start_quarantine(
        derive.dirty_detections(_event_stream(spark, d)), good, bad, new_path(spark, "offsets"), 7, NOW,
        availableNow=True).awaitTermination()
    rows = spark.read.parquet(good).select(F.lit("accepted").alias("reason")).unionByName(
        spark.read.parquet(bad).select(F.col("reject_reason").alias("reason")))
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def _requests(events: DataFrame) -> DataFrame:
    """Events as client requests, with the month squeezed so that the limits are reached."""
    start = 1_704_067_200_000_000
    squeezed = F.expr(f"{start} + (unix_micros(CAST(ts AS TIMESTAMP)) - {start}) DIV 200")
    return events.select(
        F.col("event_type").alias("client"), "event_id", F.timestamp_micros(squeezed).alias("ts"))


@query
def t04_token_bucket(spark, d):
    return timeline.rate_limit(_requests(_events(spark, d)), "client", "event_id").select(
        "client", "event_id", "outcome", "retry_after")


@query
def t04_token_bucket_stream(spark, d):
    from emberfold.streaming.token_bucket import rate_limit_stream

    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    path = new_path(spark, "decisions")
    try:
        (
            rate_limit_stream(_requests(_event_stream(spark, d)), "client", "event_id")
            .writeStream.format("parquet").option("path", path)
            .option("checkpointLocation", new_path(spark, "offsets")).outputMode("append")
            .trigger(availableNow=True).start().awaitTermination()
        )
    finally:
        spark.conf.set(setting, before)
    return spark.read.parquet(path).select("client", "event_id", "outcome", "retry_after")


@query
def t05_freshness(spark, d):
    events = _events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    reads = events.where("event_type = 'view'").select("user_id", F.col("ts").alias("read_at"), "event_id")
    loads = events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("succeeded_at"))
    return timeline.freshness(reads, loads, "user_id", ttl_s=86_400).select(
        "event_id", "user_id", "available", "data_age_seconds", "data_stale")


@query
def t06_failure_backoff(spark, d):
    attempts = _events(spark, d).select(
        "user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"),
        (F.col("event_type") != "error").alias("succeeded"))
    return timeline.failure_backoff(attempts, "user_id", "event_id").select(
        "user_id", "event_id", "failure_count", "delay_seconds")


@query
def t07_rolling_stats(spark, d):
    return timeline.rolling_stats(_clean(spark, d), NOW, [1, 3, 5, 31]).withColumn(
        "days", F.col("days").cast("bigint"))


@query
def t07_sliding_stream(spark, d):
    """Sliding windows kept by the stream in complete mode, so every window is in the result."""
    path = new_path(spark, "sliding")
    windows = ingest.sliding_stats(derive.detections(_event_stream(spark, d)), slide="6 hours")
    (
        windows.writeStream.outputMode("complete")
        .foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path))
        .option("checkpointLocation", new_path(spark, "offsets"))
        .trigger(availableNow=True).start().awaitTermination()
    )
    return spark.read.parquet(path).select(
        _stamp("window_start"), "total_detections", "total_frp", "maximum_frp")


@query
def t07_sliding_append(spark, d):
    """Windows closed by the watermark, from four deliveries of which the last brings rows three weeks late."""
    landing, path = new_path(spark, "landing"), new_path(spark, "windows")
    rows = derive.detections(_events(spark, d))
    late = F.expr("event_id % 97 = 0 AND observed_at < TIMESTAMP '2024-01-08 00:00:00'")
    delivery = F.when(late, 3).otherwise(F.least(F.floor((F.dayofmonth("observed_at") - 1) / 8), F.lit(3)))
    for k in range(4):  # one after the other, as the source takes files by their time
        rows.where(delivery == k).coalesce(1).write.mode("append").parquet(landing)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(landing)
    ingest.start_sliding(
        stream, path, new_path(spark, "offsets"), slide="6 hours", availableNow=True).awaitTermination()
    return spark.read.parquet(path).select(
        _stamp("window_start"), "total_detections", "total_frp", "maximum_frp")


@query
def t08_location_sessions(spark, d):
    return timeline.location_sessions(_clean(spark, d)).select(
        _stamp("started_at"), _stamp("ended_at"), "detections", "south", "west")


# --- Logs ---------------------------------------------------------------------------------------


@query
def l01_sanitize(spark, d):
    secrets = ["the", "license"]
    documents = derive.table(spark, d, "documents").select(
        F.lit("documents").alias("origin"), F.col("doc_id").cast("string").alias("id"), "text")
    talks = derive.table(spark, d, "conversations").select(
        F.lit("conversations").alias("origin"), F.concat_ws("-", "conv_id", "turn").alias("id"), "text")
    return documents.unionByName(talks).withColumn(
        "text", text.sanitize_log_text(F.col("text"), secrets))


def _requests_log(spark, d) -> DataFrame:
    digest = F.md5(F.col("event_id").cast("string"))
    kind = F.col("event_id") % 5
    dashed = F.concat_ws(
        "-", digest.substr(1, 8), digest.substr(9, 4),
        F.concat(F.when(kind == 2, "1").otherwise("4"), digest.substr(14, 3)),
        F.concat(F.lit("a"), digest.substr(18, 3)), digest.substr(21, 12))
    return _events(spark, d).select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type",
        (F.lit(200) + F.col("event_id") * 7 % 5 * 100).alias("status"),
        F.when(kind == 0, "").when(kind == 1, F.upper(digest)).otherwise(dashed).alias("client_id"))


@query
def l02_uuid(spark, d):
    return _requests_log(spark, d).select("event_id", text.uuid_kind(F.col("client_id")).alias("kind"))


@query
def l03_pseudonym(spark, d):
    return _requests_log(spark, d).select(
        "event_id", text.client_pseudonym(F.col("client_id"), "report-key").alias("client_key"))


@query
def l04_json_lines(spark, d):
    rows = _requests_log(spark, d)
    line = logs.json_line(
        rows, "ts", labels.status_severity(F.col("status")), "event_type", ["status", "client_id"])
    return rows.select("event_id", line.alias("line"))


@query
def l05_status_severity(spark, d):
    return _requests_log(spark, d).select(
        "event_id", labels.status_severity(F.col("status")).alias("severity"))
