"""Fixed values and table schemas shared by every module.

The thresholds, names and limits below are fixed values: results depend on them, so they are stated
once, plainly, in natural order.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values -----------------------------------------------------------------------------

DETECTION_COLUMNS = [
    "latitude", "longitude", "confidence", "acq_date", "acq_time", "satellite", "frp",
]
SOURCE_DATASET = "VIIRS_NOAA20_NRT"
BOUNDS = (-10.0, 35.0, 5.0, 44.0)  # west, south, east, north
FUTURE_TOLERANCE_S = 15 * 60
MAX_TEXT_LENGTH = 32
HIGH_FRP_MW = 1000.0

CONFIDENCE_ALIASES = {
    "l": "low", "low": "low",
    "n": "nominal", "nominal": "nominal",
    "h": "high", "high": "high",
}
CONFIDENCE_RANK = {"unknown": 0, "low": 1, "nominal": 2, "high": 3}
TREND_LABELS = {"increasing": "Increasing", "stable": "Stable", "decreasing": "Decreasing"}

EARTH_RADIUS_KM = 6371.0088      # sphere used for distances
KM_PER_DEGREE = 111.32           # flat scale used for envelopes only
CLUSTER_RADIUS_KM = 2.0
CLUSTER_WINDOW_HOURS = 24
ENVELOPE_BUFFER_KM = 1.0
ENVELOPE_STEPS = 12
ENVELOPE_MIN_COS = 0.01

INCREASE_FACTOR = 1.2
DECREASE_FACTOR = 0.8
SEVERITY_LEVELS = [("low", 10.0), ("moderate", 50.0), ("high", 150.0), ("extreme", None)]
INTENSITY_LEVELS = [("Low", 5.0), ("Moderate", 15.0), ("High", 50.0), ("Extreme", None)]
PERSISTENT_HOURS = 6

CACHE_TTL_S = 3600
BACKOFF_INITIAL_S = 60
BACKOFF_MAX_S = 900
BUCKET_CAPACITY, BUCKET_REFILL_S = 5, 12.0
GUARD_CAPACITY, GUARD_REFILL_S = 20, 3.0
BUCKET_TTL_S = 24 * 3600

RETENTION_DAYS = 365
STORAGE_GUARD_BYTES = 8 * 1024**3
MAX_LOG_TEXT = 1000
LEGACY_CLIENT_NAMESPACE = b"legacy-client-without-installation-id"

# --- Scale limits of this engine --------------------------------------------------------------

# A key is "hot" when it holds more than 1/HOT_SHARE of the rows, so there are at most HOT_SHARE
# hot keys and their unique partner rows always fit a broadcast.
HOT_SHARE = 1_000
# Below this many rows a join needs no hot-key split: one task copes with all of them.
HOT_MIN_ROWS = 5_000_000
# Largest lookup that may be broadcast after its size has been checked.
BROADCAST_ROWS = 100_000

# --- Schemas ----------------------------------------------------------------------------------

RAW_DETECTION = T.StructType([T.StructField(c, T.StringType()) for c in DETECTION_COLUMNS])

POINT = T.StructType([
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
])

FIRE_DETECTIONS = T.StructType([
    T.StructField("detection_id", T.StringType()),
    T.StructField("cluster_id", T.StringType()),
    T.StructField("cluster_snapshot_at", T.TimestampType()),
    T.StructField("observed_at", T.TimestampType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("position", POINT),
    T.StructField("satellite", T.StringType()),
    T.StructField("confidence", T.StringType()),
    T.StructField("frp_mw", T.DoubleType()),
    T.StructField("quality_flags", T.ArrayType(T.StringType())),
    T.StructField("source_dataset", T.StringType()),
    T.StructField("first_ingested_at", T.TimestampType()),
    T.StructField("last_ingested_at", T.TimestampType()),
    T.StructField("observation_date", T.DateType()),
])

FIRE_CLUSTERS = T.StructType([
    T.StructField("cluster_id", T.StringType()),
    T.StructField("snapshot_at", T.TimestampType()),
    T.StructField("center", POINT),
    T.StructField("boundary", T.StringType()),
    T.StructField("detection_count", T.LongType()),
    T.StructField("total_frp_mw", T.DoubleType()),
    T.StructField("maximum_frp_mw", T.DoubleType()),
    T.StructField("first_detected_at", T.TimestampType()),
    T.StructField("last_detected_at", T.TimestampType()),
    T.StructField("confidence", T.StringType()),
    T.StructField("trend", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("merged_into_cluster_id", T.StringType()),
    T.StructField("source_dataset", T.StringType()),
    T.StructField("snapshot_date", T.DateType()),
])

FIRE_CLUSTER_MEMBERS = T.StructType([
    T.StructField("cluster_id", T.StringType()),
    T.StructField("snapshot_at", T.TimestampType()),
    T.StructField("detection_id", T.StringType()),
    T.StructField("snapshot_date", T.DateType()),
])

# Partial statistics of a date. Sums are kept as an exact part and a rest too large for it.
FIRE_DAILY_DETECTIONS = T.StructType([
    T.StructField("satellite", T.StringType()),
    T.StructField("detections", T.LongType()),
    T.StructField("known_frp", T.LongType()),
    T.StructField("exact_frp", T.DecimalType(38, 8)),
    T.StructField("rest_frp", T.DoubleType()),
    T.StructField("maximum_frp_mw", T.DoubleType()),
    T.StructField("observation_date", T.DateType()),
])

FIRE_DAILY_CLUSTERS = T.StructType([
    T.StructField("severity", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("snapshot_count", T.LongType()),
    T.StructField("snapshot_date", T.DateType()),
])
