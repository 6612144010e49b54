"""Detections derived from the `events` table, the only stream-like table of the test data."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberfold.session import pin_utc
from emberfold.settings import DETECTION_COLUMNS

NOW = datetime(2024, 1, 31, tzinfo=timezone.utc)
DAYS = 31


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return pin_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def detections(events: DataFrame, *extra: str) -> DataFrame:
    """Each user is a hot spot and each event one detection near it."""
    return events.selectExpr(
        *extra,
        "event_id",
        "round(36.0e0 + (user_id * 37 % 790) / 100.0e0 + ((event_id * 7919) % 41 - 20) / 1000.0e0, 5)"
        " AS latitude",
        "round(-9.0e0 + (user_id * 91 % 1300) / 100.0e0 + ((event_id * 104729) % 41 - 20) / 1000.0e0, 5)"
        " AS longitude",
        "CASE event_id % 3 WHEN 0 THEN 'l' WHEN 1 THEN 'n' ELSE 'h' END AS confidence",
        "CAST(CAST(ts AS DATE) AS STRING) AS acq_date",
        "CAST(hour(ts) * 100 + minute(ts) AS INT) AS acq_time",
        "CASE event_type WHEN 'click' THEN 'N20' WHEN 'error' THEN 'N20' WHEN 'signup' THEN 'NPP'"
        " ELSE 'N21' END AS satellite",
        "value AS frp",
        "CAST(date_trunc('minute', ts) AS TIMESTAMP) AS observed_at",
    )


def dirty_detections(events: DataFrame) -> DataFrame:
    """The same rows as text with planted faults, some repeated with other values."""
    clean = detections(events)
    text = clean.select("event_id", *[F.col(c).cast("string").alias(c) for c in DETECTION_COLUMNS])
    every = lambda n: F.col("event_id") % n == 0
    override = lambda column, *rules: _case(column, rules)
    text = text.select(
        "event_id",
        override("latitude", (every(97), F.lit("90"))),
        "longitude",
        override("confidence", (every(71), F.lit("unexpected"))),
        "acq_date",
        override("acq_time", (every(89), F.lit("2460"))),
        override("satellite", (every(83), F.lit("\x07")),
                 (every(67), F.concat("satellite", F.lit("\x07")))),
        override("frp", (every(73), F.lit("1001")), (every(79), F.lit("not-a-number"))),
    )
    copies = text.where(every(61)).withColumns({"confidence": F.lit("h"), "frp": F.lit("20")})
    return text.unionByName(copies)


def _case(column, rules):
    result = F
    for condition, value in rules:
        result = result.when(condition, value)
    return result.otherwise(F.col(column)).alias(column)
