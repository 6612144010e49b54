"""Readable report tables: one narrow select over detections or incidents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfold.functions import labels as L


def label_detections(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "detection_key": L.detection_key(
            F.col("latitude").cast("string"), F.col("longitude").cast("string"),
            F.col("acq_date"), F.col("acq_time").cast("string"), F.col("satellite")),
        "intensity": L.intensity_label(F.col("frp")),
        "time_label": L.time_label(F.col("acq_time")),
        "observed_label": L.observed_label(F.col("acq_date"), F.col("acq_time")),
        "confidence_label": L.confidence_label(F.col("confidence")),
        "frp_label": L.frp_label(F.col("frp")),
        "coordinates_label": L.coordinates_label(F.col("latitude"), F.col("longitude")),
    })


def label_incidents(df: DataFrame, now: Column) -> DataFrame:
    return df.withColumns({
        "level_label": L.severity_label(F.col("total_frp_mw")),
        "duration_label": L.duration_label(F.col("duration_hours")),
        "trend_label": L.trend_label(F.col("trend")),
        "age_label": L.age_label(F.col("last_detected_at"), now),
    })
