"""Reading detection files: text columns by name, optional volume guards, area and window selection."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberfold.operators.normalize import InvalidBatch, instant, require_columns, utc
from emberfold.session import written
from emberfold.settings import BOUNDS, DETECTION_COLUMNS, FUTURE_TOLERANCE_S


class BatchTooLarge(InvalidBatch):
    """The batch exceeds a limit its owner asked for."""


def read_detections_csv(
    spark: SparkSession,
    paths: str | list[str],
    max_rows: int | None = None,
    max_bytes: int | None = None,
) -> DataFrame:
    """Header CSV files as STRING columns chosen by name; extra columns are ignored.

    A record that does not fit the header stops the read. Limits are off by default: nothing here
    is quadratic in the rows.
    """
    if max_bytes is not None:
        check_bytes(spark, paths, max_bytes)
    df = require_columns(spark.read.csv(paths, header=True, inferSchema=False, mode="FAILFAST"))
    df = df.select(*[F.col(c).cast("string").alias(c) for c in DETECTION_COLUMNS])
    return df if max_rows is None else check_rows(df, max_rows)


def read_with_quarantine(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(good rows, text of malformed records) instead of failing on the first malformed record."""
    header = require_columns(spark.read.csv(paths, header=True, inferSchema=False)).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*header, "_malformed"]])
    df = spark.read.csv(
        paths, header=True, schema=schema, enforceSchema=False, mode="PERMISSIVE",
        columnNameOfCorruptRecord="_malformed")
    # Written once: both results then come from the same parse.
    df, _ = written(df.select(*DETECTION_COLUMNS, "_malformed"), "parsed")
    good = df.where(F.col("_malformed").isNull()).select(*DETECTION_COLUMNS)
    return good, df.where(F.col("_malformed").isNotNull()).select(F.col("_malformed").alias("record"))


def check_rows(df: DataFrame, max_rows: int) -> DataFrame:
    """Refuse a batch of more than `max_rows`; exactly `max_rows` is allowed."""
    if df.count() > max_rows:
        raise BatchTooLarge(f"the batch exceeds {max_rows} rows")
    return df


def check_bytes(spark: SparkSession, paths: str | list[str], max_bytes: int) -> int:
    """Refuse files of more than `max_bytes` in total, or of none at all, without reading contents."""
    files = spark.read.format("binaryFile").load(paths).select("length")
    total = files.agg(F.sum("length")).first()[0] or 0
    if total == 0:
        raise InvalidBatch("the batch is empty")
    if total > max_bytes:
        raise BatchTooLarge(f"the batch exceeds {max_bytes} bytes")
    return total


def column_presence(df: DataFrame) -> DataFrame:
    """(column, present_values) of every required column, in one pass; a missing column fails first."""
    require_columns(df)
    counts = df.agg(*[F.count(c).alias(c) for c in DETECTION_COLUMNS])
    return counts.unpivot([], DETECTION_COLUMNS, "column", "present_values")


def select_area(
    detections: DataFrame,
    days: int,
    now: datetime,
    bounds: tuple[float, float, float, float] = BOUNDS,
) -> DataFrame:
    """Typed detections of one area and rolling window; plain comparisons, so Parquet can skip data."""
    west, south, east, north = bounds
    earliest, latest = utc(now) - timedelta(days=days), utc(now) + timedelta(seconds=FUTURE_TOLERANCE_S)
    area = (
        (F.col("latitude") >= south) & (F.col("latitude") <= north)
        & (F.col("longitude") >= west) & (F.col("longitude") <= east)
    )
    window = (F.col("observed_at") >= instant(earliest)) & (F.col("observed_at") <= instant(latest))
    return detections.where(area & window)
