"""Validation, normalisation, deduplication and the quality report of raw detections."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfold.functions.labels import normal_confidence
from emberfold.functions.numeric import finite, nearest_unit, parse_number, plain_number_text
from emberfold.functions.text import clean_text, with_compatible_text
from emberfold.operators.ranking import with_place
from emberfold.settings import BOUNDS, DETECTION_COLUMNS, FUTURE_TOLERANCE_S, HIGH_FRP_MW

CANONICAL_ORDER = ["acq_date", "acq_time", "latitude", "longitude", "satellite"]
REPORT_COLUMNS = [
    "received_rows", "accepted_rows", "dropped_rows", "duplicates_removed",
    "conflicting_duplicates", "invalid_coordinates", "invalid_timestamps", "invalid_satellites",
    "invalid_frp", "high_frp", "unknown_confidence",
]


class InvalidBatch(ValueError):
    """The source batch as a whole must not replace an earlier good one."""


def require_columns(df: DataFrame, columns: Sequence[str] = DETECTION_COLUMNS) -> DataFrame:
    """Fail before any job runs when a required column is missing; extra columns are allowed."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise InvalidBatch(f"missing required columns: {', '.join(missing)}")
    return df


def utc(moment: datetime) -> datetime:
    return moment.replace(tzinfo=timezone.utc) if moment.tzinfo is None else moment.astimezone(timezone.utc)


def instant(moment: datetime) -> Column:
    return F.timestamp_micros(F.lit(round((utc(moment) - datetime(1970, 1, 1, tzinfo=timezone.utc))
                                          / timedelta(microseconds=1))))


def parse_day(acq_date: Column) -> Column:
    """DATE of YYYY-MM-DD text (month and day may be unpadded), else NULL."""
    return F.when(acq_date.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), acq_date.try_cast("date"))


def valid_time(number: Column) -> Column:
    """HHMM as a whole number, NULL unless it is integral with hour <= 23 and minute <= 59."""
    fits = number.between(0, 2359) & (number == F.floor(number)) & (number % 100 <= 59)
    return F.when(fits, number.cast("int"))


def time_text(hhmm: Column) -> Column:
    return F.lpad(hhmm.cast("string"), 4, "0")


def observed(day: Column, hhmm: Column) -> Column:
    """UTC timestamp of a date and a valid HHMM number."""
    seconds = F.unix_date(day).cast("bigint") * 86400 + F.floor(hhmm / 100) * 3600 + (hhmm % 100) * 60
    return F.when(F.year(day) >= 1, F.timestamp_seconds(seconds))


def sealed(df: DataFrame) -> DataFrame:
    """Same rows, but later filters stay above this point.

    Spark pushes a filter on a computed column down by repeating the whole expression; with long
    parsing expressions that would evaluate them many times per row.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def annotate(
    df: DataFrame,
    days: int,
    now: datetime,
    bounds: tuple[float, float, float, float] = BOUNDS,
) -> DataFrame:
    """Every input row with its parsed values, `reject_reason` (NULL = accepted) and quality flags.

    Checks run in a fixed order and the first failure names the reason. Narrow: no shuffle.
    """
    require_columns(df)
    if days < 1:
        raise ValueError("days must be at least 1")
    west, south, east, north = bounds
    earliest, latest = utc(now) - timedelta(days=days), utc(now) + timedelta(seconds=FUTURE_TOLERANCE_S)

    computed = {*DETECTION_COLUMNS, "observed_at", "quality_flags", "reject_reason"}
    extras = [c for c in df.columns if c not in computed]
    text = df.select(*[F.col(c).cast("string").alias(c) for c in DETECTION_COLUMNS], *extras)
    text = with_compatible_text(text, ["satellite", "confidence"])
    parsed = text.select(
        *extras,
        *[parse_number(F.col(c)).alias(c) for c in ("latitude", "longitude", "acq_time", "frp")],
        parse_day(F.col("acq_date")).alias("day"),
        clean_text(F.col("satellite_nfkc")).alias("satellite"),
        F.col("satellite").alias("satellite_raw"),
        clean_text(F.col("confidence_nfkc")).alias("confidence_clean"),
        F.col("confidence").alias("confidence_raw"),
    )
    parsed = parsed.withColumn("hhmm", valid_time(F.col("acq_time"))).withColumns({
        "frp": finite(F.col("frp")),
        "observed_at": observed(F.col("day"), F.col("hhmm")),
    })

    located = (
        F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180)
        & F.col("latitude").between(south, north) & F.col("longitude").between(west, east)
    )
    timely = F.col("observed_at").between(instant(earliest), instant(latest))
    frp_ok = F.col("frp") >= 0
    checked = parsed.select(
        "*",
        F.when(~F.coalesce(located, F.lit(False)), "invalid_coordinates")
        .when(~F.coalesce(timely, F.lit(False)), "invalid_timestamps")
        .when(F.col("satellite").isNull(), "invalid_satellites")
        .alias("reject_reason"),
        F.coalesce("confidence_clean", F.lit("unknown")).alias("confidence"),
    )
    flag = lambda condition, name: F.when(F.coalesce(condition, F.lit(False)), name)
    # In alphabetical order already, so the array needs no sort.
    flags = F.array_compact(F.array(
        flag(F.col("confidence_clean") != F.col("confidence_raw"), "confidence_sanitized"),
        flag(normal_confidence(F.col("confidence")) == "unknown", "confidence_unknown"),
        F.when(F.coalesce(frp_ok, F.lit(False)), flag(F.col("frp") > HIGH_FRP_MW, "frp_high"))
        .otherwise("frp_invalid"),
        flag(F.col("satellite") != F.col("satellite_raw"), "satellite_sanitized"),
    ))
    return sealed(checked.select(
        *extras,
        "latitude", "longitude", "confidence",
        F.date_format("observed_at", "yyyy-MM-dd").alias("acq_date"),
        F.col("hhmm").alias("acq_time"),
        "satellite",
        F.when(frp_ok, F.col("frp")).alias("frp"),
        flags.alias("quality_flags"),
        "observed_at",
        "reject_reason",
    ))


def _quoted(text: Column) -> Column:
    quote = F.when(text.contains("'") & ~text.contains('"'), '"').otherwise("'")
    escaped = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    escaped = F.when(quote == "'", F.replace(escaped, F.lit("'"), F.lit("\\'"))).otherwise(escaped)
    return F.concat(quote, escaped, quote)


def tie_break_key() -> Column:
    """Text order that picks the winner among rows of one identity, whatever order they came in."""
    flags = F.col("quality_flags")
    listed = F.concat(F.lit("('"), F.array_join(flags, "', '"), F.lit("'"))
    flag_text = (
        F.when(F.size(flags) == 0, "()")
        .when(F.size(flags) == 1, F.concat(listed, F.lit(",)")))
        .otherwise(F.concat(listed, F.lit(")")))
    )
    return F.struct(
        _quoted(F.col("confidence")).alias("k1"),
        F.coalesce(plain_number_text(F.col("frp")), F.lit("None")).alias("k2"),
        plain_number_text(F.col("latitude")).alias("k3"),
        plain_number_text(F.col("longitude")).alias("k4"),
        flag_text.alias("k5"),
    )


def deduplicate(accepted: DataFrame) -> DataFrame:
    """One row per (latitude and longitude at 5 decimals, time, satellite), plus group counters.

    Both steps are mergeable aggregates, so any number of copies of one observation collapses
    before the shuffle. The costly text key is built after identical copies are already merged.
    Extra columns of the winner are kept; the smallest value decides when they differ.
    """
    canonical = ["latitude", "longitude", "confidence", "frp", "quality_flags"]
    identity = ["lat_unit", "lon_unit", "observed_at", "satellite"]
    fixed = {*canonical, *identity, "acq_date", "acq_time", "reject_reason"}
    extras = [c for c in accepted.columns if c not in fixed]
    variants = (
        accepted.withColumns({
            "lat_unit": nearest_unit(F.col("latitude"), 5),
            "lon_unit": nearest_unit(F.col("longitude"), 5),
        })
        .groupBy(*identity, *canonical)
        .agg(F.count(F.lit(1)).alias("copies"), *[F.min(c).alias(c) for c in extras])
    )
    best = variants.select(
        *identity,
        "copies",
        F.struct(tie_break_key().alias("key"), *canonical, *extras,
                 F.col("copies").alias("same")).alias("row"),
    ).groupBy(*identity).agg(F.min("row").alias("row"), F.sum("copies").alias("group_rows"))
    return best.select(
        *[F.col(f"row.{c}") for c in extras],
        "row.latitude", "row.longitude", "row.confidence",
        F.date_format("observed_at", "yyyy-MM-dd").alias("acq_date"),
        F.date_format("observed_at", "HHmm").cast("int").alias("acq_time"),
        "satellite", "row.frp", "row.quality_flags", "observed_at",
        "group_rows",
        (F.col("group_rows") - F.col("row.same")).alias("conflicts"),
    )


def quality_report(annotated: DataFrame, deduplicated: DataFrame) -> DataFrame:
    """The eleven counters as one row: one pass over each side, merged as two partial rows."""
    reason = lambda name: F.count_if(F.col("reject_reason") == name).alias(name)
    kept = F.col("reject_reason").isNull()
    flagged = lambda name: F.count_if(kept & F.array_contains("quality_flags", name))
    zero = F.lit(0).cast("bigint")
    before = annotated.agg(
        F.count(F.lit(1)).alias("received_rows"),
        zero.alias("accepted_rows"),
        zero.alias("duplicates_removed"),
        zero.alias("conflicting_duplicates"),
        reason("invalid_coordinates"), reason("invalid_timestamps"), reason("invalid_satellites"),
        flagged("frp_invalid").alias("invalid_frp"),
        flagged("frp_high").alias("high_frp"),
        flagged("confidence_unknown").alias("unknown_confidence"),
    )
    after = deduplicated.agg(
        zero.alias("received_rows"),
        F.count(F.lit(1)).alias("accepted_rows"),
        F.coalesce(F.sum(F.col("group_rows") - 1), zero).alias("duplicates_removed"),
        F.coalesce(F.sum("conflicts"), zero).alias("conflicting_duplicates"),
        *[zero.alias(c) for c in REPORT_COLUMNS[5:]],
    )
    total = before.unionByName(after)
    total = total.agg(*[F.sum(c).alias(c) for c in total.columns])
    dropped = F.col("received_rows") - F.col("accepted_rows") - F.col("duplicates_removed")
    return total.withColumn("dropped_rows", dropped).select(*REPORT_COLUMNS)


def accepted_rows(annotated: DataFrame) -> DataFrame:
    return annotated.where(F.col("reject_reason").isNull()).drop("reject_reason")


def normalize(
    df: DataFrame,
    days: int,
    now: datetime,
    bounds: tuple[float, float, float, float] = BOUNDS,
) -> tuple[DataFrame, DataFrame]:
    """(clean detections, one-row quality report) of a raw batch for a rolling window of days."""
    annotated = annotate(df, days, now, bounds)
    groups = deduplicate(accepted_rows(annotated))
    return groups.drop("group_rows", "conflicts"), quality_report(annotated, groups)


def require_valid_rows(report: DataFrame) -> dict[str, int]:
    """The report as numbers; refuses a non-empty batch in which no row is valid."""
    counters = report.first().asDict()
    if counters["received_rows"] and not counters["accepted_rows"]:
        raise InvalidBatch("the batch contains no valid rows")
    return counters


def canonical_sort(df: DataFrame) -> DataFrame:
    return df.orderBy(*CANONICAL_ORDER)


def canonical_places(df: DataFrame) -> DataFrame:
    """Every row with its `place` in canonical order."""
    return with_place(df, [], CANONICAL_ORDER)


def coerce_for_clustering(df: DataFrame) -> DataFrame:
    """Rows that were never normalised, made usable for clustering.

    Rows without usable coordinates or time are left out, unusable FRP becomes NULL, and no bounds
    or window apply. Already normalised rows pass through unchanged in meaning.
    """
    require_columns(df)
    computed = {*DETECTION_COLUMNS, "observed_at", "acq_time_text", "confidence_normalized"}
    passed = [c for c in df.columns if c not in computed]
    types = dict(df.dtypes)
    number = lambda c: (
        parse_number(F.col(c)) if types[c] == "string" else F.col(c).cast("double")).alias(c)
    parsed = df.select(
        *passed,
        number("latitude"), number("longitude"), number("frp"),
        parse_number(F.col("acq_time").cast("string")).alias("time_number"),
        F.col("acq_date").cast("string").alias("acq_date"),
        F.col("satellite").cast("string").alias("satellite"),
        F.col("confidence").cast("string").alias("confidence"),
    )
    parsed = parsed.withColumns({
        "hhmm": valid_time(F.floor("time_number")),
        "day": parse_day(F.col("acq_date")),
    })
    shaped = sealed(parsed.select(
        *passed,
        "latitude", "longitude", "confidence", "acq_date",
        time_text(F.col("hhmm")).alias("acq_time_text"),
        "satellite",
        finite(F.col("frp")).alias("frp"),
        observed(F.col("day"), F.col("hhmm")).alias("observed_at"),
        normal_confidence(F.col("confidence")).alias("confidence_normalized"),
    ))
    return shaped.where(
        F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180)
        & F.col("observed_at").isNotNull())
