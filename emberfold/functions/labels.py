"""Readable report labels as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberfold.functions.numeric import finite, fixed_text
from emberfold.settings import (
    CONFIDENCE_ALIASES, INTENSITY_LEVELS, SEVERITY_LEVELS, TREND_LABELS,
)


def _lookup(key: Column, table: dict[str, str], default: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key], default)


def level(value: Column, levels: list[tuple[str, float | None]]) -> Column:
    """Name of the first level whose exclusive upper limit is above `value`; lowest when missing."""
    names = F.when(finite(value).isNull(), levels[0][0])
    for name, limit in levels[:-1]:
        names = names.when(value < limit, name)
    return names.otherwise(levels[-1][0])


def severity(total_frp: Column) -> Column:
    return level(total_frp, SEVERITY_LEVELS)


def severity_label(total_frp: Column) -> Column:
    return level(total_frp, [(name.capitalize(), limit) for name, limit in SEVERITY_LEVELS])


def intensity_label(frp: Column) -> Column:
    return level(frp, INTENSITY_LEVELS)


def normal_confidence(text: Column) -> Column:
    return _lookup(F.lower(F.coalesce(text, F.lit(""))), CONFIDENCE_ALIASES, F.lit("unknown"))


def confidence_label(text: Column) -> Column:
    titles = {alias: name.capitalize() for alias, name in CONFIDENCE_ALIASES.items()}
    return _lookup(F.lower(F.coalesce(text, F.lit(""))), titles, F.coalesce(text, F.lit("Unknown")))


def trend_label(trend: Column) -> Column:
    return _lookup(F.coalesce(trend, F.lit("")), TREND_LABELS, F.lit("Unknown"))


def padded_time(value: Column) -> Column:
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(F.length(text) < 4, F.lpad(text, 4, "0")).otherwise(text)


def time_label(value: Column) -> Column:
    digits = padded_time(value)
    return F.concat(digits.substr(1, 2), F.lit(":"), digits.substr(3, 2), F.lit(" UTC"))


def observed_label(acq_date: Column, acq_time: Column) -> Column:
    return F.concat(acq_date, F.lit(" at "), time_label(acq_time))


def frp_label(frp: Column) -> Column:
    value = finite(frp)
    return F.when(value.isNull(), "Not available").otherwise(
        F.concat(fixed_text(value, 2, half_up=True), F.lit(" MW")))


def coordinates_label(latitude: Column, longitude: Column) -> Column:
    usable = latitude.between(-90, 90) & longitude.between(-180, 180)
    return F.when(
        F.coalesce(usable, F.lit(False)),
        F.concat(fixed_text(latitude, 4, half_up=True), F.lit(", "), fixed_text(longitude, 4, half_up=True)),
    ).otherwise("Location unavailable")


def duration_label(hours: Column) -> Column:
    value = finite(hours)
    return (
        F.when(value.isNull() | (value == 0), "Single observation")
        .when(value < 1, F.concat(F.floor(value * 60 + 0.5).cast("string"), F.lit(" min")))
        .otherwise(F.concat(fixed_text(value, 1, half_up=True), F.lit(" h")))
    )


def age_label(updated_at: Column, now: Column) -> Column:
    """'5 minutes ago', 'an earlier update' when unknown; never below one minute."""
    seconds = (F.unix_micros(now) - F.unix_micros(updated_at)) / 1_000_000
    minutes = F.greatest(F.floor(seconds / 60 + 0.5), F.lit(1))
    hours = F.floor(minutes / 60 + 0.5)

    def counted(number: Column, unit: str) -> Column:
        plural = F.when(number == 1, f" {unit} ago").otherwise(f" {unit}s ago")
        return F.concat(number.cast("string"), plural)

    return (
        F.when(updated_at.isNull(), "an earlier update")
        .when(minutes < 60, counted(minutes, "minute"))
        .otherwise(counted(hours, "hour"))
    )


def status_severity(status: Column) -> Column:
    return F.when(status >= 500, "ERROR").when(status >= 400, "WARNING").otherwise("INFO")


def detection_key(*columns: Column) -> Column:
    return F.concat_ws("-", *columns)
