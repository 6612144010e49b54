"""Cleaning of log tables: redaction, identity checks, pseudonyms, severity, JSON lines."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfold.functions.labels import status_severity
from emberfold.functions.text import client_pseudonym, sanitize_log_text, uuid_kind


def timestamp_ms(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def json_line(
    df: DataFrame, at: str, level: Column, event: str, fields: list[str], secrets: Iterable[str] = ()
) -> Column:
    """One structured log line: fixed head, then the given fields; text is sanitised, NULLs are kept."""
    secrets = list(secrets)
    types = dict(df.dtypes)
    clean = lambda c: sanitize_log_text(F.col(c), secrets) if types[c] == "string" else F.col(c)
    return F.to_json(
        F.struct(
            timestamp_ms(F.col(at)).alias("timestamp"),
            level.alias("severity"),
            clean(event).alias("message"),
            clean(event).alias("event"),
            *[clean(c).alias(c) for c in fields]),
        {"ignoreNullFields": "false"})


def readable_line(
    df: DataFrame, at: str, level: Column, event: str, fields: list[str], secrets: Iterable[str] = ()
) -> Column:
    """The same event as one compact readable line: time | severity | event | key=value pairs."""
    secrets = list(secrets)
    types = dict(df.dtypes)
    def value(c: str) -> Column:
        text = sanitize_log_text(F.col(c), secrets) if types[c] == "string" else F.col(c)
        pair = F.to_json(F.struct(text.alias("v")), {"ignoreNullFields": "false"})
        return F.concat(F.lit(f"{c}="), F.regexp_extract(pair, r'(?s)^\{"v":(.*)\}$', 1))
    head = F.concat_ws(" | ", timestamp_ms(F.col(at)), level, sanitize_log_text(F.col(event), secrets))
    return F.concat_ws(" | ", head, F.concat_ws(" ", *[value(c) for c in fields])) if fields else head


def clean_events(
    df: DataFrame, secrets: Iterable[str], key: str,
    text: str = "text", client_id: str = "client_id", status: str = "status",
) -> DataFrame:
    """Redacted text, checked and pseudonymised identity and severity of a log table (batch or stream).

    The raw identity is dropped. Narrow: no shuffle, no Python.
    """
    return df.withColumns({
        text: sanitize_log_text(F.col(text), secrets),
        "client_kind": uuid_kind(F.col(client_id)),
        "client_key": client_pseudonym(F.col(client_id), key),
        "severity": status_severity(F.col(status)),
    }).drop(client_id)
