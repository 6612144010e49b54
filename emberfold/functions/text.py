"""Text cleaning, redaction and keyed hashing as Column expressions."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfold.settings import LEGACY_CLIENT_NAMESPACE, MAX_LOG_TEXT, MAX_TEXT_LENGTH

# Canonical UUID text, any version and strictly version 4.
UUID_ANY = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
UUID_V4 = r"^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"

_PLAIN = r"^[!-~]+$"


def _non_ascii(value: Column) -> Column:
    """Whether UTF-8 text has a character above 127: only then has it more bytes than characters."""
    return F.octet_length(value) > F.length(value)


def _compose_compatible(values: pd.DataFrame) -> pd.DataFrame:
    return values.apply(lambda c: c.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore"))


def with_compatible_text(df: DataFrame, columns: list[str], suffix: str = "_nfkc") -> DataFrame:
    """Add `<column><suffix>`: each text column in Unicode NFKC form.

    ASCII text is already in that form, so Python only ever gets the non-ASCII values, those of all
    columns in one call; NULLs stand for the others. Narrow, and no job runs while the plan is built.
    """
    fields = [f"c{k}" for k in range(len(columns))]
    compose = F.pandas_udf(_compose_compatible, ", ".join(f"{f} string" for f in fields))
    odd = F.struct(*[F.when(_non_ascii(F.col(c)), F.col(c)).alias(f) for c, f in zip(columns, fields)])
    return df.withColumn("_composed", compose(odd)).withColumns({
        c + suffix: F.coalesce(F.col("_composed")[f], F.col(c)) for c, f in zip(columns, fields)
    }).drop("_composed")


def clean_text(composed: Column, maximum: int = MAX_TEXT_LENGTH) -> Column:
    """Drop control and other category-C characters, strip; NULL when empty or longer than `maximum`."""
    kept = F.regexp_replace(composed, r"\p{C}", "")
    stripped = F.regexp_replace(kept, r"^\p{Z}+|\p{Z}+$", "")
    # Printable ASCII without spaces, the usual case, needs no cleaning.
    return (
        F.when(composed.rlike(_PLAIN) & (F.length(composed) <= maximum), composed)
        .when(F.length(stripped).between(1, maximum), stripped)
    )


def sanitize_log_text(text: Column, secrets: Iterable[str] = ()) -> Column:
    """Redact secrets, collapse control characters to one space, cut to the log field length."""
    for secret in secrets:
        if secret:
            text = F.replace(text, F.lit(secret), F.lit("[REDACTED]"))
    return F.substring(F.regexp_replace(text, r"[\x00-\x1f\x7f]+", " "), 1, MAX_LOG_TEXT)


def uuid_kind(text: Column) -> Column:
    """'v4' for a canonical version-4 UUID, 'other' for any other canonical UUID, else 'invalid'."""
    return (
        F.when(text.rlike(UUID_V4), "v4").when(text.rlike(UUID_ANY), "other").otherwise("invalid")
    )


def hmac_sha256(message: Column, secret: str) -> Column:
    """Hex HMAC-SHA256 of a BINARY column; only the two padded keys are computed on the driver."""
    key = secret.encode("utf-8")
    if not key:
        raise ValueError("a non-empty secret is required")
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    inner = F.lit(bytes(b ^ 0x36 for b in key))
    outer = F.lit(bytes(b ^ 0x5C for b in key))
    digest = F.unhex(F.sha2(F.concat(inner, message), 256))
    return F.sha2(F.concat(outer, digest), 256)


def client_pseudonym(client_id: Column, secret: str, required: bool = False) -> Column:
    """Keyed hash of a canonical UUIDv4; a missing id maps to one shared key unless `required`.

    NULL marks an identity that must be refused.
    """
    missing = client_id.isNull() | (client_id == "")
    raw = F.unhex(F.replace(client_id, F.lit("-"), F.lit("")))
    known = F.when(client_id.rlike(UUID_V4), hmac_sha256(raw, secret))
    legacy = hmac_sha256(F.lit(LEGACY_CLIENT_NAMESPACE), secret)
    return F.when(missing, F.lit(None) if required else legacy).otherwise(known)
