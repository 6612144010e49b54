"""Number parsing, exact rounding and order-independent sums as plain Column expressions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_SUM_TYPE = "decimal(20,8)"


def parse_number(text: Column) -> Column:
    """Text to DOUBLE, NULL when it is not a plain number ('NaN', 'inf', '5d'). May overflow to
    infinity: apply `finite` to the result in a later select, so the text is parsed only once.
    """
    return F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))


def finite(value: Column) -> Column:
    """NULL for NaN and both infinities; Spark would otherwise rank NaN above every number."""
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def nearest_unit(value: Column, digits: int, half_up: bool = False) -> Column:
    """`value * 10**digits` rounded to the nearest whole number, as BIGINT.

    The exact binary value decides and ties go to even, so 2.675 gives 267 and 0.125 gives 12 for
    two digits (`half_up` sends ties up: 13). Splitting `value` into two halves recovers the error of
    the floating product exactly. Kept short: long expressions compile to code the JVM will not
    optimise.
    """
    if not 0 <= digits <= 7:
        raise ValueError("digits must be between 0 and 7")
    scale = float(10**digits)
    wide = value * 134217729.0  # 2**27 + 1
    high = wide - (wide - value)
    product = value * scale
    error = (high * scale - product) + (value - high) * scale
    whole = F.floor(product)
    tie = F.lit(-5e-324) if half_up else F.when(whole % 2 != 0, F.lit(-5e-324)).otherwise(0.0)
    return whole + F.when((product - whole - 0.5) + error > tie, 1).otherwise(0)


def exact_round(value: Column, digits: int) -> Column:
    """Round half-even on the exact binary value; huge values have no fraction and pass through."""
    small = F.abs(value) < 1e15 / 10**digits
    rounded = nearest_unit(F.when(small, value), digits).cast("double") / float(10**digits)
    return F.when(small, rounded).otherwise(value)


def fixed_text(value: Column, digits: int, half_up: bool = False) -> Column:
    """Fixed-point text with exactly `digits` decimals (at least one), for example 41.12345."""
    unit = nearest_unit(F.abs(value), digits, half_up).cast("decimal(18,0)")
    minus = (value < 0) | ((value == 0) & value.cast("string").startswith("-"))
    text = (unit * F.lit(Decimal(1).scaleb(-digits))).cast("string")
    return F.when(F.abs(value) < 1e15 / 10**digits, F.concat(F.when(minus, "-").otherwise(""), text)).otherwise(
        F.format_string(f"%.{digits}f", value))


def exact_sum(value: Column) -> Column:
    """Sum of non-null doubles that does not depend on row order; NULL when there are none.

    Values that fit DECIMAL(20,8) are added exactly; anything larger is added as DOUBLE.
    """
    exact, rest = sum_parts(value)
    return F.when(F.count(value) > 0, exact.cast("double") + rest)


def sum_parts(value: Column) -> tuple[Column, Column]:
    """The two sums that `exact_sum` adds, 0 when empty. Parts of groups can be stored and added up later."""
    exact = value.try_cast(_SUM_TYPE)
    rest = F.when(exact.isNull(), value)
    nothing = F.lit(0).cast("decimal(38,8)")
    return F.coalesce(F.sum(exact).cast("decimal(38,8)"), nothing), F.coalesce(F.sum(rest), F.lit(0.0))


def array_sum(values: Column) -> Column:
    """`exact_sum` over the non-null elements of one array (0.0 when empty)."""
    present = F.filter(values, lambda v: v.isNotNull())
    exact = F.aggregate(
        present,
        F.lit(0).cast("decimal(38,8)"),
        lambda acc, v: (acc + F.coalesce(v.try_cast(_SUM_TYPE), F.lit(0).cast(_SUM_TYPE)))
        .cast("decimal(38,8)"),
    )
    rest = F.aggregate(
        present,
        F.lit(0.0),
        lambda acc, v: acc + F.when(v.try_cast(_SUM_TYPE).isNull(), v).otherwise(0.0),
    )
    return exact.cast("double") + rest


def plain_number_text(value: Column) -> Column:
    """A DOUBLE as the shortest text that reads back to it: 20.0, 0.0005, 12345678.5, 1e-05, 1e+16."""
    raw = value.cast("string")
    # Spark switches to exponents earlier than this format; only those values are rewritten.
    digits = F.regexp_replace(raw.try_cast("decimal(38,21)").cast("string"), r"0+$", "")
    plain = F.regexp_replace(digits, r"\.$", ".0")
    power = F.regexp_replace(F.regexp_replace(raw, r"\.0E", "E"), r"E(\d)", "e+$1")
    power = F.regexp_replace(F.replace(power, F.lit("E-"), F.lit("e-")), r"e([+-])(\d)$", "e$10$2")
    size = F.abs(value)
    return (
        F.when((size == 0) | size.between(1e-3, 9.999999e6), raw)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(power)
    )
