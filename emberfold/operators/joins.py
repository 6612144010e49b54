"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberfold import settings


def join_lookup(
    rows: DataFrame, lookup: DataFrame, key: str, total_rows: int, how: str = "inner", count: str | None = None
) -> DataFrame:
    """Join `rows` with a `lookup` that is unique on `key`; `how` is inner, left or left_semi.

    Keys holding more than 1/HOT_SHARE of the rows take a broadcast join, so their rows are never
    sent to one task. At most HOT_SHARE keys can qualify, which bounds the broadcast whatever the
    data size. `total_rows` is the known size of `rows`; small inputs skip the split. `count` names a
    column of a stored `lookup` with the rows of its key, which saves counting them; it is not returned.
    Keys without a lookup row, kept by `left`, are then not split.
    """
    if total_rows <= settings.HOT_MIN_ROWS:
        return rows.join(lookup.drop(count) if count else lookup, key, how)
    counted = lookup.select(key, F.col(count).alias("_n")) if count else rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    hot = counted.where((F.col("_n") > total_rows // settings.HOT_SHARE) & F.col(key).isNotNull()).select(key)
    lookup = lookup.drop(count) if count else lookup
    hot_lookup = lookup.join(F.broadcast(hot), key, "left_semi")
    hot_rows = rows.join(F.broadcast(hot), key, "left_semi")
    cold_rows = rows.join(F.broadcast(hot), key, "left_anti")
    return hot_rows.join(F.broadcast(hot_lookup), key, how).unionByName(
        cold_rows.join(lookup, key, how))
