"""Positions in an order, and other work along an order, without one task for a table, a group or a value.

Rows are cut into ranges of the whole order by Spark's sampled range partitioning. A hash of the row and a row
number end the order, so equal values, however many, spread over ranges too. What a range needs to
know of those before it is a few numbers for each range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberfold.session import written


def in_ranges(rows: DataFrame, order: list[Column | str], parts: int | None = None) -> DataFrame:
    """`rows` with `_part`, the number of their range of `order`, and `_tie`, which ends the order.

    `parts` is the number of ranges, by default Spark's choice. The rows are written, as their ranges must stay.
    """
    ended = rows.withColumns({"_tie": F.xxhash64(*rows.columns), "_row": F.monotonically_increasing_id()})
    keys = [*order, "_tie", "_row"]
    ranged = ended.repartitionByRange(parts, *keys) if parts else ended.repartitionByRange(*keys)
    return written(ranged.drop("_row").withColumn("_part", F.spark_partition_id()), "ranges")[0]


def with_place(
    rows: DataFrame, group: list[str], order: list[Column | str], name: str = "place", parts: int | None = None
) -> DataFrame:
    """`rows` with their 1-based position in `order` within `group` (none: the whole table).

    Rows that are equal in `order` follow each other by a hash of the row. A null group is a group like any other.
    """
    ranged = in_ranges(rows, [*group, *order], parts)
    counts = ranged.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = (W.partitionBy(*group) if group else W.partitionBy(F.lit(0))).orderBy("_part").rowsBetween(
        W.unboundedPreceding, -1)
    # Only the first group of a range can continue from the one before: one row for each range at most.
    carried = counts.withColumn("_before", F.sum("_n").over(earlier)).where("_before > 0").select(
        F.col("_part").alias("_at"), "_before", *[F.col(g).alias(f"_group_{g}") for g in group])
    same = F.col("_part") == F.col("_at")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_group_{g}"))
    inside = W.partitionBy("_part", *group).orderBy(*order, "_tie")
    return (
        ranged.withColumn("_here", F.row_number().over(inside)).join(F.broadcast(carried), same, "left")
        .withColumn(name, F.coalesce("_before", F.lit(0)) + F.col("_here"))
        .select(*rows.columns, name)
    )
