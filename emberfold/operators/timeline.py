"""Per-key time operators that hold when one key has a large share of the rows.

Rows are cut into ranges of (key, time), however many of them one key or one hour holds. Each function works
inside the ranges, and over one summary row of each range that a key touches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from emberfold import settings
from emberfold.functions.geo import SpaceTimeGrid
from emberfold.operators.links import add_runs, build_slots
from emberfold.operators.normalize import instant, utc
from emberfold.functions.numeric import exact_round, exact_sum
from emberfold.operators.ranking import in_ranges

def freshness(
    reads: DataFrame, snapshots: DataFrame, key: str,
    ttl_s: int = settings.CACHE_TTL_S, parts: int | None = None,
) -> DataFrame:
    """For each read, the latest snapshot of its key at or before it, with age and staleness.

    reads: key, read_at and any other columns. snapshots: key, succeeded_at. `stale` includes an age
    of exactly `ttl_s`; no snapshot gives NULL age and available = false.
    """
    others = [c for c in reads.columns if c not in (key, "read_at")]
    nothing = reads.select(*others).schema
    asked = reads.select(
        key, F.col("read_at").alias("at"), F.lit(1).alias("kind"),
        F.lit(None).cast("timestamp").alias("known"), *others)
    loaded = snapshots.select(
        key, F.col("succeeded_at").alias("at"), F.lit(0).alias("kind"),
        F.col("succeeded_at").alias("known"),
        *[F.lit(None).cast(nothing[c].dataType).alias(c) for c in others])
    timeline = in_ranges(asked.unionByName(loaded), [key, "at", "kind"], parts)
    inside = W.partitionBy(key, "_part").orderBy("at", "kind").rowsBetween(W.unboundedPreceding, 0)
    local = timeline.withColumn("local", F.max("known").over(inside)).where("kind = 1")
    earlier = W.partitionBy(key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    carried = timeline.groupBy(key, "_part").agg(F.max("known").alias("last")).select(
        F.col(key).alias("_key"), F.col("_part").alias("_at"), F.max("last").over(earlier).alias("carried")).where(
        "carried IS NOT NULL")
    # One key of a range at most goes on from the range before.
    local = local.join(F.broadcast(carried), (F.col("_part") == F.col("_at")) & F.col(key).eqNullSafe(F.col("_key")), "left")
    found = F.coalesce("local", "carried")
    age = F.floor((F.unix_micros("at") - F.unix_micros("snapshot_at")) / 1_000_000)
    exact = (F.unix_micros("at") - F.unix_micros("snapshot_at")) >= ttl_s * 1_000_000
    return local.withColumn("snapshot_at", found).select(
        key, F.col("at").alias("read_at"), *others, "snapshot_at",
        F.col("snapshot_at").isNotNull().alias("available"),
        age.alias("data_age_seconds"), exact.alias("data_stale"))


def failure_backoff(
    attempts: DataFrame, key: str, tie: str,
    initial_s: int = settings.BACKOFF_INITIAL_S, maximum_s: int = settings.BACKOFF_MAX_S,
    parts: int | None = None,
) -> DataFrame:
    """Failed attempts with their place in the current failure streak and the delay it calls for.

    attempts: key, ts, succeeded and `tie`, a unique column that orders equal times. A success ends
    the streak.
    """
    rows = in_ranges(attempts, [key, "ts", tie], parts)
    order = W.partitionBy(key, "_part").orderBy("ts", tie).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("island", F.count_if("succeeded").over(order))
    island = W.partitionBy(key, "_part", "island").orderBy("ts", tie).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("failed_here", F.count_if(~F.col("succeeded")).over(island))
    tail = rows.groupBy(key, "_part").agg(F.max(F.struct("island", "failed_here")).alias("last"))
    by_part = W.partitionBy(key).orderBy("_part")
    running = by_part.rowsBetween(W.unboundedPreceding, 0)
    tail = tail.withColumn("streak", F.sum(
        F.when(F.col("last.island") > 0, 1).otherwise(0)).over(running))
    in_streak = W.partitionBy(key, "streak").orderBy("_part").rowsBetween(W.unboundedPreceding, 0)
    tail = tail.withColumn("at_end", F.sum("last.failed_here").over(in_streak))
    carried = tail.select(
        F.col(key).alias("_key"), F.col("_part").alias("_at"), F.lag("at_end").over(by_part).alias("carried")).where("carried > 0")
    same = (F.col("_part") == F.col("_at")) & F.col(key).eqNullSafe(F.col("_key"))
    count = F.col("failed_here") + F.when(F.col("island") == 0, F.coalesce("carried", F.lit(0))).otherwise(0)
    delay = F.least(F.pow(F.lit(2), F.least(F.col("failure_count") - 1, F.lit(30))) * initial_s,
                    F.lit(maximum_s)).cast("bigint")
    return (
        rows.where(~F.col("succeeded")).join(F.broadcast(carried), same, "left")
        .withColumn("failure_count", count)
        .select(key, "ts", tie, "failure_count", delay.alias("delay_seconds"))
        .withColumn("retry_at", F.col("ts") + F.make_dt_interval(secs=F.col("delay_seconds")))
    )


def location_sessions(detections: DataFrame, grid: SpaceTimeGrid | None = None) -> DataFrame:
    """Runs of activity per small cell: consecutive detections no more than a window apart."""
    grid = grid or SpaceTimeGrid()
    runs = add_runs(build_slots(detections, grid), grid)
    return runs.groupBy("node").agg(
        F.timestamp_seconds(F.min("t_min")).alias("started_at"),
        F.timestamp_seconds(F.max("t_max")).alias("ended_at"),
        F.sum("n").alias("detections"),
        F.min("lat_min").alias("south"), F.min("lon_min").alias("west"),
    ).drop("node")


def rolling_stats(detections: DataFrame, now, days: list[int]) -> DataFrame:
    """Count, mean and maximum FRP of several rolling windows in one pass over the widest."""
    moment = utc(now)
    tolerance = settings.FUTURE_TOLERANCE_S * 1_000_000
    age_us = F.unix_micros(instant(moment)) - F.unix_micros("observed_at")
    widest = detections.where((age_us <= max(days) * 86_400_000_000) & (age_us >= -tolerance))
    lengths = F.filter(
        F.array(*[F.lit(d) for d in sorted(set(days))]),
        lambda d: age_us <= d.cast("bigint") * 86_400_000_000)
    return (
        widest.select(F.explode(lengths).alias("days"), "frp").groupBy("days")
        .agg(F.count(F.lit(1)).alias("total_detections"),
             (exact_sum(F.col("frp")) / F.count("frp")).alias("mean"),
             F.max("frp").alias("top"))
        .select("days", "total_detections",
                F.coalesce(exact_round(F.col("mean"), 2), F.lit(0.0)).alias("average_frp"),
                F.coalesce(exact_round(F.col("top"), 2), F.lit(0.0)).alias("maximum_frp"))
    )


# --- Token bucket -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Bucket:
    capacity: int = settings.BUCKET_CAPACITY
    refill_s: float = settings.BUCKET_REFILL_S
    ttl_s: float = settings.BUCKET_TTL_S

    def take(self, state: tuple[float, float] | None, now: float):
        """((tokens, time) after the request, or None if it is refused; seconds to wait). A refusal changes nothing."""
        spent = 0.0
        if state is not None and now - state[1] < self.ttl_s:
            spent = self.capacity - state[0] - max(now - state[1], 0.0) / self.refill_s
        left = self.capacity - max(spent, 0.0)
        if left >= 1:
            return (left - 1, now), 0
        return None, max(math.ceil(self.refill_s * (1 - left)), 1)

    @property
    def full_after_s(self) -> float:
        return self.capacity * self.refill_s


SHARED = Bucket()
GUARD = Bucket(settings.GUARD_CAPACITY, settings.GUARD_REFILL_S)


def decide(states: list, now: float, guard: Bucket, shared: Bucket) -> tuple[str, int]:
    """Outcome of one request; updates the [guard, shared] states in place.

    The guard is asked first. A request the guard refuses never reaches the shared bucket.
    """
    after, wait = guard.take(states[0], now)
    if after is None:
        return "local_guard", wait
    states[0] = after
    after, wait = shared.take(states[1], now)
    if after is None:
        return "shared_bucket", wait
    states[1] = after
    return "allowed", 0


def rate_limit(
    events: DataFrame, key: str, tie: str, guard: Bucket = GUARD, shared: Bucket = SHARED
) -> DataFrame:
    """Token-bucket decision for every event of every key, in time order.

    events: key, ts and `tie`, a unique BIGINT that orders equal times. After a pause in which both
    buckets refill completely the past no longer matters, so each key splits into independent busy
    periods at such pauses and the periods spread over tasks. Rows stream through sorted; only the
    bucket states are held.
    """
    pause_us = math.ceil(max(guard.full_after_s, shared.full_after_s) * 1_000_000) + 1
    rows = events.select(key, "ts", tie, F.unix_micros("ts").alias("us")).withColumn(
        "bin", F.floor(F.col("us") / F.lit(pause_us)).cast("bigint"))
    bins = rows.groupBy(key, "bin").agg(F.min("us").alias("low"), F.max("us").alias("high"))
    order = W.partitionBy(key).orderBy("bin")
    pause = F.col("low") - F.lag("high").over(order) >= pause_us
    periods = bins.withColumn(
        "starts", F.when(F.coalesce(pause, F.lit(True)), F.col("bin"))
    ).select(key, "bin", F.max("starts").over(order.rowsBetween(W.unboundedPreceding, 0)).alias("period"))
    schema = T.StructType([
        rows.schema[key], T.StructField("ts", T.TimestampType()), rows.schema[tie],
        T.StructField("outcome", T.StringType()), T.StructField("retry_after", T.LongType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, states = None, [None, None]
        for frame in frames:
            outcomes, waits = [], []
            for k, period, us in zip(frame[key], frame["period"], frame["us"]):
                if (k, period) != current:
                    current, states = (k, period), [None, None]
                outcome, wait = decide(states, us / 1e6, guard, shared)
                outcomes.append(outcome)
                waits.append(wait)
            yield pd.DataFrame({
                key: frame[key], "ts": frame["ts"], tie: frame[tie],
                "outcome": outcomes, "retry_after": waits})

    placed = rows.join(periods, [key, "bin"]).select(key, "period", "ts", tie, "us")
    return (
        placed.repartition(key, "period").sortWithinPartitions(key, "period", "us", tie)
        .mapInPandas(run, schema)
    )
