"""Token-bucket decisions over a stream, with the bucket states kept in the state store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

import emberfold
from emberfold.operators.timeline import GUARD, SHARED, Bucket, decide

_STATE = T.StructType([
    T.StructField("guard_tokens", T.DoubleType()), T.StructField("guard_at", T.DoubleType()),
    T.StructField("shared_tokens", T.DoubleType()), T.StructField("shared_at", T.DoubleType()),
])


class _Limiter(StatefulProcessor):
    def __init__(self, key: str, tie: str, guard: Bucket, shared: Bucket):
        self._key, self._tie, self._guard, self._shared = key, tie, guard, shared

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._buckets = handle.getValueState("buckets", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["us", self._tie], kind="stable")
        held = self._buckets.get() if self._buckets.exists() else (None,) * 4
        states = [None if held[0] is None else (held[0], held[1]),
                  None if held[2] is None else (held[2], held[3])]
        decisions = [decide(states, us / 1e6, self._guard, self._shared) for us in frame["us"]]
        self._buckets.update((*(states[0] or (None, None)), *(states[1] or (None, None))))
        yield pd.DataFrame({
            self._key: [key[0]] * len(frame), "ts": frame["ts"].to_numpy(),
            self._tie: frame[self._tie].to_numpy(),
            "outcome": [d[0] for d in decisions], "retry_after": [d[1] for d in decisions]})

    def close(self) -> None:
        pass


def rate_limit_stream(
    events: DataFrame, key: str, tie: str, guard: Bucket = GUARD, shared: Bucket = SHARED
) -> DataFrame:
    """Decision per event. Needs the RocksDB state store; rows are time-ordered per micro-batch, whose
    size the source's own rate option bounds.
    """
    schema = T.StructType([
        events.schema[key], T.StructField("ts", T.TimestampType()), events.schema[tie],
        T.StructField("outcome", T.StringType()), T.StructField("retry_after", T.LongType())])
    keyed = events.select(key, "ts", tie, F.unix_micros("ts").alias("us"))
    # The process that initialises state does not see shipped packages: send the code by value.
    cloudpickle.register_pickle_by_value(emberfold)
    try:
        return keyed.groupBy(key).transformWithStateInPandas(
            statefulProcessor=_Limiter(key, tie, guard, shared), outputStructType=schema,
            outputMode="Append", timeMode="None")
    finally:
        cloudpickle.unregister_pickle_by_value(emberfold)
