"""The event log as a stream: counts of failures, claims by micro-batch, duplicates, states per request."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read(spark: SparkSession, path: str, schema: str = SCHEMA, files: int = 100, pattern: str = "*.parquet") -> DataFrame:
    """Parquet files of a folder as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", pattern).parquet(path)


def failure_counts(events: DataFrame, kind: str = "error", every: str = "1 hour", late: str = "1 day") -> DataFrame:
    """start, n of failures in tumbling windows; events later than the watermark are left out."""
    w = F.window("ts", every)
    return events.where(F.col("event_type") == kind).withWatermark("ts", late).groupBy(w).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def without_repeats(events: DataFrame, keys: list[str], within: str = "10 seconds") -> DataFrame:
    """First events of equal keys within a time of each other; approximate at the edge, the exact rule is in ``operators.limits``."""
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark(keys)


def polled(stream: DataFrame, act: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False, every: str = "10 seconds") -> StreamingQuery:
    """Calls ``act`` on each micro-batch: one at a time, and again after a failure, so it has to be idempotent by batch id."""
    writer = stream.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def committed(path: str) -> Callable[[DataFrame, int], None]:
    """An idempotent sink: each micro-batch has a folder of its own, overwritten if the batch comes again."""

    def act(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return act


class SlidingLimit(StatefulProcessor):
    """Calls of a key within the last ``window`` seconds, denied ones too; old ones leave the state as new ones come, and by timer."""

    def __init__(self, limit: int, window: float):
        self.limit, self.window = limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.calls = handle.getListState("calls", "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [x[0] for x in self.calls.get()]
        new = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        width, out = int(self.window * 1e6), []
        for us, event in zip(new["ts"].astype("datetime64[us]").astype("int64"), new["event_id"], strict=True):
            held = [t for t in held if t > us - width] + [int(us)]
            out.append((event, len(held), len(held) <= self.limit))
        self.calls.put([(t,) for t in held])
        yield pd.DataFrame({"key": [str(key[0])] * len(out), "event_id": [x[0] for x in out], "calls": [x[1] for x in out], "allowed": [x[2] for x in out]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.calls.clear()
        return iter(())

    def close(self) -> None:
        pass


def sliding_limit(events: DataFrame, key: str, limit: int, window_seconds: float) -> DataFrame:
    """key, event_id, calls, allowed of a stream; needs the RocksDB state store."""
    return events.groupBy(key).transformWithStateInPandas(SlidingLimit(limit, window_seconds), "key string, event_id long, calls long, allowed boolean", "append", "none")
