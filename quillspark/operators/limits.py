"""Time controls over logs: sliding limits, duplicate suppression, backoff and a circuit breaker."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Calls allowed in 60 seconds, by action.
LIMITS = {"login": 5, "upload": 10, "comment": 20, "retry": 10}
WINDOW_MS, SUPPRESS_MS = 60_000, 10_000


def rate_limited(log: DataFrame, keys: list[str], limit: int, window_us: int, ts: str = "ts", order: str = "event_id") -> DataFrame:
    """Adds calls (within the window up to the row, denied ones too), allowed and remaining.

    Strict bound: a call exactly one window old no longer counts. Equal times count in the order of ``order``.
    """
    d = log.withColumn("_us", F.unix_micros(ts))
    upto = W.partitionBy(*keys).orderBy("_us").rangeBetween(-(window_us - 1), 0)
    peers = W.partitionBy(*keys, "_us")
    later = F.count("*").over(peers) - F.row_number().over(peers.orderBy(order))
    d = d.withColumn("calls", F.count("*").over(upto) - later).drop("_us")
    return d.withColumn("allowed", F.col("calls") <= limit).withColumn("remaining", F.greatest(F.lit(0), F.lit(limit) - F.col("calls")))


def kept_after_suppression(times: Column, window: int) -> Column:
    """Of sorted times those that are kept: each at least ``window`` after the last *kept* one (a fold, as ``lag`` would anchor on dropped ones)."""
    start = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast("array<boolean>").alias("kept"))

    def step(a: Column, t: Column) -> Column:
        keep = a["last"].isNull() | (t - a["last"] > window)
        return F.struct(F.when(keep, t).otherwise(a["last"]).alias("last"), F.concat(a["kept"], F.array(keep)).alias("kept"))

    return F.aggregate(times, start, step, lambda a: a["kept"])


def suppressed(log: DataFrame, keys: list[str], window_us: int, ts: str = "ts", order: str = "event_id") -> DataFrame:
    """keys, order, kept of every row; a repeat within the window of a kept one of the same keys isn't kept."""
    g = log.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.unix_micros(ts).alias("t"), F.col(order).alias("o")))).alias("x"))
    g = g.withColumn("k", kept_after_suppression(F.transform("x", lambda x: x["t"]), window_us))
    return g.select(*keys, F.explode(F.arrays_zip("x", "k")).alias("z")).select(*keys, F.col("z.x.o").alias(order), F.col("z.k").alias("kept"))


@dataclass
class CircuitBreaker:
    """closed until ``most`` failures in a row, then open for ``wait`` seconds, then one trial. Driver-side control of a polling loop."""

    clock: Callable[[], float]
    most: int = 10
    wait: float = 300.0
    failures: int = 0
    opened: float | None = None

    @property
    def state(self) -> str:
        if self.opened is None:
            return "closed"
        return "half_open" if self.clock() - self.opened >= self.wait else "open"

    def allows(self) -> bool:
        return self.state != "open"

    def succeeded(self) -> None:
        self.failures, self.opened = 0, None

    def failed(self) -> None:
        self.failures += 1
        if self.state == "half_open" or self.failures >= self.most:
            self.opened = self.clock()
