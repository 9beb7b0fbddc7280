"""Regular intervals between the events of a pair, kept as keyed state with event-time timers.

For each pair of client and host the state holds its open hours, those that late rows may still reach, as counts by second,
at most 3,600 an hour however many events there are; and one summary of all hours that are closed. A timer closes an hour
when the watermark has passed it, in order of time, and forgets a pair that has been silent for long. The state is the
result: ``beacons_of_state`` reads it from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .streams import PAIR

HOUR = 3600
#: Seconds of a pair that are held before they are summed.
SECONDS = 1_000_000
CLOSED = "events long, first long, last long, squares double, last_micros long"
OPEN = "seconds array<int>, counts array<long>, last_micros long"


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Different seconds in order with their counts."""
    seconds, where = np.unique(np.concatenate([s for s, _ in held]), return_inverse=True)
    counts = np.zeros(len(seconds), np.int64)
    np.add.at(counts, where, np.concatenate([c for _, c in held]))
    return seconds, counts


class HourGaps(StatefulProcessor):
    """Counts by second of open hours, and a summary of the closed ones; gives a pair's summary whenever an hour closes."""

    def __init__(self, forget_hours: int):
        self.forget = forget_hours * HOUR

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.closed = handle.getValueState("closed", CLOSED)
        self.open = handle.getMapState("open", "hour long", OPEN)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # a trigger's rows are counted by second first, so that each hour's state is read and written once
        held, latest = [], {}
        for some in rows:
            at = some["at"].to_numpy(np.int64)
            held.append(np.unique(at // 1_000_000, return_counts=True))
            hours, where = np.unique(at // 1_000_000 // HOUR, return_inverse=True)
            last = np.full(len(hours), np.iinfo(np.int64).min)
            np.maximum.at(last, where, at)
            for hour, t in zip(hours.tolist(), last.tolist(), strict=True):
                latest[hour] = max(t, latest.get(hour, t))
            if sum(len(s) for s, _ in held[1:]) > SECONDS:
                held = [_summed(held)]
        if held:
            seconds, number = _summed(held)
            for hour, t in latest.items():
                mine = slice(*np.searchsorted(seconds, [hour * HOUR, (hour + 1) * HOUR]))
                counts = np.zeros(HOUR, np.int64)
                counts[seconds[mine] % HOUR] = number[mine]
                if self.open.containsKey((hour,)):
                    old_seconds, before, old = self.open.getValue((hour,))
                    counts[np.array(old_seconds, np.int64)] += np.array(before, np.int64)
                    t = max(t, old)
                else:
                    self.handle.registerTimer((hour + 1) * HOUR * 1000)
                some_seconds = np.flatnonzero(counts)
                self.open.updateValue((hour,), (some_seconds.tolist(), counts[some_seconds].tolist(), t))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        hour = expiredTimerInfo.getExpiryTimeInMs() // 1000 // HOUR - 1
        if not self.open.containsKey((hour,)):
            if self.closed.exists() and self.closed.get()[2] + self.forget <= (hour + 1) * HOUR:
                self.closed.clear()
            return
        seconds, counts, latest = self.open.getValue((hour,))
        self.open.removeKey((hour,))
        at = np.array(seconds, np.int64) + hour * HOUR
        events, first, last, squares, last_micros = self.closed.get() if self.closed.exists() else (0, int(at[0]), int(at[0]), 0.0, 0)
        gaps = np.diff(np.append(last, at)).astype(float)
        now = (events + int(sum(counts)), first, int(at[-1]), squares + float((gaps * gaps).sum()), max(last_micros, latest))
        self.closed.update(now)
        self.handle.registerTimer((int(at[-1]) // HOUR + 1) * HOUR * 1000 + self.forget * 1000)
        yield pd.DataFrame({PAIR[0]: [key[0]], PAIR[1]: [key[1]], "events": [now[0]], "last_seen": [now[2]]})

    def close(self) -> None:
        pass


def stream_pair_gaps(stream: DataFrame, delay: str, forget_hours: int = 24 * 90) -> DataFrame:
    """Keep the gaps of each pair; rows later than ``delay`` are dropped, rows without a time too. A pair that is silent for
    ``forget_hours`` is forgotten. Needs the store of ``use_keyed_state``."""
    rows = stream.where(F.col("time").isNotNull()).withWatermark("time", delay).select(*PAIR, "time", F.unix_micros("time").alias("at"))
    return rows.groupBy(*PAIR).transformWithStateInPandas(HourGaps(forget_hours), f"{PAIR[0]} string, {PAIR[1]} string, events long, last_seen long", "Update", "EventTime")


def beacons_of_state(spark: SparkSession, checkpoint: str, min_beacons: int = 10, jitter: float = 0.2) -> DataFrame:
    """Pairs whose events come at regular intervals, from the state of a query's checkpoint: closed hours' summaries and the
    seconds of open hours together."""
    read = lambda name: spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
    pair = [F.col(f"key.{c}").alias(c) for c in PAIR]
    closed = read("closed").select(*pair, "value.*")
    hours = read("open").select(*pair, F.col("user_map_key.hour").alias("hour"), "user_map_value.*")
    # an hour's summary, as if it had closed; then hours follow each other
    at = lambda i: F.element_at("seconds", i) + F.col("hour") * HOUR
    inner = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size("seconds") - 1, F.lit(1))), F.lit(0.0), lambda s, i: s + F.when(i < F.size("seconds"), F.pow(F.element_at("seconds", F.least(i + 1, F.size("seconds"))) - F.element_at("seconds", i), F.lit(2))).otherwise(0.0))
    shaped = hours.select(*PAIR, F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c).alias("events"), at(1).alias("first"), at(-1).alias("last"), inner.alias("squares"), "last_micros")
    parts = closed.select(*PAIR, "events", "first", "last", "squares", "last_micros").unionByName(shaped)
    gap = F.col("first") - F.lag("last").over(Window.partitionBy(*PAIR).orderBy("first"))
    total = parts.withColumn("between", F.coalesce(gap * gap, F.lit(0))).groupBy(*PAIR).agg(F.sum("events").alias("events"), F.min("first").alias("first"), F.max("last").alias("last"), (F.sum("squares") + F.sum("between")).alias("squares"), F.timestamp_micros(F.max("last_micros")).alias("last_seen"))
    n, span = F.col("events") - 1, (F.col("last") - F.col("first")).cast("double")
    found = total.where(n > F.greatest(F.lit(min_beacons), F.lit(1))).withColumns({"beacon_count": n, "avg_interval": span / n, "interval_stddev": F.sqrt(F.greatest(F.col("squares") - span * span / n, F.lit(0.0)) / (n - 1))})
    return found.where(F.col("interval_stddev") < F.col("avg_interval") * jitter).select(*PAIR, "beacon_count", "avg_interval", "interval_stddev", "last_seen")
