"""Continuous mapping, extraction, metrics, matching and detection.

Each function takes a streaming DataFrame and returns one; the caller chooses the sink, its checkpoint and the
trigger. Event times must be timestamps with a zone, as watermarks need them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from vigil.operators.hunting import seconds_between
from vigil.operators.mapping import Spec, apply_mapping
from vigil.operators.observables import extract_observables
from vigil.functions.computed import host_suffixes
from vigil.sources import folders

#: State that keeps single values per key needs this store.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Rows of a feed that are sent to all tasks, at most.
FEED_ROWS = 200_000


def use_keyed_state(spark: SparkSession) -> None:
    """Choose the state store that keyed processors need, for queries started from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def stream_mapping(stream: DataFrame, specs: list[Spec], class_uid: int, category_uid: int, threshold: float = 0.5) -> DataFrame:
    """Raw records to events; no state."""
    return apply_mapping(stream, specs, class_uid, category_uid, threshold)


def stream_extract_observables(stream: DataFrame, type_paths: dict[int, tuple[str, tuple[str, ...]]]) -> DataFrame:
    """Events to indicators; no state."""
    return extract_observables(stream, type_paths)


def stream_metric(stream: DataFrame, metrics: dict[str, Column], granularity: str, delay: str, keys: list[str] | None = None, time: str = "time") -> DataFrame:
    """Aggregates by tumbling window and keys; rows later than ``delay`` are dropped. Distinct counts must be approximate.

    Weeks begin on Mondays, as in batch queries. Months differ in length, so they are no windows: they are groups whose
    state stays, one row for each month and key.
    """
    rows = stream.withWatermark(time, delay)
    if granularity == "month":
        return rows.groupBy(F.date_trunc("month", time).alias("time_bucket"), *(keys or [])).agg(*(c.alias(n) for n, c in metrics.items()))
    length = {"minute": "1 minute", "hour": "1 hour", "day": "1 day", "week": "7 days"}[granularity]
    # windows are counted from a Thursday
    window = F.window(time, length, startTime="4 days") if granularity == "week" else F.window(time, length)
    grouped = rows.groupBy(window.alias("w"), *(keys or []))
    return grouped.agg(*(c.alias(n) for n, c in metrics.items())).select(F.col("w.start").alias("time_bucket"), *(keys or []), *metrics)


def stream_ioc_match(stream: DataFrame, feed: DataFrame, host: str = "query_hostname") -> DataFrame:
    """Arriving events that match a static feed's domains, by an equality join on the host's suffixes; no state.

    A feed of up to ``FEED_ROWS`` domains goes to the events, as the suffixes of many hosts are the same few.
    """
    domains = feed.where(F.col("indicator_type") == "domain")
    if domains.limit(FEED_ROWS + 1).count() <= FEED_ROWS:
        domains = F.broadcast(domains)
    return stream.withColumn("indicator", F.explode(host_suffixes(host))).join(domains, "indicator")


def stream_dedupe(stream: DataFrame, key: str, delay: str, time: str = "time") -> DataFrame:
    """The first row of each key; a key is remembered as long as the watermark allows late rows."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


PAIR = ["source_ip", "query_hostname"]


#: The stretches of time that a pair's chunks are kept as.
CHUNK = ["first", "last", "n", "total", "squares"]


def stream_beaconing(stream: DataFrame, path: str, checkpoint: str, chunk: str = "hour", every: str | None = None, compact: int = 16) -> StreamingQuery:
    """Keep the gaps between the events of each pair of client and host up to date; ``beacons`` reads them.

    Each trigger appends its times, by day, to ``path/times`` and counts anew the chunks that it touches, from the times
    of these days. So late rows count as if they had come in time, and a hot pair's rows are ordered by Spark, chunk by
    chunk. A trigger that is repeated overwrites what it wrote. Each ``compact`` triggers the chunks' last counts are put
    together in ``path/whole``, and what they came from goes with the next time. Times of days so old that no row comes
    any more may be deleted by day and by hand of the tables' owner.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(*PAIR, "time", F.date_trunc(chunk, "time").alias("chunk"), F.to_date("time").alias("day")).withColumn("batch", F.lit(number))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(f"{path}/times")
        times = spark.read.schema(rows.schema).parquet(f"{path}/times")
        new = times.where(F.col("batch") == number)
        days = [r.day for r in new.select("day").distinct().collect()]  # the days of one trigger
        touched = new.select(*PAIR, "chunk").distinct()
        every_time = times.where(F.col("day").isin(days) & (F.col("batch") <= number)).join(touched, [*PAIR, "chunk"], "left_semi")
        gaps = every_time.withColumn("gap", seconds_between(F.lag("time").over(Window.partitionBy(*PAIR, "chunk").orderBy("time")), F.col("time")))
        stats = gaps.groupBy(*PAIR, "chunk").agg(F.min("time").alias("first"), F.max("time").alias("last"), F.count("gap").alias("n"), F.sum("gap").alias("total"), F.sum((F.col("gap") * F.col("gap")).cast("decimal(38,0)")).alias("squares"))
        stats.write.mode("overwrite").parquet(f"{path}/chunks/batch={number}")
        if number % compact == compact - 1:
            old = [n for n in _numbers(spark, f"{path}/whole", "upto") if n < number]
            covered = [n for n in _numbers(spark, f"{path}/chunks", "batch") if n <= max(old, default=-1)]
            _chunks(spark, path, number - 1, number).drop("batch").write.mode("overwrite").parquet(f"{path}/whole/upto={number}")
            for name in (*(f"whole/upto={n}" for n in old[:-1]), *(f"chunks/batch={n}" for n in covered)):
                folders.remove(spark, f"{path}/{name}")

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def _numbers(spark: SparkSession, path: str, name: str) -> list[int]:
    """The numbers of finished folders ``name=number``."""
    found = [int(x.split("=")[1]) for x in folders.children(spark, path) if x.startswith(f"{name}=")]
    return sorted(n for n in found if folders.exists(spark, f"{path}/{name}={n}/_SUCCESS"))


def _chunks(spark: SparkSession, path: str, before: int | None = None, last: int | None = None) -> DataFrame:
    """The last count of each chunk: from the newest whole one (up to ``before``) and the triggers after it (up to ``last``)."""
    whole = [n for n in _numbers(spark, f"{path}/whole", "upto") if before is None or n <= before]
    start = max(whole, default=-1)
    after = [n for n in _numbers(spark, f"{path}/chunks", "batch") if n > start and (last is None or n <= last)]
    parts = [spark.read.parquet(f"{path}/chunks/batch={n}").withColumn("batch", F.lit(n)) for n in after]
    if whole:
        parts.append(spark.read.parquet(f"{path}/whole/upto={start}").withColumn("batch", F.lit(start)))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy(*PAIR, "chunk").agg(F.max_by(F.struct(*CHUNK, "batch"), "batch").alias("c")).select(*PAIR, "chunk", "c.*")


def beacons(spark: SparkSession, path: str, min_beacons: int = 10, jitter: float = 0.2) -> DataFrame:
    """Pairs whose events come at regular intervals, from the chunks that ``stream_beaconing`` keeps: the last count of each
    chunk, and the gaps between chunks."""
    chunks = _chunks(spark, path).drop("batch")
    between = seconds_between(F.lag("last").over(Window.partitionBy(*PAIR).orderBy("chunk")), F.col("first"))
    found = chunks.withColumn("between", between).groupBy(*PAIR).agg(
        (F.sum("n") + F.count("between")).alias("beacon_count"),
        (F.coalesce(F.sum("total"), F.lit(0)) + F.coalesce(F.sum("between"), F.lit(0))).alias("total"),
        (F.coalesce(F.sum("squares"), F.lit(0)) + F.coalesce(F.sum((F.col("between") * F.col("between")).cast("decimal(38,0)")), F.lit(0))).cast("double").alias("squares"),
        F.max("last").alias("last_seen"),
    )
    n, total = F.col("beacon_count"), F.col("total").cast("double")
    found = found.where(n > F.greatest(F.lit(min_beacons), F.lit(1))).withColumn("avg_interval", total / n)
    found = found.withColumn("interval_stddev", F.sqrt(F.greatest(F.col("squares") - total * total / n, F.lit(0.0)) / (n - 1)))
    return found.where(F.col("interval_stddev") < F.col("avg_interval") * jitter).select(*PAIR, "beacon_count", "avg_interval", "interval_stddev", "last_seen")


class FirstSeen(StatefulProcessor):
    """The first time of a key, which is forgotten some time after its last change; given when the key is new and again when
    an earlier event comes late."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("seen", "at long", self.ttl)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at = min(int(some["at"].min()) for some in rows)
        if not self.state.exists() or at < self.state.get()[0]:
            self.state.update((at,))
            yield pd.DataFrame({"key": [key[0]], "first_seen": [at]})

    def close(self) -> None:
        pass


def stream_first_seen(stream: DataFrame, key: str, ttl_seconds: int | None = None) -> DataFrame:
    """Keys never seen before with the time of their first event; of the rows of a key the last one holds.

    Rows without a time are left out; a null key is a key. Events are counted down to one a key and task before they
    are dealt. With ``ttl_seconds`` a key is forgotten that long after its last change, and is new when it comes again; for
    that, events go to a keyed processor in batches. Such a query looks at the clock, so it goes on until it is stopped.
    """
    keyed = stream.where(F.col("time").isNotNull()).select(F.col(key).cast("string").alias("key"), F.unix_micros("time").alias("at"))
    if ttl_seconds is None:
        found = keyed.groupBy("key").agg(F.min("at").alias("first_seen"))
    else:
        found = keyed.groupBy("key").transformWithStateInPandas(FirstSeen(ttl_seconds * 1000), "key string, first_seen long", "Update", "ProcessingTime")
    return found.select("key", F.timestamp_micros("first_seen").alias("first_seen"))


def stream_refresh(stream: DataFrame, path: str, checkpoint: str, key: str = "observable_id", every: str | None = None, time: str = "event_time") -> StreamingQuery:
    """Keep a written table, partitioned by day, up to date: rows of keys that it hasn't got are appended.

    A key belongs to one event and so to one day; a trigger reads only the keys of its own days. Without ``every`` the
    query takes what is there and ends, as for a manual refresh; else it goes on at that interval.
    """

    def insert(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("event_date", F.to_date(time))
        if folders.exists(spark, path):
            days = [r.event_date for r in new.select("event_date").distinct().collect()]  # the days of one trigger
            held = spark.read.schema(new.schema).parquet(path)
            held = held.where(F.col("event_date").isin(days) | (F.lit(None in days) & F.col("event_date").isNull()))
            new = new.join(held.select(key), key, "left_anti")
        # dealt by key first, so that rows are ordered once for the drop
        new.repartition(key).dropDuplicates([key]).write.mode("append").partitionBy("event_date").parquet(path)

    writer = stream.writeStream.foreachBatch(insert).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def run_once(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and give what it wrote; in update mode with the number of each trigger."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("trigger", F.lit(number)).write.mode("append").parquet(f"{path}/out")

    spark = stream.sparkSession
    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{path}/out")

