"""Streams run over all that the tables hold, compared with the same work as a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from vigil.sources import logs
from vigil.sources.events import shared_folder, stream_files
from vigil.streaming import pairs, rollups, streams

from . import binding
from .binding import DNS_SQL, FEED_SQL
from .queries_semantic import OBSERVABLES, OBSERVABLES_SQL
from .queries_sources import SPECS
from .queries_threat import OBS
from .registry import query

#: Parts of the arriving files that triggers are counted in; rows of a file, about.
FILES, FILE_ROWS = 4, 500_000


def _files(events: DataFrame, parts: int) -> int:
    """As many files as rows need, a multiple of ``parts``: so that tasks stay small, and triggers as many."""
    return parts * max(1, -(-events.count() // (FILE_ROWS * parts)))


def dns_stream(spark: SparkSession, sf_dir: str, files_each: int | None = None) -> DataFrame:
    """The DNS events as a stream of files, written to the shared folder first; a trigger takes ``files_each`` of FILES parts."""
    folder = shared_folder(spark, "arriving")
    events = binding.dns(spark, sf_dir).withColumn("time", F.col("time").cast("timestamp"))
    n = _files(events, FILES)
    events.repartition(n, "metadata_uid").write.parquet(folder)
    options = {"maxFilesPerTrigger": str(files_each * n // FILES)} if files_each else {}
    return stream_files(spark, folder, events.schema, **options)


def _ntz(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


LOG_SQL = f"{DNS_SQL} SELECT query_type, count(*) AS n, count(DISTINCT metadata_uid) AS n_uids, sum(k)::BIGINT AS total FROM dns GROUP BY 1"


def _read_log(spark: SparkSession, folder: str, path: str, stop_after: int | None = None) -> None:
    """Stream a log to ``path``, up to its end or so many triggers; each trigger has a folder of its own."""
    given: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        if stop_after is None or len(given) < stop_after:
            batch.write.mode("overwrite").parquet(f"{path}/out/trigger={number}")
            given.append(number)
        else:
            raise InterruptedError("stopped in mid-stream")

    log = logs.stream_log(spark, folder, "reader", LOG_RECORDS)
    running = log.writeStream.foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(processingTime="0 seconds").start()
    try:
        running.processAllAvailable()
    except StreamingQueryException as e:
        if stop_after is None or "stopped in mid-stream" not in str(e):
            raise
    finally:
        running.stop()


#: Partitions of a log, and records of each that a trigger takes.
LOG_PARTITIONS, LOG_RECORDS = 3, 100_000


def _logged(spark: SparkSession, sf_dir: str) -> str:
    """The DNS events as a log that two appends made."""
    folder = shared_folder(spark, "log")
    events = binding.dns(spark, sf_dir)
    body = F.to_json(F.struct("metadata_uid", "query_type", "k"))
    for half in range(2):
        logs.append(events.where(F.col("k") % 2 == half).select(F.col("source_ip").alias("key"), body.alias("value")), folder, LOG_PARTITIONS)
    return folder


def _counted(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(f"{path}/out").select(F.from_json("value", "metadata_uid string, query_type string, k int").alias("v")).select("v.*")
    return rows.groupBy("query_type").agg(F.count("*").alias("n"), F.count_distinct("metadata_uid").alias("n_uids"), F.sum("k").alias("total"))


@query("scan_kafka", LOG_SQL)
def scan_kafka(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The continuous source: a log of partitions and offsets. ``stream_events`` does the same over Kafka, whose connector isn't
    installed here."""
    path = shared_folder(spark, "scanned")
    _read_log(spark, _logged(spark, sf_dir), path)
    return _counted(spark, path)


@query("scan_log_restarted", LOG_SQL)
def scan_log_restarted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query that breaks off after its first trigger and starts again loses and repeats nothing."""
    path, folder = shared_folder(spark, "scanned"), _logged(spark, sf_dir)
    _read_log(spark, folder, path, 1)
    _read_log(spark, folder, path)
    return _counted(spark, path)


@query("stream_mapping", f"{DNS_SQL} SELECT upper(query_hostname) AS hostname, source_ip AS ip, metadata_uid AS uid, CAST(trunc(duration) AS INTEGER) AS duration, 4003 AS class_uid, 4 AS category_uid FROM dns")
def stream_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = streams.run_once(streams.stream_mapping(dns_stream(spark, sf_dir, 1), SPECS, 4003, 4), shared_folder(spark, "mapped"))
    return found.select("query.hostname", "src_endpoint.ip", "metadata.uid", "duration", "class_uid", "category_uid")


@query("stream_extract_observables", f"{DNS_SQL}, {OBSERVABLES_SQL} SELECT {OBS} FROM obs")
def stream_extract_observables(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = streams.run_once(streams.stream_extract_observables(dns_stream(spark, sf_dir, 1), OBSERVABLES), shared_folder(spark, "extracted"))
    return _ntz(found.drop("trigger"), "event_time")


@query("stream_metric_tumbling", f"{DNS_SQL} SELECT date_trunc('hour', time)::TIMESTAMP AS time_bucket, query_type, count(*) AS n, min(duration) AS lowest FROM dns GROUP BY 1, 2")
def stream_metric_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    metric = streams.stream_metric(dns_stream(spark, sf_dir, 1), {"n": F.count("*"), "lowest": F.min("duration")}, "hour", "60 days", ["query_type"])
    updates = streams.run_once(metric, shared_folder(spark, "metric"), "update")
    last = updates.groupBy("time_bucket", "query_type").agg(F.max_by(F.struct("n", "lowest"), "trigger").alias("m"))
    return _ntz(last.select("time_bucket", "query_type", "m.*"), "time_bucket")


@query("stream_ioc_match", f"{DNS_SQL}, {FEED_SQL} SELECT metadata_uid, query_hostname, indicator, threat_type, confidence FROM dns JOIN feed ON query_hostname = indicator OR query_hostname LIKE '%.' || indicator WHERE indicator_type = 'domain'")
def stream_ioc_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = streams.run_once(streams.stream_ioc_match(dns_stream(spark, sf_dir, 1), binding.feed(spark)), shared_folder(spark, "matched"))
    return found.select("metadata_uid", "query_hostname", "indicator", "threat_type", "confidence")


for _unit in ("week", "month"):

    def _tumbling(spark: SparkSession, sf_dir: str, unit: str = _unit) -> DataFrame:
        metric = streams.stream_metric(dns_stream(spark, sf_dir, 1), {"n": F.count("*")}, unit, "60 days", ["query_type"])
        updates = streams.run_once(metric, shared_folder(spark, "metric"), "update")
        return _ntz(updates.groupBy("time_bucket", "query_type").agg(F.max_by("n", "trigger").alias("n")), "time_bucket")

    query(f"stream_metric_{_unit}", f"{DNS_SQL} SELECT date_trunc('{_unit}', time)::TIMESTAMP AS time_bucket, query_type, count(*) AS n FROM dns GROUP BY 1, 2")(_tumbling)


BEACON_SQL = f"{DNS_SQL}, g AS (SELECT source_ip, query_hostname, time, date_diff('second', lag(time) OVER (PARTITION BY source_ip, query_hostname ORDER BY time), time) AS gap FROM dns) SELECT source_ip, query_hostname, count(*) AS beacon_count, round(avg(gap), 4) AS avg_interval, round(stddev_samp(gap), 4) AS interval_stddev, max(time) AS last_seen FROM g WHERE gap IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 10 AND stddev_samp(gap) < avg(gap)"


@query("stream_beaconing", BEACON_SQL)
def stream_beaconing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files come in no order of time, one a trigger, so most rows are late."""
    path = shared_folder(spark, "beacons")
    streams.stream_beaconing(dns_stream(spark, sf_dir, 1), f"{path}/table", f"{path}/state").awaitTermination()
    found = streams.beacons(spark, f"{path}/table", 10, 1.0)
    return _ntz(found.withColumns({c: F.round(c, 4) for c in ("avg_interval", "interval_stddev")}), "last_seen")


@query("stream_beaconing_state", BEACON_SQL)
def stream_beaconing_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from keyed state, read back from the checkpoint; the delay lets all rows in."""
    streams.use_keyed_state(spark)
    path = shared_folder(spark, "pairs")
    streams.run_once(pairs.stream_pair_gaps(dns_stream(spark, sf_dir, 1), "60 days"), path, "update")
    found = pairs.beacons_of_state(spark, f"{path}/state", 10, 1.0)
    return _ntz(found.withColumns({c: F.round(c, 4) for c in ("avg_interval", "interval_stddev")}), "last_seen")


def _odd_times(events: DataFrame) -> DataFrame:
    """Some events without a time, some without a host."""
    return events.withColumns({"time": F.when(F.col("k") % 11 != 5, F.col("time")), "query_hostname": F.when(F.col("k") % 13 != 6, F.col("query_hostname"))})


FIRST_SQL = f"{DNS_SQL} SELECT CASE WHEN k % 13 <> 6 THEN query_hostname END AS key, min(time) AS first_seen FROM dns WHERE k % 11 <> 5 GROUP BY 1"


def _last(updates: DataFrame) -> DataFrame:
    return _ntz(updates.groupBy("key").agg(F.max_by("first_seen", "trigger").alias("first_seen")), "first_seen")


@query("stream_first_seen", FIRST_SQL)
def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _last(streams.run_once(streams.stream_first_seen(_odd_times(dns_stream(spark, sf_dir, 1)), "query_hostname"), shared_folder(spark, "first"), "update"))


@query("stream_dedupe", f"{DNS_SQL} SELECT DISTINCT metadata_uid FROM dns")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    twice = dns_stream(spark, sf_dir, 2).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return streams.run_once(streams.stream_dedupe(twice, "metadata_uid", "60 days"), shared_folder(spark, "deduped")).select("metadata_uid")


@query("stream_refresh_rollup", f"{DNS_SQL}, {OBSERVABLES_SQL} SELECT type_id, count(*) AS n, count(DISTINCT observable_id) AS n_ids FROM obs GROUP BY 1")
def stream_refresh_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "refreshed")
    for turn in range(2):  # a second refresh brings the same events again and adds nothing
        observables = streams.stream_extract_observables(dns_stream(spark, sf_dir, 2), OBSERVABLES)
        streams.stream_refresh(observables, f"{path}/table", f"{path}/state-{turn}").awaitTermination()
    return spark.read.parquet(f"{path}/table").groupBy("type_id").agg(F.count("*").alias("n"), F.count_distinct("observable_id").alias("n_ids"))


ROLLUP = rollups.Rollup(("source_ip", "query_type", "action"), {"total_k": "CAST(k AS LONG)", "severity": "CAST(severity_id AS LONG)"})


@query("stream_hot_rollup", f"{DNS_SQL} SELECT source_ip, query_type, action, count(*) AS event_count, sum(k)::BIGINT AS total_k, sum(severity_id)::BIGINT AS severity FROM dns WHERE k % 7 <> 3 GROUP BY ALL")
def stream_hot_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The roll-up of events that come in no order, twice, and are partly taken back, some before they came; a second refresh
    brings further events."""
    path, folder = shared_folder(spark, "rollup"), shared_folder(spark, "arriving")
    events = binding.dns(spark, sf_dir).withColumn("time", F.col("time").cast("timestamp"))
    n = 2 * _files(events, 3)  # a refresh brings at most three rows of an event
    coming = events.select("*", F.posexplode(F.expr("CASE WHEN k % 7 = 3 THEN array(1, 1, -1) ELSE array(1, 1) END")).alias("copy", "sign"))
    coming = coming.withColumn("uid", F.concat_ws("/", "metadata_uid", "sign"))
    for part in ("k % 3 = 0", "k % 3 <> 0"):
        # dealt by copy too, so that copies come in different triggers
        coming.where(part).repartition(n, "uid", "copy").drop("copy").write.mode("append").parquet(folder)
        arriving = stream_files(spark, folder, spark.read.parquet(folder).schema, maxFilesPerTrigger=str(n // 3))
        # what the roll-up doesn't take needn't go through the state
        taken = arriving.select("uid", "time", "sign", *ROLLUP.keys, "k", "severity_id")
        once = streams.stream_dedupe(taken, "uid", "60 days")
        rollups.stream_rollup(once, ROLLUP, f"{path}/runs", f"{path}/state", "sign").awaitTermination()
    return rollups.read_rollup(spark, f"{path}/runs", ROLLUP)
