"""Ready-made hunting queries over DNS events. Times count back from ``as_of``."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.plans.semantic import timestamp

from .threat import ioc_match

#: The technique that each detection answers to.
TECHNIQUES = {"dns_tunneling_high_volume": "T1071.004", "dns_tunneling_long_queries": "T1048.003", "dns_txt_record_abuse": "T1071.004", "dga_nxdomain_spike": "T1568.002", "dga_random_domains": "T1568.002", "fast_flux_detection": "T1568.001", "c2_beaconing_regular_intervals": "T1071.004"}


def recent(events: DataFrame, as_of: datetime, hours: int) -> DataFrame:
    """Events since so many hours; of a table that is written by day only these days' folders are opened."""
    start = as_of - timedelta(hours=hours)
    found = events.where(F.col("time") >= timestamp(start))
    return found.where(F.col("event_date") >= F.lit(start.date())) if "event_date" in events.columns else found


def _count_of(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def dns_tunneling_high_volume(events: DataFrame, as_of: datetime, hours: int = 24, threshold: int = 10_000, limit: int = 100) -> DataFrame:
    found = recent(events, as_of, hours).groupBy("source_ip").agg(F.count("*").alias("query_count"), F.count_distinct("query_hostname").alias("unique_domains"), F.avg(F.length("query_hostname")).alias("avg_query_length"))
    return found.where(F.col("query_count") > threshold).orderBy(F.desc("query_count"), "source_ip").limit(limit)


def dns_tunneling_long_queries(events: DataFrame, as_of: datetime, min_length: int = 50, hours: int = 24, limit: int = 100) -> DataFrame:
    found = recent(events, as_of, hours).withColumn("query_length", F.length("query_hostname")).where(F.col("query_length") > min_length)
    return found.orderBy(F.desc("query_length"), "time", "metadata_uid").limit(limit).select("source_ip", "query_hostname", "query_length", "time")


def dns_txt_record_abuse(events: DataFrame, as_of: datetime, hours: int = 24, threshold: int = 10) -> DataFrame:
    found = recent(events, as_of, hours).where(F.col("query_type") == "TXT").groupBy("source_ip", "query_hostname").agg(F.count("*").alias("txt_query_count"), F.min("time").alias("first_seen"), F.max("time").alias("last_seen"))
    return found.where(F.col("txt_query_count") > threshold).orderBy(F.desc("txt_query_count"), "source_ip", "query_hostname")


def dga_nxdomain_spike(events: DataFrame, as_of: datetime, hours: int = 24, nxdomain_threshold: float = 50.0, min_queries: int = 100) -> DataFrame:
    failed = _count_of(F.upper("response_code") == "NXDOMAIN")
    found = recent(events, as_of, hours).groupBy("source_ip").agg(F.count("*").alias("total_queries"), failed.alias("nxdomain_count"), F.round(100.0 * failed / F.count("*"), 2).alias("nxdomain_rate"))
    return found.where((F.col("nxdomain_rate") > nxdomain_threshold) & (F.col("total_queries") > min_queries)).orderBy(F.desc("nxdomain_count"), "source_ip")


def dga_random_domains(events: DataFrame, as_of: datetime, hours: int = 24, max_normal_length: int = 40, limit: int = 100) -> DataFrame:
    stats = recent(events, as_of, hours).where(F.length("query_hostname") > 10).groupBy("query_hostname", "source_ip").agg(F.count("*").alias("query_count"))
    stats = stats.withColumns({"domain_length": F.length("query_hostname"), "numeric_chars": F.length(F.regexp_replace("query_hostname", "[^0-9]", "")), "alpha_chars": F.length(F.regexp_replace("query_hostname", "[^a-z]", ""))})
    odd = (F.col("numeric_chars") > F.col("domain_length") * 0.3) | (F.col("domain_length") > max_normal_length)
    return stats.where(odd).withColumn("numeric_ratio", F.round(100.0 * F.col("numeric_chars") / F.col("domain_length"), 2)).orderBy(F.desc("query_count"), "query_hostname", "source_ip").limit(limit)


def fast_flux_detection(events: DataFrame, as_of: datetime, hours: int = 24, ip_threshold: int = 10, limit: int = 50) -> DataFrame:
    """One scan: (host, answer) pairs are counted, then each host's. The largest sets are those that are given, so no
    task holds more of a host than the result does."""
    pairs = recent(events, as_of, hours).where(F.col("answers_rdata").isNotNull()).groupBy("query_hostname", "answers_rdata").agg(F.count("*").alias("n"))
    found = pairs.groupBy("query_hostname").agg(F.count("*").alias("unique_ips"), F.sum("n").alias("query_count"), F.collect_list("answers_rdata").alias("ip_addresses"))
    found = found.where(F.col("unique_ips") > ip_threshold).orderBy(F.desc("unique_ips"), "query_hostname").limit(limit)
    return found.withColumn("ip_addresses", F.sort_array("ip_addresses"))


def seconds_between(start: Column | str, stop: Column | str) -> Column:
    """Second boundaries between two times."""
    return F.unix_timestamp(F.date_trunc("second", stop)) - F.unix_timestamp(F.date_trunc("second", start))


def c2_beaconing(events: DataFrame, as_of: datetime, hours: int = 24, min_beacons: int = 10, jitter_threshold: float = 0.2, chunk: str = "hour") -> DataFrame:
    """Gaps are taken within chunks of time, then between the chunks of a pair, so that no task orders all of a hot pair's events."""
    pair = ["source_ip", "query_hostname"]
    rows = recent(events, as_of, hours).select(*pair, "time", F.date_trunc(chunk, "time").alias("chunk"))
    inner = rows.withColumn("before", F.lag("time").over(Window.partitionBy(*pair, "chunk").orderBy("time")))
    ends = inner.groupBy(*pair, "chunk").agg(F.min("time").alias("time"), F.max("time").alias("last"))
    between = ends.withColumn("before", F.lag("last").over(Window.partitionBy(*pair).orderBy("chunk")))
    gaps = inner.select(*pair, "time", "before").unionByName(between.select(*pair, "time", "before")).where(F.col("before").isNotNull()).withColumn("gap", seconds_between("before", "time"))
    found = gaps.groupBy(*pair).agg(F.count("*").alias("beacon_count"), F.avg("gap").alias("avg_interval"), F.stddev_samp("gap").alias("interval_stddev"), F.min("time").alias("first_seen"), F.max("time").alias("last_seen"))
    return found.where((F.col("beacon_count") > min_beacons) & (F.col("interval_stddev") < F.col("avg_interval") * jitter_threshold)).orderBy(F.desc("beacon_count"), *pair)


def ioc_domain_match(events: DataFrame, feed: DataFrame, as_of: datetime, hours: int = 24, limit: int = 1000) -> DataFrame:
    found = ioc_match(recent(events, as_of, hours), feed, "domain", ["query_hostname"])
    found = found.select("metadata_uid", "source_ip", "query_hostname", "time", "action", "threat_type", "confidence", F.col("source").alias("intel_source"))
    return found.orderBy(F.desc("time"), "metadata_uid", "threat_type").limit(limit).drop("metadata_uid")


def blocked_dns_by_host(events: DataFrame, as_of: datetime, hours: int = 24, min_blocked: int = 10, limit: int = 100) -> DataFrame:
    """One scan: (client, host) pairs are counted first, clients and their blocked hosts from the pairs."""
    pairs = recent(events, as_of, hours).groupBy("source_ip", "query_hostname").agg(F.count("*").alias("n"), _count_of(F.col("action") == "Blocked").alias("blocked"))
    total, blocked = F.sum("n"), F.sum("blocked")
    found = pairs.groupBy("source_ip").agg(total.alias("total_queries"), blocked.alias("blocked_count"), F.round(100.0 * blocked / total, 2).alias("blocked_rate"), F.collect_list(F.when(F.col("blocked") > 0, F.col("query_hostname"))).alias("blocked_domains"))
    found = found.where(F.col("blocked_count") > min_blocked).orderBy(F.desc("blocked_count"), "source_ip").limit(limit)
    return found.withColumn("blocked_domains", F.sort_array("blocked_domains"))


def top_queried_domains(events: DataFrame, as_of: datetime, hours: int = 24, limit: int = 100) -> DataFrame:
    found = recent(events, as_of, hours).groupBy("query_hostname").agg(F.count("*").alias("query_count"), F.count_distinct("source_ip").alias("unique_clients"), F.min("time").alias("first_seen"), F.max("time").alias("last_seen"))
    return found.orderBy(F.desc("query_count"), "query_hostname").limit(limit)


def dns_by_region(events: DataFrame, as_of: datetime, hours: int = 24) -> DataFrame:
    found = recent(events, as_of, hours).groupBy("cloud_region").agg(F.count("*").alias("query_count"), F.count_distinct("source_ip").alias("unique_clients"), F.count_distinct("query_hostname").alias("unique_domains"))
    return found.orderBy(F.desc("query_count"), "cloud_region")


def new_domains_first_seen(events: DataFrame, as_of: datetime, hours: int = 24, limit: int = 100) -> DataFrame:
    """Hosts of all time, so that one seen long before isn't new; only then the window."""
    history = events.groupBy("query_hostname").agg(F.min("time").alias("first_seen"), F.count("*").alias("total_queries"))
    return history.where(F.col("first_seen") >= timestamp(as_of - timedelta(hours=hours))).orderBy(F.desc("first_seen"), "query_hostname").limit(limit)
