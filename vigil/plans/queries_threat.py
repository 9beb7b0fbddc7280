"""Queries of indicators, threat feeds, hunting and computed fields, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions import computed
from vigil.operators import hunting, observables, threat, validity

from . import binding
from .binding import AS_OF_SQL, DNS_SQL, FEED_SQL
from .queries_semantic import OBSERVABLES_SQL
from .queries_semantic import observables as observable_table
from .registry import query
from .semantic import timestamp

OBS = "observable_id, type_id, type_name, value, event_uid, event_class_uid, event_time, attribute_path"


@query("extract_observables", f"{DNS_SQL}, {OBSERVABLES_SQL} SELECT {OBS} FROM obs")
def extract_observables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observable_table(spark, sf_dir)


def with_array(events: DataFrame) -> DataFrame:
    """Events with an embedded indicator array of two places."""
    item = lambda name, kind, type_id, c: F.struct(F.lit(name).alias("name"), F.lit(kind).alias("type"), F.lit(type_id).alias("type_id"), F.col(c).alias("value"))
    return events.withColumn("observables", F.array(item("query.hostname", "Hostname", 1, "query_hostname"), item("answers[0].rdata", "IP Address", 2, "answers_rdata")))


@query("explode_observables", f"{DNS_SQL} SELECT metadata_uid, class_uid, time, 0 AS position, 1 AS type_id, 'Hostname' AS type_name, 'query.hostname' AS attribute_path, query_hostname AS value FROM dns UNION ALL SELECT metadata_uid, class_uid, time, 1, 2, 'IP Address', 'answers[0].rdata', answers_rdata FROM dns WHERE answers_rdata IS NOT NULL")
def explode_observables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observables.explode_observables(with_array(binding.dns(spark, sf_dir)))


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = {"src_endpoint.ip": "source_ip", "query.hostname": "query_hostname", "answers[0].rdata": "answers_rdata", "cloud.region": "cloud_region", "duration": "duration"}
    return binding.dns(spark, sf_dir).select(F.col("metadata_uid").alias("record"), "class_uid", F.explode(F.array(*(F.struct(F.lit(p).alias("path"), F.col(c).cast("string").alias("value"), F.lit("number" if p == "duration" else "string").alias("type")) for p, c in pairs.items()))).alias("f")).select("record", "class_uid", "f.*").where(F.col("value").isNotNull())


FIELDS_SQL = "fields AS (SELECT metadata_uid AS record, class_uid, path, value, type FROM (" + " UNION ALL ".join(f"SELECT metadata_uid, class_uid, '{p}' AS path, CAST({c} AS VARCHAR) AS value, '{t}' AS type FROM dns" for p, c, t in (("src_endpoint.ip", "source_ip", "string"), ("query.hostname", "query_hostname", "string"), ("answers[0].rdata", "answers_rdata", "string"), ("cloud.region", "cloud_region", "string"))) + ") f WHERE value IS NOT NULL)"


@query("extract_observables_arrays", f"{DNS_SQL}, a AS (SELECT metadata_uid, class_uid, time, query_hostname, unnest([answers_rdata, source_ip, NULL]) AS v, unnest([0, 1, 2]) AS i FROM dns) SELECT metadata_uid || '_answers[' || i || '].rdata' AS observable_id, 2 AS type_id, 'IP Address' AS type_name, v AS value, metadata_uid AS event_uid, class_uid AS event_class_uid, time AS event_time, 'answers[' || i || '].rdata' AS attribute_path FROM a WHERE v IS NOT NULL UNION ALL SELECT metadata_uid || '_src_endpoint.ip', 2, 'IP Address', source_ip, metadata_uid, class_uid, time, 'src_endpoint.ip' FROM dns")
def extract_observables_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values in an array of structs, values in a struct, and paths that the events don't have."""
    answer = lambda c: F.struct(c.alias("rdata"))
    events = binding.dns(spark, sf_dir).select("metadata_uid", "class_uid", "time", F.array(answer(F.col("answers_rdata")), answer(F.col("source_ip")), answer(F.lit(None).cast("string"))).alias("answers"), F.struct(F.col("source_ip").alias("ip")).alias("src_endpoint"))
    return observables.extract_observables(events, {2: ("IP Address", ("answers.rdata", "src_endpoint.ip", "device.ip", "src_endpoint.port"))})


@query("extract_observables_by_dictionary", f"{DNS_SQL}, {FIELDS_SQL} SELECT record, class_uid, path, value, CASE path WHEN 'src_endpoint.ip' THEN 2 WHEN 'query.hostname' THEN 1 END AS type_id FROM fields WHERE path IN ('src_endpoint.ip', 'query.hostname') UNION ALL SELECT record, class_uid, path, value, 2 FROM fields WHERE path = 'answers[0].rdata'")
def extract_observables_by_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = [("attribute", "ip", None, 2), ("object", "query", None, 1), ("path", "answers[0].rdata", 4003, 2), ("path", "cloud.region", 3002, 99), ("class", "3002", None, 98), ("object", "cloud", 3002, 97)]
    return observables.extract_from_dictionary(_fields(spark, sf_dir), spark.createDataFrame(entries, "kind string, key string, class_uid int, type_id int"))


@query("flag_observables", f"{DNS_SQL}, {FIELDS_SQL} SELECT record, path, value, CASE WHEN path = 'query.hostname' THEN 'hostname' ELSE 'ip' END AS observable_type, CASE WHEN path = 'answers[0].rdata' THEN 'Medium' ELSE 'High' END AS confidence, CASE WHEN path = 'answers[0].rdata' THEN 'value' ELSE 'both' END AS matched_by FROM fields WHERE path IN ('src_endpoint.ip', 'query.hostname', 'answers[0].rdata')")
def flag_observables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observables.flag_observables(_fields(spark, sf_dir)).drop("class_uid", "type")


@query("scan_text_observables")
def scan_text_observables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observables.scan_text_observables(binding.table(spark, sf_dir, "documents"), "doc_id", "text")


@query("scan_text_emails", r"SELECT DISTINCT doc_id, 'email' AS observable_type, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')) AS value FROM documents")
def scan_text_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_text_observables(spark, sf_dir).where(F.col("observable_type") == "email")


EVENT = "metadata_uid, time, source_ip, query_hostname, action"


@query("reverse_lookup", f"{DNS_SQL}, {OBSERVABLES_SQL} SELECT {EVENT} FROM dns WHERE metadata_uid IN (SELECT event_uid FROM obs WHERE value = '10.0.0.3')")
def reverse_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observables.reverse_lookup(observable_table(spark, sf_dir).where(F.col("value") == "10.0.0.3"), binding.dns(spark, sf_dir)).select(*EVENT.split(", "))


@query("reverse_lookup_filtered", f"{DNS_SQL}, {OBSERVABLES_SQL} SELECT {EVENT} FROM dns WHERE metadata_uid IN (SELECT event_uid FROM obs WHERE value = '10.0.0.3') AND time BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-12'")
def reverse_lookup_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches = observable_table(spark, sf_dir).where(F.col("value") == "10.0.0.3")
    return observables.reverse_lookup(matches, binding.dns(spark, sf_dir), (timestamp("2024-01-02"), timestamp("2024-01-12")), filtered=True).select(*EVENT.split(", "))


@query("reverse_lookup_batch", f"{DNS_SQL}, {OBSERVABLES_SQL} SELECT {EVENT} FROM dns WHERE metadata_uid IN (SELECT event_uid FROM obs WHERE type_id IN (1, 2) AND value IN ('10.0.0.3', 'h1.view.example.com') AND event_time >= TIMESTAMP '2024-01-05') ORDER BY time DESC, metadata_uid LIMIT 300")
def reverse_lookup_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = observables.ObservableFilter((1, 2), ("10.0.0.3", "h1.view.example.com"), timestamp("2024-01-05"), None, 300)
    return observables.lookup_events(observable_table(spark, sf_dir), binding.dns(spark, sf_dir), wanted).select(*EVENT.split(", "))


@query("ioc_hot_match", f"{DNS_SQL}, {OBSERVABLES_SQL}, {FEED_SQL} SELECT observable_id, value, threat_type, confidence, source, query_hostname, action FROM obs JOIN feed ON value = indicator JOIN dns ON event_uid = metadata_uid")
def ioc_hot_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threat.ioc_hot_match(observable_table(spark, sf_dir), binding.feed(spark), binding.dns(spark, sf_dir)).select("observable_id", "value", "threat_type", "confidence", "source", "query_hostname", "action")


@query("ioc_domain_lookup", f"{DNS_SQL}, {FEED_SQL} SELECT metadata_uid, query_hostname, indicator, threat_type, confidence FROM dns LEFT JOIN feed ON indicator_type = 'domain' AND (query_hostname = indicator OR query_hostname LIKE '%.' || indicator)")
def ioc_domain_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threat.ioc_lookup(binding.dns(spark, sf_dir), binding.feed(spark), "domain", ["query_hostname"]).select("metadata_uid", "query_hostname", "indicator", "threat_type", "confidence")


@query("ioc_ip_lookup", f"{DNS_SQL}, {FEED_SQL} SELECT metadata_uid, source_ip, answers_rdata, indicator, threat_type FROM dns LEFT JOIN feed ON indicator_type = 'ip' AND (source_ip = indicator OR answers_rdata = indicator)")
def ioc_ip_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threat.ioc_lookup(binding.dns(spark, sf_dir), binding.feed(spark), "ip", ["source_ip", "answers_rdata"]).select("metadata_uid", "source_ip", "answers_rdata", "indicator", "threat_type")


@query("ioc_cross", f"{DNS_SQL}, {FEED_SQL} SELECT metadata_uid, indicator FROM dns CROSS JOIN feed")
def ioc_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threat.ioc_lookup(binding.dns(spark, sf_dir), binding.feed(spark), None).select("metadata_uid", "indicator")


#: A feed from the events: hosts that are listed for some days again and again, a domain without bounds, clients by weeks.
VALID_FEED = {
    "h": "SELECT query_hostname AS indicator, 'domain' AS indicator_type, 'seen' AS threat_type, min(time) AS first_seen, min(time) + INTERVAL 30 HOUR AS last_seen FROM dns WHERE k % 7 = 1 GROUP BY query_hostname, source_ip",
    "d": "SELECT DISTINCT event_type || '.example.com', 'domain', 'always', CAST(NULL AS {t}), CAST(NULL AS {t}) FROM events WHERE event_type = 'error'",
    "c": "SELECT source_ip, 'ip', 'client', max(time) - INTERVAL 50 HOUR, CAST(NULL AS {t}) FROM dns WHERE k % 5 = 2 GROUP BY source_ip",
}


def _valid_feed_sql(kind: str) -> str:
    return " UNION ALL ".join(VALID_FEED.values()).format(t=kind)


VALID_SQL = f"{DNS_SQL}, feed AS ({_valid_feed_sql('TIMESTAMP')})"


def _valid_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    dns, events = binding.dns(spark, sf_dir), binding.table(spark, sf_dir, "events")
    return spark.sql(_valid_feed_sql("TIMESTAMP_NTZ").replace("FROM dns", "FROM {dns}").replace("FROM events", "FROM {events}"), dns=dns, events=events)


@query("ioc_valid_domains", f"{VALID_SQL} SELECT metadata_uid, query_hostname, indicator, threat_type, first_seen FROM dns LEFT JOIN feed ON indicator_type = 'domain' AND (query_hostname = indicator OR query_hostname LIKE '%.' || indicator) AND (first_seen IS NULL OR time >= first_seen) AND (last_seen IS NULL OR time <= last_seen)")
def ioc_valid_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the listings that were valid at their time."""
    found = validity.valid_lookup(binding.dns(spark, sf_dir), _valid_feed(spark, sf_dir), "domain", ["query_hostname"])
    return found.select("metadata_uid", "query_hostname", "indicator", "threat_type", "first_seen")


@query("ioc_valid_addresses", f"{VALID_SQL} SELECT DISTINCT source_ip, answers_rdata, time, indicator, last_seen FROM dns JOIN feed ON indicator_type = 'ip' AND (source_ip = indicator OR answers_rdata = indicator) AND (first_seen IS NULL OR time >= first_seen) AND (last_seen IS NULL OR time <= last_seen)")
def ioc_valid_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = validity.valid_matches(binding.dns(spark, sf_dir), _valid_feed(spark, sf_dir), "ip", ["source_ip", "answers_rdata"])
    return found.select("source_ip", "answers_rdata", "time", "indicator", "last_seen")


COVERS = [("dns_event", 1, False), ("auth_event", 2, True), ("dns_event", 2, False)]
COVERAGE_SQL = f"{DNS_SQL}, {OBSERVABLES_SQL}, types AS (SELECT DISTINCT type_id, type_name FROM obs UNION SELECT DISTINCT 30, 'Event Kind' FROM events WHERE event_type = 'view'), covers AS (SELECT * FROM (VALUES ('dns_event', 1, false), ('auth_event', 2, true), ('dns_event', 2, false)) c(entity, type_id, partial)), cov AS (SELECT t.type_id, type_name, coalesce(list_sort(list(entity) FILTER (WHERE entity IS NOT NULL)), []) AS entities, count(entity) AS n_entities, max(CASE WHEN entity IS NULL THEN 0.0 WHEN partial THEN 0.5 ELSE 1.0 END)::DOUBLE AS covered FROM types t LEFT JOIN covers c ON t.type_id = c.type_id GROUP BY 1, 2)"


def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = observable_table(spark, sf_dir).select("type_id", "type_name")
    kinds = binding.table(spark, sf_dir, "events").where("event_type = 'view'").select(F.lit(30).alias("type_id"), F.lit("Event Kind").alias("type_name"))
    return observables.observable_coverage(seen.unionByName(kinds), spark.createDataFrame(COVERS, "entity string, type_id int, partial boolean"))


@query("observable_coverage", f"{COVERAGE_SQL} SELECT type_id, type_name, entities, n_entities, covered, n_entities = 0 AS is_gap, CASE WHEN n_entities = 0 THEN lower(regexp_replace(type_name, '\\W+', '_', 'g')) || '_entity' END AS suggested_entity FROM cov")
def observable_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coverage(spark, sf_dir)


@query("observable_coverage_percent", f"{COVERAGE_SQL} SELECT count(*) FILTER (WHERE covered > 0) AS n_covered, count(*) FILTER (WHERE covered = 0) AS n_gaps, round(100 * avg(covered), 2) AS percent FROM cov")
def observable_coverage_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observables.coverage_percent(_coverage(spark, sf_dir))


@query("observable_compat", f"{COVERAGE_SQL} SELECT type_id, type_name, CASE WHEN n_entities = 0 THEN 'gap' ELSE 'redundant' END AS problem, entities FROM cov WHERE n_entities <> 1")
def observable_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observables.observable_gaps(_coverage(spark, sf_dir))


def _since(hours: int) -> str:
    return f"time >= {AS_OF_SQL} - INTERVAL {hours} HOUR"


def _hunt(name: str, f, sql: str, needs_feed: bool = False, **parameters) -> None:
    def go(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = [binding.dns(spark, sf_dir)] + ([binding.feed(spark)] if needs_feed else [])
        return f(*tables, binding.as_of(spark, sf_dir), **parameters)

    query(name, sql)(go)


_hunt("dns_tunneling_high_volume", hunting.dns_tunneling_high_volume, f"{DNS_SQL} SELECT source_ip, count(*) AS query_count, count(DISTINCT query_hostname) AS unique_domains, avg(length(query_hostname)) AS avg_query_length FROM dns WHERE {_since(720)} GROUP BY 1 HAVING count(*) > 100 ORDER BY 2 DESC, 1 LIMIT 100", hours=720, threshold=100)
_hunt("dns_tunneling_long_queries", hunting.dns_tunneling_long_queries, f"{DNS_SQL} SELECT source_ip, query_hostname, length(query_hostname)::INT AS query_length, time FROM dns WHERE length(query_hostname) > 50 AND {_since(720)} ORDER BY length(query_hostname) DESC, time, metadata_uid LIMIT 100", hours=720)
_hunt("dns_txt_record_abuse", hunting.dns_txt_record_abuse, f"{DNS_SQL} SELECT source_ip, query_hostname, count(*) AS txt_query_count, min(time) AS first_seen, max(time) AS last_seen FROM dns WHERE query_type = 'TXT' AND {_since(720)} GROUP BY 1, 2 HAVING count(*) > 10", hours=720)
_hunt("dga_nxdomain_spike", hunting.dga_nxdomain_spike, f"{DNS_SQL}, s AS (SELECT source_ip, count(*) AS total_queries, count(*) FILTER (WHERE response_code = 'NXDOMAIN') AS nxdomain_count FROM dns WHERE {_since(720)} GROUP BY 1) SELECT *, round(100.0::DOUBLE * nxdomain_count / total_queries, 2) AS nxdomain_rate FROM s WHERE round(100.0::DOUBLE * nxdomain_count / total_queries, 2) > 19 AND total_queries > 100", hours=720, nxdomain_threshold=19.0)
_hunt("dga_random_domains", hunting.dga_random_domains, f"{DNS_SQL}, s AS (SELECT query_hostname, source_ip, count(*) AS query_count, length(query_hostname)::INT AS domain_length, length(regexp_replace(query_hostname, '[^0-9]', '', 'g'))::INT AS numeric_chars, length(regexp_replace(query_hostname, '[^a-z]', '', 'g'))::INT AS alpha_chars FROM dns WHERE {_since(720)} AND length(query_hostname) > 10 GROUP BY 1, 2) SELECT *, round(100.0::DOUBLE * numeric_chars / domain_length, 2) AS numeric_ratio FROM s WHERE numeric_chars > domain_length * 0.3 OR domain_length > 40 ORDER BY query_count DESC, query_hostname, source_ip LIMIT 100", hours=720)
_hunt("fast_flux_detection", hunting.fast_flux_detection, f"{DNS_SQL} SELECT query_hostname, count(DISTINCT answers_rdata) AS unique_ips, count(*) AS query_count, list_sort(list(DISTINCT answers_rdata)) AS ip_addresses FROM dns WHERE {_since(720)} AND answers_rdata IS NOT NULL GROUP BY 1 HAVING count(DISTINCT answers_rdata) > 10 ORDER BY 2 DESC, 1 LIMIT 50", hours=720)
_hunt("c2_beaconing_regular_intervals", hunting.c2_beaconing, f"{DNS_SQL}, g AS (SELECT source_ip, query_hostname, time, date_diff('second', lag(time) OVER (PARTITION BY source_ip, query_hostname ORDER BY time), time) AS gap FROM dns WHERE {_since(720)}) SELECT source_ip, query_hostname, count(*) AS beacon_count, avg(gap) AS avg_interval, stddev_samp(gap) AS interval_stddev, min(time) AS first_seen, max(time) AS last_seen FROM g WHERE gap IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 10 AND stddev_samp(gap) < avg(gap) * 1.0", hours=720, jitter_threshold=1.0)
_hunt("ioc_domain_match", hunting.ioc_domain_match, f"{DNS_SQL}, {FEED_SQL} SELECT source_ip, query_hostname, time, action, threat_type, confidence, source AS intel_source FROM dns JOIN feed ON query_hostname = indicator OR query_hostname LIKE '%.' || indicator WHERE {_since(720)} AND indicator_type = 'domain' ORDER BY time DESC, metadata_uid, threat_type LIMIT 1000", needs_feed=True, hours=720)
_hunt("blocked_dns_by_host", hunting.blocked_dns_by_host, f"{DNS_SQL} SELECT source_ip, count(*) AS total_queries, count(*) FILTER (WHERE action = 'Blocked') AS blocked_count, round(100.0::DOUBLE * count(*) FILTER (WHERE action = 'Blocked') / count(*), 2) AS blocked_rate, list_sort(list(DISTINCT query_hostname) FILTER (WHERE action = 'Blocked')) AS blocked_domains FROM dns WHERE {_since(720)} GROUP BY 1 HAVING count(*) FILTER (WHERE action = 'Blocked') > 10 ORDER BY 3 DESC, 1 LIMIT 100", hours=720)
_hunt("top_queried_domains", hunting.top_queried_domains, f"{DNS_SQL} SELECT query_hostname, count(*) AS query_count, count(DISTINCT source_ip) AS unique_clients, min(time) AS first_seen, max(time) AS last_seen FROM dns WHERE {_since(720)} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100", hours=720)
_hunt("dns_by_region", hunting.dns_by_region, f"{DNS_SQL} SELECT cloud_region, count(*) AS query_count, count(DISTINCT source_ip) AS unique_clients, count(DISTINCT query_hostname) AS unique_domains FROM dns WHERE {_since(240)} GROUP BY 1", hours=240)
_hunt("new_domains_first_seen", hunting.new_domains_first_seen, f"{DNS_SQL}, h AS (SELECT query_hostname, min(time) AS first_seen, count(*) AS total_queries FROM dns GROUP BY 1) SELECT * FROM h WHERE first_seen >= {AS_OF_SQL} - INTERVAL 72 HOUR ORDER BY first_seen DESC, query_hostname LIMIT 100", hours=72)


def _computed(name: str, column, sql: str | None) -> None:
    query(name, sql and f"{DNS_SQL} SELECT metadata_uid, {sql} AS {name} FROM dns")(lambda spark, sf_dir: binding.dns(spark, sf_dir).select("metadata_uid", column("query_hostname").alias(name)))


_computed("vowel_count", computed.vowel_count, "(length(query_hostname) - length(regexp_replace(lower(query_hostname), '[aeiou]', '', 'g')))::INT")
_computed("shannon_entropy", computed.shannon_entropy, "(SELECT -sum(p * log2(p)) FROM (SELECT count(*) / length(query_hostname) AS p FROM (SELECT unnest(string_split(query_hostname, '')) AS ch) GROUP BY ch))")
_computed("subdomain_depth", computed.subdomain_depth, "(length(query_hostname) - length(replace(query_hostname, '.', '')) - 1)::INT")
_computed("query_length", computed.query_length, "length(query_hostname)::INT")
_computed("is_numeric_heavy", computed.is_numeric_heavy, "CASE WHEN length(regexp_replace(query_hostname, '[^0-9]', '', 'g')) / nullif(length(query_hostname), 0) > 0.4 THEN true ELSE false END")
