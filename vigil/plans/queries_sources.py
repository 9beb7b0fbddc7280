"""Queries of sources, parsing, mapping, views and sinks, with their SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.operators import mapping, parsing, partitions
from vigil.sources import events as source
from vigil.sources import csv_files, indexed

from . import binding
from .binding import DNS_SQL
from .model import Attribute, Entity
from .queries_semantic import OBSERVABLES_SQL
from .queries_semantic import observables as observable_table
from .registry import query
from .semantic import entity_view

#: Raw records of all formats, from events, in both dialects.
RAW = (
    "CASE event_id % 6"
    " WHEN 0 THEN '{\"user\": ' || CAST(user_id AS STRING) || ', \"type\": \"' || event_type || '\", \"n\": {\"k\": ' || CAST(k AS STRING) || ', \"w\": ' || CAST(k AS STRING) || '.5, \"o\": {\"p\": {\"q\": {\"r\": \"{[\"}}}}, \"tags\": [\"a\", null]}'"
    " WHEN 1 THEN CASE WHEN event_id % 12 = 1 THEN 'user,type,k' || chr(10) || CAST(user_id AS STRING) || ',' || event_type || ',' || CAST(k AS STRING) || chr(10) || CAST(user_id + 1 AS STRING) || ',,true'"
    " ELSE 'user,\"the, type\",k' || chr(10) || CAST(user_id AS STRING) || ',\"' || event_type || ', \"\"x\"\"\",' || CAST(k AS STRING) || chr(10) || chr(10) || CAST(user_id + 1 AS STRING) || ',\"plain, too\",1.5' END"
    " WHEN 2 THEN 'Jan ' || lpad(CAST(1 + k % 28 AS STRING), 2, ' ') || ' 0' || CAST(k % 10 AS STRING) || ':15:00 host' || CAST(user_id AS STRING) || ' sshd[' || CAST(event_id AS STRING) || ']: login user=' || CAST(user_id AS STRING) || ' action=\"' || event_type || ' it\"'"
    " WHEN 3 THEN '2024-01-01T00:00:00.5Z host' || CAST(user_id AS STRING) || ' cron: plain ' || event_type"
    " WHEN 4 THEN ' user=' || CAST(user_id AS STRING) || ' type=\"' || event_type || '\" k=' || CAST(k AS STRING) || ' ok=true note=''a b'' none=null '"
    " ELSE 'unrecognised ' || event_type END AS raw"
)
RAW_SQL = f"WITH raws AS (SELECT event_id AS record_id, {RAW} FROM (SELECT *, {binding.K} AS k FROM events) e)"


def raws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binding.table(spark, sf_dir, "events").withColumn("k", F.expr(binding.K)).selectExpr("event_id AS record_id", RAW)


@query("scan_files", "SELECT event_type, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY 1")
def scan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.read_events(spark, f"{sf_dir}/events.parquet").groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("detect_log_format", f"{RAW_SQL} SELECT record_id, CASE WHEN regexp_matches(trim(raw), '^[{{\\[]') AND json_valid(trim(raw)) THEN 'json' WHEN len(string_split(trim(raw), chr(10))) > 1 AND len(regexp_extract_all(string_split(trim(raw), chr(10))[1], ',')) > 0 AND len(regexp_extract_all(string_split(trim(raw), chr(10))[1], ',')) = len(regexp_extract_all(string_split(trim(raw), chr(10))[2], ',')) THEN 'csv' WHEN regexp_matches(trim(raw), '^[A-Z][a-z]{{2}}\\s+\\d{{1,2}}\\s+\\d{{2}}:\\d{{2}}:\\d{{2}}|^\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}:\\d{{2}}') THEN 'syslog' WHEN regexp_matches(raw, '\\w+=\\S+') THEN 'kv' ELSE 'json' END AS format FROM raws")
def detect_log_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raws(spark, sf_dir).select("record_id", parsing.detect_log_format("raw").alias("format"))


#: Leaves and arrays of the JSON records, in DuckDB.
TREE_SQL = RAW_SQL + ", tree AS (SELECT record_id, replace(t.fullkey, '$.', '') AS path, CASE t.type WHEN 'NULL' THEN 'null' WHEN 'ARRAY' THEN json_extract(raw, t.fullkey)::VARCHAR ELSE json_extract_string(raw, t.fullkey) END AS value, CASE t.type WHEN 'NULL' THEN 'null' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' ELSE 'number' END AS type FROM raws, json_tree(CASE WHEN json_valid(raw) THEN raw ELSE 'null' END) t WHERE json_valid(raw) AND t.type <> 'OBJECT')"
FORMAT_SQL = r"CASE WHEN regexp_matches(trim(raw), '^[{\[]') AND json_valid(trim(raw)) THEN 'json' WHEN len(string_split(trim(raw), chr(10))) > 1 AND len(regexp_extract_all(string_split(trim(raw), chr(10))[1], ',')) > 0 AND len(regexp_extract_all(string_split(trim(raw), chr(10))[1], ',')) = len(regexp_extract_all(string_split(trim(raw), chr(10))[2], ',')) THEN 'csv' WHEN regexp_matches(trim(raw), '^[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}|^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}') THEN 'syslog' WHEN regexp_matches(raw, '\w+=\S+') THEN 'kv' ELSE 'json' END"


@query("flatten_json", f"{TREE_SQL} SELECT record_id, path, value, type FROM tree")
def flatten_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """However deep the records are nested."""
    return parsing.flatten_json(raws(spark, sf_dir), "record_id", "raw")


#: The cells as the records are made of them.
CSV_SQL = f"WITH c AS (SELECT event_id AS record_id, user_id, event_type, event_id % 12 = 1 AS plain, {binding.K} AS k FROM events WHERE event_id % 6 = 1), cells AS (SELECT record_id, unnest([{{'row': 0, 'position': 0, 'path': 'user', 'value': user_id::VARCHAR}}, {{'row': 0, 'position': 1, 'path': CASE WHEN plain THEN 'type' ELSE 'the, type' END, 'value': CASE WHEN plain THEN event_type ELSE event_type || ', \"x\"' END}}, {{'row': 0, 'position': 2, 'path': 'k', 'value': k::VARCHAR}}, {{'row': 1, 'position': 0, 'path': 'user', 'value': (user_id + 1)::VARCHAR}}, {{'row': 1, 'position': 1, 'path': CASE WHEN plain THEN 'type' ELSE 'the, type' END, 'value': CASE WHEN plain THEN '' ELSE 'plain, too' END}}, {{'row': 1, 'position': 2, 'path': 'k', 'value': CASE WHEN plain THEN 'true' ELSE '1.5' END}}], recursive := true) FROM c) SELECT *, CASE WHEN value = '' THEN 'null' WHEN value = 'true' THEN 'boolean' WHEN regexp_full_match(value, '[0-9.]+') THEN 'number' ELSE 'string' END AS type FROM cells"


@query("parse_csv", CSV_SQL)
def parse_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that look like CSV, whatever their ids."""
    return parsing.parse_csv(raws(spark, sf_dir).where(parsing.detect_log_format("raw") == "csv"), "record_id", "raw")


#: Bytes of a range, so small that files of a few hundred records are cut too.
CSV_RANGE = 16_384
#: Bytes of a file, about, and files, at least.
CSV_FILE, CSV_FILES = 16 << 20, 4


@query("read_csv_files", "WITH d AS (SELECT doc_id, lang, coalesce(text, '') || chr(10) || '\"end\"' AS text FROM documents) SELECT 'doc_id' AS path, 'number' AS type, md5(doc_id::VARCHAR) AS digest, count(*) AS n FROM d GROUP BY ALL UNION ALL SELECT 'the text', 'string', md5(text), count(*) FROM d GROUP BY ALL UNION ALL SELECT 'column_2', 'string', md5(lang), count(*) FROM d GROUP BY ALL")
def read_csv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in CSV files with quotes, doubled quotes, commas and line ends in cells, read in small ranges."""
    path = source.shared_folder(spark, "csv")
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    text = F.concat(F.coalesce("text", F.lit("")), F.lit('\n"end"'))
    rows = binding.table(spark, sf_dir, "documents").select(F.concat_ws(",", F.col("doc_id").cast("string"), quoted(text), "lang").alias("line"))
    # each file begins with its header, as the part that writes it does
    n = max(CSV_FILES, -(-(rows.agg(F.sum(F.octet_length("line"))).first()[0] or 0) // CSV_FILE))
    parts = rows.withColumn("part", F.pmod(F.xxhash64("line"), F.lit(n)))
    heads = spark.range(n).select(F.lit('doc_id,"the text",').alias("line"), F.col("id").alias("part"))
    both = heads.withColumn("body", F.lit(0)).unionByName(parts.withColumn("body", F.lit(1)))
    both.repartition(n, "part").sortWithinPartitions("part", "body").drop("body").write.partitionBy("part").text(path)
    found = csv_files.read_csv_fields(spark, path, CSV_RANGE)
    return found.groupBy("path", "type", F.md5("value").alias("digest")).agg(F.count("*").alias("n"))


LINE_SQL = RAW_SQL + ", f AS (SELECT record_id, raw, " + FORMAT_SQL + r" AS format FROM raws), l AS (SELECT record_id, raw, CASE WHEN regexp_matches(raw, '^[A-Z][a-z]{2}\s') THEN regexp_extract(raw, '^([A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+(\S+?)(?:\[(\d+)\])?:\s*(.*)$', ['timestamp', 'hostname', 'process', 'pid', 'message']) ELSE regexp_extract(raw, '^(\S+)\s+(\S+)\s+(\S+?)(?:\[(\d+)\])?:\s*(.*)$', ['timestamp', 'hostname', 'process', 'pid', 'message']) END AS p FROM f WHERE format = 'syslog')"


@query("parse_syslog", LINE_SQL + r""" SELECT record_id, 'timestamp' AS path, p.timestamp AS value, 'string' AS type FROM l UNION ALL SELECT record_id, 'hostname', p.hostname, 'string' FROM l UNION ALL SELECT record_id, 'process', p.process, 'string' FROM l UNION ALL SELECT record_id, 'pid', p.pid, 'number' FROM l WHERE p.pid <> '' UNION ALL SELECT record_id, 'message', p.message, 'string' FROM l UNION ALL SELECT record_id, 'message.user', regexp_extract(raw, 'user=(\S+)', 1), 'number' FROM l WHERE contains(raw, 'user=') UNION ALL SELECT record_id, 'message.action', regexp_extract(raw, 'action="([^"]*)"', 1), 'string' FROM l WHERE contains(raw, 'action=') UNION ALL SELECT record_id, 'raw', trim(raw), 'string' FROM f WHERE format <> 'syslog'""")
def parse_syslog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records; those of other formats stay raw."""
    return parsing.parse_syslog(raws(spark, sf_dir), "record_id", "raw")


@query("parse_kv", f"{RAW_SQL}, k AS (SELECT record_id, unnest(regexp_extract_all(raw, '(\\w+)=', 1)) AS path, unnest(list_transform(regexp_extract_all(raw, '\\w+=(\"[^\"]*\"|''[^'']*''|\\S+)', 1), lambda x: trim(x, '\"''')) ) AS value, unnest(range(len(regexp_extract_all(raw, '(\\w+)=', 1))))::INT AS position FROM raws) SELECT *, CASE WHEN value IN ('', 'null', 'NULL') THEN 'null' WHEN value IN ('true', 'false') THEN 'boolean' WHEN regexp_full_match(value, '-?\\d+(\\.\\d+)?') THEN 'number' ELSE 'string' END AS type FROM k")
def parse_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of all records, also those inside lines of other formats."""
    return parsing.parse_kv(raws(spark, sf_dir), "record_id", "raw")


@query("infer_value_type", f"WITH v AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN CAST({binding.K} AS STRING) WHEN 1 THEN 'true' WHEN 2 THEN '' WHEN 3 THEN event_type ELSE '-1.5' END AS value FROM events) SELECT *, CASE WHEN value = '' THEN 'null' WHEN value = 'true' THEN 'boolean' WHEN regexp_full_match(value, '-?\\d+(\\.\\d+)?') THEN 'number' ELSE 'string' END AS type FROM v")
def infer_value_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = binding.table(spark, sf_dir, "events").selectExpr("event_id", f"CASE event_id % 5 WHEN 0 THEN CAST({binding.K} AS STRING) WHEN 1 THEN 'true' WHEN 2 THEN '' WHEN 3 THEN event_type ELSE '-1.5' END AS value")
    return values.withColumn("type", parsing.infer_value_type("value"))


CLASSES = [(4003, "DNS Activity", 4, "Network Activity"), (3002, "Authentication", 3, "Identity & Access Management")]
CLAIMS = "event_id, CASE event_id % 5 WHEN 0 THEN '4003' WHEN 1 THEN '3002' WHEN 2 THEN '9999' WHEN 3 THEN event_type END AS class_uid, CASE event_id % 3 WHEN 0 THEN '4' WHEN 1 THEN 'x' END AS category_uid"


@query("detect_event_class", f"WITH d AS (SELECT * FROM (VALUES (4003, 'DNS Activity', 4, 'Network Activity'), (3002, 'Authentication', 3, 'Identity & Access Management')) v(u, n, c, cn)), r AS (SELECT {CLAIMS}, TRY_CAST(class_uid AS BIGINT) AS cu, TRY_CAST(category_uid AS BIGINT) AS ca FROM events) SELECT event_id, class_uid, category_uid, cu AS detected_class_uid, n AS class_name, coalesce(ca, c) AS detected_category_uid, coalesce(CASE WHEN ca = 4 THEN 'Network Activity' END, cn) AS category_name, CASE WHEN cu IS NULL THEN 'Low' ELSE 'Definitive' END AS confidence, CASE WHEN class_uid IS NOT NULL AND cu IS NULL THEN 'class_uid must be an integer' WHEN cu IS NOT NULL AND u IS NULL THEN 'class_uid ' || cu || ' not found' END AS error FROM r LEFT JOIN d ON cu = u")
def detect_event_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = binding.table(spark, sf_dir, "events").selectExpr(*[x.strip() for x in CLAIMS.replace("END AS class_uid, ", "END AS class_uid\n").replace("event_id, CASE", "event_id\nCASE", 1).split("\n")])
    return mapping.detect_event_class(claims, spark.createDataFrame(CLASSES, "class_uid long, class_name string, category_uid long, category_name string"))


SPECS = [mapping.Spec("query_hostname", "query.hostname", "upper"), mapping.Spec("source_ip", "src_endpoint.ip"), mapping.Spec("metadata_uid", "metadata.uid", "trim", 0.9), mapping.Spec("duration", "duration", "cast:Integer", 0.8), mapping.Spec("cloud_region", "cloud.region", None, 0.3)]


@query("apply_mapping", f"{DNS_SQL} SELECT upper(query_hostname) AS hostname, source_ip AS ip, metadata_uid AS uid, CAST(trunc(duration) AS INTEGER) AS duration, 4003 AS class_uid, 4 AS category_uid FROM dns")
def apply_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mapping.apply_mapping(binding.dns(spark, sf_dir), SPECS, 4003, 4)
    return found.select("query.hostname", "src_endpoint.ip", "metadata.uid", "duration", "class_uid", "category_uid")


DICTIONARY = [("metadata_uid", "string_t", "required", False), ("class_uid", "integer_t", "required", False), ("answers_rdata", "ip_t", "required", False), ("severity_id", "float_t", "optional", False), ("time", "timestamp_t", "required", False), ("unheard", "strange_t", "optional", False)]


@query("conform_schema", f"{DNS_SQL} SELECT metadata_uid, class_uid::BIGINT AS class_uid, answers_rdata, severity_id::DOUBLE AS severity_id, time, NULL::VARCHAR AS unheard FROM dns WHERE answers_rdata IS NOT NULL")
def conform_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.conform(binding.dns(spark, sf_dir), DICTIONARY)[0].withColumn("time", F.col("time").cast("timestamp_ntz"))


@query("conform_schema_rejected", f"{DNS_SQL} SELECT metadata_uid, class_uid::BIGINT AS class_uid, answers_rdata, severity_id::DOUBLE AS severity_id FROM dns WHERE answers_rdata IS NULL")
def conform_schema_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.conform(binding.dns(spark, sf_dir), DICTIONARY)[1].select("metadata_uid", "class_uid", "answers_rdata", "severity_id")


#: A dictionary of nested attributes, for mapped events with an array of answers.
NESTED = [("metadata.uid", "string_t", "required", False), ("src_endpoint.ip", "ip_t", "optional", False), ("src_endpoint.port", "port_t", "optional", False), ("answers[].rdata", "ip_t", "required", False), ("answers[].ttl", "integer_t", "optional", False), ("query.hostname", "hostname_t", "required", False), ("duration", "long_t", "optional", False)]
NESTED_SQL = f"{DNS_SQL}, m AS (SELECT metadata_uid AS uid, CASE WHEN k % 4 = 1 THEN NULL ELSE upper(query_hostname) END AS hostname, source_ip AS ip, answers_rdata AS rdata, k, CAST(trunc(duration) AS BIGINT) AS duration FROM dns), c AS (SELECT *, list_filter([CASE WHEN rdata IS NULL THEN 'answers[].rdata' END, CASE WHEN hostname IS NULL THEN 'query.hostname' END], lambda x: x IS NOT NULL) AS missing FROM m)"


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapped events; some lack a host, some an answer."""
    events = binding.dns(spark, sf_dir).withColumn("query_hostname", F.when(F.col("k") % 4 != 1, F.col("query_hostname")))
    events = events.withColumn("answers", F.array(F.struct(F.col("answers_rdata").alias("rdata"), F.col("k").cast("string").alias("ttl")), F.struct(F.col("source_ip").alias("rdata"), F.lit("?").alias("ttl"))))
    return mapping.apply_mapping(events, [*SPECS, mapping.Spec("answers", "answers")], 4003, 4)


@query("conform_nested", f"{NESTED_SQL} SELECT uid, ip, NULL::BIGINT AS port, rdata AS first_answer, k::BIGINT AS first_ttl, ip AS second_answer, NULL::BIGINT AS second_ttl, hostname, duration FROM c WHERE len(missing) = 0")
def conform_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapped events conformed: nested attributes keep their places, elements of arrays too."""
    dictionary = spark.createDataFrame(NESTED, "path string, type string, requirement string, is_array boolean")
    good = mapping.conform(_mapped(spark, sf_dir), dictionary)[0]
    return good.selectExpr("metadata.uid", "src_endpoint.ip", "src_endpoint.port", "answers[0].rdata AS first_answer", "answers[0].ttl AS first_ttl", "answers[1].rdata AS second_answer", "answers[1].ttl AS second_ttl", "query.hostname", "duration")


@query("conform_nested_rejected", f"{NESTED_SQL} SELECT uid, missing FROM c WHERE len(missing) > 0")
def conform_nested_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each rejected event is."""
    return mapping.conform(_mapped(spark, sf_dir), NESTED)[1].select("metadata.uid", "missing")


@query("type_uid", f"{DNS_SQL} SELECT metadata_uid, class_uid::BIGINT * 100 + severity_id AS type_uid FROM dns")
def type_uid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.with_type_uid(binding.dns(spark, sf_dir).withColumn("activity_id", F.col("severity_id"))).select("metadata_uid", "type_uid")


VIEW = Entity("dns_event", (Attribute("host", field="query_hostname"), Attribute("user_number", field="user.k"), Attribute("unmapped"), Attribute("secret", field="source_ip", visible=False)), class_uids=(4003,))


@query("entity_view", f"{DNS_SQL} SELECT metadata_uid, class_uid, query_hostname AS host, CAST(k AS VARCHAR) AS user_number, NULL::VARCHAR AS unmapped FROM dns WHERE class_uid = 4003")
def entity_view_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = binding.dns(spark, sf_dir).withColumn("raw_data", F.to_json(F.struct(F.struct("k").alias("user"))))
    return entity_view(VIEW, events).select("metadata_uid", "class_uid", "host", "user_number", "unmapped")


@query("json_extract", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binding.table(spark, sf_dir, "events").select("event_id", source.json_path("props", "k").alias("k"))


@query("array_contains", f"{DNS_SQL} SELECT metadata_uid, list_contains([query_type, response_code], 'TXT') AS has_txt FROM dns")
def array_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binding.dns(spark, sf_dir).select("metadata_uid", source.array_has(F.array("query_type", "response_code"), "TXT").alias("has_txt"))


@query("write_events", f"{DNS_SQL} SELECT CAST(time AS DATE) AS event_date, count(*) AS n, count(DISTINCT metadata_uid) AS n_uids FROM dns GROUP BY 1")
def write_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = source.shared_folder(spark, "events")
    source.write_events(binding.dns(spark, sf_dir), path)
    return source.read_events(spark, path).groupBy("event_date").agg(F.count("*").alias("n"), F.count_distinct("metadata_uid").alias("n_uids"))


@query("write_observables", f"{DNS_SQL}, {OBSERVABLES_SQL} SELECT type_id, value, count(*) AS n FROM obs WHERE event_time >= TIMESTAMP '2024-01-10' AND event_time < TIMESTAMP '2024-01-20' GROUP BY 1, 2")
def write_observables(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = source.shared_folder(spark, "observables")
    source.write_observables(observable_table(spark, sf_dir), path)
    found = source.read_events(spark, path).where("event_date >= DATE'2024-01-10' AND event_date < DATE'2024-01-20'")
    return found.groupBy("type_id", "value").agg(F.count("*").alias("n"))


INDEXED_ROWS = 20_000
LOOK_UPS = {"value": "value IN ('192.0.2.17', 'h1.view.example.com')", "uid": "event_uid IN ('ev-7', 'ev-77', 'ev-100')", "time": "event_time >= TIMESTAMP '2024-01-10 06:00:00' AND event_time < TIMESTAMP '2024-01-11' AND type_id = 2"}


@query("look_up_indexed", f"{DNS_SQL}, {OBSERVABLES_SQL} " + " UNION ALL ".join(f"SELECT '{n}' AS asked, observable_id, type_id, value, event_uid, event_time FROM obs WHERE {w}" for n, w in LOOK_UPS.items()))
def look_up_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look-ups by value, event and time, each of which opens only the files that its index names."""
    path = source.shared_folder(spark, "indexed")
    indexed.write_indexed(observable_table(spark, sf_dir), path, INDEXED_ROWS)
    asked = {"value": {"values": ["192.0.2.17", "h1.view.example.com"]}, "uid": {"uids": ["ev-7", "ev-77", "ev-100"]}, "time": {"start": datetime(2024, 1, 10, 6), "stop": datetime(2024, 1, 11), "type_ids": [2]}}
    parts = [indexed.look_up(spark, path, **a).select(F.lit(n).alias("asked"), "observable_id", "type_id", "value", "event_uid", "event_time") for n, a in asked.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("partition_registry", f"{DNS_SQL} SELECT 'dns' AS table_name, CAST(CAST(time AS DATE) AS VARCHAR) AS partition_key, count(*) AS row_count, false AS is_empty, min(k) AS low, max(k) AS high, true AS has_bytes FROM dns GROUP BY CAST(time AS DATE)")
def partition_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The partitions of a written table, from listings and footers alone; that the bytes are the files' is checked here."""
    path = source.shared_folder(spark, "registered")
    source.write_events(binding.dns(spark, sf_dir), path)
    found = partitions.registry(spark, path, "dns", ordered="k")
    listed = spark.createDataFrame([(partitions.listed_bytes(spark, path),)], "listed long")
    whole = found.agg((F.sum("size_bytes") == F.max(F.lit(listed.first().listed))).alias("has_bytes"))
    return found.join(F.broadcast(whole)).select("table_name", "partition_key", "row_count", "is_empty", "low", "high", "has_bytes")


@query("hot_rollup", f"{DNS_SQL} SELECT source_ip, query_type, action, count(*) AS event_count FROM dns GROUP BY ALL")
def hot_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.hot_rollup(binding.dns(spark, sf_dir), ["source_ip", "query_type", "action"])
