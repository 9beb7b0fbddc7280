"""Queries of profiling, lineage, coverage, differences and merges, with their SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.operators import changes, lineage, parsing, profiling, range_hash, sketches
from vigil.sources.events import shared_folder

from . import binding
from .binding import AS_OF_SQL, DNS_SQL
from .queries_sources import TREE_SQL, raws
from .registry import query

# 2.5 profiling

PROFILED = ["lang", "source", "n_chars", "doc_id", "text"]


def _statistics_sql(c: str) -> str:
    return f"SELECT 'documents' AS table_name, '{c}' AS column_name, count(DISTINCT {c}) AS distinct_count, count(*) - count({c}) AS null_count, count(*) AS total_count, CAST(min({c}) AS VARCHAR) AS min_value, CAST(max({c}) AS VARCHAR) AS max_value, (count(*) - count({c})) / count(*) AS null_rate, count(DISTINCT {c}) / count(*) AS cardinality, 1.0::DOUBLE AS sample_rate FROM documents"


@query("column_statistics", " UNION ALL ".join(_statistics_sql(c) for c in PROFILED))
def column_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.column_statistics(binding.table(spark, sf_dir, "documents"), "documents", PROFILED)


SKETCHED = ["query_type", "k", "action"]


def _sketch_sql(c: str, number: bool) -> str:
    bounds = f"min({c})::DOUBLE AS min_number, NULL::VARCHAR AS min_text" if number else f"NULL::DOUBLE AS min_number, min({c}) AS min_text"
    return f"SELECT '{c}' AS column_name, count(*) AS total_count, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS distinct_count, {bounds}, (SELECT max(n) FROM (SELECT count(*) AS n FROM chosen GROUP BY {c})) AS top_count FROM chosen"


@query("sketched_statistics", f"{DNS_SQL}, chosen AS (SELECT * FROM dns WHERE CAST(time AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-24') " + " UNION ALL ".join(_sketch_sql(c, c == "k") for c in SKETCHED))
def sketched_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of twenty days from the days' sketches, which were made in two goes; these columns have few values, so that
    the sketches are exact."""
    path = shared_folder(spark, "sketches")
    dns = binding.dns(spark, sf_dir).withColumn("day", F.to_date("time"))
    sketches.add_partitions(dns.where("day < DATE'2024-01-15'"), SKETCHED, "day", path)
    sketches.add_partitions(dns, SKETCHED, "day", path)
    found = sketches.merge(sketches.read_sketches(spark, path), F.col("partition").between("2024-01-05", "2024-01-24"))
    return found.select("column_name", "total_count", "null_count", "distinct_count", "min_number", "min_text", F.get("frequent", F.lit(0))["count"].alias("top_count"))


@query("stale_statistics", f"WITH s AS (SELECT event_type AS table_name, max(ts) - INTERVAL 1 DAY * (user_id % 4) AS collected_at FROM events GROUP BY event_type, user_id % 4), n AS (SELECT table_name, min(collected_at) AS collected_at FROM s GROUP BY 1) SELECT * FROM n WHERE collected_at < {AS_OF_SQL} - INTERVAL 86400 SECOND")
def stale_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = binding.table(spark, sf_dir, "events").groupBy("event_type", F.expr("user_id % 4").alias("d")).agg(F.max("ts").alias("t")).selectExpr("event_type AS table_name", "t - make_dt_interval(CAST(d AS INT)) AS collected_at")
    oldest = stats.groupBy("table_name").agg(F.min("collected_at").alias("collected_at"))
    return profiling.stale_statistics(oldest, binding.as_of(spark, sf_dir))


def _partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.partition_metadata(binding.dns(spark, sf_dir), "dns", "time", "day", F.length("query_hostname"))


PARTS_SQL = "parts AS (SELECT 'dns' AS table_name, date_trunc('day', time)::TIMESTAMP AS start_time, date_trunc('day', time)::TIMESTAMP + INTERVAL 1 DAY AS end_time, count(*) AS row_count, sum(length(query_hostname))::BIGINT AS size_bytes, false AS is_empty, max(time) AS last_modified FROM dns GROUP BY date_trunc('day', time))"


@query("partition_metadata", f"{DNS_SQL}, {PARTS_SQL} SELECT *, strftime(start_time, '%Y-%m-%dT%H') AS partition_key FROM parts")
def partition_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _partitions(spark, sf_dir)


@query("partition_metadata_empties", f"{DNS_SQL}, p AS (SELECT date_trunc('hour', time)::TIMESTAMP AS start_time, count(*) AS n FROM dns GROUP BY 1), r AS (SELECT unnest(generate_series((SELECT min(start_time) FROM p), (SELECT max(start_time) FROM p), INTERVAL 1 HOUR)) AS start_time) SELECT r.start_time, coalesce(n, 0) AS row_count, n IS NULL AS is_empty FROM r LEFT JOIN p ON r.start_time = p.start_time")
def partition_metadata_empties(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = profiling.partition_metadata(binding.dns(spark, sf_dir), "dns", "time", "hour")
    return profiling.with_empty_partitions(meta, "hour").select("start_time", "row_count", "is_empty")


@query("partitions_in_range", f"{DNS_SQL}, {PARTS_SQL}, w AS (SELECT user_id AS window_id, min(ts) AS s, min(ts) + INTERVAL 50 HOUR AS e FROM events GROUP BY 1) SELECT window_id, count(*) AS n_partitions, sum(row_count)::BIGINT AS estimated_rows FROM w JOIN parts ON start_time < e AND end_time > s GROUP BY 1")
def partitions_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = binding.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("window_id")).agg(F.min("ts").alias("s")).selectExpr("window_id", "s", "s + INTERVAL 50 HOUR AS e")
    return profiling.partitions_in_range(_partitions(spark, sf_dir), windows)


def _json_fields(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The fields of all records, and these; records that aren't JSON have none."""
    records = raws(spark, sf_dir)
    return parsing.flatten_json(records, "record_id", "raw"), records


@query("field_profile", f"{TREE_SQL} SELECT path, type, min(value) AS example, count(DISTINCT record_id) AS n_records, count(DISTINCT record_id) / (SELECT count(*) FROM raws) AS presence_rate FROM tree GROUP BY 1, 2")
def field_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.field_profile(*_json_fields(spark, sf_dir), "record_id")


MAPPINGS = [("user", "High"), ("n.k", "Medium"), ("type", "Medium"), ("never.seen", "High")]
MAPPINGS_SQL = f"{TREE_SQL}, seen AS (SELECT DISTINCT path FROM tree), maps AS (SELECT * FROM (VALUES ('user', 'High'), ('n.k', 'Medium'), ('type', 'Medium'), ('never.seen', 'High')) m(target, confidence))"


def _mappings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MAPPINGS, "target string, confidence string")


GAPS_SQL = f"{MAPPINGS_SQL}, gaps AS (SELECT path, 'unmapped' AS gap FROM seen WHERE path NOT IN (SELECT target FROM maps) UNION ALL SELECT target, 'unobserved' FROM maps WHERE target NOT IN (SELECT path FROM seen))"


@query("mapping_coverage", f"{MAPPINGS_SQL}, c AS (SELECT (SELECT count(*) FROM seen) AS n, (SELECT count(*) FROM maps) AS m, (SELECT list_sort(list(path)) FROM seen WHERE path NOT IN (SELECT target FROM maps)) AS unmapped_paths, (SELECT list_sort(list(target)) FROM maps WHERE target NOT IN (SELECT path FROM seen)) AS unobserved_targets) SELECT 100.0::DOUBLE * (n - len(unmapped_paths)) / n AS percent_mapped, 100.0::DOUBLE * len(unmapped_paths) / n AS percent_unmapped, 100.0::DOUBLE * len(unobserved_targets) / m AS percent_unobserved, unmapped_paths, unobserved_targets FROM c")
def mapping_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.mapping_coverage(_json_fields(spark, sf_dir)[0], _mappings(spark))


@query("mapping_gaps", f"{GAPS_SQL} SELECT path, gap FROM gaps")
def mapping_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.mapping_gaps(_json_fields(spark, sf_dir)[0], _mappings(spark))


@query("mapping_verification", f"{MAPPINGS_SQL} SELECT target, CASE WHEN target IN (SELECT path FROM seen) THEN 'Verified' ELSE 'Unverified' END AS status FROM maps")
def mapping_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.mapping_verification(_mappings(spark), _json_fields(spark, sf_dir)[0])


SCHEMA = [("user", "string_t", 1, "required"), ("type", "string_t", 1, "optional"), ("n.k", "integer_t", 1, "optional"), ("n.w", "integer_t", 1, "optional"), ("n.o.p.q.r", "float_t", 1, "optional"), ("tags", "long_t", 1, "recommended"), ("other.path", "string_t", 1, "required")]
SCHEMA_SQL = "sch AS (SELECT * FROM (VALUES " + ", ".join(repr(x) for x in SCHEMA) + ") s(path, attr_type, class_uid, requirement))"
#: Which observed types go with which schema types.
AGREE_SQL = "agree AS (SELECT observed, unnest(string_split(kinds, ' ')) AS kind FROM (VALUES ('string', 'string_t hostname_t ip_t email_t url_t mac_t subnet_t path_t process_name_t username_t datetime_t'), ('integer', 'integer_t long_t timestamp_t'), ('float', 'float_t double_t'), ('boolean', 'boolean_t')) a(observed, kinds))"


def _schema(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SCHEMA, "path string, attr_type string, class_uid int, requirement string")


@query("type_mismatch", f"{MAPPINGS_SQL}, {SCHEMA_SQL}, {AGREE_SQL}, t AS (SELECT DISTINCT path, CASE WHEN type <> 'number' THEN type WHEN value::DOUBLE % 1 = 0 THEN 'integer' ELSE 'float' END AS type FROM tree) SELECT path, type AS observed_type, attr_type AS schema_type FROM sch JOIN t USING (path) WHERE type NOT IN ('null', 'array') AND (type, attr_type) NOT IN (SELECT (observed, kind) FROM agree)")
def type_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = parsing.flatten_json(raws(spark, sf_dir), "record_id", "raw", split_numbers=True)
    return profiling.type_mismatch(fields, _schema(spark), 1)


@query("attribute_tiers", f"{MAPPINGS_SQL}, {SCHEMA_SQL} SELECT coalesce(seen.path, sch.path) AS path, CASE WHEN seen.path IS NULL THEN 'potential' WHEN target IS NOT NULL OR requirement IN ('required', 'recommended') THEN 'core' ELSE 'extended' END AS tier FROM seen FULL JOIN sch ON seen.path = sch.path LEFT JOIN (SELECT target FROM maps WHERE confidence = 'High') m ON m.target = coalesce(seen.path, sch.path)")
def attribute_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.attribute_tiers(_json_fields(spark, sf_dir)[0], _schema(spark), _mappings(spark))


#: The schema's word on the documents' columns: type, requirement, group, indicator type.
ATTRIBUTES = [("doc_id", "long_t", "required", "primary", None), ("lang", "string_t", "recommended", "classification", None), ("source", "string_t", "optional", "classification", 20), ("n_chars", "long_t", "optional", "context", None), ("text", "string_t", "recommended", "primary", 30), ("never_seen", "timestamp_t", "required", None, None)]
FEW = 50


@query("infer_dimensions", "WITH d AS (SELECT * FROM (VALUES ('doc_id', 'identifier', true, false, true, false, NULL), ('lang', 'text', false, true, false, true, NULL), ('source', 'searchable', false, false, false, true, 20), ('n_chars', 'numeric', false, false, false, false, NULL), ('text', 'searchable', false, true, true, false, 30)) v(name, kind, required, recommended, is_primary, classification, observable)), s AS (" + " UNION ALL ".join(f"SELECT '{c}' AS name, count(DISTINCT {c}) <= {FEW} AS enum FROM documents" for c in ("doc_id", "lang", "source", "n_chars", "text")) + ") SELECT name, CASE WHEN enum THEN 'categorical' ELSE kind END AS dimension_type, CASE WHEN required OR is_primary THEN 'high' WHEN recommended OR classification THEN 'medium' ELSE 'low' END AS priority, name <> 'n_chars' OR enum AS is_dimension, CASE WHEN enum THEN 'enum' WHEN required THEN 'required' WHEN is_primary THEN 'primary group' WHEN classification THEN 'classification group' WHEN observable IS NOT NULL THEN 'observable' ELSE 'no criterion met' END AS reason FROM d JOIN s USING (name)")
def infer_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the profile of the documents' columns, joined with a dictionary; few values make an enum."""
    profile = profiling.column_statistics(binding.table(spark, sf_dir, "documents"), "documents").select(F.col("column_name").alias("name"), (F.col("distinct_count") <= FEW).alias("has_enum"))
    dictionary = spark.createDataFrame(ATTRIBUTES, "name string, attr_type string, requirement string, group string, observable_type_id int")
    return profiling.infer_dimensions(profile.join(dictionary, "name"))


@query("value_pattern_check", f"{DNS_SQL} SELECT 'query_hostname' AS attribute, avg(CASE WHEN regexp_matches(query_hostname, '^h[0-9]') THEN 1.0 ELSE 0.0 END) AS match_rate FROM dns UNION ALL SELECT 'answers_rdata', avg(CASE WHEN regexp_matches(answers_rdata, '\\.1\\d*$') THEN 1.0 ELSE 0.0 END) FROM dns WHERE answers_rdata IS NOT NULL")
def value_pattern_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.value_pattern_check(binding.dns(spark, sf_dir), {"query_hostname": r"^h[0-9]", "answers_rdata": r"\.1\d*$"})


# 2.6 lineage and coverage

RUNS_SQL = "runs AS (SELECT 'run-' || CAST(user_id AS VARCHAR) || '-' || event_type AS id, event_type AS source_system, 'raw_' || CAST(user_id % 7 AS VARCHAR) AS source_table, 'table_' || CAST(user_id % 3 AS VARCHAR) AS target_table, max(ts) AS ingestion_timestamp, count(*) AS record_count FROM events GROUP BY user_id, event_type)"
FIELD_RUNS_SQL = "fruns AS (SELECT id || '-f' || CAST(i AS VARCHAR) AS id, CASE WHEN i = 3 THEN 'gone-' || id ELSE id END AS source_lineage_id, 'src_' || CAST(i AS VARCHAR) AS source_field, 'field_' || CAST(i % 2 AS VARCHAR) AS target_field FROM runs CROSS JOIN (SELECT unnest(range(4)) AS i) n)"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = binding.table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("ts").alias("ingestion_timestamp"), F.count("*").alias("record_count"))
    return found.selectExpr("concat('run-', user_id, '-', event_type) AS id", "event_type AS source_system", "concat('raw_', user_id % 7) AS source_table", "concat('table_', user_id % 3) AS target_table", "ingestion_timestamp", "record_count")


def field_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = runs(spark, sf_dir).select("id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i"))
    return each.selectExpr("concat(id, '-f', i) AS id", "CASE WHEN i = 3 THEN concat('gone-', id) ELSE id END AS source_lineage_id", "concat('src_', i) AS source_field", "concat('field_', i % 2) AS target_field")


@query("capture_lineage", f"{DNS_SQL} SELECT 'dns' AS source_system, 'events' AS source_table, 'dns_event' AS target_table, count(*) AS record_count, source_field, target_field, transformation FROM dns, (VALUES ('src_ip', 'source_ip', NULL), ('dns_name', 'query_hostname', 'lower')) f(source_field, target_field, transformation) GROUP BY ALL")
def capture_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = binding.dns(spark, sf_dir)
    source, fields = lineage.capture_lineage(events, shared_folder(spark, "run"), "dns", "events", "dns_event", [("src_ip", "source_ip", None), ("dns_name", "query_hostname", "lower")], datetime(2024, 2, 1))
    return source.join(fields.withColumnRenamed("id", "field_id"), F.col("id") == F.col("source_lineage_id")).select("source_system", "source_table", "target_table", "record_count", "source_field", "target_field", "transformation")


@query("source_lineage", f"WITH {RUNS_SQL}, w AS (SELECT *, count(*) OVER () AS total_count FROM runs WHERE target_table = 'table_1' AND ingestion_timestamp BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-30') SELECT *, total_count > 30 AS has_more FROM w ORDER BY ingestion_timestamp, id LIMIT 20 OFFSET 10")
def source_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.source_lineage(runs(spark, sf_dir), "table_1", datetime(2024, 1, 1), datetime(2024, 1, 30), 10, 20)


@query("field_lineage", f"WITH {RUNS_SQL}, {FIELD_RUNS_SQL}, w AS (SELECT f.*, count(*) OVER () AS total_count FROM fruns f LEFT JOIN runs r ON f.source_lineage_id = r.id WHERE target_field = 'field_1' AND (r.id IS NULL OR ingestion_timestamp BETWEEN TIMESTAMP '2024-01-25' AND TIMESTAMP '2024-01-30')) SELECT *, total_count > 500 AS has_more FROM w ORDER BY id LIMIT 500")
def field_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.field_lineage(field_runs(spark, sf_dir), runs(spark, sf_dir), "field_1", datetime(2024, 1, 25), datetime(2024, 1, 30), 0, 500)


@query("lineage_graph", f"WITH {RUNS_SQL} SELECT DISTINCT source_system || ':' || source_table AS node, 'source' AS kind FROM runs UNION SELECT target_table, 'target' FROM runs")
def lineage_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.lineage_graph(runs(spark, sf_dir))[0]


@query("lineage_graph_edges", f"WITH {RUNS_SQL} SELECT source_system || ':' || source_table AS source, target_table AS target, ingestion_timestamp, record_count FROM runs WHERE target_table = 'table_2'")
def lineage_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.lineage_graph(runs(spark, sf_dir), "table_2")[1]


EDGES_SQL = "edges AS (SELECT 'n' || CAST(user_id AS VARCHAR) AS source, 'n' || CAST((user_id * 7 + 3) % 150 AS VARCHAR) AS target, CASE event_type WHEN 'view' THEN 'MapsTo' WHEN 'click' THEN 'Contains' ELSE 'DataFlow' END AS edge_type FROM events GROUP BY ALL)"


@query("connected_nodes", f"WITH RECURSIVE {EDGES_SQL}, both_ways AS (SELECT source AS a, target AS b FROM edges WHERE edge_type IN ('MapsTo', 'DataFlow') UNION SELECT target, source FROM edges WHERE edge_type IN ('MapsTo', 'DataFlow')), walk AS (SELECT 'n1' AS node, 0 AS depth UNION SELECT b, depth + 1 FROM walk JOIN both_ways ON node = a WHERE depth < 3) SELECT node, min(depth) AS depth FROM walk GROUP BY 1")
def connected_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = binding.table(spark, sf_dir, "events").selectExpr("concat('n', user_id) AS source", "concat('n', (user_id * 7 + 3) % 150) AS target", "CASE event_type WHEN 'view' THEN 'MapsTo' WHEN 'click' THEN 'Contains' ELSE 'DataFlow' END AS edge_type").distinct()
    return lineage.connected_nodes(edges, ["n1"], 3, ["MapsTo", "DataFlow"])


#: A registry of tables, one for each user, from events.
TABLES = [
    "concat('t', user_id) AS table_name",
    "CASE user_id % 3 WHEN 0 THEN 4003 ELSE 3002 END AS class_uid",
    "user_id % 5 <> 4 AS is_active",
    "named_struct('mitre_techniques', array(concat('T', 1000 + user_id % 9 * 77), 'T1071.004'), 'mitre_tactics', array(element_at(array('command-and-control', 'exfiltration', 'initial-access'), CAST(1 + user_id % 3 AS INT))), 'data_sources', array(concat('src-', user_id % 4)), 'kill_chain_phases', array('delivery', concat('phase-', user_id % 2))) AS detection_coverage",
]
TABLES_SQL = "tabs AS (SELECT DISTINCT 't' || CAST(user_id AS VARCHAR) AS table_name, CASE user_id % 3 WHEN 0 THEN 4003 ELSE 3002 END AS class_uid, user_id % 5 <> 4 AS is_active, ['T' || CAST(1000 + user_id % 9 * 77 AS VARCHAR), 'T1071.004'] AS techniques, ['command-and-control', 'exfiltration', 'initial-access'][1 + user_id % 3] AS tactic, 'src-' || CAST(user_id % 4 AS VARCHAR) AS data_source, ['delivery', 'phase-' || CAST(user_id % 2 AS VARCHAR)] AS phases FROM events), act AS (SELECT * FROM tabs WHERE is_active)"


def tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binding.table(spark, sf_dir, "events").select("user_id").distinct().selectExpr(*TABLES)


@query("coverage_by_technique", f"WITH {TABLES_SQL}, u AS (SELECT table_name, unnest(techniques) AS technique FROM act) SELECT technique, count(*) AS table_count, list_sort(list(table_name)) AS tables FROM u GROUP BY 1")
def coverage_by_technique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.coverage_by_technique(tables(spark, sf_dir))


@query("coverage_by_tactic", f"WITH {TABLES_SQL}, u AS (SELECT table_name, tactic, unnest(techniques) AS technique FROM act) SELECT tactic, count(DISTINCT technique) AS technique_count, count(DISTINCT table_name) AS table_count FROM u GROUP BY 1")
def coverage_by_tactic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.coverage_by_tactic(tables(spark, sf_dir))


@query("coverage_by_data_source", f"WITH {TABLES_SQL} SELECT data_source, count(*) AS table_count, list_sort(list(table_name)) AS tables FROM act GROUP BY 1")
def coverage_by_data_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.coverage_by_data_source(tables(spark, sf_dir))


@query("coverage_by_kill_chain", f"WITH {TABLES_SQL}, u AS (SELECT unnest(phases) AS phase FROM act) SELECT phase, count(*) AS table_count FROM u GROUP BY 1")
def coverage_by_kill_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.coverage_by_kill_chain(tables(spark, sf_dir))


@query("coverage_matrix", f"WITH {TABLES_SQL}, u AS (SELECT DISTINCT unnest(techniques) AS technique FROM act), t AS (SELECT technique, CASE CAST(floor(CAST(substr(split_part(technique, '.', 1), 2) AS INT) / 100) AS INT) WHEN 10 THEN 'command-and-control' WHEN 11 THEN 'exfiltration' WHEN 12 THEN 'impact' WHEN 15 THEN 'reconnaissance' WHEN 16 THEN 'resource-development' ELSE 'unknown' END AS tactic FROM u) SELECT tactic, CASE tactic WHEN 'command-and-control' THEN 'Command And Control' WHEN 'resource-development' THEN 'Resource Development' ELSE upper(tactic[1]) || tactic[2:] END AS name, count(*)::INT AS technique_count, list_sort(list(technique)) AS techniques FROM t GROUP BY 1")
def coverage_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.coverage_matrix(tables(spark, sf_dir))


@query("tables_by_technique", f"WITH {TABLES_SQL} SELECT table_name FROM act WHERE list_contains(techniques, 'T1077')")
def tables_by_technique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.tables_covering(tables(spark, sf_dir), technique="T1077").select("table_name")


@query("tables_by_tactic", f"WITH {TABLES_SQL} SELECT table_name FROM act WHERE tactic = 'exfiltration'")
def tables_by_tactic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.tables_covering(tables(spark, sf_dir), tactic="exfiltration").select("table_name")


@query("tables_by_class", f"WITH {TABLES_SQL} SELECT table_name, class_uid FROM act WHERE class_uid = 4003")
def tables_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.tables_by_class(tables(spark, sf_dir), 4003).select("table_name", "class_uid")


# 2.7 changes: two snapshots of the conversations, by turn

OLD = "SELECT conv_id, turn, role, text FROM conversations WHERE (conv_id + turn) % 11 <> 0"
NEW = "SELECT conv_id, turn, CASE WHEN conv_id % 7 = 0 THEN upper(role) ELSE role END AS role, CASE WHEN turn % 5 = 0 THEN NULL ELSE text END AS text FROM conversations WHERE (conv_id + turn) % 13 <> 0"


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    df = binding.table(spark, sf_dir, "conversations").dropDuplicates(["conv_id", "turn"])
    old = df.where("(conv_id + turn) % 11 <> 0")
    new = df.where("(conv_id + turn) % 13 <> 0").selectExpr("conv_id", "turn", "CASE WHEN conv_id % 7 = 0 THEN upper(role) ELSE role END AS role", "CASE WHEN turn % 5 = 0 THEN NULL ELSE text END AS text")
    return old, new


@query("snapshot_diff", f"WITH o AS ({OLD}), n AS ({NEW}) SELECT * FROM (SELECT coalesce(o.conv_id, n.conv_id) AS conv_id, coalesce(o.turn, n.turn) AS turn, CASE WHEN o.conv_id IS NULL THEN 'added' WHEN n.conv_id IS NULL THEN 'removed' WHEN o.role IS DISTINCT FROM n.role OR o.text IS DISTINCT FROM n.text THEN 'modified' END AS change, CASE WHEN o.conv_id IS NULL OR n.conv_id IS NULL THEN '' ELSE concat_ws(',', CASE WHEN o.role IS DISTINCT FROM n.role THEN 'role' END, CASE WHEN o.text IS DISTINCT FROM n.text THEN 'text' END) END AS reason FROM o FULL JOIN n ON o.conv_id = n.conv_id AND o.turn = n.turn) WHERE change IS NOT NULL")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.snapshot_diff(*snapshots(spark, sf_dir), ["conv_id", "turn"], ["role", "text"])


DEFS_SQL = "od AS (SELECT conv_id AS name, list_sort(list(DISTINCT role)) AS dimensions, count(*) % 2 AS aggregation FROM o GROUP BY 1), nd AS (SELECT conv_id AS name, list_sort(list(DISTINCT role)) AS dimensions, count(*) % 2 AS aggregation FROM n WHERE conv_id % 10 <> 3 GROUP BY 1), ch AS (SELECT coalesce(od.name, nd.name) AS name, CASE WHEN od.name IS NULL THEN 'added' WHEN nd.name IS NULL THEN 'removed' WHEN od.dimensions <> nd.dimensions OR od.aggregation <> nd.aggregation THEN 'modified' END AS change, CASE WHEN od.name IS NULL THEN false WHEN nd.name IS NULL THEN true ELSE NOT list_has_all(nd.dimensions, od.dimensions) OR od.aggregation <> nd.aggregation END AS is_breaking FROM od FULL JOIN nd ON od.name = nd.name)"


def _definitions(df: DataFrame) -> DataFrame:
    return df.groupBy(F.col("conv_id").alias("name")).agg(F.collect_set("role").alias("dimensions"), (F.count("*") % 2).alias("aggregation"))


@query("breaking_changes", f"WITH o AS ({OLD}), n AS ({NEW}), {DEFS_SQL} SELECT * FROM ch WHERE change IS NOT NULL")
def breaking_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = snapshots(spark, sf_dir)
    return changes.breaking_changes(_definitions(old), _definitions(new.where("conv_id % 10 <> 3")), ["name"], ["dimensions"], ["aggregation"])


@query("version_bump", f"WITH o AS ({OLD}), n AS ({NEW}), {DEFS_SQL} SELECT CASE WHEN bool_or(is_breaking) THEN 'major' WHEN bool_or(change = 'added') THEN 'minor' ELSE 'patch' END AS bump, count(*) AS n_changes FROM ch WHERE change IS NOT NULL")
def version_bump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.version_bump(breaking_changes(spark, sf_dir))


@query("content_hash_changes", f"WITH o AS ({OLD}), n AS ({NEW}) SELECT * FROM (SELECT coalesce(o.conv_id, n.conv_id) || '-' || coalesce(o.turn, n.turn) AS key, CASE WHEN o.conv_id IS NULL THEN 'added' WHEN n.conv_id IS NULL THEN 'removed' WHEN o.role IS DISTINCT FROM n.role OR o.text IS DISTINCT FROM n.text THEN 'modified' END AS change FROM o FULL JOIN n ON o.conv_id = n.conv_id AND o.turn = n.turn) WHERE change IS NOT NULL")
def content_hash_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = (df.withColumn("key", F.concat_ws("-", "conv_id", "turn")) for df in snapshots(spark, sf_dir))
    state = old.select("key", changes.content_hash(["role", "text"]).alias("content_hash"))
    return changes.content_hash_changes(state, new, "key", ["role", "text"]).drop("now_hash")


@query("snapshot_changes", f"WITH o AS ({OLD}), n AS ({NEW}) SELECT * FROM (SELECT coalesce(o.conv_id, n.conv_id) || '-' || coalesce(o.turn, n.turn) AS key, CASE WHEN o.conv_id IS NULL THEN 'added' WHEN n.conv_id IS NULL THEN 'removed' WHEN o.role IS DISTINCT FROM n.role OR o.text IS DISTINCT FROM n.text THEN 'modified' END AS change FROM o FULL JOIN n ON o.conv_id = n.conv_id AND o.turn = n.turn) WHERE change IS NOT NULL")
def snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same changes from two written snapshots and their trees of hashes."""
    path = shared_folder(spark, "snapshots")
    for name, df in zip(("old", "new"), snapshots(spark, sf_dir), strict=True):
        range_hash.write_snapshot(df.withColumn("key", F.concat_ws("-", "conv_id", "turn")), f"{path}/{name}", "key", ["role", "text"])
    return range_hash.snapshot_changes(spark, f"{path}/old", f"{path}/new", "key")


@query("merge_newest", f"WITH o AS ({OLD}), n AS ({NEW}), l AS (SELECT conv_id, turn, role, conv_id % 3 AS version FROM o), r AS (SELECT conv_id, turn, role, turn % 3 AS version FROM n) SELECT coalesce(l.conv_id, r.conv_id) AS conv_id, coalesce(l.turn, r.turn) AS turn, CASE WHEN l.conv_id IS NULL OR r.version > l.version THEN r.role ELSE l.role END AS role, CASE WHEN l.conv_id IS NULL OR r.version > l.version THEN r.version ELSE l.version END AS version FROM l FULL JOIN r ON l.conv_id = r.conv_id AND l.turn = r.turn")
def merge_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = snapshots(spark, sf_dir)
    local, remote = old.selectExpr("conv_id", "turn", "role", "conv_id % 3 AS version"), new.selectExpr("conv_id", "turn", "role", "turn % 3 AS version")
    return changes.merge_newest(local, remote, ["conv_id", "turn"], "version")


@query("dedupe_key_guard", "SELECT url, count(*) AS n FROM pages GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT role, count(*) FROM conversations GROUP BY 1 HAVING count(*) > 1")
def dedupe_key_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes.assert_unique(binding.table(spark, sf_dir, "pages"), ["page_id"])
    pages = changes.duplicate_keys(binding.table(spark, sf_dir, "pages"), ["url"])
    return pages.unionByName(changes.duplicate_keys(binding.table(spark, sf_dir, "conversations").withColumnRenamed("role", "url"), ["url"]))
