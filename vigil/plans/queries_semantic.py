"""Queries of projection, filters, aggregates, joins, routes and metrics, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.operators import metrics as M
from vigil.operators.observables import extract_observables
from vigil.sources.events import shared_folder

from . import binding
from .binding import AS_OF_SQL, DNS_SQL, FEED_SQL
from .model import Attribute, Entity, Filter, Metric, Model, Relationship, SemanticQuery
from .registry import query
from .routing import RollupSpec, StoredRollup, build_rollup, run_routed
from .semantic import join_relationship, run

MODEL = Model.of(
    [
        Entity(
            "dns_event",
            tuple(Attribute(n) for n in ("metadata_uid", "source_ip", "query_hostname", "query_type", "response_code", "action", "cloud_region", "answers_rdata", "severity_id", "status_id", "duration", "time"))
            + (Attribute("is_failure", expression="status_id = 2"), Attribute("host", field="query_hostname", synonyms=("domain", "fqdn")), Attribute("is_long", expression="length(query_hostname) > 50")),
            class_uids=(4003,),
            covers_observables=(1, 2),
        ),
        Entity("threat_intel", tuple(Attribute(n) for n in ("indicator", "indicator_type", "threat_type", "confidence", "source"))),
        Entity("lineitem", tuple(Attribute(n, field=f"l_{n}") for n in ("orderkey", "quantity", "extendedprice", "returnflag", "linestatus", "shipmode", "shipdate"))),
        Entity(
            "orders",
            tuple(Attribute(n, field=f"o_{n}") for n in ("orderkey", "custkey", "orderstatus", "totalprice", "orderpriority", "orderdate")) + (Attribute("segment", expression="customer.c_mktsegment"),),
            relationships=(Relationship("placed_by", "customer", "orders.o_custkey = customer.c_custkey"),),
            time_column="o_orderdate",
        ),
        Entity("customer", tuple(Attribute(n, field=f"c_{n}") for n in ("custkey", "name", "nationkey", "acctbal", "mktsegment"))),
    ],
    [
        Metric("dns_query_count", "dns_event"),
        Metric("total_duration", "dns_event", "sum", "duration"),
        Metric("avg_duration", "dns_event", "avg", "duration"),
        Metric("min_duration", "dns_event", "min", "duration"),
        Metric("max_duration", "dns_event", "max", "duration"),
        Metric("distinct_hosts", "dns_event", "count_distinct", "query_hostname"),
        Metric("blocked_dns_rate", "dns_event", "avg", "CASE WHEN action = 'Blocked' THEN 1.0D ELSE 0.0D END"),
        Metric("nx_success_count", "dns_event", "count", filter="response_code = 'NXDOMAIN'"),
        Metric("nx_rate", "dns_event", formula="nx_success_count / dns_query_count"),
        Metric("nx_percent", "dns_event", formula="nx_rate * 100"),
        Metric("mixed", "dns_event", formula="total_duration / nx_success_count + max_duration / dns_query_count - (min_duration - 2) * 3"),
        Metric("last_duration", "dns_event", "sum", "duration", not_summed_over=("time", "metadata_uid"), series=("source_ip",)),
        Metric("host_sightings", "dns_event", "count", hot=True, type_id=1),
        Metric("ip_sightings", "dns_event", "count_distinct", hot=True, type_id=2),
        Metric("order_count", "orders"),
        Metric("order_value", "orders", "sum", "o_totalprice"),
    ],
)


def _bind(spark: SparkSession, sf_dir: str):
    def bind(name: str) -> DataFrame:
        if name == "dns_event":
            return binding.dns(spark, sf_dir)
        return binding.feed(spark) if name == "threat_intel" else binding.table(spark, sf_dir, name)

    return bind


def _ask(spark: SparkSession, sf_dir: str, q: SemanticQuery, observables: DataFrame | None = None) -> DataFrame:
    return run(q, MODEL, _bind(spark, sf_dir), observables)


def _register(name: str, q: SemanticQuery, sql: str) -> None:
    query(name, sql)(lambda spark, sf_dir: _ask(spark, sf_dir, q))


_register(
    "sq_flagship",
    SemanticQuery("dns_event", metrics=("dns_query_count", "blocked_dns_rate"), group_by=("query_type",), filters=(Filter("response_code", "=", "NOERROR"),), time_granularity="hour", order_by=(("dns_query_count", "desc"), ("time_bucket", "asc"), ("query_type", "asc")), limit=200),
    f"{DNS_SQL} SELECT date_trunc('hour', time)::TIMESTAMP AS time_bucket, query_type, count(*) AS dns_query_count, avg(CASE WHEN action = 'Blocked' THEN 1.0 ELSE 0.0 END) AS blocked_dns_rate FROM dns WHERE response_code = 'NOERROR' GROUP BY 1, 2 ORDER BY dns_query_count DESC, time_bucket, query_type LIMIT 200",
)
_register(
    "sq_select",
    SemanticQuery("dns_event", select=("metadata_uid", "host", "is_long", "is_failure")),
    f"{DNS_SQL} SELECT metadata_uid, query_hostname AS host, length(query_hostname) > 50 AS is_long, status_id = 2 AS is_failure FROM dns",
)
for _name, _filter, _sql in (
    ("eq", Filter("query_type", "=", "TXT"), "query_type = 'TXT'"),
    ("ne", Filter("answers_rdata", "!=", "192.0.2.17"), "answers_rdata <> '192.0.2.17'"),
    ("gt", Filter("severity_id", ">", 4), "severity_id > 4"),
    ("gte", Filter("duration", ">=", 50.5), "duration >= 50.5"),
    ("lt", Filter("severity_id", "<", 2), "severity_id < 2"),
    ("lte", Filter("severity_id", "<=", 2), "severity_id <= 2"),
    ("in", Filter("severity_id", "in", [1, 3, "5"]), "CAST(severity_id AS VARCHAR) IN ('1', '3', '5')"),
    ("notin", Filter("answers_rdata", "not in", ["192.0.2.17", "192.0.2.18"]), "answers_rdata NOT IN ('192.0.2.17', '192.0.2.18')"),
    ("like", Filter("query_hostname", "like", "h1.%example.com"), "query_hostname LIKE 'h1.%example.com'"),
    ("isnull", Filter("answers_rdata", "is null"), "answers_rdata IS NULL"),
    ("isnotnull", Filter("answers_rdata", "is not null"), "answers_rdata IS NOT NULL"),
):
    _register(f"sq_filter_{_name}", SemanticQuery("dns_event", select=("metadata_uid", "query_hostname", "answers_rdata", "severity_id"), filters=(_filter,)), f"{DNS_SQL} SELECT metadata_uid, query_hostname, answers_rdata, severity_id FROM dns WHERE {_sql}")
for _name, _metric, _sql in (
    ("count", "dns_query_count", "count(*)"),
    ("sum", "total_duration", "sum(duration)"),
    ("avg", "avg_duration", "avg(duration)"),
    ("min", "min_duration", "min(duration)"),
    ("max", "max_duration", "max(duration)"),
    ("count_distinct", "distinct_hosts", "count(DISTINCT query_hostname)"),
):
    _register(f"sq_metric_{_name}", SemanticQuery("dns_event", metrics=(_metric,), group_by=("cloud_region",)), f"{DNS_SQL} SELECT cloud_region, {_sql} AS {_metric} FROM dns GROUP BY 1")
_register(
    "sq_group_by",
    SemanticQuery("dns_event", select=("action",), metrics=("dns_query_count",), group_by=("source_ip", "query_type")),
    f"{DNS_SQL} SELECT source_ip, query_type, action, count(*) AS dns_query_count FROM dns GROUP BY ALL",
)
for _unit in ("minute", "hour", "day", "week", "month"):
    _register("sq_time_bucket" + ("" if _unit == "hour" else f"_{_unit}"), SemanticQuery("dns_event", metrics=("dns_query_count",), time_granularity=_unit), f"{DNS_SQL} SELECT date_trunc('{_unit}', time)::TIMESTAMP AS time_bucket, count(*) AS dns_query_count FROM dns GROUP BY 1")
_register(
    "sq_time_range",
    SemanticQuery("dns_event", select=("metadata_uid", "time"), time_range=("2024-01-05 00:00:00", "2024-01-09T12:00:00")),
    f"{DNS_SQL} SELECT metadata_uid, time FROM dns WHERE time BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-09 12:00:00'",
)
_register("sq_relative_time", SemanticQuery("dns_event", select=("metadata_uid",), time_range=("-7d", "-36h")), f"{DNS_SQL} SELECT metadata_uid FROM dns WHERE time BETWEEN {AS_OF_SQL} - INTERVAL 7 DAY AND {AS_OF_SQL} - INTERVAL 36 HOUR")
_register(
    "sq_order_by",
    SemanticQuery("dns_event", metrics=("dns_query_count", "avg_duration"), group_by=("query_hostname",), order_by=(("dns_query_count", "desc"), ("query_hostname", "asc"))),
    f"{DNS_SQL} SELECT query_hostname, count(*) AS dns_query_count, avg(duration) AS avg_duration FROM dns GROUP BY 1 ORDER BY 2 DESC, 1",
)
_register(
    "sq_limit_offset",
    SemanticQuery("dns_event", select=("metadata_uid", "duration"), order_by=(("duration", "desc"), ("metadata_uid", "asc")), limit=25, offset=10),
    f"{DNS_SQL} SELECT metadata_uid, duration FROM dns ORDER BY duration DESC, metadata_uid LIMIT 25 OFFSET 10",
)
_register(
    "sq_rel_join",
    SemanticQuery("orders", metrics=("order_count", "order_value"), group_by=("segment", "orderstatus")),
    "SELECT c_mktsegment AS segment, o_orderstatus AS orderstatus, count(*) AS order_count, sum(o_totalprice) AS order_value FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2",
)
_register("sq_rel_pruned", SemanticQuery("orders", metrics=("order_count",), group_by=("orderstatus",), relationships=()), "SELECT o_orderstatus AS orderstatus, count(*) AS order_count FROM orders GROUP BY 1")


@query("sq_role_join", "SELECT home.n_name AS home_nation, away.n_name AS away_nation, count(*) AS n_lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation home ON c_nationkey = home.n_nationkey JOIN nation away ON s_nationkey = away.n_nationkey GROUP BY 1, 2")
def sq_role_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    bind = lambda name: binding.table(spark, sf_dir, name)
    df = bind("lineitem").alias("lineitem")
    for r in (
        Relationship("order", "orders", "lineitem.l_orderkey = orders.o_orderkey"),
        Relationship("buyer", "customer", "orders.o_custkey = customer.c_custkey"),
        Relationship("seller", "supplier", "lineitem.l_suppkey = supplier.s_suppkey"),
        Relationship("home", "nation", "customer.c_nationkey = home.n_nationkey", alias="home"),
        Relationship("away", "nation", "supplier.s_nationkey = away.n_nationkey", alias="away"),
    ):
        df = join_relationship(df, r, bind)
    return df.groupBy(F.col("home.n_name").alias("home_nation"), F.col("away.n_name").alias("away_nation")).agg(F.count("*").alias("n_lines"))


OBSERVABLES = {1: ("Hostname", ("query_hostname",)), 2: ("IP Address", ("source_ip", "answers_rdata"))}
OBSERVABLES_SQL = "obs AS (SELECT metadata_uid || '_query_hostname' AS observable_id, 1 AS type_id, 'Hostname' AS type_name, query_hostname AS value, metadata_uid AS event_uid, class_uid AS event_class_uid, time AS event_time, 'query_hostname' AS attribute_path FROM dns UNION ALL SELECT metadata_uid || '_source_ip', 2, 'IP Address', source_ip, metadata_uid, class_uid, time, 'source_ip' FROM dns UNION ALL SELECT metadata_uid || '_answers_rdata', 2, 'IP Address', answers_rdata, metadata_uid, class_uid, time, 'answers_rdata' FROM dns WHERE answers_rdata IS NOT NULL)"


def observables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_observables(binding.dns(spark, sf_dir), OBSERVABLES)


@query("sq_hot_path", f"{DNS_SQL}, {OBSERVABLES_SQL} SELECT date_trunc('day', event_time)::TIMESTAMP AS time_bucket, type_id, count(*) AS host_sightings, count(DISTINCT value) AS ip_sightings FROM obs WHERE type_id IN (1, 2) AND event_time >= TIMESTAMP '2024-01-03' GROUP BY 1, 2")
def sq_hot_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = SemanticQuery("dns_event", metrics=("host_sightings", "ip_sightings"), time_granularity="day", time_range=("2024-01-03", None), path="hot")
    return _ask(spark, sf_dir, q, observables(spark, sf_dir))


@query("sq_route_auto", f"{DNS_SQL}, {OBSERVABLES_SQL} SELECT type_id, count(DISTINCT value) AS ip_sightings FROM obs WHERE type_id = 2 GROUP BY 1")
def sq_route_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ask(spark, sf_dir, SemanticQuery("dns_event", metrics=("ip_sightings",)), observables(spark, sf_dir))


_register(
    "metric_formula",
    SemanticQuery("dns_event", metrics=("nx_rate", "nx_percent", "dns_query_count"), group_by=("source_ip",)),
    f"{DNS_SQL} SELECT source_ip, count(*) FILTER (WHERE response_code = 'NXDOMAIN') / count(*) AS nx_rate, count(*) FILTER (WHERE response_code = 'NXDOMAIN') / count(*) * 100 AS nx_percent, count(*) AS dns_query_count FROM dns GROUP BY 1",
)


_register(
    "metric_formula_mixed",
    SemanticQuery("dns_event", metrics=("mixed",), group_by=("query_hostname",)),
    f"{DNS_SQL} SELECT query_hostname, sum(duration) / nullif(count(*) FILTER (WHERE response_code = 'NXDOMAIN'), 0) + max(duration) / count(*) - (min(duration) - 2) * 3 AS mixed FROM dns GROUP BY 1",
)
_register(
    "metric_last_values",
    SemanticQuery("dns_event", metrics=("last_duration", "dns_query_count"), group_by=("cloud_region",), time_granularity="day"),
    f"{DNS_SQL}, last AS (SELECT date_trunc('day', time)::TIMESTAMP AS time_bucket, cloud_region, source_ip, arg_max(duration, (time, metadata_uid)) AS duration, count(*) AS n FROM dns GROUP BY 1, 2, 3) SELECT time_bucket, cloud_region, sum(duration) AS last_duration, sum(n)::BIGINT AS dns_query_count FROM last GROUP BY 1, 2",
)


@query("metric_semi_additive", f"{DNS_SQL}, last AS (SELECT cloud_region, source_ip, arg_max(duration, (time, metadata_uid)) AS duration FROM dns GROUP BY 1, 2) SELECT cloud_region, sum(duration) AS balance FROM last GROUP BY 1")
def metric_semi_additive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.semi_additive(binding.dns(spark, sf_dir), ["source_ip"], ["cloud_region"], ["time", "metadata_uid"], "duration", "balance")


@query("metric_pack", f"{DNS_SQL} SELECT query_type, count(*) AS event_count, avg(duration) AS avg_duration, count(*) FILTER (WHERE status_id = 1) / count(*) AS success_rate, count(*) FILTER (WHERE status_id = 1) AS success_count, count(status_id) AS total_count, count(*) FILTER (WHERE severity_id >= 4) AS high_severity_count FROM dns GROUP BY 1")
def metric_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.metric_pack(binding.dns(spark, sf_dir), ["query_type"])


@query("event_rate_per_minute", f"{DNS_SQL} SELECT source_ip, count(*) / nullif(date_diff('minute', min(time), max(time)), 0) AS events_per_minute FROM dns GROUP BY 1")
def event_rate_per_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.event_rate(binding.dns(spark, sf_dir), ["source_ip"])


@query("metric_top_n", f"{DNS_SQL} SELECT query_hostname, count(*) AS n FROM dns GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def metric_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.top_values(binding.dns(spark, sf_dir), "query_hostname", 10)


@query("metric_ratio", f"{DNS_SQL} SELECT action, count(*) AS n, count(*) / sum(count(*)) OVER () AS ratio FROM dns GROUP BY 1")
def metric_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.value_ratio(binding.dns(spark, sf_dir), "action")


@query("metric_unique", f"{DNS_SQL} SELECT date_trunc('hour', time)::TIMESTAMP AS time_bucket, count(DISTINCT query_hostname) AS n_unique FROM dns GROUP BY 1")
def metric_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.unique_per_bucket(binding.dns(spark, sf_dir), "query_hostname", "hour")


@query("hierarchy_rollup", "SELECT r_name AS region, n_name AS nation, c_mktsegment AS segment, grouping(r_name, n_name, c_mktsegment)::BIGINT AS level, count(*) AS customers, sum(c_acctbal) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name, c_mktsegment)")
def hierarchy_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: binding.table(spark, sf_dir, name)
    df = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    df = df.select(F.col("r_name").alias("region"), F.col("n_name").alias("nation"), F.col("c_mktsegment").alias("segment"), "c_acctbal")
    return M.hierarchy_rollup(df, ["region", "nation", "segment"], {"customers": F.count("*"), "balance": F.sum("c_acctbal")})


#: Roll-ups of the DNS events, coarse and fine.
ROLLUPS = [
    RollupSpec("by_type_day", "dns_event", ("query_type", "action"), ("dns_query_count", "total_duration", "avg_duration", "min_duration", "nx_rate"), "day"),
    RollupSpec("by_client_hour", "dns_event", ("query_type", "action", "source_ip", "host"), ("dns_query_count", "total_duration", "avg_duration", "min_duration", "max_duration", "nx_rate", "blocked_dns_rate"), "hour"),
    RollupSpec("by_region", "dns_event", ("cloud_region",), ("dns_query_count", "max_duration")),
]


def stored_rollups(spark: SparkSession, sf_dir: str) -> list[StoredRollup]:
    """The roll-ups, written to the shared folder."""
    path, found = shared_folder(spark, "rollups"), []
    for spec in ROLLUPS:
        build_rollup(spec, MODEL, _bind(spark, sf_dir)).write.parquet(f"{path}/{spec.name}")
        table = spark.read.parquet(f"{path}/{spec.name}")
        found.append(StoredRollup(spec, table, table.count()))
    return found


ROUTED = {
    "sq_routed_day": (SemanticQuery("dns_event", metrics=("dns_query_count", "avg_duration", "nx_rate", "min_duration"), group_by=("query_type",), time_granularity="week"), f"{DNS_SQL} SELECT date_trunc('week', time)::TIMESTAMP AS time_bucket, query_type, count(*) AS dns_query_count, avg(duration) AS avg_duration, count(*) FILTER (WHERE response_code = 'NXDOMAIN') / count(*) AS nx_rate, min(duration) AS min_duration FROM dns GROUP BY 1, 2"),
    "sq_routed_hour": (SemanticQuery("dns_event", metrics=("blocked_dns_rate", "distinct_hosts", "max_duration"), group_by=("source_ip",), filters=(Filter("query_type", "in", ["A", "TXT"]),), time_granularity="day", time_range=("2024-01-05T06:00:00", "2024-01-20T17:59:59.999999")), f"{DNS_SQL} SELECT date_trunc('day', time)::TIMESTAMP AS time_bucket, source_ip, avg(CASE WHEN action = 'Blocked' THEN 1.0 ELSE 0.0 END) AS blocked_dns_rate, count(DISTINCT query_hostname) AS distinct_hosts, max(duration) AS max_duration FROM dns WHERE query_type IN ('A', 'TXT') AND time BETWEEN TIMESTAMP '2024-01-05 06:00:00' AND TIMESTAMP '2024-01-20 17:59:59.999999' GROUP BY 1, 2"),
    "sq_routed_events": (SemanticQuery("dns_event", metrics=("dns_query_count", "distinct_hosts"), group_by=("cloud_region",)), f"{DNS_SQL} SELECT cloud_region, count(*) AS dns_query_count, count(DISTINCT query_hostname) AS distinct_hosts FROM dns GROUP BY 1"),
}

for _name, (_query, _sql) in ROUTED.items():
    query(_name, _sql)(lambda spark, sf_dir, q=_query: run_routed(q, MODEL, _bind(spark, sf_dir), stored_rollups(spark, sf_dir)))
