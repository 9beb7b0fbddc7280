"""The tables that queries are bound to: a DNS event view over ``events`` and the others as they are."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"
DNS_COLUMNS = [
    "'ev-' || CAST(event_id AS STRING) AS metadata_uid",
    "4003 AS class_uid",
    "4 AS category_uid",
    "ts AS time",
    "'10.0.0.' || CAST(user_id % 20 AS STRING) AS source_ip",
    "CASE WHEN k % 50 = 7 THEN 'n' || CAST(CAST(ts AS DATE) AS STRING) || '.new.example.net' WHEN k % 10 = 0 THEN repeat('a1b2c3d4', 7) || '.' || event_type || '.example.com' ELSE 'h' || CAST(k % 4 AS STRING) || '.' || event_type || '.example.com' END AS query_hostname",
    "CASE k % 5 WHEN 0 THEN 'TXT' WHEN 1 THEN 'AAAA' ELSE 'A' END AS query_type",
    "CASE WHEN event_type = 'error' THEN 'NXDOMAIN' ELSE 'NOERROR' END AS response_code",
    "CASE WHEN event_type = 'signup' THEN 'Blocked' ELSE 'Allowed' END AS action",
    "'region-' || CAST(user_id % 4 AS STRING) AS cloud_region",
    "CASE WHEN k % 3 = 0 THEN NULL ELSE '192.0.2.' || CAST((k * 7 + user_id) % 250 AS STRING) END AS answers_rdata",
    "1 + k % 6 AS severity_id",
    "CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS status_id",
    "value AS duration",
    "k",
]
#: The same view for DuckDB, to begin a statement with.
DNS_SQL = f"WITH dns AS (SELECT {', '.join(DNS_COLUMNS)} FROM (SELECT *, {K} AS k FROM events) e)"
AS_OF_SQL = "(SELECT max(ts) FROM events)"
FEED = [
    ("error.example.com", "domain", "c2", 90, "feed-a"),
    ("h1.view.example.com", "domain", "phishing", 70, "feed-b"),
    ("10.0.0.3", "ip", "scanner", 60, "feed-a"),
    ("192.0.2.17", "ip", "c2", 80, "feed-b"),
]
FEED_COLUMNS = "indicator string, indicator_type string, threat_type string, confidence int, source string"
FEED_SQL = "feed AS (SELECT * FROM (VALUES " + ", ".join(repr(x) for x in FEED) + ") f(indicator, indicator_type, threat_type, confidence, source))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("k", F.expr(K)).selectExpr(*DNS_COLUMNS)


def feed(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FEED, FEED_COLUMNS)


def as_of(spark: SparkSession, sf_dir: str) -> datetime:
    """The time of the last event, so that results don't depend on the clock."""
    return table(spark, sf_dir, "events").agg(F.max("ts")).first()[0]
