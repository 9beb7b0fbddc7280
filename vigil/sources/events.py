"""Sources and sinks of events and indicators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_events(spark: SparkSession, path: str, fmt: str = "parquet", schema: StructType | str | None = None, **options: str) -> DataFrame:
    """Events from files: parquet, orc, json, csv or text. Give a schema for json and csv, else they are read twice."""
    if fmt not in ("parquet", "orc", "json", "csv", "text"):
        raise ValueError(f"no format {fmt!r}")
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def stream_events(spark: SparkSession, brokers: str, topic: str, **options: str) -> DataFrame:
    """The values of a Kafka topic as a stream of (raw, timestamp); needs the Kafka connector on the class path."""
    stream = spark.readStream.format("kafka").option("kafka.bootstrap.servers", brokers).option("subscribe", topic).options(**options).load()
    return stream.select(F.col("value").cast("string").alias("raw"), "timestamp")


def stream_files(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet", **options: str) -> DataFrame:
    """Files that arrive in a folder, as a stream."""
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


def write_events(df: DataFrame, path: str, time: str = "time", mode: str = "append") -> None:
    """Events by day, in each file ordered by class, so that scans of a time or class skip files and row groups.

    Rows are dealt by day and rebalanced, so that a day with very many events is split over several files.
    """
    dated = df.withColumn("event_date", F.to_date(time))
    dated.hint("rebalance", "event_date").sortWithinPartitions("event_date", "category_uid", "class_uid", time).write.mode(mode).partitionBy("event_date").parquet(path)


def write_observables(df: DataFrame, path: str, mode: str = "append") -> None:
    """Indicators by day, in each file ordered by type and value; the row groups' bounds serve as the index."""
    dated = df.withColumn("event_date", F.to_date("event_time"))
    dated.hint("rebalance", "event_date").sortWithinPartitions("event_date", "type_id", "value").write.mode(mode).partitionBy("event_date").parquet(path)


def hot_rollup(df: DataFrame, fields: list[str]) -> DataFrame:
    """Counts by all mapped fields."""
    return df.groupBy(*fields).agg(F.count("*").alias("event_count"))


def json_path(column: str | Column, path: str) -> Column:
    """A dotted path out of JSON text."""
    return F.get_json_object(column, f"$.{path}")


def array_has(column: str | Column, value: object) -> Column:
    return F.array_contains(column, value)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see; only a local session may do without ``spark.checkpoint.dir``."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
