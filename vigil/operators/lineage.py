"""Lineage, graph traversal, and the coverage of detections."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.plans.semantic import timestamp
from vigil.sources.events import shared_folder

#: Tactics by the number of a technique, in hundreds.
TACTICS = {0: "initial-access", 1: "execution", 2: "persistence", 3: "privilege-escalation", 4: "defense-evasion", 5: "credential-access", 6: "discovery", 7: "lateral-movement", 8: "collection", 10: "command-and-control", 11: "exfiltration", 12: "impact", 15: "reconnaissance", 16: "resource-development"}


def capture_lineage(df: DataFrame, path: str, source_system: str, source_table: str, target_table: str, fields: list[tuple[str, str, str | None]], at: datetime) -> tuple[DataFrame, DataFrame]:
    """Write a run's rows to ``path`` and give its source and field lineage; the count is observed while writing."""
    from pyspark.sql import Observation

    seen = Observation()
    df.observe(seen, F.count("*").alias("n")).write.mode("append").parquet(path)
    spark, run = df.sparkSession, str(uuid.uuid4())
    source = spark.createDataFrame([(run, source_system, source_table, target_table, seen.get["n"])], "id string, source_system string, source_table string, target_table string, record_count long").withColumn("ingestion_timestamp", timestamp(at))
    field = spark.createDataFrame([(f"{run}-{i}", run, *f) for i, f in enumerate(fields)], "id string, source_lineage_id string, source_field string, target_field string, transformation string")
    return source, field


def _page(df: DataFrame, order: list[str], offset: int, limit: int | None) -> DataFrame:
    """A page in the order given, with the total and whether more follow; the total is one row, counted apart."""
    page = df.orderBy(*order)
    page = page.offset(offset) if offset else page
    page = page.limit(limit) if limit is not None else page
    counted = page.join(F.broadcast(df.agg(F.count("*").alias("total_count"))))
    return counted.withColumn("has_more", F.col("total_count") > offset + (limit if limit is not None else 1 << 60))


def source_lineage(lineage: DataFrame, target: str, start: datetime | None = None, stop: datetime | None = None, offset: int = 0, limit: int | None = None) -> DataFrame:
    """The runs into a target, by time, inclusive bounds."""
    df = lineage.where(F.col("target_table") == target)
    if start is not None:
        df = df.where(F.col("ingestion_timestamp") >= timestamp(start))
    if stop is not None:
        df = df.where(F.col("ingestion_timestamp") <= timestamp(stop))
    return _page(df, ["ingestion_timestamp", "id"], offset, limit)


def field_lineage(fields: DataFrame, sources: DataFrame, target_field: str, start: datetime, stop: datetime, offset: int = 0, limit: int | None = None) -> DataFrame:
    """The field lineage of a target field whose run is in the window; rows without a run are kept."""
    runs = sources.select(F.col("id").alias("source_lineage_id"), F.col("ingestion_timestamp").alias("at"))
    df = fields.where(F.col("target_field") == target_field).join(runs, "source_lineage_id", "left").where(F.col("at").isNull() | F.col("at").between(timestamp(start), timestamp(stop)))
    return _page(df.drop("at"), ["id"], offset, limit)


def lineage_graph(lineage: DataFrame, target: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Distinct nodes, sources named system:table, and an edge for each run."""
    if target is not None:
        lineage = lineage.where(F.col("target_table") == target)
    name = F.concat_ws(":", "source_system", "source_table")
    nodes = lineage.select(name.alias("node"), F.lit("source").alias("kind")).unionByName(lineage.select(F.col("target_table").alias("node"), F.lit("target").alias("kind"))).distinct()
    return nodes, lineage.select(name.alias("source"), F.col("target_table").alias("target"), "ingestion_timestamp", "record_count")


def connected_nodes(edges: DataFrame, start: list[str], max_depth: int = 2, types: list[str] | None = None) -> DataFrame:
    """Nodes within ``max_depth`` hops, edges followed both ways, with the hop that reaches them first.

    Each hop joins the new nodes with the edges and leaves out those seen; it is written, so that plans don't grow.
    """
    spark = edges.sparkSession
    if types is not None:
        edges = edges.where(F.col("edge_type").isin(types))
    both = edges.select(F.col("source").alias("a"), F.col("target").alias("b")).unionByName(edges.select(F.col("target").alias("a"), F.col("source").alias("b"))).distinct()
    folder = shared_folder(spark, "hops")
    seen = spark.createDataFrame([(n, 0) for n in start], "node string, depth int")
    new = seen
    for depth in range(1, max_depth + 1):
        hop = new.join(both, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth))
        hop.write.parquet(f"{folder}/{depth}")
        new = spark.read.schema("node string, depth int").parquet(f"{folder}/{depth}")
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
    return seen


def _active(tables: DataFrame, column: str, name: str) -> DataFrame:
    return tables.where("is_active").select("table_name", F.explode(F.array_distinct(F.col(f"detection_coverage.{column}"))).alias(name))


def _count_and_list(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("table_count"), F.sort_array(F.collect_list("table_name")).alias("tables"))


def coverage_by_technique(tables: DataFrame) -> DataFrame:
    return _count_and_list(_active(tables, "mitre_techniques", "technique"), "technique")


def coverage_by_data_source(tables: DataFrame) -> DataFrame:
    return _count_and_list(_active(tables, "data_sources", "data_source"), "data_source")


def coverage_by_tactic(tables: DataFrame) -> DataFrame:
    tactics = tables.where("is_active").select("table_name", F.explode(F.array_distinct("detection_coverage.mitre_tactics")).alias("tactic"), F.col("detection_coverage.mitre_techniques").alias("t"))
    pairs = tactics.select("tactic", "table_name", F.explode_outer("t").alias("technique"))
    return pairs.groupBy("tactic").agg(F.count_distinct("technique").alias("technique_count"), F.count_distinct("table_name").alias("table_count"))


def coverage_by_kill_chain(tables: DataFrame) -> DataFrame:
    return _active(tables, "kill_chain_phases", "phase").groupBy("phase").agg(F.count("*").alias("table_count"))


def tactic_of(technique: Column) -> Column:
    """The tactic by the technique's number, unknown if the ranges don't have it."""
    number = F.regexp_extract(technique, r"^T*(\d+)", 1).try_cast("int")
    table = F.create_map(*(F.lit(x) for pair in TACTICS.items() for x in pair))
    return F.coalesce(F.when(number > 0, F.try_element_at(table, F.floor(number / 100).cast("int"))), F.lit("unknown"))


def coverage_matrix(tables: DataFrame, tactic_map: DataFrame | None = None) -> DataFrame:
    """A row for each tactic with its title and the techniques covered; give (technique, tactic) to replace the ranges."""
    cells = coverage_by_technique(tables)
    cells = cells.join(tactic_map, "technique", "left").withColumn("tactic", F.coalesce("tactic", F.lit("unknown"))) if tactic_map is not None else cells.withColumn("tactic", tactic_of(F.col("technique")))
    listed = cells.groupBy("tactic").agg(F.sort_array(F.collect_list(F.struct("technique", "table_count"))).alias("cells"))
    title = F.array_join(F.transform(F.split("tactic", "-"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " ")
    return listed.select("tactic", title.alias("name"), F.size("cells").alias("technique_count"), F.transform("cells", lambda c: c["technique"]).alias("techniques"))


def tables_covering(tables: DataFrame, technique: str | None = None, tactic: str | None = None) -> DataFrame:
    column, value = ("mitre_techniques", technique) if technique is not None else ("mitre_tactics", tactic)
    return tables.where(F.col("is_active") & F.array_contains(F.col(f"detection_coverage.{column}"), value))


def tables_by_class(tables: DataFrame, class_uid: int) -> DataFrame:
    return tables.where(F.col("is_active") & (F.col("class_uid") == class_uid))
