"""A registry of a table's partitions from its files alone: sizes, times of change, row counts and bounds.

Sizes and times come from the files' metadata, rows and bounds from the footers of Parquet files, by aggregates that
Spark answers from the footers (``spark.sql.parquet.aggregatePushdown``). No page of data is read.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.sources import folders

PUSHDOWN, READER = "spark.sql.parquet.aggregatePushdown", "spark.sql.sources.useV1SourceList"


@contextmanager
def from_footers(spark: SparkSession):
    """Read Parquet by the reader that answers counts and bounds from the footers, as long as this lasts."""
    before = {k: spark.conf.get(k) for k in (PUSHDOWN, READER)}
    spark.conf.set(PUSHDOWN, "true")
    spark.conf.set(READER, ",".join(x for x in before[READER].split(",") if x.strip() != "parquet"))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def files_of(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, modified) of each data file, from the file system's listing."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    return rows.select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def bounds_of(spark: SparkSession, path: str, by: str, column: str) -> DataFrame:
    """(by, row_count, low, high) of each partition: rows, and bounds of a column, from the footers."""
    return spark.read.parquet(path).groupBy(by).agg(F.count("*").alias("row_count"), F.min(column).alias("low"), F.max(column).alias("high"))


def newest(spark: SparkSession, path: str, column: str):
    """The greatest value of a column of plain type, from the footers."""
    with from_footers(spark):
        return spark.read.parquet(path).agg(F.max(column)).first()[0]


def registry(spark: SparkSession, path: str, table_name: str, by: str = "event_date", ordered: str | None = None) -> DataFrame:
    """One row a partition of a table that is written by ``by``: its files, bytes, last change and rows, whether it has none.

    ``ordered`` names a column whose bounds are given too; footers have them for numbers and dates. The row
    counts are taken while the call lasts and brought to a table of a row a partition.
    """
    value = F.regexp_extract("file", f"{by}=([^/]+)", 1)
    sizes = files_of(spark, path).groupBy(F.when(value != "__HIVE_DEFAULT_PARTITION__", value).alias("partition_key")).agg(F.count("*").alias("n_files"), F.sum("bytes").alias("size_bytes"), F.max("modified").alias("last_modified"))
    with from_footers(spark):
        rows = spark.read.parquet(path)
        more = [F.min(ordered).alias("low"), F.max(ordered).alias("high")] if ordered else []
        counted = rows.groupBy(by).agg(F.count("*").alias("row_count"), *more)
        known = spark.createDataFrame(counted.collect(), counted.schema)  # a row a partition
    key = F.col(by).cast("string")
    found = sizes.join(known.withColumn("k", key), F.col("partition_key").eqNullSafe(F.col("k")), "left")
    extra = ["low", "high"] if ordered else []
    return found.select(F.lit(table_name).alias("table_name"), "partition_key", "n_files", F.coalesce("row_count", F.lit(0)).alias("row_count"), "size_bytes", (F.coalesce("row_count", F.lit(0)) == 0).alias("is_empty"), "last_modified", *extra)


def listed_bytes(spark: SparkSession, path: str) -> int:
    return sum(n for f, n in folders.sizes(spark, path).items() if f.endswith(".parquet"))
