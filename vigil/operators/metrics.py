"""Aggregates beyond the plain six: snapshots, packs, rates, shares and drill-downs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def semi_additive(df: DataFrame, entity_keys: list[str], dims: list[str], time: list[str], value: str, name: str) -> DataFrame:
    """The sum over ``dims`` of each entity's last value; the value is never summed over time."""
    last = df.groupBy(*dims, *entity_keys).agg(F.max_by(value, F.struct(*time)).alias(name))
    return last.groupBy(*dims).agg(F.sum(name).alias(name))


def metric_pack(df: DataFrame, dims: list[str]) -> DataFrame:
    """The standard metrics that the columns at hand allow, in one aggregation."""
    has = set(df.columns)
    found: list[Column] = [F.count("*").alias("event_count")]
    if "duration" in has:
        found.append(F.avg("duration").alias("avg_duration"))
    if "status_id" in has:
        found += [F.try_divide(F.count_if(F.col("status_id") == 1), F.count("*")).alias("success_rate"), F.count_if(F.col("status_id") == 1).alias("success_count"), F.count("status_id").alias("total_count")]
    if "severity_id" in has:
        found.append(F.count_if(F.col("severity_id") >= 4).alias("high_severity_count"))
    if "disposition_id" in has:
        found.append(F.count_if(F.col("disposition_id") == 2).alias("blocked_count"))
    return df.groupBy(*dims).agg(*found)


def minutes_between(start: Column, stop: Column) -> Column:
    """Minute boundaries between two times."""
    at = lambda c: F.unix_timestamp(F.date_trunc("minute", c))
    return ((at(stop) - at(start)) / 60).cast("long")


def event_rate(df: DataFrame, keys: list[str], time: str = "time") -> DataFrame:
    """Events a minute between a key's first and last event; null if they share a minute."""
    found = df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(time).alias("first"), F.max(time).alias("last"))
    return found.select(*keys, F.try_divide("n", F.nullif(minutes_between(F.col("first"), F.col("last")), F.lit(0))).alias("events_per_minute"))


def top_values(df: DataFrame, column: str, n: int) -> DataFrame:
    """The most frequent values, ties in the order of the values."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)


def value_ratio(df: DataFrame, column: str) -> DataFrame:
    """Each value's share of all rows; the total is one row."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select(column, "n", (F.col("n") / F.col("total")).alias("ratio"))


def unique_per_bucket(df: DataFrame, column: str, granularity: str, time: str = "time") -> DataFrame:
    return df.groupBy(F.date_trunc(granularity, time).cast("timestamp_ntz").alias("time_bucket")).agg(F.count_distinct(column).alias("n_unique"))


def hierarchy_rollup(df: DataFrame, levels: list[str], metrics: dict[str, Column]) -> DataFrame:
    """Totals at each level of a drill path; ``level`` has a bit for each level summed away."""
    return df.rollup(*levels).agg(F.grouping_id().alias("level"), *(c.alias(n) for n, c in metrics.items()))
