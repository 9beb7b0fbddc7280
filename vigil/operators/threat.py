"""Joins of events with threat feeds, by equality only.

A host matches an indicator if it equals it or ends with a dot and the indicator. Instead of testing each host
with each indicator, the host's suffixes are exploded and joined by equality: a pair meets at most once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.functions.computed import host_suffixes


def keyed_values(events: DataFrame, kind: str, columns: list[str]) -> DataFrame:
    """Distinct values of the matched columns and the indicators that each of them would meet."""
    if kind == "domain":
        return events.select(*columns).distinct().withColumn("indicator", F.explode(host_suffixes(columns[0])))
    return events.select(*columns).distinct().withColumn("indicator", F.explode(F.array_distinct(F.array_compact(F.array(*columns)))))


def ioc_matches(events: DataFrame, feed: DataFrame, kind: str, columns: list[str]) -> DataFrame:
    """(columns, feed columns) of each distinct value that matches an indicator of the kind."""
    return keyed_values(events, kind, columns).join(feed.where(F.col("indicator_type") == kind), "indicator")


def ioc_lookup(events: DataFrame, feed: DataFrame, kind: str | None, columns: list[str] | None = None) -> DataFrame:
    """Events with the feed columns of what they match, null where nothing does; without a kind, every pair.

    The number of rows is that of a left join on the OR of all conditions.
    """
    if kind is None:
        return events.crossJoin(feed)
    hits = ioc_matches(events, feed, kind, columns)
    renamed = hits.select(*(F.col(c).alias(f"matched_{i}") for i, c in enumerate(columns)), *feed.columns)
    condition = F.lit(True)
    for i, c in enumerate(columns):
        condition = condition & F.col(c).eqNullSafe(F.col(f"matched_{i}"))
    return events.join(renamed, condition, "left").select(*events.columns, *feed.columns)


def ioc_match(events: DataFrame, feed: DataFrame, kind: str, columns: list[str]) -> DataFrame:
    """The events that match, with the feed columns."""
    return ioc_lookup(events, feed, kind, columns).where(F.col("indicator").isNotNull())


def ioc_hot_match(observables: DataFrame, feed: DataFrame, view: DataFrame) -> DataFrame:
    """Indicators that equal a feed entry, with their events, by confidence, then time."""
    hits = observables.join(feed, observables["value"] == feed["indicator"])
    found = hits.join(view, hits["event_uid"] == view["metadata_uid"])
    return found.orderBy(F.desc("confidence"), F.desc("event_time"), "observable_id")
