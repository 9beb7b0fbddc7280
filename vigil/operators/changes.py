"""Differences between snapshots, and merges of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _joined(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.withColumn("_in", F.lit(True)).alias("o").join(new.withColumn("_in", F.lit(True)).alias("n"), keys, "full")


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str], compare: list[str]) -> DataFrame:
    """Keys added, removed or modified, and the columns that differ; nulls equal each other."""
    changed = F.array_compact(F.array(*(F.when(~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")), F.lit(c)) for c in compare)))
    both = F.col("o._in").isNotNull() & F.col("n._in").isNotNull()
    kind = F.when(F.col("o._in").isNull(), "added").when(F.col("n._in").isNull(), "removed").when(F.size(changed) > 0, "modified")
    found = _joined(old, new, keys).select(*keys, kind.alias("change"), F.when(both, F.array_join(changed, ",")).otherwise("").alias("reason"))
    return found.where(F.col("change").isNotNull())


def breaking_changes(old: DataFrame, new: DataFrame, keys: list[str], sets: list[str], fixed: list[str]) -> DataFrame:
    """Changes of keyed definitions with a mark: removal of the key, loss of a set's member or a change of a fixed column breaks.

    A set that becomes null has lost all its members; one that was null has none to lose.
    """
    lost = F.lit(False)
    differs = F.lit(False)
    for c in sets:
        was, now = F.col(f"o.{c}"), F.col(f"n.{c}")
        lost = lost | (F.size(F.array_except(was, F.coalesce(now, F.slice(was, 1, 0)))) > 0)
        differs = differs | ~F.sort_array(was).eqNullSafe(F.sort_array(now))
    for c in fixed:
        lost = lost | ~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
        differs = differs | ~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    kind = F.when(F.col("o._in").isNull(), "added").when(F.col("n._in").isNull(), "removed").when(differs, "modified")
    breaks = F.when(kind == "removed", True).when(kind == "modified", F.coalesce(lost, F.lit(False))).otherwise(False)
    return _joined(old, new, keys).select(*keys, kind.alias("change"), breaks.alias("is_breaking")).where(F.col("change").isNotNull())


def version_bump(changes: DataFrame) -> DataFrame:
    """One row: major if anything breaks, minor if anything is added, patch if anything changes, else none."""
    bump = F.when(F.max("is_breaking"), "major").when(F.max(F.col("change") == "added"), "minor").when(F.count("*") > 0, "patch").otherwise("none")
    return changes.agg(bump.alias("bump"), F.count("*").alias("n_changes"))


def content_hash(columns: list[str]) -> Column:
    """A hash of the columns' values; null and empty differ."""
    return F.xxhash64(*(F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in columns))


def content_hash_changes(state: DataFrame, current: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys added, modified or removed since the state (key, content_hash), with the hash now."""
    now = current.select(key, content_hash(columns).alias("now_hash"))
    before = state.select(key, F.col("content_hash").alias("old_hash"))
    kind = F.when(F.col("old_hash").isNull(), "added").when(F.col("now_hash").isNull(), "removed").when(F.col("old_hash") != F.col("now_hash"), "modified")
    return before.join(now, key, "full").select(key, kind.alias("change"), "now_hash").where(F.col("change").isNotNull())


def merge_newest(local: DataFrame, remote: DataFrame, keys: list[str], version: str) -> DataFrame:
    """All keys; a remote row replaces a local one only if its version is greater. Aggregates, so that a key's rows needn't meet first."""
    rows = local.withColumn("_rank", F.lit(1)).unionByName(remote.withColumn("_rank", F.lit(0)))
    rest = [c for c in local.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(version, "_rank")).alias("r"))
    return newest.select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of more than one row, with the number of rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` itself; an error if a key repeats."""
    if found := duplicate_keys(df, keys).head(1):
        raise ValueError(f"the key {found[0].asDict()} repeats")
    return df
