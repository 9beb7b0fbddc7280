"""Comparison of two snapshots by a tree of hashes over ranges of keys: only ranges that differ are read row by row.

A snapshot is written once with its keys in files that are ranges, next to a tree of hashes: leaves are ranges of the key's
hash with the sum of their rows' hashes, inner nodes sum their children. Two trees are compared from the root down; a node
whose hash is equal on both sides ends its branch. What is left are the leaves that differ, and only their rows meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .changes import content_hash

#: Bits of the key's hash that name a leaf, and bits by which a node has children.
LEAF_BITS, STEP_BITS = 12, 4


def _leaf(key: str, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 64 - bits).cast("long")


def write_snapshot(df: DataFrame, path: str, key: str, columns: list[str], bits: int = LEAF_BITS) -> None:
    """(key, content_hash, leaf) to ``path/rows``, in files that are ranges of leaves, and the tree to ``path/tree``."""
    rows = df.select(key, content_hash(columns).alias("content_hash"), _leaf(key, bits).alias("leaf"))
    rows.repartitionByRange("leaf").sortWithinPartitions("leaf", key).write.mode("overwrite").option("parquet.block.size", str(1 << 20)).parquet(f"{path}/rows")
    spark = df.sparkSession
    # sums of hashes are taken modulo 2 ** 64 by parts, as a sum of longs may overflow
    mixed = F.xxhash64(key, "content_hash")
    sums = {"high": F.sum(F.shiftright(mixed, 32)), "low": F.sum(mixed.bitwiseAND(F.lit((1 << 32) - 1)))}
    level = spark.read.parquet(f"{path}/rows").groupBy(F.col("leaf").alias("node")).agg(*(c.alias(n) for n, c in sums.items()), F.count("*").alias("n")).withColumn("depth", F.lit(bits))
    tree = level
    for depth in range(bits - STEP_BITS, -1, -STEP_BITS):
        level = level.groupBy(F.shiftright("node", STEP_BITS).alias("node")).agg(F.sum("high").alias("high"), F.sum("low").alias("low"), F.sum("n").alias("n")).withColumn("depth", F.lit(depth))
        tree = tree.unionByName(level)
    tree.coalesce(1).write.mode("overwrite").partitionBy("depth").parquet(f"{path}/tree")  # at most 2 ** bits leaves


def differing_leaves(spark: SparkSession, old: str, new: str, bits: int = LEAF_BITS) -> list[int]:
    """The leaves whose hashes differ, found from the root down; at most 2 ** bits numbers."""
    a, b = (spark.read.parquet(f"{p}/tree") for p in (old, new))
    open_: list[int] | None = None
    for depth in range(bits % STEP_BITS, bits + 1, STEP_BITS):
        sides = [t.where((F.col("depth") == depth) & (F.lit(True) if open_ is None else F.shiftright("node", STEP_BITS).isin(open_))) for t in (a, b)]
        both = sides[0].alias("a").join(sides[1].alias("b"), "node", "full")
        differs = ~(F.col("a.high").eqNullSafe(F.col("b.high")) & F.col("a.low").eqNullSafe(F.col("b.low")) & F.col("a.n").eqNullSafe(F.col("b.n")))
        open_ = sorted(r.node for r in both.where(differs).select("node").collect())
        if not open_:
            return []
    return open_


def snapshot_changes(spark: SparkSession, old: str, new: str, key: str, bits: int = LEAF_BITS) -> DataFrame:
    """(key, change): keys added, modified or removed between two written snapshots."""
    leaves = differing_leaves(spark, old, new, bits)
    a, b = (spark.read.parquet(f"{p}/rows").where(F.col("leaf").isin(leaves)) for p in (old, new))
    was, now = a.select(key, F.col("content_hash").alias("was")), b.select(key, F.col("content_hash").alias("now"))
    kind = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "modified")
    return was.join(now, key, "full").select(key, kind.alias("change")).where(F.col("change").isNotNull())
