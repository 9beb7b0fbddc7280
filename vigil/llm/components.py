"""Connected components of a large graph by alternating star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace

#: Each round at least halves the longest paths in practice; a graph that isn't done by then is an error.
MOST_ROUNDS = 60


def connected(edges: DataFrame, work: Workspace) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b); the root is the component's smallest node.

    A large-star step links each node's larger neighbours to the least node it knows, a small-star step the
    smaller ones. Minima are computed apart and written, so that a node with very many neighbours is split
    in the joins. Only two sums a round come to the driver.
    """
    now = work.table(_canonical(edges.where("a <> b")), "edges")
    seen = None
    for _ in range(MOST_ROUNDS):
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if not state.n or (state.n, state.h) == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        seen = (state.n, state.h)
        # large star: a > b in every row
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = work.table(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = work.table(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        # small star
        least = work.table(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        moved = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = work.table(_canonical(moved.unionByName(least.select("a", F.col("m").alias("b")))), "small")
    raise RuntimeError("components did not settle")


def _canonical(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
