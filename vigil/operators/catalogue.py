"""An index of vectors: inverted lists over cells around centroids, which searches open in part.

Centroids are trained on a bounded sample of rows; every row is assigned to its nearest one. A search opens the lists of the
``probes`` nearest cells of each query. With ``exact`` it goes on to all cells that may hold something nearer than the
k-th found: by the triangle inequality for angles, a cell's rows are no nearer to a query than the query is to the
centroid, less the cell's radius. Long lists are cut into blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .vectors import CORPUS_BLOCK, QUERY_BLOCK, best_of_blocks

#: Rows that centroids are trained on, at most; rounds of training; cells, at most.
SAMPLE, ROUNDS, MOST_CELLS = 20_000, 10, 4_096


@dataclass(frozen=True)
class Cells:
    """Centroids of length one, the largest angle between each and its rows, and its number of rows."""

    centroids: np.ndarray
    radius: np.ndarray
    sizes: np.ndarray


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x**2).sum(1, keepdims=True))
    return np.divide(x, size, out=np.zeros(x.shape), where=size > 0)


def train_cells(corpus: DataFrame, n_cells: int, seed: int = 3) -> np.ndarray:
    """Centroids by k-means over directions, on the at most SAMPLE rows of the smallest hash of their ids."""
    rows = corpus.where("vector IS NOT NULL").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").collect()
    x = _unit(np.array([r.vector for r in rows], float).reshape(len(rows), -1))
    rng = np.random.default_rng(seed)
    n = max(1, min(n_cells, MOST_CELLS, len(x)))
    centroids = x[rng.choice(len(x), n, replace=False)] if len(x) else np.zeros((1, 1))
    for _ in range(ROUNDS):
        own = (x @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        empty = np.bincount(own, minlength=n) == 0
        centroids = np.where(empty[:, None], centroids, _unit(sums))
    return centroids


def build_index(corpus: DataFrame, path: str, n_cells: int) -> None:
    """Write (id, vector, cell) of all rows of ``corpus`` (id, vector) to ``path/lists``, ordered by cell, and the cells to
    ``path/cells``. Null vectors are left out, zero vectors are like any others."""
    spark = corpus.sparkSession
    shared = spark.sparkContext.broadcast(train_cells(corpus, n_cells))  # at most MOST_CELLS centroids

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                near = _unit(np.stack(rows["vector"].to_numpy()).astype(float)) @ shared.value.T
                cell = near.argmax(1)
                yield rows.assign(cell=cell.astype(np.int32), angle=np.arccos(np.clip(near[np.arange(len(cell)), cell], -1, 1)))

    kind = dict(corpus.dtypes)["id"]
    rows = corpus.select("id", F.col("vector").cast("array<double>").alias("vector")).where("vector IS NOT NULL").mapInPandas(assign, f"id {kind}, vector array<double>, cell int, angle double")
    rows.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").write.mode("overwrite").parquet(f"{path}/lists")
    held = spark.read.parquet(f"{path}/lists").groupBy("cell").agg(F.count("*").alias("n_rows"), F.max("angle").alias("radius"))
    centroids = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(shared.value)], "cell int, centroid array<double>")
    centroids.join(held, "cell").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")


def read_cells(spark: SparkSession, path: str) -> tuple[list[int], Cells]:
    rows = sorted(spark.read.parquet(f"{path}/cells").collect(), key=lambda r: r.cell)  # at most MOST_CELLS
    return [r.cell for r in rows], Cells(np.array([r.centroid for r in rows], float), np.array([r.radius for r in rows]), np.array([r.n_rows for r in rows]))


def _compared(asked: DataFrame, path: str, numbers: list[int], cells: Cells, k: int, but_own: bool, kind: str) -> DataFrame:
    """(query_id, id, score): each (id, vector, cell)'s best k of its cell, block by block."""
    spark = asked.sparkSession
    blocks = spark.createDataFrame([(c, max(1, -(-int(n) // CORPUS_BLOCK))) for c, n in zip(numbers, cells.sizes, strict=True)], "cell int, n_blocks long")
    counts = asked.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("n_asked"))
    plan = F.broadcast(blocks.join(counts, "cell"))  # a row a cell
    lists = spark.read.parquet(f"{path}/lists").select("id", "vector", "cell").join(plan, "cell")
    right = lists.select("id", "vector", "cell", F.pmod(F.xxhash64("id"), F.col("n_blocks")).alias("c"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_asked") - 1)).alias("q"))
    left = asked.join(plan, "cell").select("id", "vector", "cell", F.pmod(F.xxhash64("id"), F.col("n_asked")).alias("q"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("c"))
    return left.groupBy("cell", "q", "c").cogroup(right.groupBy("cell", "q", "c")).applyInPandas(best_of_blocks(k, but_own), f"query_id {kind}, id {dict(right.dtypes)['id']}, score double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def search(queries: DataFrame, path: str, k: int, probes: int = 8, exact: bool = False, but_own: bool = False) -> DataFrame:
    """(query_id, rank, id, score) of the k most similar rows that the opened lists hold; with ``exact`` of all rows.

    Queries are (id, vector); those without a vector find nothing.
    """
    spark = queries.sparkSession
    numbers, cells = read_cells(spark, path)
    shared = spark.sparkContext.broadcast((np.array(numbers), cells.centroids, cells.radius))
    kind = dict(queries.dtypes)["id"]
    asked = queries.where("vector IS NOT NULL").select("id", F.col("vector").cast("array<double>").alias("vector"))

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        named, centroids, _ = shared.value
        for rows in batches:
            if len(rows):
                order = np.argsort(-(_unit(np.stack(rows["vector"].to_numpy()).astype(float)) @ centroids.T), axis=1, kind="stable")[:, :probes]
                yield pd.DataFrame({"id": rows["id"].repeat(order.shape[1]), "vector": rows["vector"].repeat(order.shape[1]), "cell": named[order.ravel()].astype(np.int32)})

    first = _ranked(_compared(asked.mapInPandas(near, f"id {kind}, vector array<double>, cell int"), path, numbers, cells, k, but_own, kind), k)
    if not exact:
        return first.select("query_id", "rank", "id", "score")
    last = first.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("least"))
    open_ = asked.join(last, F.col("id") == F.col("query_id"), "left").select("id", "vector", F.coalesce("least", F.lit(-1.0)).alias("least"))

    def rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        named, centroids, radius = shared.value
        for rows in batches:
            if not len(rows):
                continue
            score = _unit(np.stack(rows["vector"].to_numpy()).astype(float)) @ centroids.T
            bound = np.cos(np.maximum(np.arccos(np.clip(score, -1, 1)) - radius, 0))
            seen = np.zeros(score.shape, bool)
            np.put_along_axis(seen, np.argsort(-score, axis=1, kind="stable")[:, :probes], True, 1)
            at, cell = np.nonzero((bound >= rows["least"].to_numpy()[:, None] - 1e-9) & ~seen)
            yield pd.DataFrame({"id": rows["id"].to_numpy()[at], "vector": rows["vector"].to_numpy()[at], "cell": named[cell].astype(np.int32)})

    more = _compared(open_.mapInPandas(rest, f"id {kind}, vector array<double>, cell int"), path, numbers, cells, k, but_own, kind)
    return _ranked(first.select("query_id", "id", "score").unionByName(more), k).select("query_id", "rank", "id", "score")
