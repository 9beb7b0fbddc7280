"""Nearest neighbours by vantage-point trees, one for each shard of the vectors.

A tree's node keeps a vector and the median distance to it; nearer vectors go to one side, farther ones to
the other. The triangle inequality bounds how near a side can be. A side is left out if its bound times
``factor`` is beyond the k-th nearest found so far: 1 gives exact results, more leaves out more.

Shards are the leaves of such a tree too: a top tree over a bounded sample, down which every vector is routed. A leaf
keeps the least and largest distance of its vectors to the vantage points above it. A query first searches the leaf
that it falls into; its k-th nearest there then leaves out all other leaves that the same bound rules out. A crowded leaf is
split into shells by the distance to its last vantage point; each shell keeps its own bounds for all points above it, so
shells are left out one by one. Only a shell that is still crowded, as by equal vectors, is split by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Workspace

#: Vectors in a shard, on average; queries that one task answers; vectors in a leaf.
SHARD, QUERY_BLOCK, LEAF = 16_384, 2_048, 128
#: Leaves of the top tree at most, and vectors in the sample for each of them. The sample only shapes the tree: every
#: vector is routed and searched.
TOP_LEAVES, SAMPLE_EACH = 512, 8
#: Shells of a leaf at most, and parts of one that rows are dealt to.
SHELLS, PARTS = 64, 1 << 24
SHARDS = "dim int, leaf int, shard int, rows array<long>, ids array<long>, point array<int>, points binary, nodes binary, order array<int>"
FOUND = "row long, query_id long, vec_id long, score double"
NODE = np.dtype([("at", "<i4"), ("middle", "<f8"), ("inner", "<i4"), ("outer", "<i4"), ("start", "<i4"), ("stop", "<i4")])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances between rows, in double precision, by differences."""
    out = np.empty((len(a), len(b)))
    step = max(1, (1 << 21) // max(1, b.size))
    for i in range(0, len(a), step):
        out[i : i + step] = np.sqrt(((a[i : i + step, None, :] - b[None, :, :]) ** 2).sum(-1))
    return out


def build(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the order in which leaves list the points. A leaf has at = -1."""
    nodes, order, listed = [], [], 0
    rng = np.random.default_rng(0)
    stack: list[tuple[np.ndarray, int, str]] = [(np.arange(len(points)), -1, "")]
    while stack:
        mine, parent, side = stack.pop()
        here = len(nodes)
        if parent >= 0:
            nodes[parent][side] = here
        if len(mine) <= LEAF:
            nodes.append({"at": -1, "middle": 0.0, "inner": -1, "outer": -1, "start": listed, "stop": listed + len(mine)})
            order.append(mine)
            listed += len(mine)
            continue
        pick = int(rng.integers(len(mine)))
        rest = np.delete(mine, pick)
        away = distances(points[mine[pick]][None], points[rest])[0]
        middle = float(np.median(away))
        inside = away <= middle
        nodes.append({"at": int(mine[pick]), "middle": middle, "inner": -1, "outer": -1, "start": 0, "stop": 0})
        stack.append((rest[inside], here, "inner"))
        stack.append((rest[~inside], here, "outer"))
    table = np.array([tuple(n[k] for k in NODE.names) for n in nodes], NODE)
    return table, np.concatenate(order) if order else np.zeros(0, np.int64)


class Shard:
    """A tree over the distinct vectors of a shard; each vector lists its rows of the smallest ids."""

    def __init__(self, ids: np.ndarray, point: np.ndarray, points: np.ndarray, nodes: np.ndarray, order: np.ndarray, rows: np.ndarray | None = None):
        self.points, self.nodes, self.order = points, nodes, order
        self.sizes = (points**2).sum(1)
        by = np.argsort(point, kind="stable")
        self.ids, self.first = ids[by], np.searchsorted(point[by], np.arange(len(points) + 1))
        self.rows = self.ids if rows is None else rows[by]

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, factor: float, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Distances and ids of the k nearest rows to each query but its own row, by distance, then id; of those beyond
        ``bound`` only as many as are met on the way."""
        none = np.iinfo(np.int64).max
        self.best = np.full((len(queries), k), np.inf)
        self.bound = np.full(len(queries), np.inf) if bound is None else bound
        self.found = np.full((len(queries), k), none)
        self.queries, self.own, self.factor = queries, own, factor
        self.home = np.full(len(queries), -1)
        if len(self.nodes) and len(queries):
            self._descend(0, np.arange(len(queries)))
            self._visit(0, np.arange(len(queries)))
        return self.best, self.found

    def _reach(self, q: np.ndarray) -> np.ndarray:
        """The distance beyond which nothing can be among the k nearest."""
        return np.minimum(self.best[q, -1], self.bound[q])

    def _near(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Distances of those pairs that a product of matrices, with a margin for its rounding, can't rule out; else infinity."""
        asked, points = self.queries[q], self.points[at]
        sizes = (asked**2).sum(1)[:, None] + self.sizes[at]
        row, column = np.nonzero(sizes - 2 * (asked @ points.T) <= self._reach(q)[:, None] ** 2 + 1e-11 * sizes)
        out = np.full((len(q), len(at)), np.inf)
        for i in range(0, len(row), 1 << 15):
            r, c = row[i : i + (1 << 15)], column[i : i + (1 << 15)]
            out[r, c] = np.sqrt(((asked[r] - points[c]) ** 2).sum(-1))
        return out

    def _offer(self, q: np.ndarray, at: np.ndarray, away: np.ndarray) -> None:
        finite = np.flatnonzero(np.isfinite(away).any(0))
        at, away = at[finite], away[:, finite]
        counts = self.first[at + 1] - self.first[at]
        column = np.repeat(np.arange(len(at)), counts)
        place = np.repeat(self.first[at] - (np.cumsum(counts) - counts), counts) + np.arange(len(column))
        ids = self.ids[place]
        away = np.where(self.rows[place][None, :] == self.own[q][:, None], np.inf, away[:, column])
        some = np.flatnonzero((away <= self.best[q, -1][:, None]).any(1))
        if not len(some):
            return
        q, away = q[some], away[some]
        useful = np.flatnonzero((away <= self.best[q, -1][:, None]).any(0))
        away, ids = away[:, useful], ids[useful]
        k = self.best.shape[1]
        d = np.concatenate([self.best[q], away], 1)
        i = np.concatenate([self.found[q], np.broadcast_to(ids, away.shape)], 1)
        first = np.lexsort((i, d), axis=1)[:, :k]
        self.best[q], self.found[q] = np.take_along_axis(d, first, 1), np.take_along_axis(i, first, 1)

    def _gap(self, node: np.void, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        away = distances(self.queries[q], self.points[[node["at"]]])
        return away, away[:, 0] - node["middle"]

    def _leaf(self, node: np.void, q: np.ndarray) -> None:
        at = self.order[node["start"] : node["stop"]]
        if len(at) and len(q):
            self._offer(q, at, self._near(q, at))

    def _descend(self, n: int, q: np.ndarray) -> None:
        """Each query to the one leaf on its side of all nodes, for a first bound; queries go together."""
        node = self.nodes[n]
        if not len(q):
            return
        if node["at"] < 0:
            self.home[q] = n
            self._leaf(node, q)
            return
        inside = self._gap(node, q)[1] <= 0
        self._descend(node["inner"], q[inside])
        self._descend(node["outer"], q[~inside])

    def _visit(self, n: int, q: np.ndarray) -> None:
        """All other leaves that a query's bound doesn't rule out; every node is entered once, by all its queries."""
        node = self.nodes[n]
        if not len(q):
            return
        if node["at"] < 0:
            self._leaf(node, q[self.home[q] != n])
            return
        away, gap = self._gap(node, q)
        self._offer(q, np.array([node["at"]]), away)
        for child, bound in (("inner", gap), ("outer", -gap)):
            # the margin covers rounding
            self._visit(node[child], q[bound * self.factor <= self._reach(q) * (1 + 1e-12) + 1e-12])


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, dim) of rows with an id and a vector that isn't null, empty, zero, or partly null or not finite."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.col("vec_id").isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)
    return vectors.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda x: x + F.lit(0.0)).alias("v"))


class Top:
    """The top tree over vectors of one dimension: vantage points, medians, and leaves with the points above them."""

    def __init__(self, sample: np.ndarray, leaves: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.points: list[np.ndarray] = []
        self.middles: list[float] = []
        self.children: list[list[int]] = []  # of each point: the node inside and outside; a leaf is -1 - its number
        self.paths: list[list[int]] = []

        def grow(mine: np.ndarray, leaves: int, path: list[int]) -> int:
            away = distances(mine[rng.integers(len(mine))][None], mine)[0] if leaves > 1 and len(mine) > 1 else np.zeros(0)
            if not away.any():
                self.paths.append(path)
                return -len(self.paths)
            here, middle = len(self.points), float(np.median(away))
            inside = away <= middle
            if inside.all():  # at least half are equally far
                inside = away < middle
            self.points.append(mine[int(away.argmin())])
            self.middles.append(float(away[inside].max()))
            self.children.append([0, 0])
            self.children[here] = [grow(mine[inside], leaves // 2, [*path, here]), grow(mine[~inside], leaves - leaves // 2, [*path, here])]
            return here

        self.root = grow(sample, leaves, [])

    def away(self, vectors: np.ndarray) -> np.ndarray:
        """Distances to all vantage points."""
        return distances(vectors, np.stack(self.points)) if self.points else np.zeros((len(vectors), 0))

    def route(self, vectors: np.ndarray) -> tuple[np.ndarray, list[list[float]]]:
        """The leaf of each vector, and its distances to the vantage points above, node by node."""
        at, away = np.full(len(vectors), self.root), [[] for _ in range(len(vectors))]
        while (some := np.flatnonzero(at >= 0)).size:
            for node in np.unique(at[some]).tolist():
                mine = some[at[some] == node]
                far = distances(vectors[mine], self.points[node][None])[:, 0]
                for i, x in zip(mine.tolist(), far.tolist(), strict=True):
                    away[i].append(x)
                at[mine] = np.array(self.children[node])[(far > self.middles[node]).astype(int)]
        return -1 - at, away

    def bounds(self, away: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """How near each query can be to each leaf's vectors, of which ``low`` and ``high`` hold the distances."""
        if not self.points:
            return np.zeros((len(away), len(low)))
        out = np.zeros((len(away), len(low)))
        for leaf, path in enumerate(self.paths):
            if path:
                out[:, leaf] = np.maximum(low[leaf, path] - away[:, path], away[:, path] - high[leaf, path]).max(1)
        return np.maximum(out, 0)


def tops(rows: DataFrame, n: int) -> dict[int, Top]:
    """The top tree of each dimension, from at most TOP_LEAVES * SAMPLE_EACH rows of the smallest hashes."""
    leaves = min(TOP_LEAVES, max(1, -(-n // SHARD)))
    sample = rows.orderBy(F.xxhash64("row", F.lit(3)), "row").limit(leaves * SAMPLE_EACH).select("dim", "v").collect() if leaves > 1 else []
    by: dict[int, list] = {}
    for r in sample:
        by.setdefault(r.dim, []).append(r.v)
    return {d: Top(np.array(v), leaves) for d, v in by.items()}


def index(routed: DataFrame, k: int) -> DataFrame:
    """The shards' trees."""

    def make(group: pd.DataFrame) -> pd.DataFrame:
        every = np.stack(group["v"].to_numpy()).astype(np.float64)
        points, point = np.unique(every, axis=0, return_inverse=True)
        ids, rows, point = group["vec_id"].to_numpy(np.int64), group["row"].to_numpy(np.int64), point.reshape(-1)
        by = np.lexsort((rows, ids, point))
        ids, rows, point = ids[by], rows[by], point[by]
        # of equal vectors only the k + 1 smallest ids can be among a query's nearest, its own row left out
        keep = np.arange(len(point)) - np.searchsorted(point, point) <= k
        nodes, order = build(points)
        first = group.iloc[:1]
        return pd.DataFrame({"dim": first["dim"], "leaf": first["leaf"], "shard": first["shard"], "rows": [rows[keep]], "ids": [ids[keep]], "point": [point[keep].astype(np.int32)], "points": [points.tobytes()], "nodes": [nodes.tobytes()], "order": [order.astype(np.int32)]})

    return routed.groupBy("dim", "leaf", "shard").applyInPandas(make, SHARDS)


def _dealt(routed: DataFrame) -> DataFrame:
    """``routed`` with a shard: the shell of its leaf by the distance to the last vantage point, and a part of a crowded shell."""
    last = F.when(F.size("away") > 0, F.element_at("away", -1))
    leaves = routed.groupBy("dim", "leaf").agg(F.least(F.ceil(F.count("*") / SHARD), F.lit(SHELLS)).alias("shells"), F.percentile_approx(last, [i / SHELLS for i in range(1, SHELLS)], 10_000).alias("cuts"))
    place = F.size(F.filter(F.coalesce("cuts", F.array().cast("array<double>")), lambda c: c < last))
    shelled = routed.join(leaves, ["dim", "leaf"]).withColumn("shell", F.floor(F.when(last.isNull(), 0).otherwise(place) * F.col("shells") / SHELLS)).drop("cuts", "shells")
    parts = shelled.groupBy("dim", "leaf", "shell").agg(F.ceil(F.count("*") / SHARD).alias("parts"))
    part = F.pmod(F.xxhash64("row", F.lit(1)), F.col("parts"))
    return shelled.join(parts, ["dim", "leaf", "shell"]).withColumn("shard", (F.col("shell") * PARTS + part).cast("int")).drop("shell", "parts")


def _limits(dealt: DataFrame) -> DataFrame:
    """(dim, leaf, shard, limits): the least and largest distances of a shard's vectors to the vantage points above."""
    each = dealt.select("dim", "leaf", "shard", F.posexplode_outer("away").alias("place", "far")).groupBy("dim", "leaf", "shard", "place").agg(F.min("far").alias("low"), F.max("far").alias("high"))
    return each.groupBy("dim", "leaf", "shard").agg(F.sort_array(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", "low", "high")))).alias("limits"))


def _searched(asked: DataFrame, trees: DataFrame, shards: DataFrame, k: int, factor: float, work: Workspace) -> DataFrame:
    """(row, query_id, vec_id, score) of queries (row, vec_id, v, dim, leaf, bound, away) in the shards of their leaf that
    their bounds allow; if ``home`` is true in their ``shard`` alone, else in all but that."""
    gap = lambda x: F.greatest(x["low"] - F.get("away", x["place"]), F.get("away", x["place"]) - x["high"])
    excluded = F.exists("limits", lambda x: gap(x) * factor > F.col("bound") * (1 + 1e-12) + 1e-12)
    met = asked.withColumnRenamed("shard", "own").join(shards, ["dim", "leaf"])
    pairs = work.table(met.where(F.when(F.col("home"), F.col("own") == F.col("shard")).otherwise((F.col("own") != F.col("shard")) & ~excluded)).select("row", "vec_id", "v", "dim", "leaf", "shard", "bound"), "pairs")
    counts = work.table(pairs.groupBy("dim", "leaf", "shard").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("blocks")), "blocks")
    left = pairs.join(counts, ["dim", "leaf", "shard"]).withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks"))).drop("blocks")
    right = trees.join(counts, ["dim", "leaf", "shard"]).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")

    def search(queries: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(tree):
            return pd.DataFrame({c: [] for c in ("row", "query_id", "vec_id", "score")}).astype({"row": "int64", "query_id": "int64", "vec_id": "int64"})
        t = tree.iloc[0]
        shard = Shard(np.asarray(t["ids"]), np.asarray(t["point"]), np.frombuffer(t["points"]).reshape(-1, int(t["dim"])), np.frombuffer(t["nodes"], NODE), np.asarray(t["order"]), np.asarray(t["rows"]))
        own = queries["row"].to_numpy(np.int64)
        best, found = shard.search(np.stack(queries["v"].to_numpy()).astype(np.float64), own, k, factor, queries["bound"].to_numpy(np.float64))
        q, r = np.nonzero(np.isfinite(best))
        return pd.DataFrame({"row": own[q], "query_id": queries["vec_id"].to_numpy(np.int64)[q], "vec_id": found[q, r], "score": best[q, r]})

    key = ["dim", "leaf", "shard", "block"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(search, FOUND)


def nearest(vectors: DataFrame, work: Workspace, k: int = 10, every: int = 100, factor: float = 1.0) -> DataFrame:
    """Each query's k nearest by Euclidean distance, ties to the smaller id; queries are ids divisible by ``every``.

    Rows without an id and vectors that ``usable`` leaves out take no part. Every row is a candidate but the query's
    own, also rows that repeat it; each row of a query's id is a query of its own. Vectors meet only those of equal
    dimension. An empty table gives no rows; extra columns are ignored.
    """
    rows = work.table(usable(vectors).withColumn("dim", F.size("v")).withColumn("row", F.monotonically_increasing_id()), "vectors")
    top = rows.sparkSession.sparkContext.broadcast(tops(rows, rows.count()))  # its size is bounded by the sample

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            leaf = np.zeros(len(batch), np.int32)
            away: list[list[float]] = [[]] * len(batch)
            for d, at in batch.groupby("dim").indices.items():
                if d in top.value:
                    leaf[at], found = top.value[d].route(np.stack(batch["v"].to_numpy()[at]))
                    for i, x in zip(at, found, strict=True):
                        away[i] = x
            yield batch.assign(leaf=leaf, away=away)

    routed = work.table(rows.mapInPandas(route, "vec_id long, v array<double>, dim int, row long, leaf int, away array<double>"), "routed")
    dealt = work.table(_dealt(routed), "dealt")
    trees = work.table(index(dealt.drop("away"), k), "trees")
    shards = work.table(_limits(dealt), "shards")
    # at most TOP_LEAVES leaves of a dimension, a few dozen vantage points above each
    ends = shards.select("dim", "leaf", F.inline("limits")).groupBy("dim", "leaf", "place").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()
    limits: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for d, t in top.value.items():
        limits[d] = np.full((len(t.paths), len(t.points)), np.inf), np.full((len(t.paths), len(t.points)), -np.inf)
    for r in ends:
        point = top.value[r.dim].paths[r.leaf][r.place]
        limits[r.dim][0][r.leaf, point], limits[r.dim][1][r.leaf, point] = r.low, r.high
    bounds = rows.sparkSession.sparkContext.broadcast(limits)

    asked = dealt.where(F.col("vec_id") % every == 0).withColumn("home", F.lit(True))
    home = work.table(_searched(asked.withColumn("bound", F.lit(float("inf"))), trees, shards, k, factor, work), "home")
    # the k-th nearest at home, if there are so many
    kth = home.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy("score"))).where(F.col("rank") == k).select("row", F.col("score").alias("bound"))
    asked = asked.join(kth, "row", "left").withColumns({"bound": F.coalesce("bound", F.lit(float("inf"))), "home": F.lit(False)})

    def others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for d, at in batch.groupby("dim").indices.items():
                if d not in top.value:
                    continue
                mine = batch.iloc[at]
                away = top.value[d].away(np.stack(mine["v"].to_numpy()))
                near = top.value[d].bounds(away, *bounds.value[d]) * factor <= mine["bound"].to_numpy()[:, None] * (1 + 1e-12) + 1e-12
                near[np.arange(len(mine)), mine["leaf"].to_numpy()] = False
                q, leaf = np.nonzero(near)
                paths = top.value[d].paths
                yield mine.iloc[q].assign(leaf=leaf.astype(np.int32), shard=np.full(len(q), -1, np.int32), away=[away[i, paths[x]].tolist() for i, x in zip(q, leaf, strict=True)])

    columns = ["row", "vec_id", "v", "dim", "leaf", "bound", "away", "shard", "home"]
    away = asked.select(columns).mapInPandas(others, "row long, vec_id long, v array<double>, dim int, leaf int, bound double, away array<double>, shard int, home boolean")
    found = work.table(home.unionByName(_searched(asked.select(columns).unionByName(away), trees, shards, k, factor, work)), "found")
    work.keep_only("found")
    rank = F.row_number().over(Window.partitionBy("row", "query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
