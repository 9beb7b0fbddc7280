"""SimHash near-duplicates by generalised pigeonhole.

Bits that vary together go to one partition. Partition thresholds t_i add up to radius - partitions + 1, so
that two fingerprints within the radius are within t_i in some partition i. A dynamic programme chooses the
t_i with the least work that a sample of the fingerprints predicts. Each partition is probed with all values
within its threshold, and candidates are verified on all bits. The sample only steers the work; the links
are exact whatever it says.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected
from .shared import Workspace, carried, nothing_kept, restored, text_batches

SEED = 42
#: Fingerprints in the sample that plans the partitions.
PLAN_SAMPLE = 4000
#: Buckets with more fingerprints than this are compared block by block, in tasks of this many a side.
BUCKET = 200


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of each shingle of ``width`` words, A-Z in lower case; a shorter text is one shingle."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    plain, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([hashed(plain, SEED)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    return np.array([hashed(plain[a:b], SEED) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=False)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are set in over half of the hashes."""
    if not len(hashes):
        return 0
    bits = np.zeros(64, np.int64)
    for part in np.array_split(hashes, -(-len(hashes) // 65536)):
        bits += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int, name: str) -> DataFrame:
    """``docs`` with each text's fingerprint as a signed long; a text without words (or null) has fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing_kept()
        for rows in text_batches(batches, "text"):
            found = np.array([majority(shingle_hashes(x or b"", width)) for x in rows.column("text").cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), pa.array(found.view(np.int64))], [*kept, name])

    kept = [c for c in docs.columns if c != name]
    return docs.mapInArrow(run, T.StructType([*(docs.schema[c] for c in kept), T.StructField(name, T.LongType())]))


def plan(sample: np.ndarray, total: int, radius: int) -> list[tuple[list[int], int]]:
    """Bit groups and their thresholds (-1: never probed), by the least predicted work."""
    bits = (sample[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    bits = bits.astype(np.float64)
    centred = bits - bits.mean(0) if len(bits) else bits
    spread = np.sqrt((centred**2).mean(0)) + 1e-9 if len(bits) else np.ones(64)
    linked = np.abs(centred.T @ centred / max(1, len(bits)) / spread[:, None] / spread)
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for m in (2, 3, 4, 6, 8):
        if m > radius + 1:
            continue
        groups = _correlated_groups(linked, m)
        costs = [_costs(sample, g, total, radius) for g in groups]
        # least[s]: of the groups so far, with thresholds plus one adding up to s
        least: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for cost in costs:
            step: dict[int, tuple[float, list[int]]] = {}
            for s, (spent, chosen) in least.items():
                for t, c in enumerate(cost, -1):
                    if s + t + 1 <= radius + 1 and (s + t + 1 not in step or spent + c < step[s + t + 1][0]):
                        step[s + t + 1] = (spent + c, [*chosen, t])
            least = step
        spent, chosen = least[radius + 1]
        if best is None or spent < best[0]:
            best = (spent, list(zip(groups, chosen, strict=True)))
    return best[1] if best else [(list(range(64)), radius)]


def _correlated_groups(linked: np.ndarray, m: int) -> list[list[int]]:
    """Groups of equal size; each grows from a free bit by the bits most correlated with it so far."""
    free, groups = set(range(64)), []
    for i in range(m):
        size = 64 // m + (i < 64 % m)
        group = [min(free)]
        free.remove(group[0])
        while len(group) < size:
            b = max(free, key=lambda x: (linked[x, group].mean(), -x))  # noqa: B023
            group.append(b)
            free.remove(b)
        groups.append(sorted(group))
    return groups


def _costs(sample: np.ndarray, group: list[int], total: int, radius: int) -> list[float]:
    """Predicted work of a group for thresholds -1, 0, 1, ...: probes made and candidates verified."""
    mask = np.uint64(sum(1 << b for b in group))
    part = np.unique(sample)[:2000] & mask
    near = np.zeros(65)
    for block in np.array_split(part, max(1, len(part) // 500)):
        near += np.bincount(np.bitwise_count(block[:, None] ^ part[None, :]).ravel(), minlength=65)
    near[0] -= len(part)
    share = np.cumsum(np.maximum(near, 0)) / max(1, len(part) * (len(part) - 1))
    # where a sample shows no close pair, evenly spread bits are assumed
    even = np.cumsum([comb(len(group), t) for t in range(len(group) + 1)]) / 2.0 ** len(group)
    out = [0.0]
    for t in range(min(radius, len(group)) + 1):
        probes = sum(comb(len(group), k) for k in range(t + 1))
        out.append(4.0 * total * probes if probes <= 5000 else float("inf"))
        out[-1] += float(total) ** 2 / 2 * max(share[t], even[t])
    return out


def _popcount(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(fps: DataFrame, radius: int, work: Workspace) -> DataFrame:
    """Links (a, b) between distinct fingerprints within the radius, enough to connect all that are linked.

    ``fps`` has one row for each distinct ``fp``. Small buckets are joined; in a large one, each task compares
    two blocks and gives only the links of a spanning forest, so that the output grows with the fingerprints.
    """
    total = fps.count()
    share = min(1.0, 2 * PLAN_SAMPLE / max(1, total))
    sample = np.array([r.fp for r in fps.where(F.pmod(F.xxhash64("fp", F.lit(7)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("fp").limit(PLAN_SAMPLE).collect()], np.int64).view(np.uint64)
    chosen = [(g, t) for g, t in plan(sample, total, radius) if t >= 0]
    masks = [_signed(sum(1 << b for b in g)) for g, _ in chosen]
    index = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("part", "key"))
    shifts = F.array(*[F.lit([0, *(_signed(sum(1 << b for b in c)) for k in range(1, t + 1) for c in itertools.combinations(g, k))]) for g, t in chosen])
    moved = index.select("fp", "part", F.col("key").alias("own"), F.explode(F.get(shifts, F.col("part"))).alias("shift"))
    probes = moved.select("fp", "part", F.col("own").bitwiseXOR(F.col("shift")).alias("key"), "own").where(F.col("key") >= F.col("own")).drop("own")
    hot = work.table(index.groupBy("part", "key").count().where(F.col("count") > BUCKET), "hot")
    n_hot = hot.count()
    a, b = index.alias("a"), probes.alias("b")
    if n_hot:
        a = index.join(hot, ["part", "key"], "left_anti").alias("a")
    near = (_popcount(F.col("a.fp"), F.col("b.fp")) <= radius) & (F.col("a.fp") != F.col("b.fp"))
    cold = a.hint("merge").join(b, (F.col("a.part") == F.col("b.part")) & (F.col("a.key") == F.col("b.key")) & near).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    if n_hot:
        return cold.unionByName(_hot_links(index, probes, hot, radius))
    return cold


def _hot_links(index: DataFrame, probes: DataFrame, hot: DataFrame, radius: int) -> DataFrame:
    """Links of large buckets: every block of a bucket's values against every block of what probes it."""
    reached = probes.join(hot, ["part", "key"], "left_semi").groupBy("part", "key").count().withColumnRenamed("count", "n_probes")
    sizes = hot.join(reached, ["part", "key"]).select("part", "key", F.ceil(F.col("count") / BUCKET).alias("rows"), F.ceil(F.col("n_probes") / BUCKET).alias("cols"))
    block = lambda n: F.pmod(F.xxhash64("fp"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    rows = index.join(sizes, ["part", "key"]).select("part", "key", "fp", F.lit(True).alias("own"), block("rows").alias("row"), every("cols").alias("col"))
    cols = probes.join(sizes, ["part", "key"]).select("part", "key", "fp", F.lit(False).alias("own"), block("cols").alias("col"), every("rows").alias("row"))

    def compare(task: pd.DataFrame) -> pd.DataFrame:
        fps = np.unique(task["fp"].to_numpy(np.int64))
        own = np.isin(fps, task.loc[task["own"], "fp"].to_numpy(np.int64))
        left, right = np.flatnonzero(own), np.arange(len(fps))
        near = np.bitwise_count(fps[left][:, None] ^ fps[right][None, :]) <= radius
        root = np.arange(len(fps))
        out: list[tuple[int, int]] = []

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return int(i)

        for i in range(len(left)):
            mates = right[near[i]]
            for j in mates[root[mates] != root[left[i]]].tolist():
                x, y = find(left[i]), find(j)
                if x != y:
                    root[max(x, y)] = min(x, y)
                    out.append((int(fps[left[i]]), int(fps[j])))
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return rows.unionByName(cols).groupBy("part", "key", "row", "col").applyInPandas(compare, "a long, b long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def components(fps: DataFrame, radius: int, work: Workspace) -> DataFrame:
    """(fp, component) of each distinct ``fp``; a component is named by the least ``least`` of its fingerprints."""
    edges = work.table(links(fps.select("fp"), radius, work).distinct(), "links")
    roots = connected(edges, work)
    named = work.table(fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "named")
    least = work.table(named.groupBy("root").agg(F.min("least").alias("component")), "least")
    return work.table(named.join(least, "root").select("fp", "component"), "components")


def near_duplicates(docs: DataFrame, width: int, radius: int, work: Workspace) -> DataFrame:
    """Per document: its fingerprint and its component, named by the smallest doc_id that links reach.

    Equal texts, and texts without words or null, share a fingerprint and so a component. A very long text is hashed
    whole, in a batch of its own. A null doc_id names a component only if no other id does. Repeated rows each get
    their row. An empty table gives no rows; extra columns are ignored.
    """
    of_doc = work.table(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), width, "fp").drop("text"), "fingerprints")
    fps = work.table(of_doc.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = components(fps, radius, work)
    work.keep_only("fingerprints", "components")
    return of_doc.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def one_of_each(docs: DataFrame, width: int, radius: int, work: Workspace) -> DataFrame:
    """One row of ``docs`` of each component, that of the smallest doc_id (null last), with its columns.

    Of rows that share that id, the one that comes first in the written table stays. Null, empty and very long texts
    are fingerprinted as in ``near_duplicates``. An empty table gives no rows. Columns are carried under numbers, so
    their names can't clash.
    """
    rows = work.table(fingerprints(carried(docs, doc_id=F.col("doc_id"), text=F.col("text")), width, "fp").drop("text").withColumn("row", F.monotonically_increasing_id()), "rows")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    fps = work.table(rows.groupBy("fp").agg(F.min(order).alias("least")), "distinct")
    first = work.table(components(fps, radius, work).select(F.col("component.row").alias("row")).distinct(), "first")
    work.keep_only("rows", "first")
    return restored(rows.join(first.hint("merge"), "row", "left_semi"), docs)
