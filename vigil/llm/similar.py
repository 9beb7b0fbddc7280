"""Near copies by exact similarity: the share of their shingles that two texts have in common.

Candidates are SimHash links and pairs that share a band of min-hashes. Bands alone leave out one pair in
10,000 at similarity 0.8 and fewer above. Every candidate is confirmed by the two whole shingle sets, and only
confirmed pairs form components. In each band's bucket all texts are first held against one; where that leaves
a bucket in several components, all its pairs across components are compared, block by block in a large one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected
from .fingerprints import BUCKET, SEED, links, majority, shingle_hashes
from .shared import Workspace, carried, nothing_kept, restored, text_batches

#: A band is shared with probability s^ROWS at similarity s, one of all with 1 - (1 - s^ROWS)^BANDS.
BANDS, ROWS = 32, 6
#: Pairs of so many bands are confirmed first; of the others' only those that these leave in different components.
FIRST_BANDS = 4
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bands(shingles: np.ndarray) -> np.ndarray:
    """One key for each band of a shingle set's min-hashes; none for the empty set."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for part in np.array_split(shingles, -(-len(shingles) // 2048)):
        np.minimum(least, (_FACTORS[:, None] * part).min(1), out=least)
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Shared shingles over all shingles of two sorted sets; two empty sets are equal."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    few, many = sorted((len(a), len(b)))
    return few >= least * many * (1 - 1e-9) and similarity(a, b) >= least


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """``docs`` with ``node`` (a hash of the shingle set), ``fp`` (the SimHash fingerprint) and ``bands``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing_kept()
        for rows in text_batches(batches, "text"):
            nodes, fps, keys = [], [], []
            for x in rows.column("text").cast(pa.binary()).to_pylist():
                found = shingle_hashes(x or b"", width)
                fps.append(majority(found))
                found = np.unique(found)
                nodes.append(xxhash.xxh64_intdigest(found.tobytes(), SEED))
                keys.append(bands(found))
            signed = lambda v: pa.array(np.array(v, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*rows.columns, signed(nodes), signed(fps), pa.array(keys, pa.list_(pa.int64()))], names)

    names = [*docs.columns, "node", "fp", "bands"]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("node", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))]))


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of (node, text): the sorted shingle set as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing_kept()
        for rows in text_batches(batches, "text"):
            found = [np.unique(shingle_hashes(x or b"", width)).tobytes() for x in rows.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_pydict({"node": rows.column("node"), "shingles": pa.array(found, pa.binary())})

    return texts.select("node", "text").mapInArrow(run, "node long, shingles binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose shingle sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            sides = zip(rows.column("left").to_pylist(), rows.column("right").to_pylist(), strict=True)
            good = [_similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), least) for x, y in sides]
            yield rows.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    of = lambda end, side: sets.select(F.col("node").alias(end), F.col("shingles").alias(side))
    return pairs.join(of("a", "left"), "a").join(of("b", "right"), "b").select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def _across(members: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Confirmed pairs that join components within buckets. ``members``: key, node, root, n (the bucket's size)."""

    def compare(task: pd.DataFrame) -> pd.DataFrame:
        task = task.drop_duplicates(["node", "block"])
        nodes, blocks = task["node"].to_numpy(np.int64), task["block"].to_numpy(np.int64)
        held = [np.frombuffer(x, np.uint64) for x in task["shingles"]]
        root = {x: x for x in task["root"].to_numpy(np.int64).tolist()}
        of = task["root"].to_numpy(np.int64).tolist()
        one = int(task["row"].iloc[0]) == int(task["col"].iloc[0])
        out: list[tuple[int, int]] = []

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for i in range(len(nodes)):
            for j in range(i):
                if (one or blocks[i] != blocks[j]) and (x := find(of[i])) != (y := find(of[j])) and _similar(held[i], held[j], least):
                    root[max(x, y)] = min(x, y)
                    out.append((int(nodes[i]), int(nodes[j])))
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    count = F.ceil(F.col("n") / BUCKET)
    block = F.pmod(F.xxhash64("node"), count)
    other = F.explode(F.sequence(F.lit(0).cast("long"), count - 1))
    dealt = members.select("key", "node", "root", block.alias("block"), other.alias("other"))
    dealt = dealt.select("key", "node", "root", "block", F.least("block", "other").alias("row"), F.greatest("block", "other").alias("col"))
    return dealt.join(sets, "node").groupBy("key", "row", "col").applyInPandas(compare, "a long, b long")


def _roots(nodes: DataFrame, pairs: DataFrame, work: Workspace) -> DataFrame:
    roots = connected(pairs, work)
    return work.table(nodes.join(roots, "node", "left").select(*nodes.columns, F.coalesce("root", "node").alias("root")), "roots")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends are in different components so far; to confirm the others would change nothing."""
    end = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    return pairs.join(end("a"), "a").join(end("b"), "b").where("a_root <> b_root").select("a", "b")


def _joined_roots(roots: DataFrame, pairs: DataFrame, work: Workspace) -> DataFrame:
    """``roots`` after further confirmed pairs; only the components that these join are gone through again."""
    end = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    between = pairs.join(end("a"), "a").join(end("b"), "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).where("a <> b").distinct()
    over = connected(between, work).select(F.col("node").alias("root"), F.col("root").alias("over"))
    return work.table(roots.join(over, "root", "left").select("node", F.coalesce("over", "root").alias("root")), "roots")


def one_of_each(docs: DataFrame, width: int, radius: int, least: float, work: Workspace) -> DataFrame:
    """One row of ``docs`` of each group that pairs of similarity ``least`` connect, that of the smallest doc_id
    (null last), with its columns.

    Of rows that share that id, the one that comes first in the written table stays. Texts without words or null are
    equal to each other. A very long text is hashed whole, in a batch of its own. An empty table gives no rows.
    Columns are carried under numbers, so their names can't clash.
    """
    own = carried(docs, doc_id=F.col("doc_id"), text=F.col("text"))
    rows = work.table(signatures(own, width).withColumn("row", F.monotonically_increasing_id()), "rows")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    nodes = work.table(rows.groupBy("node").agg(F.min(order).alias("first"), F.min("fp").alias("fp"), F.first("bands").alias("bands")), "nodes")
    plain = nodes.select("node", "first")

    places = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    buckets = work.table(places.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("one")).where("n > 1"), "buckets")
    members = work.table(places.join(buckets, "key"), "members")
    stars = work.table(members.where("node <> one").groupBy(F.col("node").alias("a"), F.col("one").alias("b")).agg(F.min("band").alias("band")), "stars")

    leaders = work.table(nodes.groupBy("fp").agg(F.min("node").alias("one")), "leaders")
    linked = work.table(links(leaders.select("fp"), radius, work).distinct(), "links")
    end = lambda c: leaders.select(F.col("fp").alias(c), F.col("one").alias(f"{c}_node"))
    linked = linked.join(end("a"), "a").join(end("b"), "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    same = nodes.join(leaders, "fp").where("node <> one").select(F.col("node").alias("a"), F.col("one").alias("b"))
    linked = linked.unionByName(same).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    linked = work.table(linked.join(stars, ["a", "b"], "left_anti"), "linked")

    needed = members.select("node").unionByName(linked.select(F.col("a").alias("node"))).unionByName(linked.select(F.col("b").alias("node"))).distinct()
    firsts = work.table(plain.join(needed, "node", "left_semi").select("node", F.col("first.row").alias("row")), "needed")
    sets = work.table(_sets(rows.select("row", "text").join(firsts, "row"), width), "sets")

    found = work.table(_confirmed(stars.where(F.col("band") < FIRST_BANDS).select("a", "b"), sets, least), "confirmed")
    roots = _roots(plain.select("node"), found, work)
    rest = stars.where(F.col("band") >= FIRST_BANDS).select("a", "b")
    more = work.table(_confirmed(_apart(rest, roots), sets, least), "more")
    roots = _joined_roots(roots, more, work)
    mixed = members.where("n > 2").join(roots, "node")
    # buckets of the same members are compared once
    mixed = work.table(mixed, "mixed")
    sums = mixed.groupBy("key").agg(F.min("n").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("h"))
    keys = work.table(sums.where("low <> high").groupBy("n", "h").agg(F.min("key").alias("key")).select("key"), "open")
    across = work.table(_across(mixed.join(keys, "key", "left_semi"), sets, least), "across")
    last = work.table(across.unionByName(_confirmed(_apart(linked, roots), sets, least)), "last")
    named = plain.join(_joined_roots(roots, last, work), "node")
    stay = work.table(named.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("row")), "stay")
    work.keep_only("rows", "stay")
    return restored(rows.join(stay.hint("merge"), "row", "left_semi"), docs)
