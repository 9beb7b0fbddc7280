"""The trie of conversations' prefixes, with subtree sums by the Euler-tour technique.

A node is a distinct sequence of a conversation's first turns. Nodes are told apart by polynomial hashes of their turns,
which can be put together from parts, so that a conversation's turns may lie in several partitions. Each node has an enter
and an exit arc; an arc's successor is known from first children, next siblings and parents. The tour, a linked list of all
arcs, is ranked distributedly: runs of arcs that lie in one partition are contracted to one element each, further elements
are spliced into their predecessors by coin flips until few are left, these are ranked, and places are handed back. Leaves
and savings are summed along with the ranks, so a subtree's sums are differences of prefix sums at its node's two arcs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Workspace

#: Conversations share the first turns of the one whose id is the next lower multiple of this; at most so many turns.
SHARED, TURNS = 100, 6
#: Prefix hashes are polynomials over turn digests, modulo a prime; the base is any fixed number below it.
PRIME, BASE = (1 << 127) - 1, 0x5DEECE66D1B3C9F7A2B4C6D8E9F01235
#: Ids that agree but for so many bits are joined to one piece of text first.
PIECE_BITS = 8
#: Arcs of so many nodes are contracted together in one task; so many elements of the contracted list are ranked together.
CHUNK, FEW = 1 << 19, 1 << 16


def shared_turns() -> Column:
    """How many turns a conversation takes over: by the hash of its id."""
    return (F.crc32(F.col("conv_id").cast("string")) % TURNS).cast("int")


def _bytes(x: int) -> bytes:
    return x.to_bytes(16, "big")


def _number(x: bytes) -> int:
    return int.from_bytes(x, "big")


def _rows(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(batch.column(c).to_pylist() for c in names), strict=True)


def _edges(table: DataFrame, *columns: str) -> list[Row]:
    """The marked rows of each partition, at most two a partition, in order."""
    return sorted(table.where("edge IS NOT NULL").select("part", "edge", *columns).collect(), key=lambda r: (r.part, r.edge))


# prefixes


def _prefixes(turns: DataFrame, work: Workspace) -> DataFrame:
    """(conv_id, position, tokens, x, before): each turn's place in its conversation and the hashes of the turns up to it, with
    and without itself.

    Turns are dealt by ranges of (conversation, turn). A conversation's places and hashes go on from one partition to the
    next: what came before is known from the partitions' ends.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, conv, place, x = TaskContext.get().partitionId(), None, 0, 0
        first, last = True, None

        def batch_of(rows: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema.names)

        for batch in batches:
            out: list[list] = []
            for own, digest, tokens in _rows(batch, "conv_id", "digest", "tokens"):
                if own != conv:
                    if last is not None and first:
                        last[-1], first = 0, False  # the end of the first conversation
                    conv, place, x = own, 0, 0
                if last is not None:
                    out.append(last)
                before, place = x, place + 1
                x = (x * BASE + int(digest, 16)) % PRIME
                last = [own, place, tokens, _bytes(x), _bytes(before), part, first, None]
            if out:
                yield batch_of(out)
        if last is not None:
            last[-1] = 0 if first else 1
            yield batch_of([last])

    schema = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("tokens", pa.int64()), ("x", pa.binary()), ("before", pa.binary()), ("part", pa.int32()), ("opening", pa.bool_()), ("edge", pa.int32())])
    order = ["conv_id", "turn", "role", "digest"]
    dealt = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    local = work.table(dealt.mapInArrow(run, "conv_id long, position long, tokens long, x binary, before binary, part int, opening boolean, edge int"), "prefixes")

    earlier: dict[int, tuple[int, int]] = {}
    ends = _edges(local, "conv_id", "position", "x")
    open_conv, place, x = None, 0, 0
    for i, e in enumerate(ends):
        begins = i == 0 or ends[i - 1].part != e.part
        if begins and e.conv_id == open_conv:
            earlier[e.part] = (place, x)
            place, x = place + e.position, (x * pow(BASE, e.position, PRIME) + _number(e.x)) % PRIME
        else:
            open_conv, place, x = e.conv_id, e.position, _number(e.x)
    if not earlier:
        return local.select("conv_id", "position", "tokens", "x", "before")

    def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, position, tokens, x, before, part, opening in _rows(batch, *schema.names[:-1]):
                if opening and part in earlier:
                    n, start = earlier[part]
                    y = start * pow(BASE, position - 1, PRIME)
                    x, before, position = _bytes((y * BASE + _number(x)) % PRIME), _bytes((y + _number(before)) % PRIME), position + n
                out.append((conv, position, tokens, x, before))
            if not out:
                continue
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), schema.types[:5], strict=True)], schema.names[:5])

    moved = local.where("opening").drop("edge").mapInArrow(go_on, "conv_id long, position long, tokens long, x binary, before binary")
    return local.where("NOT opening").select(moved.columns).unionByName(moved)


def _rebuilt(own: DataFrame, work: Workspace) -> DataFrame:
    """(conv_id, depth, x, px, tokens, ends): every prefix of every rebuilt conversation with its hash and that of the prefix
    before it; depth 0 is the root. ``ends`` marks the whole conversation."""
    is_base = F.col("conv_id") % SHARED == 0
    h = F.when(is_base, 0).otherwise(shared_turns())
    sizes = own.groupBy("conv_id").agg(F.max("position").alias("n"), F.max(F.when(F.col("position") == h, F.col("x"))).alias("skipped"))
    turn = F.struct("position", "x", "before", "tokens")
    # at most TURNS - 1 turns of each
    bases = own.where(is_base & (F.col("position") < TURNS)).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    convs = sizes.withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % SHARED}).join(bases, "base", "left")
    taken = F.when(F.col("h") > 0, F.slice(F.coalesce("turns", F.array().cast("array<struct<position: long, x: binary, before: binary, tokens: long>>")), F.lit(1), F.greatest("h", F.lit(1))))
    convs = convs.withColumn("taken", F.coalesce(taken, F.array().cast("array<struct<position: long, x: binary, before: binary, tokens: long>>"))).withColumn("m", F.size("taken").cast("long"))
    convs = work.table(convs.select("conv_id", "h", "m", "skipped", "taken", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("whole")), "conversations")
    zero = F.lit(bytes(16))
    root = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), zero.alias("x"), F.lit(None).cast("binary").alias("px"), F.lit(0).cast("long").alias("tokens"), (F.col("whole") == 0).alias("ends"))
    over = convs.select("conv_id", "whole", F.explode("taken").alias("t")).select("conv_id", F.col("t.position").alias("depth"), F.col("t.x").alias("x"), F.col("t.before").alias("px"), F.col("t.tokens").alias("tokens"), (F.col("t.position") == F.col("whole")).alias("ends"))
    start = F.when(F.col("m") > 0, F.element_at("taken", F.greatest(F.col("m"), F.lit(1)).cast("int"))["x"]).otherwise(zero)
    after = convs.select(F.col("conv_id").alias("of"), "h", "m", "whole", F.coalesce("skipped", zero).alias("skipped"), start.alias("start"))
    rest = own.join(after, F.col("conv_id") == F.col("of")).where(F.col("position") > F.col("h"))

    def put_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The hash with the taken turns in the place of the skipped ones."""
        names = ["conv_id", "depth", "x", "px", "tokens", "ends"]
        for batch in batches:
            out = []
            for conv, position, tokens, x, before, h, m, whole, skipped, begin in _rows(batch, "conv_id", "position", "tokens", "x", "before", "h", "m", "whole", "skipped", "start"):
                k = position - h
                y = (_number(begin) - _number(skipped)) * pow(BASE, k - 1, PRIME)
                out.append((conv, k + m, _bytes((_number(x) + y * BASE) % PRIME), _bytes((_number(before) + y) % PRIME), tokens, k + m == whole))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names)

    return root.unionByName(over).unionByName(rest.mapInArrow(put_on, "conv_id long, depth long, x binary, px binary, tokens long, ends boolean"))


def _ends(members: DataFrame) -> DataFrame:
    """(x, depth, ends_sha256) of nodes at which conversations end. Ids are joined piece by piece, and a node's pieces are
    hashed as a stream."""
    pieces = members.where("ends").groupBy("x", "depth", F.shiftright("conv_id", PIECE_BITS).alias("piece")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest, out = None, hashlib.sha256(), []

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"x": pa.array([n[0] for n, _ in out], pa.binary()), "depth": pa.array([n[1] for n, _ in out], pa.int64()), "ends_sha256": pa.array([d for _, d in out], pa.string())})

        for batch in batches:
            for x, depth, ids in _rows(batch, "x", "depth", "ids"):
                if (x, depth) == node:
                    digest.update(b",")
                else:
                    if node is not None:
                        out.append((node, digest.hexdigest()))
                    node, digest = (x, depth), hashlib.sha256()
                digest.update(ids.encode())
            if len(out) >= 1000:
                yield batch_of()
                out = []
        if node is not None:
            out.append((node, digest.hexdigest()))
            yield batch_of()

    ordered = pieces.repartition("x", "depth").sortWithinPartitions("x", "depth", "piece").select("x", "depth", "ids")
    return ordered.mapInArrow(run, "x binary, depth long, ends_sha256 string")


def _nodes(own: DataFrame, work: Workspace) -> DataFrame:
    """One row a node: its smallest member and depth, which name it, its parent's, its numbers of members and children, the
    smallest member of its first child, what it saves, and the digest of the conversations that end at it."""
    members = work.table(_rebuilt(own, work), "members")
    plain = work.table(members.groupBy("x", "depth").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("tokens").alias("tokens"), F.max("px").alias("px")), "plain")
    kids = plain.where("depth > 0").groupBy(F.col("px").alias("x"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"), F.min("conv_id").alias("first_child"))
    parents = plain.select(F.col("x").alias("px"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    found = plain.join(parents, ["px", "depth"], "left").join(kids, ["x", "depth"], "left").join(_ends(members), ["x", "depth"], "left")
    nothing = hashlib.sha256().hexdigest()
    return work.table(found.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "first_child", ((F.col("n_convs") - 1) * F.col("tokens")).alias("saves"), F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256")), "nodes")


def _with_siblings(nodes: DataFrame, work: Workspace) -> DataFrame:
    """``nodes`` with ``sibling``, the smallest member of the next child of the same parent.

    Nodes are dealt by ranges of (parent, node), so that a parent's children may lie in several partitions; the last
    row of each partition takes the first of the next one.
    """
    names = nodes.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, first = TaskContext.get().partitionId(), None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if held is None else pa.concat_batches([held, batch])
            if rows.num_rows > 1:
                yield whole(rows, part, first, False)
                first = False
            held = rows.slice(rows.num_rows - 1)
        if held is not None:
            yield whole(held, part, first, True)

    def whole(rows: pa.RecordBatch, part: int, first: bool, last: bool) -> pa.RecordBatch:
        """All rows but the last, whose sibling isn't known yet; or the last row of a partition alone."""
        n = rows.num_rows - (not last)
        parent, depth, conv = (rows.column(c).to_pylist() for c in ("parent_conv_id", "depth", "conv_id"))
        following = [conv[i + 1] if i + 1 < len(conv) and (parent[i], depth[i]) == (parent[i + 1], depth[i + 1]) else None for i in range(n)]
        edge = [None] * n
        if first:
            edge[0] = 0
        if last:
            edge[-1] = 2 if first else 1  # 2: both ends of the partition
        out = rows.slice(0, n)
        return pa.RecordBatch.from_arrays([*out.columns, pa.array(following, pa.int64()), pa.array([part] * n, pa.int32()), pa.array(edge, pa.int32())], [*names, "sibling", "part", "edge"])

    schema = T.StructType([*nodes.schema.fields, T.StructField("sibling", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("edge", T.IntegerType())])
    order = ["depth", "parent_conv_id", "conv_id"]
    local = work.table(nodes.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema), "siblings")
    after: dict[int, int] = {}
    ends = _edges(local, *order)
    for one, two in zip(ends, ends[1:], strict=False):
        if one.part != two.part and one.edge > 0 and (one.depth, one.parent_conv_id) == (two.depth, two.parent_conv_id):
            after[one.part] = two.conv_id
    if after:
        across = local.sparkSession.createDataFrame(sorted(after.items()), "part int, across long")  # at most a row a partition
        known = local.join(F.broadcast(across), "part", "left")
        local = known.withColumn("sibling", F.when(F.col("edge") > 0, F.col("across")).otherwise(F.col("sibling")))
    return local.select(*names, "sibling")


# the tour


def _followed(nxt: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the arcs of lists (``nxt``: the next one's index or -1): the first arc of each one's list, and the sums of weights
    from there up to and with each."""
    n = len(nxt)
    back = np.full(n, -1)
    some = np.flatnonzero(nxt >= 0)
    back[nxt[some]] = some
    head, sums = np.where(back < 0, np.arange(n), back), weights.copy()
    active = np.flatnonzero(back >= 0)
    while len(active):
        at = back[active]
        sums[active], head[active], back[active] = sums[active] + sums[at], head[at], back[at]
        active = active[back[active] >= 0]
    return head, sums


#: What is summed along the tour: arcs, leaves, savings.
SUMS = ["arcs", "leaves", "saved"]
_ARC = "struct<conv: long, slot: long>"


def _contract(nodes: DataFrame, work: Workspace) -> DataFrame:
    """``nodes`` with, for their two arcs, the run of arcs that each lies on and the sums up to it; the first arc of a run has
    the run's sums and what follows it.

    An arc is named by the smallest member of its node and a slot, twice the depth, and one more for the exit. Nodes are
    dealt by ranges of (conversation, depth), so that most arcs meet their successors.
    """
    kept = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "ends_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= CHUNK:
                yield ranked(pa.concat_batches(held))
                held = []
        if sum(b.num_rows for b in held):
            yield ranked(pa.concat_batches(held))

    def ranked(rows: pa.RecordBatch) -> pa.RecordBatch:
        n = rows.num_rows
        of = lambda c: rows.column(c).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        has = lambda c: ~np.asarray(rows.column(c).is_null())
        conv, depth = of("conv_id"), of("depth")
        leaf, brother, child = ~has("first_child"), has("sibling"), has("first_child")
        # enter arcs, then exit arcs
        next_conv = np.concatenate([np.where(child, of("first_child"), conv), np.where(brother, of("sibling"), of("parent_conv_id"))])
        next_slot = np.concatenate([np.where(child, 2 * depth + 2, 2 * depth + 1), np.where(brother, 2 * depth, 2 * depth - 1)])
        following = np.concatenate([np.ones(n, bool), brother | has("parent_conv_id")])
        own_conv, own_slot = np.tile(conv, 2), np.concatenate([2 * depth, 2 * depth + 1])
        codes, places = np.unique(conv, return_inverse=True)
        key = np.tile(places, 2) * (2 * int(depth.max()) + 2) + own_slot
        by = np.argsort(key)
        code = np.minimum(np.searchsorted(codes, next_conv), len(codes) - 1)
        inside = following & (codes[code] == next_conv) & (next_slot <= 2 * int(depth.max()) + 1)
        wanted = code * (2 * int(depth.max()) + 2) + next_slot
        found = by[np.minimum(np.searchsorted(key[by], wanted), 2 * n - 1)]
        nxt = np.where(inside & (key[found] == wanted), found, -1)
        weights = np.zeros((2 * n, 3), np.int64)
        weights[:, 0], weights[:n, 1], weights[:n, 2] = 1, leaf, of("saves")
        head, sums = _followed(nxt, weights)
        ends = np.flatnonzero(nxt < 0)
        last = np.full(2 * n, -1)
        last[head[ends]] = ends  # of the run that begins here
        begins = last >= 0
        arc = lambda c, s, ok: pa.StructArray.from_arrays([pa.array(c), pa.array(s)], ["conv", "slot"], mask=pa.array(~ok))
        columns = [rows.column(c) for c in kept] + [pa.array(leaf.astype(np.int64)), rows.column("saves")]
        for side in (slice(0, n), slice(n, 2 * n)):
            at, end = head[side], last[side]
            columns += [arc(own_conv[at], own_slot[at], np.ones(n, bool)), *(pa.array(sums[side, k]) for k in range(3))]
            columns += [pa.array(begins[side]), arc(next_conv[end], next_slot[end], begins[side] & following[end]), *(pa.array(sums[end, k]) for k in range(3))]
        return pa.RecordBatch.from_arrays(columns, names)

    names = [*kept, "leaf", "saves"]
    schema = [*(f"{f.name} {f.dataType.simpleString()}" for f in nodes.select(kept).schema), "leaf long", "saves long"]
    for side in ("enter", "exit"):
        names += [f"{side}_run", *(f"{side}_{s}" for s in SUMS), f"{side}_begins", f"{side}_next", *(f"{side}_run_{s}" for s in SUMS)]
        schema += [f"{side}_run {_ARC}", *(f"{side}_{s} long" for s in SUMS), f"{side}_begins boolean", f"{side}_next {_ARC}", *(f"{side}_run_{s} long" for s in SUMS)]
    dealt = nodes.repartitionByRange("conv_id", "depth").sortWithinPartitions("conv_id", "depth")
    return work.table(dealt.mapInArrow(run, ", ".join(schema)), "arcs")


def list_ranks(runs: DataFrame, work: Workspace, few: int = FEW) -> DataFrame:
    """(run, arcs, leaves, saved): what lies before each element of a list of (run, next, arcs, leaves, saved).

    In each round every element flips a coin, and those with tails after one with heads are spliced into it; about a
    quarter goes. When at most ``few`` are left, they are ranked together. Then the spliced ones get their places,
    last round first.
    """
    spliced: list[DataFrame] = []
    now = runs
    while now.count() > few:
        heads = F.pmod(F.xxhash64("run.conv", "run.slot", F.lit(len(spliced))), F.lit(2)) == 1
        tossed = work.table(now.withColumn("heads", heads), "tossed")
        after = tossed.where("NOT heads").select(F.col("run").alias("next"), F.col("run").alias("gone"), F.col("next").alias("then"), *(F.col(s).alias(f"{s}_gone") for s in SUMS))
        pairs = tossed.where("heads").join(after, "next", "left")
        joined = work.table(pairs.select("run", F.when(F.col("gone").isNull(), F.col("next")).otherwise(F.col("then")).alias("next"), *((F.col(s) + F.coalesce(f"{s}_gone", F.lit(0))).alias(s) for s in SUMS), "gone", *(F.col(s).alias(f"{s}_before") for s in SUMS)), "joined")
        gone = joined.where("gone IS NOT NULL").select("gone", F.col("run").alias("into"), *(F.col(f"{s}_before") for s in SUMS))
        spliced.append(gone)
        left = tossed.where("NOT heads").join(gone.select(F.col("gone").alias("run")), "run", "left_anti").select("run", "next", *SUMS)
        now = work.table(joined.select("run", "next", *SUMS).unionByName(left), "list")
    rows = now.select("run.conv", "run.slot", F.col("next.conv").alias("next_conv"), F.col("next.slot").alias("next_slot"), *SUMS).collect()  # at most ``few``
    place = {(r.conv, r.slot): i for i, r in enumerate(rows)}
    nxt = np.array([place.get((r.next_conv, r.next_slot), -1) for r in rows], np.int64)
    weights = np.array([[r[s] for s in SUMS] for r in rows], np.int64).reshape(-1, 3)
    before = _followed(nxt, weights)[1] - weights
    found = now.sparkSession.createDataFrame([((r.conv, r.slot), *map(int, b)) for r, b in zip(rows, before, strict=True)], f"run {_ARC}, arcs long, leaves long, saved long")
    for gone in reversed(spliced):
        known = found.select(F.col("run").alias("into"), *(F.col(s).alias(f"{s}_into") for s in SUMS))
        placed = gone.join(known, "into").select(F.col("gone").alias("run"), *((F.col(f"{s}_into") + F.col(f"{s}_before")).alias(s) for s in SUMS))
        found = work.table(found.unionByName(placed), "placed")
    return found


def tour(nodes: DataFrame, work: Workspace, few: int = FEW) -> DataFrame:
    """``nodes`` with the places of their two arcs in the tour (from 0), the leaves of their subtrees and what these save."""
    arcs = _contract(_with_siblings(nodes, work), work)
    sides = [arcs.where(f"{s}_begins").select(F.col(f"{s}_run").alias("run"), F.col(f"{s}_next").alias("next"), *(F.col(f"{s}_run_{c}").alias(c) for c in SUMS)) for s in ("enter", "exit")]
    ranks = list_ranks(work.table(sides[0].unionByName(sides[1]), "runs"), work, few)
    for side in ("enter", "exit"):
        own = ranks.select(F.col("run").alias(f"{side}_run"), *(F.col(c).alias(f"{side}_before_{c}") for c in SUMS))
        arcs = arcs.join(own, f"{side}_run")
    at: Callable[[str, str], Any] = lambda side, c: F.col(f"{side}_before_{c}") + F.col(f"{side}_{c}")
    return arcs.withColumns(
        {
            "enter": at("enter", "arcs") - 1,
            "exit": at("exit", "arcs") - 1,
            "n_leaves": at("exit", "leaves") - at("enter", "leaves") + F.col("leaf"),
            "saved_tokens": at("exit", "saved") - at("enter", "saved") + F.col("saves"),
        }
    )


def prefix_trie(conversations: DataFrame, work: Workspace, few: int = FEW) -> DataFrame:
    """One row for each distinct prefix of the rebuilt conversations.

    A conversation takes the first turns of the one whose id is the next lower multiple of 100 (none if that is absent, all
    if it has fewer) in place of its own. Turns are ordered (null first), ties by role, then by a hash of the text. Null roles
    and texts are empty; rows without a conversation id belong to no conversation and are left out. A conversation left
    without turns is a member of the root alone. Equal conversations share all their nodes. A very long text is hashed in
    its row and not moved. An empty table has no nodes; extra columns are ignored.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), digest.alias("digest"), F.length(text).cast("long").alias("tokens"))
    found = tour(_nodes(_prefixes(turns, work), work), work, few)
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "enter", "exit")
