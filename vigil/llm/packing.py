"""Best-fit packing of token pieces into fixed sequences, with certified bin counts.

Documents longer than a sequence are cut; whole pieces fill a sequence alone. The rest go to partitions of
bounded size. Each partition packs by best-fit decreasing and gets a lower bound from dual-feasible
functions. Where the bound is met, the partition is certified and keeps its bins but the emptiest and those
of the smallest pieces, as room of several partitions may add up to a bin. The others hand back the pieces of all their unfilled bins. What comes
back is dealt anew and packed again, until it fits one partition or rounds hardly save a sequence any more. Each
piece tells the bins, the bound and the certificate of the partition that placed it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace, text_batches
from .tokenize import encoder, with_end

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = f"{PIECES}, sequence_id long, offset long, partition_bins long, partition_bound long, certified boolean, open boolean"
#: Pieces that one task packs at once.
PARTITION_PIECES = 100_000
#: The exchange ends after so many rounds in a row that save less than this share of the sequences they repack.
PATIENCE, GAIN = 2, 0.001
#: A certified partition hands back one in so many of its bins for their room, and as many for their small pieces.
BACK = 4


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Pieces of at most ``capacity`` ids; the first piece of a long document is the shorter one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for rows in text_batches(batches, "text", 4 << 20):
            ids, sizes = with_end(*encode(rows.column("text")), end_id)
            raw = memoryview(ids.astype("<u4").tobytes())
            pieces = -(-sizes // capacity)
            owner = np.repeat(np.arange(len(sizes)), pieces)
            number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first = sizes - (pieces - 1) * capacity
            length = np.where(number == 0, first[owner], capacity)
            start = np.where(number == 0, 0, first[owner] + (number - 1) * capacity)
            at = (np.cumsum(sizes) - sizes)[owner] + start
            crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"doc_id": rows.column("doc_id").take(pa.array(owner)), "piece": pa.array(number, pa.int32()), "start": start, "length": length, "ids_crc32": pa.array(crc, pa.int64())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(cut, PIECES)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each length: its bin and its offset there; and each bin's fill.

    Bins wait by the room they have left. A bit set of the rooms that occur gives the tightest one at once.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offsets, fills = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for i in order.tolist():
        n = int(lengths[i])
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = waiting[room].pop()
            if not waiting[room]:
                rooms &= ~(1 << room)
        else:
            b, room = len(fills), capacity
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += n
        left = room - n
        if left:
            waiting[left].append(b)
            rooms |= 1 << left
    return bins, offsets, np.array(fills, np.int64)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """The largest bin bound that two families of dual-feasible functions give, from counts by length.

    f_k counts a length above half a bin as a whole bin less what fits beside it, u_k rounds multiples of
    1/(k+1) down; the plain sum is the bound with neither.
    """
    lengths = np.arange(len(counts))
    best = -(-int((counts * lengths).sum()) // capacity)
    used = lengths[counts > 0]
    # a length over capacity - k counts as a whole bin, one of at least k as itself, a smaller one as nothing
    for k in used[used <= capacity // 2].tolist():
        value = np.where(lengths > capacity - k, capacity, np.where(lengths >= k, lengths, 0))
        best = max(best, -(-int((counts * value).sum()) // capacity))
    for k in range(1, 33):
        scaled = (k + 1) * lengths
        # in units of 1/(k * capacity)
        value = np.where(scaled % capacity == 0, lengths * k, scaled // capacity * capacity)
        best = max(best, -(-int((counts * value).sum()) // (k * capacity)))
    return best


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, work: Workspace) -> DataFrame:
    """Pack whole texts (null: empty) into sequences; one row a piece with its sequence and offset there.

    A document without words is one piece that holds only the end id. A very long text is encoded whole, in a batch
    of its own, and cut into pieces. Null or repeated ids and repeated rows are packed like any others; pieces of
    equal length are placed in the order in which they reach their partition. An empty table gives no rows; extra
    columns are ignored.

    ``partition_bins`` and ``partition_bound`` are the number of sequences of the partition that placed the piece
    and the least number that its pieces need; ``certified`` says that they are equal. Where it is false, a gap is
    left that the exchange did not close. A piece that fills a sequence alone is its own certificate.
    """
    pieces = work.table(cut_pieces(docs, tokenizer, end_id, capacity), "pieces")
    one, long = F.lit(1).cast("long"), F.lit(0).cast("long")
    whole = pieces.where(F.col("length") == capacity).select("*", (F.shiftleft(one, 62) + F.monotonically_increasing_id()).alias("sequence_id"), long.alias("offset"), one.alias("partition_bins"), one.alias("partition_bound"), F.lit(True).alias("certified"))
    placed = [whole]
    pool = pieces.where(F.col("length") < capacity)
    n, turn, idle, before = pool.count(), 0, 0, None
    while n:
        partitions = max(1, -(-n // PARTITION_PIECES))
        table = work.table(_dealt(pool, partitions, turn, capacity), f"placed-{turn}")
        # a sequence has one piece at its start
        sums = table.agg(F.count_if(F.col("offset") == 0).alias("bins"), F.count_if((F.col("offset") == 0) & F.col("open")).alias("open_bins"), F.count_if("open").alias("left")).first()
        idle = idle + 1 if before is not None and sums.bins > (1 - GAIN) * before else 0
        left = sums.left if partitions > 1 and idle < PATIENCE else 0
        placed.append(table.where(~F.col("open")).drop("open") if left else table.drop("open"))
        pool, n, turn, before = table.where("open").select(*pieces.columns), left, turn + 1, sums.open_bins
    result = placed[0]
    for part in placed[1:]:
        result = result.unionByName(part)
    return result


def _dealt(pool: DataFrame, partitions: int, turn: int, capacity: int) -> DataFrame:
    """One round: deal pieces evenly by their row in the written table, pack each partition, mark the bins that it
    hands back."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        lengths = group["length"].to_numpy(np.int64)
        bins, offsets, fills = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        certified = len(fills) == bound
        base = (turn << 56) | (int(group["part"].iloc[0]) << 32)
        out = group.drop(columns="part")
        # of a certified partition the emptiest bins and those of the smallest pieces, at least one; all of another's
        back, some = np.full(len(fills), not certified), -(-len(fills) // BACK)
        smallest = np.full(len(fills), capacity)
        np.minimum.at(smallest, bins, lengths)
        back[np.argsort(fills, kind="stable")[:some]] = True
        back[np.argsort(smallest, kind="stable")[:some]] = True
        return out.assign(sequence_id=base + bins, offset=offsets, partition_bins=len(fills), partition_bound=bound, certified=certified, open=back[bins] & (fills[bins] < capacity))

    part = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(turn)), F.lit(partitions)).cast("int")
    return pool.withColumn("part", part).groupBy("part").applyInPandas(one, PLACED)
