"""Matches that hold only while an indicator is valid: points in intervals, by equality joins.

An interval of times is cut into dyadic blocks, at most two of each size: seconds whose numbers agree but for the last l
bits. A moment lies in one block of each size, so it meets an interval at most once, by equality of (indicator, size,
block). Only events whose value meets an indicator at all are multiplied by the sizes that occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .threat import keyed_values

#: Seconds are counted with so many bits, from 1970 on; intervals without an end reach to the last one.
BITS = 32
LAST = (1 << BITS) - 1
BLOCKS = "array<struct<size: int, block: bigint>>"


def _seconds(time: Column) -> Column:
    inside = F.least(F.greatest(F.unix_seconds(time.cast("timestamp")), F.lit(0).cast("long")), F.lit(LAST).cast("long"))
    return F.when(time.isNotNull(), inside)


def dyadic_blocks(low: Column, high: Column) -> Column:
    """The fewest blocks that cover the whole numbers from ``low`` to ``high``; none if ``low`` is above it."""
    start = F.struct(low.alias("a"), high.alias("b"), F.array().cast(BLOCKS).alias("found"))

    def step(s: Column, size: Column) -> Column:
        one = lambda cond, at: F.when(cond, F.array(F.struct(size.alias("size"), at.alias("block")))).otherwise(F.array().cast(BLOCKS))
        a, b = s["a"], s["b"]
        open_, odd, even = a <= b, a % 2 == 1, b % 2 == 0
        after = a + F.when(open_ & odd, 1).otherwise(0)
        left = open_ & even & (after <= b)
        before = b - F.when(left, 1).otherwise(0)
        # halves of an emptied range might meet again, so it is marked
        done = after > before
        return F.struct(F.when(done, F.lit(1)).otherwise(F.shiftright(after, 1)).cast("long").alias("a"), F.when(done, F.lit(0)).otherwise(F.shiftright(before, 1)).cast("long").alias("b"), F.concat(s["found"], one(open_ & odd, a), one(left, b)).alias("found"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(BITS)), start, step)["found"]


def cut_intervals(feed: DataFrame, start: str = "first_seen", stop: str = "last_seen") -> DataFrame:
    """``feed`` with (size, block) for each block of each entry's interval; a bound that is null is none."""
    low = F.coalesce(_seconds(F.col(start)), F.lit(0).cast("long"))
    high = F.coalesce(_seconds(F.col(stop)), F.lit(LAST).cast("long"))
    return feed.select("*", F.inline(dyadic_blocks(low, high)))


def valid_matches(events: DataFrame, feed: DataFrame, kind: str, columns: list[str], time: str = "time", start: str = "first_seen", stop: str = "last_seen") -> DataFrame:
    """(columns, time, feed columns) of each distinct value and time that meets a valid indicator of the kind; both bounds count."""
    feed = feed.where(F.col("indicator_type") == kind)
    met = keyed_values(events.select(*columns), kind, columns).join(feed.select("indicator").distinct(), "indicator")
    renamed = met.select(F.col("indicator").alias("_met"), *(F.col(c).alias(f"_value_{i}") for i, c in enumerate(columns)))
    same = F.lit(True)
    for i, c in enumerate(columns):
        same = same & F.col(c).eqNullSafe(F.col(f"_value_{i}"))
    moments = events.where(F.col(time).isNotNull()).select(*columns, time).distinct().join(renamed, same).select(*columns, time, "_met")
    pieces = cut_intervals(feed, start, stop)
    sizes = [r["size"] for r in pieces.select("size").distinct().collect()]  # at most BITS + 1
    second = _seconds(F.col(time))
    each = F.array(*(F.struct(F.lit(s).alias("_size"), F.shiftright(second, s).alias("_block")) for s in sizes)) if sizes else F.array().cast("array<struct<_size: int, _block: bigint>>")
    placed = moments.select("*", F.inline(each))
    found = placed.join(pieces, (F.col("_met") == F.col("indicator")) & (F.col("_size") == F.col("size")) & (F.col("_block") == F.col("block")))
    exact = (F.col(start).isNull() | (F.col(time) >= F.col(start))) & (F.col(stop).isNull() | (F.col(time) <= F.col(stop)))
    return found.where(exact).select(*columns, time, *feed.columns)


def valid_lookup(events: DataFrame, feed: DataFrame, kind: str, columns: list[str], time: str = "time", start: str = "first_seen", stop: str = "last_seen") -> DataFrame:
    """Events with the feed entries that they match and that were valid at their time, null where none was."""
    hits = valid_matches(events, feed, kind, columns, time, start, stop)
    names = [*columns, time]
    renamed = hits.select(*(F.col(c).alias(f"_at_{i}") for i, c in enumerate(names)), *feed.columns)
    same = F.lit(True)
    for i, c in enumerate(names):
        same = same & F.col(c).eqNullSafe(F.col(f"_at_{i}"))
    return events.join(renamed, same, "left").select(*events.columns, *feed.columns)
