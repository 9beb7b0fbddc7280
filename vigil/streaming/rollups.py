"""Roll-ups that follow a stream: a log of signed partial aggregates, one run of files a trigger, merged as it grows.

A trigger adds one run: the counts and sums that its rows add to each group, or take from it where rows are retracted.
Counts and sums of runs add up in any order, so rows that come late or are taken back need no second look at what was
written. Runs of equal length are merged ``FAN`` at a time to one that covers their triggers, so that each row is
rewritten a logarithmic number of times and the number of runs stays logarithmic. A trigger that is repeated writes its
run anew; a run that a longer, finished one covers doesn't count. So each trigger counts once, whatever fails between.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vigil.sources import folders

#: Runs of a length that are merged to one.
FAN = 4
COUNT = "event_count"
_RUN = re.compile(r"(\d+)-(\d+)")


@dataclass(frozen=True)
class Rollup:
    """Counts by keys, and sums of expressions by the names that they get; sums should be of whole or decimal numbers, as
    floating ones depend on the order of addition."""

    keys: tuple[str, ...]
    sums: dict[str, str] = field(default_factory=dict)


def partial(rows: DataFrame, rollup: Rollup, sign: Column | None = None) -> DataFrame:
    """What rows add to each group; ``sign`` is 1 for rows that come and -1 for rows that are taken back."""
    one = F.lit(1) if sign is None else sign
    signed = rows.select(*rollup.keys, one.cast("long").alias(COUNT), *((F.expr(e) * one).alias(n) for n, e in rollup.sums.items()))
    return merged(signed, rollup)


def merged(parts: DataFrame, rollup: Rollup) -> DataFrame:
    """Partial aggregates of the same groups as one; a group that nothing is left of goes."""
    kinds = dict(parts.dtypes)
    total = lambda c: F.sum(c).cast(kinds[c]).alias(c)
    found = parts.groupBy(*rollup.keys).agg(total(COUNT), *(total(n) for n in rollup.sums))
    nothing = F.col(COUNT) == 0
    for n in rollup.sums:
        nothing = nothing & (F.coalesce(F.col(n), F.lit(0)) == 0)
    return found.where(~nothing)


def runs(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """(first, last) trigger of each finished run, also of covered ones."""
    found = [tuple(map(int, m.groups())) for n in folders.children(spark, path) if (m := _RUN.fullmatch(n))]
    return sorted(r for r in found if folders.exists(spark, f"{_folder(path, r)}/_SUCCESS"))


def _folder(path: str, run: tuple[int, int]) -> str:
    return f"{path}/{run[0]:012d}-{run[1]:012d}"


def current(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs that no longer one covers."""
    return [r for r in found if not any(o != r and o[0] <= r[0] and r[1] <= o[1] for o in found)]


def _read(spark: SparkSession, path: str, chosen: list[tuple[int, int]], schema) -> DataFrame:
    return spark.read.schema(schema).parquet(*(_folder(path, r) for r in chosen))


def _compact(spark: SparkSession, path: str, rollup: Rollup, last: int, schema) -> None:
    """Merge, after trigger ``last``, every FAN runs that it completes; delete runs that were covered before it."""
    found = runs(spark, path)
    covered = [r for r in found if r not in current(found)]
    size = FAN
    while (last + 1) % size == 0:
        whole = (last + 1 - size, last)
        inside = [r for r in current(found) if whole[0] <= r[0] and r[1] <= whole[1]]
        if whole not in found and inside:
            merged(_read(spark, path, inside, schema), rollup).write.mode("overwrite").parquet(_folder(path, whole))
            found.append(whole)
        size *= FAN
    for run in covered:  # by now no reader that listed runs before the last trigger is busy with them
        folders.remove(spark, _folder(path, run))


def stream_rollup(stream: DataFrame, rollup: Rollup, path: str, checkpoint: str, sign: str | None = None, every: str | None = None) -> StreamingQuery:
    """Keep the roll-up at ``path`` up to date; ``read_rollup`` reads it.

    ``sign`` names a column of 1 and -1. Rows should come once (``stream_dedupe`` sees to that). Without ``every`` the query
    takes what is there and ends, as for a manual refresh; else it goes on at that interval.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        found = partial(batch, rollup, F.col(sign) if sign else None)
        found.write.mode("overwrite").parquet(_folder(path, (number, number)))
        _compact(spark, path, rollup, number, found.schema)

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def read_rollup(spark: SparkSession, path: str, rollup: Rollup) -> DataFrame:
    """Keys, ``event_count`` and sums of all triggers so far."""
    chosen = current(runs(spark, path))
    if not chosen:
        raise ValueError(f"no roll-up at {path}")
    return merged(spark.read.parquet(*(_folder(path, r) for r in chosen)), rollup)
