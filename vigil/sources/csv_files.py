"""CSV files whose quoted cells may hold line ends, read in byte ranges, so that one file splits over tasks.

Whether a line end closes a record depends on all quotes before it. So each range's quotes are counted first; sums of the
counts before a range say whether it begins inside quotes. Then each task reads the records that begin in its range, on to
the end of the last one. Doubled quotes change nothing, as they count twice.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.operators.parsing import infer_value_type

from . import folders
from .logs import open_folder

#: Bytes of a range, and of what is read at once.
RANGE, READ = 64 << 20, 1 << 20
#: Bytes that one task reads, about, and tasks, at most: ranges are small rows, which Spark would put into few tasks.
TASK, TASKS = 16 << 20, 20_000
#: Records of a batch.
BATCH = 2_000
QUOTE, NEWLINE = ord('"'), ord("\n")


def _files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Names and sizes, all that the driver knows of the files."""
    return [(f, n) for f, n in sorted(folders.sizes(spark, path).items()) if n and not f.rsplit("/", 1)[1].startswith(("_", "."))]


def _tasks(spark: SparkSession, files: list[tuple[str, int]]) -> int:
    return max(1, spark.sparkContext.defaultParallelism, min(TASKS, -(-sum(n for _, n in files) // TASK)))


def _ranges(spark: SparkSession, files: list[tuple[str, int]], size: int) -> DataFrame:
    """(file, start, stop, bytes) of all ranges of all files."""
    rows = spark.createDataFrame(files, "file string, bytes long")
    each = rows.select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(size).cast("long"))).alias("start"))
    return each.withColumn("stop", F.least(F.col("start") + size, "bytes")).repartition(_tasks(spark, files), "file", "start")


def _blocks(file: str, start: int, stop: int, most: int = READ) -> Iterator[np.ndarray]:
    where, path = open_folder(file)
    with where.open_input_file(path) as f:
        f.seek(start)
        while start < stop and (block := f.read(min(most, stop - start))):
            start += len(block)
            yield np.frombuffer(block, np.uint8)


def _quotes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        counts = [sum(int((b == QUOTE).sum()) for b in _blocks(r["file"], r["start"], r["stop"])) for r in rows]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("file", "start", "stop", "bytes")), pa.array(counts, pa.int64())], ["file", "start", "stop", "bytes", "quotes"])


def records(file: str, start: int, stop: int, size: int, inside: bool) -> Iterator[tuple[int, bytes]]:
    """(place, bytes) of the records that begin from ``start`` to before ``stop``; ``inside``: the range begins in quotes."""
    held, begins, at, odd = b"", None, start, inside
    if start == 0:
        begins = 0
    else:  # a line end just before the range makes its first byte a beginning
        before = next(_blocks(file, start - 1, start))
        begins = start if before[0] == NEWLINE and not inside else None
    # what follows the range is read for the end of one record only
    for block in _blocks(file, start, size, min(READ, max(4096, stop - start))):
        quotes = np.cumsum(block == QUOTE)
        ends = np.flatnonzero((block == NEWLINE) & ((quotes + odd) % 2 == 0))
        last = 0
        for e in ends.tolist():
            if begins is not None:
                yield begins, held + block[last:e].tobytes()
            begins, held, last = at + e + 1, b"", e + 1
            if begins >= stop:
                return
        if begins is not None:
            held += block[last:].tobytes()
        odd = bool((odd + int(quotes[-1])) % 2) if len(quotes) else odd
        at += len(block)
        if begins is None and at >= stop:
            return  # the range lies inside one record
    if begins is not None and held:
        yield begins, held


def _cells(raw: bytes) -> list[str] | None:
    """A record's cells; None for an empty line."""
    csv.field_size_limit((1 << 31) - 1)
    text = raw.decode("utf-8", "replace").removesuffix("\r")
    return next(csv.reader(io.StringIO(text, newline=""))) if text.strip() else None


def _given(file: str, out: list[tuple[int, list[str]]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"file": pa.array([file] * len(out)), "place": pa.array([p for p, _ in out], pa.int64()), "cells": pa.array([c for _, c in out], pa.list_(pa.string()))})


RECORD = "file string, place long, cells array<string>"


def read_csv_records(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """(file, place, cells) of all records of a file or folder, ``place`` the record's first byte; empty lines are left out.

    A record is whole in one task's memory. A quote that is never closed makes the rest of its file one record.
    """
    files = _files(spark, path)
    counted = _ranges(spark, files, size).mapInArrow(_quotes, "file string, start long, stop long, bytes long, quotes long")
    before = F.sum("quotes").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    known = counted.withColumn("inside", F.coalesce(before, F.lit(0)) % 2 == 1).drop("quotes").repartition(_tasks(spark, files), "file", "start")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                out: list[tuple[int, list[str]]] = []
                held = 0
                for place, raw in records(r["file"], r["start"], r["stop"], r["bytes"], r["inside"]):
                    if (cells := _cells(raw)) is not None:
                        out.append((place, cells))
                        held += len(raw)
                    if len(out) == BATCH or held > READ:
                        yield _given(r["file"], out)
                        out, held = [], 0
                if out:
                    yield _given(r["file"], out)

    return known.mapInArrow(read, RECORD)


def _heads(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, cells) of each file's first record, of which no more is read."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                found = ((place, cells) for place, raw in records(r["file"], 0, r["bytes"], r["bytes"], False) if (cells := _cells(raw)) is not None)
                if (head := next(found, None)) is not None:
                    yield _given(r["file"], [head])

    return spark.createDataFrame(_files(spark, path), "file string, bytes long").mapInArrow(first, RECORD)


def read_csv_fields(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """(file, place, position, path, value, type) of every data record's cells, named by their file's first record.

    A name that is missing is column_i; a cell that is missing is empty.
    """
    rows = read_csv_records(spark, path, size)
    heads = F.broadcast(_heads(spark, path).select("file", F.col("place").alias("first"), F.col("cells").alias("names")))  # a row a file
    body = rows.join(heads, "file").where(F.col("place") > F.col("first"))
    cell: Column = F.coalesce(F.get("cells", F.col("position")), F.lit(""))
    named = body.select("file", "place", "cells", F.posexplode("names").alias("position", "name"))
    path_name = F.when(F.trim("name") == "", F.concat(F.lit("column_"), F.col("position"))).otherwise(F.trim("name"))
    return named.select("file", "place", "position", path_name.alias("path"), cell.alias("value"), infer_value_type(cell).alias("type"))
