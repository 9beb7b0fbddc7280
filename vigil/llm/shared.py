"""What the operators share: the folder that all executors see, written tables, and Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.sources.events import shared_folder

T = TypeVar("T")


class Workspace:
    """Written tables of one operator's run; they cut lineage and survive the loss of executors.

    An operator deletes what no later plan reads (``keep_only``). What its lazy result reads stays until the caller has
    written that result: ``workspaces`` deletes the tables of all operators that ran inside it.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self._n = spark, shared_folder(spark, "llm"), 0
        self._written: list[tuple[str, str]] = []
        small_batches(spark)
        for used in _SCOPES:
            used.append(self)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` to the shared folder and read it back."""
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        self._written.append((name, path))
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete the written tables of these names."""
        for name, path in self._written:
            if name in names:
                self.remove(path)
        self._written = [x for x in self._written if x[0] not in names]

    def keep_only(self, *names: str) -> None:
        """Delete all written tables but those of these names."""
        self.drop(*{name for name, _ in self._written}.difference(names))

    def close(self) -> None:
        """Delete all that was written."""
        self.remove(self.root)

    def remove(self, path: str) -> None:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


_SCOPES: list[list[Workspace]] = []


@contextlib.contextmanager
def workspaces() -> Iterator[None]:
    """Delete, at the end, what operators wrote inside; by then all results that read it must be written."""
    used: list[Workspace] = []
    _SCOPES.append(used)
    try:
        yield
    finally:
        _SCOPES.remove(used)
        for work in used:
            work.close()


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI or plain path, on the driver or an executor."""
    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), uri.removeprefix("file:")
    return fs.LocalFileSystem(), uri


def carried(docs: DataFrame, **also: Column) -> DataFrame:
    """The columns of ``docs`` under numbers, so that an operator's own columns can't clash with their names."""
    return docs.select(*(F.col(f"`{c}`").alias(f"carried_{i}") for i, c in enumerate(docs.columns)), *(c.alias(n) for n, c in also.items()))


def restored(df: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The carried columns under their names again, those in ``new`` with new contents."""
    return df.select(*(new.get(c, F.col(f"carried_{i}")).alias(c) for i, c in enumerate(docs.columns)))


#: Text batches after which freed memory is handed back.
TRIM_EVERY = 8
_KEPT: dict[object, object] = {}
_C = ctypes.CDLL(None)


def kept_in_worker(key: object, make: Callable[[], T]) -> T:
    """What a Python worker keeps between tasks: one thing at a time, so that operators don't add up."""
    if key not in _KEPT:
        nothing_kept()
        _KEPT[key] = make()
    return _KEPT[key]


def nothing_kept() -> None:
    """Give back the memory of what earlier tasks of this worker kept."""
    _KEPT.clear()
    gc.collect()
    trim()


def trim() -> None:
    """Hand freed memory back to the system, so that a worker's peaks don't stay with it."""
    pa.default_memory_pool().release_unused()
    if hasattr(_C, "malloc_trim"):
        _C.malloc_trim(0)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Have Spark hand Python workers batches of at most so many rows, so that batches of long texts stay small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def text_batches(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Regroup batches so that the texts of each hold about ``most_bytes`` together, at least one row each."""
    held: list[pa.RecordBatch] = []
    total = given = 0
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        start = 0
        for i, n in enumerate(sizes.tolist()):
            if total and total + n > most_bytes:
                if i > start:
                    held.append(batch.slice(start, i - start))
                yield pa.concat_batches(held)
                held, total, start, given = [], 0, i, given + 1
                if given % TRIM_EVERY == 0:  # memory that is taken anew each time costs time
                    trim()
            total += n
        if batch.num_rows > start:
            held.append(batch.slice(start))
    if held:
        yield pa.concat_batches(held)
        trim()


#: The white space between words.
SPACE = np.zeros(256, bool)
SPACE[[*range(9, 14), 32]] = True


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each text starts in the bytes of all (one more for the end), and these bytes; a null text is empty."""
    texts = pc.fill_null(texts, "" if pa.types.is_string(texts.type) else b"").cast(pa.binary())
    _, offsets, raw = texts.buffers()
    if not len(texts):
        return np.zeros(1, np.int32), np.zeros(0, np.uint8)
    bounds = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]] if raw else np.zeros(0, np.uint8)
    return bounds - bounds[0], data


def words_of(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """The words of all texts in order, as numbers of distinct words; these words; and the number of each text's."""
    bounds, data = text_bytes(texts)
    solid = ~SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = bounds[:-1][bounds[:-1] < len(data)]
    first[inner] = solid[inner]
    at = np.flatnonzero(first)
    # without the white space, each word ends where the next one starts
    ends = np.cumsum(solid, dtype=np.int32)
    starts = np.append(ends[at] - 1, ends[-1] if len(ends) else 0).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(starts), pa.py_buffer(data[solid])]).dictionary_encode()
    return words.indices.to_numpy(), words.dictionary.to_pylist(), np.diff(np.searchsorted(at, bounds))
