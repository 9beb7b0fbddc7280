"""A log that can be read again from any place: a folder of partitions, each a row of segments.

A segment is an Arrow file named by the offset of its first record and its number of records. ``append`` adds records
and ``LogSource`` (format ``vigil_log``) streams them. Offsets are counted for each partition, so that a query which starts
again goes on where its checkpoint says, without loss and without repeats. The source hands out at most
``max_per_trigger`` records of each partition a trigger. Spark asks for the newest offset without saying where a query
stands, so what was handed out last is kept in a file of the consumer's (option ``consumer``).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "partition int, offset long, key string, value string"
_SCHEMA = pa.schema([("partition", pa.int32()), ("offset", pa.int64()), ("key", pa.string()), ("value", pa.string())])
#: Records of a batch inside a segment.
BATCH = 5_000


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI or plain path."""
    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri.removeprefix("file:")


def segments(folder: str) -> dict[int, list[tuple[int, int, str]]]:
    """(first offset, records, file) of each partition's segments, in order."""
    where, root = open_folder(folder)
    found: dict[int, list[tuple[int, int, str]]] = {}
    for f in where.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
        if f.is_file and f.extension == "arrow" and "/partition-" in f.path:
            first, n = f.base_name.removesuffix(".arrow").split("-")
            found.setdefault(int(f.path.rsplit("/partition-", 1)[1].split("/")[0]), []).append((int(first), int(n), f.path))
    return {p: sorted(s) for p, s in sorted(found.items())}


def append(df: DataFrame, folder: str, partitions: int, segment: int = 100_000) -> int:
    """Add records (key, value) to a log; those of a key go to one partition. Returns their number.

    Tasks write segments of bounded size under names of their own attempts. The driver then gives the segments that Spark
    reports their offsets and names; what a lost attempt wrote never gets one. A log has one writer at a time.
    """
    dealt = df.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), F.pmod(F.xxhash64("key"), F.lit(partitions)).cast("int").alias("partition"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = open_folder(folder)
        where.create_dir(f"{root}/new", recursive=True)
        held: dict[int, list[pa.RecordBatch]] = {}

        def put(p: int) -> pa.RecordBatch:
            rows = pa.Table.from_batches(held.pop(p))
            path = f"{root}/new/{uuid.uuid4().hex}.arrow"
            with where.open_output_stream(path) as out, pa.ipc.new_file(out, rows.schema) as writer:
                writer.write_table(rows, BATCH)
            return pa.RecordBatch.from_pydict({"partition": pa.array([p], pa.int32()), "task": pa.array([TaskContext.get().partitionId()], pa.int32()), "path": [path], "n": pa.array([len(rows)], pa.int64())})

        for batch in batches:
            own = batch.column("partition").to_numpy()
            for p in sorted(set(own.tolist())):
                held.setdefault(p, []).append(batch.filter(pa.array(own == p)).select(["key", "value"]))
                if sum(b.num_rows for b in held[p]) >= segment:
                    yield put(p)
        for p in list(held):
            yield put(p)

    written = dealt.repartition("partition").mapInArrow(write, "partition int, task int, path string, n long").collect()  # a row a segment
    where, root = open_folder(folder)
    ends = {p: s[-1][0] + s[-1][1] for p, s in segments(folder).items()}
    for r in sorted(written, key=lambda r: (r.partition, r.task, r.path)):
        first = ends.get(r.partition, 0)
        where.create_dir(f"{root}/partition-{r.partition:05d}", recursive=True)
        where.move(r.path, f"{root}/partition-{r.partition:05d}/{first:020d}-{r.n:010d}.arrow")
        ends[r.partition] = first + r.n
    return sum(r.n for r in written)


class Slice(InputPartition):
    """Some records of one segment."""

    def __init__(self, partition: int, path: str, first: int, start: int, stop: int):
        self.partition, self.path, self.first, self.start, self.stop = partition, path, first, start, stop


class LogReader(DataSourceStreamReader):
    """Offsets by partition; partitions that appear later start at 0."""

    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.most = int(options.get("max_per_trigger", 1 << 62))
        self.note = f"consumer-{options['consumer']}.json" if "consumer" in options else None
        self.given: dict[str, int] | None = None

    def initialOffset(self) -> dict:  # noqa: N802
        if self.given is None:  # Spark may ask for the start after it has asked for the newest offset
            self.given = {}
            self._keep()
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        if self.given is None:
            self.given = self._kept()
        ends = {str(p): s[-1][0] + s[-1][1] for p, s in segments(self.folder).items()}
        self.given = {p: min(end, self.given.get(p, 0) + self.most) for p, end in ends.items()}
        self._keep()
        return self.given

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        found: list[InputPartition] = []
        for p, own in segments(self.folder).items():
            low, high = start.get(str(p), 0), end.get(str(p), 0)
            found += [Slice(p, path, first, max(low, first), min(high, first + n)) for first, n, path in own if first < high and low < first + n]
        return found

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        where, _ = open_folder(self.folder)
        with where.open_input_file(partition.path) as f, pa.ipc.open_file(f) as rows:
            at = partition.first
            for i in range(rows.num_record_batches):
                batch = rows.get_batch(i)
                low, high = max(partition.start - at, 0), min(partition.stop - at, batch.num_rows)
                if low < high:
                    some = batch.slice(low, high - low)
                    yield pa.RecordBatch.from_arrays([pa.array([partition.partition] * (high - low), pa.int32()), pa.array(range(at + low, at + high), pa.int64()), *some.columns], schema=_SCHEMA)
                at += batch.num_rows

    def commit(self, end: dict) -> None:
        pass

    def _kept(self) -> dict[str, int]:
        where, root = open_folder(self.folder)
        if self.note is None or where.get_file_info(f"{root}/{self.note}").type == fs.FileType.NotFound:
            return {}
        with where.open_input_stream(f"{root}/{self.note}") as f:
            return json.loads(f.read())

    def _keep(self) -> None:
        if self.note is None:
            return
        where, root = open_folder(self.folder)
        new = f"{root}/{self.note}-{uuid.uuid4().hex}"
        with where.open_output_stream(new) as f:
            f.write(json.dumps(self.given).encode())
        where.move(new, f"{root}/{self.note}")


class LogSource(DataSource):
    """``spark.readStream.format("vigil_log").load(folder)``: (partition, offset, key, value)."""

    @classmethod
    def name(cls) -> str:
        return "vigil_log"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        if "max_per_trigger" in self.options and "consumer" not in self.options:
            raise ValueError("max_per_trigger needs a consumer, whose place is kept")
        return LogReader(self.options)


def stream_log(spark: SparkSession, folder: str, consumer: str, max_per_trigger: int | None = None) -> DataFrame:
    """A log's records as a stream; a consumer's name belongs to one query and its checkpoint."""
    spark.dataSource.register(LogSource)
    options = {"max_per_trigger": str(max_per_trigger)} if max_per_trigger else {}
    return spark.readStream.format("vigil_log").options(consumer=consumer, **options).load(folder)
