"""The indicator table with indexes: rows clustered by a space-filling curve, and a Bloom filter for each key column.

Rows are ordered by Morton codes: the bits of the value's hash and of the time, taken in turn, so that rows of like
values and like times lie together and a file's bounds are narrow in both. A look-up by value compares the hash column
too, whose bounds exclude most files; a look-up by time does so by the time. Event uids follow neither, so a second table,
ordered by the uid's hash, says in which files an event's rows are. What a file holds is kept in a small table of its own
(bounds and rows of each file), from which a look-up names the files to read: the others aren't opened at all. Inside a file
row groups are passed over by their bounds and by Bloom filters of values and uids.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.plans.semantic import timestamp

from . import folders

#: Bits of each of the two dimensions of the curve.
BITS = 12
#: Rows of a file, about; bytes of a row group, at most, and of a row in it, about; rows of a page, whose bounds are kept
#: too; share of other keys that a Bloom filter lets through.
FILE_ROWS, GROUP_BYTES, ROW_BYTES, PAGE_ROWS, LET_THROUGH = 1_000_000, 8 << 20, 32, 2_000, 0.05


def morton(first: Column, second: Column, bits: int = BITS) -> Column:
    """The bits of two numbers below 2 ** bits in turn, highest first."""
    code = F.lit(0).cast("long")
    for i in range(bits):
        for k, c in enumerate((second, first)):
            code = code.bitwiseOR(F.shiftleft(F.shiftright(c.cast("long"), i).bitwiseAND(F.lit(1).cast("long")), 2 * i + k))
    return code


def value_hash(value: Column | str) -> Column:
    return F.xxhash64(value)


def micros(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp"))


def clustered(df: DataFrame, low: datetime, high: datetime) -> DataFrame:
    """Rows with the hash of their value and their place on the curve; times are counted from ``low`` to ``high``."""
    span = max(1.0, (high - low).total_seconds())
    since = (micros(F.col("event_time")) - micros(timestamp(low))) / 1e6
    place = F.least(F.greatest(F.floor(since / span * (1 << BITS)), F.lit(0)), F.lit((1 << BITS) - 1))
    hashed = F.shiftrightunsigned("value_hash", 64 - BITS)
    # whole microseconds have bounds that filters are held against whatever kind of time the column has
    return df.withColumns({"value_hash": value_hash("value"), "time_micros": micros(F.col("event_time"))}).withColumn("place", morton(hashed, F.coalesce(place, F.lit(0))))


def write_indexed(df: DataFrame, path: str, rows_per_file: int = FILE_ROWS, group_bytes: int = GROUP_BYTES, page_rows: int = PAGE_ROWS) -> None:
    """Write indicators to ``path/data`` along the curve, and what each file holds to ``path/files``.

    Files are ranges of the curve, so a value or a day with very many rows is split over several. Counting rows and
    times takes one pass over the time column.
    """
    spark = df.sparkSession
    total = df.agg(F.count("*").alias("n"), F.min("event_time").alias("low"), F.max("event_time").alias("high")).first()
    n_files = max(1, -(-total.n // rows_per_file))
    now = datetime(1970, 1, 1)
    placed = clustered(df, total.low or now, total.high or now)
    ordered = placed.repartitionByRange(n_files, "place", "value_hash", "event_uid").sortWithinPartitions("place", "type_id", "value")
    writer = ordered.drop("place").write.mode("overwrite").option("parquet.block.size", str(group_bytes)).option("parquet.page.row.count.limit", str(page_rows))
    for c in ("value", "event_uid"):
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.fpp#{c}", str(LET_THROUGH)).option(f"parquet.bloom.filter.expected.ndv#{c}", str(max(100, min(rows_per_file, group_bytes // ROW_BYTES))))
    writer.parquet(f"{path}/data")
    written = spark.read.parquet(f"{path}/data").withColumns({"file": F.col("_metadata.file_path"), "bytes": F.col("_metadata.file_size")})
    _write_bounds(written, f"{path}/files", {"type": "type_id", "hash": "value_hash", "time": "time_micros"})
    # where each event's rows are: few bytes a row, in files that are ranges of the uid's hash
    # they are dealt before they are made distinct, so that no task holds more than a range's
    uids = written.select(value_hash("event_uid").alias("uid_hash"), "file").repartitionByRange(n_files, "uid_hash").distinct()
    uids.sortWithinPartitions("uid_hash").write.mode("overwrite").parquet(f"{path}/uids")
    _write_bounds(spark.read.parquet(f"{path}/uids").select("uid_hash", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")), f"{path}/uid_files", {"hash": "uid_hash"})


def _write_bounds(rows: DataFrame, path: str, bounds: dict[str, str]) -> None:
    """(file, bytes, n_rows, low and high of each column): a row a file."""
    held = rows.groupBy("file", "bytes").agg(F.count("*").alias("n_rows"), *(f(c).alias(f"{side}_{n}") for n, c in bounds.items() for side, f in (("low", F.min), ("high", F.max))))
    held.coalesce(1).write.mode("overwrite").parquet(path)


def _hashes(spark: SparkSession, texts: Sequence[str]) -> list[int]:
    return [r[0] for r in spark.createDataFrame([(v,) for v in texts], "v string").select(value_hash("v")).collect()]


def _within(numbers: Sequence[int], low: str, high: str) -> Column:
    return F.exists(F.array(*(F.lit(n) for n in numbers)), lambda n: n.between(F.col(low), F.col(high)))


def _files(spark: SparkSession, path: str, kept: Column) -> list[str]:
    """The files that may hold what is looked for: names of files of bounded size, not rows."""
    return sorted(r.file for r in spark.read.parquet(path).where(kept).select("file").collect())


def look_up(spark: SparkSession, path: str, values: Sequence[str] = (), uids: Sequence[str] = (), start: datetime | None = None, stop: datetime | None = None, type_ids: Sequence[int] = ()) -> DataFrame:
    """Indicators of these values, event uids, types and times (``start`` to before ``stop``); only files that may hold some
    are opened, and of these only row groups whose bounds and Bloom filters allow it."""
    schema = spark.read.parquet(f"{path}/data").schema
    found, kept, named = F.lit(True), F.lit(True), None
    if values:
        hashes = _hashes(spark, values)
        found = found & F.col("value_hash").isin(hashes) & F.col("value").isin(list(values))
        kept = kept & _within(hashes, "low_hash", "high_hash")
    if uids:
        hashes = _hashes(spark, uids)
        found = found & F.col("event_uid").isin(list(uids))
        places = _files(spark, f"{path}/uid_files", _within(hashes, "low_hash", "high_hash"))
        named = {r.file for r in spark.read.parquet(*places).where(F.col("uid_hash").isin(hashes)).select("file").distinct().collect()} if places else set()
    if type_ids:
        found = found & F.col("type_id").isin(list(type_ids))
        kept = kept & _within(type_ids, "low_type", "high_type")
    if start is not None:
        at = _micros(spark, start)
        found, kept = found & (F.col("time_micros") >= at), kept & (F.col("high_time") >= at)
    if stop is not None:
        at = _micros(spark, stop)
        found, kept = found & (F.col("time_micros") < at), kept & (F.col("low_time") < at)
    chosen = [f for f in _files(spark, f"{path}/files", kept) if named is None or f in named]
    rows = spark.read.schema(schema).parquet(*chosen) if chosen else spark.createDataFrame([], schema)
    return rows.where(found).drop("value_hash", "time_micros")


def _micros(spark: SparkSession, at: datetime) -> int:
    return spark.range(1).select(micros(timestamp(at))).first()[0]


def bytes_of(spark: SparkSession, path: str) -> int:
    """The bytes of the data files."""
    return sum(n for f, n in folders.sizes(spark, f"{path}/data").items() if f.endswith(".parquet"))


def bytes_read(spark: SparkSession, ask: Callable[[], DataFrame]) -> int:
    """The bytes that Spark's tasks read to make and compute a DataFrame, with indexes, footers and filters."""
    # reads of several ranges at once aren't counted by all file systems
    spark.sparkContext._jsc.hadoopConfiguration().set("parquet.hadoop.vectored.io.enabled", "false")
    store = spark.sparkContext._jsc.sc().statusStore()
    seen = lambda: {(s.stageId(), s.attemptId()): s.inputBytes() for s in _stages(store)}
    before = seen()
    ask().write.format("noop").mode("overwrite").save()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(n for k, n in seen().items() if k not in before)


def _stages(store) -> list:
    found = store.stageList(None, False, False, getattr(store, "stageList$default$4")(), getattr(store, "stageList$default$5")())
    return [found.apply(i) for i in range(found.size())]
