"""Token-ID output: documents' ids in ascending order of document id, in Simple-8b files."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simple8b
from .shared import Workspace, open_fs, text_batches
from .tokenize import encoder, with_end

MANIFEST = "part int, path string, documents long, ids long"
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, work: Workspace) -> DataFrame:
    """Encode whole texts (null: empty), append ``end_id`` to each, and write one file for each range of doc_id.

    Returns the manifest, one row a file, in the order of ``part``. Null ids come first; rows that share an id
    are ordered by their texts' hash, and equal rows by their place in the input, so that they too are split over
    files. A very long text is encoded whole, in a batch of its own. An empty table gives no files. Extra columns
    are ignored.
    """
    folder = work.path("ids")
    base, path = open_fs(folder)
    base.create_dir(path, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        files, top = open_fs(folder)
        files.create_dir(top, recursive=True)
        # each attempt writes a file of its own; the manifest names that of the one that counts
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}.s8b"
        writer = None
        encode = encoder(tokenizer).encode
        with files.open_output_stream(f"{top}/{name}", compression=None) as file:
            for rows in text_batches(batches, "text", 4 << 20):
                writer = writer or simple8b.Writer(file)
                ids, sizes = with_end(*encode(rows.column("text")), end_id)
                keys = rows.column("doc_id")
                writer.add(keys.fill_null(0).to_numpy(), np.asarray(keys.is_null()), sizes, ids)
            if writer:
                writer.close()
        if not writer:
            files.delete_file(f"{top}/{name}")
            return
        yield pa.RecordBatch.from_pydict({"part": pa.array([context.partitionId()], pa.int32()), "path": [f"{folder}/{name}"], "documents": [writer.documents], "ids": [writer.ids]})

    sorted_docs = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        .withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
        .repartitionByRange("doc_id", "tie", "row")
        .sortWithinPartitions("doc_id", "tie", "row")
        .drop("tie", "row")
    )
    return work.table(sorted_docs.mapInArrow(write, MANIFEST), "manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: the ids before it in all files, its number of ids, and their CRC-32.

    The manifest has one row a file, so its running total is computed over few rows.
    """
    spark = manifest.sparkSession
    starts, before = [], 0
    for row in sorted(manifest.collect(), key=lambda r: r.part):
        starts.append((row.path, before))
        before += row.ids
    files = spark.createDataFrame(starts or [("", 0)], "path string, before long").where("path <> ''")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = open_fs(row["path"])
                start = row["before"]
                with store.open_input_stream(path, compression=None) as file:
                    for keys, nulls, sizes, ids in simple8b.read(file):
                        raw = memoryview(ids.astype("<u4").tobytes())
                        stops = np.cumsum(sizes)
                        crc = [zlib.crc32(raw[4 * (b - n) : 4 * b]) for b, n in zip(stops.tolist(), sizes.tolist(), strict=True)]
                        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(keys, pa.int64(), mask=nulls), "start": start + stops - sizes, "n_tokens": sizes, "ids_crc32": pa.array(crc, pa.int64())})
                        start += int(sizes.sum())

    return files.repartition(max(1, len(starts))).mapInArrow(read, RESULT)
