"""Token ids written as ORC: integer run-length encoding, row indexes, Bloom filters on the document id.

``write`` sorts the documents by id over the whole table (range partitioning,
one file per range), encodes the texts and writes one row per document: its id,
file number, place in the file, and ids. ORC stores the ids as a run-length
encoded integer stream and keeps minima, maxima and a Bloom filter of
``doc_id`` for each row group, so readers take stripes in parallel and a lookup
by id skips the row groups that cannot hold it.

Defined cases: a null text counts as empty, and every document ends with
``end_id``, so an empty one has one id. A null id sorts first; repeated ids
stay, each row on its own. Other columns are not read. An empty table gives
files without rows. Texts are encoded whole, and Spark keeps one text's ids in
one row, so a single text must stay under 2^31 ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cropstats.llm import batches, bpe, scratch

SCHEMA = "doc_id long, file int, ids_before long, n_tokens long, ids array<int>"
#: Rows in a row group, each with its own index entry and Bloom filter.
ROW_GROUP = 1000


def encode_batches(parts: Iterator[pa.RecordBatch], tokenizer: str, end_id: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Bounded slices of the batches with the ids of each text, end id included."""
    encoder = bpe.encoder(tokenizer)
    end = np.array([end_id], dtype="<u4")
    for part in batches.pieces(parts, "text"):
        yield part, [np.concatenate((x, end)) for x in encoder.ids(batches.strings(part, "text"))]


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, files: int | None = None) -> None:
    """Encode every text of ``docs`` (``doc_id``, ``text``) and write the ORC files in ascending id order."""

    def encoded(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, number = 0, TaskContext.get().partitionId()
        for part, ids in encode_batches(parts, tokenizer, end_id):
            sizes = np.array([len(x) for x in ids], dtype=np.int64)
            ends = np.cumsum(sizes)
            flat = np.concatenate(ids).view(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column(part.schema.get_field_index("doc_id")), pa.array(np.full(len(ids), number, dtype=np.int32)), pa.array(before + ends - sizes), pa.array(sizes),
                 pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(flat))],
                names=["doc_id", "file", "ids_before", "n_tokens", "ids"])
            before += int(ends[-1])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ranges = rows.repartitionByRange(files or scratch.partitions(docs), "doc_id").sortWithinPartitions("doc_id", "text")
    (batches.mapped(ranges, encoded, SCHEMA)
     .write.option("compression", "zstd").option("orc.create.index", "true").option("orc.row.index.stride", str(ROW_GROUP))
     .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").orc(path))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The documents of the files with ``start``, the number of ids in all documents before each.

    Only one total per file meets in one task; the ids stay where they are read.
    """
    rows = spark.read.schema(SCHEMA).orc(path)
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    ahead = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    first = totals.select("file", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("first"))
    return rows.join(F.broadcast(first), "file").select("doc_id", (F.col("first") + F.col("ids_before")).alias("start"), "n_tokens", "ids")


def lookup(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """The rows of a few documents; row groups whose minima, maxima or Bloom filter exclude the ids are not read."""
    return spark.read.schema(SCHEMA).orc(path).where(F.col("doc_id").isin([int(i) for i in ids])).select("doc_id", "n_tokens", "ids")


def digests(rows: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and the CRC-32 of each row's ids as little-endian unsigned 32-bit integers."""

    def crc(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            lists = part.column(3)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(np.concatenate(([0], ends[:-1])).tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(sums, type=pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return batches.mapped(rows.select("doc_id", "start", "n_tokens", "ids"), crc, "doc_id long, start long, n_tokens long, ids_crc32 long")
