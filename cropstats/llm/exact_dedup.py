"""Exact dedup by content sort.

Texts are equal when identical after deleting blanks, tabs, line feeds,
vertical tabs, form feeds and returns. Sampled splitters range-partition the
rows by the first characters of the normalised text, a hash of all of it, and
the order of preference, so even a group that holds a third of all rows spreads
over many tasks. Spark's external sort places equal texts adjacent, best row
first, and neighbours are compared in full. Only the first and last run of a
range can go on in the next one; these two rows per range meet by SHA-256.

Of equal texts the row with the most code points in the original text stays,
then the smallest ``doc_id``. Defined cases: a null text counts as empty, and
empty texts are equal to each other and to white space alone; a null id loses
to any other; of repeated rows one stays; other columns are carried untouched,
whatever their names; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cropstats.llm import batches, scratch

WHITE_SPACE = "[\\x20\\x09-\\x0D]+"
_RUN = T.StructType([T.StructField("keep_id", T.LongType()), T.StructField("run_size", T.LongType()), T.StructField("first", T.BooleanType()), T.StructField("text_sha256", T.StringType()), T.StructField("border", T.BooleanType()), T.StructField("range", T.IntegerType())])


def _runs(df: DataFrame, carried: list[str], keepers: bool) -> DataFrame:
    """Each row, or only the first of each run of equal texts, with what its range knows of the run."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"), F.col("doc_id").cast("long").alias("id"), text.alias("text"))
    normal = F.regexp_replace("text", WHITE_SPACE, "")
    keyed = rows.select("row", "id", "text", F.substring(normal, 1, 16).alias("head"), F.xxhash64(normal).alias("hash"), (-F.length("text")).alias("size"))
    order = [F.col("size"), F.col("id").asc_nulls_last()]
    # a hundred sampled keys a partition reach the driver, none of them longer than the 16 characters
    ranged = keyed.repartitionByRange(scratch.partitions(df), F.col("head"), F.col("hash"), *order)
    sorted_ = ranged.select("row", "id", normal.alias("text"), "head", "hash", "size").sortWithinPartitions("head", "hash", "text", *order)
    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("run", _RUN)])

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        held: list[pa.Array] = []
        state = {"text": None, "size": 0, "keep": None, "start": True}

        def closed(border: bool) -> list[tuple]:
            sha = hashlib.sha256(state["text"]).hexdigest()
            return [(state["keep"], state["size"], i == 0, sha, border or state["start"], number) for i in range(1 if keepers else state["size"])]

        def batch(rows: list[pa.Array], runs: list[tuple]) -> pa.RecordBatch:
            joined = pa.concat_arrays(rows)
            columns = zip(*runs, strict=True)
            run = pa.StructArray.from_arrays([pa.array(c, type=t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.bool_(), pa.int32()), strict=True)], names=_RUN.names)
            return pa.RecordBatch.from_arrays([joined, run], names=["row", "run"])

        for part in parts:
            texts, ids, payload = batches.utf8(part, "text"), part.column(1).to_pylist(), part.column(0)
            begins = [i for i, t in enumerate(texts) if t != (texts[i - 1] if i else state["text"])]
            ahead = begins[0] if begins else len(texts)
            state["size"] += ahead
            rows = held if keepers else [*held, payload.slice(0, ahead)]
            runs: list[tuple] = []
            for i, after in zip(begins, [*begins[1:], len(texts)], strict=True):
                if state["text"] is not None:
                    runs += closed(False)
                    state["start"] = False
                state |= {"text": texts[i], "size": after - i, "keep": ids[i]}
                rows.append(payload.slice(i, 1 if keepers else after - i))
            if runs:
                joined = pa.concat_arrays(rows)
                yield batch([joined.slice(0, len(runs))], runs)
                held = [joined.slice(len(runs))]
            else:
                held = rows
        if state["text"] is not None:
            yield batch(held, closed(True))

    return batches.mapped(sorted_.select("row", "id", "text"), compare, schema)


def _across(runs: DataFrame) -> DataFrame:
    """The runs that may go on in another range, put together: two rows at most from each range."""
    border = runs.where("run.border AND run.first").select("run.*")
    return F.broadcast(border.groupBy("text_sha256").agg(F.sum("run_size").alias("all_size"), F.min("range").alias("first_range"), F.min_by("keep_id", "range").alias("all_keep")))


def groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    runs = scratch.stored(_runs(docs, ["doc_id"], False), "exact-runs")
    joined = runs.select("row.doc_id", "run.*").join(_across(runs), "text_sha256", "left")
    return joined.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("border"), F.col("all_keep")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("all_size", "run_size").alias("group_size"),
                         (F.col("first") & (F.col("first_range").isNull() | (F.col("first_range") == F.col("range")))).alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    runs = scratch.stored(_runs(docs, docs.columns, True), "exact-kept")
    joined = runs.select("row", "run.text_sha256", "run.range", "run.border").join(_across(runs), "text_sha256", "left")
    return joined.where(~F.col("border") | (F.col("first_range") == F.col("range"))).select("row.*")
