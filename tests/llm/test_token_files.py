"""Lookups by id in the ORC files: right rows, and row groups left out by index and Bloom filter."""

from __future__ import annotations

from tokenizers import Tokenizer

from cropstats.llm import queries, scratch, token_files


def _rows_read(df) -> int:
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().get("numOutputRows").get().value() for i in range(leaves.size()))


def test_lookup_reads_only_the_row_groups_that_may_hold_the_ids(spark):
    path = scratch.fresh_path(spark, "test-lookup")
    # ids are multiples of 7, so an id between two of them is within the minima and maxima
    docs = spark.range(6000).selectExpr("id * 7 AS doc_id", "concat('text number ', id) AS text")
    token_files.write(docs, path, queries.byte_bpe(), files=1)
    found = token_files.lookup(spark, path, [7 * 1500])
    rows = found.collect()
    library = Tokenizer.from_file(queries.byte_bpe())
    assert [r.ids for r in rows] == [[*library.encode("text number 1500", add_special_tokens=False).ids, 0]]
    assert "In(doc_id" in found._jdf.queryExecution().executedPlan().toString() or "EqualTo(doc_id" in found._jdf.queryExecution().executedPlan().toString()
    assert _rows_read(found) <= 2 * token_files.ROW_GROUP
    absent = token_files.lookup(spark, path, [7 * 1500 + 3])
    assert absent.collect() == [] and _rows_read(absent) < 6000
