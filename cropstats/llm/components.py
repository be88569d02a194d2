"""Connected components of a table of links, in Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropstats.llm import scratch


def components(links: DataFrame) -> DataFrame:
    """``node``, ``component`` (the smallest node reachable) for every node of ``links`` (``a``, ``b``).

    Each round a node takes the smallest label among its neighbours', then the
    label of its label; rounds go on until no label changes, and each is
    written to the shared folder. Nodes with very many links meet only in
    map-side minima and in joins that Spark splits.
    """
    spark, before = links.sparkSession, scratch.mark()
    both = scratch.stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    labels = scratch.stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("near")), "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        step = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = scratch.stored(step.join(jump, "component", "left").select("node", "old", F.least("component", F.coalesce("further", "component")).alias("component")), "labels")
        labels = new.select("node", "component")
        labels._stored_at = new._stored_at
        done = new.where("old <> component").isEmpty()
        scratch.release(spark, before, new, *([] if done else [both]))
        if done:
            return labels
