"""Catalog databases, table sinks and table scans (CAT-1, CAT-2, SNK-1, SNK-2, SRC-6)."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def ensure_database(spark: SparkSession, name: str, location: str | None = None) -> None:
    """``CREATE DATABASE IF NOT EXISTS name [LOCATION …]`` (CAT-1)."""
    stmt = f"CREATE DATABASE IF NOT EXISTS `{name}`"
    if location:
        stmt += f" LOCATION '{location}'"
    spark.sql(stmt)


def databases(spark: SparkSession) -> list[str]:
    """Names of the catalog's databases (CAT-2, ``SHOW DATABASES``)."""
    return [d.name for d in spark.catalog.listDatabases()]


def save_table(df: DataFrame, name: str, fmt: str = "parquet", mode: str = "overwrite",
               partition_by: Sequence[str] = (), bucket_by: tuple[int, Sequence[str]] | None = None,
               sort_by: Sequence[str] = ()) -> None:
    """Write ``df`` as catalog table ``name`` (SNK-1).

    ``fmt`` is a parameter (the reference writes Delta; any installed format
    works). ``partition_by`` lays out large long tables by e.g. ``Year`` so a
    year filter prunes files; ``bucket_by=(n, keys)`` pre-partitions a table
    that is joined repeatedly on ``keys``.
    """
    writer = df.write.format(fmt).mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if bucket_by:
        n, keys = bucket_by
        writer = writer.bucketBy(n, *keys)
        if sort_by:
            writer = writer.sortBy(*sort_by)
    writer.saveAsTable(name)


def replace_partitions(df: DataFrame, name: str, fmt: str = "parquet", partition_by: Sequence[str] = ("Year",),
                       bucket_by: tuple[int, Sequence[str]] | None = None) -> None:
    """Write ``df`` over the partitions that it has rows of; the table's other partitions stay (SNK-1).

    Creates the table, so laid out, where it is missing. The write runs in a
    session of its own with dynamic partition overwrite, so neither the
    caller's settings nor its concurrent writes change; Spark stages the new
    files and moves whole partitions when the job commits, so a lost executor
    leaves no half-written one.
    """
    spark = df.sparkSession
    if not spark.catalog.tableExists(name):
        save_table(df, name, fmt, partition_by=partition_by, bucket_by=bucket_by, sort_by=bucket_by[1] if bucket_by else ())
        return
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    view = f"replace_{uuid.uuid4().hex}"
    df.createGlobalTempView(view)
    try:
        columns = ", ".join(f"`{c}`" for c in spark.table(name).columns)
        own.sql(f"INSERT OVERWRITE TABLE {name} SELECT {columns} FROM global_temp.{view}")
    finally:
        spark.catalog.dropGlobalTempView(view)
    spark.catalog.refreshTable(name)


def analyze_table(spark: SparkSession, name: str, columns: Sequence[str] | None = None) -> None:
    """Row count, size and column statistics for the optimiser, all columns by default (JON-5).

    With ``spark.sql.cbo.enabled`` (set by ``session.build``) Spark orders a
    star's joins and picks broadcasts from these, so no row has to be counted when
    a query is planned.
    """
    what = "FOR ALL COLUMNS" if columns is None else "FOR COLUMNS " + ", ".join(f"`{c}`" for c in columns)
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS {what}")


def save_files(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
               partition_by: Sequence[str] = (), **options: str) -> None:
    """Write ``df`` as files at ``path`` (SNK-2)."""
    writer = df.write.format(fmt).mode(mode).options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def table(spark: SparkSession, name: str) -> DataFrame:
    """Scan a catalog table (SRC-6)."""
    return spark.table(name)
