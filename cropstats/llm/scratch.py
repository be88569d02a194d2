"""Tables written to the shared checkpoint folder, to cut lineage.

A table written here survives lost executors: a later stage reads files, not
shuffle output of a stage that would have to run again.
"""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's setting to delete a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="llm-checkpoint-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


_made = threading.local()


def mark() -> int:
    """How many tables this thread has written so far; see :func:`release`."""
    return len(_paths())


def _paths() -> list[str]:
    if not hasattr(_made, "paths"):
        _made.paths = []
    return _made.paths


def made(since: int) -> list[str]:
    """The paths of the tables that this thread has stored since then and not deleted."""
    return _paths()[since:]


def release(spark: SparkSession, since: int, *keep: DataFrame) -> None:
    """Delete the tables that this thread has stored since ``since``, but for those given.

    For the tables of steps whose results are written: nothing may still read
    them lazily. Each is deleted by the exact path it was written to.
    """
    kept = {df._stored_at for df in keep}
    delete(spark, [p for p in made(since) if p not in kept])


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that this thread has stored."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        if path in _paths():
            _paths().remove(path)
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    The table takes the place of the shuffles that made it, so Spark may delete
    their files as soon as it is written.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    _paths().append(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._stored_at = path
    return table


def partitions(df: DataFrame, least: int = 1) -> int:
    """Shuffle partitions the session asks for, ``least`` at least."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


#: Hash slots of :func:`slots`: the broadcast has this many rows at most, at any size of the corpus.
SLOTS = 1 << 18


def slots(ids: DataFrame) -> DataFrame:
    """The hash slots that hold any of the ids (column ``doc_id``); a table of at most ``SLOTS`` rows."""
    return ids.select(F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(SLOTS)).cast("int").alias("__slot")).distinct()


def in_slots(docs: DataFrame, found: DataFrame, outside: bool = False) -> DataFrame:
    """The rows of ``docs`` whose id may be among those of ``found``, or those whose id surely is not.

    This only saves shuffling: a join on the id has to follow inside. With few
    ids most rows need not move; with very many, all slots are taken and all
    rows move.
    """
    slotted = docs.withColumn("__slot", F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(SLOTS)).cast("int"))
    return slotted.join(F.broadcast(found), "__slot", "left_anti" if outside else "left_semi").drop("__slot")
