"""Readers for the landed input files (SRC-1..SRC-5, SRC-8).

All readers take an explicit schema: no inference pass over the data, and no
type that depends on which rows happened to be sampled (K5, K16).
"""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cropstats import schemas


def read_delimited(spark: SparkSession, path: str | Sequence[str],
                   schema: T.StructType | str | None = None, header: bool = True,
                   sep: str = ",", infer: bool = True, **options: str) -> DataFrame:
    """Delimited text with a header (SRC-1). Pass a schema in production.

    Without one, Spark infers types with an extra pass (the reference's
    ``inferSchema=True``) or, with ``infer=False``, reads every column as
    text bound by its header name. Duplicate header names get their position
    appended (``Average surface temperature4``, K8).
    """
    reader = spark.read.option("header", header).option("sep", sep)
    for k, v in options.items():
        reader = reader.option(k, v)
    if schema is not None:
        reader = reader.schema(schema)
    else:
        reader = reader.option("inferSchema", infer)
    return reader.csv(path if isinstance(path, str) else list(path))


def _file_path() -> F.Column:
    return F.col("_metadata.file_path")


def first_lines(spark: SparkSession, paths: Sequence[str]) -> dict[str, str | None]:
    """The first line of each file that is not blank, ``None`` if there is none.

    Opens each file through Spark's file systems and reads its first buffer
    only, gzip and the like included; a thread each for a few files at a time.
    The driver holds one line per file of its own file listing.
    """
    jvm = spark._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)

    def first(path: str) -> str | None:
        at = jvm.org.apache.hadoop.fs.Path(path)
        stream = at.getFileSystem(conf).open(at)
        try:
            codec = codecs.getCodec(at)
            text = codec.createInputStream(stream) if codec is not None else stream
            reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(text, "UTF-8"))
            line = reader.readLine()
            while line is not None and not line.strip("\ufeff \t\r"):
                line = reader.readLine()
            return line.removeprefix("\ufeff") if line is not None else None
        finally:
            stream.close()

    with ThreadPoolExecutor(16) as pool:
        return dict(zip(paths, pool.map(first, paths), strict=True))


def listed_files(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """The files below ``paths``, by Spark's listing, as paths that its readers take."""
    found = spark.read.option("recursiveFileLookup", True).text(list(paths)).inputFiles()
    return [spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(f)).toString() for f in found]


def bound_columns(header: Sequence[str], wanted: Sequence[str]) -> dict[str, int] | None:
    """The place of each wanted column in a header, whatever its case; ``None`` if one is missing.

    An exact name wins over one that differs in case; two that differ in case
    only, none of them exact, are an error.
    """
    places: dict[str, int] = {}
    for name in wanted:
        exact = [i for i, h in enumerate(header) if h == name]
        alike = exact or [i for i, h in enumerate(header) if h.strip().casefold() == name.casefold()]
        if not alike:
            return None
        if not exact and len(alike) > 1:
            raise ValueError(f"column {name!r} is ambiguous in header {list(header)}")
        places[name] = alike[0]
    return places


def read_yearly_files(spark: SparkSession, path: str | Sequence[str],
                      columns: Mapping[str, str], year_regex: str,
                      year_col: str = "Year", sep: str = ",") -> DataFrame:
    """One delimited file per year, the year taken from the file path (SRC-2, SET-1).

    ``columns`` maps wanted column name → type. Files may order their columns
    differently, carry extra ones and write names in another case: a single
    glob read would bind by position and silently swap them. So each file's
    header, its first line, is read beforehand (``first_lines``), files are
    grouped by header, and each group is read once with its own schema and
    selected by name; the groups are then unioned by name. A file whose header
    lacks a column fails the read; a blank file has no rows.
    """
    headers = first_lines(spark, listed_files(spark, [path] if isinstance(path, str) else path))
    layouts: dict[tuple[str, ...], list[str]] = {}
    missing = []
    for file, line in headers.items():
        if line is None:
            continue
        names = tuple(next(csv.reader([line], delimiter=sep)))
        if bound_columns(names, list(columns)) is None:
            missing.append(file)
        layouts.setdefault(names, []).append(file)
    if missing:
        raise ValueError(f"no header naming {list(columns)} in: {missing[:5]}"
                         f"{' …' if len(missing) > 5 else ''}")
    parts = []
    for names, files in layouts.items():
        unique = _unique(names)
        fields = [T.StructField(n, T.StringType()) for n in unique]
        places = bound_columns(names, list(columns))
        df = (spark.read.schema(T.StructType(fields)).option("header", True)
              .option("enforceSchema", True).option("sep", sep).csv(files))
        parts.append(df.select(
            *[F.col(f"`{unique[places[n]]}`").try_cast(t).alias(n) for n, t in columns.items()],
            F.regexp_extract(_file_path(), year_regex, 1).try_cast("int").alias(year_col)))
    if not parts:
        schema = ", ".join(f"`{n}` {t}" for n, t in columns.items()) + f", `{year_col}` int"
        return spark.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _unique(names: Sequence[str]) -> list[str]:
    """Header names as schema names: a name seen before, in any case, gets its place appended."""
    seen: set[str] = set()
    out = []
    for i, n in enumerate(names):
        n = n.replace("`", "") or f"_c{i}"
        while n.casefold() in seen:
            n = f"{n}{i}"
        seen.add(n.casefold())
        out.append(n)
    return out


def read_station_daily(spark: SparkSession, path: str | Sequence[str],
                       id_regex: str = r"([^/]+?)\.csv(?:\.gz)?$",
                       station_col: str = "StationId",
                       schema: T.StructType = schemas.DAILY_WEATHER) -> DataFrame:
    """Headerless daily CSV per station, gzip or plain; id from the path (SRC-3).

    Replaces the per-station HTTP fetch (UDF-1): the files are landed first,
    then read in one scan. A gzip file is one task (not splittable), so the
    parallelism is the file count, not a manual ``repartition(100)`` (UDF-3).
    """
    paths = [path] if isinstance(path, str) else list(path)
    df = (spark.read.schema(schema).option("header", False)
          .option("recursiveFileLookup", True).csv(paths))
    return df.withColumn(station_col, F.regexp_extract(_file_path(), id_regex, 1))


def read_stations(spark: SparkSession, path: str,
                  schema: str = "id string, country string") -> DataFrame:
    """Station list, a (gzip) JSON array, reduced to its needed fields (SRC-4, UDF-2).

    ``NA`` (Namibia) stays a string; only a JSON ``null`` becomes NULL (K9).
    """
    return spark.read.schema(schema).option("multiLine", True).json(path)


def numbered_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Lines of text files with their ``path`` and a ``place`` that grows from line to line of a file.

    A split's lines come in order and a split starts at a known offset of its
    file, so (offset, running number) orders a file's lines without a sort.
    """
    lines = spark.read.text([path] if isinstance(path, str) else list(path))
    return lines.select("value", _file_path().alias("path"),
                        F.struct(F.col("_metadata.file_block_start").alias("offset"),
                                 F.monotonically_increasing_id().alias("number")).alias("place"))


def read_sheet_export(spark: SparkSession, path: str | Sequence[str], columns: Mapping[str, str],
                      key_col: str, key_regex: str | None = None) -> DataFrame:
    """A sheet saved as delimited text whose header sits below a preamble (SRC-5).

    Stands in for ``read_excel(sheet, header=n)``: in each file the header is
    the first line with a cell ``key_col`` (one line per file to the driver),
    wanted columns are bound by name from it, and every line below it is a row,
    those with a blank key included; only lines without any content are none.
    ``key_regex`` keeps rows whose key matches it. Cells are cast with
    ``try_cast``, so an empty or non-numeric score is NULL. A file without a
    header fails the read. A cell may hold the separator in quotes, no line break.
    """
    lines = numbered_lines(spark, path)
    key = key_col.casefold()
    cells = F.transform(F.split("value", ","), lambda c: F.lower(F.regexp_replace(c, '^[\ufeff\\s"]+|[\\s"]+$', "")))
    is_header = F.array_contains(cells, key) if "," not in key_col else F.lower("value").contains(key)
    heads = (lines.groupBy("path").agg(F.min_by("value", F.when(is_header, F.col("place"))).alias("line"),
                                       F.min(F.when(is_header, F.col("place"))).alias("place")).collect())  # a row per file
    if not heads or any(h["place"] is None for h in heads):
        lost = [h["path"] for h in heads if h["place"] is None]
        raise ValueError(f"no header row naming {key_col!r} in {lost[:5] or path}")
    parts = []
    layouts: dict[tuple[str, ...], list] = {}
    for h in heads:
        layouts.setdefault(tuple(next(csv.reader([h["line"].removeprefix("\ufeff")]))), []).append(h)
    for names, files in layouts.items():
        places = bound_columns(names, [*columns, key_col])
        if places is None:
            raise ValueError(f"columns {[c for c in columns if bound_columns(names, [c]) is None]} not in header of {files[0]['path']}")
        starts = spark.createDataFrame([(h["path"], h["place"]) for h in files], "__path string, __start struct<offset:bigint,number:bigint>")
        raw = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(names))])
        # a row per file of this read, which the driver has already listed
        below = lines.join(F.broadcast(starts), (F.col("path") == F.col("__path")) & (F.col("place") > F.col("__start")))
        rows = below.where(F.col("value").rlike('[^,\\s"]')).select(F.from_csv("value", raw.simpleString()).alias("row")).select("row.*")
        if key_regex is not None:
            rows = rows.where(F.col(f"_c{places[key_col]}").rlike(key_regex))
        parts.append(rows.select(*[F.col(f"_c{places[n]}").try_cast(t).alias(n) for n, t in columns.items()]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_lookup(spark: SparkSession, path: str,
                schema: T.StructType | str = schemas.FLAGS) -> DataFrame:
    """Small code → text lookup with a header, e.g. the flag table (SRC-8).

    A leading UTF-8 byte-order mark is stripped by the CSV reader (K9).
    """
    return spark.read.schema(schema).option("header", True).csv(path)


def lookup_from_values(spark: SparkSession, rows: Sequence[tuple],
                       schema: T.StructType | str = schemas.FLAGS) -> DataFrame:
    """The same lookup from fixed values (SRC-7)."""
    return spark.createDataFrame(list(rows), schema)
