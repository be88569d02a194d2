"""Fitted models kept under the shared folder and used again by later sessions (ML-10).

A stored model is a folder ``models/<name>/<version>`` below the folder that
``spark.checkpoint.dir`` names: the model itself, and ``about`` with the
columns it needs, their types, and the row counts of its fit. ``about`` is
written last, so a folder without it is an unfinished save and is not found.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cropstats.operators import ml
from cropstats.operators.linear import LinearMap
from cropstats.session import checkpoint_dir


@dataclass
class StoredModel:
    model: PipelineModel | LinearMap
    inputs: T.StructType
    counts: dict[str, int]

    def score(self, df: DataFrame, counts: Observation | None = None) -> DataFrame:
        """Score another table: its input columns must be there and are read in the types of the fit.

        Raises ``ValueError`` naming columns that are missing or whose type
        cannot be read as that of the fit (text for a number). Rows are skipped
        and counted as by ``ml.scored_rows`` and ``LinearMap.score``.
        """
        have = {f.name: f.dataType for f in df.schema.fields}
        numbers = (T.NumericType, T.BooleanType)
        bad = [f.name for f in self.inputs.fields
               if f.name not in have or (isinstance(f.dataType, T.NumericType) and not isinstance(have[f.name], numbers))]
        if bad:
            raise ValueError(f"columns {bad} are missing or not of the type the model was fitted on")
        df = df.withColumns({f.name: F.col(f"`{f.name}`").cast(f.dataType) for f in self.inputs.fields if have[f.name] != f.dataType})
        if isinstance(self.model, LinearMap):
            return self.model.score(df, counts)
        return ml.scored_rows(self.model, df, counts)


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/models/{name}"


def _files(spark: SparkSession, path: str):
    """Spark's own view of a path: its file system and the path in it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def save(df: DataFrame, model: PipelineModel | LinearMap, name: str, inputs: Sequence[str],
         counts: dict[str, int] | None = None) -> str:
    """Store ``model``, fitted on ``df`` from the columns ``inputs``; returns its version.

    ``counts`` are row counts to keep with it, e.g. what an ``Observation`` of the fit gave.
    """
    spark, version = df.sparkSession, uuid.uuid4().hex
    path = f"{_folder(spark, name)}/{version}"
    about = {"kind": type(model).__name__, "inputs": df.select(*inputs).schema.jsonValue(), "counts": counts or {}}
    if isinstance(model, LinearMap):
        about["map"] = asdict(model)
    else:
        model.save(f"{path}/model")
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path}/about")
    return version


def versions(spark: SparkSession, name: str) -> list[str]:
    """The complete versions of a model, oldest first."""
    fs, at = _files(spark, _folder(spark, name))
    if not fs.exists(at):
        return []
    found = []
    for status in fs.listStatus(at):
        _, done = _files(spark, f"{status.getPath().toString()}/about/_SUCCESS")
        if fs.exists(done):
            found.append((fs.getFileStatus(done).getModificationTime(), status.getPath().getName()))
    return [v for _, v in sorted(found)]


def load(spark: SparkSession, name: str, version: str | None = None) -> StoredModel:
    """A stored model, the newest if no version is given."""
    known = versions(spark, name)
    if not known or (version is not None and version not in known):
        raise ValueError(f"no model {name!r}" + (f" of version {version!r}" if version else ""))
    path = f"{_folder(spark, name)}/{version or known[-1]}"
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    model = LinearMap(**about["map"]) if about["kind"] == "LinearMap" else PipelineModel.load(f"{path}/model")
    return StoredModel(model, T.StructType.fromJson(about["inputs"]), about["counts"])
