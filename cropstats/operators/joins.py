"""Join helpers (JON-2..JON-5, FLT-8).

Nothing is counted or hinted when a query is planned. A side is broadcast when
its size in bytes is known to be under Spark's threshold: from the files, from
table statistics (``catalog.analyze_table``), or at run time, when AQE sees the
finished stage below a join. Otherwise the join shuffles, with skew splitting.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def filter_to_keys(df: DataFrame, key: str, keys: DataFrame, keys_col: str) -> DataFrame:
    """Keep the rows of ``df`` whose ``key`` is in ``keys``, whatever their number.

    A left-semi join: Spark broadcasts the key list when its size in bytes
    allows that, and shuffles both sides otherwise. The rows are the same.
    """
    listed = keys.select(F.col(keys_col).alias("__fk")).distinct()
    return df.join(listed, F.col(key) == F.col("__fk"), "left_semi")


@dataclass
class Dim:
    """One dimension of a star join: ``fact.left == dim.right`` for each pair."""

    df: DataFrame
    on: Mapping[str, str]
    select: Sequence[str] = field(default_factory=tuple)
    how: str = "inner"


def star_join(fact: DataFrame, dims: Sequence[Dim]) -> DataFrame:
    """Join ``fact`` to each dimension in turn (JON-3/4/5, PRJ-11).

    Dimension columns are brought in under the names in ``Dim.select``, and a
    later dimension may join on one of them. All renames are in one projection
    above the joins, so the optimiser sees plain inner joins: it prunes
    columns, pushes filters to each scan, infers ``IS NOT NULL`` for the keys, and
    where tables have statistics orders the joins by cost.
    """
    at = {c: c for c in fact.columns}
    out = fact
    for i, d in enumerate(dims):
        own = {c: f"__d{i}_{c}" for c in dict.fromkeys([*d.on.values(), *d.select])}
        right = d.df.select(*[F.col(f"`{c}`").alias(a) for c, a in own.items()])
        cond = F.lit(True)
        for k, (left_col, right_col) in enumerate(d.on.items()):
            equal = F.col(f"`{at[left_col]}`") == F.col(f"`{own[right_col]}`")
            cond = equal if k == 0 else cond & equal
        out = out.join(right, cond, d.how)
        at |= {c: own[c] for c in d.select}
    return out.select(*[F.col(f"`{a}`").alias(c) for c, a in at.items()])


def keys_present_in(dim: DataFrame, facts: DataFrame, dim_key: str, fact_key: str,
                    columns: Sequence[str] | None = None) -> DataFrame:
    """Distinct dimension rows whose key occurs in the facts (FLT-8, AGG-7, DST-1).

    Written as a left-semi join: ``SELECT DISTINCT … FROM dim JOIN facts`` is
    not turned into a semi join by Catalyst and would shuffle the whole fact
    side through a join and an aggregate. The fact side is first reduced to
    its distinct keys (partial hash aggregate on the map side), so a key that
    holds a third of the facts becomes one row before any join.
    """
    cols = list(columns) if columns else dim.columns
    keys = facts.select(F.col(fact_key).alias("__k")).distinct()
    semi = dim.join(keys, F.col(dim_key) == F.col("__k"), "left_semi")
    return semi.select(*cols).distinct()


def assert_unique(df: DataFrame, keys: Sequence[str]) -> None:
    """Raise if ``keys`` do not identify rows of ``df`` (K14 guard)."""
    dup = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if dup:
        raise ValueError(f"duplicate key {dict(dup[0].asDict())} for {list(keys)}")
