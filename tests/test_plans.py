"""Physical-plan checks: pushdown, pruning, broadcast of dims, hash aggregation."""

from __future__ import annotations

import contextlib
import io

from cropstats.plans import queries, tables
from tests.conftest import SF_SMALL


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_filters_and_projection_reach_the_scan(spark):
    """FLT-1, FLT-4, FLT-5, FLT-6, PRJ-1."""
    plan = _plan(queries.q25_not_contains(spark, SF_SMALL))
    assert "PushedFilters" in plan
    assert "GreaterThan(p_retailprice,950.0)" in plan
    assert "GreaterThanOrEqual(p_size,10)" in plan
    assert "ReadSchema: struct<p_partkey:bigint,p_name:string,p_brand:string,p_size:int," \
           "p_retailprice:double>" in plan


def test_order_facts_use_hash_aggregate_and_broadcast(spark):
    plan = _plan(tables.yearly_order_facts(spark, SF_SMALL))
    # the joined orders go through a hash aggregate; max() of the whole strings
    # sorts only that aggregate's rows, above it in the tree
    tree = plan.split("\n\n")[0]
    assert "HashAggregate" in tree
    assert tree.rindex("SortAggregate") < tree.index("HashAggregate") < tree.index("Join")


def test_hub_join_is_broadcast(spark):
    """JON-3, JON-4."""
    plan = _plan(queries.q10_feature_join(spark, SF_SMALL))
    assert "BroadcastHashJoin" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_feature_filters_reach_the_scans(spark):
    """FLT-2: element and item go through builder, joins and aggregate to the scans."""
    for query in (queries.q10_feature_join, queries.q10b_feature_join_v2):
        plan = _plan(query(spark, SF_SMALL))
        assert "EqualTo(o_orderstatus,F)" in plan and "EqualTo(c_mktsegment,BUILDING)" in plan


def test_feature_joins_count_nothing_in_advance(spark):
    """JON-5: building the six-table star runs no job."""
    tracker = spark.sparkContext.statusTracker()
    group = "no-job-before-the-action"
    spark.sparkContext.setJobGroup(group, "plan only")
    try:
        queries.q10b_feature_join_v2(spark, SF_SMALL).explain("simple")
        # what does run is the footer read of a file for its schema
        assert not [j for j in tracker.getJobIdsForGroup(group) if (tracker.getJobInfo(j) or 0) and len(tracker.getJobInfo(j).stageIds) > 1]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_unpivot_reads_the_saved_wide_table_only(spark):
    """RSH-2: one scan, one Generate, no exchange."""
    plan = _plan(queries.q01_unpivot_years(spark, SF_SMALL)).split("\n\n")[0]
    assert plan.count("Scan parquet") == 1 and "Generate" in plan and "Exchange" not in plan


def test_series_range_is_one_scan(spark):
    """AGG-9, FLT-3: a window over the series, no join; its filter reaches the scan."""
    plan = _plan(queries.q24_series(spark, SF_SMALL))
    tree = plan.split("\n\n")[0]
    assert tree.count("Scan parquet") == 1 and "Window" in tree and "Join" not in tree
    assert "EqualTo(n_name,NATION_1)" in plan


def test_wide_correlations_are_one_shuffle(spark):
    tree = _plan(queries.q13d_corr_many_columns(spark, SF_SMALL)).split("\n\n")[0]
    assert tree.count("Exchange") == 1 and tree.count("MapInArrow") == 2


def test_corr_by_group_is_one_aggregate(spark):
    df = queries.q13_corr_by_group(spark, SF_SMALL)
    plan = _plan(df)
    assert "Generate" in plan
    assert "CartesianProduct" not in plan


def test_country_dim_is_semi_join(spark):
    plan = _plan(queries.q09_country_dim(spark, SF_SMALL))
    assert "LeftSemi" in plan


def test_no_query_plans_a_cross_join(spark):
    """No registered query may use a Cartesian product or a nested-loop join."""
    import __spark_entry__ as entry

    for name, fn in entry.queries().items():
        plan = _plan(fn(spark, SF_SMALL))
        assert "CartesianProduct" not in plan, name
        assert "BroadcastNestedLoopJoin" not in plan, name
