"""Plans are what they should be: columns pruned, filters at the scan, partial aggregates before shuffles, group limits before sorts."""

import re

import pytest

from lodestar.plans import registry

SF = "/root/testdata/sf0.001"
Q = registry.queries()


def plan(spark, name):
    return Q[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name, table, columns",
    [
        ("stock_rollup_1d", "lineitem", {"l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate"}),
        ("events_rollup_1h", "events", {"ts", "user_id", "value"}),
        ("alliance_ship_topk", "supplier", {"s_suppkey", "s_nationkey"}),
        ("refresh_tiers", "events", {"ts", "user_id"}),
    ],
)
def test_scans_read_what_they_need(spark, name, table, columns):
    for m in re.finditer(r"FileScan parquet \[([^\]]*)\][^\n]*?/" + table + r"\.parquet", plan(spark, name)):
        assert {c.split("#")[0] for c in m[1].split(",")} <= columns, m[1]


def test_filters_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    p = plan(spark, "type_names_resolved")
    assert "GreaterThanOrEqual(l_quantity" in p and "In(l_returnflag" in p and "GreaterThan(p_size" in p


@pytest.mark.parametrize("name", ["price_rollup_1d", "orderbook_projection", "hull_loss_1d", "battle_rollups", "feature_windows"])
def test_aggregates_are_partial_before_the_shuffle(spark, name):
    assert "partial_" in plan(spark, name)


@pytest.mark.parametrize("name", ["latest_snapshot_per_type", "alliance_geo_topk", "top_sources_per_type"])
def test_group_limit_comes_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan(spark, name)


@pytest.mark.parametrize("name", sorted(set(Q) - {"streamed_rollup_1h", "shadow_model"}))
def test_no_product_and_no_row_python(spark, name):
    p = plan(spark, name)
    assert "CartesianProduct" not in p and "BatchEvalPython" not in p
