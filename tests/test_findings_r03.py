"""Pairs by products of blocks, where round 3 found queries that made a row of each meeting."""

import pytest
from test_findings_r02 import QUERIES, events, same


@pytest.mark.parametrize("name", ("fleet_cores", "identity_links", "copresence_events", "identity_clusters", "identity_scores"))
def test_meetings_are_no_rows(spark, tmp_path, monkeypatch, name):
    """In blocks of a few nodes, matrices of a few columns and runs of a few pairs the result is that of the SQL; before, the plan had the rows of two that met."""
    from lodestar.operators import block_pairs, relational

    monkeypatch.setattr(relational, "BLOCK", 3)
    for k, v in (("COLUMNS", 7), ("RUN", 5), ("CELLS", 1)):
        monkeypatch.setattr(block_pairs, k, v)
    days = [(86_400 * k + 60 * u, u) for k in range(29) for u in (0, 10, 20, 30, 7, 17)]
    events(spark, tmp_path, days + [(3600 * ((k * k) % 700) + 97 * (k % 29), k % 41) for k in range(2500)])
    assert same(spark, tmp_path, name, "events") > 0
    plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "_p#" not in plan
    assert "MapInArrow" in plan or name == "identity_clusters"


def test_a_cluster_sends_a_forest(spark, tmp_path):
    """Forty alike make 780 links and one cluster; 39 links leave the task, where before all did."""
    from lodestar.plans import spy

    events(spark, tmp_path, [(60 * k + u, 5 * u) for k in range(4) for u in range(40)])
    df = spark.read.parquet(f"{tmp_path}/events.parquet").selectExpr("event_id", "ts", "user_id", "event_type", "value", "'{\"k\": 3}' as props")
    df.write.parquet(f"{tmp_path}/alike/events.parquet")
    assert QUERIES["identity_links"](spark, f"{tmp_path}/alike").count() == 780
    assert spy.cluster_forest(spark, f"{tmp_path}/alike").count() == 39
    assert same(spark, tmp_path / "alike", "identity_clusters", "events") == 1
