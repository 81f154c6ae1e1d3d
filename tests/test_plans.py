"""Plans that must hold at any size: no pairs of all rows, not even with a one-row side behind a constant key."""
import pytest

from takt import bindings
from takt.catalog import collect

SF = "/root/testdata/sf0.001"
NAMES = ["unit_threshold", "unit_threshold_grid", "resample_units", "hard_examples", "scope_filter", "observability", "station_economics",
         "recurring_constraints", "financial_overview", "run_block_bootstrap", "upsert_run_history", "headline_messages", "evidence_gates",
         "pr_auc", "metric_table", "policy_table"]


@pytest.mark.parametrize("name", NAMES)
def test_no_cross_join(spark, name):
    plan = collect()[0][name](spark, SF)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_registered_queries_use_the_library_defaults():
    import inspect

    from takt.catalog import hidden, learn
    from takt.operators.occupancy import draw_hypotheses
    assert hidden.K >= inspect.signature(draw_hypotheses).parameters["k"].default
    assert "iterations=" not in inspect.getsource(learn)


@pytest.mark.parametrize("zone", ["Asia/Tokyo", "America/New_York"])
def test_line_clock_is_the_same_under_any_session_zone(spark, zone):
    d, before = "/root/testdata/sf0.001", spark.conf.get("spark.sql.session.timeZone")

    def rows():
        return bindings.line_log(spark, d).select("run_id", "production_day", "timestamp_ms", "event_sequence").orderBy("event_sequence").collect()

    want = rows()
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        assert rows() == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
