"""Registered queries against DuckDB on the small tables (all of them with TAKT_FULL=1)."""
import os

import pytest

from takt.catalog import collect
from tests.compare import compare, duck

SF = os.environ.get("TAKT_SF", "/root/testdata/sf0.001")
QUERIES, ORACLE = collect()
QUICK = ["bottleneck_features", "defect_features", "pair_fifo", "assign_by_interval", "series_analytics", "warning_periods", "recurring_constraints",
         "policy_table", "station_posterior", "attribute_readings", "corridor_load", "interval_ticks", "boundary_allocation", "fit_dwell", "resample_units", "median_bootstrap", "nearest_load", "evidence_gates", "metric_table", "split_bus", "sequence_gaps", "alert_policy_stream", "read_run_table",
         "read_run_bundles", "evidence_feedback", "causal_replay", "causal_replay_quality", "interval_ticks_stream", "rate_windows"]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(QUERIES) if os.environ.get("TAKT_FULL") else QUICK)
def test_query(spark, con, name):
    message, rows = compare(spark, con, SF, QUERIES[name], ORACLE.get(name))
    assert not message or message.startswith("NOTE"), message


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
