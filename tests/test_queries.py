"""Registered queries against their SQL on the small tables.

By default one query per operator family; BARLOOM_ALL=1 runs every one of them.
"""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
QUICK = (
    "session_bars", "resample_monthly_strict_volume", "provisional_week", "calendar_gaps", "period_status", "daily_quality_issues", "overlay_upstream_volume", "published_weeks",
    "ema_mean_seed", "ema_null_reset", "macd_weekly", "rsi_wilder", "volatility_kinds", "max_drawdown_window", "quadratic_turn", "ma_stack", "upsert_merge", "batch_classification",
    "hash_chain_audit", "html_table_extraction", "latest_vintage_as_of", "trades_asof_price", "overlap_weights", "nearest_match", "expanding_valuation_percentile",
    "weekly_session_sample", "strided_anchor_sample", "golden_black_points", "turn_consistency", "label_losses", "brier_scores", "interval_scores", "position_replay",
    "average_cost_ledger", "money_weighted_returns", "position_performance", "weekly_judgements", "policy_targets", "temperature_calibration", "fan_quantiles", "block_bootstrap",
    "health_states", "similar_windows", "decision_funnel", "streamed_bars", "streamed_positions",
)
NAMES = sorted(entry.oracle_sql()) if os.environ.get("BARLOOM_ALL") else [n for n in QUICK if n in entry.oracle_sql()]


@pytest.fixture(scope="session")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    ok, note, _seconds, _rows = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert ok, note


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
