"""Registered queries against their SQL twins on the smallest tables (tests/check.py runs them all
at any scale)."""

import os

import pytest
from oracle import compare, connect

from alphaframe.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
SLOW = {"gbt_walk_forward", "reweighted_ensemble", "walk_forward_oos"}
CHOSEN = [
    "flagship", "resample_bars", "scan_bars", "flatten_bars_json", "flatten_company_facts", "resolve_entity_ids",
    "rolling_vol", "rolling_median_dv", "sma_trend", "pct_rank", "quantile_bins", "vol_reference", "market_risk_scale",
    "asof_join", "fundamental_ratios", "universe_top_n", "feature_panel", "factor_summary", "adaptive_weights",
    "daily_mark", "stress_matrix", "pairwise_corr", "balanced_exposure", "threshold_search", "portfolio_grid_search",
    "fold_plan", "regime_router", "latest_run_per_strategy", "stream_fills", "stream_ewma",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", CHOSEN)
def test_query(spark, con, name):
    ok, msg, _ = compare(spark, con, name, QUERIES[name], ORACLES[name], SF)
    assert ok, msg


def test_every_key_is_registered():
    assert len(QUERIES) > 140 and set(ORACLES) <= set(QUERIES)
    assert not SLOW & set(ORACLES)
