"""Physical plans: no cross products, filters and columns reach the scan, windows are never keyed by the entity alone."""

import pytest

import __spark_entry__ as entry

QUERIES = entry.queries()
CHECKED = [
    "agg_conditional_profile", "agg_sessions", "agg_threshold_counts", "asof_prev_next", "cross_join_grid", "join_interval_cause",
    "join_lookback_window", "join_point_in_polygon", "join_radius_haversine", "join_state_dim", "score_auc_brier", "topk_best_in_horizon",
    "win_lags", "win_since_last", "zonal_stats", "fn_bin_equal_width", "win_rank_quantile", "raster_align", "hit_zone_projection",
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", CHECKED)
def test_no_cross_product(spark, small, name):
    text = plan(QUERIES[name](spark, small))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scan_is_pruned_and_filtered(spark, small):
    query = QUERIES["scan_parquet_lazy"](spark, small)._jdf.queryExecution()
    text = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(query, "formatted")
    assert "GreaterThanOrEqual(l_shipdate" in text and "GreaterThan(l_discount" in text and "l_extendedprice" not in text


@pytest.mark.parametrize("name", ["win_lags", "win_rolling_stats", "win_exog_lags", "win_savgol", "agg_past_future_diff"])
def test_series_windows_are_cut_in_blocks(spark, small, name):
    lines = [x for x in plan(QUERIES[name](spark, small)).splitlines() if "Window [" in x or "hashpartitioning" in x]
    assert any("_block" in x for x in lines)


def test_head_per_group_limits_before_the_shuffle(spark, small):
    assert "WindowGroupLimit" in plan(QUERIES["head_per_group"](spark, small))
    assert "WindowGroupLimit" in plan(QUERIES["agg_load_duration"](spark, small))
