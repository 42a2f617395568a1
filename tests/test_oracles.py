"""Queries against the same query in SQL on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
KEYS = ["risk_profile", "macd", "adx_14", "reconcile_streams", "apply_corporate_actions", "hurst_dfa", "forecast_multi_horizon", "generate_signal", "resolve_outcomes", "ks_two_sample", "scalar_functions", "adf_test_without_lags", "linear_model", "model_drift", "performance_report", "catalyst_events", "prediction_stats", "forecast_anchored", "prefix_join", "missing_symbols", "rank_predictions", "validate_model", "store_predictions", "adf_test", "fit_ar", "filter_bad_prints", "prepare_verified_matrix", "kalman_track", "rolling_hurst_100", "garch_vol", "ewma_vol_20", "ema_w", "walk_forward_forecasts", "backtest_metrics", "backtest_verdict", "backtest_validation", "covariance_pairs_universe", "portfolio_risk_universe", "rank_universe", "stream_bad_prints", "stream_resolve"]


def rows(df):
    df = df.reindex(sorted(df.columns), axis=1)
    cell = lambda v: None if v is None or v is pd.NA or v != v else float(v) if isinstance(v, int | float) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else str(v)
    return sorted((tuple(map(cell, r)) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("key", KEYS)
def test_same_rows_as_sql(spark, key):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    want, got = con.execute(entry.oracle_sql()[key]).df(), entry.queries()[key](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
