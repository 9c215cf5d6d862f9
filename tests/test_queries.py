"""Every registered query against its SQL statement on the smallest tables."""

import glob
import os

import pandas as pd
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not present")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def canonical(df):
    def cell(v):
        if v is None or (pd.api.types.is_scalar(v) and pd.isna(v)):
            return ""
        try:
            return repr(round(float(v), 9))
        except (TypeError, ValueError):
            return str(v)
    return sorted(tuple(cell(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


FAST = ["time_bars_1h", "tick_bars_100", "volume_bars", "vwap_merge", "asof_trades_quotes", "event_concurrency",
        "volatility_level", "ewm_mean_std_span", "frac_diff_fixed_width", "cusum_events", "triple_barrier_labels",
        "concurrency_uniqueness", "purged_kfold", "walk_forward", "train_fit_zscore", "trailing_scale_anchored",
        "threshold_performance", "trade_ledger", "book_best_prices", "stream_order_book", "horizon_label_counts"]


def test_registry_is_consistent():
    queries, statements = entry.queries(), entry.oracle_sql()
    assert set(statements) <= set(queries) and len(queries) > 150


@pytest.mark.parametrize("name", FAST)
def test_query_matches_sql(spark, duck, name):
    got = entry.queries()[name](spark, FOLDER).toPandas()
    want = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
