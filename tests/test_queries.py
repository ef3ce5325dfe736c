"""Registered queries against their SQL. ALL_QUERIES=1 runs every one of them, otherwise a spread."""
import os

import pytest

import __spark_entry__ as entry
import verify

SPREAD = """candles_1h candles_refresh candle_reconcile daily_ohlc ask_daily_18h game_day_turnover day_spine_state cleaning_days clean_trades
outlier_methods weighted_quantiles item_summary ask_gap_asof depth_quote event_fanout dup_seq merge_sales listing_diff listing_close
invalidate_vanished book_snapshot health_unify collection_stats turnover_rank floor_index cheapest_k merge_trades owner_guards unify_eligible
unify_deltas bucket_signature changed_buckets prune_proven seasonal_profile repetition weekday_trend variance_ratio rolling_backtest naive_band
issue_forecast panel_settle_eval block_bootstrap hourly_event_study did_contrast notice_rows term_match event_upsert stream_candles
stream_rolling_24h""".split()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", list(entry.queries()) if os.environ.get("ALL_QUERIES") else SPREAD)
def test_query_matches_sql(spark, name):
    ok, note = verify.compare(spark, SF, name)
    assert ok, note


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
