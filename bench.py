"""Headline timings: prints one JSON line.

Registered queries run end to end from the given files. The `stored_*` entries time an operator on snapshots
and bars written once beforehand, which is how the published database timings are taken. Cached intermediates
are dropped before every run; each value is the median of the timed runs after one warm-up.
"""
from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from tidebook.catalog import QUERIES
from tidebook.operators import candles, market, seasonal
from tidebook.session import get_session
from tidebook.sources.bindings import AS_OF, Inputs

HEADLINE = ["candles_1h", "candles_1h_volume", "daily_ohlc", "candle_reconcile", "game_day_turnover", "cleaning_days", "weighted_quantiles",
            "outlier_methods", "item_summary", "ask_gap_asof", "turnover_rank", "listing_diff", "merge_trades", "unify_candles", "bucket_signature",
            "changed_buckets", "seasonal_profile", "random_walk_report", "rolling_backtest", "naive_band_score", "did_contrast",
            "hourly_event_study", "html_text"]
RUNS = int(os.environ.get("BENCH_RUNS", "2"))


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
                        spark__ui__showConsoleProgress="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    work = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    x = Inputs(spark, folder)
    x.snapshots().write.parquet(f"{work}/snapshots")
    x.candles().write.parquet(f"{work}/bars")
    snaps, bars = lambda: spark.read.parquet(f"{work}/snapshots"), lambda: spark.read.parquet(f"{work}/bars")
    jobs = {n: (lambda n=n: QUERIES[n](spark, folder)) for n in HEADLINE}
    jobs.update({
        "stored_ask_daily_18h": lambda: candles.ask_daily_18h(snaps(), "error"),
        "stored_stock_daily_18h": lambda: candles.stock_daily_18h(snaps()),
        "stored_seasonal_inputs": lambda: seasonal.seasonal_inputs(bars(), snaps(), AS_OF, "error"),
        "stored_last_snapshot": lambda: market.last_snapshot(snaps(), AS_OF, "error"),
        "stored_daily_ohlc": lambda: candles.daily_ohlc(bars()),
    })
    took: dict[str, float] = {}
    for name, job in jobs.items():
        times = []
        for i in range(RUNS + 1):
            spark.catalog.clearCache()
            start = time.perf_counter()
            job().write.format("noop").mode("overwrite").save()
            if i:
                times.append(time.perf_counter() - start)
        took[name] = round(statistics.median(times), 4)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf,
                      "cpus": int(cpus), "snapshot_rows": snaps().count(), "bar_rows": bars().count()}))


if __name__ == "__main__":
    main()
