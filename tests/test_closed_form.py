"""Small cases with results known by hand."""
import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidebook.operators import candles, cleaning, events, forecast, health, ingest, ledger, market, merge, notices, seasonal, stats

TS = "timestamp"


def ts(df, *cols):
    return df.withColumns({c: F.col(c).cast(TS) for c in cols})


def trades(spark, rows):
    return ts(spark.createDataFrame(rows, "id long, item_id string, sold_date string, unit_price long, qty int"), "sold_date").withColumn("category", F.lit("goods"))


def test_dup_seq_counts_equal_keys_in_order(spark, rows):
    s = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b"), (3, "a")], "pos long, k string")
    assert rows(ingest.dup_seq(s, [], ["k"], "pos", chunk_rows=2), "pos", "dup_seq") == [(0, 0), (1, 1), (2, 0), (3, 2)]


def test_saturation_needs_a_full_newer_response(spark):
    r = ts(spark.createDataFrame([
        ("a", "2024-01-01 00:00:00", 100, "2024-01-01 00:00:00"), ("a", "2024-01-01 01:00:00", 100, "2024-01-01 00:30:00"),
        ("a", "2024-01-01 02:00:00", 99, "2024-01-01 01:30:00"), ("a", "2024-01-01 03:00:00", 100, "2024-01-01 02:00:00")],
        "item_id string, started_at string, sold_rows int, oldest_sold string"), "started_at", "oldest_sold")
    r = r.withColumn("error", F.lit(None).cast("string")).withColumn("finished_at", F.col("started_at"))
    assert [x["saturated"] for x in ingest.saturation(r, 100).orderBy("started_at").collect()] == [False, True, False, False]


def test_unreadable_times_are_left_out(spark):
    s = spark.createDataFrame([(1, "2024-01-01 09:00:00"), (2, "soon")], "id long, sold_text string")
    assert [(r["id"], r["sold_date"]) for r in ingest.ingest_sales(s).collect()] == [(1, dt.datetime(2024, 1, 1))]


def test_capped_response_proves_nothing_above_its_top(spark, rows):
    """Three polls; the second shows two cheap rows only and is capped at two."""
    day = lambda d: f"2024-01-0{d} 00:00:00"
    data = [(n, "i", "c", day(d), day(d), i, p, c, "2024-01-09 00:00:00") for i, (n, d, p, c) in enumerate([
        ("cheap", 1, 10, 5), ("dear", 1, 90, 7), ("gone", 1, 20, 4), ("cheap", 2, 10, 3), ("new", 2, 30, 1), ("cheap", 3, 10, 3)])]
    r = ts(spark.createDataFrame(data, "auction_no string, item_id string, category string, batch string, observed_at string, id long, unit_price long, cur_count int, expire_date string"),
           "batch", "observed_at", "expire_date").withColumns({"upgrade": F.lit(None).cast("int"), "upgrade_max": F.lit(None).cast("int")})
    got = rows(ingest.listing_diff(r, cap=2), "auction_no", "reason", "qty_sold", F.dayofmonth("observed_at").alias("d"))
    # Poll 1 and 2 are capped, so "dear" is only judged by poll 3; "gone" is below poll 2's top of 30.
    assert got == [("cheap", "partial", 2, 2), ("dear", "vanished_before_expiry", 7, 3), ("gone", "vanished_before_expiry", 4, 2), ("new", "vanished_before_expiry", 1, 3)]


def test_bar_of_two_sales_and_backfill(spark):
    t = trades(spark, [(1, "a", "2024-01-01 00:10:00", 100, 1), (2, "a", "2024-01-01 00:10:00", 200, 1), (3, "a", "2024-01-01 01:00:00", 300, 2)])
    b = {r["hour"].hour: r for r in candles.candles_1h(t).collect()}
    assert (b[0]["o"], b[0]["c"], b[0]["n"], b[0]["vwap"]) == (100, 200, 2, 150.0)
    stored = candles.candles_1h(t.filter("id < 3")).withColumn("raw_complete", F.lit(True))
    once = candles.candles_refresh(stored, t, "2024-01-01 00:00:00")
    twice = candles.candles_refresh(once, t, "2024-01-01 00:00:00")
    key = lambda d: sorted(map(tuple, d.select("item_id", "hour", "o", "n", "vwap").collect()))
    assert key(once) == key(twice) and len(key(once)) == 2


def test_reconcile_finds_a_corrupted_bar_and_pending_sales(spark):
    t = trades(spark, [(i, "a", f"2024-01-01 0{i}:00:00", 100 + i, 1) for i in range(5)])
    held = candles.candles_1h(t.filter("id <= 3"))
    run = lambda h: candles.candle_reconcile(t, h, "2024-01-01 00:00:00", "2024-01-02 00:00:00", 3).first().asDict()
    assert run(held) == {"bars": 4, "pending_bars": 1, "pending_trades": 1, "mismatches": 0}
    assert run(held.withColumn("h", F.when(F.hour("hour") == 2, 0).otherwise(F.col("h"))))["mismatches"] == 1
    assert run(held.filter(F.hour("hour") != 1))["mismatches"] == 1


def test_last_hour_price_excludes_its_open_end(spark):
    t = trades(spark, [(1, "a", "2024-01-01 11:30:00", 100, 1), (2, "a", "2024-01-01 12:00:00", 100, 1), (3, "a", "2024-01-01 11:45:00", 130, 10),
                       (4, "a", "2024-01-01 11:00:00", 999, 9), (5, "a", "2024-01-01 12:00:01", 999, 9)])
    assert market.vwap_1h(t, "2024-01-01 12:00:00").first()["vwap1h"] == 125.0


def test_cleaning_bounds_are_inclusive(spark, rows):
    prices = [1000] * 20 + [100, 10000, 99, 10001, 5000000]
    t = trades(spark, [(i, "a", "2024-01-01 05:00:00", p, 1 if p == 1000 else i) for i, p in enumerate(prices)])
    bars = candles.candles_1h(t).withColumn("category", F.lit("goods"))
    days = cleaning.cleaning_days(t, bars, F.lit(10**9), "cards", "UTC")
    d = days.first()
    assert (d["median"], d["excluded_n"], d["excluded_qty"], d["verified"]) == (1000.0, 3, 22 + 23 + 24, True)
    kept = {r["unit_price"] for r in cleaning.clean_trades(t, days, "cards", "UTC").collect()}
    assert kept == {1000, 100, 10000}
    thin = cleaning.cleaning_days(t, bars.withColumn("n", F.col("n") + 1), F.lit(10**9), "cards", "UTC")
    assert not thin.first()["verified"] and cleaning.clean_trades(t, thin, "cards", "UTC").count() == 0


def test_quantity_weighted_quartiles(spark):
    data = [(80, 100), (10, 200), (10, 200), (1, 900)]
    t = trades(spark, [(i, "a", "2024-01-01 05:00:00", p, q) for i, (q, p) in enumerate(data)])
    items = spark.createDataFrame([("a", "goods", True)], "item_id string, category string, tracked boolean")
    run = lambda b: {r["kind"]: (r["q25"], r["median"], r["q75"]) for r in cleaning.weighted_quantiles(t, b, items, F.lit(99), "cards", "UTC").collect()}
    assert run(candles.candles_1h(t)) == {"day": (100, 100, 100), "hour": (100, 100, 100)}
    assert run(candles.candles_1h(t.filter("id > 0"))) == {"day": (None,) * 3, "hour": (None,) * 3}


def test_game_day_starts_at_six_and_absent_days_stay_null(spark):
    t = trades(spark, [(1, "a", "2024-01-10 20:59:00", 100, 2), (2, "a", "2024-01-10 21:00:00", 900, 2)])
    items = spark.createDataFrame([("a", "goods", True)], "item_id string, category string, tracked boolean")
    d = {str(r["day"]): r["amount"] for r in candles.game_day_turnover(candles.candles_1h(t), items, "2024-01-20 00:00:00", "cards").collect()}
    assert len(d) == 30 and d["2024-01-10"] == 200.0 and d["2024-01-11"] == 1800.0 and d["2024-01-12"] is None


def test_hour_end_is_picked_before_it_is_judged(spark):
    rows_ = [(i, "a", "cards", 0, 3, f"2024-01-01 {i:02d}:10:00", 100) for i in range(18)] + [(50, "a", "cards", 0, 3, "2024-01-01 17:50:00", None)]
    s = ts(spark.createDataFrame(rows_, "id long, item_id string, category string, upgrade int, upgrade_max int, captured_at string, min_unit_price long"), "captured_at")
    assert candles.ask_daily_18h(s, "cards", "UTC").first()["value"] is None
    assert candles.ask_daily_18h(s, "cards", "UTC", legacy=True).first()["value"] == 100.0


def test_ladder_recovers_cools_down_and_alerts_once():
    l = health.AlarmLadder()
    steps = [(0, 30), (5, 30), (10, 30), (15, 30), (20, 30), (25, 30), (400, 5)]
    assert [l.check(m, g, 0) for m, g in steps] == ["recover", "recover_cooldown", "recover", "alert", "alert_cooldown", "alert_cooldown", "ok"]


def test_merge_keeps_the_first_source_and_renumbers(spark, rows):
    s = ts(spark.createDataFrame([("B", 1, 7, "a", "2024-01-01 00:00:00", 5), ("A", 0, 9, "a", "2024-01-01 00:00:00", 5), ("A", 0, 3, "a", "2024-01-01 00:00:01", 5), ("B", 1, 2, "a", "2024-01-02 00:00:00", 5)],
                                 "source string, source_rank int, id long, item_id string, sold_date string, unit_price long"), "sold_date")
    m = merge.merge_trades(s, "2024-01-03 00:00:00", ["item_id", "sold_date", "unit_price"], chunk_rows=4)
    assert rows(m, "id", "source", "source_id") == [(1, "A", 3), (2, "A", 9), (3, "B", 2)]


def test_weekly_changes_are_rounded_before_the_median(spark):
    day = lambda w, i: f"2024-01-{8 + 7 * w + i:02d}"
    data = [("a", day(w, i), v, 1) for w, v in ((0, 70.0), (1, 110.0)) for i in range(5)] + [("b", day(w, i), v, 2) for w, v in ((0, 100.0), (1, 90.0)) for i in range(7)]
    data += [("c", day(w, i), 1.0, 1) for w in (0, 1) for i in range(4)]
    d = spark.createDataFrame(data, "item_id string, day string, vwap double, qty long").withColumn("day", F.col("day").cast("date"))
    m = seasonal.weekly_market(d, "2024-01-24 00:00:00")
    assert {r["item_id"]: r["change_pct"] for r in m.collect()} == {"a": 57.1, "b": -10.0}
    b = seasonal.weekly_breadth(m).first()
    assert (b["up"], b["down"], b["median_pct"], b["risers"]) == (1, 1, pytest.approx(23.55), "a")


def test_variance_ratio_and_holm(spark):
    p, returns = [100.0], [.01, -.02, .01, 0.0] * 10
    for x in returns:
        p.append(p[-1] * math.exp(x))
    bars = spark.createDataFrame([("a", i * 3600, v) for i, v in enumerate(p)], "item_id string, s long, vwap double").withColumn("hour", F.timestamp_seconds("s"))
    r = stats.variance_ratio(bars).first()
    n, mu = 40, sum(returns) / 40
    sq = [(x - mu) ** 2 for x in returns]
    two = sum((returns[i] + returns[i - 1] - 2 * mu) ** 2 for i in range(1, 40))
    vr = two / (2 * (n - 1) * (1 - 2 / n)) / (sum(sq) / (n - 1))
    theta = sum(sq[i] * sq[i - 1] for i in range(1, 40)) / sum(sq) ** 2
    assert r["vr"] == pytest.approx(vr) and r["z"] == pytest.approx((vr - 1) / math.sqrt(theta))
    assert r["p"] == pytest.approx(math.erfc(abs(r["z"]) / math.sqrt(2)), abs=2e-7)
    short = stats.variance_ratio(bars.filter("s < 3600 * 20")).first()
    assert short["vr"] is None and short["bars"] == 20
    t = spark.createDataFrame([("a", .01), ("b", .04), ("c", .03)], "item_id string, p double")
    assert {x["item_id"]: round(x["adjusted"], 6) for x in stats.holm(t).collect()} == {"a": .03, "c": .06, "b": .06}


@pytest.fixture(scope="module")
def daily(spark):
    d = [(f"i{k}", k, i, 100.0 * (k + 1) * math.exp(.01 * i + .02 * ((i + k) % 7)), 8) for k in range(3) for i in range(30) if i % 13 != 5]
    return spark.createDataFrame(d, "item_id string, k int, i int, vwap double, n long").withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), F.col("i"))).select("item_id", "day", "vwap", "n")


def test_the_future_changes_no_past_forecast(daily):
    changed = daily.withColumn("vwap", F.when(F.col("day") >= "2024-01-21", F.col("vwap") * 9).otherwise(F.col("vwap")))
    pick = lambda d: sorted(tuple(r) for r in forecast.rolling_backtest(d, "2024-01-30").filter("origin <= '2024-01-21'").select("item_id", "origin", "h", F.round("mid", 8), F.round("lo", 8), "naive").collect())
    a, b = pick(daily), pick(changed)
    assert a and [x for x in a] == [x for x in b]


def test_forecast_does_not_depend_on_row_order(daily):
    key = lambda d: sorted((r["item_id"], r["h"], round(r["mid"], 9)) for r in forecast.trend_weekday_forecast(d, "2024-01-30").collect())
    assert key(daily) == key(daily.orderBy(F.rand(5)).repartition(7))


def test_missing_member_empties_the_index(spark):
    v = spark.createDataFrame([("a", "d1", 110.0), ("b", "d1", 50.0), ("a", "d2", 120.0)], "item_id string, day string, value double")
    m = spark.createDataFrame([("x", "a", 100.0), ("x", "b", 100.0)], "basket string, item_id string, base double")
    assert {r["day"]: (r["value"], r["coverage"]) for r in forecast.basket_index(v, m).collect()} == {"d1": (80.0, 2), "d2": (None, 1)}


def test_a_ledger_is_written_once(spark):
    c = spark.createDataFrame([("v", "2024-01-02", 1.0)], "version string, origin string, value double").withColumn("origin", F.col("origin").cast("date"))
    first = ledger.ledger_issue(c.limit(0), c, "2024-01-01 20:00:00", "2024-01-01 19:00:00")
    assert first.count() == 1
    assert ledger.ledger_issue(first, c, "2024-01-01 21:00:00", "2024-01-01 19:00:00").count() == 0
    assert ledger.ledger_issue(c.limit(0), c, "2024-01-01 16:00:00", "2024-01-01 15:30:00").count() == 0       # 01:00 local
    assert ledger.ledger_issue(c.limit(0), c, "2024-01-01 20:00:00", "2024-01-01 14:00:00").count() == 0       # bars of today missing


def test_step_of_twenty_percent(spark):
    b = spark.createDataFrame([("a", i * 3600, 1200.0 if i >= 700 else 1000.0, 1, 1) for i in range(900)], "item_id string, s long, vwap double, qty long, n long") \
        .withColumns({"hour": F.timestamp_seconds("s"), "gold": F.col("vwap").cast("decimal(38,0)")})
    e = spark.createDataFrame([(1, "a", 700 * 3600, 690 * 3600)], "event_id long, item_id string, a long, n long") \
        .select("event_id", "item_id", F.timestamp_seconds("a").alias("at"), F.timestamp_seconds("n").alias("announced"))
    r = {x["mode"]: x for x in events.hourly_event_study(b, e, 6, 6).collect()}
    assert r["all"]["actual_pct"] == pytest.approx(20) and r["all"]["median"] == pytest.approx(0) and r["all"]["status"] == "outside the usual range"
    assert r["Tuesday"]["references"] == 4 and r["noThursday"]["references"] < r["all"]["references"]


def test_difference_in_differences(spark):
    side = [("t1", "treatment", 1), ("t2", "treatment", 2), ("c1", "control", 1), ("c2", "control", 2)]
    m = spark.createDataFrame(side, "item_id string, side string, position int").withColumn("expires_day", F.lit(None).cast("date"))
    d = [(i, f"2024-01-{k:02d}", (120.0 if s == "treatment" and k > 10 else 100.0) * (2 if i == "c2" else 1), 9) for i, s, _ in side for k in range(1, 21)]
    daily = spark.createDataFrame(d, "item_id string, day string, vwap double, n long").withColumn("day", F.col("day").cast("date"))
    w = spark.createDataFrame([("main", "x", "2024-01-01", "2024-01-10", "2024-01-11", "2024-01-20")], "variant string, label string, b0 string, b1 string, a0 string, a1 string")
    w = w.withColumns({c: F.col(c).cast("date") for c in ("b0", "b1", "a0", "a1")})
    run = lambda df, through: events.did_contrast(events.did_excess(events.side_logs(events.study_prices(df, m, through), events.study_groups(m))), w, through).first()
    assert run(daily, "2024-01-20")["relative_pct"] == pytest.approx(20)
    assert run(daily, "2024-01-19")["status"] == "pending"
    holes = daily.filter("NOT (item_id = 'c1' AND day BETWEEN '2024-01-03' AND '2024-01-05')")
    assert run(holes, "2024-01-20")["status"] == "insufficient"


def test_day_in_a_notice_title(spark):
    row = '<ul><li class="category">{}</li><li class="title" data-no="{}">{}<div class="iconset"></div></li><li class="date"> {}</li></ul>'
    html = row.format("major", 5, "Update &amp; fix 10/22(목)", "2026.10.20") + row.format("minor", 6, "New year 1/7(수)", "2026.12.30") + row.format("minor", 7, "Plain", "2026.10.01")
    p = spark.createDataFrame([(1, html)], "page_id long, html string")
    got = {r["id"]: (r["category"], r["title"], r["date"], r["explicit"]) for r in notices.notice_rows(p).collect()}
    assert got == {"5": ("major", "Update & fix 10/22(목)", "2026-10-22", True), "6": ("minor", "New year 1/7(수)", "2027-01-07", True), "7": ("minor", "Plain", "2026-10-01", False)}


def test_hour_is_known_only_if_every_poll_succeeded_in_time(spark):
    rows = [("a", "00:10", "00:11", None), ("a", "00:20", None, None), ("b", "00:10", "00:11", None), ("b", "00:20", "02:00", None),
            ("c", "00:10", "00:11", "timeout"), ("d", "00:10", "00:11", None)]
    runs = spark.createDataFrame(rows, "item_id string, s string, f string, error string").select(
        "item_id", *[F.to_timestamp(F.concat(F.lit("2024-01-01 "), c)).alias(n) for c, n in (("s", "started_at"), ("f", "finished_at"))], "error",
        F.lit(False).alias("saturated"), F.lit(1).alias("sold_rows"), F.lit(1).alias("listing_rows"))
    known = lambda **more: {r["item_id"] for r in health.quality_hours(runs, **more).collect() if r["known"]}
    assert known() == {"b", "d"}
    assert known(as_of="2024-01-01 01:00:00") == {"d"}


def test_ledger_rules_see_missing_values(spark):
    rows = [("a", "v2", "2024-01-05", None, 1, "2024-01-06", "last", 1.0), ("b", "v2", "2024-01-05", "2024-01-05 01:00:00", 1, None, "last", 1.0),
            ("c", "v2", "2024-01-05", "2024-01-05 01:00:00", 1, "2024-01-06", "last", 1.0), ("d", "v2", "2024-01-05", "2024-01-05 09:00:00", 1, "2024-01-06", "last", 1.0)]
    issues = spark.createDataFrame(rows, "item_id string, version string, o string, i string, h int, t string, model string, value double").select(
        "item_id", "version", F.to_date("o").alias("origin"), F.to_timestamp("i").alias("issued_at"), "h", F.to_date("t").alias("target"), "model", "value")
    found = {(r["item_id"], r["rule"]) for r in ledger.ledger_validate(issues, "v2", ["last"], now="2024-01-05 06:00:00").collect()}
    assert {x for x in found if x[1] not in ("horizons", "models")} == {
        ("a", "issued on another day"), ("b", "target date"), ("d", "issued in the future")}


def test_calendar_rows_without_url_and_in_order_of_arrival(spark):
    kind = "name string, type string, announced_at timestamp, starts_at timestamp, ends_at timestamp, related array<string>, url string"
    t = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    stored = spark.createDataFrame([(1, "sale", "old", t(0), t(1), None, ["a"], "u/1"), (2, "other", "old", None, t(1), t(9), None, "u/2")], f"id long, {kind}")
    new = spark.createDataFrame([
        (1, "sale", "first", None, t(14), t(30), None, None),
        (2, "sale", "second", t(2), t(-8), None, ["b"], None),       # 1 January in Seoul, 31 December in UTC
        (3, "sale", "third", None, t(2), t(40), None, "u/1"),
        (4, "fresh", "one", t(3), t(4), None, None, "u/8"), (5, "fresh", "two", None, t(5), t(6), None, "u/9"),
        (6, "other", "x", None, t(1), None, None, "u/3"), (7, None, "nameless", None, t(1), None, None, None)], f"position int, {kind}")
    got = {(r["id"], r["name"]): r for r in notices.event_upsert(stored, new, tz="Asia/Seoul", order=["position"]).collect()}
    assert set(got) == {(1, "sale"), (2, "other"), (None, "fresh"), (None, None)}
    one, fresh = got[1, "sale"], got[None, "fresh"]
    assert (one["type"], one["announced_at"], one["starts_at"], one["ends_at"], one["related"], one["url"]) == ("third", t(2), t(2), t(40), ["b"], "u/1")
    assert (fresh["type"], fresh["announced_at"], fresh["ends_at"], fresh["url"]) == ("two", t(3), t(6), "u/9")
    assert (got[2, "other"]["type"], got[2, "other"]["ends_at"], got[2, "other"]["url"]) == ("x", t(9), "u/3")


def test_equal_sales_of_one_source_stay_apart(spark, rows, tmp_path):
    from tidebook.catalog import QUERIES
    sales = spark.sql("""SELECT id AS event_id, ts, 1L AS user_id, 'view' AS event_type, 2.5D AS value, '{"k": 4}' AS props
        FROM VALUES (1L, TIMESTAMP '2024-01-05 10:00:00'), (2L, TIMESTAMP '2024-01-05 10:00:00'), (4L, TIMESTAMP '2024-01-11 10:00:00'),
          (6L, TIMESTAMP '2024-01-11 10:00:00'), (8L, TIMESTAMP '2024-01-15 10:00:00') AS t(id, ts)""")
    sales.write.parquet(f"{tmp_path}/events.parquet")
    merged = QUERIES["merge_trades"](spark, str(tmp_path))
    assert rows(merged, "source", "source_id") == [("A", 1), ("A", 2), ("A", 4), ("A", 6), ("B", 8)]
    assert rows(QUERIES["unify_eligible"](spark, str(tmp_path)), "source_id") == [(1,), (2,), (4,), (6,), (8,)]
    assert {r["n"] for r in QUERIES["unify_candles"](spark, str(tmp_path)).select("n").collect()} == {1, 2}
    assert QUERIES["merge_guards"](spark, str(tmp_path)).count() == 0
