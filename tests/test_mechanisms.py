"""Streams against brute force, ranks, picks, eliminations and the shapes of plans."""
import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidebook.catalog.models import _points
from tidebook.operators import events, forecast, ingest, market, models, notices, stats
from tidebook.plans.split import first_keys, global_ranks, rows_of
from tidebook.sources.bindings import AS_OF, Inputs
from tidebook.streaming import jobs
from tidebook.streaming.run import run_parts


@pytest.fixture(scope="module")
def x(spark):
    return Inputs(spark, "/root/testdata/sf0.001")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


# -- streams

T0 = dt.datetime(2024, 1, 1)
POLL = "item_id string, batch timestamp, listings array<struct<auction_no: string, unit_price: bigint, cur_count: bigint, expire: bigint>>, ceiling bigint"


def walked(polls):
    """Events of the polls of each item, straight from the rules."""
    out = []
    for item in sorted({p[0] for p in polls}):
        held = {}
        for _, at, rows, ceiling in sorted(p for p in polls if p[0] == item):
            seen = {r[0] for r in rows}
            for no in [n for n in held if n not in seen]:
                price, count, expire = held[no]
                now = int(at.replace(tzinfo=dt.timezone.utc).timestamp() * 1_000_000)
                if now >= expire or ceiling is None or price < ceiling:
                    del held[no]
                    if now >= expire or count > 0:
                        out.append((no, "expired" if now >= expire else "vanished_before_expiry", 0 if now >= expire else count, at))
            for no, price, count, expire in rows:
                if no in held and count < held[no][1]:
                    out.append((no, "partial", held[no][1] - count, at))
                held[no] = (price, count, expire)
    return sorted(out)


def test_absence_is_judged_by_empty_and_capped_polls(spark):
    rng, polls = random.Random(7), []
    for item in ("a", "b"):
        for h in range(40):
            at = T0 + dt.timedelta(hours=h)
            rows = []
            for n in range(6):
                if rng.random() < 0.5:
                    expire = T0 + dt.timedelta(hours=8 * n)
                    rows.append((f"{item}{n}", 10 * n, rng.randint(0, 5), int(expire.replace(tzinfo=dt.timezone.utc).timestamp() * 1_000_000)))
            if h % 7 == 3:
                rows = []
            polls.append((item, at, rows, max((r[1] for r in rows), default=None) if rows and h % 5 == 0 else None))
    frame = spark.createDataFrame(polls, POLL)
    hour = F.col("batch")
    parts = [frame.where(hour < "2024-01-01 12:00:00").orderBy(F.rand(3)), frame.where((hour >= "2024-01-01 12:00:00") & (hour < "2024-01-02 00:00:00")),
             frame.where(hour >= "2024-01-02 00:00:00")]
    got = run_parts(parts, lambda s: jobs.stream_listing_state(s, "1 hour", slots=3))
    last = T0 + dt.timedelta(hours=38)  # the watermark is an hour behind
    wanted = [e for e in walked(polls) if e[3] <= last]
    assert sorted((r["auction_no"], r["reason"], r["qty_sold"], r["observed_at"]) for r in got.collect()) == wanted
    assert {e[1] for e in wanted} == {"expired", "vanished_before_expiry", "partial"}


def test_twins_stay_and_repeated_polls_collapse(spark):
    sale = lambda i, d, price, poll: (i, "a", T0 + dt.timedelta(days=d), price, 1, 0, T0 + dt.timedelta(days=poll))
    rows = [sale(1, 0, 5, 1), sale(2, 0, 5, 1), sale(3, 0, 6, 1),                       # two equal sales and another one
            sale(1, 0, 5, 2), sale(2, 0, 5, 2), sale(4, 1, 5, 2),                       # the next poll returns them again
            sale(9, 0, 5, 3), sale(1, 0, 5, 3), sale(2, 0, 5, 3), sale(5, 9, 1, 30)]    # a third equal one turns up late
    frame = spark.createDataFrame(rows, "id long, item_id string, sold_date timestamp, unit_price long, qty int, reinforce int, polled_at timestamp")
    parts = [frame.where(F.col("polled_at") < "2024-01-03"), frame.where((F.col("polled_at") >= "2024-01-03") & (F.col("polled_at") < "2024-01-04")),
             frame.where(F.col("polled_at") >= "2024-01-04")]
    got = run_parts(parts, lambda s: jobs.stream_sales(s, "5 days", response="polled_at"))
    assert sorted((r["sold_date"].day, r["unit_price"], r["dup_seq"], r["id"]) for r in got.collect()) == [(1, 5, 0, 1), (1, 5, 1, 2), (1, 5, 2, 9), (1, 6, 0, 3), (2, 5, 0, 4)]


def test_only_slots_reach_the_alarm_state(x):
    checks = x.health_checks().select("source", "checked_at", "gap_min", "stale_items")
    schema = checks.schema
    stream = jobs.stream_health(x.spark.readStream.schema(schema).parquet("/root/testdata/sf0.001"))
    text = stream._jdf.queryExecution().analyzed().toString()
    assert text.index("TransformWithState") < text.index("Aggregate [window")


# -- ranks and picks

@pytest.mark.parametrize("family", [[], ["k"]])
def test_global_ranks_and_holm(spark, family):
    rng = random.Random(2)
    rows = [(f"i{n}", rng.choice("ab"), rng.choice([0.001, 0.02, 0.2, rng.random()])) for n in range(400)]
    frame = spark.createDataFrame(rows, "item_id string, k string, p double")
    ranked = {r["item_id"]: r for r in global_ranks(frame, family, "p", "item_id", splits=8).collect()}
    adjusted = {r["item_id"]: r["adjusted"] for r in stats.holm(frame, family).collect()}
    groups = [rows] if not family else [[r for r in rows if r[1] == k] for k in "ab"]
    for group in groups:
        reached = 0.0
        for n, (item, _, p) in enumerate(sorted(group, key=lambda r: (r[2], r[0])), 1):
            reached = max(reached, min(1.0, p * (len(group) - n + 1)))
            assert (ranked[item]["_rn"], ranked[item]["_n"]) == (n, len(group))
            assert adjusted[item] == pytest.approx(reached, abs=1e-15)


def test_newest_rows_of_any_payload(spark):
    rows = [("a", 1, 5, "x"), ("a", 2, 1, "y"), ("a", 2, 3, "z"), ("b", 0, 0, None), (None, 3, 3, "n"), (None, 3, 4, "m"), ("c", 1, 1, "r"), ("c", 1, 1, "r")]
    frame = spark.createDataFrame(rows, "k string, t int, id long, v string")
    last = first_keys(frame, ["k"], ["t", "id"], F.max, n=F.count(F.lit(1)))
    out = rows_of(frame, ["k"], ["t", "id"], last, repeated=True)
    assert sorted((r["k"] or "", r["v"] or "", r["n"]) for r in out.collect()) == [("", "m", 2), ("a", "z", 3), ("b", "", 1), ("c", "r", 2)]


def test_fan_out_grid():
    assert market.tiles(0, 40, 1000) == (1, 1) and market.tiles(5, 40, 1000) == (1, 1)
    for e, i in ((1, 100_000_000), (100_000_000, 1), (10_000, 10_000), (3, 7_000_000)):
        rows, columns = market.tiles(e, i, 1_000_000)
        assert rows <= max(1, e) and columns <= max(1, i)
        assert -(-e // rows) * -(-i // columns) <= 4_000_000


def test_one_event_for_all_of_many_items(spark):
    items = spark.range(5000).select(F.col("id").cast("string").alias("item_id"))
    calendar = spark.createDataFrame([(1, "all", T0, None), (2, "some", T0, ["7", "8"]), (3, "empty", T0, [])], "id long, name string, starts_at timestamp, related array<string>")
    out = market.event_fanout(calendar, items, pairs_a_task=500)
    assert {r["id"]: r["n"] for r in out.groupBy("id").agg(F.count(F.lit(1)).alias("n")).collect()} == {1: 5000, 2: 2, 3: 5000}
    assert out.distinct().count() == 10_002


# -- models

def test_elimination_equals_a_solver(spark):
    rng = np.random.default_rng(3)
    xs, rows = ["x0", "x1", "x2"], []
    for n in (0, 1, 2, 50):
        z, y, q = rng.normal(size=(n, 3)), rng.normal(size=n), rng.normal(size=3)
        z[:, 2] = 0.0  # a feature without spread
        sums = {"g_n": n, "g_y": y.sum(), **{f"g_{i}": z[:, i].sum() for i in range(3)}, **{f"g_{i}y": (z[:, i] * y).sum() for i in range(3)},
                **{f"g_{i}_{j}": (z[:, i] * z[:, j]).sum() for i in range(3) for j in range(i, 3)}, **{f"x{i}": q[i] for i in range(3)}}
        want = []
        for d in (1, 2, 3):
            if not n:
                want.append(None)
                continue
            m, sd = z[:, :d].mean(0), z[:, :d].std(0)
            sd = np.where(sd > 0, sd, 1)
            s = (z[:, :d] - m) / sd
            want.append(y.mean() + ((q[:d] - m) / sd) @ np.linalg.solve(s.T @ s + np.eye(d), s.T @ (y - y.mean())))
        rows.append((sums, want))
    frame = spark.createDataFrame(pd.DataFrame([{k: float(v) for k, v in s.items()} for s, _ in rows]))
    got = models.ridge_path(frame, xs).orderBy("g_n").collect()
    for r, (_, want) in zip(got, rows):
        assert [r[f"_p{k}"] for k in (1, 2, 3)] == [w if w is None else pytest.approx(w, abs=1e-9) for w in want]


def test_days_without_an_origin_bar_have_rows(x):
    points = _points(x)
    gone = points.filter("NOT (hour = TIMESTAMP '2024-01-20 23:00:00')")       # 08:00 of the 21st in Seoul
    day = lambda f: {(r["item_id"], r["state"], r["base"]) for r in f.filter("day = DATE '2024-01-21'").collect()}
    assert day(models.joint_evening(gone, AS_OF)) == {(r["item_id"], "input missing", None) for r in points.select("item_id").distinct().collect()}


def test_expanding_quantile_equals_numpy():
    rng = np.random.default_rng(5)
    move = np.where(rng.random(60) < 0.2, np.nan, rng.random(60))
    f = pd.DataFrame({"item_id": "a", "origin": pd.date_range("2024-01-01", periods=60), "move": move}).sample(frac=1, random_state=1)
    out = forecast._expanding_quantile(f, 0.8)
    for k, (n, width) in enumerate(zip(out["moves"], out["width"])):
        seen = move[:k][~np.isnan(move[:k])]
        assert n == len(seen)
        assert (width is pd.NA and not n) or width == pytest.approx(np.quantile(seen, 0.8), abs=1e-15)


# -- events share figures

def test_events_of_one_item_and_day_share_their_figures(spark):
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    series = spark.createDataFrame([("a", day(n), float(n + 1)) for n in range(30)], "item_id string, day date, value double")
    marks = spark.createDataFrame([(1, "a", day(10)), (2, "a", day(10)), (3, "a", None), (4, "b", day(10))], "event_id long, item_id string, event_day date")
    out = {r["event_id"]: r for r in events.event_window_7(series, marks, "2024-01-30").collect()}
    assert out[1]["change"] == out[2]["change"] == pytest.approx((sum(range(11, 18)) / sum(range(4, 11)) - 1) * 100)
    assert (out[3]["ready"] or False, out[3]["pre_n"], out[4]["pre_n"]) == (False, 0, 0)


def test_weekdays_away_from_events(spark):
    from tidebook.operators import seasonal
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)   # a Monday
    daily = spark.createDataFrame([("a", day(n), 10.0 if n % 7 else 20.0, 1) for n in range(56)], "item_id string, day date, vwap double, qty int")
    near = spark.createDataFrame([("a", day(3))], "item_id string, day date")
    out = {r["k"]: r for r in seasonal.weekday_ex_events(daily, near, "2024-12-31").collect()}
    assert all(r["state"] == "ready" and r["used"] == 49 and r["excluded"] == 7 for r in out.values())
    mean = (7 * 20 + 42 * 10) / 49
    assert out[1]["price"] == pytest.approx(20 / mean * 100) and out[2]["price"] == pytest.approx(10 / mean * 100)


# -- notices

def test_headings_stand_in_the_article(spark):
    o, e = notices.BODY_OPENS, notices.BODY_ENDS
    pages = [(1, f"<h1>site</h1>{o}<h1>a</h1><h1> a </h1><h1></h1><h1>b</h1>{e}\"><h1>c</h1>"), (2, "<h1>none</h1>"), (3, f"{o}<h1>x</h1>{o}<h1>y</h1>"), (4, None)]
    out = {r["page_id"]: r["headings"] for r in notices.notice_headings(spark.createDataFrame(pages, "page_id long, html string")).collect()}
    assert out == {1: ["a", "b"], 2: [], 3: ["x"], 4: []}


# -- plans

def test_sightings_are_required(x):
    with pytest.raises(ValueError):
        ingest.judged(x.listing_rows(), 10)


def test_arg_max_of_text_needs_no_sorted_aggregate(x):
    from tidebook.catalog.merge import numbered_sources
    from tidebook.operators import merge
    assert "SortAggregate" not in plan(ingest.listing_state(x.listing_rows()))[1]
    states = x.spark.sql("SELECT * FROM VALUES ('A', 10L), ('B', 20L), ('C', 30L) AS s(source, raw_max_id)")
    assert "SortAggregate" not in plan(merge.unify_eligible(numbered_sources(x.source_trades()), states, AS_OF))[1]


def test_summary_reads_each_table_once(spark, x, tmp_path):
    trades, snaps, items = (str(tmp_path / n) for n in ("trades", "snaps", "items"))
    x.trades().write.parquet(trades)
    x.snapshots().write.parquet(snaps)
    x.items().write.parquet(items)
    read = spark.read.parquet
    assert plan(market.item_summary(read(items), read(trades), read(snaps), AS_OF, "error"))[1].count("FileScan parquet") == 3
    assert plan(market.ask_gap_asof(read(snaps), read(trades), AS_OF, "error"))[1].count("FileScan parquet") <= 4


def test_panels_keep_no_growing_arrays(x):
    from tidebook.catalog.forecast import Z, _daily
    for f in (forecast.rolling_backtest(_daily(x), Z), forecast.naive_band(_daily(x), Z, (1, 7), rolling=True)):
        logical, _ = plan(f)
        assert "collect_list" not in logical and "percentile" not in logical
