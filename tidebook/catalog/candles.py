"""Bar and rollup queries."""
from pyspark.sql import functions as F

from tidebook.catalog.registry import query, r, view
from tidebook.operators import candles as op
from tidebook.sources.bindings import AS_OF

NOW = f"TIMESTAMP '{AS_OF}'"
KDAY = "CAST({} + INTERVAL 9 HOUR AS DATE)"
view("st", "SELECT max(id) AS raw_max_id FROM ev WHERE sold_date < TIMESTAMP '2024-01-29 12:00:00'")
for _n, _t in (("b1", "tr"), ("b5", "t5")):
    view(_n, f"""SELECT item_id, category, date_trunc('hour', sold_date) AS hour, arg_min(unit_price, (sold_date, id)) AS o,
      max(unit_price) AS h, min(unit_price) AS l, arg_max(unit_price, (sold_date, id)) AS c,
      sum(unit_price * qty) AS gold, CAST(sum(qty) AS BIGINT) AS qty, count(*) AS n FROM {_t}
      WHERE id <= (SELECT raw_max_id FROM st) GROUP BY 1, 2, 3""")
for _n, _c in (("du", "c1"), ("du5", "c5")):
    for _z, _e in (("", "CAST(hour AS DATE)"), ("k", KDAY.format("hour"))):
        view(_n + _z, f"""SELECT item_id, category, {_e} AS day, arg_min(o, hour) AS o, max(h) AS h, min(l) AS l,
          arg_max(c, hour) AS c, sum(gold) AS gold, CAST(sum(qty) AS BIGINT) AS qty, CAST(sum(n) AS BIGINT) AS n,
          CAST(sum(gold) AS DOUBLE) / CAST(sum(qty) AS DOUBLE) AS vwap FROM {_c} GROUP BY 1, 2, 3""")

V = r("CAST(gold AS DOUBLE) / CAST(qty AS DOUBLE)")
G = r("gold")


@query("candles_1h", f"SELECT item_id, category, hour, o, h, l, c, {G} AS gold, qty, n, {V} AS vwap FROM c1")
def _(x):
    return x.candles()


@query("candles_1h_volume", f"""SELECT CAST(l_suppkey AS VARCHAR) AS item_id, date_trunc('hour', l_shipdate) AS hour,
  max(p) AS h, min(p) AS l, {r('sum(p * q)')} AS gold, CAST(sum(q) AS BIGINT) AS qty, count(*) AS n FROM
  (SELECT *, CAST(round(l_extendedprice / l_quantity) AS BIGINT) AS p, CAST(l_quantity AS INTEGER) AS q FROM lineitem) GROUP BY 1, 2""")
def _(x):
    return op.candles_1h(x.volume_sales()).select("item_id", "hour", "h", "l", "gold", "qty", "n")


RAW_FROM = "2024-01-05 00:00:00"


def _stored(x):
    """Bars up to day 20; those before RAW_FROM have lost their raw and carry a mark in qty."""
    old = F.col("hour") < RAW_FROM
    return (op.candles_1h(x.trades().filter("sold_date < '2024-01-21'")).withColumn("raw_complete", ~old)
            .withColumn("qty", F.when(old, F.col("qty") + 1000).otherwise(F.col("qty")))
            .filter((F.hour("hour") != 3) | ~old))


view("stored", """SELECT item_id, hour, o, h, l, c, gold, CASE WHEN hour < TIMESTAMP '2024-01-05' THEN qty + 1000 ELSE qty END AS qty,
  n, hour >= TIMESTAMP '2024-01-05' AS raw_complete FROM c1
  WHERE hour < TIMESTAMP '2024-01-21' AND (hour(hour) <> 3 OR hour >= TIMESTAMP '2024-01-05')""")


@query("candles_refresh", f"""SELECT item_id, hour, o, h, l, c, {G} AS gold, qty, n, raw_complete FROM
  (SELECT * FROM stored WHERE hour < TIMESTAMP '2024-01-05'
   UNION ALL SELECT item_id, hour, o, h, l, c, gold, qty, n, true FROM c1 b WHERE hour >= TIMESTAMP '2024-01-05'
     OR NOT EXISTS (SELECT 1 FROM stored s WHERE s.item_id = b.item_id AND s.hour = b.hour))""")
def _(x):
    return op.candles_refresh(_stored(x), x.trades(), RAW_FROM).drop("vwap")


@query("candles_refresh_from", f"""SELECT item_id, hour, o, h, l, c, {G} AS gold, qty, n, raw_complete FROM
  (SELECT * FROM stored WHERE hour < TIMESTAMP '2024-01-18'
   UNION ALL SELECT item_id, hour, o, h, l, c, gold, qty, n, true FROM c1 WHERE hour >= TIMESTAMP '2024-01-18')""")
def _(x):
    return op.candles_refresh(_stored(x), x.trades(), RAW_FROM, "2024-01-18 00:30:00").drop("vwap")


@query("candles_prune", f"""SELECT id, t.item_id, sold_date FROM tr t WHERE sold_date >= TIMESTAMP '2024-01-16 12:00:00'
  OR NOT EXISTS (SELECT 1 FROM stored s WHERE s.item_id = t.item_id AND s.hour = date_trunc('hour', t.sold_date) AND raw_complete)""")
def _(x):
    kept, _frozen = op.candles_prune(x.trades(), _stored(x), AS_OF, keep_days=14)
    return kept.select("id", "item_id", "sold_date")


@query("candles_freeze", """SELECT item_id, hour, raw_complete AND hour >= TIMESTAMP '2024-01-16 12:00:00' AS raw_complete FROM stored""")
def _(x):
    _kept, frozen = op.candles_prune(x.trades(), _stored(x), AS_OF, keep_days=14)
    return frozen.select("item_id", "hour", "raw_complete")


@query("candle_reconcile", """WITH t AS (SELECT * FROM tr WHERE sold_date >= TIMESTAMP '2024-01-03' AND sold_date < TIMESTAMP '2024-01-30'),
  held AS (SELECT * REPLACE (CASE WHEN n = 3 THEN qty + 1 ELSE qty END AS qty) FROM b1
    WHERE hour >= TIMESTAMP '2024-01-03' AND hour < TIMESTAMP '2024-01-30'),
  raw AS (SELECT * FROM b1 WHERE hour >= TIMESTAMP '2024-01-03' AND hour < TIMESTAMP '2024-01-30')
  SELECT (SELECT count(*) FROM raw) AS bars,
    (SELECT count(*) FROM (SELECT DISTINCT item_id, date_trunc('hour', sold_date) FROM t WHERE id > (SELECT raw_max_id FROM st))) AS pending_bars,
    (SELECT count(*) FROM t WHERE id > (SELECT raw_max_id FROM st)) AS pending_trades,
    (SELECT count(*) FROM raw FULL JOIN held USING (item_id, hour) WHERE (raw.o, raw.h, raw.l, raw.c, raw.gold, raw.qty, raw.n)
       IS DISTINCT FROM (held.o, held.h, held.l, held.c, held.gold, held.qty, held.n)) AS mismatches""")
def _(x):
    held = x.known_bars().withColumn("qty", F.when(F.col("n") == 3, F.col("qty") + 1).otherwise(F.col("qty")))
    return op.candle_reconcile(x.trades(), held, "2024-01-03 00:00:00", "2024-01-30 00:00:00", x.raw_max_id())


@query("candle_freshness", f"""SELECT item_id, refreshed_at, {r(f"(epoch_us({NOW}) - epoch_us(refreshed_at)) / 1e6 / 60")} AS age_minutes,
  (epoch_us({NOW}) - epoch_us(refreshed_at)) / 1e6 / 60 > 90 AS stale FROM
  (SELECT item_id, max(sold_date) AS refreshed_at FROM tr WHERE sold_date <= {NOW} GROUP BY 1)""")
def _(x):
    states = x.trades().filter(F.col("sold_date") <= AS_OF).groupBy("item_id").agg(F.max("sold_date").alias("refreshed_at"))
    return op.candle_freshness(states, AS_OF)


DAILY = f"SELECT item_id, CAST(day AS VARCHAR) AS day, o, h, l, c, {G} AS gold, qty, n, {r('vwap')} AS vwap FROM "


@query("daily_ohlc", DAILY + "duk")
def _(x):
    return op.daily_ohlc(x.candles(), "Asia/Seoul")


@query("daily_ohlc_utc", DAILY + "du")
def _(x):
    return op.daily_ohlc(x.candles(), "UTC")


ASK = {"ask0": "(upgrade = 0 OR upgrade IS NULL)", "askMax": "upgrade > 0 AND upgrade = upgrade_max"}


def _ask_sql(basis):
    return f"""SELECT item_id, CAST({KDAY.format('captured_at')} AS VARCHAR) AS day, arg_min(min_unit_price, (captured_at, id)) AS o,
      max(min_unit_price) AS h, min(min_unit_price) AS l, arg_max(min_unit_price, (captured_at, id)) AS c,
      {r('avg(min_unit_price)')} AS vwap, 0 AS qty, count(*) AS n FROM sn
      WHERE category = 'error' AND {ASK[basis]} AND min_unit_price > 0 GROUP BY 1, 2"""


@query("ask_daily_ohlc", _ask_sql("ask0"))
def _(x):
    return op.ask_daily_ohlc(x.snapshots(), "error", "ask0")


@query("ask_daily_ohlc_max", _ask_sql("askMax"))
def _(x):
    return op.ask_daily_ohlc(x.snapshots(), "error", "askMax")


ASKH = f"""SELECT item_id, date_trunc('hour', captured_at) AS hour, {r('avg(min_unit_price)')} AS vwap, CAST(0 AS BIGINT) AS qty FROM sn
  WHERE captured_at > {NOW} - INTERVAL 7 DAY AND category = 'error' AND """


@query("hourly_series", f"""SELECT item_id, hour, {V} AS vwap, qty FROM c1
  WHERE hour >= {NOW} - INTERVAL 7 DAY AND category <> 'error' UNION ALL {ASKH} {ASK['ask0']} GROUP BY 1, 2""")
def _(x):
    return op.hourly_series(x.candles(), x.snapshots(), "error", AS_OF)


@query("hourly_series_max", f"{ASKH} {ASK['askMax']} GROUP BY 1, 2")
def _(x):
    return op.ask_hourly(x.snapshots(), "error", "askMax", AS_OF)


@query("daily_vwap", f"SELECT item_id, CAST(day AS VARCHAR) AS day, {r('vwap')} AS vwap, qty, n FROM duk WHERE day < DATE '2024-01-30'")
def _(x):
    return op.daily_vwap(x.candles(), "2024-01-30")


def _ask18(legacy):
    return f"""WITH s AS (SELECT *, date_trunc('hour', captured_at) AS hour FROM sn5 WHERE category = 'error'
        AND (upgrade = 0 OR upgrade = upgrade_max) {"AND min_unit_price > 400" if legacy else ""}),
      h AS (SELECT item_id, upgrade, hour, max(captured_at) AS captured_at,
        arg_max(min_unit_price, (captured_at, id)) AS p FROM s GROUP BY 1, 2, 3)
      SELECT item_id, CASE WHEN upgrade = 0 THEN 'ask0' ELSE 'askMax' END AS basis, CAST({KDAY.format('captured_at')} AS VARCHAR) AS day,
        CASE WHEN count(*) FILTER (p > 400) >= 10 THEN {r('avg(p - 400) FILTER (p > 400)')} END AS value,
        count(*) FILTER (p > 400) AS hours FROM h GROUP BY 1, 2, 3"""


def _shifted(x):
    """Prices less 400, so that some books count as empty."""
    return x.snapshots(wide=False).withColumn("min_unit_price", F.col("min_unit_price") - 400)


@query("ask_daily_18h", _ask18(False))
def _(x):
    return op.ask_daily_18h(_shifted(x), "error", min_hours=10)


@query("ask_daily_18h_legacy", _ask18(True))
def _(x):
    return op.ask_daily_18h(_shifted(x), "error", min_hours=10, legacy=True)


@query("stock_daily_18h", f"""WITH h AS (SELECT item_id, date_trunc('hour', captured_at) AS hour, max(captured_at) AS captured_at,
    arg_max(total_qty, (captured_at, id)) AS q FROM sn5 WHERE upgrade IS NULL GROUP BY 1, 2)
  SELECT item_id, CAST({KDAY.format('captured_at')} AS VARCHAR) AS day,
    CASE WHEN count(*) >= 18 THEN {r('avg(q)')} END AS value, count(*) AS hours FROM h GROUP BY 1, 2""")
def _(x):
    return op.stock_daily_18h(x.snapshots(wide=False))


@query("game_day_turnover", f"""WITH d AS (SELECT CAST(hour + INTERVAL 3 HOUR AS DATE) AS day, sum(gold) AS g, sum(n) AS n,
    count(DISTINCT item_id) AS i, count(DISTINCT hour) AS hh FROM c1 WHERE category <> 'error' GROUP BY 1)
  SELECT CAST(s.day AS VARCHAR) AS day, {r('g')} AS amount, CAST(coalesce(n, 0) AS BIGINT) AS trades,
    coalesce(i, 0) AS observed_items, coalesce(hh, 0) AS observed_hours
  FROM (SELECT CAST(DATE '2024-01-29' - CAST(i AS INTEGER) AS DATE) AS day FROM range(30) q(i)) s LEFT JOIN d USING (day)""")
def _(x):
    return op.game_day_turnover(x.candles(), x.items(), AS_OF, "error")


@query("hour_spine", f"""SELECT i.item_id, {NOW} - to_hours(CAST(k AS INTEGER)) AS hour, {V} AS vwap, qty
  FROM it i, range(168) q(k) LEFT JOIN c1 b ON b.item_id = i.item_id AND b.hour = {NOW} - to_hours(CAST(k AS INTEGER))""")
def _(x):
    return op.hour_spine(x.candles(), AS_OF)


@query("gap_segments", """SELECT item_id, min(hour) AS first_hour, max(hour) AS last_hour, count(*) AS hours FROM
  (SELECT item_id, hour, hour - to_hours(CAST(row_number() OVER (PARTITION BY item_id ORDER BY hour) AS INTEGER)) AS g FROM c1)
  GROUP BY item_id, g""")
def _(x):
    return op.gap_segments(x.candles())


view("dstate", f"""WITH d AS (SELECT item_id, day, CASE WHEN n % 11 <> 0 THEN vwap END AS value, n FROM duk),
  s AS (SELECT item_id, CAST(unnest(generate_series(greatest(min(day), DATE '2024-01-01'), DATE '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS day
    FROM d GROUP BY 1)
  SELECT s.item_id, s.day, value, n, s.day >= DATE '2024-01-30' AS partial,
    CASE WHEN d.item_id IS NULL THEN 'missing' WHEN value IS NULL THEN 'unavailable' WHEN n < 5 THEN 'sparse' ELSE 'ready' END AS state
  FROM s LEFT JOIN d ON d.item_id = s.item_id AND d.day = s.day""")


def _days(x):
    d = op.daily_ohlc(x.candles())
    return d.select("item_id", "day", F.when(F.col("n") % 11 != 0, F.col("vwap")).alias("value"), "n")


@query("day_spine_state", f"SELECT item_id, CAST(day AS VARCHAR) AS day, {r('value')} AS value, n, partial, state FROM dstate")
def _(x):
    return op.day_spine_state(_days(x), AS_OF, 30)


@query("period_change", f"""SELECT item_id, count(*) AS days, CAST(min(day) AS VARCHAR) AS first_day, CAST(max(day) AS VARCHAR) AS last_day,
  {r('arg_min(value, day)')} AS first_value, {r('arg_max(value, day)')} AS last_value,
  {r('(arg_max(value, day) / arg_min(value, day) - 1) * 100')} AS pct
  FROM dstate WHERE NOT partial AND state = 'ready' AND value > 0 GROUP BY 1 HAVING count(*) >= 2""")
def _(x):
    return op.period_change(op.day_spine_state(_days(x), AS_OF, 30))


@query("spark14", """SELECT item_id, string_agg(CAST(CAST(floor(vwap + 0.5) AS BIGINT) AS VARCHAR), ',' ORDER BY day) AS spark FROM
  (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY day DESC) AS rn FROM duk) WHERE rn <= 14 GROUP BY 1""")
def _(x):
    whole = F.transform("spark", lambda v: F.floor(v + 0.5).cast("string"))
    return op.spark14(op.daily_ohlc(x.candles())).select("item_id", F.array_join(whole, ",").alias("spark"))
