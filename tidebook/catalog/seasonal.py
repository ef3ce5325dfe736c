"""Seasonality and weekly queries."""
from pyspark.sql import functions as F

from tidebook.catalog.candles import KDAY, NOW
from tidebook.catalog.registry import query, r, view
from tidebook.operators import candles as bars, health, seasonal as op
from tidebook.sources.bindings import AS_OF

TODAY = "2024-01-30"
WEEK = "CAST(date_trunc('week', {}) AS DATE)"
view("fl", f"""SELECT captured_at, id, p10, min_unit_price AS min_price, listing_count AS listings, CASE WHEN listing_count >= 2 THEN median END AS mean10,
  CASE WHEN listing_count >= 2 THEN p25 END AS tenth FROM sa WHERE p10 > 0 AND min_unit_price > 0""")
view("fld", f"""WITH h AS (SELECT date_trunc('hour', captured_at) AS hour, arg_max((p10, min_price, listings, mean10, tenth), (captured_at, id)) AS v FROM fl GROUP BY 1),
  w AS (SELECT hour, v[1] AS p10, v[2] AS mn, v[3] AS listings, v[4] AS mean10, v[5] AS tenth FROM h)
  SELECT {KDAY.format('hour')} AS day, count(*) AS hours, count(mean10) AS material_hours, avg(mean10) AS mean10, avg(tenth) AS tenth, avg(p10) AS p10, avg(mn) AS min,
    avg(listings) AS listings FROM w GROUP BY 1""")


def _floors(x):
    two = F.col("listing_count") >= 2
    return x.snapshots().select("captured_at", "id", "p10", F.col("min_unit_price").alias("min_price"), F.col("listing_count").alias("listings"),
                                F.when(two, F.col("median")).alias("mean10"), F.when(two, F.col("p25")).alias("tenth"))


@query("floor_series", f"""SELECT CAST(day AS VARCHAR) AS day, hours, material_hours, {r('mean10')} AS mean10, {r('tenth')} AS tenth, {r('p10')} AS p10,
  {r('min')} AS min, {r('listings')} AS listings FROM fld""")
def _(x):
    return op.floor_series(_floors(x), AS_OF)


def trend_sql(days, keys, before, weeks):
    """`days` is a relation with the keys, day and price."""
    on = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys)
    ks = ", ".join(keys)
    return f"""WITH v AS (SELECT * FROM {days} WHERE day < DATE '{before}' AND price > 0),
      f AS (SELECT *, {WEEK.format('day')} AS w, count(*) OVER (PARTITION BY {ks}, {WEEK.format('day')}) AS cnt, avg(price) OVER (PARTITION BY {ks}, {WEEK.format('day')}) AS m FROM v),
      g AS (SELECT f.*, f.price / m * 100 AS idx, (f.price / b.price - 1) * 100 AS chg FROM f LEFT JOIN v b ON {on('b', 'f')} AND b.day = f.day - 1 WHERE cnt = 7),
      wk AS (SELECT {ks}, count(DISTINCT w) AS weeks, min(day) AS fd, max(day) AS ld FROM g GROUP BY ALL),
      pt AS (SELECT {ks}, isodow(day) AS k, avg(idx) AS price, count(*) AS n, avg(chg) AS change, count(chg) AS change_n FROM g GROUP BY ALL),
      ct AS (SELECT {ks}, isodow(day) AS k, count(*) AS available FROM v GROUP BY ALL),
      tt AS (SELECT {ks}, count(*) AS days FROM v GROUP BY ALL)
      SELECT {', '.join('tt.' + k for k in keys)}, CAST(s.k AS INTEGER) AS k, coalesce(weeks >= {weeks}, false) AS ready, coalesce(weeks, 0) AS weeks, days, fd AS first_day, ld AS last_day,
        coalesce(available, 0) AS available, CASE WHEN weeks >= {weeks} THEN pt.price END AS price, CASE WHEN weeks >= {weeks} THEN n END AS n,
        CASE WHEN weeks >= {weeks} THEN change END AS change, CASE WHEN weeks >= {weeks} THEN change_n END AS change_n
      FROM tt CROSS JOIN range(1, 8) s(k) LEFT JOIN wk ON {on('wk', 'tt')} LEFT JOIN pt ON {on('pt', 'tt')} AND pt.k = s.k LEFT JOIN ct ON {on('ct', 'tt')} AND ct.k = s.k"""


TOUT = f"""k, ready, weeks, days, CAST(first_day AS VARCHAR) AS first_day, CAST(last_day AS VARCHAR) AS last_day, available, {r('price')} AS price, n,
  {r('change')} AS change, change_n"""
view("fday", "SELECT 'floor' AS item_id, day, p10 AS price FROM fld WHERE hours >= 12")
view("ftrend", trend_sql("fday", ["item_id"], TODAY, 3))


@query("floor_weekday", f"SELECT item_id, {TOUT} FROM ftrend")
def _(x):
    d = op.floor_series(_floors(x), AS_OF).filter("hours >= 12").select(F.lit("floor").alias("item_id"), "day", F.col("p10").alias("price"))
    return op.weekday_trend(d, TODAY, min_weeks=3)


view("day5", "SELECT item_id, day, vwap AS price FROM duk WHERE n >= 5")
view("wtrend", trend_sql("day5", ["item_id"], TODAY, 4))


def _trade_days(x):
    return bars.daily_ohlc(x.candles()).filter("n >= 5").select("item_id", "day", F.col("vwap").alias("price"))


@query("weekday_trend", f"SELECT item_id, {TOUT} FROM wtrend")
def _(x):
    return op.weekday_trend(_trade_days(x), TODAY)


@query("weekday_groups", f"""SELECT 'trade' AS basis, k, count(*) AS candidates, count(*) FILTER (ready) AS eligible, max(weeks) AS max_weeks,
  CAST(min(first_day) FILTER (ready) AS VARCHAR) AS first_day, CAST(max(last_day) FILTER (ready) AS VARCHAR) AS last_day, {r('avg(price) FILTER (ready)')} AS price,
  {r('avg(change) FILTER (ready)')} AS change, CAST(coalesce(sum(n), 0) AS BIGINT) AS n, CAST(coalesce(sum(change_n), 0) AS BIGINT) AS change_n, count(change) AS change_items,
  CAST(sum(available) AS BIGINT) AS available FROM wtrend GROUP BY k""")
def _(x):
    return op.weekday_groups(op.weekday_trend(_trade_days(x), TODAY).withColumn("basis", F.lit("trade")))


view("adays", f"""WITH h AS (SELECT item_id, upgrade, date_trunc('hour', captured_at) AS hour, max(captured_at) AS captured_at, arg_max(min_unit_price, (captured_at, id)) AS p FROM sn5
    WHERE category = 'error' AND captured_at <= {NOW} AND (upgrade = 0 OR upgrade = upgrade_max) GROUP BY 1, 2, 3)
  SELECT item_id, CASE WHEN upgrade = 0 THEN 'ask0' ELSE 'askMax' END AS basis, {KDAY.format('captured_at')} AS day, avg(p) AS price, count(*) AS hours FROM h WHERE p > 0 GROUP BY 1, 2, 3""")


@query("ask_weekday", f"""WITH c AS (SELECT *, {WEEK.format('day')} AS w FROM adays WHERE day < DATE '{TODAY}' AND hours >= 10),
  f AS (SELECT *, avg(price) OVER (PARTITION BY item_id, basis, w) AS m, count(*) OVER (PARTITION BY item_id, basis, w) AS n FROM c),
  g AS (SELECT *, count(*) OVER (PARTITION BY item_id, basis) AS tot FROM f WHERE n = 7),
  i AS (SELECT item_id, basis, isodow(day) AS k, avg(price / m * 100) AS p FROM g WHERE tot >= 14 GROUP BY 1, 2, 3)
  SELECT basis, CAST(k AS INTEGER) AS k, count(*) AS items, {r('avg(p)')} AS price FROM i GROUP BY 1, 2""")
def _(x):
    return op.ask_weekday(op.ask_days(x.snapshots(wide=False), "error", AS_OF), TODAY, min_hours=10, min_weeks=2)


view("welig", """SELECT item_id, category FROM tr WHERE category <> 'error' GROUP BY 1, 2 HAVING epoch_us(max(sold_date)) - epoch_us(min(sold_date)) > 14 * 86400000000 AND count(*) >= 25""")
view("weff", f"""WITH d AS (SELECT * FROM duk JOIN welig USING (item_id) WHERE day < DATE '{TODAY}'), b AS (SELECT item_id, avg(vwap) AS m, avg(qty) AS q FROM d GROUP BY 1),
  n AS (SELECT isodow(day) AS k, ln(vwap / m) AS lr, d.qty / q AS rq FROM d JOIN b USING (item_id) WHERE m > 0 AND vwap > 0)
  SELECT CAST(k AS INTEGER) AS k, count(*) AS n, avg(lr) * 100 AS ret, stddev_samp(lr) / sqrt(count(*)) * 100 AS se, avg(rq) AS vol FROM n GROUP BY 1""")


def _effect(x):
    t = x.trades().filter("category <> 'error'")
    daily, elig = bars.daily_ohlc(bars.candles_1h(t)), op.weekday_eligible(t)
    return daily, elig, op.weekday_effect(daily, elig, TODAY)


@query("weekday_effect", f"SELECT k, n, {r('ret')} AS ret, {r('se')} AS se, {r('vol')} AS vol FROM weff")
def _(x):
    return _effect(x)[2]


@query("weekday_sample", f"""SELECT (SELECT count(*) FROM welig) AS items, count(*) AS item_days, CAST(max(day) - min(day) + 1 AS INTEGER) AS span_days, CAST(min(day) AS VARCHAR) AS first_day,
  CAST(max(day) AS VARCHAR) AS last_day, (SELECT string_agg(category || '=' || n, ',' ORDER BY category) FROM (SELECT category, count(*) AS n FROM welig GROUP BY 1)) AS categories,
  {r('(SELECT avg(se) * 2.8 FROM weff)')} AS mde FROM duk JOIN welig USING (item_id) WHERE day < DATE '{TODAY}'""")
def _(x):
    s = op.weekday_sample(*_effect(x), TODAY)
    pairs = F.transform(F.array_sort(F.map_entries("categories")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return s.withColumn("categories", F.array_join(pairs, ","))


@query("weekday_ex_events", f"""WITH d AS (SELECT item_id, day, vwap, qty FROM duk WHERE day < DATE '{TODAY}' AND vwap > 0 AND qty > 0),
  e AS (SELECT DISTINCT u.item_id, {KDAY.format('starts_at')} AS day FROM cal, unnest(related) AS u(item_id) WHERE len(related) > 0),
  sp AS (SELECT item_id, CAST(max(day) - min(day) AS INTEGER) AS span, count(*) AS a FROM d GROUP BY 1),
  us AS (SELECT * FROM d WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.item_id = d.item_id AND abs(e.day - d.day) <= 3)),
  b AS (SELECT item_id, avg(vwap) AS m, avg(qty) AS q, count(*) AS used FROM us GROUP BY 1),
  g AS (SELECT item_id, isodow(day) AS k, count(*) AS n, avg(vwap) AS v, avg(qty) AS vq FROM us GROUP BY 1, 2),
  l AS (SELECT item_id, CASE WHEN count(*) = 7 THEN min(n) ELSE 0 END AS least FROM g GROUP BY 1),
  o AS (SELECT sp.item_id, CAST(s.k AS INTEGER) AS k, span, a, coalesce(used, 0) AS used, coalesce(n, 0) AS n, v, vq, m, q,
    CASE WHEN span < 25 THEN 'history' WHEN coalesce(least, 0) < 2 THEN 'samples' ELSE 'ready' END AS state
    FROM sp CROSS JOIN range(1, 8) s(k) LEFT JOIN b ON b.item_id = sp.item_id LEFT JOIN l ON l.item_id = sp.item_id LEFT JOIN g ON g.item_id = sp.item_id AND g.k = s.k)
  SELECT item_id, k, state, span, used, a - used AS excluded, n, CASE WHEN state = 'ready' THEN {r('v / m * 100')} END AS price, CASE WHEN state = 'ready' THEN {r('vq / q * 100')} END AS qty FROM o""")
def _(x):
    c = x.calendar().filter(F.size("related") > 0).select(F.explode("related").alias("item_id"), F.to_date(F.from_utc_timestamp("starts_at", "Asia/Seoul")).alias("day"))
    return op.weekday_ex_events(bars.daily_ohlc(x.candles()), c.distinct(), TODAY, min_span=25, min_per_day=2)


def path_sql(b, tz=9, points="c5"):
    """Day paths of boundary b at a fixed offset."""
    return f"""WITH p AS (SELECT item_id, hour, CAST(hour + INTERVAL {tz - b} HOUR AS DATE) AS day, CAST(hour(hour + INTERVAL {tz - b} HOUR) AS INTEGER) AS slot,
        CAST(gold AS DOUBLE) / qty AS p FROM {points} WHERE hour < {NOW}),
      s AS (SELECT item_id, min(hour) AS fh, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM p GROUP BY 1),
      g AS (SELECT item_id, day, count(*) AS hours, avg(p) AS average, count(*) FILTER (slot < 3) AS en, count(*) FILTER (slot >= 21) AS l_n, avg(p) FILTER (slot < 3) AS e, avg(p) FILTER (slot >= 21) AS l,
        regr_slope(ln(p), slot) AS sl, regr_sxx(ln(p), slot) AS xx, regr_syy(ln(p), slot) AS yy, regr_sxy(ln(p), slot) AS xy, arg_min(slot, (p, slot)) AS low_hour, arg_max(slot, (p, -slot)) AS high_hour FROM p GROUP BY 1, 2),
      j AS (SELECT s.item_id, s.day, coalesce(hours, 0) AS hours, CAST(s.day AS TIMESTAMP) - INTERVAL {tz - b} HOUR >= fh AND CAST(s.day AS TIMESTAMP) - INTERVAL {tz - b} HOUR + INTERVAL 1 DAY <= {NOW} AS complete,
        average, en, l_n, e, l, sl, xx, yy, xy, low_hour, high_hour FROM s LEFT JOIN g ON g.item_id = s.item_id AND g.day = s.day),
      k AS (SELECT *, complete AND hours >= 18 AS eligible FROM j)
      SELECT item_id, day, complete, hours, eligible, average, CASE WHEN eligible AND en >= 2 AND l_n >= 2 THEN (l / e - 1) * 100 END AS change_pct,
        CASE WHEN eligible THEN (exp(CASE WHEN xx > 0 THEN sl ELSE 0 END * 24) - 1) * 100 END AS slope24_pct, CASE WHEN eligible AND xx > 0 AND yy > 0 THEN xy * xy / (xx * yy) END AS r2, low_hour, high_hour FROM k"""


view("path0", path_sql(0))
view("path6", path_sql(6))


def _points(x):
    return x.candles(wide=False).select("item_id", "hour", F.col("vwap").alias("price"))


for _b in (0, 6):
    @query("day_paths" if _b == 0 else "day_paths_6h", f"""SELECT item_id, CAST(day AS VARCHAR) AS day, complete, hours, eligible, {r('average')} AS average, {r('change_pct')} AS change_pct,
      {r('slope24_pct')} AS slope24_pct, {r('r2')} AS r2, low_hour, high_hour FROM path{_b}""")
    def _(x, _b=_b):
        return op.day_paths(_points(x), AS_OF, _b)


def _bc(b):
    return f"""SELECT item_id, {b} AS boundary, 'change' AS kind, 0 AS slot, count(change_pct) AS n, avg(change_pct) AS value, count(*) FILTER (change_pct > 0) AS up, count(*) FILTER (change_pct < 0) AS down
        FROM path{b} JOIN com USING (item_id, day) GROUP BY 1
      UNION ALL SELECT c.item_id, {b}, 'hour', CAST((hour(hour + INTERVAL {9 - b} HOUR) + {b}) % 24 AS INTEGER) AS slot, count(*), avg(CAST(gold AS DOUBLE) / qty / average * 100), NULL, NULL
        FROM c5 c JOIN path{b} p ON p.item_id = c.item_id AND p.day = CAST(c.hour + INTERVAL {9 - b} HOUR AS DATE) JOIN com ON com.item_id = p.item_id AND com.day = p.day WHERE hour < {NOW} GROUP BY 1, 4
      UNION ALL SELECT item_id, {b}, 'weekday', CAST(isodow(day) - 1 AS INTEGER), count(*), avg(average / m * 100), NULL, NULL FROM
        (SELECT p.*, avg(average) OVER (PARTITION BY p.item_id, {WEEK.format('p.day')}) AS m, count(*) OVER (PARTITION BY p.item_id, {WEEK.format('p.day')}) AS n7
         FROM path{b} p JOIN com ON com.item_id = p.item_id AND com.day = p.day) WHERE n7 = 7 GROUP BY 1, 4"""


@query("boundary_compare", f"""WITH com AS (SELECT a.item_id, a.day FROM path0 a JOIN path6 b ON a.item_id = b.item_id AND a.day = b.day WHERE a.eligible AND b.eligible),
  u AS ({_bc(0)} UNION ALL {_bc(6)}) SELECT item_id, boundary, kind, slot, n, {r('value')} AS value, up, down FROM u""")
def _(x):
    return op.boundary_compare(_points(x), AS_OF)


view("sin", f"""WITH s AS (SELECT item_id, category, date_trunc('hour', captured_at) AS hour, arg_max((min_unit_price, listing_count, total_qty), (captured_at, id)) AS v FROM sn5
    WHERE captured_at < {NOW} AND (upgrade = 0 OR upgrade IS NULL) GROUP BY 1, 2, 3), b AS (SELECT * FROM c5 WHERE hour < {NOW} AND category <> 'error')
  SELECT item_id, category, hour, 'price' AS metric, CAST(gold AS DOUBLE) / qty AS value FROM b UNION ALL SELECT item_id, category, hour, 'traded', qty FROM b
  UNION ALL SELECT item_id, category, hour, 'listings', v[2] FROM s UNION ALL SELECT item_id, category, hour, 'stock', v[3] FROM s
  UNION ALL SELECT item_id, category, hour, 'price', v[1] FROM s WHERE category = 'error'""")


def _inputs(x):
    return op.seasonal_inputs(x.candles(wide=False), x.snapshots(wide=False), AS_OF, "error")


@query("seasonal_inputs", f"SELECT item_id, category, hour, metric, {r('value')} AS value FROM sin")
def _(x):
    return _inputs(x)


view("brg", "SELECT item_id, item_id AS set_id FROM it5 UNION ALL SELECT item_id, 'group:' || CAST(length(category) % 2 AS VARCHAR) FROM it5")


def _bridge(x):
    return op.seasonal_sets(x.items(wide=False), (F.length("category") % 2).cast("string"))


@query("seasonal_sets", "SELECT * FROM brg")
def _(x):
    return _bridge(x)


def profile_sql(series, keys, least, allowed=""):
    """Seasonal profile of `series` (keys, item_id, hour, value); ends with relation `prof`."""
    k = "".join(f"{c}, " for c in keys)
    on = lambda a, b: "".join(f" AND {a}.{c} = {b}.{c}" for c in keys)
    return f"""sz AS (SELECT set_id, count(*) AS size FROM brg GROUP BY 1),
      p AS (SELECT {k}item_id, boundary, CAST(hour + to_hours(9 - boundary) AS DATE) AS day, CAST(hour(hour + to_hours(9 - boundary)) AS INTEGER) AS slot, value FROM {series}, (VALUES (0), (6)) b(boundary) WHERE value >= 0 AND hour < {NOW}),
      q AS (SELECT * FROM p WHERE CAST(day AS TIMESTAMP) + to_hours(boundary - 9) >= {NOW} - INTERVAL 56 DAY AND CAST(day AS TIMESTAMP) + to_hours(boundary - 9) + INTERVAL 1 DAY <= {NOW}),
      d AS (SELECT {k}item_id, boundary, day, avg(value) AS a FROM q GROUP BY ALL HAVING count(*) >= {least} AND avg(value) > 0),
      cd AS (SELECT {k}set_id, day FROM d JOIN brg USING (item_id) JOIN sz USING (set_id) GROUP BY {k}set_id, day, size HAVING count(*) = 2 * size),
      cm AS (SELECT * FROM cd {allowed}),
      nv AS (SELECT {''.join(f'q.{c}, ' for c in keys)}cm.set_id, q.boundary, q.day, q.slot, count(*) AS m, avg(value / a * 100) AS v FROM q JOIN d ON d.item_id = q.item_id AND d.boundary = q.boundary AND d.day = q.day{on('d', 'q')}
        JOIN brg ON brg.item_id = q.item_id JOIN cm ON cm.set_id = brg.set_id AND cm.day = q.day{on('cm', 'q')} GROUP BY ALL),
      sh AS (SELECT nv.* FROM nv JOIN sz USING (set_id) WHERE m = size),
      dm AS (SELECT {''.join(f'd.{c}, ' for c in keys)}cm.set_id, d.item_id, d.boundary, d.day, a FROM d JOIN brg ON brg.item_id = d.item_id JOIN cm ON cm.set_id = brg.set_id AND cm.day = d.day{on('cm', 'd')}),
      dw AS (SELECT *, avg(a) OVER (PARTITION BY {k}set_id, item_id, boundary, {WEEK.format('day')}) AS wm, count(*) OVER (PARTITION BY {k}set_id, item_id, boundary, {WEEK.format('day')}) AS wn FROM dm),
      wi AS (SELECT {k}set_id, boundary, day, avg(a / wm * 100) AS i FROM dw WHERE wn = 7 GROUP BY ALL),
      en AS (SELECT {k}set_id, boundary, day, (avg(v) FILTER (slot >= 21) / avg(v) FILTER (slot < 3) - 1) * 100 AS c FROM sh GROUP BY ALL HAVING count(*) FILTER (slot < 3) >= 2 AND count(*) FILTER (slot >= 21) >= 2 AND avg(v) FILTER (slot < 3) > 0),
      prof AS (SELECT {k}set_id, boundary, 'hour' AS kind, (slot + boundary) % 24 AS slot, count(*) AS n, avg(v) AS value, quantile_cont(v, 0.5) AS median, NULL AS up, NULL AS down FROM sh GROUP BY ALL
        UNION ALL SELECT {k}set_id, boundary, 'weekday', CAST(isodow(day) - 1 AS INTEGER), count(*), avg(i), NULL, NULL, NULL FROM wi GROUP BY ALL
        UNION ALL SELECT {k}set_id, boundary, 'change', 0, count(*), avg(c), NULL, count(*) FILTER (c > 1e-9), count(*) FILTER (c < -1e-9) FROM en GROUP BY ALL)"""


POUT = f"set_id, boundary, kind, slot, n, {r('value')} AS value, {r('median')} AS median, up, down FROM prof"
for _m in ("price", "listings"):
    @query("seasonal_profile" if _m == "price" else "seasonal_profile_listings", f"WITH se AS (SELECT item_id, hour, value FROM sin WHERE metric = '{_m}'), {profile_sql('se', [], 18)} SELECT {POUT}")
    def _(x, _m=_m):
        return op.seasonal_profile(_inputs(x).filter(F.col("metric") == _m), _bridge(x), AS_OF)


@query("profile_extrema", f"""WITH se AS (SELECT item_id, hour, value FROM sin WHERE metric = 'price'), {profile_sql('se', [], 18)}
  SELECT set_id, boundary, arg_min(slot, (value, slot)) AS low_hour, {r('min(value)')} AS low, arg_max(slot, (value, slot)) AS high_hour, {r('max(value)')} AS high
  FROM prof WHERE kind = 'hour' AND n >= 3 GROUP BY 1, 2""")
def _(x):
    return op.profile_extrema(op.seasonal_profile(_inputs(x).filter("metric = 'price'"), _bridge(x), AS_OF), ["set_id", "boundary"])


@query("activity_profiles", f"""WITH ok AS (SELECT * FROM sin WHERE metric IN ('price', 'traded', 'stock') AND value >= 0 AND (metric <> 'price' OR value > 0)),
  se AS (SELECT metric, item_id, hour, value FROM ok WHERE (item_id, hour) IN (SELECT (item_id, hour) FROM ok GROUP BY item_id, hour HAVING count(*) = 3)),
  {profile_sql('se', ['metric'], 18, "WHERE (set_id, day) IN (SELECT (set_id, day) FROM cd GROUP BY set_id, day HAVING count(*) = 3)")} SELECT metric, {POUT}""")
def _(x):
    return op.activity_profiles(_inputs(x), _bridge(x), AS_OF, ["price", "traded", "stock"])


view("q5", """SELECT item_id, date_trunc('hour', sold_date) AS hour, bool_and(k <> 0) AS known, bool_and(k <> 0) AND NOT bool_or(k >= 98) AS overlap,
  bool_and(k <> 0) AND NOT bool_or(k >= 98) AND count(*) < 6 AS clean FROM t5 GROUP BY 1, 2""")


def _flagged(x):
    """Hourly prices with quality flags from a run log of the busy items."""
    t = x.trades(wide=False)
    runs = t.groupBy("item_id", F.date_trunc("hour", "sold_date").alias("h")).agg(
        F.min("sold_date").alias("started_at"), F.max("sold_date").alias("finished_at"), F.count(F.lit(1)).alias("sold_rows"),
        (F.max("k") >= 98).alias("saturated"), F.lit(0).alias("listing_rows"), F.when(F.min("k") == 0, F.lit("timeout")).alias("error"))
    points = _points(x).withColumnRenamed("price", "value")
    return health.quality_join(points, runs, full_sold=6)


def rep_sql(b):
    """Member days of boundary b: relation `md`."""
    return f"""f AS (SELECT c.item_id, c.hour, CAST(gold AS DOUBLE) / qty AS value, known, overlap, clean FROM c5 c JOIN q5 USING (item_id, hour)),
      p AS (SELECT item_id, mode, CAST(hour + INTERVAL {9 - b} HOUR AS DATE) AS day, CAST((hour(hour + INTERVAL 9 HOUR)) AS INTEGER) AS clock, value FROM f, (VALUES ('all'), ('noThursday'), ('known'), ('overlap'), ('clean')) v(mode)
        WHERE CASE mode WHEN 'all' THEN true WHEN 'noThursday' THEN isodow(hour + INTERVAL 9 HOUR) <> 4 WHEN 'known' THEN known WHEN 'overlap' THEN overlap ELSE clean END
          AND CAST(CAST(hour + INTERVAL {9 - b} HOUR AS DATE) AS TIMESTAMP) + INTERVAL {24 + b - 9} HOUR <= {NOW}),
      sz AS (SELECT set_id, count(*) AS size FROM brg GROUP BY 1),
      g AS (SELECT set_id, mode, item_id, day FROM p JOIN brg USING (item_id) GROUP BY ALL HAVING count(*) >= 16),
      wd AS (SELECT set_id, mode, day FROM g JOIN sz USING (set_id) GROUP BY set_id, mode, day, size HAVING count(*) = size),
      bl AS (SELECT brg.set_id, p.*, CASE WHEN clock BETWEEN 6 AND 8 THEN 'm' ELSE 'e' END AS block FROM p JOIN brg USING (item_id) JOIN wd ON wd.set_id = brg.set_id AND wd.mode = p.mode AND wd.day = p.day
        WHERE clock BETWEEN 6 AND 8 OR clock BETWEEN 18 AND 20),
      ss AS (SELECT set_id, mode, day, clock FROM bl JOIN sz USING (set_id) GROUP BY set_id, mode, day, clock, size HAVING count(*) = size),
      mm AS (SELECT set_id, mode, day, item_id, avg(value) FILTER (block = 'm') AS a, avg(value) FILTER (block = 'e') AS b FROM bl JOIN ss USING (set_id, mode, day, clock) GROUP BY ALL
        HAVING count(*) FILTER (block = 'm') >= 2 AND count(*) FILTER (block = 'e') >= 2),
      md AS (SELECT set_id, mode, day, item_id, CASE WHEN a > 0 THEN (b / a - 1) * 100 END AS pct, count(*) OVER (PARTITION BY set_id, mode, day) AS size FROM mm)"""


SUM = f"count(*) AS n, count(*) FILTER (pct > 0) AS up, count(*) FILTER (pct < 0) AS down, {r('quantile_cont(pct, 0.5)')} AS median_pct, {r('avg(pct)')} AS mean_pct"
for _b in (0, 6):
    @query("repetition" if _b == 6 else "repetition_0h", f"WITH {rep_sql(_b)}, dd AS (SELECT set_id, mode, day, avg(pct) AS pct FROM md GROUP BY 1, 2, 3) SELECT set_id, mode, {SUM} FROM dd GROUP BY 1, 2")
    def _(x, _b=_b):
        return op.repetition(op.repetition_days(_flagged(x), _bridge(x), AS_OF, _b, min_hours=16))


@query("leave_one_out", f"""WITH {rep_sql(6)}, o AS (SELECT a.set_id, a.mode, a.day, 'without' AS part, a.item_id, avg(b.pct) AS pct FROM md a JOIN md b ON a.set_id = b.set_id AND a.mode = b.mode AND a.day = b.day AND a.item_id <> b.item_id GROUP BY ALL
    UNION ALL SELECT set_id, mode, day, 'alone', item_id, pct FROM md) SELECT set_id, mode, part, item_id, {SUM} FROM o GROUP BY 1, 2, 3, 4""")
def _(x):
    return op.leave_one_out(op.repetition_days(_flagged(x), _bridge(x), AS_OF, 6, min_hours=16))


view("wmk", """WITH d AS (SELECT * FROM duk WHERE category <> 'error' AND vwap > 0 AND qty > 0 AND day >= DATE '2024-01-15' AND day < DATE '2024-01-29'),
  g AS (SELECT item_id, count(*) FILTER (day < DATE '2024-01-22') AS prev_days, count(*) FILTER (day >= DATE '2024-01-22') AS last_days, CAST(sum(qty) FILTER (day < DATE '2024-01-22') AS BIGINT) AS prev_qty,
    CAST(sum(qty) FILTER (day >= DATE '2024-01-22') AS BIGINT) AS last_qty, sum(vwap * qty) FILTER (day < DATE '2024-01-22') AS pg, sum(vwap * qty) FILTER (day >= DATE '2024-01-22') AS lg FROM d GROUP BY 1)
  SELECT item_id, prev_days, last_days, prev_qty, last_qty, pg / prev_qty AS prev_price, lg / last_qty AS last_price, round((lg / last_qty / (pg / prev_qty) - 1) * 100, 1) AS change_pct FROM g WHERE prev_days >= 5 AND last_days >= 5""")


def _market(x):
    return op.weekly_market(bars.daily_ohlc(x.candles().filter("category <> 'error'")), AS_OF)


@query("weekly_market", f"SELECT item_id, prev_days, last_days, prev_qty, last_qty, {r('prev_price')} AS prev_price, {r('last_price')} AS last_price, {r('change_pct')} AS change_pct FROM wmk")
def _(x):
    return _market(x)


@query("weekly_breadth", f"""SELECT count(*) AS items, count(*) FILTER (change_pct > 0) AS up, count(*) FILTER (change_pct < 0) AS down, count(*) FILTER (change_pct = 0) AS flat, {r('quantile_cont(change_pct, 0.5)')} AS median_pct,
  (SELECT string_agg(item_id, ',' ORDER BY change_pct DESC, item_id) FROM (SELECT * FROM wmk WHERE change_pct > 0 ORDER BY change_pct DESC, item_id LIMIT 3)) AS risers,
  (SELECT string_agg(item_id, ',' ORDER BY change_pct, item_id) FROM (SELECT * FROM wmk WHERE change_pct < 0 ORDER BY change_pct, item_id LIMIT 3)) AS fallers FROM wmk""")
def _(x):
    return op.weekly_breadth(_market(x))


@query("period_overlap", """WITH p AS (SELECT id, CAST(starts_at AS DATE) AS s, CASE WHEN id % 5 <> 0 THEN CAST(ends_at AS DATE) END AS e FROM cal),
  d AS (SELECT CAST(DATE '2024-01-10' + CAST(i AS INTEGER) AS DATE) AS day FROM range(11) q(i))
  SELECT id, CAST(day AS VARCHAR) AS day, CASE WHEN s = day AND e = day THEN 'start and end' WHEN s = day THEN 'start' WHEN e = day THEN 'end' ELSE 'during' END AS phase FROM p JOIN d ON s <= day AND (e IS NULL OR day <= e)""")
def _(x):
    p = x.calendar().select("id", F.to_date("starts_at").alias("start_day"), F.when(F.col("id") % 5 != 0, F.to_date("ends_at")).alias("end_day"))
    return op.period_overlap(p, "2024-01-10", "2024-01-20").select("id", "day", "phase")
