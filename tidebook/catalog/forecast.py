"""Forecast and backtest queries."""
from pyspark.sql import functions as F

from tidebook.catalog.candles import NOW
from tidebook.catalog.registry import query, r, view
from tidebook.catalog.seasonal import _floors
from tidebook.operators import candles as bars, forecast as op, seasonal
from tidebook.sources.bindings import AS_OF

Z = "2024-01-30"
view("fd", f"SELECT item_id, day, vwap, n FROM duk WHERE day < DATE '{Z}' AND vwap > 0")
view("ftr", f"""WITH o AS (SELECT item_id, CAST(unnest(generate_series(min(day) + 1, DATE '{Z}', INTERVAL 1 DAY)) AS DATE) AS origin FROM fd GROUP BY 1)
  SELECT o.item_id, o.origin, d.day, d.vwap, d.n, isodow(d.day) AS k FROM o JOIN fd d ON d.item_id = o.item_id AND d.day < o.origin""")
view("fst", """SELECT item_id, origin, count(*) AS obs, sum(n) AS trades, min(day) AS fd, max(day) AS ld, avg(vwap) AS m, arg_max(vwap, day) AS lv FROM ftr GROUP BY 1, 2""")
view("fcf", """WITH c AS (SELECT t.origin, k, count(*) AS n, avg(ln(t.vwap / m)) AS c FROM ftr t JOIN fst s ON s.item_id = t.item_id AND s.origin = t.origin WHERE ld - s.fd > 14 AND trades >= 25 GROUP BY 1, 2)
  SELECT origin, CAST(k AS INTEGER) AS k, n, c - avg(c) OVER (PARTITION BY origin) AS coef FROM c""")
view("fel", "SELECT * FROM fst WHERE obs >= 10 AND trades / (ld - fd + 1) >= 5")
view("ffit", """WITH t AS (SELECT t.item_id, t.origin, t.day - e.fd AS x, ln(t.vwap) AS y0, ln(t.vwap) - coalesce(coef, 0) AS y FROM ftr t JOIN fel e ON e.item_id = t.item_id AND e.origin = t.origin
    LEFT JOIN fcf c ON c.origin = t.origin AND c.k = t.k),
  f AS (SELECT item_id, origin, coalesce(regr_slope(y, x), 0) AS b, avg(y) AS my, avg(x) AS mx, coalesce(regr_slope(y0, x), 0) AS b0, avg(y0) AS my0 FROM t GROUP BY 1, 2),
  g AS (SELECT item_id, origin, b, my - b * mx AS a, b0, my0 - b0 * mx AS a0 FROM f),
  q AS (SELECT item_id, origin, list_sort(list(y - (a + b * x))) AS r, count(*) AS n FROM t JOIN g USING (item_id, origin) GROUP BY 1, 2)
  SELECT g.*, r[CAST(least(floor(n * 0.1), n - 1) AS INTEGER) + 1] AS rlo, r[CAST(least(floor(n * 0.9), n - 1) AS INTEGER) + 1] AS rhi, e.fd, e.ld, e.lv, e.obs FROM g JOIN q USING (item_id, origin) JOIN fel e USING (item_id, origin)""")
view("fpred", """WITH p AS (SELECT f.*, CAST(h AS INTEGER) AS h, CAST(origin + CAST(h AS INTEGER) AS DATE) AS d FROM ffit f, range(1, 8) q(h)),
  b AS (SELECT p.*, a + b * (d - fd) + coalesce(coef, 0) AS base, 1 + 0.45 * (greatest(1, d - ld) - 1) AS w FROM p LEFT JOIN fcf c ON c.origin = p.origin AND c.k = isodow(d))
  SELECT item_id, origin, h, d, exp(base) AS mid, exp(base + rlo * w) AS lo, exp(base + rhi * w) AS hi, lv AS naive, exp(a0 + b0 * (d - fd)) AS trend, obs FROM b""")


def _daily(x):
    return bars.daily_ohlc(x.candles()).select("item_id", "day", "vwap", "n")


@query("weekday_coeffs", f"SELECT CAST(origin AS VARCHAR) AS origin, k, n, {r('coef')} AS coef FROM fcf")
def _(x):
    return op.weekday_coeffs(op.panel(_daily(x), Z))


PATH = f"{r('mid')} AS mid, {r('lo')} AS lo, {r('hi')} AS hi, {r('naive')} AS naive"


@query("trend_weekday_forecast", f"SELECT item_id, CAST(origin AS VARCHAR) AS origin, h, CAST(d AS VARCHAR) AS d, {PATH}, {r('trend')} AS trend FROM fpred WHERE origin = DATE '{Z}'")
def _(x):
    return op.trend_weekday_forecast(_daily(x), Z)


view("fcase", """WITH e AS (SELECT item_id, max(day) AS ed FROM fd GROUP BY 1)
  SELECT p.*, a.vwap AS actual FROM fpred p JOIN e USING (item_id) JOIN fd a ON a.item_id = p.item_id AND a.day = p.d WHERE h IN (1, 7) AND origin < ed""")


@query("rolling_backtest", f"SELECT item_id, CAST(origin AS VARCHAR) AS origin, h, CAST(d AS VARCHAR) AS d, {PATH}, {r('trend')} AS trend, {r('actual')} AS actual FROM fcase")
def _(x):
    return op.rolling_backtest(_daily(x), Z)


def score_sql(table, keys):
    ape = lambda c: f"avg(abs({c} - actual) / actual) * 100"
    return f"""SELECT {keys}, count(*) AS cases, {r(ape('mid'))} AS mape, {r(ape('naive'))} AS naive_mape, {r('avg(CASE WHEN actual BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END) * 100')} AS coverage,
      {r(f"({ape('naive')} - {ape('mid')}) / ({ape('naive')}) * 100")} AS vs_naive FROM {table} GROUP BY ALL"""


@query("forecast_score", score_sql("fcase", "h"))
def _(x):
    return op.forecast_score(op.rolling_backtest(_daily(x), Z))


view("fband", """WITH mv AS (SELECT a.item_id, a.day, abs(ln(a.vwap / b.vwap)) AS mv FROM fd a JOIN fd b ON a.item_id = b.item_id AND b.day = a.day - 1),
  w AS (SELECT e.item_id, e.origin, e.ld, e.lv, count(*) AS c, quantile_cont(mv, 0.8) AS wd FROM fel e JOIN mv ON mv.item_id = e.item_id AND mv.day < e.origin GROUP BY 1, 2, 3, 4 HAVING count(*) >= 8),
  p AS (SELECT w.*, CAST(h AS INTEGER) AS h, CAST(origin + CAST(h AS INTEGER) AS DATE) AS d FROM w, range(1, 8) q(h))
  SELECT item_id, origin, h, d, lv AS mid, lv * exp(-wd * sqrt(greatest(1, d - ld))) AS lo, lv * exp(wd * sqrt(greatest(1, d - ld))) AS hi, lv AS naive FROM p""")
view("fbcase", """WITH e AS (SELECT item_id, max(day) AS ed FROM fd GROUP BY 1)
  SELECT p.*, a.vwap AS actual FROM fband p JOIN e USING (item_id) JOIN fd a ON a.item_id = p.item_id AND a.day = p.d WHERE h IN (1, 7) AND origin < ed""")


@query("naive_band", f"SELECT item_id, CAST(origin AS VARCHAR) AS origin, h, CAST(d AS VARCHAR) AS d, {PATH} FROM fband WHERE origin = DATE '{Z}'")
def _(x):
    return op.naive_band(_daily(x), Z, range(1, 8), rolling=False)


@query("naive_band_score", score_sql("fbcase", "item_id, h"))
def _(x):
    return op.forecast_score(op.naive_band(_daily(x), Z, (1, 7), rolling=True), ["item_id", "h"])


@query("compare_models", f"""WITH l AS (SELECT item_id, h, actual, unnest([{{'model': 'naive', 'v': naive}}, {{'model': 'trend', 'v': trend}}, {{'model': 'weekday', 'v': mid}}]) AS m FROM fcase),
  i AS (SELECT h, m.model AS model, item_id, count(*) AS n, sum(abs(m.v - actual) / actual * 100) AS s FROM l GROUP BY 1, 2, 3),
  j AS (SELECT i.*, i.s / i.n AS mape, i.s / i.n - t.s / t.n AS g FROM i JOIN i t ON t.h = i.h AND t.item_id = i.item_id AND t.model = 'trend')
  SELECT h, model, CAST(sum(n) AS BIGINT) AS cases, count(*) AS items, {r('sum(s) / sum(n)')} AS case_mape, {r('avg(mape)')} AS item_mape, count(*) FILTER (g < -1e-9) AS better,
    count(*) FILTER (abs(g) <= 1e-9) AS tied, count(*) FILTER (g > 1e-9) AS worse FROM j GROUP BY 1, 2""")
def _(x):
    return op.compare_models(op.rolling_backtest(_daily(x), Z))


view("bmem", "SELECT category AS basket, item_id, CAST(100 + length(item_id) * 10 AS DOUBLE) AS base FROM it")


def _members(x):
    return x.items().select(F.col("category").alias("basket"), "item_id", (F.length("item_id") * 10 + 100).cast("double").alias("base"))


def _values(x):
    return bars.daily_ohlc(x.candles()).select("item_id", "day", F.when(F.col("n") >= 3, F.col("vwap")).alias("value"))


view("bval", "SELECT item_id, day, CASE WHEN n >= 3 THEN vwap END AS value FROM duk")
view("bidx", """SELECT basket, day, CASE WHEN count(*) FILTER (value > 0) = any_value(size) THEN avg(value / base * 100) FILTER (value > 0) END AS value, count(*) FILTER (value > 0) AS coverage
  FROM bval JOIN bmem USING (item_id) JOIN (SELECT basket, count(*) AS size FROM bmem GROUP BY 1) USING (basket) GROUP BY 1, 2""")


@query("basket_index", f"SELECT basket, CAST(day AS VARCHAR) AS day, {r('value')} AS value, coverage FROM bidx")
def _(x):
    return op.basket_index(_values(x), _members(x))


@query("basket_members", f"SELECT basket, item_id, CAST(day AS VARCHAR) AS day, {r('value / base * 100')} AS value FROM bval JOIN bmem USING (item_id)")
def _(x):
    return op.basket_members(_values(x), _members(x))


view("rser", f"""SELECT 'floor-min' AS series, day, CASE WHEN hours >= 18 THEN min END AS value, hours AS coverage FROM fld WHERE day < DATE '{Z}'
  UNION ALL SELECT 'floor-p10', day, CASE WHEN hours >= 18 THEN p10 END, hours FROM fld WHERE day < DATE '{Z}' UNION ALL SELECT basket, day, value, coverage FROM bidx WHERE day < DATE '{Z}'""")


def research(x):
    return op.research_series(seasonal.floor_series(_floors(x), AS_OF), op.basket_index(_values(x), _members(x)), Z)


@query("research_series", f"SELECT series, CAST(day AS VARCHAR) AS day, {r('value')} AS value, coverage FROM rser")
def _(x):
    return research(x)


# Issued on every origin for which the day before was seen.
view("iser", "SELECT item_id AS series, day, vwap AS value FROM duk WHERE vwap > 0")
view("iss", """WITH o AS (SELECT DISTINCT CAST(day + 1 AS DATE) AS origin FROM iser),
  t AS (SELECT s.series, origin, s.day, value, s.day - o.origin AS x, ln(value) AS y, isodow(s.day) AS k FROM iser s JOIN o ON s.day < o.origin AND s.day >= o.origin - 56),
  c AS (SELECT series, origin, max(day) AS ld, arg_max(value, day) AS lv FROM t GROUP BY 1, 2 HAVING max(day) = origin - 1),
  m AS (SELECT series, origin, k, count(*) AS n, avg(x) AS mx, avg(y) AS my FROM t GROUP BY 1, 2, 3),
  f AS (SELECT t.series, t.origin, sum((x - mx) * (y - my)) / sum((x - mx) ^ 2) AS b, min(n) AS least, count(DISTINCT t.k) AS ks FROM t JOIN m ON m.series = t.series AND m.origin = t.origin AND m.k = t.k GROUP BY 1, 2),
  h AS (SELECT c.*, b, least, ks, CAST(h AS INTEGER) AS h, CAST(c.origin + CAST(h AS INTEGER) AS DATE) AS d FROM c JOIN f USING (series, origin), range(1, 8) q(h))
  SELECT series, origin, h, d, 'naive' AS model, lv AS value FROM h
  UNION ALL SELECT h.series, origin, h, d, 'seasonal', s.value FROM h JOIN iser s ON s.series = h.series AND s.day = CASE WHEN h = 7 THEN d - 14 ELSE d - 7 END
  UNION ALL SELECT h.series, h.origin, h, d, 'weekday', exp(my + b * (h - mx)) FROM h JOIN m ON m.series = h.series AND m.origin = h.origin AND m.k = isodow(d) WHERE ks = 7 AND least >= 3""")


def issues(x):
    s = bars.daily_ohlc(x.candles()).filter("vwap > 0").select(F.col("item_id").alias("series"), "day", F.col("vwap").alias("value"))
    origins = s.select(F.date_add("day", 1).alias("origin")).distinct()
    return s, op.issue_forecast(s, origins, least=3)


@query("issue_forecast", f"SELECT series, CAST(origin AS VARCHAR) AS origin, h, CAST(d AS VARCHAR) AS d, model, {r('value')} AS value FROM iss")
def _(x):
    return issues(x)[1]


@query("score_issues", f"""WITH n AS (SELECT series, origin, h, value AS hold FROM iss WHERE model = 'naive')
  SELECT i.series, i.h, model, count(*) AS n, {r('avg(abs(i.value / a.value - 1)) * 100')} AS mape, {r('avg(abs(hold / a.value - 1)) * 100')} AS naive_mape
  FROM iss i JOIN n ON n.series = i.series AND n.origin = i.origin AND n.h = i.h JOIN iser a ON a.series = i.series AND a.day = i.d WHERE i.h IN (1, 7) GROUP BY 1, 2, 3""")
def _(x):
    s, p = issues(x)
    return op.score_issues(p, s.withColumnRenamed("day", "d"))
