"""Ledger queries."""
from pyspark.sql import functions as F

from tidebook.catalog.forecast import issues
from tidebook.catalog.registry import query, r, view
from tidebook.operators import candles as bars, ledger as op
from tidebook.sources.bindings import AS_OF

MODELS = ["last", "mean7", "same_weekday"]


def _versioned(x):
    return issues(x)[1].withColumn("version", F.lit("v2"))


@query("ledger_issue", f"SELECT version, series, CAST(origin AS VARCHAR) AS origin, h, model, {r('value')} AS value FROM (SELECT 'v2' AS version, * FROM iss) WHERE origin = DATE '2024-01-30'")
def _(x):
    p = _versioned(x)
    ledger = p.filter("origin < '2024-01-29'").select("version", "origin")
    return op.ledger_issue(ledger, p, AS_OF, "2024-01-30 11:00:00").select("version", "series", "origin", "h", "model", "value")


@query("ledger_settle", f"""WITH t AS (SELECT DISTINCT series, d AS target FROM iss WHERE h IN (1, 7) AND d <= DATE '2024-01-28' AND d >= DATE '2024-01-24')
  SELECT 'v2' AS version, t.series, CAST(target AS VARCHAR) AS target, {r('value')} AS value FROM t LEFT JOIN iser s ON s.series = t.series AND s.day = t.target AND day(s.day) % 4 <> 0""")
def _(x):
    s, _p = issues(x)
    p = _versioned(x)
    settled = p.filter("d < '2024-01-24'").select("version", F.col("d").alias("target")).distinct()
    return op.ledger_settle(p, settled, s.filter(F.dayofmonth("day") % 4 != 0), "2024-01-30", "2024-01-30").select("version", "series", "target", "value")


view("pan", """WITH a AS (SELECT item_id, day, vwap, n, day - CAST(row_number() OVER (PARTITION BY item_id ORDER BY day) AS INTEGER) AS g FROM du5 WHERE vwap > 0 AND n > 0),
  w AS (SELECT *, row_number() OVER v AS td, avg(n) OVER v AS mn, min(day) OVER v AS fd, avg(vwap) OVER (PARTITION BY item_id, g ORDER BY day ROWS 6 PRECEDING) AS m7, lag(vwap, 5) OVER v AS s1, lag(vwap, 3) OVER v AS s3,
    lag(vwap, 6) OVER v AS s7 FROM a WINDOW v AS (PARTITION BY item_id, g ORDER BY day))
  SELECT item_id, CAST(day + 1 AS DATE) AS origin, fd, td, mn, vwap AS l, m7, s1, s3, s7, CASE WHEN NOT (td >= 14 AND mn >= 5) THEN 'needs 21 days in a row and 5 trades a day' END AS reason FROM w""")


def _daily5(x):
    return bars.daily_ohlc(x.candles(wide=False), "UTC").select("item_id", "day", "vwap", "n")


@query("panel_origins", f"""SELECT item_id, CAST(origin AS VARCHAR) AS origin, CAST(fd AS VARCHAR) AS first_day, CAST(td AS INTEGER) AS train_days, {r('mn')} AS mean_n, {r('l')} AS last, {r('m7')} AS mean7,
  {r('s1')} AS same1, {r('s3')} AS same3, {r('s7')} AS same7, reason FROM pan""")
def _(x):
    return op.panel_origins(_daily5(x), min_days=14)


@query("panel_input", f"""WITH d AS (SELECT item_id, day, n FROM duk WHERE day < DATE '2024-01-30'), i AS (SELECT item_id, max(day) AS ld FROM d GROUP BY 1),
  g AS (SELECT item_id, day, n, day - CAST(row_number() OVER (PARTITION BY item_id ORDER BY day) AS INTEGER) AS g FROM d),
  q AS (SELECT g.item_id, min(g.day) AS fd, count(*) AS td, avg(g.n) AS mn FROM g JOIN g l ON l.item_id = g.item_id AND l.g = g.g AND l.day = DATE '2024-01-29' GROUP BY 1)
  SELECT i.item_id, CAST(coalesce(td, 0) AS INTEGER) AS train_days, CAST(fd AS VARCHAR) AS first_day, {r('mn')} AS mean_n, CASE WHEN td >= 21 AND mn >= 5 THEN NULL ELSE 'needs 21 days in a row and 5 trades a day' END AS reason
  FROM i LEFT JOIN q USING (item_id)""")
def _(x):
    return op.panel_input(bars.daily_ohlc(x.candles()), "2024-01-30")


view("bas", """SELECT item_id, origin, h, model, value, CAST(origin + CAST(h AS INTEGER) AS DATE) AS target FROM (
  SELECT item_id, origin, unnest([{'h': 1, 'model': 'last', 'value': l}, {'h': 3, 'model': 'last', 'value': l}, {'h': 7, 'model': 'last', 'value': l}, {'h': 1, 'model': 'mean7', 'value': m7}, {'h': 3, 'model': 'mean7', 'value': m7},
    {'h': 7, 'model': 'mean7', 'value': m7}, {'h': 1, 'model': 'same_weekday', 'value': s1}, {'h': 3, 'model': 'same_weekday', 'value': s3}, {'h': 7, 'model': 'same_weekday', 'value': s7}], recursive := true) FROM pan WHERE reason IS NULL)""")


def baseline(x):
    return op.baseline_models(op.panel_origins(_daily5(x), min_days=14))


@query("baseline_models", f"SELECT item_id, CAST(origin AS VARCHAR) AS origin, CAST(h AS INTEGER) AS h, model, {r('value')} AS value, CAST(target AS VARCHAR) AS target FROM bas")
def _(x):
    return baseline(x)


view("pst", """SELECT t.item_id, t.target, CASE WHEN n >= 60 AND vwap > 0 THEN vwap END AS actual, coalesce(n, 0) AS n,
  CASE WHEN n IS NULL THEN 'no bar' WHEN NOT (n >= 60 AND vwap > 0) THEN 'too few trades or no price' END AS reason
  FROM (SELECT DISTINCT item_id, target FROM bas WHERE target <= DATE '2024-01-28') t LEFT JOIN (SELECT * FROM du5 WHERE day(day) % 9 <> 0) d ON d.item_id = t.item_id AND d.day = t.target""")


def _settled(x, b):
    return op.panel_settle(_daily5(x).filter(F.dayofmonth("day") % 9 != 0), b, "2024-01-30", min_n=60)


@query("panel_settle", f"SELECT item_id, CAST(target AS VARCHAR) AS target, {r('actual')} AS actual, n, reason FROM pst")
def _(x):
    return _settled(x, baseline(x))


view("pcs", """SELECT b.*, p.actual, p.n, p.reason, CASE WHEN p.item_id IS NULL THEN 'pending' WHEN p.actual IS NULL THEN 'excluded' ELSE 'scored' END AS state
  FROM bas b LEFT JOIN pst p ON p.item_id = b.item_id AND p.target = b.target""")


def cases(x):
    b = baseline(x)
    return op.panel_cases(b, _settled(x, b))


@query("panel_cases", f"SELECT item_id, CAST(origin AS VARCHAR) AS origin, CAST(h AS INTEGER) AS h, model, state, reason, {r('actual')} AS actual FROM pcs")
def _(x):
    return cases(x).select("item_id", "origin", "h", "model", "state", "reason", "actual")


view("pape", """WITH o AS (SELECT *, abs(value / actual - 1) * 100 AS ape FROM pcs WHERE state = 'scored')
  SELECT o.*, l.ape AS hold FROM o JOIN o l ON l.item_id = o.item_id AND l.origin = o.origin AND l.h = o.h AND l.model = 'last'""")


@query("panel_settle_eval", f"""WITH i AS (SELECT h, model, item_id, count(*) AS n, avg(ape) AS m, avg(hold) AS b, sum(ape) AS s FROM pape GROUP BY 1, 2, 3)
  SELECT CAST(h AS INTEGER) AS h, model, CAST(sum(n) AS BIGINT) AS cases, count(*) AS items, {r('sum(s) / sum(n)')} AS mape, {r('avg(m)')} AS item_mape, {r('avg(b)')} AS item_baseline, count(*) FILTER (m < b - 1e-9) AS wins,
    (SELECT count(DISTINCT target) FROM pape p WHERE p.h = i.h AND p.model = i.model) AS dates FROM i GROUP BY i.h, model""")
def _(x):
    return op.panel_settle_eval(cases(x))


@query("ledger_validate", """WITH b AS (SELECT item_id, origin, h, model, CASE WHEN day(origin) = 20 THEN 'v1' ELSE 'v2' END AS version, CASE WHEN day(origin) = 22 AND model = 'last' THEN target + 1 ELSE target END AS target,
    CASE WHEN day(origin) = 24 AND h = 3 THEN -value ELSE value END AS value, CASE WHEN day(origin) = 23 AND h = 1 THEN NULL WHEN day(origin) = 26 THEN TIMESTAMP '2024-01-27 12:00:00' ELSE origin + INTERVAL 3 HOUR END AS issued_at FROM bas WHERE NOT (day(origin) = 28 AND h = 7)),
  v AS (SELECT item_id, origin, 'version' AS rule FROM b WHERE version <> 'v2' UNION ALL SELECT item_id, origin, 'issued on another day' FROM b WHERE CAST(issued_at + INTERVAL 9 HOUR AS DATE) IS DISTINCT FROM CAST(origin AS DATE)
    UNION ALL SELECT item_id, origin, 'issued in the future' FROM b WHERE issued_at > TIMESTAMP '2024-01-28 12:00:00'
    UNION ALL SELECT item_id, origin, 'target date' FROM b WHERE CAST(target AS DATE) <> origin + CAST(h AS INTEGER) UNION ALL SELECT item_id, origin, 'value' FROM b WHERE value <= 0
    UNION ALL SELECT item_id, origin, 'horizons' FROM b GROUP BY 1, 2 HAVING count(DISTINCT h) <> 3 UNION ALL SELECT item_id, origin, 'models' FROM b GROUP BY 1, 2 HAVING count(*) <> 9)
  SELECT item_id, CAST(origin AS VARCHAR) AS origin, rule, count(*) AS rows FROM v GROUP BY 1, 2, 3""")
def _(x):
    day = F.dayofmonth("origin")
    b = baseline(x).filter(~((day == 28) & (F.col("h") == 7))).withColumns({
        "version": F.when(day == 20, "v1").otherwise("v2"),
        "target": F.when((day == 22) & (F.col("model") == "last"), F.date_add("target", 1)).otherwise(F.col("target")),
        "value": F.when((day == 24) & (F.col("h") == 3), -F.col("value")).otherwise(F.col("value")),
        "issued_at": F.when((day == 23) & (F.col("h") == 1), F.lit(None)).when(day == 26, F.lit("2024-01-27 12:00:00").cast("timestamp")).otherwise(F.col("origin").cast("timestamp") + F.expr("INTERVAL 3 HOURS"))})
    return op.ledger_validate(b, "v2", MODELS, now="2024-01-28 12:00:00")


@query("forecast_usable", """WITH p AS (SELECT item_id, list((d, v) ORDER BY d) AS pts FROM (SELECT item_id, day AS d, CASE WHEN n % 7 = 0 THEN -vwap ELSE vwap END AS v FROM duk WHERE day BETWEEN DATE '2024-01-22' AND DATE '2024-01-29') GROUP BY 1),
  a AS (SELECT item_id, day AS ad, vwap AS av, CASE WHEN n % 5 = 0 THEN 'waiting' ELSE 'ready' END AS status FROM duk WHERE day = DATE '2024-01-21')
  SELECT p.item_id, coalesce(status = 'ready' AND len(pts) = 8 AND av > 0 AND list_bool_and(list_transform(pts, lambda q: q[2] > 0)), false) AS usable FROM p LEFT JOIN a USING (item_id)""")
def _(x):
    d = bars.daily_ohlc(x.candles())
    pts = (d.filter("day BETWEEN '2024-01-22' AND '2024-01-29'").groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct(
        F.col("day").alias("d"), F.when(F.col("n") % 7 == 0, -F.col("vwap")).otherwise(F.col("vwap")).alias("value")))).alias("points")))
    anchor = d.filter("day = '2024-01-21'").select("item_id", F.col("day").alias("anchor_day"), F.col("vwap").alias("anchor_value"),
                                                   F.when(F.col("n") % 5 == 0, "waiting").otherwise("ready").alias("status"))
    return op.forecast_usable(pts.join(anchor, "item_id", "left"), "2024-01-22")


@query("review_overview", f"""SELECT item_id, CAST(h AS INTEGER) AS h, model, count(*) AS n, {r('avg(ape)')} AS mape, count(*) FILTER (model = 'mean7' AND day(origin) % 3 = 0) AS failures,
  CASE WHEN model <> 'last' THEN count(*) FILTER (ape < hold) END AS wins, count(*) >= 7 AS comparable FROM pape GROUP BY item_id, pape.h, model""")
def _(x):
    c = cases(x).withColumn("failed", (F.col("model") == "mean7") & (F.dayofmonth("origin") % 3 == 0))
    return op.review_overview(c)
