"""Model study queries."""
from pyspark.sql import functions as F

from tidebook.catalog.candles import NOW
from tidebook.catalog.ledger import _daily5
from tidebook.catalog.registry import query, r, view
from tidebook.catalog.seasonal import _flagged
from tidebook.operators import ledger, models as op
from tidebook.plans.split import newest
from tidebook.sources.bindings import AS_OF

KD = "CAST(CAST(hour + INTERVAL 9 HOUR AS DATE) AS VARCHAR)"
view("hsp", """WITH a AS (SELECT item_id, hour, CAST(gold AS DOUBLE) / qty AS vwap, row_number() OVER (PARTITION BY item_id ORDER BY hour) AS i, count(*) OVER (PARTITION BY item_id) AS m,
    date_diff('hour', min(hour) OVER (PARTITION BY item_id), hour) AS x FROM c1 WHERE gold > 0), b AS (SELECT *, least(24, floor(m * 0.3)) AS test FROM a)
  SELECT *, i <= m - test AS train, ln(vwap) AS y, hour(hour + INTERVAL 9 HOUR) AS clock FROM b WHERE m >= 24 AND m - test >= 16 AND test >= 6""")
view("hco", """WITH d AS (SELECT clock, y - avg(y) OVER (PARTITION BY item_id) AS dev FROM hsp WHERE train), l AS (SELECT c.clock, coalesce(avg(dev), 0) AS c FROM range(24) c(clock) LEFT JOIN d ON d.clock = c.clock GROUP BY 1)
  SELECT clock, c - avg(c) OVER () AS coef FROM l""")
view("hcase", """WITH s AS (SELECT h.*, coef FROM hsp h JOIN hco USING (clock)), t AS (SELECT *, y - coef AS d FROM s WHERE train),
  f AS (SELECT item_id, coalesce(regr_slope(d, x), 0) AS b, avg(d) AS md, avg(x) AS mx, max(x) AS lx, arg_max(vwap, x) AS lp FROM t GROUP BY 1),
  q AS (SELECT t.item_id, list_sort(list(d - (md - b * mx) - b * x)) AS r, count(*) AS n FROM t JOIN f USING (item_id) GROUP BY 1)
  SELECT s.item_id, s.hour, s.vwap AS actual, md - b * mx + b * x + coef AS base, exp(md - b * mx + b * x + coef) AS predicted, lp AS naive, greatest(1, x - lx) AS elapsed,
    r[CAST(least(floor(n * 0.1), n - 1) AS INTEGER) + 1] AS r_lo, r[CAST(least(floor(n * 0.9), n - 1) AS INTEGER) + 1] AS r_hi FROM s JOIN f USING (item_id) JOIN q USING (item_id) WHERE NOT train""")


@query("hourly_holdout", f"SELECT item_id, count(*) AS n, {r('avg(abs(predicted - actual) / actual) * 100')} AS model_mape, {r('avg(abs(naive - actual) / actual) * 100')} AS naive_mape FROM hcase GROUP BY 1")
def _(x):
    return op.hourly_holdout(op.holdout_cases(x.candles()))


@query("hourly_holdout_coverage", f"""WITH g AS (SELECT growth, count(*) AS n, count(*) FILTER (actual BETWEEN exp(base + r_lo * (1 + growth * (elapsed - 1))) AND exp(base + r_hi * (1 + growth * (elapsed - 1)))) / count(*) * 100 AS coverage
    FROM hcase, (VALUES (CAST(0 AS DOUBLE)), (0.02), (0.05), (0.1)) v(growth) GROUP BY 1)
  SELECT {r('growth')} AS growth, n, {r('coverage')} AS coverage, row_number() OVER (ORDER BY abs(coverage - 80), growth) = 1 AS chosen FROM g""")
def _(x):
    return op.holdout_coverage(op.holdout_cases(x.candles()))


def _points(x):
    """Hourly price with the book's last quantity and the quality flag."""
    s = x.snapshots(wide=False).filter("upgrade IS NULL OR upgrade = 0").withColumn("hour", F.date_trunc("hour", "captured_at"))
    stock = newest(s, ["item_id", "hour"], ["captured_at", "id"], ["total_qty"])
    return _flagged(x).select("item_id", "hour", F.col("value").alias("price"), "known").join(stock, ["item_id", "hour"]).withColumnRenamed("total_qty", "stock")


view("mpt", """WITH s AS (SELECT item_id, date_trunc('hour', captured_at) AS hour, arg_max(total_qty, (captured_at, id)) AS stock FROM sn5 WHERE upgrade IS NULL OR upgrade = 0 GROUP BY 1, 2)
  SELECT c.item_id, c.hour, CAST(c.gold AS DOUBLE) / c.qty AS price, stock, known FROM c5 c JOIN s USING (item_id, hour) JOIN q5 USING (item_id, hour)""")
view("rsm", """SELECT a.item_id, h, a.hour, ln(a.price / b.price) AS x0, ln((1 + a.stock) / (1 + b.stock)) AS x1, ln(n.price / a.price) AS y FROM mpt a JOIN mpt b ON b.item_id = a.item_id AND b.hour = a.hour - INTERVAL 1 HOUR
  CROSS JOIN (VALUES (1), (3), (6)) v(h) JOIN mpt n ON n.item_id = a.item_id AND n.hour = a.hour + to_hours(h)""")
view("rcase", """WITH g AS (SELECT s.item_id, s.h, s.hour, s.x0, s.x1, s.y, count(*) AS n, avg(r.x0) AS m0, avg(r.x1) AS m1, avg(r.y) AS my, var_pop(r.x0) AS v0, var_pop(r.x1) AS v1, covar_pop(r.x0, r.x1) AS c01,
    covar_pop(r.x0, r.y) AS c0y, covar_pop(r.x1, r.y) AS c1y FROM rsm s JOIN rsm r ON r.item_id = s.item_id AND r.h = s.h AND r.hour <= s.hour - to_hours(s.h) GROUP BY ALL HAVING count(*) >= 100),
  f AS (SELECT item_id, h, min(hour) AS t0 FROM rsm GROUP BY 1, 2),
  z AS (SELECT g.*, (g.x0 - m0) / sqrt(v0) AS z0, (g.x1 - m1) / sqrt(v1) AS z1, n * c0y / sqrt(v0) AS b0, n * c1y / sqrt(v1) AS b1, n * c01 / sqrt(v0 * v1) AS a01, n + 1 AS d FROM g JOIN f USING (item_id, h) WHERE g.hour - t0 >= INTERVAL 7 DAY)
  SELECT item_id, h, hour, n, y, my + z0 * b0 / d AS p1, my + z0 * (b0 * d - a01 * b1) / (d * d - a01 * a01) + z1 * (b1 * d - a01 * b0) / (d * d - a01 * a01) AS p2 FROM z""")


@query("ridge_hourly", f"""SELECT item_id, h, hour, {KD} AS day, n AS train_n, {r('y')} AS actual, {r('p1')} AS pred_price, {r('p2')} AS pred_stock, {r('abs(exp(-y) - 1) * 100')} AS err_hold,
  {r('abs(exp(p1 - y) - 1) * 100')} AS err_price, {r('abs(exp(p2 - y) - 1) * 100')} AS err_stock FROM rcase""")
def _(x):
    return op.ridge_hourly(_points(x))


@query("ridge_summary", f"""WITH e AS (SELECT *, {KD} AS day, abs(exp(-y) - 1) * 100 AS e0, abs(exp(p1 - y) - 1) * 100 AS e1, abs(exp(p2 - y) - 1) * 100 AS e2 FROM rcase),
  d AS (SELECT item_id, h, day, avg(e2) < avg(e1) AS w FROM e GROUP BY 1, 2, 3), w AS (SELECT item_id, h, count(*) AS days, count(*) FILTER (w) AS stock_wins FROM d GROUP BY 1, 2)
  SELECT e.item_id, e.h, count(*) AS n, {r('avg(e0)')} AS mape_hold, {r('avg(e1)')} AS mape_price, {r('avg(e2)')} AS mape_stock, any_value(days) AS days, any_value(stock_wins) AS stock_wins FROM e JOIN w USING (item_id, h) GROUP BY 1, 2""")
def _(x):
    return op.ridge_summary(op.ridge_hourly(_points(x)))


def _elimination(d: int = 4) -> str:
    """Chain of views that eliminates the normal equations of `jg`, as the operator does; its last one is `je`."""
    cells = [(i, j) for i in range(d) for j in range(i, d)]
    keep = "* EXCLUDE ({})"
    at = lambda i, j: f"(s{i}{j} - n * m{i} * m{j}) / (e{i} * e{j}) + {1 if i == j else 0}"
    out = ["j0 AS (SELECT *, sy / n AS p0, " + ", ".join(f"s{i} / n AS m{i}" for i in range(d)) + " FROM jg)",
           "j1 AS (SELECT *, " + ", ".join(f"CASE WHEN greatest(s{i}{i} - n * m{i} * m{i}, 0) > 0 THEN sqrt((s{i}{i} - n * m{i} * m{i}) / n) ELSE 1 END AS e{i}" for i in range(d)) + " FROM j0)",
           "k0 AS (SELECT *, " + ", ".join([*(f"{at(i, j)} AS a{i}{j}" for i, j in cells), *(f"(sy{i} - n * m{i} * p0) / e{i} AS u{i}" for i in range(d)), *(f"(x{i} - m{i}) / e{i} AS w{i}" for i in range(d))]) + " FROM j1)"]
    for k in range(d):
        rest = range(k + 1, d)
        new = {f"a{i}{j}": f"a{i}{j} - a{k}{i} / a{k}{k} * a{k}{j}" for i in rest for j in rest if j >= i} | {f"{c}{j}": f"{c}{j} - a{k}{j} / a{k}{k} * {c}{k}" for c in "uw" for j in rest}
        cols = "* REPLACE (" + ", ".join(f"{e} AS {n}" for n, e in new.items()) + ")" if new else "*"
        out.append(f"k{k + 1} AS (SELECT {cols}, p{k} + u{k} * w{k} / a{k}{k} AS p{k + 1} FROM k{k})")
    return ",\n  ".join(out)


def joint_sql(horizons, origin_hour):
    """Forecasts of one local hour of every day, straight from the samples of the 28 days before each origin."""
    hs = ", ".join(f"({h})" for h in horizons)
    sums = ", ".join(["count(s.hour) AS n", "sum(s.y) AS sy", *(f"sum(s.x{i}) AS s{i}" for i in range(4)), *(f"sum(s.x{i} * s.y) AS sy{i}" for i in range(4)),
                      *(f"sum(s.x{i} * s.x{j}) AS s{i}{j}" for i in range(4) for j in range(i, 4))])
    turn = lambda f: f"CASE WHEN v.h % 24 = 0 THEN 0 ELSE {f}((v.c + v.h) * (2 * pi() / 24)) - {f}(v.c * (2 * pi() / 24)) END"
    return f"""WITH p AS MATERIALIZED (SELECT *, hour(hour + INTERVAL 9 HOUR) AS c FROM mpt WHERE hour + INTERVAL 1 HOUR <= {NOW}),
  jx AS MATERIALIZED (SELECT v.item_id, v.hour, CAST(v.h AS INTEGER) AS h, v.price, a.price AS y_base, a.item_id IS NOT NULL AND b.item_id IS NOT NULL AS ready, coalesce(v.known AND a.known AND b.known AND n.known, false) AS known,
      n.price AS n_price, yp.price AS y_price, ln(v.price / a.price) * v.h / 24 AS x0, {turn('sin')} AS x1, {turn('cos')} AS x2, ln((1 + v.stock) / (1 + b.stock)) AS x3, ln(n.price / v.price) AS y
    FROM (SELECT p.*, h FROM p, (VALUES {hs}) q(h)) v LEFT JOIN p a ON a.item_id = v.item_id AND a.hour = v.hour - INTERVAL 24 HOUR LEFT JOIN p b ON b.item_id = v.item_id AND b.hour = v.hour - INTERVAL 3 HOUR
    LEFT JOIN p n ON n.item_id = v.item_id AND n.hour = v.hour + to_hours(v.h) LEFT JOIN p yp ON yp.item_id = v.item_id AND yp.hour = v.hour - INTERVAL 24 HOUR + to_hours(v.h)),
  js AS MATERIALIZED (SELECT * FROM jx WHERE ready AND n_price > 0),
  jd AS (SELECT item_id, CAST(unnest(generate_series(CAST(CAST(min(hour) + INTERVAL 9 HOUR AS DATE) AS TIMESTAMP), {NOW} + INTERVAL 9 HOUR, INTERVAL 1 DAY)) AS DATE) AS day FROM p GROUP BY 1),
  jc AS (SELECT item_id, day, CAST(day AS TIMESTAMP) + to_hours({origin_hour - 9}) AS hour, CAST(h AS INTEGER) AS h FROM jd, (VALUES {hs}) q(h) WHERE CAST(day AS TIMESTAMP) + to_hours({origin_hour - 8}) <= {NOW}),
  jg AS MATERIALIZED (SELECT jc.item_id, jc.day, jc.hour, jc.h, any_value(o.price) AS price, any_value(o.ready) AS ready, any_value(o.known) AS known, any_value(o.n_price) AS n_price, any_value(o.y_price) AS y_price, any_value(o.y_base) AS y_base,
      {', '.join(f'any_value(o.x{i}) AS x{i}' for i in range(4))}, {sums}, epoch(max(s.hour) - min(s.hour)) / 3600 AS span
    FROM jc LEFT JOIN jx o ON o.item_id = jc.item_id AND o.hour = jc.hour AND o.h = jc.h
    LEFT JOIN js s ON s.item_id = jc.item_id AND s.h = jc.h AND s.hour < jc.hour AND s.hour >= jc.hour - INTERVAL 28 DAY AND s.hour + to_hours(s.h) <= jc.hour GROUP BY 1, 2, 3, 4),
  {_elimination()},
  jm AS (SELECT *, bool_and(n >= 120 AND coalesce(span >= 168, false)) OVER (PARTITION BY item_id, hour) AS every FROM k4),
  jt AS (SELECT *, CASE WHEN NOT coalesce(ready, false) THEN 'input missing' WHEN NOT every THEN 'training insufficient' ELSE 'issued' END AS state FROM jm)
  SELECT item_id, day, hour, h, state, price AS base, n_price AS actual, coalesce(known, false) AS known, CASE WHEN price IS NOT NULL THEN n END AS train_n, CASE WHEN state = 'issued' THEN price END AS hold,
    CASE WHEN state = 'issued' THEN price * exp(p1) END AS trend, CASE WHEN state = 'issued' THEN price * exp(p3) END AS clock, CASE WHEN state = 'issued' THEN price * exp(p4) END AS stock,
    CASE WHEN state = 'issued' THEN y_price END AS y_price, CASE WHEN state = 'issued' THEN y_base END AS y_base FROM jt"""


view("jev", joint_sql((10, 11, 12), 8))
view("fdp", joint_sql(range(1, 25), 5))
FULL = lambda c: f"CASE WHEN count({c}) = count(*) THEN avg({c}) END"


@query("joint_evening", f"""WITH g AS (SELECT item_id, day, state, max(base) AS base, {FULL('actual')} AS actual, bool_and(known) AS known, min(train_n) AS train_n, {FULL('hold')} AS hold, {FULL('trend')} AS trend, {FULL('clock')} AS clock,
    {FULL('stock')} AS stock, {FULL('y_price')} AS yp, max(y_base) AS yb FROM jev GROUP BY 1, 2, 3)
  SELECT item_id, CAST(day AS VARCHAR) AS day, state, {r('base')} AS base, {r('actual')} AS actual, known, train_n, {r('hold')} AS hold, {r('trend')} AS trend, {r('clock')} AS clock, {r('stock')} AS stock, {r('base * yp / yb')} AS yesterday FROM g""")
def _(x):
    return op.joint_evening(_points(x), AS_OF)


@query("joint_evening_simple", f"""WITH p AS (SELECT * FROM mpt WHERE hour + INTERVAL 1 HOUR <= {NOW}),
  d AS (SELECT item_id, unnest(generate_series(CAST(CAST(min(hour) + INTERVAL 9 HOUR AS DATE) AS TIMESTAMP) - INTERVAL 1 HOUR, {NOW} - INTERVAL 1 HOUR, INTERVAL 1 DAY)) AS hour FROM p GROUP BY 1),
  o AS (SELECT d.item_id, d.hour, p.price FROM d LEFT JOIN p USING (item_id, hour)),
  t AS (SELECT o.item_id, o.hour, o.price AS base, avg(n.price) AS actual, count(*) AS k FROM (SELECT * FROM o WHERE price IS NOT NULL) o JOIN p n ON n.item_id = o.item_id AND n.hour BETWEEN o.hour + INTERVAL 10 HOUR AND o.hour + INTERVAL 12 HOUR GROUP BY 1, 2, 3),
  y AS (SELECT o.item_id, o.hour, avg(n.price) AS yp, count(*) AS k FROM o JOIN p n ON n.item_id = o.item_id AND n.hour BETWEEN o.hour - INTERVAL 14 HOUR AND o.hour - INTERVAL 12 HOUR GROUP BY 1, 2),
  a AS (SELECT item_id, hour FROM o WHERE price IS NOT NULL AND EXISTS (SELECT 1 FROM p WHERE p.item_id = o.item_id AND p.hour = o.hour - INTERVAL 24 HOUR) AND EXISTS (SELECT 1 FROM p WHERE p.item_id = o.item_id AND p.hour = o.hour - INTERVAL 3 HOUR))
  SELECT o.item_id, CAST(CAST(o.hour + INTERVAL 9 HOUR AS DATE) AS VARCHAR) AS day, {r('o.price')} AS base, CASE WHEN t.k = 3 THEN {r('t.actual')} END AS actual, a.hour IS NOT NULL AS complete_input,
    CASE WHEN y.k = 3 AND a.hour IS NOT NULL THEN {r('o.price * yp / b.price')} END AS yesterday
  FROM o LEFT JOIN t USING (item_id, hour) LEFT JOIN y USING (item_id, hour) LEFT JOIN a USING (item_id, hour) LEFT JOIN p b ON b.item_id = o.item_id AND b.hour = o.hour - INTERVAL 24 HOUR""")
def _(x):
    f = op.joint_evening(_points(x), AS_OF, least=0, warm_days=-10**6)
    ok = F.col("state") != "input missing"
    return f.select("item_id", "day", "base", "actual", ok.alias("complete_input"), F.when(ok, F.col("yesterday")).alias("yesterday"))


PATH_COLS = ["base", "actual", "hold", "trend", "clock", "stock"]


@query("full_day_path", f"""SELECT item_id, CAST(day AS VARCHAR) AS day, hour, h, state, {', '.join(f'{r(c)} AS {c}' for c in PATH_COLS)}, {r('y_price')} AS yesterday, known, train_n FROM fdp""")
def _(x):
    return op.full_day_path(_points(x), AS_OF)


view("fdl", """SELECT item_id, day, h, m.model AS model, m.v AS value, actual, base, hold AS held FROM (SELECT *, unnest([{'model': 'hold', 'v': hold}, {'model': 'trend', 'v': trend}, {'model': 'clock', 'v': clock},
  {'model': 'stock', 'v': stock}, {'model': 'yesterday', 'v': y_price}]) AS m FROM fdp WHERE state = 'issued') WHERE actual IS NOT NULL AND m.v IS NOT NULL""")
view("fdd", """SELECT item_id, day, model, count(*) AS hours, avg(abs(value / actual - 1)) * 100 AS path_mape, avg(abs(held / actual - 1)) * 100 AS hold_mape,
  CASE WHEN count(*) = 24 THEN abs(avg(value) / avg(actual) - 1) * 100 END AS mean_price_ape FROM fdl GROUP BY 1, 2, 3""")


@query("full_day_days", f"SELECT item_id, CAST(day AS VARCHAR) AS day, model, hours, {r('path_mape')} AS path_mape, {r('hold_mape')} AS hold_mape, {r('mean_price_ape')} AS mean_price_ape FROM fdd")
def _(x):
    return op.path_days(op.full_day_path(_points(x), AS_OF))


@query("full_day_summary", f"""SELECT item_id, model, count(*) AS days18, {r('avg(path_mape)')} AS path_mape, {r('avg(hold_mape)')} AS hold_mape, count(*) FILTER (path_mape < hold_mape) AS wins, count(*) FILTER (hours = 24) AS days24,
  {r('avg(path_mape) FILTER (hours = 24)')} AS complete_mape, {r('avg(mean_price_ape) FILTER (hours = 24)')} AS mean_price_mape FROM fdd WHERE hours >= 18 GROUP BY 1, 2""")
def _(x):
    return op.path_summary(op.path_days(op.full_day_path(_points(x), AS_OF)))


@query("full_day_curve", f"SELECT item_id, h, model, count(*) AS n, {r('avg(actual / base * 100)')} AS actual_index, {r('avg(value / base * 100)')} AS model_index FROM fdl GROUP BY 1, 2, 3")
def _(x):
    return op.path_curve(op.full_day_path(_points(x), AS_OF))


def _days(x):
    """Next-day forecasts of the simple models, with the price they start from."""
    p = ledger.panel_origins(_daily5(x), min_days=7).filter("reason IS NULL")
    t = _daily5(x).select("item_id", F.date_sub("day", 1).alias("origin"), F.col("vwap").alias("actual"))
    return p.join(t, ["item_id", "origin"], "left").select("item_id", F.col("origin").alias("day"), F.col("last").alias("base"), "actual", "last", "mean7", F.col("same1").alias("same"))


view("dd", """WITH w AS (SELECT item_id, day, vwap, n, row_number() OVER v AS td, avg(n) OVER v AS mn, avg(vwap) OVER (PARTITION BY item_id ORDER BY day ROWS 6 PRECEDING) AS m7, lag(vwap, 5) OVER v AS s1 FROM du5 WINDOW v AS (PARTITION BY item_id ORDER BY day))
  SELECT w.item_id, CAST(w.day + 1 AS DATE) AS day, w.vwap AS base, t.vwap AS actual, w.vwap AS last, m7 AS mean7, s1 AS same FROM w LEFT JOIN du5 t ON t.item_id = w.item_id AND t.day = w.day + 2 WHERE td >= 7 AND mn >= 5""")
DL = """WITH l AS (SELECT item_id, day, base, actual, last, unnest([{'model': 'last', 'v': last}, {'model': 'mean7', 'v': mean7}, {'model': 'same', 'v': same}]) AS m FROM dd WHERE actual IS NOT NULL)"""


@query("error_score", f"""{DL}, e AS (SELECT item_id, m.model AS model, abs(m.v / actual - 1) * 100 AS ape, abs(last / actual - 1) * 100 AS hape, (m.v / actual - 1) * 100 AS b FROM l WHERE m.v IS NOT NULL)
  SELECT item_id, model, count(*) AS n, {r('avg(ape)')} AS mape, {r('avg(b)')} AS bias, count(*) FILTER (ape < hape) AS wins, {r('avg(hape)')} AS hold_mape, {r('quantile_cont(ape, 0.5)')} AS median_ape,
    {r('list_sort(list(ape))[CAST(floor(0.9 * (count(*) - 1)) AS INTEGER) + 1]')} AS p90_ape FROM e GROUP BY 1, 2""")
def _(x):
    return op.error_score(_days(x), ["last", "mean7", "same"], ["item_id"])


CELLS = ", ".join(f"count(*) FILTER (a = {i} AND b = {j}) AS m{i}{j}" for i in range(3) for j in range(3))


@query("direction_score", f"""{DL}, g AS (SELECT item_id, (actual / base - 1) * 100 AS t, m.model AS model, (m.v / base - 1) * 100 AS mv FROM l WHERE m.v IS NOT NULL
    UNION ALL SELECT item_id, (actual / base - 1) * 100, c.m, c.v FROM dd, (VALUES ('always down', -100), ('always flat', 0), ('always up', 100)) c(m, v) WHERE actual IS NOT NULL),
  d AS (SELECT item_id, model, th, CASE WHEN t > th + 1e-9 THEN 2 WHEN t < -th - 1e-9 THEN 0 ELSE 1 END AS a, CASE WHEN mv > th + 1e-9 THEN 2 WHEN mv < -th - 1e-9 THEN 0 ELSE 1 END AS b FROM g, (VALUES (CAST(0 AS DOUBLE)), (0.5), (1.0)) v(th)),
  c AS (SELECT item_id, model, {r('th')} AS threshold, count(*) AS n, {CELLS} FROM d GROUP BY item_id, model, th),
  s AS (SELECT *, m00 + m01 + m02 AS s0, m10 + m11 + m12 AS s1, m20 + m21 + m22 AS s2 FROM c)
  SELECT * EXCLUDE (s0, s1, s2), {r('(m00 + m11 + m22) / n')} AS accuracy,
    {r('(CASE WHEN s0 > 0 THEN m00 / s0 ELSE 0 END + CASE WHEN s1 > 0 THEN m11 / s1 ELSE 0 END + CASE WHEN s2 > 0 THEN m22 / s2 ELSE 0 END) / ((s0 > 0)::INT + (s1 > 0)::INT + (s2 > 0)::INT)')} AS balanced FROM s""")
def _(x):
    return op.direction_score(_days(x), ["last", "mean7", "same"], ["item_id"])


@query("block_bootstrap", f"""WITH RECURSIVE v AS (SELECT item_id, day, abs(mean7 / actual - 1) * 100 - abs(last / actual - 1) * 100 AS d FROM dd WHERE actual IS NOT NULL AND mean7 IS NOT NULL),
  b AS (SELECT item_id, (day - min(day) OVER (PARTITION BY item_id)) // 3 AS b, d FROM v), bl AS (SELECT item_id, b, sum(d) AS s, count(*) AS n FROM b GROUP BY 1, 2),
  bi AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY b) - 1 AS i, count(*) OVER (PARTITION BY item_id) AS k FROM bl),
  lc AS (SELECT 0 AS j, CAST((20261001::BIGINT * 1664525 + 1013904223) % 4294967296 AS BIGINT) AS seed UNION ALL SELECT j + 1, CAST((seed::HUGEINT * 1664525 + 1013904223) % 4294967296 AS BIGINT) FROM lc WHERE j < 2000 * (SELECT max(k) FROM bi) - 1),
  ks AS (SELECT DISTINCT item_id, k FROM bi),
  pk AS (SELECT item_id, j // k AS draw, CAST(floor(seed / 4294967296 * k) AS BIGINT) AS i FROM ks JOIN lc ON j < 2000 * k WHERE k >= 4),
  ms AS (SELECT pk.item_id, draw, sum(s) / sum(n) AS m FROM pk JOIN bi ON bi.item_id = pk.item_id AND bi.i = pk.i GROUP BY 1, 2),
  iv AS (SELECT item_id, list_sort(list(m)) AS l FROM ms GROUP BY 1)
  SELECT bi.item_id, CAST(sum(n) AS BIGINT) AS n, count(*) AS blocks, {r('sum(s) / sum(n)')} AS mean_difference, {r('any_value(l)[51]')} AS low, {r('any_value(l)[1950]')} AS high FROM bi LEFT JOIN iv USING (item_id) GROUP BY 1""")
def _(x):
    return op.block_bootstrap(_days(x), "mean7", "last", ["item_id"])
