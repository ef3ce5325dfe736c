"""Cleaning and distribution queries."""
from pyspark.sql import functions as F

from tidebook.catalog.candles import KDAY
from tidebook.catalog.registry import query, r, view
from tidebook.operators import candles as bars, cleaning as op
from tidebook.session import reuse

TIERED = "error"
view("cdays", f"""WITH raw AS (SELECT item_id, {KDAY.format('sold_date')} AS day, quantile_cont(unit_price, 0.5) AS median,
    count(*) AS observed_n, CAST(sum(qty) AS BIGINT) AS observed_qty, count(*) FILTER (id <= (SELECT raw_max_id FROM st)) AS en,
    coalesce(sum(qty) FILTER (id <= (SELECT raw_max_id FROM st)), 0) AS eq FROM tr WHERE category <> 'error' GROUP BY 1, 2),
  x AS (SELECT item_id, {KDAY.format('hour')} AS day, sum(n) AS n, sum(qty) AS qty FROM stbars
    WHERE category <> 'error' GROUP BY 1, 2),
  d AS (SELECT coalesce(raw.item_id, x.item_id) AS item_id, coalesce(raw.day, x.day) AS day, median,
    coalesce(observed_n, 0) AS observed_n, coalesce(observed_qty, 0) AS observed_qty,
    coalesce(en = coalesce(x.n, 0) AND eq = coalesce(x.qty, 0), false) AS verified
    FROM raw FULL JOIN x ON raw.item_id = x.item_id AND raw.day = x.day)
  SELECT d.*, coalesce(xn, 0) AS excluded_n, CAST(coalesce(xq, 0) AS BIGINT) AS excluded_qty FROM d LEFT JOIN
    (SELECT d.item_id, d.day, count(*) AS xn, sum(qty) AS xq FROM tr t JOIN d ON d.item_id = t.item_id
       AND d.day = {KDAY.format('t.sold_date')} WHERE verified AND (unit_price < median / 10 OR unit_price > median * 10) GROUP BY 1, 2) e
    ON e.item_id = d.item_id AND e.day = d.day""")
# Bars as held by the display build: one hour of every day was lost for one item of each type.
view("stbars", "SELECT * FROM b1 WHERE NOT (item_id LIKE '%-3' AND hour(hour) = 5)")


def held(x):
    return x.known_bars().filter(~(F.col("item_id").endswith("-3") & (F.hour("hour") == 5)))


def cleaning_days(x):
    return op.cleaning_days(x.trades(), held(x), x.raw_max_id(), TIERED)


@query("cleaning_days", f"""SELECT item_id, CAST(day AS VARCHAR) AS day, {r('median')} AS median, observed_n, observed_qty, verified,
  excluded_n, excluded_qty FROM cdays""")
def _(x):
    return cleaning_days(x)


view("ctr", f"""SELECT t.* FROM tr t LEFT JOIN cdays d ON d.item_id = t.item_id AND d.day = {KDAY.format('t.sold_date')}
  WHERE category = 'error' OR (verified AND unit_price BETWEEN median / 10 AND median * 10)""")
view("cc1", """SELECT item_id, date_trunc('hour', sold_date) AS hour, arg_min(unit_price, (sold_date, id)) AS o, max(unit_price) AS h,
  min(unit_price) AS l, arg_max(unit_price, (sold_date, id)) AS c, sum(unit_price * qty) AS gold, CAST(sum(qty) AS BIGINT) AS qty,
  count(*) AS n FROM ctr WHERE id <= (SELECT raw_max_id FROM st) GROUP BY 1, 2""")


@query("clean_trades", "SELECT id, item_id, sold_date, unit_price, qty FROM ctr")
def _(x):
    return op.clean_trades(x.trades(), cleaning_days(x), TIERED).select("id", "item_id", "sold_date", "unit_price", "qty")


@query("clean_candles", f"SELECT item_id, hour, o, h, l, c, {r('gold')} AS gold, qty, n, {r('CAST(gold AS DOUBLE) / qty')} AS vwap FROM cc1")
def _(x):
    return op.clean_candles(x.trades(), cleaning_days(x), x.raw_max_id(), TIERED)


@query("cleaning_summary", """SELECT CAST(sum(excluded_n) AS BIGINT) AS excluded_trades, CAST(sum(excluded_qty) AS BIGINT) AS excluded_qty,
  count(*) FILTER (NOT verified) AS unverified_days, count(*) AS days FROM cdays""")
def _(x):
    return op.cleaning_summary(cleaning_days(x))


def _methods(name, table):
    view(name, f"""WITH t AS (SELECT item_id, {KDAY.format('sold_date')} AS day, unit_price AS u, qty FROM {table}),
      s AS (SELECT item_id, day, quantile_cont(u, 0.25) AS q1, quantile_cont(u, 0.5) AS median, quantile_cont(u, 0.75) AS q3, count(*) AS n,
        CAST(sum(qty) AS BIGINT) AS qty, min(u) AS low, max(u) AS high, avg(u) AS mu, stddev_pop(u) AS sd, CAST(sum(u * qty) AS DOUBLE) / sum(qty) AS original FROM t GROUP BY 1, 2),
      m AS (SELECT item_id, day, quantile_cont(abs(u - median), 0.5) AS mad FROM t JOIN s USING (item_id, day) GROUP BY 1, 2),
      k AS (SELECT t.*, method, CASE method WHEN 'raw' THEN true
          WHEN 'iqr' THEN q1 = q3 OR (u >= q1 - 1.5 * (q3 - q1) AND u <= q3 + 1.5 * (q3 - q1))
          WHEN 'mad' THEN mad = 0 OR abs(u - median) <= 3 * 1.4826 * mad WHEN 'zscore' THEN sd = 0 OR abs(u - mu) <= 3 * sd
          ELSE u >= median / 10 AND u <= median * 10 END AS keep
        FROM t JOIN s USING (item_id, day) JOIN m USING (item_id, day), (VALUES ('raw'), ('iqr'), ('mad'), ('zscore'), ('trade10x')) v(method))
      SELECT item_id, day, method, any_value(s.n) AS n, any_value(s.qty) AS qty, any_value(median) AS median, any_value(low) AS low, any_value(high) AS high,
        any_value(original) AS original, count(*) FILTER (keep) AS kept_n, CAST(coalesce(sum(k.qty) FILTER (keep), 0) AS BIGINT) AS kept_qty,
        CAST(sum(u * k.qty) FILTER (keep) AS DOUBLE) / sum(k.qty) FILTER (keep) AS cleaned
      FROM k JOIN s USING (item_id, day) GROUP BY 1, 2, 3""")


_methods("om", "tr")
_methods("om5", "t5")
OM = f"""SELECT item_id, CAST(day AS VARCHAR) AS day, method, n, qty, {r('median')} AS median, low, high, {r('original')} AS original,
  kept_n, kept_qty, {r('cleaned')} AS cleaned FROM """


@query("outlier_methods", OM + "om")
def _(x):
    return op.outlier_methods(x.trades())


@query("cleaned_join_verify", OM + """om o WHERE NOT EXISTS (SELECT 1 FROM duk p WHERE p.item_id = o.item_id AND p.day = o.day AND day(p.day) % 7 = 0)""")
def _(x):
    rows = reuse(op.outlier_methods(x.trades()))
    prior = bars.daily_ohlc(x.candles()).withColumn(
        "n", F.when(F.dayofmonth("day") % 7 == 0, F.col("n") + 1).otherwise(F.col("n")))
    return op.cleaned_join_verify(rows, rows, prior, "2024-01-16")


@query("train21_cases", f"""WITH u AS (SELECT * FROM om5 WHERE method = 'trade10x' AND kept_n >= 5 AND cleaned > 0),
  c AS (SELECT a.item_id, a.day, a.cleaned AS actual, count(*) AS k, avg(b.cleaned) AS m FROM u a JOIN u b ON a.item_id = b.item_id
    AND b.day < a.day AND b.day >= a.day - 21 GROUP BY 1, 2, 3)
  SELECT item_id, CAST(day AS VARCHAR) AS day, CAST(CAST(day - 21 AS DATE) AS VARCHAR) AS train_from, {r('m')} AS train_mean, {r('actual')} AS actual
  FROM c WHERE k = 21""")
def _(x):
    return op.train21_cases(op.outlier_methods(x.trades(wide=False)))


def _wq(bars_sql):
    return f"""WITH g AS (SELECT * FROM (VALUES ('day'), ('hour')) v(kind)),
      bins AS (SELECT item_id, kind, CASE kind WHEN 'day' THEN CAST({KDAY.format('sold_date')} AS TIMESTAMP) - INTERVAL 9 HOUR
          ELSE date_trunc('hour', sold_date) END AS bucket, unit_price, sum(qty) AS q, count(*) AS n FROM tr, g
        WHERE category <> 'error' AND id <= (SELECT raw_max_id FROM st) GROUP BY 1, 2, 3, 4),
      cum AS (SELECT *, sum(q) OVER (PARTITION BY item_id, kind, bucket ORDER BY unit_price) AS cu,
        sum(q) OVER (PARTITION BY item_id, kind, bucket) AS total FROM bins),
      qs AS (SELECT item_id, kind, bucket, sum(n) AS n, sum(q) AS q, min(unit_price) AS l, max(unit_price) AS h,
        min(unit_price) FILTER (cu >= total * 0.25) AS q25, min(unit_price) FILTER (cu >= total * 0.5) AS median,
        min(unit_price) FILTER (cu >= total * 0.75) AS q75 FROM cum GROUP BY 1, 2, 3),
      e AS (SELECT item_id, kind, CASE kind WHEN 'day' THEN CAST({KDAY.format('hour')} AS TIMESTAMP) - INTERVAL 9 HOUR ELSE hour END AS bucket,
        CAST(sum(n) AS BIGINT) AS n, CAST(sum(qty) AS BIGINT) AS qty, min(l) AS l, max(h) AS h, sum(gold) AS gold
        FROM {bars_sql}, g WHERE category <> 'error' GROUP BY 1, 2, 3)
      SELECT e.item_id, e.kind, e.bucket, e.n, e.qty, e.l, e.h, {r('CAST(gold AS DOUBLE) / qty')} AS vwap,
        CASE WHEN (qs.n, q, qs.l, qs.h) = (e.n, e.qty, e.l, e.h) THEN q25 END AS q25,
        CASE WHEN (qs.n, q, qs.l, qs.h) = (e.n, e.qty, e.l, e.h) THEN median END AS median,
        CASE WHEN (qs.n, q, qs.l, qs.h) = (e.n, e.qty, e.l, e.h) THEN q75 END AS q75
      FROM e LEFT JOIN qs ON qs.item_id = e.item_id AND qs.kind = e.kind AND qs.bucket = e.bucket"""


@query("weighted_quantiles", _wq("stbars"))
def _(x):
    return op.weighted_quantiles(x.trades(), held(x), x.items(), x.raw_max_id(), TIERED)


@query("quantile_family", f"""WITH s AS (SELECT item_id, list_sort(list(unit_price)) AS a, count(*) AS n, quantile_cont(unit_price, 0.25) AS p25,
    quantile_cont(unit_price, 0.5) AS p50, quantile_cont(unit_price, 0.8) AS p80 FROM t5 GROUP BY 1)
  SELECT item_id, a[CAST(least(floor(n * 0.1), n - 1) AS INTEGER) + 1] AS floor_p10, a[CAST(least(floor(n * 0.5), n - 1) AS INTEGER) + 1] AS floor_median,
    {r('p25')} AS linear_p25, {r('p50')} AS mid_median, {r('p80')} AS linear_p80, a[CAST(floor((n - 1) * 0.9) AS INTEGER) + 1] AS upper_p90 FROM s""")
def _(x):
    return op.quantile_family(x.trades(wide=False), ["item_id"], "unit_price")
