"""Statistical test queries."""
from pyspark.sql import functions as F

from tidebook.catalog.candles import NOW
from tidebook.catalog.registry import query, r, view
from tidebook.operators import stats as op
from tidebook.sources.bindings import AS_OF

view("lrun", f"""WITH b AS (SELECT item_id, hour, CAST(gold AS DOUBLE) / qty AS vwap, n, epoch(hour) / 3600 - row_number() OVER (PARTITION BY item_id ORDER BY hour) AS g FROM c5 WHERE hour < {NOW}),
  s AS (SELECT item_id, g, row_number() OVER (PARTITION BY item_id ORDER BY count(*) DESC, max(hour) DESC) AS rn FROM b GROUP BY 1, 2)
  SELECT b.item_id, hour, vwap, b.n FROM b JOIN s ON s.item_id = b.item_id AND s.g = b.g WHERE rn = 1""")


@query("longest_run", f"SELECT item_id, hour, {r('vwap')} AS vwap, n FROM lrun")
def _(x):
    return op.longest_run(x.candles(wide=False), AS_OF).select("item_id", "hour", "vwap", "n")


def vr_sql(name, q):
    lags = "".join(f", sum(s * s{k}) AS x{k}" for k in range(1, q))
    cols = "".join(f", lag(s, {k}) OVER (PARTITION BY item_id ORDER BY hour) AS s{k}" for k in range(1, q))
    theta = " + ".join(f"{(2 * (1 - k / q)) ** 2} * x{k}" for k in range(1, q))
    return f"""WITH a AS (SELECT item_id, hour, vwap, ln(vwap / lag(vwap) OVER w) AS r1, ln(vwap / lag(vwap, {q}) OVER w) AS rq FROM lrun WINDOW w AS (PARTITION BY item_id ORDER BY hour)),
      b AS (SELECT *, avg(r1) OVER (PARTITION BY item_id) AS mu FROM a), c AS (SELECT *, (r1 - mu) ^ 2 AS s FROM b), d AS (SELECT *{cols} FROM c),
      g AS (SELECT item_id, count(*) AS bars, count(r1) AS n, sum(s) AS ss, sum((rq - {q} * mu) ^ 2) AS sq{lags} FROM d GROUP BY 1),
      h AS (SELECT *, ({theta}) / ss ^ 2 AS theta, (sq / ({q} * (n - {q} + 1) * (1 - {q} / n))) / (ss / (n - 1)) AS v FROM g),
      i AS (SELECT *, CASE WHEN bars >= 30 AND theta > 0 THEN v END AS vr, CASE WHEN bars >= 30 AND theta > 0 THEN (v - 1) / sqrt(theta) END AS z FROM h),
      j AS (SELECT *, 1 / (1 + 0.2316419 * abs(z)) AS t FROM i)
      SELECT item_id, bars, CASE WHEN vr IS NOT NULL THEN n END AS returns, vr, z, CASE WHEN z IS NOT NULL THEN least(1, 2 * exp(-z * z / 2) / sqrt(2 * pi()) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))) END AS p FROM j"""


view("vr2", vr_sql("vr2", 2))
view("vr4", vr_sql("vr4", 4))
VOUT = f"SELECT item_id, bars, returns, {r('vr')} AS vr, {r('z')} AS z, {r('p')} AS p FROM "
for _q in (2, 4):
    @query("variance_ratio" if _q == 2 else "variance_ratio_q4", VOUT + f"vr{_q}")
    def _(x, _q=_q):
        return op.variance_ratio(op.longest_run(x.candles(wide=False), AS_OF), _q)


view("hlm", """SELECT *, max(step) OVER (ORDER BY p, item_id ROWS UNBOUNDED PRECEDING) AS adjusted FROM (SELECT *, least(1, p * (count(*) OVER () - row_number() OVER (ORDER BY p, item_id) + 1)) AS step FROM vr2 WHERE p IS NOT NULL)""")


@query("holm", f"SELECT item_id, {r('p')} AS p, {r('adjusted')} AS adjusted FROM hlm")
def _(x):
    return op.holm(op.variance_ratio(op.longest_run(x.candles(wide=False), AS_OF)).filter("p IS NOT NULL").select("item_id", "p"))


view("rwr", f"""WITH f AS (SELECT item_id, min(hour) AS first_hour, max(hour) AS last_hour, avg(n) AS per_bar, avg(vwap) AS price, stddev_samp(lr) * 100 AS volatility FROM
    (SELECT *, ln(vwap / lag(vwap) OVER (PARTITION BY item_id ORDER BY hour)) AS lr FROM lrun) GROUP BY 1),
  t AS (SELECT item_id, CAST(least(ceil(row_number() OVER (ORDER BY per_bar, item_id) / greatest(ceil(count(*) OVER () / 3), 1)), 3) AS BIGINT) AS third FROM f JOIN hlm USING (item_id))
  SELECT v.*, first_hour, last_hour, per_bar, price, volatility, adjusted, third, coalesce(adjusted < 0.05, false) AS significant,
    CASE WHEN v.vr IS NULL THEN CASE WHEN v.bars < 30 THEN 'too few contiguous hours' ELSE 'no usable variance' END END AS excluded
  FROM vr2 v JOIN f USING (item_id) LEFT JOIN (SELECT item_id, adjusted FROM hlm) USING (item_id) LEFT JOIN t USING (item_id)""")


def _report(x):
    return op.random_walk_report(x.candles(wide=False), AS_OF)


@query("random_walk_report", f"""SELECT item_id, bars, returns, {r('vr')} AS vr, {r('z')} AS z, {r('p')} AS p, first_hour, last_hour, {r('per_bar')} AS per_bar, {r('price')} AS price, {r('volatility')} AS volatility,
  {r('adjusted')} AS adjusted, third, significant, excluded FROM rwr""")
def _(x):
    return _report(x)


TOT = "count(*) AS items, count(*) FILTER (significant) AS significant, count(*) FILTER (significant AND vr < 1) AS reversal, count(*) FILTER (significant AND vr > 1) AS momentum"


@query("random_walk_summary", f"""SELECT CAST(0 AS BIGINT) AS third, {TOT}, {r('quantile_cont(vr, 0.5)')} AS vr, {r('avg(per_bar)')} AS per_bar FROM rwr WHERE vr IS NOT NULL
  UNION ALL SELECT third, {TOT}, {r('avg(vr)')}, {r('avg(per_bar)')} FROM rwr WHERE vr IS NOT NULL GROUP BY third""")
def _(x):
    return op.random_walk_summary(_report(x))
