"""Ranking and floor queries."""
from pyspark.sql import functions as F

from tidebook.catalog.candles import NOW
from tidebook.catalog.registry import query, r, view
from tidebook.operators import ranking as op
from tidebook.sources.bindings import AS_OF

view("l50", f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY sold_date DESC, id DESC) AS rn FROM t5 WHERE sold_date <= {NOW}) WHERE rn <= 50""")
view("test_est", f"""WITH a AS (SELECT item_id, count(*) AS n, min(sold_date) AS a, (epoch_us(max(sold_date)) - epoch_us(min(sold_date))) / 1e6 AS s,
    CAST(coalesce(sum(unit_price * qty) FILTER (sold_date >= {NOW} - INTERVAL 24 HOUR), 0) AS DOUBLE) AS gold,
    CAST(coalesce(sum(qty) FILTER (sold_date >= {NOW} - INTERVAL 24 HOUR), 0) AS BIGINT) AS observed_qty,
    count(*) FILTER (sold_date >= {NOW} - INTERVAL 24 HOUR) AS trades, arg_max(unit_price, (sold_date, id)) AS last_price FROM l50 GROUP BY 1),
  f AS (SELECT *, n = 50 AND a > {NOW} - INTERVAL 24 HOUR AS sat, greatest(60.0, s * n / (n - 1)) / 60 AS cov FROM a)
  SELECT item_id, CAST(floor(CASE WHEN sat THEN gold * 1440 / cov ELSE gold END + 0.5) AS BIGINT) AS turnover, observed_qty, trades, last_price,
    CASE WHEN sat THEN cov END AS span_minutes, CASE WHEN sat THEN 'estimated' ELSE 'api_complete' END AS basis FROM f""")
EST = f"SELECT item_id, turnover, observed_qty, trades, last_price, {r('span_minutes')} AS span_minutes, basis"


@query("turnover_estimate", EST + " FROM test_est")
def _(x):
    return op.turnover_estimate(x.trades(wide=False), AS_OF, limit=50)


@query("turnover_rank", f"""WITH c AS (SELECT item_id, CAST(sum(unit_price * qty) AS BIGINT) AS turnover, CAST(sum(qty) AS BIGINT) AS observed_qty, count(*) AS trades,
    arg_max(unit_price, (sold_date, id)) AS last_price, NULL AS span_minutes, 'collected' AS basis FROM ta WHERE sold_date > {NOW} - INTERVAL 24 HOUR AND category <> 'error' GROUP BY 1),
  u AS (SELECT * FROM c UNION ALL SELECT * FROM test_est)
  {EST}, CAST(row_number() OVER (ORDER BY turnover DESC, item_id) AS INTEGER) AS rank, CASE WHEN span_minutes > 0 THEN {r('1440 / span_minutes')} END AS factor
  FROM u ORDER BY turnover DESC, item_id LIMIT 20""")
def _(x):
    got = op.collected_turnover(x.trades().filter("category <> 'error'"), AS_OF)
    return op.turnover_rank(op.turnover_estimate(x.trades(wide=False), AS_OF, limit=50), got, keep=20)


@query("liquidity_scan", f"""WITH a AS (SELECT item_id, count(*) AS trades, (epoch_us(max(sold_date)) - epoch_us(min(sold_date))) / 1e6 / 60 AS s, list_sort(list(unit_price)) AS p
    FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY sold_date DESC, id DESC) AS rn FROM ta) WHERE rn <= 100 GROUP BY 1)
  SELECT item_id, trades, {r('s')} AS span_min, p[CAST(floor(trades / 2) AS INTEGER) + 1] AS median, {r('s / trades')} AS minutes_per_trade FROM a WHERE trades >= 30""")
def _(x):
    return op.liquidity_scan(x.trades(), AS_OF)


view("cat", "SELECT CAST(p_partkey AS VARCHAR) AS item_id, p_name AS item_name, p_type AS item_type, p_brand AS item_kind FROM part")


@query("universe_select", """SELECT * FROM cat WHERE regexp_matches(item_name, '^(red|small) ') AND NOT regexp_matches(item_name, 'ring$')
  AND item_id NOT IN (SELECT CAST(l_partkey AS VARCHAR) FROM lineitem WHERE l_quantity >= 50)""")
def _(x):
    tracked = x.table("lineitem").filter("l_quantity >= 50").select(F.col("l_partkey").cast("string").alias("item_id"))
    return op.universe_select(x.catalog(), "^(red|small) ", "ring$", tracked)


@query("market_universe", "SELECT * FROM cat WHERE item_kind = 'Brand#17' AND NOT regexp_matches(item_name, 'bolt$')")
def _(x):
    return op.market_universe(x.catalog(), "Brand#17", "bolt$")


@query("type_histogram", "SELECT item_type, count(*) AS items FROM cat GROUP BY 1")
def _(x):
    return op.type_histogram(x.catalog())


@query("name_bigrams", """WITH g AS (SELECT DISTINCT item_id, substr(item_name, CAST(i AS INTEGER), 2) AS gram FROM cat, range(1, 40) q(i) WHERE i < length(item_name))
  SELECT gram, count(*) AS names FROM g WHERE regexp_matches(gram, '[a-z]') GROUP BY 1""")
def _(x):
    return op.name_bigrams(x.catalog(), "[a-z]")


@query("floor_index", """WITH w AS (SELECT scan_id, count(*) AS scanned FROM sob GROUP BY 1 HAVING count(*) FILTER (status = 'failed') = 0)
  SELECT scan_id, any_value(scanned) AS scanned, list_sort(list(min_price))[CAST(least(floor(count(*) * 0.1), count(*) - 1) AS INTEGER) + 1] AS p10,
    list_sort(list(min_price))[CAST(least(floor(count(*) * 0.5), count(*) - 1) AS INTEGER) + 1] AS median, min(min_price) AS min_unit_price,
    arg_min(item_id, (min_price, item_id)) AS min_item_id, count(*) AS with_listings, CAST(sum(listing_count) AS BIGINT) AS total_listings
  FROM sob JOIN w USING (scan_id) WHERE status = 'observed' GROUP BY 1""")
def _(x):
    return op.floor_index(x.scan_observations())


@query("cheapest_k", f"""WITH m AS (SELECT date_trunc('hour', sold_date) AS scan_id, item_id, user_id AS auction_no, id, CASE WHEN k = 98 THEN 0 ELSE unit_price END AS p, qty FROM t5),
  bad AS (SELECT scan_id, max(p <= 0) AS malformed FROM m GROUP BY 1),
  u AS (SELECT scan_id, auction_no, arg_max(p, id) AS p FROM m WHERE p > 0 GROUP BY 1, 2),
  k AS (SELECT scan_id, count(*) AS found, max(p) AS kth, sum(p) AS s, string_agg(CAST(auction_no AS VARCHAR), ',' ORDER BY p, auction_no) AS ids FROM
    (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY p, auction_no) AS rn FROM u) WHERE rn <= 5 GROUP BY 1),
  b AS (SELECT scan_id, min(top) AS boundary FROM (SELECT scan_id, item_id, max(p) AS top FROM m GROUP BY 1, 2 HAVING count(*) >= 6) GROUP BY 1),
  t AS (SELECT bad.scan_id, malformed, found, kth, s, ids, NOT malformed AND NOT (boundary IS NOT NULL AND (coalesce(found, 0) < 5 OR boundary < kth)) AS trusted
    FROM bad LEFT JOIN k USING (scan_id) LEFT JOIN b USING (scan_id))
  SELECT scan_id, malformed, found, trusted, CASE WHEN trusted AND found = 5 THEN {r('s / 5')} END AS mean_price, CASE WHEN trusted THEN ids END AS listings FROM t""")
def _(x):
    m = x.trades(wide=False).select(F.date_trunc("hour", "sold_date").alias("scan_id"), "item_id", F.col("user_id").alias("auction_no"), F.col("id").alias("position"),
                                    F.when(F.col("k") == 98, 0).otherwise(F.col("unit_price")).alias("unit_price"), F.col("qty").alias("cnt"))
    caps = m.groupBy("scan_id", "item_id").agg(F.count(F.lit(1)).alias("n"), F.max("unit_price").alias("boundary")).filter("n >= 6")
    return op.cheapest_k(m, caps, k=5)


@query("matched_floor_change", f"""WITH v AS (SELECT scan_id, item_id, min_price AS p FROM sob WHERE status = 'observed' AND min_price > 0
    AND scan_id NOT IN (SELECT scan_id FROM sob WHERE status = 'failed')),
  a AS (SELECT scan_id, count(*) AS n, list_sort(list(p))[CAST(floor(count(*) * 0.1) AS INTEGER) + 1] AS q FROM v GROUP BY 1),
  m AS (SELECT n.scan_id, count(*) AS common, list_sort(list(n.p))[CAST(floor(count(*) * 0.1) AS INTEGER) + 1] AS nq,
    list_sort(list(o.p))[CAST(floor(count(*) * 0.1) AS INTEGER) + 1] AS oq FROM v n JOIN v o ON o.item_id = n.item_id AND o.scan_id = n.scan_id - INTERVAL 1 HOUR GROUP BY 1)
  SELECT m.scan_id, common, b.n AS before, a.n AS after, {r('ln(a.q / b.q) * 100')} AS raw, {r('ln(nq / oq) * 100')} AS matched,
    {r('ln(a.q / b.q) * 100 - ln(nq / oq) * 100')} AS difference
  FROM m JOIN a USING (scan_id) JOIN a b ON b.scan_id = m.scan_id - INTERVAL 1 HOUR WHERE common >= 3""")
def _(x):
    return op.matched_floor_change(x.scan_observations(), min_common=3)
