"""Multi-source merge queries."""
from pyspark.sql import functions as F

from tidebook.catalog.candles import NOW
from tidebook.catalog.market import marked_deltas
from tidebook.catalog.registry import query, r, view
from tidebook.operators import ingest, merge as op
from tidebook.operators.candles import candles_1h
from tidebook.session import reuse
from tidebook.sources.bindings import AS_OF

NATURAL = ["item_id", "sold_date", "unit_price", "qty", "reinforce"]


def numbered_sources(sales):
    """Sales of all sources as ingest stores them; equal ones of one source are numbered, so that each of them stays a sale of
    its own."""
    return reuse(ingest.dup_seq(sales, ["source"], NATURAL, "id"))


view("srca", f"SELECT * FROM src WHERE sold_date <= {NOW}")
view("mtr", """SELECT *, row_number() OVER (ORDER BY source_rank, source_id) AS new_id FROM
  (SELECT *, id AS source_id, row_number() OVER (PARTITION BY item_id, sold_date, unit_price, qty, reinforce ORDER BY source_rank, id) AS copy FROM srca) WHERE copy = 1""")


@query("merge_trades", "SELECT new_id AS id, source, source_id, item_id, sold_date, unit_price, qty FROM mtr")
def _(x):
    return op.merge_trades(numbered_sources(x.source_trades()), AS_OF).select("id", "source", "source_id", "item_id", "sold_date", "unit_price", "qty")


@query("merge_guards", """WITH p AS (SELECT *, CASE WHEN source = 'B' AND k = 7 THEN unit_price * qty + 1 ELSE unit_price * qty END AS price FROM src),
  d AS (SELECT * FROM p UNION ALL SELECT * FROM p WHERE source = 'A' AND k = 3)
  SELECT 'repeated' AS kind, source, item_id, sold_date, unit_price, qty FROM d GROUP BY source, item_id, sold_date, unit_price, qty, reinforce HAVING count(*) > 1
  UNION ALL SELECT 'conflict', NULL, item_id, sold_date, unit_price, qty FROM d GROUP BY item_id, sold_date, unit_price, qty, reinforce HAVING count(DISTINCT price) > 1""")
def _(x):
    s = numbered_sources(x.source_trades())
    price = F.col("unit_price") * F.col("qty")
    s = s.withColumn("price", F.when((F.col("source") == "B") & (F.col("k") == 7), price + 1).otherwise(price))
    doubled = s.unionByName(s.filter("source = 'A' AND k = 3"))
    return op.merge_guards(doubled, ["price"]).drop("reinforce", "dup_seq")


@query("owner_guards", """WITH o AS (SELECT item_id, source, CASE WHEN source = 'B' AND item_id LIKE '%-1' THEN valid_from - INTERVAL 1 DAY
      WHEN source = 'B' AND item_id LIKE '%-2' THEN valid_from + INTERVAL 1 DAY ELSE valid_from END AS f, valid_to AS t FROM own)
  SELECT b.item_id, 'overlap' AS kind, b.f AS valid_from FROM o a JOIN o b ON a.item_id = b.item_id AND a.source < b.source AND a.t > b.f
  UNION ALL SELECT b.item_id, 'gap', b.f FROM o a JOIN o b ON a.item_id = b.item_id AND a.source = 'A' AND b.source = 'B' AND a.t < b.f
  UNION ALL SELECT s.item_id, 'unowned', min(captured_at) FROM srcsn s WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.item_id = s.item_id
    AND coalesce(o.f <= s.captured_at, true) AND coalesce(s.captured_at < o.t, true)) GROUP BY 1""")
def _(x):
    b = F.col("source") == "B"
    start = F.when(b & F.col("item_id").endswith("-1"), F.col("valid_from") - F.expr("INTERVAL 1 DAY")) \
        .when(b & F.col("item_id").endswith("-2"), F.col("valid_from") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("valid_from"))
    return op.owner_guards(x.owners().withColumn("valid_from", start), x.source_snapshots(), "captured_at")


view("osn", f"""SELECT s.*, s.id AS source_id, row_number() OVER (ORDER BY s.source_rank, s.id) AS new_id FROM srcsn s JOIN own o ON o.item_id = s.item_id AND o.source = s.source
  AND coalesce(o.valid_from <= s.captured_at, true) AND coalesce(s.captured_at < o.valid_to, true) WHERE s.captured_at <= {NOW}""")


@query("merge_snapshots", "SELECT new_id AS id, source, source_id, item_id, captured_at, upgrade, min_unit_price, total_qty FROM osn")
def _(x):
    return op.merge_snapshots(x.source_snapshots(), x.owners(), AS_OF).select(
        "id", "source", "source_id", "item_id", "captured_at", "upgrade", "min_unit_price", "total_qty")


@query("snapshot_conflicts", f"""WITH d AS (SELECT item_id, captured_at, upgrade FROM osn UNION ALL SELECT item_id, captured_at, upgrade FROM osn WHERE listing_count = 2)
  SELECT item_id, captured_at, coalesce(upgrade, -1) AS tier, count(*) AS rows FROM d GROUP BY 1, 2, 3 HAVING count(*) > 1""")
def _(x):
    m = op.merge_snapshots(x.source_snapshots(), x.owners(), AS_OF)
    return op.snapshot_conflicts(m.unionByName(m.filter("listing_count = 2")))


@query("owned_hours", """WITH o AS (SELECT item_id, source, valid_from + INTERVAL 30 MINUTE AS f, valid_to + INTERVAL 30 MINUTE AS t FROM own),
  b AS (SELECT DISTINCT item_id, source, date_trunc('hour', sold_date) AS hour FROM src)
  SELECT b.item_id, b.source, count(*) FILTER (coalesce(hour + INTERVAL 1 HOUR <= t, true)) AS owned_bars, count(*) FILTER (hour + INTERVAL 1 HOUR > t) AS boundary_bars
  FROM b JOIN o ON o.item_id = b.item_id AND o.source = b.source AND coalesce(o.f <= hour, true) AND coalesce(hour < o.t, true) GROUP BY 1, 2""")
def _(x):
    half = F.expr("INTERVAL 30 MINUTES")
    o = x.owners().withColumns({"valid_from": F.col("valid_from") + half, "valid_to": F.col("valid_to") + half})
    return op.owned_hours(candles_1h(x.source_trades(), ["item_id", "source"]), o)


@query("unify_items", "SELECT item_id, source, min(sold_date) AS added_at FROM src JOIN (SELECT item_id, source FROM own WHERE valid_to IS NULL) USING (item_id, source) GROUP BY 1, 2")
def _(x):
    dims = x.source_trades().groupBy("item_id", "source").agg(F.min("sold_date").alias("added_at"))
    return op.unify_items(dims, x.owners())


view("sst", "SELECT source, max(id) AS raw_max_id FROM src WHERE sold_date < TIMESTAMP '2024-01-11 12:00:00' OR (source <> 'A' AND sold_date < TIMESTAMP '2024-01-29') GROUP BY 1")
view("uni", f"""WITH e AS (SELECT item_id, sold_date, unit_price, qty, reinforce, bool_or(id <= raw_max_id) AS eligible FROM srca JOIN sst USING (source) GROUP BY 1, 2, 3, 4, 5)
  SELECT m.* EXCLUDE (id), eligible, row_number() OVER (ORDER BY eligible DESC, new_id) AS id FROM mtr m JOIN e USING (item_id, sold_date, unit_price, qty, reinforce)""")


def _states(x):
    t = x.source_trades()
    return (t.filter((F.col("sold_date") < "2024-01-11 12:00:00") | ((F.col("source") != "A") & (F.col("sold_date") < "2024-01-29")))
            .groupBy("source").agg(F.max("id").alias("raw_max_id")))


@query("unify_eligible", "SELECT id, source, source_id, item_id, sold_date, eligible FROM uni")
def _(x):
    return op.unify_eligible(numbered_sources(x.source_trades()), _states(x), AS_OF).select("id", "source", "source_id", "item_id", "sold_date", "eligible")


@query("unify_candles", f"""SELECT item_id, hour, o, h, l, c, {r('gold')} AS gold, qty, n FROM
  (SELECT item_id, hour, o, h, l, c, gold, qty, n FROM c1 WHERE hour < TIMESTAMP '2024-01-06'
   UNION ALL SELECT item_id, date_trunc('hour', sold_date), arg_min(unit_price, (sold_date, id)), max(unit_price), min(unit_price), arg_max(unit_price, (sold_date, id)),
     sum(unit_price * qty), CAST(sum(qty) AS BIGINT), count(*) FROM uni WHERE eligible AND sold_date >= TIMESTAMP '2024-01-06' GROUP BY 1, 2)""")
def _(x):
    return op.unify_candles(x.candles(), op.unify_eligible(numbered_sources(x.source_trades()), _states(x), AS_OF), "2024-01-06 00:00:00").drop("vwap")


view("sdel", """SELECT 'A' AS source, auction_no, item_id, observed_at, reason, qty_sold, CAST(NULL AS TIMESTAMP) AS invalidated_at FROM linv WHERE day(observed_at) <= 12
  UNION ALL SELECT 'B', auction_no, item_id, observed_at, reason, qty_sold, invalidated_at FROM linv WHERE day(observed_at) >= 10
  UNION ALL SELECT 'C', auction_no, item_id, observed_at, reason, qty_sold, invalidated_at FROM linv WHERE day(observed_at) >= 18""")


@query("unify_deltas", """SELECT d.source, d.auction_no, d.item_id, d.observed_at, d.reason, d.qty_sold, (SELECT max(x.invalidated_at) FROM sdel x WHERE x.auction_no = d.auction_no
    AND x.item_id = d.item_id AND x.observed_at = d.observed_at AND x.reason = d.reason) AS invalidated_at
  FROM sdel d JOIN own o ON o.item_id = d.item_id AND o.source = d.source AND coalesce(o.valid_from <= d.observed_at, true) AND coalesce(d.observed_at < o.valid_to, true)""")
def _(x):
    d = marked_deltas(x).select("auction_no", "item_id", "observed_at", "reason", "qty_sold", "invalidated_at")
    day = F.dayofmonth("observed_at")
    a = d.filter(day <= 12).withColumn("invalidated_at", F.lit(None).cast("timestamp")).withColumn("source", F.lit("A"))
    b, c = (d.filter(day >= n).withColumn("source", F.lit(s)) for n, s in ((10, "B"), (18, "C")))
    return op.unify_deltas(a.unionByName(b).unionByName(c), x.owners())


view("gepo", """SELECT * FROM (VALUES ('A', CAST(NULL AS TIMESTAMP), TIMESTAMP '2024-01-11'), ('B', TIMESTAMP '2024-01-11', TIMESTAMP '2024-01-20'),
  ('C', TIMESTAMP '2024-01-20', NULL)) e(source, valid_from, valid_to)""")


def _epochs(x):
    return x.spark.sql("SELECT * FROM VALUES ('A', NULL, TIMESTAMP '2024-01-11'), ('B', TIMESTAMP '2024-01-11', TIMESTAMP '2024-01-20'), "
                       "('C', TIMESTAMP '2024-01-20', NULL) AS e(source, valid_from, valid_to)")


@query("unify_globals", f"""SELECT s.source, s.item_id, captured_at, min_unit_price FROM srcsn s JOIN gepo e ON e.source = s.source AND coalesce(e.valid_from <= captured_at, true)
  AND coalesce(captured_at < e.valid_to, true) WHERE captured_at <= {NOW}""")
def _(x):
    rows = x.source_snapshots().select("source", "item_id", "captured_at", "min_unit_price")
    return op.unify_globals(rows, _epochs(x), "captured_at", AS_OF)


@query("overlay_live", """SELECT item_id, hour, o, h, l, c, qty, n FROM c1 b WHERE hour < TIMESTAMP '2024-01-18' AND NOT EXISTS (SELECT 1 FROM b1 l WHERE l.item_id = b.item_id AND l.hour = b.hour AND l.hour >= TIMESTAMP '2024-01-15')
  UNION ALL SELECT item_id, hour, o, h, l, c, qty + 1, n FROM b1 WHERE hour >= TIMESTAMP '2024-01-15'""")
def _(x):
    cols = ["item_id", "hour", "o", "h", "l", "c", "qty", "n"]
    old = x.candles().filter("hour < '2024-01-18'").select(*cols)
    live = x.known_bars().filter("hour >= '2024-01-15'").withColumn("qty", F.col("qty") + 1).select(*cols)
    return op.overlay_live(old, live, ["item_id", "hour"])
