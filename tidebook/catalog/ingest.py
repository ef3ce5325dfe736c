"""Ingest and keyed-state queries."""
from pyspark.sql import functions as F

from tidebook.catalog.registry import query, r, view
from tidebook.operators import ingest as op


def landed_sales(x):
    """Landing rows: local wall-clock text, unreadable now and then."""
    text = F.date_format(F.from_utc_timestamp("sold_date", "Asia/Seoul"), "yyyy-MM-dd HH:mm:ss")
    return x.trades().select("id", "item_id", F.when(F.col("k") == 99, F.lit("n/a")).otherwise(text).alias("sold_text"),
                             "unit_price", "qty", "reinforce")


@query("ingest_sales", """SELECT id, item_id, date_trunc('second', sold_date) AS sold_date, unit_price, qty, reinforce
  FROM tr WHERE k <> 99""")
def _(x):
    return op.ingest_sales(landed_sales(x)).select("id", "item_id", "sold_date", "unit_price", "qty", "reinforce")


@query("ingest_listings", """SELECT id, auction_no, item_id, observed_at, unit_price, cur_count,
  CASE WHEN reg_count IS NULL THEN cur_count ELSE reg_count END AS reg_count, upgrade, expire_date FROM lr""")
def _(x):
    return op.ingest_listings(x.listing_rows()).select(
        "id", "auction_no", "item_id", "observed_at", "unit_price", "cur_count", "reg_count", "upgrade", "expire_date")


def coarse_sales(x):
    """Day-grain sales on a coarse price tick, where equal natural keys are common."""
    return x.trades(wide=False).select(
        "id", "item_id", F.date_trunc("day", "sold_date").alias("sold_date"),
        F.expr("unit_price div 1000").alias("unit_price"), "qty", "reinforce")


view("coarse", """SELECT id, item_id, date_trunc('day', sold_date) AS sold_date, unit_price // 1000 AS unit_price,
  qty, reinforce FROM t5""")
view("coarse_seq", """SELECT *, row_number() OVER (PARTITION BY item_id, sold_date, unit_price, qty, reinforce ORDER BY id) - 1
  AS dup_seq FROM coarse""")
NATURAL = ["item_id", "sold_date", "unit_price", "qty", "reinforce"]


@query("dup_seq", "SELECT id, item_id, sold_date, unit_price, qty, dup_seq FROM coarse_seq")
def _(x):
    return op.dup_seq(coarse_sales(x), [], NATURAL, "id").select(
        "id", "item_id", "sold_date", "unit_price", "qty", "dup_seq")


@query("merge_sales", """WITH s AS (SELECT * FROM coarse_seq),
  kept AS (SELECT * FROM s WHERE sold_date < TIMESTAMP '2024-01-20'),
  incoming AS (SELECT * FROM s WHERE sold_date >= TIMESTAMP '2024-01-17')
  SELECT item_id, sold_date, unit_price, qty, dup_seq, min(id) AS id FROM incoming i
  WHERE NOT EXISTS (SELECT 1 FROM kept o WHERE o.item_id = i.item_id AND o.sold_date = i.sold_date
    AND o.unit_price = i.unit_price AND o.qty = i.qty AND o.reinforce = i.reinforce AND o.dup_seq = i.dup_seq)
  GROUP BY ALL""")
def _(x):
    s = op.dup_seq(coarse_sales(x), [], NATURAL, "id")
    day = F.col("sold_date")
    return op.merge_sales(s.filter(day < "2024-01-20"), s.filter(day >= "2024-01-17")).select(
        "item_id", "sold_date", "unit_price", "qty", "dup_seq", "id")


@query("tier_filter", """SELECT id, auction_no, item_id, upgrade FROM lr JOIN
  (SELECT item_id, max(upgrade_max) AS m FROM lr GROUP BY 1) USING (item_id) WHERE upgrade = 0 OR upgrade = m""")
def _(x):
    return op.tier_filter(x.listing_rows()).select("id", "auction_no", "item_id", "upgrade")


@query("tier_conflict_check", """SELECT item_id, min(m) AS low, max(m) AS high, count(DISTINCT m) AS tiers FROM
  (SELECT item_id, CASE WHEN cur_count >= 95 THEN upgrade_max + 1 ELSE upgrade_max END AS m FROM lr)
  WHERE m > 0 GROUP BY 1 HAVING count(DISTINCT m) > 1""")
def _(x):
    drifted = x.listing_rows().withColumn(
        "upgrade_max", F.when(F.col("cur_count") >= 95, F.col("upgrade_max") + 1).otherwise(F.col("upgrade_max")))
    return op.tier_conflict_check(drifted)


@query("listing_state", """SELECT auction_no, arg_max(item_id, (observed_at, id)) AS item_id,
  arg_max(unit_price, (observed_at, id)) AS unit_price, arg_max(cur_count, (observed_at, id)) AS cur_count,
  min(observed_at) AS first_seen_at, max(observed_at) AS last_seen_at FROM lr GROUP BY 1""")
def _(x):
    return op.listing_state(x.listing_rows()).drop("upgrade", "upgrade_max")


CAP = 10
view("lseen", """SELECT auction_no, item_id, category, batch, arg_max(unit_price, (observed_at, id)) AS unit_price,
  arg_max(cur_count, (observed_at, id)) AS cur_count, arg_max(expire_date, (observed_at, id)) AS expire_date,
  any_value(upgrade) AS upgrade, any_value(upgrade_max) AS upgrade_max FROM lr GROUP BY 1, 2, 3, 4""")
view("lpolls", f"""SELECT item_id, batch, CASE WHEN count(*) >= {CAP} THEN max(unit_price) END AS ceiling
  FROM lseen GROUP BY 1, 2""")
view("ljudged", """WITH n AS (SELECT *, lead(batch) OVER w AS next_batch, lead(cur_count) OVER w AS next_count,
    lead(unit_price) OVER w AS next_price FROM lseen WINDOW w AS (PARTITION BY auction_no ORDER BY batch))
  SELECT n.*, (SELECT min(p.batch) FROM lpolls p WHERE p.item_id = n.item_id AND p.batch > n.batch
      AND (n.next_batch IS NULL OR p.batch < n.next_batch)
      AND (p.batch >= n.expire_date OR p.ceiling IS NULL OR n.unit_price < p.ceiling)) AS closed_at FROM n""")
view("ldeltas", """SELECT auction_no, item_id, unit_price,
    CASE WHEN closed_at >= expire_date THEN 'expired' ELSE 'vanished_before_expiry' END AS reason,
    CASE WHEN closed_at >= expire_date THEN 0 ELSE cur_count END AS qty_sold, cur_count AS prev_count,
    CASE WHEN closed_at >= expire_date THEN cur_count ELSE 0 END AS new_count, closed_at AS observed_at
  FROM ljudged WHERE closed_at IS NOT NULL AND (closed_at >= expire_date OR cur_count > 0)
  UNION ALL SELECT auction_no, item_id, next_price, 'partial', cur_count - next_count, cur_count, next_count, next_batch
  FROM ljudged WHERE closed_at IS NULL AND next_count < cur_count""")


@query("listing_diff", "SELECT * FROM ldeltas")
def _(x):
    return op.listing_diff(x.listing_rows(), CAP)


@query("listing_close", """SELECT auction_no, item_id, cur_count, batch AS last_seen_at,
  CASE WHEN category = 'error' AND upgrade IS NULL
    THEN (SELECT min(p.batch) FROM lpolls p WHERE p.item_id = j.item_id AND p.batch > j.batch)
    ELSE closed_at END AS closed_at FROM ljudged j WHERE next_batch IS NULL""")
def _(x):
    return op.listing_close(x.listing_rows(), "error", CAP)


@query("items_upsert", """WITH o AS (SELECT item_id, category, tracked, 3600 AS p FROM it WHERE added_at < TIMESTAMP '2024-01-01 06:00:00'),
  n AS (SELECT item_id, upper(category) AS category, tracked, CASE WHEN sum(qty) > 1400 THEN 600 ELSE 7200 END AS p
    FROM it JOIN tr USING (item_id, category) GROUP BY ALL)
  SELECT item_id, coalesce(n.category, o.category) AS category, coalesce(n.tracked, o.tracked) AS tracked,
    least(o.p, n.p) AS poll_interval_sec FROM o FULL JOIN n USING (item_id)""")
def _(x):
    old = x.items().filter(F.col("added_at") < "2024-01-01 06:00:00").drop("added_at")
    new = (x.trades().groupBy("item_id", F.upper("category").alias("category")).agg(F.sum("qty").alias("q"))
           .select("item_id", "category", F.lit(True).alias("tracked"),
                   F.when(F.col("q") > 1400, 600).otherwise(7200).alias("poll_interval_sec")))
    return op.items_upsert(old, new)


@query("invalidate_vanished", """SELECT auction_no, observed_at, qty_sold,
  (SELECT min(s.batch) FROM lseen s WHERE s.auction_no = d.auction_no AND s.batch > d.observed_at) AS invalidated_at
  FROM ldeltas d WHERE reason = 'vanished_before_expiry'""")
def _(x):
    seen = op.sightings(x.listing_rows())
    return op.invalidate_vanished(op.listing_diff(seen, CAP), seen)


@query("book_snapshot", "SELECT * FROM sn")
def _(x):
    return x.snapshots()


@query("book_snapshot_busy", "SELECT * FROM sn5")
def _(x):
    return x.snapshots(wide=False)


SPAN = "(epoch_us(finished_at) - epoch_us(started_at)) / 1e6 / 60"


@query("run_quality", f"""SELECT item_id, started_at, sold_rows, listing_rows,
  CASE WHEN sold_rows > 1 THEN {r(SPAN)} END AS span_min, saturated,
  CASE WHEN error IS NOT NULL THEN 'failed' WHEN finished_at IS NULL THEN 'running' ELSE 'success' END AS status FROM ru""")
def _(x):
    return op.run_quality(x.runs())


@query("saturation", """SELECT item_id, started_at, sold_rows, previous_run,
  sold_rows >= 3 AND previous_run IS NOT NULL AND hour > previous_run AS saturated FROM
  (SELECT *, max(CASE WHEN error IS NULL THEN started_at END) OVER (PARTITION BY item_id ORDER BY started_at
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_run FROM ru)""")
def _(x):
    return op.saturation(x.runs().withColumn("oldest_sold", F.col("hour")), limit=3)


@query("poll_advice", f"""WITH q AS (SELECT *, CASE WHEN sold_rows > 1 THEN {SPAN} END AS s FROM ru),
  f AS (SELECT *, coalesce(saturated AND s > 0 AND s < 3600 / 60 * 1.5, false) AS too_fast FROM q)
  SELECT item_id, started_at, {r('s')} AS span_min, too_fast, CASE WHEN too_fast THEN 1800 ELSE 3600 END AS advised_sec,
  CASE WHEN s / sold_rows < 0.2 THEN 60 WHEN s / sold_rows < 0.5 THEN 120 WHEN s / sold_rows < 2 THEN 300
    WHEN s / sold_rows < 10 THEN 900 ELSE 3600 END AS pace_sec,
  CASE WHEN s IS NULL THEN NULL ELSE 3600 END AS span_sec FROM f""")
def _(x):
    return op.poll_advice(op.run_quality(x.runs()), x.items())


@query("scan_assemble", """WITH o AS (SELECT date_trunc('hour', sold_date) AS scan_id,
    CASE WHEN k < 5 THEN 'failed' WHEN k < 7 THEN 'pending' WHEN k < 20 THEN 'empty' ELSE 'observed' END AS status FROM tr)
  SELECT scan_id, count(*) AS entities, count(*) FILTER (status = 'observed') AS observed,
    count(*) FILTER (status = 'empty') AS empty, count(*) FILTER (status = 'failed') AS failed,
    count(*) FILTER (status = 'pending') AS pending,
    CASE WHEN count(*) FILTER (status = 'failed') = count(*) THEN 'failed'
      WHEN count(*) FILTER (status IN ('failed', 'pending')) > 0 THEN 'partial' ELSE 'complete' END AS run_status
  FROM o GROUP BY 1""")
def _(x):
    k = F.col("k")
    status = F.when(k < 5, "failed").when(k < 7, "pending").when(k < 20, "empty").otherwise("observed")
    return op.scan_assemble(x.trades().select(F.date_trunc("hour", "sold_date").alias("scan_id"), status.alias("status")))
