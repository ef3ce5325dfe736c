"""Health and quality queries."""
from pyspark.sql import functions as F

from tidebook.catalog.candles import NOW
from tidebook.catalog.market import marked_deltas
from tidebook.catalog.registry import query, r, view
from tidebook.operators import health as op
from tidebook.sources.bindings import AS_OF

AGE = f"(epoch_us({NOW}) - epoch_us(t)) / 1e6"


@query("staleness", f"""WITH l AS (SELECT item_id, max(finished_at) AS t FROM ru WHERE error IS NULL AND finished_at <= {NOW} GROUP BY 1)
  SELECT item_id, t AS last_success, {r(AGE + ' / 60')} AS gap_min, t IS NULL OR {AGE} > poll_interval_sec * 5 AS stale FROM it LEFT JOIN l USING (item_id)""")
def _(x):
    return op.staleness(x.items(), x.runs(), AS_OF)


@query("uptime_24h", f"""WITH c AS (SELECT * FROM chk WHERE checked_at <= {NOW}), d AS (SELECT * FROM c WHERE checked_at > {NOW} - INTERVAL 24 HOUR)
  SELECT count(*) AS checks24, {r('100.0 * count(*) FILTER (gap_min <= 20) / count(*)')} AS uptime24, count(stale_items) AS item_checks24,
    {r('100.0 * (1 - sum(stale_items) / (count(stale_items) * (SELECT count(*) FROM it)))')} AS item_uptime24,
    count(*) FILTER (stale_items > 0) AS stale_checks24, (SELECT CAST(stale_items AS BIGINT) FROM c ORDER BY checked_at DESC, id DESC LIMIT 1) AS latest_stale FROM d""")
def _(x):
    return op.uptime_24h(x.health_checks(), x.items(), AS_OF)


SLOT = "to_timestamp(floor(epoch_us(checked_at) / 300000000) * 300)::TIMESTAMP"
view("slots", f"""SELECT source, make_timestamp(CAST(floor(epoch_us(checked_at) / 300000000) AS BIGINT) * 300000000) AS slot, arg_max((checked_at, gap_min, stale_items), (checked_at, id)) AS v
  FROM chk WHERE checked_at <= {NOW} GROUP BY 1, 2""")
view("slotrows", "SELECT source, slot, v[1] AS checked_at, v[2] AS gap_min, v[3] AS stale_items FROM slots")


@query("health_unify", f"""WITH l AS (SELECT * FROM slotrows),
  e AS (SELECT DISTINCT s.slot, o.source FROM (SELECT DISTINCT slot FROM l) s JOIN epo o ON coalesce(o.valid_from < s.slot + INTERVAL 5 MINUTE, true) AND coalesce(o.valid_to > s.slot, true))
  SELECT e.slot, coalesce(max(checked_at), e.slot) AS checked_at, CASE WHEN count(gap_min) = count(*) THEN {r('max(gap_min)')} END AS gap_min,
    CASE WHEN count(stale_items) = count(*) THEN CAST(sum(stale_items) AS BIGINT) END AS stale_items
  FROM e LEFT JOIN l ON l.slot = e.slot AND l.source = e.source GROUP BY e.slot""")
def _(x):
    return op.health_unify(x.health_checks(), x.source_epochs(), AS_OF)


def _slot_checks(x):
    """One check per source and 5 minutes."""
    slot = F.timestamp_seconds(F.floor(F.unix_timestamp("checked_at") / 300) * 300)
    c = x.health_checks().groupBy("source", slot.alias("checked_at")).agg(F.max("gap_min").alias("gap_min"), F.max("stale_items").alias("stale_items"))
    return c.select("source", "checked_at", F.coalesce("gap_min", F.lit(0.0)).alias("gap_min"), F.coalesce("stale_items", F.lit(0)).alias("stale_items"))


view("sc", """SELECT source, make_timestamp(CAST(floor(epoch_us(checked_at) / 300000000) AS BIGINT) * 300000000) AS checked_at,
  coalesce(max(gap_min), 0) AS gap_min, CAST(coalesce(max(stale_items), 0) AS BIGINT) AS stale_items FROM chk GROUP BY 1, 2""")


HEALTH_ACTION_SQL = """WITH RECURSIVE n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY checked_at) AS i FROM sc),
  w AS (SELECT source, CAST(0 AS BIGINT) AS i, CAST(NULL AS TIMESTAMP) AS checked_at, CAST([] AS TIMESTAMP[]) AS rec, CAST(NULL AS TIMESTAMP) AS al, CAST(NULL AS VARCHAR) AS action,
      CAST(NULL AS DOUBLE) AS gap_min, CAST(NULL AS BIGINT) AS stale_items FROM (SELECT DISTINCT source FROM sc)
    UNION ALL SELECT source, i, checked_at, CASE WHEN ok OR cooling THEN rec ELSE list_append(rec, checked_at) END,
      CASE WHEN NOT ok AND len(rec) >= 2 AND NOT quiet THEN checked_at ELSE al END,
      CASE WHEN ok THEN 'ok' WHEN len(rec) >= 2 THEN CASE WHEN quiet THEN 'alert_cooldown' ELSE 'alert' END WHEN cooling THEN 'recover_cooldown' ELSE 'recover' END, gap_min, stale_items
    FROM (SELECT n.source, n.i, n.checked_at, n.gap_min, n.stale_items, w.al, n.gap_min <= 20 AND n.stale_items = 0 AS ok,
        list_filter(w.rec, lambda m: m > n.checked_at - INTERVAL 40 MINUTE) AS rec,
        len(list_filter(w.rec, lambda m: m > n.checked_at - INTERVAL 10 MINUTE)) > 0 AS cooling,
        coalesce(w.al > n.checked_at - INTERVAL 6 HOUR, false) AS quiet
      FROM w JOIN n ON n.source = w.source AND n.i = w.i + 1))
  SELECT source, checked_at, """ + r("gap_min") + """ AS gap_min, stale_items, action FROM w WHERE i > 0"""


@query("health_action", HEALTH_ACTION_SQL)
def _(x):
    return op.health_action(_slot_checks(x))


@query("candle_health_action", """WITH RECURSIVE c AS (SELECT source, checked_at, CASE WHEN gap_min < 48 THEN gap_min * 3 END AS gap_min FROM sc),
  n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY checked_at) AS i FROM c),
  w AS (SELECT source, CAST(0 AS BIGINT) AS i, CAST(NULL AS TIMESTAMP) AS checked_at, CAST(NULL AS TIMESTAMP) AS al, CAST(NULL AS VARCHAR) AS action, CAST(NULL AS DOUBLE) AS gap_min FROM (SELECT DISTINCT source FROM sc)
    UNION ALL SELECT source, i, checked_at, CASE WHEN fire THEN checked_at ELSE al END, CASE WHEN fire THEN 'alert' WHEN st THEN 'stale' ELSE 'ok' END, gap_min
    FROM (SELECT n.*, w.al, n.gap_min IS NULL OR n.gap_min > 90 AS st,
      (n.gap_min IS NULL OR n.gap_min > 90) AND coalesce(w.al <= n.checked_at - INTERVAL 6 HOUR, true) AS fire FROM w JOIN n ON n.source = w.source AND n.i = w.i + 1))
  SELECT source, checked_at, """ + r("gap_min") + """ AS gap_min, action FROM w WHERE i > 0""")
def _(x):
    c = _slot_checks(x).select("source", "checked_at", F.when(F.col("gap_min") < 48, F.col("gap_min") * 3).alias("gap_min"))
    return op.candle_health_action(c)


@query("collection_stats", f"""WITH g AS (SELECT item_id, count(*) AS n, (epoch_us(max(sold_date)) - epoch_us(min(sold_date))) / 1e6 / 60 AS s, max(epoch_us(sold_date) - epoch_us(prev)) / 1e6 / 60 AS m FROM
    (SELECT *, lag(sold_date) OVER (PARTITION BY item_id ORDER BY sold_date) AS prev FROM tr) GROUP BY 1),
  q AS (SELECT item_id, sum(qty_sold) AS q FROM linv WHERE reason <> 'expired' AND invalidated_at IS NULL GROUP BY 1),
  s AS (SELECT item_id, count(*) FILTER (saturated) AS sat FROM ru GROUP BY 1)
  SELECT item_id, poll_interval_sec, n, {r('g.s')} AS span_min, {r('m')} AS max_gap_min, CAST(coalesce(q, 0) AS BIGINT) AS depletion_qty, coalesce(sat, 0) AS saturated_runs
  FROM it LEFT JOIN g USING (item_id) LEFT JOIN q USING (item_id) LEFT JOIN s USING (item_id)""")
def _(x):
    return op.collection_stats(x.items(), x.trades(), marked_deltas(x), x.runs())


@query("quality_7d", f"""SELECT item_id, count(*) AS attempts, count(*) FILTER (error IS NULL) AS succeeded, count(error) AS failed, count(*) FILTER (saturated) AS saturated,
  min(started_at) AS first_record, max(started_at) AS last_record FROM ru WHERE started_at >= {NOW} - INTERVAL 7 DAY AND started_at < {NOW} GROUP BY 1""")
def _(x):
    return op.quality_7d(x.runs(), AS_OF)


@query("quality_join", """WITH q AS (SELECT item_id, hour, bool_and(error IS NULL AND hour(hour) % 6 <> 5) AS known, bool_or(saturated OR listing_rows >= 12) AS capped, bool_or(sold_rows >= 2) AS full_ FROM ru GROUP BY 1, 2),
  s AS (SELECT item_id, unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour FROM c1 GROUP BY 1)
  SELECT s.item_id, s.hour, coalesce(known, false) AS known, coalesce(known AND NOT capped, false) AS overlap, coalesce(known AND NOT capped AND NOT full_, false) AS clean
  FROM s LEFT JOIN q ON q.item_id = s.item_id AND q.hour = s.hour""")
def _(x):
    span = x.candles().groupBy("item_id").agg(F.min("hour").alias("a"), F.max("hour").alias("z"))
    series = span.select("item_id", F.explode(F.sequence("a", "z", F.expr("INTERVAL 1 HOUR"))).alias("hour"))
    running = F.hour("hour") % 6 == 5                # polls that have not ended
    runs = x.runs().withColumn("finished_at", F.when(~running, F.col("finished_at")))
    return op.quality_join(series, runs, full_sold=2, full_listing=12)
