"""Archive and retention queries."""
from pyspark.sql import functions as F

from tidebook.catalog.candles import NOW
from tidebook.catalog.ingest import CAP
from tidebook.catalog.registry import query, r, view
from tidebook.operators import archive as op, ingest
from tidebook.sources.bindings import AS_OF

COLS = ["id", "item_id", "sold_date", "unit_price", "qty"]


def text(*cols):
    return "concat_ws(chr(31), " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '\\N')" for c in cols) + ")"


TR = text("id", "item_id", "epoch_us(sold_date)", "unit_price", "qty")


def signature_sql(source, bucket, row):
    words = ", ',', ".join(f"CAST(sum(CAST('0x' || substr(d, {1 + 8 * i}, 8) AS BIGINT)) AS BIGINT)" for i in range(8))
    return f"""SELECT bucket, count(*) AS rows, CAST(sum(b) AS BIGINT) AS bytes, sha256(concat({words})) AS hash FROM
      (SELECT {bucket} AS bucket, strlen({row}) AS b, sha256({row}) AS d FROM {source}) GROUP BY 1"""


DAY, HOUR = "strftime(sold_date, '%Y-%m-%d')", "strftime(sold_date, '%Y-%m-%d/%H')"
view("sigd", signature_sql("tr", DAY, TR))
view("sigold", signature_sql("(SELECT * REPLACE (CASE WHEN day(sold_date) % 5 = 0 AND k = 42 THEN qty + 1 ELSE qty END AS qty) FROM tr WHERE sold_date < TIMESTAMP '2024-01-29')", DAY, TR))


def day(c="sold_date"):
    return F.date_format(c, "yyyy-MM-dd")


@query("bucket_signature", "SELECT * FROM sigd")
def _(x):
    return op.bucket_signature(x.trades(), day(), COLS)


@query("bucket_signature_hourly", signature_sql("tr", HOUR, TR))
def _(x):
    return op.bucket_signature(x.trades(), F.date_format("sold_date", "yyyy-MM-dd/HH"), COLS)


def _older(x):
    """The same rows as last copied: some changed since, the last two days not copied yet."""
    drift = (F.dayofmonth("sold_date") % 5 == 0) & (F.col("k") == 42)
    return x.trades().filter("sold_date < '2024-01-29'").withColumn("qty", F.when(drift, F.col("qty") + 1).otherwise(F.col("qty")))


@query("changed_buckets", "SELECT s.*, CASE WHEN s.hash IS NOT DISTINCT FROM o.hash THEN 'reuse' ELSE 'fetch' END AS action FROM sigd s LEFT JOIN sigold o USING (bucket)")
def _(x):
    return op.changed_buckets(op.bucket_signature(x.trades(), day(), COLS), op.bucket_signature(_older(x), day(), COLS))


@query("archive_merge", """SELECT id, item_id, sold_date, unit_price, qty FROM tr WHERE sold_date >= TIMESTAMP '2024-01-15'
  UNION ALL SELECT id, item_id, sold_date, unit_price, CASE WHEN day(sold_date) % 5 = 0 AND k = 42 THEN qty + 1 ELSE qty END FROM tr WHERE sold_date < TIMESTAMP '2024-01-15'""")
def _(x):
    return op.archive_merge(_older(x).select(*COLS), x.trades().filter("sold_date >= '2024-01-15'").select(*COLS), ["id"])


@query("archive_continuity", """WITH m AS (SELECT item_id, sold_date AS created_at, lag(sold_date) OVER (PARTITION BY item_id ORDER BY sold_date) AS p FROM tr),
  g AS (SELECT *, max(CASE WHEN created_at - p > INTERVAL 6 DAY THEN 1 ELSE 0 END) OVER (PARTITION BY item_id ORDER BY created_at) AS s FROM m)
  SELECT item_id, created_at, CASE WHEN p IS NULL THEN 'initial' WHEN s = 1 THEN 'gap' ELSE 'ok' END AS continuity FROM g""")
def _(x):
    m = x.trades().select("item_id", F.col("sold_date").alias("created_at"))
    return op.archive_continuity(m, "item_id")


@query("archive_select", """SELECT id, item_id, sold_date FROM tr WHERE item_id IN ('click-0', 'view-3', 'error-1') AND sold_date >= TIMESTAMP '2024-01-08 06:00:00' AND sold_date < TIMESTAMP '2024-01-21'""")
def _(x):
    t = x.trades().withColumn("day", F.to_date("sold_date"))
    return op.archive_select(t, "2024-01-08 06:00:00", "2024-01-21 00:00:00", ["click-0", "view-3", "error-1"], "sold_date", partition="day").select("id", "item_id", "sold_date")


view("lfin", "SELECT auction_no, item_id, unit_price, cur_count, expire_date, upgrade_max, batch AS last_seen_at, closed_at FROM ljudged WHERE next_batch IS NULL")
LCOLS = ["auction_no", "item_id", "unit_price", "cur_count", "expire_date", "upgrade_max", "last_seen_at", "closed_at"]


def _final(x):
    return (ingest.judged(ingest.sightings(x.listing_rows()), CAP).filter("next_no IS NULL")
            .select("auction_no", "item_id", "unit_price", "cur_count", "expire_date", "upgrade_max", F.col("batch").alias("last_seen_at"), "closed_at"))


@query("archive_select_listings", """SELECT auction_no, item_id, last_seen_at FROM lfin WHERE coalesce(closed_at, expire_date) >= TIMESTAMP '2024-01-20' AND last_seen_at < TIMESTAMP '2024-01-28'""")
def _(x):
    return op.archive_select(_final(x), "2024-01-20 00:00:00", "2024-01-28 00:00:00", None, "last_seen_at", F.coalesce("closed_at", "expire_date")) \
        .select("auction_no", "item_id", "last_seen_at")


@query("archive_verify", """WITH c AS (SELECT * FROM tr WHERE NOT (day(sold_date) = 9 AND k = 13) UNION ALL SELECT * FROM tr WHERE day(sold_date) = 20 AND k = 14),
  a AS (SELECT strftime(sold_date, '%Y-%m-%d') AS bucket, count(*) AS n FROM tr GROUP BY 1),
  b AS (SELECT strftime(sold_date, '%Y-%m-%d') AS bucket, count(*) AS n, count(*) - count(DISTINCT id) AS rep FROM c GROUP BY 1)
  SELECT bucket, a.n AS source_rows, coalesce(b.n, 0) AS copy_rows, coalesce(rep, 0) AS repeated, a.n = b.n AS equal FROM a LEFT JOIN b USING (bucket)""")
def _(x):
    t = x.trades()
    copy = t.filter("NOT (dayofmonth(sold_date) = 9 AND k = 13)").unionByName(t.filter("dayofmonth(sold_date) = 20 AND k = 14"))
    return op.archive_verify(t, copy, day(), ["id"], COLS)


@query("schema_upgrade", """SELECT id, item_id, CAST(NULL AS INTEGER) AS extra FROM tr WHERE sold_date < TIMESTAMP '2024-01-10' UNION ALL SELECT id, item_id, k FROM tr WHERE sold_date >= TIMESTAMP '2024-01-10'""")
def _(x):
    t = x.trades()
    return op.schema_upgrade(t.filter("sold_date < '2024-01-10'").select("id", "item_id"),
                             t.filter("sold_date >= '2024-01-10'").select("id", "item_id", F.col("k").alias("extra")))


@query("rebucket_hourly", "SELECT strftime(sold_date, '%Y-%m-%d') AS day, CAST(hour(sold_date) AS INTEGER) AS hour, count(*) AS rows FROM tr GROUP BY 1, 2")
def _(x):
    return op.rebucket_hourly(x.trades(), "sold_date").groupBy("day", "hour").agg(F.count(F.lit(1)).alias("rows"))


@query("prune_proven", f"""WITH keep AS (SELECT arg_max(auction_no, (upgrade_max, last_seen_at, auction_no)) AS auction_no FROM lfin WHERE upgrade_max IS NOT NULL GROUP BY item_id)
  SELECT auction_no, item_id, cur_count, closed_at FROM lfin l WHERE NOT (coalesce(closed_at < {NOW} - INTERVAL 7 DAY AND expire_date < {NOW} - INTERVAL 7 DAY, false)
    AND cur_count % 10 <> 0 AND auction_no NOT IN (SELECT auction_no FROM keep))""")
def _(x):
    t = _final(x)
    held = t.withColumn("cur_count", F.when(F.col("cur_count") % 10 == 0, F.col("cur_count") + 1).otherwise(F.col("cur_count")))
    proofs = held.select("auction_no", op.row_digest(held, LCOLS).alias("digest"))
    old = F.lit(AS_OF).cast("timestamp") - F.expr("INTERVAL 7 DAYS")
    return op.prune_proven(t, proofs, ["auction_no"], LCOLS, (F.col("closed_at") < old) & (F.col("expire_date") < old), op.tier_keepers(t)) \
        .select("auction_no", "item_id", "cur_count", "closed_at")


@query("age_retention", f"SELECT id, source, checked_at FROM chk WHERE checked_at >= {NOW} - INTERVAL 14 DAY")
def _(x):
    return op.age_retention(x.health_checks(), "checked_at", AS_OF, 14).select("id", "source", "checked_at")
