"""Streaming queries, run over the given files and compared with the batch result of the same files."""
from pyspark.sql import functions as F

from tidebook.catalog.candles import G
from tidebook.catalog.health import HEALTH_ACTION_SQL
from tidebook.catalog.ingest import CAP, coarse_sales
from tidebook.catalog.registry import query, r, view
from tidebook.operators import ingest
from tidebook.session import reuse
from tidebook.sources.bindings import Inputs
from tidebook.streaming import jobs
from tidebook.streaming.run import newest_update, run_available, run_parts

view("streammark", "SELECT time_bucket(INTERVAL 1 MILLISECOND, max(sold_date)) - INTERVAL 2 HOUR AS wm FROM ev")
BARS = """arg_min(unit_price, (sold_date, id)) AS o, max(unit_price) AS h, min(unit_price) AS l, arg_max(unit_price, (sold_date, id)) AS c,
  {g} AS gold, CAST(sum(qty) AS BIGINT) AS qty, count(*) AS n""".format(g=r("sum(unit_price * qty)"))


def in_parts(df, column: str):
    """The rows before the 11th, until the 21st and after, as they would arrive."""
    at = F.col(column)
    return [df.filter(at < "2024-01-11"), df.filter((at >= "2024-01-11") & (at < "2024-01-21")), df.filter(at >= "2024-01-21")]


# Every day is polled on each of the two days after it; a poll stands behind the watermark two days later.
@query("stream_sales", """SELECT item_id, sold_date, unit_price, qty, reinforce, dup_seq, id FROM coarse_seq
  WHERE sold_date + INTERVAL 1 DAY <= (SELECT max(sold_date) FROM coarse)""")
def _(x):
    s = coarse_sales(x)
    polled = s.withColumn("polled_at", F.explode(F.array(*[F.col("sold_date") + F.make_dt_interval(days=F.lit(d)) for d in (1, 2)])))
    found = run_parts(in_parts(polled, "polled_at"), lambda rows: jobs.stream_sales(rows, "2 days", response="polled_at"))
    return found.select("item_id", "sold_date", "unit_price", "qty", "reinforce", "dup_seq", "id")


@query("stream_candles", f"SELECT item_id, date_trunc('hour', sold_date) AS start, {BARS} FROM tr GROUP BY 1, 2")
def _(x):
    return newest_update(run_available(jobs.stream_candles(x.stream_trades()), "update"), ["item_id", "start"])


@query("stream_watermark", "SELECT date_trunc('hour', sold_date) AS start, count(*) FILTER (id > (SELECT raw_max_id FROM st)) AS pending, count(*) AS n FROM tr GROUP BY 1")
def _(x):
    bound = x.spark.range(1).select(x.raw_max_id().alias("m")).first()["m"]
    return newest_update(run_available(jobs.stream_watermark(x.stream_trades(), bound), "update"), ["start"])


@query("stream_rolling_24h", f"""WITH b AS (SELECT item_id, date_trunc('hour', sold_date) AS hour, sum(unit_price * qty) AS gold, sum(qty) AS qty, count(*) AS n FROM tr GROUP BY 1, 2),
  w AS (SELECT item_id, hour + to_hours(CAST(i AS INTEGER)) AS as_of, gold, qty, n FROM b, range(1, 25) q(i))
  SELECT item_id, as_of, {r('CAST(sum(gold) AS DOUBLE) / CAST(sum(qty) AS DOUBLE)')} AS vwap24, CAST(sum(qty) AS BIGINT) AS qty, CAST(sum(n) AS BIGINT) AS n FROM w, streammark WHERE as_of <= wm GROUP BY 1, 2""")
def _(x):
    return run_available(jobs.stream_rolling_24h(x.stream_trades())).drop("batch")


@query("stream_game_day", f"SELECT item_id, CAST(CAST(sold_date + INTERVAL 3 HOUR AS DATE) AS TIMESTAMP) - INTERVAL 3 HOUR AS start, {BARS} FROM tr, streammark WHERE CAST(CAST(sold_date + INTERVAL 3 HOUR AS DATE) AS TIMESTAMP) + INTERVAL 21 HOUR <= wm GROUP BY 1, 2")
def _(x):
    return run_available(jobs.stream_game_day(x.stream_trades())).drop("batch")


@query("stream_activity_session", """WITH g AS (SELECT item_id, sold_date, CASE WHEN date_trunc('hour', sold_date) - lag(date_trunc('hour', sold_date)) OVER (PARTITION BY item_id ORDER BY sold_date) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS s FROM t5),
  i AS (SELECT *, sum(s) OVER (PARTITION BY item_id ORDER BY sold_date) AS k FROM g), a AS (SELECT item_id, k, min(sold_date) AS first_sale, max(sold_date) AS last_sale, count(*) AS n FROM i GROUP BY 1, 2)
  SELECT item_id, first_sale, last_sale, n FROM a, streammark WHERE date_trunc('hour', last_sale) + INTERVAL 90 MINUTE <= date_trunc('hour', wm)""")
def _(x):
    return run_available(jobs.stream_activity_session(x.stream_trades(wide=False))).drop("batch")


# A poll is settled once the watermark, a day behind, has reached it.
@query("stream_listing_state", """SELECT auction_no, item_id, unit_price, reason, qty_sold, prev_count, new_count, observed_at FROM ldeltas
  WHERE observed_at <= (SELECT max(batch) FROM lseen) - INTERVAL 1 DAY""")
def _(x):
    polls = reuse(jobs.poll_rows(ingest.sightings(x.listing_rows()), cap=CAP))
    return run_parts(in_parts(polls, "batch"), jobs.stream_listing_state).drop("batch")


def _listing_stream(x: Inputs):
    day = F.date_trunc("day", "sold_date")
    return x.stream_trades().select(
        F.concat_ws(":", "category", F.col("user_id").cast("string")).alias("auction_no"), "id", F.col("sold_date").alias("observed_at"),
        F.col("k").cast("bigint").alias("cur_count"), (day + F.make_dt_interval(days=1 + F.col("k") % 5)).alias("expire_date"))


@query("stream_listing_partial", """SELECT auction_no, CAST(p - cur_count AS BIGINT) AS qty_sold, CAST(p AS BIGINT) AS prev_count, CAST(cur_count AS BIGINT) AS new_count, observed_at FROM
  (SELECT *, lag(cur_count) OVER (PARTITION BY auction_no ORDER BY observed_at, id) AS p FROM lr) WHERE cur_count < p""")
def _(x):
    e = run_available(jobs.stream_listing_silence(_listing_stream(x)))
    return e.filter("reason = 'partial'").select("auction_no", "qty_sold", "prev_count", "new_count", "observed_at")


@query("stream_health", f"""SELECT * FROM ({HEALTH_ACTION_SQL}) WHERE checked_at + INTERVAL 5 MINUTE <= (SELECT wm FROM streammark)""")
def _(x):
    """Equal to the batch walk over slots, as far as the watermark got."""
    checks = x.health_checks().select("source", "checked_at", "gap_min", "stale_items")
    return run_parts(in_parts(checks, "checked_at"), jobs.stream_health).drop("batch")
