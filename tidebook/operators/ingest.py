"""From landed responses to sales, listings and their state."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidebook.functions.timeutil import KST, seconds_between
from tidebook.plans.quantiles import exact_quantiles
from tidebook.plans.split import first_keys, newest, numbered, oldest, rows_of
from tidebook.session import reuse

SALE_KEY = ["item_id", "sold_date", "unit_price", "qty", "reinforce", "dup_seq"]
LISTING_CAP = 400


def parse_local(text: str | Column, tz: str = KST, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Local wall-clock text to a UTC instant; unparsable text gives NULL."""
    text = F.col(text) if isinstance(text, str) else text
    return F.to_utc_timestamp(F.try_to_timestamp(text, F.lit(fmt)), tz)


def ingest_sales(landed: DataFrame, tz: str = KST) -> DataFrame:
    """Typed sales; rows whose time cannot be read are left out."""
    return (landed.withColumn("sold_date", parse_local("sold_text", tz)).drop("sold_text")
            .filter(F.col("sold_date").isNotNull()))


def ingest_listings(landed: DataFrame) -> DataFrame:
    """Single-unit listings carry no registered count: the current count stands in."""
    return landed.withColumn("reg_count", F.coalesce("reg_count", "cur_count"))


def dup_seq(sales: DataFrame, batch: Sequence[str], key: Sequence[str], position: str,
            chunk_rows: int = 65536) -> DataFrame:
    """Zero-based ordinal of identical natural keys inside one response, in response order.

    Copies of one key are numbered per slice of positions, so a key repeated without end stays splittable.
    """
    sliced = sales.withColumn("_slice", F.floor(F.col(position) / chunk_rows))
    out = numbered(sliced, [*batch, *key], "_slice", [position], "_seq")
    return out.withColumn("dup_seq", (F.col("_seq") - 1).cast("bigint")).drop("_seq", "_slice")


def merge_sales(existing: DataFrame, incoming: DataFrame, key: Sequence[str] = SALE_KEY,
                prefer: Sequence[str] = ("id",)) -> DataFrame:
    """Rows of `incoming` to append: not stored yet, one per natural key."""
    fresh = incoming.join(existing.select(*key), list(key), "left_anti")
    return oldest(fresh, key, prefer).select(*incoming.columns)


def tier_filter(listings: DataFrame) -> DataFrame:
    """Keep tier 0 and the highest tier known for the item."""
    known = listings.groupBy("item_id").agg(F.max("upgrade_max").alias("known_max"))
    return (listings.join(known, "item_id", "inner")
            .filter((F.col("upgrade") == 0) | (F.col("upgrade") == F.col("known_max"))).drop("known_max"))


def tier_conflict_check(listings: DataFrame) -> DataFrame:
    """Items that report more than one highest tier."""
    return (listings.filter(F.col("upgrade_max") > 0).groupBy("item_id")
            .agg(F.min("upgrade_max").alias("low"), F.max("upgrade_max").alias("high"),
                 F.count_distinct("upgrade_max").alias("tiers"))
            .filter("tiers > 1"))


def listing_state(rows: DataFrame) -> DataFrame:
    """Latest state per listing with first and last sighting: the newest row is found by its order, then fetched."""
    order = ["observed_at", "id"]
    last = first_keys(rows, ["auction_no"], order, F.max, first_seen_at=F.min("observed_at"), last_seen_at=F.max("observed_at"))
    state = ["auction_no", "item_id", "unit_price", "cur_count", "upgrade", "upgrade_max"]
    return rows_of(rows.select(*state, *order), ["auction_no"], order, last, repeated=True).select(*state, "first_seen_at", "last_seen_at")


def sightings(rows: DataFrame) -> DataFrame:
    """One row per listing and poll: the last observation inside the poll."""
    return reuse(newest(rows, ["auction_no", "item_id", "category", "batch"], ["observed_at", "id"],
                        ["unit_price", "cur_count", "expire_date", "upgrade", "upgrade_max"]))


def _seen(rows: DataFrame) -> DataFrame:
    """Sightings of observed rows; sightings stay as they are."""
    return sightings(rows) if "observed_at" in rows.columns else rows


def polls(seen: DataFrame, cap: int = LISTING_CAP) -> DataFrame:
    """Polls of an item in order; a capped poll proves nothing at or above its highest price."""
    order = Window.partitionBy("item_id").orderBy("batch")       # one row per poll: bounded by the calendar
    return (seen.groupBy("item_id", "batch")
            .agg(F.count(F.lit(1)).alias("rows"), F.max("unit_price").alias("_top"))
            .withColumn("poll_no", F.row_number().over(order))
            .withColumn("ceiling", F.when(F.col("rows") >= cap, F.col("_top")))
            .withColumn("next_open", F.min(F.when(F.col("ceiling").isNull(), F.col("poll_no"))).over(
                order.rowsBetween(1, Window.unboundedFollowing)))
            .withColumn("last_poll", F.max("poll_no").over(Window.partitionBy("item_id")))
            .drop("_top"))


def _expiry_polls(seen_polls: DataFrame) -> DataFrame:
    """Per item and hour of its time span: the polls inside (`inside`) and the first poll after it (`after_no`)."""
    inside = (seen_polls.groupBy("item_id", F.date_trunc("hour", "batch").alias("expiry_hour"))
              .agg(F.array_sort(F.collect_list(F.struct("batch", "poll_no"))).alias("inside")))   # the polls of one hour
    span = inside.groupBy("item_id").agg(F.min("expiry_hour").alias("a"), F.max("expiry_hour").alias("b"))
    spine = span.select("item_id", F.explode(F.expr("sequence(a, b, INTERVAL 1 HOUR)")).alias("expiry_hour"))
    later = Window.partitionBy("item_id").orderBy("expiry_hour").rowsBetween(1, Window.unboundedFollowing)   # one row per hour
    return (spine.join(inside, ["item_id", "expiry_hour"], "left")
            .withColumn("after_no", F.min(F.element_at("inside", 1)["poll_no"]).over(later)))


def absences(s: DataFrame, p: DataFrame) -> DataFrame:
    """A row for each sighting and each later poll (later_no) that may settle its absence.

    That stretch ends with the next uncapped poll, the poll before the next sighting, or the first poll at or after
    the expiry, whichever comes first. The last one is looked up by the hour of the expiry.
    """
    last = F.least(F.coalesce("next_open", "last_poll"), F.coalesce(F.col("next_no") - 1, F.col("last_poll")))
    gap = (s.withColumn("_last", last).filter(F.col("poll_no") + 1 <= F.col("_last"))
           .select("auction_no", "item_id", "batch", "poll_no", "unit_price", "expire_date", "_last",
                   F.date_trunc("hour", "expire_date").alias("expiry_hour"))
           .join(_expiry_polls(p), ["item_id", "expiry_hour"], "left"))
    due = F.filter("inside", lambda x: x["batch"] >= F.col("expire_date"))
    expiry = F.when(F.col("expire_date") <= F.col("batch"), F.col("poll_no") + 1).otherwise(
        F.coalesce(F.get(due, F.lit(0))["poll_no"], "after_no"))
    return (gap.withColumn("_last", F.least("_last", expiry))
            .select("auction_no", "item_id", "batch", "unit_price", "expire_date",
                    F.explode(F.sequence(F.col("poll_no") + 1, F.col("_last"))).alias("later_no")))


def judged(seen: DataFrame, cap: int = LISTING_CAP) -> DataFrame:
    """Each of the `sightings` with the first later poll that settles its absence (closed_at), if any.

    A sighting meets the few polls of `absences` by an equi join on (item, poll number). Rows as observed, of which a poll
    may hold several for a listing, are refused.
    """
    if "observed_at" in seen.columns:
        raise ValueError("judged takes sightings, one row for each listing and poll")
    p = polls(seen, cap)
    of_listing = Window.partitionBy("auction_no").orderBy("poll_no")   # at most one row per poll
    s = (seen.join(p.select("item_id", "batch", "poll_no", "next_open", "last_poll"), ["item_id", "batch"])
         .withColumn("next_no", F.lead("poll_no").over(of_listing))
         .withColumn("next_batch", F.lead("batch").over(of_listing))
         .withColumn("next_count", F.lead("cur_count").over(of_listing))
         .withColumn("next_price", F.lead("unit_price").over(of_listing)))
    later = p.select("item_id", F.col("poll_no").alias("later_no"), F.col("batch").alias("later"), "ceiling")
    settled = (absences(s, p).join(later, ["item_id", "later_no"])
               .filter((F.col("later") >= F.col("expire_date")) | F.col("ceiling").isNull()
                       | (F.col("unit_price") < F.col("ceiling")))
               .groupBy("auction_no", "batch").agg(F.min("later").alias("closed_at")))
    return reuse(s.join(settled, ["auction_no", "batch"], "left"))


def listing_diff(rows: DataFrame, cap: int = LISTING_CAP) -> DataFrame:
    """Depletion events: a falling count, a listing gone before expiry, an expired listing. `rows` are observations or their
    `sightings`."""
    j = judged(_seen(rows), cap)
    expired = F.col("closed_at") >= F.col("expire_date")
    gone = j.filter(F.col("closed_at").isNotNull() & (expired | (F.col("cur_count") > 0))).select(
        "auction_no", "item_id", "unit_price",
        F.when(expired, F.lit("expired")).otherwise("vanished_before_expiry").alias("reason"),
        F.when(expired, 0).otherwise(F.col("cur_count")).alias("qty_sold"),
        F.col("cur_count").alias("prev_count"),
        F.when(expired, F.col("cur_count")).otherwise(0).alias("new_count"),
        F.col("closed_at").alias("observed_at"))
    fallen = j.filter(F.col("closed_at").isNull() & (F.col("next_count") < F.col("cur_count"))).select(
        "auction_no", "item_id", F.col("next_price").alias("unit_price"), F.lit("partial").alias("reason"),
        (F.col("cur_count") - F.col("next_count")).alias("qty_sold"), F.col("cur_count").alias("prev_count"),
        F.col("next_count").alias("new_count"), F.col("next_batch").alias("observed_at"))
    return gone.unionByName(fallen)


def listing_close(rows: DataFrame, tiered: str, cap: int = LISTING_CAP) -> DataFrame:
    """Final open or closed state per listing; untiered rows of the tiered category close at the next poll."""
    seen = sightings(rows)
    j = judged(seen, cap)
    final = j.filter(F.col("next_no").isNull())
    following = polls(seen, cap).select(
        "item_id", (F.col("poll_no") - 1).alias("poll_no"), F.col("batch").alias("next_poll"))
    final = final.join(following, ["item_id", "poll_no"], "left")
    legacy = (F.col("category") == tiered) & F.col("upgrade").isNull()
    return final.select("auction_no", "item_id", "cur_count", F.col("batch").alias("last_seen_at"),
                        F.when(legacy, F.col("next_poll")).otherwise(F.col("closed_at")).alias("closed_at"))


def items_upsert(items: DataFrame, incoming: DataFrame) -> DataFrame:
    """New metadata wins; the poll period only ever shortens."""
    return (items.alias("o").join(incoming.alias("n"), "item_id", "full_outer")
            .select("item_id", F.coalesce("n.category", "o.category").alias("category"),
                    F.coalesce("n.tracked", "o.tracked").alias("tracked"),
                    F.least("o.poll_interval_sec", "n.poll_interval_sec").alias("poll_interval_sec")))


def invalidate_vanished(deltas: DataFrame, rows: DataFrame) -> DataFrame:
    """A listing seen again after it was judged gone refutes that judgement, from the first later sighting.

    Sightings and judgements of one listing are both at most one per poll, so the lookup is a window over
    their union instead of a range join. `rows` are observations or their `sightings`.
    """
    gone = (deltas.filter("reason = 'vanished_before_expiry'")
            .select("auction_no", F.col("observed_at").alias("t"), "qty_sold", F.lit(1).alias("judged")))
    back = _seen(rows).select("auction_no", F.col("batch").alias("t"), F.lit(None).cast("int").alias("qty_sold"),
                                  F.lit(0).alias("judged"))
    later = Window.partitionBy("auction_no").orderBy(F.col("t"), F.col("judged")).rowsBetween(1, Window.unboundedFollowing)
    return (gone.unionByName(back)
            .withColumn("invalidated_at", F.min(F.when(F.col("judged") == 0, F.col("t"))).over(later))
            .filter("judged = 1")
            .select("auction_no", F.col("t").alias("observed_at"), "qty_sold", "invalidated_at"))


def book_snapshot(book: DataFrame) -> DataFrame:
    """Per item, tier and poll: lowest price, floor-index quantiles, listings and quantity on offer."""
    keys = ["item_id", "category", "batch", "upgrade", "upgrade_max"]
    return exact_quantiles(
        book, keys, "unit_price",
        [("p10", "floor", 0.1), ("p25", "floor", 0.25), ("median", "floor", 0.5)],
        carry={"_id": F.max("id"), "_seen": F.max("seen_at"), "_q": F.sum("qty")},
        extra=[F.max("_id").alias("id"), F.max("_seen").alias("captured_at"),
               F.min("unit_price").alias("min_unit_price"), F.sum("_w").alias("listing_count"),
               F.sum("_q").cast("bigint").alias("total_qty")],
    ).drop("batch")


def run_quality(runs: DataFrame) -> DataFrame:
    """One line per poll with its outcome."""
    status = (F.when(F.col("error").isNotNull(), "failed")
              .when(F.col("finished_at").isNull(), "running").otherwise("success"))
    span = seconds_between(F.col("finished_at"), F.col("started_at")) / 60
    return runs.select("item_id", "started_at", "sold_rows", "listing_rows",
                       F.when(F.col("sold_rows") > 1, span).alias("span_min"), "saturated", status.alias("status"))


def saturation(runs: DataFrame, limit: int) -> DataFrame:
    """A full response whose oldest row is newer than the previous successful poll may hide sales."""
    past = Window.partitionBy("item_id").orderBy("started_at").rowsBetween(Window.unboundedPreceding, -1)
    previous = F.max(F.when(F.col("error").isNull() & F.col("finished_at").isNotNull(), F.col("started_at"))).over(past)
    return (runs.withColumn("previous_run", previous)
            .withColumn("saturated", (F.col("sold_rows") >= limit) & F.col("previous_run").isNotNull()
                        & (F.col("oldest_sold") > F.col("previous_run")))
            .select("item_id", "started_at", "sold_rows", "previous_run", "saturated"))


# Poll steps in seconds; (upper bound of minutes per trade, period in seconds).
POLL_STEPS = [60, 120, 300, 900, 1800, 3600]
PACE_LADDER = [(0.2, 60), (0.5, 120), (2.0, 300), (10.0, 900)]


def pace_period(minutes_per_trade: Column, slowest: int = 3600) -> Column:
    """Starting poll period for an item that trades every so many minutes."""
    out = F.lit(slowest)
    for bound, seconds in reversed(PACE_LADDER):
        out = F.when(minutes_per_trade < bound, seconds).otherwise(out)
    return out


def span_period(span_min: Column, rows: Column, full: int = 100) -> Column:
    """Poll period from one response: how many minutes a full response of `full` rows covers."""
    burst = F.greatest(F.lit(60), F.floor(span_min * 60 * 0.15)).cast("int")
    return (F.when(span_min.isNull(), F.lit(None).cast("int")).when(rows < full, 3600).when(span_min < 20, burst)
            .when(span_min < 120, 300).when(span_min < 1440, 900).otherwise(3600))


def poll_advice(quality: DataFrame, items: DataFrame, steps: Sequence[int] = POLL_STEPS) -> DataFrame:
    """Polls that were too slow for the flow of sales, with the next shorter period."""
    period = F.col("poll_interval_sec")
    too_fast = (F.col("saturated") & (F.col("span_min") > 0) & (F.col("span_min") < period / 60 * 1.5))
    shorter = F.greatest(*[F.when(F.lit(s) < period, F.lit(s)) for s in steps], F.lit(None).cast("int"))
    q = quality.join(items.select("item_id", "poll_interval_sec"), "item_id")
    q = q.withColumn("too_fast", F.coalesce(too_fast, F.lit(False)))
    return q.select("item_id", "started_at", "span_min", "too_fast",
                    F.when(F.col("too_fast"), F.coalesce(shorter, period)).otherwise(period).alias("advised_sec"),
                    pace_period(F.col("span_min") / F.col("sold_rows")).alias("pace_sec"),
                    span_period(F.col("span_min"), F.col("sold_rows")).alias("span_sec"))


def scan_assemble(observations: DataFrame) -> DataFrame:
    """Status of a scan from the status of its entities (observed, empty, failed, pending)."""
    one = lambda s: F.count_if(F.col("status") == s)
    return (observations.groupBy("scan_id")
            .agg(F.count(F.lit(1)).alias("entities"), one("observed").alias("observed"), one("empty").alias("empty"),
                 one("failed").alias("failed"), one("pending").alias("pending"))
            .withColumn("run_status", F.when(F.col("failed") == F.col("entities"), "failed")
                        .when(F.col("failed") + F.col("pending") > 0, "partial").otherwise("complete")))
