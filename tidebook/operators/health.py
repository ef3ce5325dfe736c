"""Collection health: staleness, uptime, the alarm ladder and quality flags."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tidebook.functions.timeutil import as_ts, hour_of, hours_ago, seconds_between
from tidebook.plans.split import newest, order_key

def _ok():
    return F.col("error").isNull() & F.col("finished_at").isNotNull()


def staleness(items: DataFrame, runs: DataFrame, as_of: str, factor: int = 5) -> DataFrame:
    """Last success per tracked item; stale when older than `factor` of its poll periods."""
    last = runs.filter(_ok() & (F.col("finished_at") <= as_ts(as_of))).groupBy("item_id").agg(F.max("finished_at").alias("last_success"))
    age = seconds_between(as_ts(as_of), F.col("last_success"))
    return (items.filter("tracked").join(last, "item_id", "left")
            .select("item_id", "last_success", (age / 60).alias("gap_min"),
                    (F.col("last_success").isNull() | (age > F.col("poll_interval_sec") * factor)).alias("stale")))


def uptime_24h(checks: DataFrame, items: DataFrame, as_of: str, max_gap: float = 20) -> DataFrame:
    """Shares of good checks in the last day, by time and weighted by items, and the latest stale count."""
    c = checks.filter(F.col("checked_at") <= as_ts(as_of))
    day = F.col("checked_at") > hours_ago(as_of, 24)
    tracked = items.filter("tracked").agg(F.count(F.lit(1))).scalar()
    agg = c.agg(F.count_if(day).alias("checks24"), F.count_if(day & (F.col("gap_min") <= max_gap)).alias("_good"),
                F.count(F.when(day, F.col("stale_items"))).alias("item_checks24"),
                F.sum(F.when(day, F.col("stale_items"))).alias("_stale"),
                F.count_if(day & (F.col("stale_items") > 0)).alias("stale_checks24"),
                F.max_by("stale_items", order_key(c, ["checked_at", "id"])).alias("latest_stale"))
    share = lambda a, b: F.when(b != 0, 100.0 * a / b)
    return agg.select(
        "checks24", share(F.col("_good"), F.col("checks24")).alias("uptime24"), "item_checks24",
        F.when(F.col("item_checks24") > 0, 100.0 * (1 - F.col("_stale") / (F.col("item_checks24") * tracked))).alias("item_uptime24"),
        "stale_checks24", "latest_stale")


# Fixed values of the alarm ladder, in minutes (and stale items, recoveries).
GAP_LIMIT, RECOVER_EVERY, RECOVER_WINDOW, RECOVERIES, ALERT_EVERY = 20, 10, 40, 2, 360


class AlarmLadder:
    """One source's alarm state: the recoveries of the last 40 minutes and the last alert."""

    def __init__(self, recoveries: list[float] | None = None, last_alert: float | None = None):
        self.recoveries, self.last_alert = list(recoveries or []), last_alert

    def check(self, minute: float, gap: float, stale: int) -> str:
        self.recoveries = [m for m in self.recoveries if m > minute - RECOVER_WINDOW]
        if gap <= GAP_LIMIT and stale == 0:
            return "ok"
        tried = len(self.recoveries)
        cooling = any(m > minute - RECOVER_EVERY for m in self.recoveries)
        if not cooling:
            self.recoveries.append(minute)
        if tried < RECOVERIES:
            return "recover_cooldown" if cooling else "recover"
        if self.last_alert is not None and self.last_alert > minute - ALERT_EVERY:
            return "alert_cooldown"
        self.last_alert = minute
        return "alert"


def _walk(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("checked_at")
    ladder = AlarmLadder()
    minutes = (pdf["checked_at"] - pd.Timestamp(0)) / pd.Timedelta(minutes=1)
    pdf["action"] = [ladder.check(*row) for row in zip(minutes, pdf["gap_min"], pdf["stale_items"])]
    return pdf[["source", "checked_at", "gap_min", "stale_items", "action"]]


def health_action(checks: DataFrame) -> DataFrame:
    """Action of every check. Cool-downs depend on earlier actions, so a source's checks are walked in order.

    The input is one check per source and 5-minute slot: a group is bounded by the calendar.
    """
    return checks.groupBy("source").applyInPandas(
        _walk, "source string, checked_at timestamp, gap_min double, stale_items bigint, action string")


def candle_health_action(checks: DataFrame, max_age: float = 90) -> DataFrame:
    """Alert on stale bars at most every six hours. `checks` has source, checked_at, gap_min (NULL: never built)."""
    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, last, out = pdf.sort_values("checked_at"), None, []
        for at, gap in zip(pdf["checked_at"], pdf["gap_min"]):
            stale = pd.isna(gap) or gap > max_age
            fire = stale and (last is None or last <= at - pd.Timedelta(minutes=ALERT_EVERY))
            last = at if fire else last
            out.append("alert" if fire else "stale" if stale else "ok")
        return pdf.assign(action=out)[["source", "checked_at", "gap_min", "action"]]
    return checks.groupBy("source").applyInPandas(walk, "source string, checked_at timestamp, gap_min double, action string")


def health_unify(checks: DataFrame, epochs: DataFrame, as_of: str, slot_sec: int = 300) -> DataFrame:
    """One line per slot from the sources expected then; NULL as soon as an expected source is missing.

    The epoch list is configuration (a handful of rows), carried as one array so that slots need no range join.
    """
    slot = F.timestamp_seconds(F.floor(F.unix_timestamp("checked_at") / slot_sec) * slot_sec)
    latest = newest(checks.filter(F.col("checked_at") <= as_ts(as_of)).withColumn("slot", slot), ["source", "slot"],
                    ["checked_at", "id"], ["checked_at", "gap_min", "stale_items"])
    config = epochs.agg(F.collect_list(F.struct("source", "valid_from", "valid_to"))).scalar()
    end = F.col("slot") + F.expr(f"INTERVAL {slot_sec} SECONDS")
    due = ((F.col("e.valid_from").isNull() | (F.col("e.valid_from") < end))
           & (F.col("e.valid_to").isNull() | (F.col("e.valid_to") > F.col("slot"))))
    expected = (latest.select("slot").distinct().select("slot", F.explode(config).alias("e")).filter(due)
                .select("slot", "e.source").distinct())
    j = expected.join(latest, ["slot", "source"], "left")
    whole = lambda c, f: F.when(F.count(c) == F.count(F.lit(1)), f(c))
    return j.groupBy("slot").agg(F.coalesce(F.max("checked_at"), F.col("slot")).alias("checked_at"),
                                 whole("gap_min", F.max).alias("gap_min"), whole("stale_items", F.sum).alias("stale_items"))


def longest_gap(trades: DataFrame) -> DataFrame:
    """Longest pause between neighbouring sales per item: inside hours first, then between the hours."""
    inside = Window.partitionBy("item_id", "_h").orderBy("sold_date")
    t = trades.select("item_id", "sold_date", hour_of("sold_date").alias("_h"))
    t = t.withColumn("_g", seconds_between(F.col("sold_date"), F.lag("sold_date").over(inside)))
    hours = t.groupBy("item_id", "_h").agg(F.max("_g").alias("_g"), F.min("sold_date").alias("_a"),
                                           F.max("sold_date").alias("_z"), F.count(F.lit(1)).alias("_n"))
    between = Window.partitionBy("item_id").orderBy("_h")
    hours = hours.withColumn("_b", seconds_between(F.col("_a"), F.lag("_z").over(between)))
    return hours.groupBy("item_id").agg(
        F.sum("_n").alias("n"), (seconds_between(F.max("_z"), F.min("_a")) / 60).alias("span_min"),
        (F.greatest(F.max("_g"), F.max("_b")) / 60).alias("max_gap_min"))


def collection_stats(items: DataFrame, trades: DataFrame, deltas: DataFrame, runs: DataFrame) -> DataFrame:
    live = deltas.filter((F.col("reason") != "expired") & F.col("invalidated_at").isNull())
    qty = live.groupBy("item_id").agg(F.sum("qty_sold").alias("_q"))
    sat = runs.groupBy("item_id").agg(F.count_if("saturated").alias("_s"))
    zero = lambda c, n: F.coalesce(c, F.lit(0)).alias(n)
    return (items.filter("tracked").join(longest_gap(trades), "item_id", "left").join(qty, "item_id", "left")
            .join(sat, "item_id", "left")
            .select("item_id", "poll_interval_sec", zero("n", "n"), "span_min", "max_gap_min", zero("_q", "depletion_qty"),
                    zero("_s", "saturated_runs")))


def quality_7d(runs: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    r = runs.filter((F.col("started_at") >= hours_ago(as_of, 24 * days)) & (F.col("started_at") < as_ts(as_of)))
    return r.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if(_ok()).alias("succeeded"), F.count_if(F.col("error").isNotNull()).alias("failed"),
        F.count_if("saturated").alias("saturated"), F.min("started_at").alias("first_record"), F.max("started_at").alias("last_record"))


def quality_hours(runs: DataFrame, full_sold: int = 100, full_listing: int = 400, as_of: str | None = None) -> DataFrame:
    """Per item-hour: known (every poll a success, finished by `as_of` if given), overlap (also no saturated or capped response), clean (also
    no full sales response)."""
    done = runs.filter(F.col("started_at").isNotNull())
    in_time = F.col("finished_at") <= as_ts(as_of) if as_of else F.lit(True)
    known = F.bool_and(F.coalesce(_ok() & in_time, F.lit(False)))
    capped = F.coalesce(F.bool_or(F.col("saturated") | (F.col("listing_rows") >= full_listing)), F.lit(False))
    full = F.coalesce(F.bool_or(F.col("sold_rows") >= full_sold), F.lit(False))
    return (done.groupBy("item_id", hour_of("started_at").alias("hour"))
            .agg(known.alias("known"), (known & ~capped).alias("overlap"), (known & ~capped & ~full).alias("clean")))


def quality_join(series: DataFrame, runs: DataFrame, full_sold: int = 100, full_listing: int = 400, as_of: str | None = None) -> DataFrame:
    """Attach the quality flags to an hourly series; an hour without any record is not known."""
    q = quality_hours(runs, full_sold, full_listing, as_of)
    out = series.join(q, ["item_id", "hour"], "left")
    return out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("known", "overlap", "clean")})
