"""Weekday and hour-of-day patterns.

Inputs are bars: one row per item and hour (or day). Windows over an item or a set are therefore bounded by
the calendar, whatever the number of raw sales.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidebook.functions.timeutil import KST, as_ts, hour_of, hours_ago, iso_dow, local_day, local_ts
from tidebook.operators.candles import hour_last
from tidebook.plans.split import newest
from tidebook.session import reuse


FLAT = 1e-9        # percent; smaller changes are summation noise, not moves


def week_of(day: Column) -> Column:
    return F.to_date(F.date_trunc("week", day))


def floor_series(floors: DataFrame, as_of: str, tz: str = KST) -> DataFrame:
    """Daily means of hour-end floors: a re-scan inside an hour does not weigh more.

    `floors` has captured_at, id, p10, min_price, listings and, where known, mean10 and tenth.
    """
    ok = floors.filter((F.col("p10") > 0) & (F.col("min_price") > 0) & (F.col("captured_at") <= as_ts(as_of)))
    last = hour_last(ok, ["p10", "min_price", "listings", "mean10", "tenth"], keys=())
    return last.groupBy(local_day("hour", tz).alias("day")).agg(
        F.count(F.lit(1)).alias("hours"), F.count("mean10").alias("material_hours"), F.avg("mean10").alias("mean10"),
        F.avg("tenth").alias("tenth"), F.avg("p10").alias("p10"), F.avg("min_price").alias("min"), F.avg("listings").alias("listings"))


def _full_weeks(days: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Days of complete Monday-Sunday weeks with the week's mean."""
    week = Window.partitionBy(*keys, "_week")
    return (days.withColumn("_week", week_of(F.col("day"))).withColumn("_n", F.count(F.lit(1)).over(week))
            .withColumn("_mean", F.avg(value).over(week)).filter("_n = 7").drop("_n"))


def weekday_trend(days: DataFrame, before: str, keys: Sequence[str] = ("item_id",), min_weeks: int = 4) -> DataFrame:
    """Per item and weekday (Monday 1): price against the week's mean and change on the day before.

    `days` holds the valid days (keys, day, price). Fewer than `min_weeks` full weeks give a not-ready row.
    """
    keys = list(keys)
    valid = days.filter((F.col("day") < F.lit(before).cast("date")) & (F.col("price") > 0)).select(*keys, "day", "price")
    valid = reuse(valid)
    prior = valid.select(*keys, F.date_add("day", 1).alias("day"), F.col("price").alias("_prev"))
    full = (_full_weeks(valid, keys, "price").join(prior, [*keys, "day"], "left")
            .withColumn("index", F.col("price") / F.col("_mean") * 100)
            .withColumn("chg", (F.col("price") / F.col("_prev") - 1) * 100))
    weeks = full.groupBy(*keys).agg(F.count_distinct("_week").alias("weeks"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    points = full.groupBy(*keys, iso_dow("day").alias("k")).agg(
        F.avg("index").alias("price"), F.count(F.lit(1)).alias("n"), F.avg("chg").alias("change"), F.count("chg").alias("change_n"))
    counts = valid.groupBy(*keys, iso_dow("day").alias("k")).agg(F.count(F.lit(1)).alias("available"))
    total = valid.groupBy(*keys).agg(F.count(F.lit(1)).alias("days"))
    grid = total.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(7))))
    out = grid.join(weeks, keys, "left").join(counts, [*keys, "k"], "left").join(points, [*keys, "k"], "left")
    ready = F.coalesce(F.col("weeks") >= min_weeks, F.lit(False))
    shown = lambda c: F.when(ready, F.col(c)).alias(c)
    return out.select(*keys, "k", ready.alias("ready"), F.coalesce("weeks", F.lit(0)).alias("weeks"), "days", "first_day", "last_day",
                      F.coalesce("available", F.lit(0)).alias("available"), shown("price"), shown("n"), shown("change"), shown("change_n"))


def weekday_groups(profiles: DataFrame, by: Sequence[str] = ("basis",)) -> DataFrame:
    """Equal-weight mean of the ready item profiles per weekday, with the sample behind it."""
    ready = F.col("ready")
    only = lambda c: F.when(ready, F.col(c))
    return profiles.groupBy(*by, "k").agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if(ready).alias("eligible"), F.max("weeks").alias("max_weeks"),
        F.min(only("first_day")).alias("first_day"), F.max(only("last_day")).alias("last_day"), F.avg(only("price")).alias("price"),
        F.avg(only("change")).alias("change"), F.coalesce(F.sum(only("n")), F.lit(0)).alias("n"),
        F.coalesce(F.sum(only("change_n")), F.lit(0)).alias("change_n"), F.count(only("change")).alias("change_items"),
        F.sum("available").alias("available"))


def ask_days(snapshots: DataFrame, tiered: str, as_of: str, tz: str = KST) -> DataFrame:
    """Daily mean and hours of the hour-end asks per item and basis."""
    s = snapshots.filter((F.col("category") == tiered) & (F.col("captured_at") <= as_ts(as_of))
                         & ((F.col("upgrade") == 0) | ((F.col("upgrade") > 0) & (F.col("upgrade") == F.col("upgrade_max")))))
    return (hour_last(s, ["min_unit_price"]).filter("min_unit_price > 0")
            .groupBy("item_id", F.when(F.col("upgrade") == 0, "ask0").otherwise("askMax").alias("basis"), local_day("captured_at", tz).alias("day"))
            .agg(F.avg("min_unit_price").alias("price"), F.count(F.lit(1)).alias("hours")))


def ask_weekday(days: DataFrame, today: str, min_hours: int = 18, min_weeks: int = 4) -> DataFrame:
    """Item-equal weekday profile of asks per basis; items with too few full weeks take no part."""
    keys = ["item_id", "basis"]
    ok = days.filter((F.col("day") < F.lit(today).cast("date")) & (F.col("price") > 0) & (F.col("hours") >= min_hours))
    full = _full_weeks(ok, keys, "price")
    enough = F.count(F.lit(1)).over(Window.partitionBy(*keys)) >= 7 * min_weeks
    per_item = (full.withColumn("_ok", enough).filter("_ok").groupBy(*keys, iso_dow("day").alias("k"))
                .agg(F.avg(F.col("price") / F.col("_mean") * 100).alias("price")))
    return per_item.groupBy("basis", "k").agg(F.count(F.lit(1)).alias("items"), F.avg("price").alias("price"))


def weekday_eligible(trades: DataFrame, min_days: int = 14, min_trades: int = 25) -> DataFrame:
    span = F.unix_micros(F.max("sold_date")) - F.unix_micros(F.min("sold_date"))
    return (trades.groupBy("item_id", "category").agg(F.count(F.lit(1)).alias("_n"), span.alias("_s"))
            .filter((F.col("_s") > min_days * 86_400_000_000) & (F.col("_n") >= min_trades)).select("item_id", "category"))


def weekday_effect(daily: DataFrame, eligible: DataFrame, before: str) -> DataFrame:
    """Log deviation from the item's mean price and share of its mean quantity by weekday, in percent."""
    d = daily.join(eligible.select("item_id"), "item_id", "left_semi").filter(F.col("day") < F.lit(before).cast("date"))
    item = Window.partitionBy("item_id")
    d = d.withColumn("_m", F.avg("vwap").over(item)).withColumn("_q", F.avg("qty").over(item)).filter("_m > 0 AND vwap > 0")
    lr = F.log(F.col("vwap") / F.col("_m"))
    return d.groupBy(iso_dow("day").alias("k")).agg(
        F.count(F.lit(1)).alias("n"), (F.avg(lr) * 100).alias("ret"),
        (F.stddev_samp(lr) / F.sqrt(F.count(F.lit(1))) * 100).alias("se"), F.avg(F.col("qty") / F.col("_q")).alias("vol"))


def weekday_sample(daily: DataFrame, eligible: DataFrame, effect: DataFrame, before: str) -> DataFrame:
    """Size of the weekday sample and the smallest effect it could show (2.8 standard errors)."""
    d = daily.join(eligible.select("item_id"), "item_id", "left_semi").filter(F.col("day") < F.lit(before).cast("date"))
    cats = eligible.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    names = cats.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "n"))))).scalar()
    return d.agg(
        F.count_distinct("item_id").alias("items"), F.count(F.lit(1)).alias("item_days"),
        (F.datediff(F.max("day"), F.min("day")) + 1).alias("span_days"), F.min("day").alias("first_day"), F.max("day").alias("last_day")
    ).withColumns({"categories": names, "mde": effect.agg(F.avg("se") * 2.8).scalar()})


def weekday_ex_events(daily: DataFrame, event_days: DataFrame, before: str, near: int = 3, min_span: int = 31,
                      min_per_day: int = 3) -> DataFrame:
    """Weekday profile without the days around events; `event_days` has item_id and day."""
    d = daily.filter((F.col("day") < F.lit(before).cast("date")) & (F.col("vwap") > 0) & (F.col("qty") > 0))
    close = event_days.select("item_id", F.explode(F.sequence(F.date_sub("day", near), F.date_add("day", near))).alias("day")).distinct()
    span = d.groupBy("item_id").agg(F.datediff(F.max("day"), F.min("day")).alias("span"), F.count(F.lit(1)).alias("_all"))
    used = d.join(close, ["item_id", "day"], "left_anti")
    base = used.groupBy("item_id").agg(F.avg("vwap").alias("_m"), F.avg("qty").alias("_q"), F.count(F.lit(1)).alias("used"))
    by_k = used.groupBy("item_id", iso_dow("day").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.avg("vwap").alias("_v"), F.avg("qty").alias("_vq"))
    least = by_k.groupBy("item_id").agg(F.when(F.count(F.lit(1)) == 7, F.min("n")).otherwise(0).alias("_least"))
    grid = span.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(7))))
    out = grid.join(base, "item_id", "left").join(least, "item_id", "left").join(by_k, ["item_id", "k"], "left")
    state = (F.when(F.col("span") < min_span, "history").when(F.coalesce("_least", F.lit(0)) < min_per_day, "samples").otherwise("ready"))
    shown = lambda c: F.when(F.col("state") == "ready", c)
    return out.withColumn("state", state).select(
        "item_id", "k", "state", "span", F.coalesce("used", F.lit(0)).alias("used"), (F.col("_all") - F.coalesce("used", F.lit(0))).alias("excluded"),
        F.coalesce("n", F.lit(0)).alias("n"), shown(F.col("_v") / F.col("_m") * 100).alias("price"), shown(F.col("_vq") / F.col("_q") * 100).alias("qty"))


def _slots(points: DataFrame, boundary: Column | int, tz: str) -> DataFrame:
    """Add the business day and the hour slot (0-23 from the day's start) of every hourly point."""
    b = F.lit(boundary) if isinstance(boundary, int) else boundary
    at = local_ts("hour", tz) - F.make_dt_interval(hours=b)
    return points.withColumn("day", F.to_date(at)).withColumn("slot", F.hour(at))


def day_paths(points: DataFrame, as_of: str, boundary: int = 0, tz: str = KST, min_hours: int = 18) -> DataFrame:
    """One row per item and business day: coverage, change, log slope, fit and the hours of the extremes.

    Days without any observation between the first and last point stay, so their exclusion can be seen.
    """
    p = _slots(points.filter(F.col("hour") < as_ts(as_of)), boundary, tz).withColumn("p", F.when(F.col("price") > 0, F.col("price")))
    spine = p.groupBy("item_id").agg(F.min("day").alias("_a"), F.max("day").alias("_z"), F.min("hour").alias("_first"))
    spine = spine.select("item_id", "_first", F.explode(F.sequence("_a", "_z")).alias("day"))
    ln, h = F.log("p"), F.when(F.col("p").isNotNull(), F.col("slot")).cast("double")
    early, late = F.when(F.col("slot") < 3, F.col("p")), F.when(F.col("slot") >= 21, F.col("p"))
    g = p.groupBy("item_id", "day").agg(
        F.count("p").alias("hours"), F.avg("p").alias("average"), F.count(early).alias("_en"), F.count(late).alias("_ln"),
        F.avg(early).alias("_e"), F.avg(late).alias("_l"), F.regr_slope(ln, h).alias("_slope"), F.regr_sxx(ln, h).alias("_xx"),
        F.regr_syy(ln, h).alias("_yy"), F.regr_sxy(ln, h).alias("_xy"),
        F.min_by("slot", F.when(F.col("p").isNotNull(), F.struct("p", "slot"))).alias("low_hour"),
        F.max_by("slot", F.when(F.col("p").isNotNull(), F.struct(F.col("p"), -F.col("slot")))).alias("high_hour"))
    start = (F.col("day").cast("timestamp") + F.expr(f"INTERVAL {boundary} HOURS"))
    start = start if tz == "UTC" else F.to_utc_timestamp(start, tz)
    j = spine.join(g, ["item_id", "day"], "left").withColumn("hours", F.coalesce("hours", F.lit(0)))
    j = j.withColumn("complete", (start >= F.col("_first")) & (start + F.expr("INTERVAL 1 DAY") <= as_ts(as_of)))
    j = j.withColumn("eligible", F.col("complete") & (F.col("hours") >= min_hours))
    steep = F.when(F.col("_xx") > 0, F.col("_slope")).otherwise(0.0)
    return j.select(
        "item_id", "day", "complete", "hours", "eligible", "average",
        F.when(F.col("eligible") & (F.col("_en") >= 2) & (F.col("_ln") >= 2), (F.col("_l") / F.col("_e") - 1) * 100).alias("change_pct"),
        F.when(F.col("eligible"), (F.exp(steep * 24) - 1) * 100).alias("slope24_pct"),
        F.when(F.col("eligible") & (F.col("_xx") > 0) & (F.col("_yy") > 0), F.col("_xy") * F.col("_xy") / (F.col("_xx") * F.col("_yy"))).alias("r2"),
        "low_hour", "high_hour")


def boundary_compare(points: DataFrame, as_of: str, tz: str = KST, min_hours: int = 18) -> DataFrame:
    """The same days seen from 00:00 and 06:00: changes, hour index and weekday index in one long table."""
    points = reuse(points)
    paths = {b: reuse(day_paths(points, as_of, b, tz, min_hours)) for b in (0, 6)}
    common = (paths[0].filter("eligible").select("item_id", "day").join(paths[6].filter("eligible").select("item_id", "day"), ["item_id", "day"]))
    out = None
    for b, path in paths.items():
        d = path.join(common, ["item_id", "day"], "left_semi")
        c = F.col("change_pct")
        change = d.groupBy("item_id").agg(F.count(c).alias("n"), F.avg(c).alias("value"), F.count_if(c > 0).alias("up"), F.count_if(c < 0).alias("down")) \
            .select("item_id", F.lit("change").alias("kind"), F.lit(0).alias("slot"), "n", "value", "up", "down")
        pts = _slots(points.filter(F.col("hour") < as_ts(as_of)), b, tz).filter("price > 0")
        none = F.lit(None).cast("bigint")
        hourly = (pts.join(d.select("item_id", "day", "average"), ["item_id", "day"])
                  .groupBy("item_id", ((F.col("slot") + b) % 24).alias("slot"))
                  .agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("price") / F.col("average") * 100).alias("value"))
                  .select("item_id", F.lit("hour").alias("kind"), "slot", "n", "value", none.alias("up"), none.alias("down")))
        weekday = (_full_weeks(d.select("item_id", "day", "average"), ["item_id"], "average")
                   .groupBy("item_id", (iso_dow("day") - 1).alias("slot"))
                   .agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("average") / F.col("_mean") * 100).alias("value"))
                   .select("item_id", F.lit("weekday").alias("kind"), "slot", "n", "value", none.alias("up"), none.alias("down")))
        part = change.unionByName(hourly).unionByName(weekday).withColumn("boundary", F.lit(b))
        out = part if out is None else out.unionByName(part)
    return out


def seasonal_inputs(bars: DataFrame, snapshots: DataFrame, as_of: str, tiered: str, days: int = 57) -> DataFrame:
    """Long hourly metrics per item: price, traded, listings, stock."""
    since, now = hours_ago(as_of, 24 * days), as_ts(as_of)
    b = bars.filter((F.col("hour") >= since) & (F.col("hour") < now) & (F.col("category") != tiered))
    s = snapshots.filter((F.col("captured_at") >= since) & (F.col("captured_at") < now) & ((F.col("upgrade") == 0) | F.col("upgrade").isNull()))
    last = newest(s.withColumn("hour", hour_of("captured_at")), ["item_id", "category", "hour"], ["captured_at", "id"],
                  ["min_unit_price", "listing_count", "total_qty"])
    long = lambda df, pairs: df.select("item_id", "category", "hour", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(c).cast("double").alias("value")) for m, c in pairs])).alias("m")).select("item_id", "category", "hour", "m.*")
    sold = long(b, [("price", "vwap"), ("traded", "qty")])
    book = long(last, [("listings", "listing_count"), ("stock", "total_qty")])
    asks = long(last.filter(F.col("category") == tiered), [("price", "min_unit_price")])
    return sold.unionByName(book).unionByName(asks)


def seasonal_sets(items: DataFrame, group: Column) -> DataFrame:
    """Membership bridge: every group of items, and every item by itself."""
    sets = F.array(F.concat(F.lit("group:"), group), F.col("item_id"))
    return items.select("item_id", F.explode(sets).alias("set_id"))


def seasonal_profile(series: DataFrame, bridge: DataFrame, as_of: str, tz: str = KST, keys: Sequence[str] = (),
                     allowed: DataFrame | None = None, min_hours: int = 18, window_days: int = 56) -> DataFrame:
    """Hour and weekday index of a set from the days on which every member is well observed at both boundaries.

    `series` has item_id, hour, value (and `keys`); `bridge` has set_id, item_id. Long output: kind hour,
    weekday or change per boundary. `allowed` (set_id, day) narrows the days further.
    """
    return _profile(*_profile_days(series, bridge, as_of, tz, keys, min_hours, window_days), keys, allowed)


def _profile_days(series, bridge, as_of, tz, keys, min_hours, window_days):
    cutoff = F.date_trunc("hour", as_ts(as_of))
    size = bridge.groupBy("set_id").agg(F.count(F.lit(1)).alias("size"))
    p = (series.filter((F.col("value") >= 0) & (F.col("hour") < cutoff))
         .withColumn("boundary", F.explode(F.array(F.lit(0), F.lit(6)))))
    p = _slots(p, F.col("boundary"), tz)
    start = F.col("day").cast("timestamp") + F.make_dt_interval(hours=F.col("boundary"))
    start = start if tz == "UTC" else F.to_utc_timestamp(start, tz)
    p = p.filter((start >= cutoff - F.expr(f"INTERVAL {window_days} DAYS")) & (start + F.expr("INTERVAL 1 DAY") <= cutoff))
    item_day = Window.partitionBy(*keys, "item_id", "boundary", "day")
    p = (p.withColumn("_n", F.count(F.lit(1)).over(item_day)).withColumn("avg", F.avg("value").over(item_day))
         .filter((F.col("_n") >= min_hours) & (F.col("avg") > 0)).drop("_n"))
    p = reuse(p.join(bridge, "item_id").join(size, "set_id"))
    whole = (p.groupBy(*keys, "set_id", "day", "size").agg(F.count_distinct("item_id", "boundary").alias("_c"))
             .filter(F.col("_c") == 2 * F.col("size")).select(*keys, "set_id", "day"))
    return p, whole


def _profile(p, common, keys, allowed):
    sk = [*keys, "set_id"]
    if allowed is not None:
        common = common.join(allowed, ["set_id", "day"], "left_semi")
    p = p.join(common, [*sk, "day"], "left_semi").withColumn("norm", F.col("value") / F.col("avg") * 100)
    at = [*sk, "boundary", "day", "slot"]
    shared = (p.groupBy(*at, "size").agg(F.count(F.lit(1)).alias("_m"), F.avg("norm").alias("v"))
              .filter(F.col("_m") == F.col("size")))
    none = F.lit(None).cast("bigint")
    hourly = (shared.groupBy(*sk, "boundary", ((F.col("slot") + F.col("boundary")) % 24).alias("slot"))
              .agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("value"), F.median("v").alias("median"))
              .select(*sk, "boundary", F.lit("hour").alias("kind"), "slot", "n", "value", "median", none.alias("up"), none.alias("down")))
    days = p.select(*sk, "item_id", "boundary", "day", "avg").distinct()
    full = _full_weeks(days, [*sk, "item_id", "boundary"], "avg").withColumn("i", F.col("avg") / F.col("_mean") * 100)
    weekday = (full.groupBy(*sk, "boundary", "day").agg(F.avg("i").alias("i"))
               .groupBy(*sk, "boundary", (iso_dow("day") - 1).alias("slot")).agg(F.count(F.lit(1)).alias("n"), F.avg("i").alias("value"))
               .select(*sk, "boundary", F.lit("weekday").alias("kind"), "slot", "n", "value", F.lit(None).cast("double").alias("median"),
                       none.alias("up"), none.alias("down")))
    early, late = F.when(F.col("slot") < 3, F.col("v")), F.when(F.col("slot") >= 21, F.col("v"))
    ends = (shared.groupBy(*sk, "boundary", "day").agg(F.count(early).alias("en"), F.count(late).alias("ln"), F.avg(early).alias("e"), F.avg(late).alias("l"))
            .filter("en >= 2 AND ln >= 2 AND e > 0").withColumn("c", (F.col("l") / F.col("e") - 1) * 100))
    change = (ends.groupBy(*sk, "boundary").agg(F.count(F.lit(1)).alias("n"), F.avg("c").alias("value"), F.count_if(F.col("c") > FLAT).alias("up"),
                                                F.count_if(F.col("c") < -FLAT).alias("down"))
              .select(*sk, "boundary", F.lit("change").alias("kind"), F.lit(0).alias("slot"), "n", "value",
                      F.lit(None).cast("double").alias("median"), "up", "down"))
    return hourly.unionByName(weekday).unionByName(change)


def activity_profiles(series: DataFrame, bridge: DataFrame, as_of: str, metrics: Sequence[str], tz: str = KST,
                      min_hours: int = 18, window_days: int = 56) -> DataFrame:
    """Profiles of several metrics on the same hours and the same days, so that they can be compared."""
    ok = series.filter(F.col("metric").isin(list(metrics)) & (F.col("value") >= 0) & ((F.col("metric") != "price") | (F.col("value") > 0)))
    together = F.count(F.lit(1)).over(Window.partitionBy("item_id", "hour"))
    ok = ok.withColumn("_k", together).filter(F.col("_k") == len(metrics)).select("item_id", "hour", "metric", "value")
    p, whole = _profile_days(ok, bridge, as_of, tz, ["metric"], min_hours, window_days)
    same = (whole.groupBy("set_id", "day").agg(F.count(F.lit(1)).alias("_k")).filter(F.col("_k") == len(metrics)).select("set_id", "day"))
    return _profile(p, whole, ["metric"], same)


def profile_extrema(profile: DataFrame, keys: Sequence[str], least: int = 3) -> DataFrame:
    """Lowest and highest hour of a profile among hours with enough days."""
    h = profile.filter((F.col("kind") == "hour") & (F.col("n") >= least))
    return h.groupBy(*keys).agg(F.min_by("slot", F.struct("value", "slot")).alias("low_hour"), F.min("value").alias("low"),
                                F.max_by("slot", F.struct("value", "slot")).alias("high_hour"), F.max("value").alias("high"))


# Which observations a repetition check may use.
MODES = ["all", "noThursday", "known", "overlap", "clean"]


def repetition_days(points: DataFrame, bridge: DataFrame, as_of: str, boundary: int = 6, tz: str = KST,
                    min_hours: int = 18, modes: Sequence[str] = MODES) -> DataFrame:
    """Per set, mode, day and member: evening (18-20) against morning (06-08) on hours all members share.

    `points` has item_id, hour, value, known, overlap, clean.
    """
    thursday = iso_dow(F.to_date(local_ts("hour", tz))) == 4
    rule = {"all": F.lit(True), "noThursday": ~thursday, "known": F.col("known"), "overlap": F.col("overlap"), "clean": F.col("clean")}
    pick = F.filter(F.array(*[F.when(rule[m], F.lit(m)) for m in modes]), lambda m: m.isNotNull())
    p = _slots(points.filter(F.col("value").isNotNull()), boundary, tz).withColumn("mode", F.explode(pick))
    size = bridge.groupBy("set_id").agg(F.count(F.lit(1)).alias("size"))
    p = p.join(bridge, "item_id").join(size, "set_id")
    end = F.col("day").cast("timestamp") + F.expr(f"INTERVAL {24 + boundary} HOURS")
    end = end if tz == "UTC" else F.to_utc_timestamp(end, tz)
    p = p.filter(end <= as_ts(as_of))
    day = ["set_id", "mode", "day"]
    member = Window.partitionBy(*day, "item_id")
    p = reuse(p.withColumn("_h", F.count(F.lit(1)).over(member)).filter(F.col("_h") >= min_hours))
    clock = (F.col("slot") + boundary) % 24
    p = p.withColumn("block", F.when(clock.between(6, 8), "morning").when(clock.between(18, 20), "evening"))
    whole = (p.groupBy(*day, "size").agg(F.count_distinct("item_id").alias("_m")).filter(F.col("_m") == F.col("size")).select(*day))
    shared = (p.filter("block IS NOT NULL").groupBy(*day, "block", "slot", "size").agg(F.count(F.lit(1)).alias("_m"))
              .filter(F.col("_m") == F.col("size")).select(*day, "slot"))
    both = (p.filter("block IS NOT NULL").join(whole, day, "left_semi").join(shared, [*day, "slot"], "left_semi"))
    side = lambda b: F.when(F.col("block") == b, F.col("value"))
    g = both.groupBy(*day, "item_id", "size").agg(F.count(side("morning")).alias("_mn"), F.count(side("evening")).alias("_en"),
                                                  F.avg(side("morning")).alias("_a"), F.avg(side("evening")).alias("_b"))
    g = g.filter("_mn >= 2 AND _en >= 2").withColumn("pct", F.when(F.col("_a") > 0, (F.col("_b") / F.col("_a") - 1) * 100))
    every = F.count("pct").over(Window.partitionBy(*day)) == F.col("size")
    return g.withColumn("_ok", every).filter("_ok").select(*day, "item_id", "size", "pct")


def _summary(days: DataFrame, keys: Sequence[str]) -> DataFrame:
    p = F.col("pct")
    return days.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(p > 0).alias("up"), F.count_if(p < 0).alias("down"),
                                   F.median("pct").alias("median_pct"), F.avg("pct").alias("mean_pct"))


def repetition(member_days: DataFrame) -> DataFrame:
    """Member-equal daily change, summed up per set and mode."""
    return _summary(member_days.groupBy("set_id", "mode", "day").agg(F.avg("pct").alias("pct")), ["set_id", "mode"])


def leave_one_out(member_days: DataFrame) -> DataFrame:
    """The same days without each member in turn, and each member alone."""
    day = Window.partitionBy("set_id", "mode", "day")
    rest = (F.sum("pct").over(day) - F.col("pct")) / (F.col("size") - 1)
    without = (member_days.filter("size > 1").withColumn("pct", rest).select("set_id", "mode", "day", F.lit("without").alias("part"), "item_id", "pct"))
    alone = member_days.select("set_id", "mode", "day", F.lit("alone").alias("part"), "item_id", "pct")
    return _summary(without.unionByName(alone), ["set_id", "mode", "part", "item_id"])


def one_decimal(value: Column) -> Column:
    """Rounding to one decimal, halves away from zero."""
    return F.round(value.cast("decimal(38,17)"), 1).cast("double")


def weekly_market(daily: DataFrame, through: str, tz: str = KST, min_days: int = 5) -> DataFrame:
    """Quantity-weighted price of the last two full weeks and its change, rounded before it is ranked."""
    monday = week_of(local_day(as_ts(through), tz))
    d = daily.filter((F.col("vwap") > 0) & (F.col("qty") > 0) & (F.col("day") >= F.date_sub(monday, 14)) & (F.col("day") < monday))
    late = F.col("day") >= F.date_sub(monday, 7)
    gold = F.col("vwap") * F.col("qty")
    part = lambda w, c: F.sum(F.when(w, c))
    g = d.groupBy("item_id").agg(
        F.count_if(~late).alias("prev_days"), F.count_if(late).alias("last_days"), part(~late, F.col("qty")).alias("prev_qty"),
        part(late, F.col("qty")).alias("last_qty"), part(~late, gold).alias("_pg"), part(late, gold).alias("_lg"))
    g = g.filter((F.col("prev_days") >= min_days) & (F.col("last_days") >= min_days)) \
        .withColumns({"prev_price": F.col("_pg") / F.col("prev_qty"), "last_price": F.col("_lg") / F.col("last_qty")})
    g = g.withColumn("change_pct", one_decimal((F.col("last_price") / F.col("prev_price") - 1) * 100)).drop("_pg", "_lg")
    return g


def weekly_breadth(market: DataFrame, movers: int = 3) -> DataFrame:
    """Counts of risers and fallers, the median change and the largest moves on each side."""
    c = F.col("change_pct")
    totals = market.agg(F.count(F.lit(1)).alias("items"), F.count_if(c > 0).alias("up"), F.count_if(c < 0).alias("down"),
                        F.count_if(c == 0).alias("flat"), F.median("change_pct").alias("median_pct"))
    top = lambda rows, order: (rows.orderBy(order, "item_id").limit(movers)
                               .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(-F.abs(c), F.col("item_id")))), lambda s: s["item_id"]), ",")).scalar())
    return totals.withColumns({"risers": top(market.filter(c > 0), F.desc("change_pct")), "fallers": top(market.filter(c < 0), F.asc("change_pct"))})


def period_overlap(periods: DataFrame, first: str, last: str) -> DataFrame:
    """Calendar periods active on each day with their phase; an open period runs to the last day asked for."""
    a, z = F.lit(first).cast("date"), F.lit(last).cast("date")
    start, end = F.greatest("start_day", a), F.least(F.coalesce("end_day", z), z)
    p = periods.filter((start <= end)).withColumn("day", F.explode(F.sequence(start, end)))
    begins, ends = F.col("day") == F.col("start_day"), F.coalesce(F.col("day") == F.col("end_day"), F.lit(False))
    return p.withColumn("phase", F.when(begins & ends, "start and end").when(begins, "start").when(ends, "end").otherwise("during"))
