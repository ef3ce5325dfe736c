"""Hourly bars and the rollups built on them."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidebook.functions.exact import exact_sum, pct_change, ratio
from tidebook.functions.timeutil import (KST, as_ts, day_number, hour_number, hour_of, hours_ago, local_day, local_ts,
                                         seconds_between)
from tidebook.plans.series import runs
from tidebook.plans.split import newest, order_key

BAR = ["o", "h", "l", "c", "gold", "qty", "n"]


def candles_1h(trades: DataFrame, keys: Sequence[str] = ("item_id",)) -> DataFrame:
    """OHLC by (time, id), exact turnover, quantity and count per item and hour; only partial aggregates."""
    order = order_key(trades, ["sold_date", "id"])
    bars = trades.groupBy(*keys, hour_of("sold_date").alias("hour")).agg(
        F.min_by("unit_price", order).alias("o"), F.max("unit_price").alias("h"),
        F.min("unit_price").alias("l"), F.max_by("unit_price", order).alias("c"),
        exact_sum(F.col("unit_price") * F.col("qty")).alias("gold"),
        F.sum("qty").cast("bigint").alias("qty"), F.count(F.lit(1)).alias("n"))
    return bars.withColumn("vwap", ratio(F.col("gold"), F.col("qty")))


def candles_refresh(stored: DataFrame, trades: DataFrame, raw_from: str, p_from: str | None = None) -> DataFrame:
    """Stored bars with every bar rebuilt that raw sales can still prove.

    From `raw_from` (or a later `p_from`) on, raw is complete and bars are replaced. Without `p_from`, older
    bars are rebuilt too unless the stored bar is protected (its raw is gone). Running it twice changes nothing;
    written with dynamic partition overwrite by day, only the days holding rebuilt bars are replaced.
    """
    start = F.greatest(as_ts(raw_from), F.date_trunc("hour", as_ts(p_from))) if p_from else as_ts(raw_from)
    raw = trades if p_from is None else trades.filter(F.col("sold_date") >= start)
    bars = candles_1h(raw)
    if p_from is None:
        guarded = stored.filter(~F.col("raw_complete") & (F.col("hour") < start)).select("item_id", "hour")
        bars = bars.join(guarded, ["item_id", "hour"], "left_anti")
    bars = bars.withColumn("raw_complete", F.lit(True))
    kept = stored.join(bars.select("item_id", "hour"), ["item_id", "hour"], "left_anti")
    return kept.unionByName(bars)


def candles_prune(trades: DataFrame, bars: DataFrame, as_of: str, keep_days: int = 35) -> tuple[DataFrame, DataFrame]:
    """(sales kept, bars with old ones frozen): raw goes only where a complete bar stands for it."""
    cutoff = F.date_trunc("hour", hours_ago(as_of, 24 * keep_days))
    covered = bars.filter("raw_complete").select("item_id", F.col("hour").alias("_hour"))
    old = trades.filter(F.col("sold_date") < cutoff).withColumn("_hour", hour_of("sold_date"))
    kept = (trades.filter(F.col("sold_date") >= cutoff)
            .unionByName(old.join(covered, ["item_id", "_hour"], "left_anti").drop("_hour")))
    frozen = bars.withColumn("raw_complete", F.col("raw_complete") & (F.col("hour") >= cutoff))
    return kept, frozen


def candle_reconcile(trades: DataFrame, stored: DataFrame, raw_from: str, through: str,
                     raw_max_id: Column | int) -> DataFrame:
    """Rebuild the bars from raw up to the id boundary and compare them, NULL-safely, with the stored ones."""
    raw_max_id = F.lit(raw_max_id) if isinstance(raw_max_id, int) else raw_max_id
    span = (F.col("sold_date") >= as_ts(raw_from)) & (F.col("sold_date") < as_ts(through))
    marked = trades.filter(span).withColumn("_late", F.col("id") > raw_max_id)
    bars = candles_1h(marked.filter(~F.col("_late")))
    late = (marked.filter("_late").groupBy("item_id", hour_of("sold_date").alias("hour"))
            .agg(F.count(F.lit(1)).alias("late_n")))
    kept = stored.filter((F.col("hour") >= as_ts(raw_from)) & (F.col("hour") < as_ts(through)))
    a = bars.select("item_id", "hour", F.struct(*BAR).alias("rebuilt"))
    b = kept.select("item_id", "hour", F.struct(*BAR).alias("held"))
    joined = a.join(b, ["item_id", "hour"], "full_outer").join(late, ["item_id", "hour"], "full_outer")
    known = F.col("rebuilt").isNotNull() | F.col("held").isNotNull()
    return joined.agg(
        F.count("rebuilt").alias("bars"), F.count("late_n").alias("pending_bars"),
        F.coalesce(F.sum("late_n"), F.lit(0)).alias("pending_trades"),
        F.count_if(known & ~F.col("rebuilt").eqNullSafe(F.col("held"))).alias("mismatches"))


def candle_freshness(states: DataFrame, as_of: str, max_age_minutes: int = 90) -> DataFrame:
    age = seconds_between(as_ts(as_of), F.col("refreshed_at")) / 60
    return states.withColumn("age_minutes", age).withColumn(
        "stale", F.col("refreshed_at").isNull() | (F.col("age_minutes") > max_age_minutes))


def _ohlc(df: DataFrame, keys: Sequence, o: str, h: str, l: str, c: str, order, *more: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.min_by(o, order).alias("o"), F.max(h).alias("h"), F.min(l).alias("l"),
                                 F.max_by(c, order).alias("c"), *more)


def daily_ohlc(bars: DataFrame, tz: str = KST) -> DataFrame:
    """Local-day bars from hourly bars."""
    d = _ohlc(bars, ["item_id", local_day("hour", tz).alias("day")], "o", "h", "l", "c", F.col("hour"),
              F.sum("gold").alias("gold"), F.sum("qty").alias("qty"), F.sum("n").alias("n"))
    return d.withColumn("vwap", ratio(F.col("gold"), F.col("qty")))


def ask_rows(snapshots: DataFrame, basis: str, tiered: str) -> DataFrame:
    """Book snapshots of the tiered category at tier 0 (or untiered) or at the highest tier, with a price."""
    tier = ((F.col("upgrade") == 0) | F.col("upgrade").isNull()) if basis == "ask0" else \
        ((F.col("upgrade") > 0) & (F.col("upgrade") == F.col("upgrade_max")))
    return snapshots.filter((F.col("category") == tiered) & tier & (F.col("min_unit_price") > 0))


def ask_daily_ohlc(snapshots: DataFrame, tiered: str, basis: str = "ask0", tz: str = KST) -> DataFrame:
    """Local-day bars of the lowest ask; the plain mean stands where sales have a weighted one."""
    p = "min_unit_price"
    return _ohlc(ask_rows(snapshots, basis, tiered), ["item_id", local_day("captured_at", tz).alias("day")],
                 p, p, p, p, F.struct("captured_at", "id"), F.avg(p).alias("vwap"), F.lit(0).alias("qty"),
                 F.count(F.lit(1)).alias("n"))


def ask_hourly(snapshots: DataFrame, tiered: str, basis: str, as_of: str, days: int = 7) -> DataFrame:
    recent = snapshots.filter(F.col("captured_at") > hours_ago(as_of, 24 * days))
    return (ask_rows(recent, basis, tiered).groupBy("item_id", hour_of("captured_at").alias("hour"))
            .agg(F.avg("min_unit_price").alias("vwap")).withColumn("qty", F.lit(0).cast("bigint")))


def hourly_series(bars: DataFrame, snapshots: DataFrame, tiered: str, as_of: str, days: int = 7) -> DataFrame:
    """Last week by hour: sale bars, and the mean ask for items priced by their book."""
    sold = (bars.filter((F.col("hour") >= F.date_trunc("hour", hours_ago(as_of, 24 * days)))
                        & (F.col("category") != tiered)).select("item_id", "hour", "vwap", "qty"))
    return sold.unionByName(ask_hourly(snapshots, tiered, "ask0", as_of, days))


def daily_vwap(bars: DataFrame, before: str | Column, tz: str = KST) -> DataFrame:
    """Complete local days only: vwap, quantity and count."""
    day = local_day("hour", tz)
    before = F.lit(before).cast("date") if isinstance(before, str) else before
    return (bars.filter(day < before).groupBy("item_id", day.alias("day"))
            .agg(F.sum("gold").alias("gold"), F.sum("qty").alias("qty"), F.sum("n").alias("n"))
            .select("item_id", "day", ratio(F.col("gold"), F.col("qty")).alias("vwap"), "qty", "n"))


def hour_last(snapshots: DataFrame, cols: Sequence[str], keys: Sequence[str] = ("item_id", "upgrade")) -> DataFrame:
    """The last snapshot of each hour per item and tier."""
    return newest(snapshots.withColumn("hour", hour_of("captured_at")), [*keys, "hour"], ["captured_at", "id"],
                  ["captured_at", *cols])


def ask_daily_18h(snapshots: DataFrame, tiered: str, tz: str = KST, min_hours: int = 18,
                  legacy: bool = False) -> DataFrame:
    """Daily ask from hour-end books; the hour's last row is chosen first and judged after.

    The legacy form drops rows without a price before choosing.
    """
    s = snapshots.filter((F.col("category") == tiered)
                         & ((F.col("upgrade") == 0) | (F.col("upgrade") == F.col("upgrade_max"))))
    if legacy:
        s = s.filter("min_unit_price > 0")
    price = F.when(F.col("min_unit_price") > 0, F.col("min_unit_price"))
    return (hour_last(s, ["min_unit_price"])
            .groupBy("item_id", F.when(F.col("upgrade") == 0, "ask0").otherwise("askMax").alias("basis"),
                     local_day("captured_at", tz).alias("day"))
            .agg(F.when(F.count(price) >= min_hours, F.avg(price)).alias("value"), F.count(price).alias("hours")))


def stock_daily_18h(snapshots: DataFrame, tz: str = KST, min_hours: int = 18) -> DataFrame:
    """Daily mean of the hour-end quantity on offer, untiered books."""
    return (hour_last(snapshots.filter("upgrade IS NULL"), ["total_qty"])
            .groupBy("item_id", local_day("captured_at", tz).alias("day"))
            .agg(F.when(F.count(F.lit(1)) >= min_hours, F.avg("total_qty")).alias("value"),
                 F.count(F.lit(1)).alias("hours")))


def game_day_turnover(bars: DataFrame, items: DataFrame, through: str, tiered: str, days: int = 30, tz: str = KST,
                      boundary_hours: int = 6) -> DataFrame:
    """Completed business days ending before `through`; a day without sales keeps a NULL amount and zero counts."""
    spark = bars.sparkSession
    last = F.date_sub(local_day(as_ts(through), tz, boundary_hours), 1)
    chosen = items.filter(F.col("tracked") & (F.col("category") != tiered)).select("item_id")
    day = local_day("hour", tz, boundary_hours)
    daily = (bars.join(chosen, "item_id", "left_semi").filter((day > F.date_sub(last, days)) & (day <= last))
             .groupBy(day.alias("day"))
             .agg(F.sum("gold").alias("gold"), F.sum("n").alias("trades"),
                  F.count_distinct("item_id").alias("observed_items"), F.count_distinct("hour").alias("observed_hours")))
    spine = spark.range(1).select(F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("day"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return (spine.join(daily, "day", "left")
            .select("day", F.col("gold").cast("double").alias("amount"), zero("trades"), zero("observed_items"),
                    zero("observed_hours")))


def hour_spine(bars: DataFrame, as_of: str, hours: int = 168) -> DataFrame:
    """Every hour of the last week per item; an hour without a bar stays NULL."""
    end = F.date_trunc("hour", as_ts(as_of))
    spine = bars.select("item_id").distinct().select(
        "item_id", F.explode(F.sequence(end - F.expr(f"INTERVAL {hours - 1} HOURS"), end, F.expr("INTERVAL 1 HOUR"))).alias("hour"))
    return spine.join(bars.select("item_id", "hour", "vwap", "qty"), ["item_id", "hour"], "left")


def gap_segments(bars: DataFrame) -> DataFrame:
    """Contiguous observed stretches of hours."""
    segments = runs(bars.select("item_id", "hour"), ["item_id"], hour_number("hour"))
    stamp = lambda c: F.timestamp_seconds(F.col(c) * 3600)
    return segments.select("item_id", stamp("first_step").alias("first_hour"), stamp("last_step").alias("last_hour"),
                           F.col("length").alias("hours"))


def day_spine_state(days: DataFrame, as_of: str, period: int | None = 30, tz: str = KST, basis: str = "trade",
                    min_trades: int = 5, min_hours: int = 18) -> DataFrame:
    """Calendar of one item: missing, unavailable, sparse or ready days; today is partial.

    `days` has item_id, day, value, n and, for floor bases, hours.
    """
    today = local_day(as_ts(as_of), tz)
    first = F.min("day") if period is None else F.greatest(F.min("day"), F.date_sub(today, period - 1))
    spine = days.groupBy("item_id").agg(first.alias("a")).select(
        "item_id", F.explode(F.when(F.col("a") <= today, F.sequence("a", today))).alias("day"))
    j = spine.join(days.withColumn("_seen", F.lit(True)), ["item_id", "day"], "left")
    ask = basis in ("ask", "floor")
    value = F.when(F.col("value") > 0, F.col("value")) if ask else F.col("value")
    thin = (F.col("hours") < min_hours) if basis == "floor" else (F.lit(False) if ask else F.col("n") < min_trades)
    state = (F.when(F.col("_seen").isNull() | (F.lit(ask) & value.isNull()), "missing")
             .when(value.isNull(), "unavailable").when(thin, "sparse").otherwise("ready"))
    return j.select("item_id", "day", value.alias("value"), "n", (F.col("day") >= today).alias("partial"),
                    state.alias("state"))


def period_change(states: DataFrame) -> DataFrame:
    """First against last ready complete day."""
    ready = states.filter(~F.col("partial") & (F.col("state") == "ready") & (F.col("value") > 0))
    return (ready.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("days"), F.min("day").alias("first_day"), F.max("day").alias("last_day"),
        F.min_by("value", "day").alias("first_value"), F.max_by("value", "day").alias("last_value"))
        .filter("days >= 2").withColumn("pct", pct_change(F.col("last_value"), F.col("first_value"))))


def spark14(daily: DataFrame, keep: int = 14) -> DataFrame:
    """The last daily prices of an item as an array in day order; the array is bounded by `keep`."""
    recent = Window.partitionBy("item_id").orderBy(F.desc("day"))
    return (daily.withColumn("_rn", F.row_number().over(recent)).filter(F.col("_rn") <= keep)
            .groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("day", "vwap"))).alias("p"))
            .select("item_id", F.col("p.vwap").alias("spark")))
