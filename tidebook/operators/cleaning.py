"""Outlier rules, cleaned copies and price distributions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidebook.functions.exact import exact_sum, ratio
from tidebook.functions.timeutil import KST, day_number, hour_of, local_day, local_ts
from tidebook.operators.candles import candles_1h
from tidebook.plans.quantiles import exact_quantiles, quantile_columns, ranked_values, value_counts
from tidebook.session import reuse

DAY = ["item_id", "day"]


def _day_prices(trades: DataFrame, tz: str, **carry: Column) -> DataFrame:
    """Sales counted per item, local day and price."""
    counts = value_counts(trades.withColumn("day", local_day("sold_date", tz)), DAY, "unit_price", None,
                          {"q": F.sum("qty"), **carry})
    return reuse(counts)         # read several times by every caller


def cleaning_days(trades: DataFrame, bars: DataFrame, raw_max_id: Column, tiered: str, tz: str = KST) -> DataFrame:
    """Per item-day: unweighted median, totals, whether raw agrees with the bars, and what 10x rules out."""
    known = F.col("id") <= raw_max_id
    hist = _day_prices(trades.filter(F.col("category") != tiered).withColumn("_known", known), tz,
                       en=F.count_if("_known"), eq=F.sum(F.when(F.col("_known"), F.col("qty")).otherwise(0)))
    raw = ranked_values(hist, DAY, "unit_price").groupBy(*DAY).agg(
        *quantile_columns("unit_price", [("median", "linear", 0.5)]), F.sum("_w").alias("observed_n"),
        F.sum("q").alias("observed_qty"), F.sum("en").alias("en"), F.sum("eq").alias("eq"))
    expected = (bars.filter(F.col("category") != tiered).groupBy("item_id", local_day("hour", tz).alias("day"))
                .agg(F.sum("n").alias("xn"), F.sum("qty").alias("xq")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    days = raw.join(expected, DAY, "full_outer").select(
        *DAY, "median", zero("observed_n").alias("observed_n"), zero("observed_qty").alias("observed_qty"),
        F.coalesce((F.col("en") == zero("xn")) & (F.col("eq") == zero("xq")), F.lit(False)).alias("verified"))
    outside = (F.col("unit_price") < F.col("median") / 10) | (F.col("unit_price") > F.col("median") * 10)
    out = (hist.join(days.filter("verified").select(*DAY, "median"), DAY).filter(outside)
           .groupBy(*DAY).agg(F.sum("_w").alias("_xn"), F.sum("q").alias("_xq")))
    return days.join(out, DAY, "left").select(
        *days.columns, zero("_xn").alias("excluded_n"), zero("_xq").alias("excluded_qty"))


def clean_trades(trades: DataFrame, days: DataFrame, tiered: str, tz: str = KST) -> DataFrame:
    """Sales within a factor of ten of the day's median on verified days; book-priced items pass as they are."""
    dated = trades.withColumn("day", local_day("sold_date", tz))
    inside = F.col("unit_price").between(F.col("median") / 10, F.col("median") * 10)
    sold = (dated.filter(F.col("category") != tiered)
            .join(days.filter("verified").select(*DAY, "median"), DAY).filter(inside))
    return dated.filter(F.col("category") == tiered).unionByName(sold.drop("median")).drop("day")


def clean_candles(trades: DataFrame, days: DataFrame, raw_max_id: Column, tiered: str, tz: str = KST) -> DataFrame:
    return candles_1h(clean_trades(trades.filter(F.col("id") <= raw_max_id), days, tiered, tz))


def cleaning_summary(days: DataFrame) -> DataFrame:
    return days.agg(F.sum("excluded_n").alias("excluded_trades"), F.sum("excluded_qty").alias("excluded_qty"),
                    F.count_if(~F.col("verified")).alias("unverified_days"), F.count(F.lit(1)).alias("days"))


# The outlier rules compared side by side.
METHODS = ["raw", "iqr", "mad", "zscore", "trade10x"]


def outlier_methods(trades: DataFrame, tz: str = KST) -> DataFrame:
    """Each rule's kept counts and price per item-day; a rule without spread keeps everything.

    All rules work on the per-price counts, so raw sales are shuffled once.
    """
    hist = _day_prices(trades, tz)
    base = ranked_values(hist, DAY, "unit_price").groupBy(*DAY).agg(
        *quantile_columns("unit_price", [("q1", "linear", .25), ("median", "linear", .5), ("q3", "linear", .75)]),
        F.sum("_w").alias("n"), F.sum("q").alias("qty"), F.min("unit_price").alias("low"),
        F.max("unit_price").alias("high"), exact_sum(F.col("unit_price") * F.col("_w")).alias("_s"))
    base = base.withColumn("mu", ratio(F.col("_s"), F.col("n"))).drop("_s")
    u, away = F.col("unit_price").cast("double"), F.abs(F.col("unit_price") - F.col("median"))
    h = hist.join(base, DAY).withColumn("dev", away)
    spread = ranked_values(value_counts(h, DAY, "dev", "_w", {"_v": F.sum(F.col("_w") * F.pow(u - F.col("mu"), 2))}),
                           DAY, "dev")
    spread = spread.groupBy(*DAY).agg(*quantile_columns("dev", [("mad", "linear", .5)]),
                                      F.sqrt(F.sum("_v") / F.max("_n")).alias("sd"))
    iqr = F.col("q3") - F.col("q1")
    keep = {
        "raw": F.lit(True),
        "iqr": (iqr == 0) | u.between(F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr),
        "mad": (F.col("mad") == 0) | (F.col("dev") <= 3 * 1.4826 * F.col("mad")),
        "zscore": (F.col("sd") == 0) | (F.abs(u - F.col("mu")) <= 3 * F.col("sd")),
        "trade10x": u.between(F.col("median") / 10, F.col("median") * 10),
    }
    rules = F.array(*[F.struct(F.lit(m).alias("method"), keep[m].alias("keep")) for m in METHODS])
    rows = (h.join(spread, DAY).select(*DAY, "unit_price", "_w", "q", "n", "qty", "median", "low", "high",
                                       F.explode(rules).alias("r")))
    gold = F.col("unit_price") * F.col("q")
    return (rows.groupBy(*DAY, F.col("r.method").alias("method"))
            .agg(F.max("n").alias("n"), F.max("qty").alias("qty"), F.max("median").alias("median"),
                 F.max("low").alias("low"), F.max("high").alias("high"), exact_sum(gold).alias("_g"),
                 F.coalesce(F.sum(F.when(F.col("r.keep"), F.col("_w"))), F.lit(0)).alias("kept_n"),
                 F.coalesce(F.sum(F.when(F.col("r.keep"), F.col("q"))), F.lit(0)).alias("kept_qty"),
                 exact_sum(gold, F.col("r.keep")).alias("_kg"))
            .withColumn("original", ratio(F.col("_g"), F.col("qty")))
            .withColumn("cleaned", ratio(F.col("_kg"), F.col("kept_qty"))).drop("_g", "_kg"))


def cleaned_join_verify(archive: DataFrame, live: DataFrame, prior: DataFrame, cut: str,
                        tolerance: float = 1e-8) -> DataFrame:
    """Join two periods at `cut`; item-days whose raw totals differ from the prior record leave every rule."""
    c = F.lit(cut).cast("date")
    rows = archive.filter(F.col("day") < c).unionByName(live.filter(F.col("day") >= c))
    p = prior.select(*DAY, F.col("vwap").alias("_v"), F.col("n").alias("_n"), F.col("qty").alias("_q"))
    differs = ((F.col("_n") != F.col("n")) | (F.col("_q") != F.col("qty"))
               | (F.abs(F.col("_v") / F.col("original") - 1) > tolerance))
    bad = rows.filter("method = 'raw'").join(p, DAY).filter(differs).select(*DAY)
    return rows.join(bad, DAY, "left_anti")


def train21_cases(rows: DataFrame, train_days: int = 21, min_n: int = 5) -> DataFrame:
    """Target days preceded by an unbroken run of usable training days."""
    use = rows.filter((F.col("method") == "trade10x") & (F.col("kept_n") >= min_n) & (F.col("cleaned") > 0))
    use = use.withColumn("_d", day_number("day"))
    w = Window.partitionBy("item_id").orderBy("_d").rangeBetween(-train_days, -1)      # one row per day
    return (use.withColumn("train_n", F.count(F.lit(1)).over(w)).withColumn("train_mean", F.avg("cleaned").over(w))
            .filter(F.col("train_n") == train_days)
            .select("item_id", "day", F.date_sub("day", train_days).alias("train_from"), "train_mean",
                    F.col("cleaned").alias("actual")))


def local_bucket(ts: Column, kind: str, tz: str) -> Column:
    if kind == "hour":
        return F.date_trunc("hour", ts)
    start = F.date_trunc("day", local_ts(ts, tz))
    return start if tz == "UTC" else F.to_utc_timestamp(start, tz)


def weighted_quantiles(trades: DataFrame, bars: DataFrame, items: DataFrame, raw_max_id: Column, tiered: str,
                       tz: str = KST) -> DataFrame:
    """Quantity-weighted quartiles per item at day and hour grain; NULL unless raw totals agree with the bars.

    Sales are counted once per (item, hour, price) and only those counts are folded into the two grains.
    """
    chosen = items.filter(F.col("tracked") & (F.col("category") != tiered)).select("item_id")
    keys = ["item_id", "kind", "bucket"]
    grains = lambda ts: F.explode(F.array(*[
        F.struct(F.lit(k).alias("kind"), local_bucket(ts, k, tz).alias("bucket")) for k in ("day", "hour")])).alias("g")
    fine = (trades.filter((F.col("id") <= raw_max_id)).join(chosen, "item_id", "left_semi")
            .groupBy("item_id", hour_of("sold_date").alias("hour"), "unit_price")
            .agg(F.sum("qty").alias("q"), F.count(F.lit(1)).alias("n")))
    hist = (fine.select("item_id", grains(F.col("hour")), "unit_price", "q", "n")
            .select("item_id", "g.*", "unit_price", "q", "n"))
    hist = reuse(value_counts(hist, keys, "unit_price", "q", {"_c": F.sum("n")}))
    got = ranked_values(hist, keys, "unit_price").groupBy(*keys).agg(
        *quantile_columns("unit_price", [("q25", "weighted", .25), ("median", "weighted", .5), ("q75", "weighted", .75)]),
        F.sum("_c").alias("rn"), F.sum("_w").alias("rq"), F.min("unit_price").alias("rl"), F.max("unit_price").alias("rh"))
    want = (bars.join(chosen, "item_id", "left_semi").select("item_id", grains(F.col("hour")), "n", "qty", "l", "h", "gold")
            .select("item_id", "g.*", "n", "qty", "l", "h", "gold").groupBy(*keys)
            .agg(F.sum("n").alias("n"), F.sum("qty").alias("qty"), F.min("l").alias("l"), F.max("h").alias("h"),
                 F.sum("gold").alias("gold")))
    agrees = F.struct("rn", "rq", "rl", "rh") == F.struct("n", "qty", "l", "h")
    return want.join(got, keys, "left").select(
        *keys, "n", "qty", "l", "h", ratio(F.col("gold"), F.col("qty")).alias("vwap"),
        *[F.when(agrees, F.col(q)).alias(q) for q in ("q25", "median", "q75")])


def quantile_family(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The rank rules side by side on one group."""
    return exact_quantiles(df, keys, value, [
        ("floor_p10", "floor", .1), ("floor_median", "floor", .5), ("linear_p25", "linear", .25),
        ("mid_median", "linear", .5), ("linear_p80", "linear", .8), ("upper_p90", "floor_n1", .9)])
