"""Daily forecasts, rolling backtests and their scores.

A series is one row per item and day. Everything a forecast of day t may know is carried as running totals
over the days before t, so the backtest of a series costs one pass per item and no origin sees the future.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tidebook.functions.timeutil import day_number, iso_dow

K = range(1, 8)
MIN_DAYS, MIN_PER_DAY, WIDEN = 10, 5, 0.45


def panel(daily: DataFrame, before: str) -> DataFrame:
    """Calendar of every item up to and including `before`, with what was known before each day.

    `daily` has item_id, day, vwap, n. The spine runs from the item's first day, so a day without sales is
    still a possible origin. `first_y` is the value of the item's first day, which is no origin itself.
    """
    z = F.lit(before).cast("date")
    d = daily.filter((F.col("day") < z) & (F.col("vwap") > 0)).select("item_id", "day", "vwap", "n")
    spine = d.groupBy("item_id").agg(F.min("day").alias("first_day"), F.max("day").alias("end_day"))
    spine = spine.withColumn("day", F.explode(F.sequence("first_day", z)))
    p = spine.join(d, ["item_id", "day"], "left")
    p = p.withColumns({"x": F.when(F.col("vwap").isNotNull(), F.datediff("day", "first_day").cast("double")), "y": F.log("vwap"), "k": iso_dow("day")})
    w = Window.partitionBy("item_id").orderBy("day")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    s = lambda c: F.sum(c).over(past)
    seen = F.col("vwap").isNotNull()
    out = {
        "obs": F.count("vwap").over(past), "trades": s("n"), "sum_v": s("vwap"), "sx": s("x"), "sxx": s(F.col("x") * F.col("x")),
        "sy": s("y"), "sxy": s(F.col("x") * F.col("y")), "last_day": F.max(F.when(seen, F.col("day"))).over(past),
        "last_value": F.last("vwap", ignorenulls=True).over(past),
        "first_y": F.first("y").over(past),
    }
    for k in K:
        on = F.col("k") == k
        out.update({f"n{k}": F.count(F.when(on, F.col("vwap"))).over(past), f"x{k}": s(F.when(on, F.col("x"))), f"y{k}": s(F.when(on, F.col("y")))})
    return p.withColumns(out).withColumnRenamed("day", "origin").filter("obs > 0")


def weekday_coeffs(known: DataFrame, min_span: int = 14, min_trades: int = 25) -> DataFrame:
    """Centred mean log deviation by weekday, per origin, over the items that qualified by then."""
    ok = known.filter((F.datediff("last_day", "first_day") > min_span) & (F.col("trades") >= min_trades))
    level = F.log(F.col("sum_v") / F.col("obs"))
    long = ok.select("origin", F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), F.col(f"n{k}").alias("n"), (F.coalesce(f"y{k}", F.lit(0.0)) - F.col(f"n{k}") * level).alias("s")) for k in K])).alias("e"))
    c = long.groupBy("origin", "e.k").agg(F.sum("e.n").alias("n"), F.sum("e.s").alias("_s")).filter("n > 0").withColumn("_c", F.col("_s") / F.col("n"))
    return c.select("origin", "k", "n", (F.col("_c") - F.avg("_c").over(Window.partitionBy("origin"))).alias("coef"))


def _eligible() -> Column:
    return (F.col("obs") >= MIN_DAYS) & (F.col("trades") / (F.datediff("last_day", "first_day") + 1) >= MIN_PER_DAY)


def _fit(sy: Column, sxy: Column) -> tuple[Column, Column]:
    """Least-squares level and slope; no spread in x gives slope 0."""
    n, sx = F.col("obs"), F.col("sx")
    den = n * F.col("sxx") - sx * sx
    slope = F.when(den != 0, (n * sxy - sx * sy) / den).otherwise(0.0)
    return (sy - slope * sx) / n, slope


def _residual_bounds(key, origins: pd.DataFrame, train: pd.DataFrame) -> pd.DataFrame:
    """Lower and upper residual of every origin of an item, of the days known before it.

    The fit, so every residual, changes with the origin; an origin takes its two order statistics from one vector of the
    item's days. Nothing is kept per origin but the result.
    """
    train = train.sort_values("day")
    day, x, y, k = (train[c].to_numpy() for c in ("day", "x", "y", "k"))
    low, high = [], []
    for o in origins.itertuples(index=False):
        n = int(np.searchsorted(day, np.datetime64(o.origin)))
        coef = np.array([getattr(o, f"c{i}") for i in K])
        r = y[:n] - coef[k[:n] - 1] - (o.a + o.b * x[:n])
        at = [min(int(np.floor(n * q)), n - 1) for q in (0.1, 0.9)]
        r.partition(at)
        low.append(r[at[0]])
        high.append(r[at[1]])
    return origins.assign(r_lo=low, r_hi=high)


def predict(known: DataFrame, coeffs: DataFrame, horizons: Sequence[int], full: DataFrame) -> DataFrame:
    """Trend plus weekday forecasts with their band, and the plain trend, for every origin in `known`.

    `full` is the whole panel, whose days train the origins after them: one row a day, at most as many an item as the calendar has.
    """
    wide = coeffs.groupBy("origin").agg(*[F.max(F.when(F.col("k") == k, F.col("coef"))).alias(f"c{k}") for k in K])
    p = known.filter(_eligible()).join(wide, "origin", "left").withColumns({f"c{k}": F.coalesce(f"c{k}", F.lit(0.0)) for k in K})
    nil = lambda name: F.coalesce(name, F.lit(0.0))
    adj = sum((F.col(f"c{k}") * F.col(f"n{k}") for k in K), F.lit(0.0))
    adjx = sum((F.col(f"c{k}") * nil(f"x{k}") for k in K), F.lit(0.0))
    a, b = _fit(F.col("sy") - adj, F.col("sxy") - adjx)
    a0, b0 = _fit(F.col("sy"), F.col("sxy"))
    p = p.select("item_id", "origin", "first_day", "last_day", "last_value", a.alias("a"), b.alias("b"), a0.alias("a0"), b0.alias("b0"), *[f"c{k}" for k in K])
    days = full.filter("y IS NOT NULL").select(F.col("item_id").alias("item"), F.col("origin").alias("day"), "x", "y", "k")
    start = full.groupBy(F.col("item_id").alias("item")).agg(F.min("first_day").alias("day"), F.min("first_y").alias("y"))
    train = days.unionByName(start.select("item", "day", F.lit(0.0).alias("x"), "y", iso_dow("day").alias("k")))
    text = p.withColumns({c: F.col(c).cast("timestamp") for c in ("origin", "first_day", "last_day")})
    schema = T.StructType([*text.schema.fields, T.StructField("r_lo", T.DoubleType()), T.StructField("r_hi", T.DoubleType())])
    p = (text.groupBy("item_id").cogroup(train.withColumn("day", F.col("day").cast("timestamp")).groupBy("item")).applyInPandas(_residual_bounds, schema)
         .withColumns({c: F.to_date(c) for c in ("origin", "first_day", "last_day")}))
    c = lambda k: F.element_at(F.array(*[F.col(f"c{i}") for i in K]), k.cast("int"))
    p = p.withColumn("h", F.explode(F.array(*[F.lit(h) for h in horizons]))).withColumn("d", F.date_add("origin", F.col("h")))
    x = F.datediff("d", "first_day")
    p = p.withColumn("base", F.col("a") + F.col("b") * x + c(iso_dow("d")))
    width = 1 + WIDEN * (F.greatest(F.lit(1), F.datediff("d", "last_day")) - 1)
    return p.select("item_id", "origin", "h", "d", F.exp("base").alias("mid"), F.exp(F.col("base") + F.col("r_lo") * width).alias("lo"),
                    F.exp(F.col("base") + F.col("r_hi") * width).alias("hi"), F.col("last_value").alias("naive"),
                    F.exp(F.col("a0") + F.col("b0") * x).alias("trend"))


def trend_weekday_forecast(daily: DataFrame, origin: str, horizons: int = 7) -> DataFrame:
    """Forecast path of every eligible item from one origin."""
    full = panel(daily, origin)
    known = full.filter(F.col("origin") == F.lit(origin).cast("date"))
    return predict(known, weekday_coeffs(known), list(range(1, horizons + 1)), full)


def _origins(known: DataFrame) -> DataFrame:
    """Days after the tenth observation and before the item's last one."""
    return known.filter((F.col("obs") >= MIN_DAYS) & (F.col("origin") < F.col("end_day")))


def rolling_backtest(daily: DataFrame, before: str, horizons: Sequence[int] = (1, 7)) -> DataFrame:
    """One case per origin and horizon whose exact target day was observed."""
    known = panel(daily, before)
    actual = daily.filter(F.col("day") < F.lit(before).cast("date")).select("item_id", F.col("day").alias("d"), F.col("vwap").alias("actual"))
    return predict(_origins(known), weekday_coeffs(known), horizons, known).join(actual, ["item_id", "d"])


def forecast_score(cases: DataFrame, keys: Sequence[str] = ("h",), mid: str = "mid") -> DataFrame:
    """Error against the observed value, against holding the last value, and coverage of the band."""
    ape = lambda c: F.avg(F.abs(F.col(c) - F.col("actual")) / F.col("actual")) * 100
    s = cases.groupBy(*keys).agg(F.count(F.lit(1)).alias("cases"), ape(mid).alias("mape"), ape("naive").alias("naive_mape"),
                                 (F.avg(F.col("actual").between(F.col("lo"), F.col("hi")).cast("int")) * 100).alias("coverage"))
    return s.withColumn("vs_naive", F.when(F.col("naive_mape") > 0, (F.col("naive_mape") - F.col("mape")) / F.col("naive_mape") * 100))


def _expanding_quantile(frame: pd.DataFrame, q: float) -> pd.DataFrame:
    """Number and interpolated quantile of the moves before each day of an item, kept in one sorted vector."""
    frame = frame.sort_values("origin")
    kept, n, counts, widths = np.empty(len(frame)), 0, [], []
    for move in frame["move"].to_numpy():
        at = (n - 1) * q
        low = int(at) if n else 0
        widths.append(kept[low] + (kept[min(low + 1, n - 1)] - kept[low]) * (at - low) if n else None)
        counts.append(n)
        if not np.isnan(move):
            place = int(np.searchsorted(kept[:n], move))
            kept[place + 1:n + 1] = kept[place:n].copy()
            kept[place] = move
            n += 1
    return frame.assign(moves=counts, width=pd.array(widths, dtype="Float64"))[["item_id", "origin", "moves", "width"]]


def naive_band(daily: DataFrame, before: str, horizons: Sequence[int], rolling: bool, min_changes: int = 8) -> DataFrame:
    """Last value with a band of the 80th percentile of daily moves, widened by the square root of the distance.

    `rolling` gives the scored history, otherwise the path from `before` itself. The percentile of all earlier moves is an
    order statistic of an expanding window: a day adds one move to the item's sorted vector, so an item takes as many
    numbers as it has days, whatever the number of origins.
    """
    known = panel(daily, before)
    w = Window.partitionBy("item_id").orderBy("origin")
    y = F.when(F.col("origin") == F.date_add("first_day", 1), F.coalesce(F.lag("y").over(w), F.col("first_y"))).otherwise(F.lag("y").over(w))
    moved = known.withColumn("move", F.abs(F.col("y") - y))    # spine rows are consecutive days; a missing day gives NULL
    stats = (moved.select("item_id", F.col("origin").cast("timestamp").alias("origin"), "move").groupBy("item_id")
             .applyInPandas(lambda f: _expanding_quantile(f, 0.8), "item_id string, origin timestamp, moves bigint, width double")
             .withColumn("origin", F.to_date("origin")))
    j = known.join(stats, ["item_id", "origin"]).filter(_eligible() & (F.col("moves") >= min_changes))
    j = _origins(j) if rolling else j.filter(F.col("origin") == F.lit(before).cast("date"))
    j = j.withColumn("h", F.explode(F.array(*[F.lit(h) for h in horizons]))).withColumn("d", F.date_add("origin", F.col("h")))
    scale = F.sqrt(F.greatest(F.lit(1), F.datediff("d", "last_day")))
    v = F.col("last_value")
    out = j.select("item_id", "origin", "h", "d", v.alias("mid"), (v * F.exp(-F.col("width") * scale)).alias("lo"), (v * F.exp(F.col("width") * scale)).alias("hi"), v.alias("naive"))
    if not rolling:
        return out
    actual = daily.filter(F.col("day") < F.lit(before).cast("date")).select("item_id", F.col("day").alias("d"), F.col("vwap").alias("actual"))
    return out.join(actual, ["item_id", "d"])


def compare_models(cases: DataFrame) -> DataFrame:
    """Case- and item-weighted error of holding, trend and trend with weekdays on the same cases."""
    long = cases.select("item_id", "h", "actual", F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), F.col(c).alias("value")) for m, c in (("naive", "naive"), ("trend", "trend"), ("weekday", "mid"))])).alias("m"))
    item = long.groupBy("h", "m.model", "item_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.abs(F.col("m.value") - F.col("actual")) / F.col("actual") * 100).alias("s"))
    trend = item.filter("model = 'trend'").select("h", "item_id", (F.col("s") / F.col("n")).alias("t"))
    j = item.withColumn("mape", F.col("s") / F.col("n")).join(trend, ["h", "item_id"])
    gap = F.col("mape") - F.col("t")
    return j.groupBy("h", "model").agg(
        F.sum("n").alias("cases"), F.count(F.lit(1)).alias("items"), (F.sum("s") / F.sum("n")).alias("case_mape"), F.avg("mape").alias("item_mape"),
        F.count_if(gap < -1e-9).alias("better"), F.count_if(F.abs(gap) <= 1e-9).alias("tied"), F.count_if(gap > 1e-9).alias("worse"))


def basket_index(values: DataFrame, members: DataFrame) -> DataFrame:
    """Fixed-base equal-weight index; NULL on a day when any member is missing.

    `values` has item_id, day, value; `members` has basket, item_id, base.
    """
    size = members.groupBy("basket").agg(F.count(F.lit(1)).alias("size"))
    ok = F.when(F.col("value") > 0, F.col("value") / F.col("base") * 100)
    j = values.join(members, "item_id").groupBy("basket", "day").agg(F.count(ok).alias("coverage"), F.avg(ok).alias("_v")).join(size, "basket")
    return j.select("basket", "day", F.when(F.col("coverage") == F.col("size"), F.col("_v")).alias("value"), "coverage")


def basket_members(values: DataFrame, members: DataFrame) -> DataFrame:
    """Each member's own series on the basket's base."""
    return values.join(members, "item_id").select("basket", "item_id", "day", (F.col("value") / F.col("base") * 100).alias("value"))


def research_series(floors: DataFrame, baskets: DataFrame, before: str, min_hours: int = 18) -> DataFrame:
    """The study panel: lowest and p10 floors (NULL on thin days) and the basket indexes, before the open day."""
    z = F.lit(before).cast("date")
    f = floors.filter(F.col("day") < z)
    thin = lambda c, name: f.select(F.lit(name).alias("series"), "day", F.when(F.col("hours") >= min_hours, F.col(c)).alias("value"), F.col("hours").alias("coverage"))
    return thin("min", "floor-min").unionByName(thin("p10", "floor-p10")).unionByName(
        baskets.filter(F.col("day") < z).select(F.col("basket").alias("series"), "day", "value", "coverage"))


def issue_forecast(series: DataFrame, origins: DataFrame, window: int = 56, least: int = 4, horizons: int = 7) -> DataFrame:
    """Hold, same-weekday and trend-with-weekdays predictions per series and origin.

    Trend and weekday levels are fitted together: removing each weekday's own mean leaves one slope. Only
    origins whose day before was observed issue; the fit needs `least` observations of every weekday.
    """
    obs = series.filter(F.col("value") > 0).select("series", "day", "value")
    t = obs.withColumn("origin", F.explode(F.transform(F.sequence(F.lit(1), F.lit(window)), lambda i: F.date_add("day", i)))).join(origins, "origin", "left_semi")
    t = t.withColumns({"x": F.datediff("day", "origin").cast("double"), "y": F.log("value"), "k": iso_dow("day")})
    by_k = t.groupBy("series", "origin", "k").agg(
        F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("x")).alias("sxx"),
        F.sum(F.col("x") * F.col("y")).alias("sxy"), F.max("day").alias("last_day"), F.max_by("value", "day").alias("last_value"))
    num, den = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n"), F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
    fit = by_k.groupBy("series", "origin").agg(
        F.when((F.count(F.lit(1)) == 7) & (F.min("n") >= least) & (F.sum(den) > 1e-10), F.sum(num) / F.sum(den)).alias("slope"),
        F.max("last_day").alias("last_day"), F.max_by("last_value", "last_day").alias("last_value"),
        F.map_from_entries(F.collect_list(F.struct("k", F.struct((F.col("sx") / F.col("n")).alias("mx"), (F.col("sy") / F.col("n")).alias("my"))))).alias("lv"))
    fit = fit.filter(F.col("last_day") == F.date_sub("origin", 1)).withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizons)))).withColumn("d", F.date_add("origin", F.col("h")))
    weeks_back = F.ceil(F.col("h") / 7) if horizons != 7 else F.lit(1)
    back = F.when(F.col("h") % 7 == 0, 7 * (weeks_back + 1)).otherwise(7 * weeks_back)
    fit = fit.withColumn("seasonal_day", F.date_sub("d", back.cast("int")))
    prior = obs.select("series", F.col("day").alias("seasonal_day"), F.col("value").alias("seasonal"))
    fit = fit.join(prior, ["series", "seasonal_day"], "left")
    seasonal = F.when(F.col("seasonal_day") >= F.date_sub("origin", window), F.col("seasonal"))
    level = F.element_at("lv", iso_dow("d"))
    weekday = F.exp(level["my"] + F.col("slope") * (F.col("h") - level["mx"]))
    rows = F.filter(F.array(F.struct(F.lit("naive").alias("model"), F.col("last_value").alias("value")),
                            F.struct(F.lit("seasonal").alias("model"), seasonal.alias("value")),
                            F.struct(F.lit("weekday").alias("model"), weekday.alias("value"))), lambda s: s["value"] > 0)
    return fit.select("series", "origin", "h", "d", F.explode(rows).alias("m")).select("series", "origin", "h", "d", "m.model", "m.value")


def score_issues(predictions: DataFrame, actuals: DataFrame) -> DataFrame:
    """Error per horizon and model on settled values, beside holding on the same cases.

    `actuals` has series, d, value (NULL when the target was never observed).
    """
    a = actuals.filter("value > 0").select("series", "d", F.col("value").alias("actual"))
    p = predictions.filter(F.col("h").isin(1, 7))
    base = p.filter("model = 'naive'").select("series", "origin", "h", F.col("value").alias("hold"))
    j = p.join(base, ["series", "origin", "h"]).join(a, ["series", "d"])
    ape = lambda c: F.avg(F.abs(F.col(c) / F.col("actual") - 1)) * 100
    return j.groupBy("series", "h", "model").agg(F.count(F.lit(1)).alias("n"), ape("value").alias("mape"), ape("hold").alias("naive_mape"))
