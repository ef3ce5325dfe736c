"""Hourly model studies: holdout, ridge regressions on lagged features, joint and full-day paths.

Samples are bars (one per item and hour). Training sums of every origin come from windows over the item's
hours, so no sample is paired with its training rows; only the small normal equations leave the JVM.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidebook.functions.timeutil import KST, as_ts, hour_number, local_day, local_ts
from tidebook.plans.quantiles import exact_quantiles
from tidebook.session import reuse

GROWTH = [0.0, 0.02, 0.05, 0.1]


def _split(bars: DataFrame) -> DataFrame:
    """Mark the last 30 % of an item's bars (24 at most) as test; short series take no part."""
    order = Window.partitionBy("item_id").orderBy("hour")
    b = bars.filter("vwap > 0").select("item_id", "hour", "vwap").withColumn("i", F.row_number().over(order)).withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("item_id")))
    test = F.least(F.lit(24), F.floor(F.col("m") * 0.3))
    return reuse(b.withColumn("test", test).filter((F.col("m") >= 24) & (F.col("m") - F.col("test") >= 16) & (F.col("test") >= 6))
            .withColumn("train", F.col("i") <= F.col("m") - F.col("test")))


def holdout_cases(bars: DataFrame, tz: str = KST) -> DataFrame:
    """Line plus pooled hour-of-day levels fitted on the training part, applied to the test part."""
    s = _split(bars).withColumn("y", F.log("vwap")).withColumn("clock", F.hour(local_ts("hour", tz)))
    item = Window.partitionBy("item_id")
    s = s.withColumn("x", hour_number("hour") - F.min(hour_number("hour")).over(item))
    tr = s.filter("train").withColumn("dev", F.col("y") - F.avg("y").over(item))
    levels = tr.groupBy("clock").agg(F.avg("dev").alias("c"))
    centre = levels.agg((F.sum("c") / 24).alias("v")).scalar()
    # An hour never seen in training has level 0 before centring.
    levels = levels.withColumn("coef", F.col("c") - centre).drop("c")
    s = s.join(levels, "clock", "left").withColumn("coef", F.coalesce(F.col("coef"), -F.coalesce(centre, F.lit(0.0))))
    t = s.filter("train").withColumn("d", F.col("y") - F.col("coef"))
    fit = t.groupBy("item_id").agg(F.coalesce(F.regr_slope("d", "x"), F.lit(0.0)).alias("b"), F.avg("d").alias("_md"), F.avg("x").alias("_mx"),
                                   F.max("x").alias("last_x"), F.max_by("vwap", "x").alias("last_price"))
    fit = fit.withColumn("a", F.col("_md") - F.col("b") * F.col("_mx"))
    resid = t.join(fit.select("item_id", "a", "b"), "item_id").withColumn("r", F.col("d") - F.col("a") - F.col("b") * F.col("x"))
    q = exact_quantiles(resid, ["item_id"], "r", [("r_lo", "floor", .1), ("r_hi", "floor", .9)], splits=64)
    out = s.filter(~F.col("train")).join(fit, "item_id").join(q, "item_id")
    out = out.withColumn("base", F.col("a") + F.col("b") * F.col("x") + F.col("coef"))
    return out.select("item_id", "hour", F.col("vwap").alias("actual"), F.exp("base").alias("predicted"), F.col("last_price").alias("naive"), "base",
                      F.greatest(F.lit(1), F.col("x") - F.col("last_x")).alias("elapsed"), "r_lo", "r_hi")


def hourly_holdout(cases: DataFrame) -> DataFrame:
    """Test error per item, model and holding."""
    ape = lambda c: F.avg(F.abs(F.col(c) - F.col("actual")) / F.col("actual")) * 100
    return cases.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), ape("predicted").alias("model_mape"), ape("naive").alias("naive_mape"))


def holdout_coverage(cases: DataFrame) -> DataFrame:
    """Coverage of the residual band for each growth of its width, the one nearest 80 % marked."""
    c = cases.withColumn("growth", F.explode(F.array(*[F.lit(g) for g in GROWTH])))
    width = 1 + F.col("growth") * (F.col("elapsed") - 1)
    inside = F.col("actual").between(F.exp(F.col("base") + F.col("r_lo") * width), F.exp(F.col("base") + F.col("r_hi") * width))
    g = c.groupBy("growth").agg(F.count(F.lit(1)).alias("n"), (F.count_if(inside) / F.count(F.lit(1)) * 100).alias("coverage"))
    best = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.abs(F.col("coverage") - 80), "growth"))
    return g.withColumn("chosen", best == 1)


def gram_columns(xs: Sequence[str], y: str, window) -> dict[str, Column]:
    """Training sums over a window: count, sums, squares and cross products (rows without `y` do not count)."""
    ok = F.col(y).isNotNull()
    s = lambda e: F.coalesce(F.sum(F.when(ok, e)).over(window), F.lit(0.0))
    cols = {"g_n": F.count(y).over(window), "g_y": s(F.col(y))}
    for i, a in enumerate(xs):
        cols[f"g_{i}"] = s(F.col(a))
        cols[f"g_{i}y"] = s(F.col(a) * F.col(y))
        for j in range(i, len(xs)):
            cols[f"g_{i}_{j}"] = s(F.col(a) * F.col(xs[j]))
    return cols


def gram_names(xs: Sequence[str]) -> list[str]:
    d = range(len(xs))
    return ["g_n", "g_y", *[f"g_{i}" for i in d], *[f"g_{i}y" for i in d], *[f"g_{i}_{j}" for i in d for j in d if j >= i]]


def _solver_names(d: int) -> list[str]:
    return gram_names([""] * d)


def _day_sums(xs: Sequence[str], y: str, near: bool) -> list[Column]:
    """The training sums of one day, for samples that end by the next origin or for the later ones."""
    tag = "near" if near else "far"
    ok = F.col(y).isNotNull() & (F.col("near") == F.lit(near))
    s = lambda e, n: F.sum(F.when(ok, e)).alias(f"{n}_{tag}")
    cols = [s(F.lit(1.0), "g_n"), s(F.col(y), "g_y"), F.min(F.when(ok, F.col("t"))).alias(f"t_lo_{tag}"), F.max(F.when(ok, F.col("t"))).alias(f"t_hi_{tag}")]
    for i, a in enumerate(xs):
        cols += [s(F.col(a), f"g_{i}"), s(F.col(a) * F.col(y), f"g_{i}y")]
        cols += [s(F.col(a) * F.col(xs[j]), f"g_{i}_{j}") for j in range(i, len(xs))]
    return cols


def ridge_path(df: DataFrame, xs: Sequence[str], penalty: float = 1.0) -> DataFrame:
    """Add _p1, _p2, …: predictions of ridge fits on the first one, two, … standardised features.

    `df` has the training sums of `gram_columns` and the features. The normal equations are eliminated in column arithmetic,
    symmetrically and feature by feature: with u and w the eliminated right side and features and d the pivots, the fit on
    the first k features predicts mean(y) plus the first k terms of u w / d, so one elimination serves all of them.
    """
    d, n = range(len(xs)), F.when(F.col("g_n") > 0, F.col("g_n"))
    g = df.withColumns({"_p0": F.col("g_y") / n, **{f"_m{i}": F.col(f"g_{i}") / n for i in d}})
    spread = {i: F.sqrt(F.greatest(F.col(f"g_{i}_{i}") - n * F.col(f"_m{i}") * F.col(f"_m{i}"), F.lit(0.0)) / n) for i in d}
    g = g.withColumns({f"_s{i}": F.when(spread[i] > 0, spread[i]).otherwise(1.0) for i in d})
    m, s = [F.col(f"_m{i}") for i in d], [F.col(f"_s{i}") for i in d]
    cell = lambda i, j: (F.col(f"g_{i}_{j}") - n * m[i] * m[j]) / (s[i] * s[j]) + (penalty if i == j else 0.0)
    g = g.withColumns({**{f"_a{i}{j}": cell(i, j) for i in d for j in d if j >= i},
                       **{f"_u{i}": (F.col(f"g_{i}y") - n * m[i] * F.col("_p0")) / s[i] for i in d},
                       **{f"_w{i}": (F.col(xs[i]) - m[i]) / s[i] for i in d}})
    for k in d:
        pivot = F.col(f"_a{k}{k}")
        share = {j: F.col(f"_a{k}{j}") / pivot for j in d if j > k}
        step = {f"_p{k + 1}": F.col(f"_p{k}") + F.col(f"_u{k}") * F.col(f"_w{k}") / pivot}
        step |= {f"_a{i}{j}": F.col(f"_a{i}{j}") - share[i] * F.col(f"_a{k}{j}") for i in share for j in share if j >= i}
        step |= {f"_{c}{j}": F.col(f"_{c}{j}") - share[j] * F.col(f"_{c}{k}") for c in "uw" for j in share}
        g = g.withColumns(step)
    return g.drop(*[f"_{c}{i}" for c in "msuw" for i in d], *[f"_a{i}{j}" for i in d for j in d if j >= i], "_p0")


def ridge_value(xs: Sequence[str], penalty: float = 1.0) -> Column:
    """Prediction of a ridge fit on standardised features from the training sums of `gram_columns`."""
    d = len(xs)
    names = _solver_names(d) + list(xs)

    @F.pandas_udf("double")
    def solve(sums: pd.DataFrame) -> pd.Series:
        v = sums.to_numpy(dtype="float64")
        n, at = v[:, 0], 2
        n = np.where(n > 0, n, np.nan)
        my = v[:, 1] / n
        m = v[:, at:at + d] / n[:, None]
        sxy = v[:, at + d:at + 2 * d]
        tri, k = np.zeros((len(v), d, d)), at + 2 * d
        for i in range(d):
            for j in range(i, d):
                tri[:, i, j] = tri[:, j, i] = v[:, k]
                k += 1
        x = v[:, k:k + d]
        cov = tri - n[:, None, None] * m[:, :, None] * m[:, None, :]
        sd = np.sqrt(np.maximum(np.einsum("nii->ni", cov) / n[:, None], 0))
        sd = np.where(sd > 0, sd, 1.0)
        a = cov / (sd[:, :, None] * sd[:, None, :]) + penalty * np.eye(d)
        b = (sxy - n[:, None] * m * my[:, None]) / sd
        out = np.full(len(v), np.nan)
        ok = np.isfinite(a).all(axis=(1, 2)) & np.isfinite(b).all(axis=1) & np.isfinite(x).all(axis=1)
        if ok.any():
            beta = np.linalg.solve(a[ok], b[ok][:, :, None])[:, :, 0]
            out[ok] = my[ok] + (beta * ((x - m) / sd)[ok]).sum(axis=1)
        return pd.Series(out).where(np.isfinite(out), None)
    return solve(F.struct(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(names)]))


def ridge_hourly(points: DataFrame, horizons: Sequence[int] = (1, 3, 6), tz: str = KST, least: int = 100, warm_days: int = 7) -> DataFrame:
    """Hold, price and price-plus-stock forecasts of the log change over each horizon, expanding window.

    `points` has item_id, hour, price, stock. A forecast at t trains on samples whose end is not after t.
    """
    p = points.withColumn("t", hour_number("hour")).select("item_id", "hour", "t", "price", "stock")
    p = reuse(p)
    prev = p.select("item_id", (F.col("t") + 1).alias("t"), F.col("price").alias("_pp"), F.col("stock").alias("_ps"))
    base = p.join(prev, ["item_id", "t"]).withColumns({
        "x0": F.log(F.col("price") / F.col("_pp")), "x1": F.log((1 + F.col("stock")) / (1 + F.col("_ps")))})
    nxt = p.select("item_id", F.col("t").alias("_end"), F.col("price").alias("_np"))
    s = base.withColumn("h", F.explode(F.array(*[F.lit(h) for h in horizons]))).withColumn("_end", F.col("t") + F.col("h")).join(nxt, ["item_id", "_end"])
    s = s.withColumn("y", F.log(F.col("_np") / F.col("price")))
    # A sample becomes usable at its end: lay samples at their end and questions at their start on one time line.
    group = Window.partitionBy("item_id", "h")
    none = F.lit(None).cast("double")
    usable = s.select("item_id", "h", "hour", "t", F.col("_end").alias("pos"), F.lit(0).alias("ask"), "x0", "x1", "y", none.alias("actual"))
    asked = s.select("item_id", "h", "hour", "t", F.col("t").alias("pos"), F.lit(1).alias("ask"), "x0", "x1", none.alias("y"), F.col("y").alias("actual"))
    past = group.orderBy("pos", "ask").rowsBetween(Window.unboundedPreceding, 0)
    g = usable.unionByName(asked).withColumns({**gram_columns(["x0", "x1"], "y", past), "_t0": F.min("t").over(group)})
    g = g.filter("ask = 1").drop("y").withColumnRenamed("actual", "y")
    g = g.filter((F.col("g_n") >= least) & (F.col("t") - F.col("_t0") >= 24 * warm_days))
    g = g.withColumns({"pred_hold": F.lit(0.0), "pred_price": ridge_value(["x0"]), "pred_stock": ridge_value(["x0", "x1"])})
    err = lambda c: F.abs(F.expm1(F.col(c) - F.col("y"))) * 100
    return g.select("item_id", "h", "hour", local_day("hour", tz).alias("day"), F.col("g_n").alias("train_n"), F.col("y").alias("actual"),
                    "pred_price", "pred_stock", err("pred_hold").alias("err_hold"), err("pred_price").alias("err_price"), err("pred_stock").alias("err_stock"))


def ridge_summary(cases: DataFrame) -> DataFrame:
    """Mean error per item and horizon, and the days on which stock helped."""
    days = cases.groupBy("item_id", "h", "day").agg((F.avg("err_stock") < F.avg("err_price")).alias("_w"))
    wins = days.groupBy("item_id", "h").agg(F.count(F.lit(1)).alias("days"), F.count_if("_w").alias("stock_wins"))
    return cases.groupBy("item_id", "h").agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"err_{m}").alias(f"mape_{m}") for m in ("hold", "price", "stock")]).join(wins, ["item_id", "h"])


MODELS = ["hold", "trend", "clock", "stock", "yesterday"]


def joint_forecast(points: DataFrame, as_of: str, horizons: Sequence[int], origin_hour: int, tz: str = KST, window_days: int = 28,
                   least: int = 120, warm_days: int = 7) -> DataFrame:
    """Forecasts of several horizons from one local hour of every day.

    `points` has item_id, hour, price, stock, known. Features at t: change over 24 h, phase of the clock,
    change of stock over 3 h. One row per item, day and horizon; `state` tells why a day was not issued. Days run from the
    item's first local day; one whose origin bar is missing has its rows too, without a base.
    """
    p = reuse(points.filter(F.col("hour") + F.expr("INTERVAL 1 HOUR") <= as_ts(as_of)).withColumn("t", hour_number("hour")))
    at = lambda k, **cols: p.select("item_id", (F.col("t") + k).alias("t"), *[F.col(c).alias(n) for n, c in cols.items()])
    base = (p.join(at(24, a_price="price", a_known="known"), ["item_id", "t"], "left").join(at(3, b_stock="stock", b_known="known"), ["item_id", "t"], "left"))
    ready = (F.col("price") > 0) & (F.col("a_price") > 0) & (F.col("stock") >= 0) & (F.col("b_stock") >= 0)
    base = base.withColumn("ready", F.coalesce(ready, F.lit(False))).withColumn("clock", F.hour(local_ts("hour", tz)))
    f = base.withColumn("h", F.explode(F.array(*[F.lit(h) for h in horizons])))
    turn = lambda e: e * (2 * np.pi / 24)
    f = f.withColumns({
        "x0": F.log(F.col("price") / F.col("a_price")) * F.col("h") / 24,
        # A whole turn of the clock is no move; without the guard its rounding noise would be standardised.
        "x1": F.when(F.col("h") % 24 == 0, 0.0).otherwise(F.sin(turn(F.col("clock") + F.col("h"))) - F.sin(turn(F.col("clock")))),
        "x2": F.when(F.col("h") % 24 == 0, 0.0).otherwise(F.cos(turn(F.col("clock") + F.col("h"))) - F.cos(turn(F.col("clock")))),
        "x3": F.log((1 + F.col("stock")) / (1 + F.col("b_stock")))})
    f = f.join(at(0, n_price="price", n_known="known").withColumn("h", F.explode(F.array(*[F.lit(h) for h in horizons])))
               .withColumn("t", F.col("t") - F.col("h")), ["item_id", "t", "h"], "left")
    f = f.withColumn("y", F.when(F.col("ready") & (F.col("n_price") > 0), F.log(F.col("n_price") / F.col("price"))))
    xs = ["x0", "x1", "x2", "x3"]
    # Origins are one day apart, so training sums are kept per day. A sample that starts k days in and ends by the
    # next origin serves from day k + 1, one that ends later from day k + 2; both serve for `window_days` days.
    local = F.floor(F.unix_timestamp(local_ts("hour", tz)) / 3600) - origin_hour
    f = f.withColumn("k", F.floor(local / 24)).withColumn("near", F.ceil((local + F.col("h")) / 24) == F.col("k") + 1)
    days = f.groupBy("item_id", "h", "k").agg(*[c for part in (True, False) for c in _day_sums(xs, "y", part)])
    by_day = Window.partitionBy("item_id", "h").orderBy("k")
    frames = {True: by_day.rangeBetween(-window_days, -1), False: by_day.rangeBetween(-window_days, -2)}
    zero = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0.0))
    both = lambda n: zero(f"{n}_near", frames[True]) + zero(f"{n}_far", frames[False])
    edge = lambda fn, pick: pick(fn("t_lo_near" if fn is F.min else "t_hi_near").over(frames[True]), fn("t_lo_far" if fn is F.min else "t_hi_far").over(frames[False]))
    sums = days.select("item_id", "h", "k", *[both(n).alias(n) for n in gram_names(xs)], edge(F.min, F.least).alias("_a"), edge(F.max, F.greatest).alias("_z"))
    g = f.filter(F.col("clock") == origin_hour).join(sums, ["item_id", "h", "k"])
    g = g.join(at(24, y_base="price"), ["item_id", "t"], "left")
    g = g.join(at(24, y_price="price").withColumn("h", F.explode(F.array(*[F.lit(h) for h in horizons]))).withColumn("t", F.col("t") - F.col("h")), ["item_id", "t", "h"], "left")
    enough = (F.col("g_n") >= least) & (F.col("_z") - F.col("_a") >= 24 * warm_days)
    g = g.withColumn("_ok", F.coalesce(enough, F.lit(False)))
    every = F.bool_and("_ok").over(Window.partitionBy("item_id", "t"))
    g = g.withColumn("state", F.when(~F.col("ready"), "input missing").when(~every, "training insufficient").otherwise("issued"))
    issued = F.col("state") == "issued"
    g = ridge_path(g, xs)
    level = lambda k: F.when(issued, F.col("price") * F.exp(F.col(f"_p{k}")))
    known = F.coalesce(F.col("known") & F.col("a_known") & F.col("b_known") & F.col("n_known"), F.lit(False))
    out = g.select("item_id", F.to_date(local_ts("hour", tz)).alias("day"), "hour", "h", "state", F.col("price").alias("base"), F.col("n_price").alias("actual"),
                    known.alias("known"), F.col("g_n").cast("bigint").alias("train_n"), F.when(issued, F.col("price")).alias("hold"), level(1).alias("trend"), level(3).alias("clock"),
                    level(4).alias("stock"), F.when(issued, F.col("y_price")).alias("y_price"), F.when(issued, F.col("y_base")).alias("y_base"))
    first = p.groupBy("item_id").agg(F.to_date(local_ts(F.min("hour"), tz)).alias("_first"))
    days = first.select("item_id", F.explode(F.sequence("_first", F.to_date(local_ts(as_ts(as_of), tz)))).alias("day"))
    days = days.withColumn("hour", F.to_utc_timestamp(F.col("day").cast("timestamp") + F.make_dt_interval(hours=F.lit(origin_hour)), tz))
    days = days.filter(F.col("hour") + F.expr("INTERVAL 1 HOUR") <= as_ts(as_of))
    absent = days.join(p.select("item_id", "hour"), ["item_id", "hour"], "left_anti").withColumn("h", F.explode(F.array(*[F.lit(h) for h in horizons])))
    absent = absent.withColumns({"state": F.lit("input missing"), "known": F.lit(False)})
    return out.unionByName(absent, allowMissingColumns=True)


def joint_evening(points: DataFrame, as_of: str, tz: str = KST, **kw) -> DataFrame:
    """Mean of the three evening hours forecast together from the 08:00 bar, one row per item and day."""
    f = joint_forecast(points, as_of, (10, 11, 12), 8, tz, **kw)
    n = F.count(F.lit(1))
    full = lambda c: F.when(F.count(c) == n, F.avg(c))
    g = f.groupBy("item_id", "day", "state").agg(
        F.max("base").alias("base"), full("actual").alias("actual"), F.bool_and("known").alias("known"), F.min("train_n").alias("train_n"),
        *[full(m).alias(m) for m in ("hold", "trend", "clock", "stock")], full("y_price").alias("_yp"), F.max("y_base").alias("_yb"))
    return g.withColumn("yesterday", F.col("base") * F.col("_yp") / F.col("_yb")).drop("_yp", "_yb")


def full_day_path(points: DataFrame, as_of: str, tz: str = KST, **kw) -> DataFrame:
    """24 hours ahead from the 05:00 bar: one row per item, day and horizon."""
    f = joint_forecast(points, as_of, range(1, 25), 5, tz, **kw)
    return f.withColumnRenamed("y_price", "yesterday").drop("y_base")


def long_models(rows: DataFrame, models: Sequence[str] = MODELS) -> DataFrame:
    """One row per model where both the forecast and the target are there."""
    e = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("value")) for m in models]))
    keep = [c for c in rows.columns if c not in models]
    out = rows.select(*keep, F.col(models[0]).alias("held"), e.alias("m")).select(*keep, "held", "m.*")
    return out.filter(F.col("actual").isNotNull() & F.col("value").isNotNull())


def path_days(paths: DataFrame) -> DataFrame:
    """Per item, day and model: hours scored, mean path error, the same for holding, error of the day's mean price."""
    p = long_models(paths.filter("state = 'issued'"))
    ape = lambda c: F.avg(F.abs(F.col(c) / F.col("actual") - 1)) * 100
    return p.groupBy("item_id", "day", "model").agg(
        F.count(F.lit(1)).alias("hours"), ape("value").alias("path_mape"), ape("held").alias("hold_mape"),
        F.when(F.count(F.lit(1)) == 24, F.abs(F.avg("value") / F.avg("actual") - 1) * 100).alias("mean_price_ape"))


def path_summary(days: DataFrame) -> DataFrame:
    """Days with at least 18 scored hours, and the complete ones among them."""
    whole = F.col("hours") == 24
    return days.filter("hours >= 18").groupBy("item_id", "model").agg(
        F.count(F.lit(1)).alias("days18"), F.avg("path_mape").alias("path_mape"), F.avg("hold_mape").alias("hold_mape"),
        F.count_if(F.col("path_mape") < F.col("hold_mape")).alias("wins"), F.count_if(whole).alias("days24"),
        F.avg(F.when(whole, F.col("path_mape"))).alias("complete_mape"), F.avg(F.when(whole, F.col("mean_price_ape"))).alias("mean_price_mape"))


def path_curve(paths: DataFrame) -> DataFrame:
    """Mean index of each horizon against the origin's price, observed and forecast."""
    p = long_models(paths.filter("state = 'issued'"))
    return p.groupBy("item_id", "h", "model").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("actual") / F.col("base") * 100).alias("actual_index"),
                                                  F.avg(F.col("value") / F.col("base") * 100).alias("model_index"))


def error_score(rows: DataFrame, models: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Mean, median and 90th percentile of the error, bias and days better than holding (the first model)."""
    p = long_models(rows, models).withColumn("ape", F.abs(F.col("value") / F.col("actual") - 1) * 100).withColumn("hold_ape", F.abs(F.col("held") / F.col("actual") - 1) * 100)
    g = p.groupBy(*keys, "model").agg(
        F.count(F.lit(1)).alias("n"), F.avg("ape").alias("mape"), F.avg((F.col("value") / F.col("actual") - 1) * 100).alias("bias"),
        F.count_if(F.col("ape") < F.col("hold_ape")).alias("wins"), F.avg("hold_ape").alias("hold_mape"))
    q = exact_quantiles(p, [*keys, "model"], "ape", [("median_ape", "linear", .5), ("p90_ape", "floor_n1", .9)])
    return g.join(q, [*keys, "model"])


def _direction(change: Column, limit: Column) -> Column:
    return F.when(change > limit + 1e-9, 2).when(change < -limit - 1e-9, 0).otherwise(1)


def direction_score(rows: DataFrame, models: Sequence[str], keys: Sequence[str], thresholds: Sequence[float] = (0, .5, 1)) -> DataFrame:
    """Three-class confusion of the predicted against the observed move, with the constant guesses beside the models."""
    always = [("always down", -100.0), ("always flat", 0.0), ("always up", 100.0)]
    guess = [F.struct(F.lit(m).alias("model"), ((F.col(m) / F.col("base") - 1) * 100).alias("move")) for m in models]
    guess += [F.struct(F.lit(m).alias("model"), F.lit(v).alias("move")) for m, v in always]
    p = (rows.filter("actual IS NOT NULL").withColumn("truth", (F.col("actual") / F.col("base") - 1) * 100)
         .withColumn("g", F.explode(F.array(*guess))).withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
         .filter("g.move IS NOT NULL"))
    p = p.withColumns({"a": _direction(F.col("truth"), F.col("threshold")), "b": _direction(F.col("g.move"), F.col("threshold"))})
    cell = lambda i, j: F.count_if((F.col("a") == i) & (F.col("b") == j)).alias(f"m{i}{j}")
    g = p.groupBy(*keys, "g.model", "threshold").agg(F.count(F.lit(1)).alias("n"), *[cell(i, j) for i in range(3) for j in range(3)])
    support = [F.col(f"m{i}0") + F.col(f"m{i}1") + F.col(f"m{i}2") for i in range(3)]
    recall = [F.when(support[i] > 0, F.col(f"m{i}{i}") / support[i]) for i in range(3)]
    classes = sum((F.when(s > 0, 1).otherwise(0) for s in support), F.lit(0))
    total = sum((F.coalesce(x, F.lit(0.0)) for x in recall), F.lit(0.0))
    return g.withColumn("accuracy", (F.col("m00") + F.col("m11") + F.col("m22")) / F.col("n")).withColumn("balanced", total / classes)


# Fixed values of the resampling stream: multiplier, increment, seed.
LCG_A, LCG_C, LCG_SEED = 1664525, 1013904223, 20261001
DRAWS, LOW, HIGH = 2000, 50, 1949


def lcg(count: int) -> np.ndarray:
    """The first `count` states of the 32-bit linear congruential stream.

    The k-step map is built by doubling, so the states come as whole array operations.
    """
    out, filled = np.empty(count, dtype=np.uint64), 1
    mask = np.uint64(0xFFFFFFFF)
    out[:1] = (LCG_SEED * LCG_A + LCG_C) & 0xFFFFFFFF
    a, c = LCG_A, LCG_C                      # advances a state by `filled` steps
    while filled < count:
        take = min(filled, count - filled)
        out[filled:filled + take] = (out[:take] * np.uint64(a) + np.uint64(c)) & mask
        a, c, filled = a * a & 0xFFFFFFFF, (a * c + c) & 0xFFFFFFFF, filled + take
    return out


def block_bootstrap(rows: DataFrame, first: str, second: str, keys: Sequence[str], block_days: int = 3, least: int = 4) -> DataFrame:
    """95 % interval of the mean difference of two models' errors from resampled blocks of days.

    Blocks are reduced to (sum, count) before anything is gathered; a series has one block per three days.
    """
    ape = lambda m: F.abs(F.col(m) / F.col("actual") - 1) * 100
    v = rows.filter(F.col("actual").isNotNull() & F.col(first).isNotNull() & F.col(second).isNotNull()).select(*keys, "day", (ape(first) - ape(second)).alias("d"))
    start = v.groupBy(*keys).agg(F.min("day").alias("_a"))
    v = v.join(start, list(keys)).withColumn("b", F.floor(F.datediff("day", "_a") / block_days))
    blocks = v.groupBy(*keys, "b").agg(F.sum("d").alias("s"), F.count(F.lit(1)).alias("n"))
    g = blocks.groupBy(*keys).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("blocks"), (F.sum("s") / F.sum("n")).alias("mean_difference"),
                                  F.sort_array(F.collect_list(F.struct("b", "s", "n"))).alias("_g"))

    @F.pandas_udf("low double, high double")
    def interval(groups: pd.Series) -> pd.DataFrame:
        out = []
        for g in groups:
            k = len(g)
            if k < least:
                out.append((None, None))
                continue
            s, n = np.array([b["s"] for b in g]), np.array([b["n"] for b in g])
            pick = np.floor(lcg(DRAWS * k).astype("float64") / 4294967296 * k).astype(int).reshape(DRAWS, k)
            means = np.sort(s[pick].sum(axis=1) / n[pick].sum(axis=1))
            out.append((means[LOW], means[HIGH]))
        return pd.DataFrame(out, columns=["low", "high"], dtype="float64")
    return g.withColumn("_i", interval("_g")).select(*keys, "n", "blocks", "mean_difference", F.col("_i.low").alias("low"), F.col("_i.high").alias("high"))
