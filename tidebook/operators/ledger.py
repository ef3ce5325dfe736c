"""Write-once forecast records, their settlement and evaluation."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidebook.functions.timeutil import KST, as_ts, day_number, local_day, local_ts
from tidebook.plans.series import islands

HORIZONS = (1, 3, 7)


def ledger_issue(ledger: DataFrame, candidates: DataFrame, as_of: str, through: str, tz: str = KST, from_hour: int = 2,
                 key: Sequence[str] = ("version", "origin")) -> DataFrame:
    """Rows to append: today's origin only, once, after `from_hour` and with today's bars complete."""
    now = local_ts(as_ts(as_of), tz)
    today = F.to_date(now)
    open_now = (F.hour(now) >= from_hour) & (local_day(as_ts(through), tz) == today)
    return candidates.filter(open_now & (F.col("origin") == today)).join(ledger.select(*key).distinct(), list(key), "left_anti")


def ledger_settle(predictions: DataFrame, settled: DataFrame, daily: DataFrame, origin: str, before: str,
                  horizons: Sequence[int] = (1, 7)) -> DataFrame:
    """Actuals to append, each target once and at least one full day after it ended; never observed stays NULL.

    `predictions` has version, series, h, d; `settled` has version, target; `daily` has series, day, value.
    """
    o, z = F.lit(origin).cast("date"), F.lit(before).cast("date")
    targets = (predictions.filter(F.col("h").isin(list(horizons)) & (F.col("d") <= F.date_sub(o, 2)) & (F.col("d") < z))
               .select("version", "series", F.col("d").alias("target")).distinct()
               .join(settled, ["version", "target"], "left_anti"))
    return targets.join(daily.select("series", F.col("day").alias("target"), "value"), ["series", "target"], "left")


def panel_origins(daily: DataFrame, min_days: int = 21, min_mean: float = 5) -> DataFrame:
    """For every observed day, the forecast origin on the day after: its unbroken history and why it may not issue.

    Run length, mean trades and the simple forecasts come from one window per run of consecutive days.
    """
    d = daily.filter("vwap > 0 AND n > 0").select("item_id", "day", "vwap", "n")
    d = islands(d, ["item_id"], day_number("day"))
    run = Window.partitionBy("item_id", "island").orderBy("day")
    upto = run.rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({"train_days": F.row_number().over(run), "mean_n": F.avg("n").over(upto), "first_day": F.min("day").over(upto),
                       "mean7": F.avg("vwap").over(run.rowsBetween(-6, 0))})
    # The last same weekday before the origin lies 5, 3 and 6 rows back for horizons 1, 3 and 7.
    d = d.withColumns({f"same{h}": F.lag("vwap", 6 - h if h < 7 else 6).over(run) for h in HORIZONS})
    ok = (F.col("train_days") >= min_days) & (F.col("mean_n") >= min_mean)
    return d.select("item_id", F.date_add("day", 1).alias("origin"), "first_day", "train_days", "mean_n", F.col("vwap").alias("last"), "mean7",
                    *[f"same{h}" for h in HORIZONS], F.when(~ok, "needs 21 days in a row and 5 trades a day").alias("reason"))


def panel_input(daily: DataFrame, origin: str, min_days: int = 21, min_mean: float = 5) -> DataFrame:
    """Items that issue from one origin, and the others with the reason; an item not seen yesterday has no run."""
    o = F.lit(origin).cast("date")
    p = panel_origins(daily, min_days, min_mean).filter(F.col("origin") == o)
    every = daily.filter((F.col("day") < o) & (F.col("vwap") > 0) & (F.col("n") > 0)).select("item_id").distinct()
    j = every.join(p, "item_id", "left")
    return j.select("item_id", F.coalesce("train_days", F.lit(0)).alias("train_days"), "first_day", "mean_n",
                    F.when(F.col("origin").isNull(), "needs 21 days in a row and 5 trades a day").otherwise(F.col("reason")).alias("reason"))


def baseline_models(panel: DataFrame) -> DataFrame:
    """Last value, mean of seven days and last same weekday for each issuing origin and horizon."""
    ok = panel.filter("reason IS NULL")
    rows = F.array(*[F.struct(F.lit(h).alias("h"), F.lit(m).alias("model"), F.col(c).alias("value"))
                     for h in HORIZONS for m, c in (("last", "last"), ("mean7", "mean7"), ("same_weekday", f"same{h}"))])
    e = ok.select("item_id", "origin", F.explode(rows).alias("e")).select("item_id", "origin", "e.*")
    return e.withColumn("target", F.date_add("origin", F.col("h")))


def panel_settle(daily: DataFrame, targets: DataFrame, now_day: str, min_n: int = 5) -> DataFrame:
    """Settled targets (at least two days old): the actual, or why there is none. `targets` has item_id, target."""
    due = targets.filter(F.col("target") <= F.date_sub(F.lit(now_day).cast("date"), 2)).select("item_id", "target").distinct()
    j = due.join(daily.select("item_id", F.col("day").alias("target"), "vwap", "n"), ["item_id", "target"], "left")
    good = (F.col("n") >= min_n) & (F.col("vwap") > 0)
    return j.select("item_id", "target", F.when(good, F.col("vwap")).alias("actual"), F.coalesce("n", F.lit(0)).alias("n"),
                    F.when(F.col("n").isNull(), "no bar").when(~good, "too few trades or no price").alias("reason"))


def panel_cases(issues: DataFrame, settled: DataFrame) -> DataFrame:
    """Every prediction with its state: scored, pending or excluded."""
    s = settled.withColumn("_settled", F.lit(True))
    j = issues.join(s, ["item_id", "target"], "left")
    state = F.when(F.col("_settled").isNull(), "pending").when(F.col("actual").isNull(), "excluded").otherwise("scored")
    return j.withColumn("state", state).drop("_settled")


def panel_settle_eval(cases: DataFrame, base: str = "last") -> DataFrame:
    """Error by horizon and model: over cases, over items, items that beat the baseline, distinct target days."""
    ok = cases.filter("state = 'scored'").withColumn("ape", F.abs(F.col("value") / F.col("actual") - 1) * 100)
    hold = ok.filter(F.col("model") == base).select("item_id", "origin", "h", F.col("ape").alias("hold"))
    j = ok.join(hold, ["item_id", "origin", "h"])
    item = j.groupBy("h", "model", "item_id").agg(F.count(F.lit(1)).alias("n"), F.avg("ape").alias("m"), F.avg("hold").alias("b"), F.sum("ape").alias("s"))
    days = j.groupBy("h", "model").agg(F.count_distinct("target").alias("dates"))
    out = item.groupBy("h", "model").agg(
        F.sum("n").alias("cases"), F.count(F.lit(1)).alias("items"), (F.sum("s") / F.sum("n")).alias("mape"), F.avg("m").alias("item_mape"),
        F.avg("b").alias("item_baseline"), F.count_if(F.col("m") < F.col("b") - 1e-9).alias("wins"))
    return out.join(days, ["h", "model"])


def ledger_validate(issues: DataFrame, version: str, models: Sequence[str], tz: str = KST, now: str | None = None) -> DataFrame:
    """Rules an issued forecast breaks, one row per item, origin and rule.

    `issues` has item_id, version, origin, issued_at, h, target, model, value. A missing day or target breaks its rule;
    with `now`, so does a forecast issued after it.
    """
    bad_value = F.col("value").isNull() | F.isnan("value") | (F.col("value") <= 0) | (F.abs("value") == float("inf"))
    row_rules = F.array(
        F.when(~F.col("version").eqNullSafe(F.lit(version)), F.lit("version")),
        F.when(~local_day("issued_at", tz).eqNullSafe(F.col("origin")), F.lit("issued on another day")),
        F.when(F.col("issued_at") > (as_ts(now) if now else F.lit(None)), F.lit("issued in the future")),
        F.when(~F.col("target").eqNullSafe(F.date_add("origin", F.col("h"))), F.lit("target date")),
        F.when(bad_value, F.lit("value")))
    rows = issues.select("item_id", "origin", F.explode(F.filter(row_rules, lambda x: x.isNotNull())).alias("rule"))
    whole = issues.groupBy("item_id", "origin").agg(F.collect_set("h").alias("hs"), F.collect_set("model").alias("ms"), F.count(F.lit(1)).alias("n"))
    group_rules = F.array(
        F.when(F.sort_array("hs") != F.array(*[F.lit(h) for h in HORIZONS]), F.lit("horizons")),
        F.when((F.sort_array("ms") != F.array(*[F.lit(m) for m in sorted(models)])) | (F.col("n") != len(models) * len(HORIZONS)), F.lit("models")))
    groups = whole.select("item_id", "origin", F.explode(F.filter(group_rules, lambda x: x.isNotNull())).alias("rule"))
    return rows.unionByName(groups).groupBy("item_id", "origin", "rule").agg(F.count(F.lit(1)).alias("rows"))


def forecast_usable(paths: DataFrame, today: str, days: int = 8) -> DataFrame:
    """A published path is shown only when unbroken, positive and anchored at yesterday.

    `paths` has item_id, status, anchor_day, anchor_value and points, an array of (d, value).
    """
    t = F.lit(today).cast("date")
    steady = F.forall(F.transform("points", lambda p, i: (p["d"] == F.date_add(t, i)) & (p["value"] > 0)), lambda ok: F.coalesce(ok, F.lit(False)))
    ok = ((F.col("status") == "ready") & (F.size("points") == days) & (F.col("anchor_value") > 0)
          & (F.col("anchor_day") == F.date_sub(t, 1)) & steady)
    return paths.select("item_id", F.coalesce(ok, F.lit(False)).alias("usable"))


def review_overview(cases: DataFrame, base: str = "last", comparable: int = 7) -> DataFrame:
    """Per item and horizon: error, failed fits and days better than holding, for each model.

    `cases` has item_id, origin, h, model, value, actual, failed.
    """
    c = cases.filter("actual IS NOT NULL").withColumn("ape", F.abs(F.col("value") / F.col("actual") - 1) * 100)
    hold = c.filter(F.col("model") == base).select("item_id", "origin", "h", F.col("ape").alias("hold"))
    j = c.join(hold, ["item_id", "origin", "h"])
    return j.groupBy("item_id", "h", "model").agg(
        F.count(F.lit(1)).alias("n"), F.avg("ape").alias("mape"), F.count_if("failed").alias("failures"), F.count_if(F.col("ape") < F.col("hold")).alias("_w")) \
        .withColumn("wins", F.when(F.col("model") != base, F.col("_w"))).withColumn("comparable", F.col("n") >= comparable).drop("_w")
