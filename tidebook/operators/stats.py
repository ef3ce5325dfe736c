"""Contiguous runs, the variance-ratio test and multiple-test correction."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tidebook.functions.normal import two_sided_p
from tidebook.functions.timeutil import as_ts, hour_number
from tidebook.plans.series import islands
from tidebook.plans.split import global_ranks, null_safe_join
from tidebook.session import reuse


def longest_run(bars: DataFrame, as_of: str) -> DataFrame:
    """Bars of each item's longest unbroken run of hours before the current hour; the later run wins a tie."""
    b = bars.filter(F.col("hour") < F.date_trunc("hour", as_ts(as_of)))
    b = islands(b, ["item_id"], hour_number("hour"))
    size = b.groupBy("item_id", "island").agg(F.count(F.lit(1)).alias("_n"), F.max("hour").alias("_end"))
    best = size.groupBy("item_id").agg(F.max_by("island", F.struct("_n", "_end")).alias("island"))
    return b.join(best, ["item_id", "island"], "left_semi").drop("island")


def variance_ratio(prices: DataFrame, q: int = 2, least: int = 30) -> DataFrame:
    """Lo-MacKinlay ratio of q-step to one-step variance with a heteroskedasticity-robust z.

    `prices` has item_id, hour, vwap: one contiguous run per item. Too few or constant prices give NULLs.
    """
    order = Window.partitionBy("item_id").orderBy("hour")
    item = Window.partitionBy("item_id")
    lp = F.log("vwap")
    r = (prices.withColumn("r1", lp - F.lag(lp, 1).over(order)).withColumn("rq", lp - F.lag(lp, q).over(order))
         .withColumn("mu", F.avg("r1").over(item)).withColumn("s", F.pow(F.col("r1") - F.col("mu"), 2)))
    for k in range(1, q):
        r = r.withColumn(f"x{k}", F.col("s") * F.lag("s", k).over(order))
    g = r.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("bars"), F.count("r1").alias("n"), F.min("vwap").alias("_low"), F.sum("s").alias("ss"),
        F.sum(F.pow(F.col("rq") - q * F.col("mu"), 2)).alias("sq"), *[F.sum(f"x{k}").alias(f"x{k}") for k in range(1, q)])
    n = F.col("n")
    m = q * (n - q + 1) * (1 - q / n)
    theta = sum(((2 * (1 - k / q)) ** 2 * F.col(f"x{k}") for k in range(1, q)), F.lit(0.0)) / F.pow("ss", 2)
    ok = (F.col("bars") >= least) & (F.col("_low") > 0) & (n > q) & (F.col("ss") > (2.220446049250313e-16 ** 2) * n)
    g = g.withColumn("theta", F.when(ok, theta)).withColumn("vr", F.when(F.col("theta") > 0, (F.col("sq") / m) / (F.col("ss") / (n - 1))))
    g = g.withColumn("z", (F.col("vr") - 1) / F.sqrt("theta"))
    return g.select("item_id", "bars", F.when(F.col("vr").isNotNull(), n).alias("returns"), "vr", "z",
                    F.when(F.col("z").isNotNull(), two_sided_p(F.col("z"))).alias("p"))


def holm(tests: DataFrame, family: Sequence[str] = (), p: str = "p", name: str = "adjusted") -> DataFrame:
    """Step-down adjusted p within each family; a family has one test per item.

    Tests are ranked in stretches of p; the running maximum of a stretch continues that of the stretches before it.
    """
    parts = list(family)
    ranked = reuse(global_ranks(tests, parts, p, "item_id").withColumn("_step", F.least(F.lit(1.0), F.col(p) * (F.col("_n") - F.col("_rn") + 1))))
    earlier = Window.partitionBy(*(parts or [F.lit(0)])).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)    # a few hundred stretches
    tops = ranked.groupBy(*parts, "_chunk").agg(F.max("_step").alias("_top")).withColumn("_reached", F.max("_top").over(earlier)).drop("_top")
    inside = Window.partitionBy(*parts, "_chunk").orderBy(p, "item_id").rowsBetween(Window.unboundedPreceding, 0)
    out = null_safe_join(ranked.withColumn("_run", F.max("_step").over(inside)), tops, [*parts, "_chunk"])
    return out.withColumn(name, F.greatest("_run", "_reached")).drop("_run", "_reached", "_step", "_rn", "_n", "_chunk")


def random_walk_report(bars: DataFrame, as_of: str, q: int = 2, alpha: float = 0.05) -> DataFrame:
    """Per item: run, ratio, volatility, adjusted significance, thickness third, or why it was left out."""
    run = reuse(longest_run(bars.filter("vwap > 0"), as_of))
    order = Window.partitionBy("item_id").orderBy("hour")
    lr = run.withColumn("r", F.log("vwap") - F.lag(F.log("vwap")).over(order))
    facts = lr.groupBy("item_id").agg(F.min("hour").alias("first_hour"), F.max("hour").alias("last_hour"), F.avg("n").alias("per_bar"),
                                      F.avg("vwap").alias("price"), (F.stddev_samp("r") * 100).alias("volatility"))
    v = reuse(variance_ratio(run, q).join(facts, "item_id"))
    tested = global_ranks(holm(v.filter("vr IS NOT NULL")), [], "per_bar", "item_id")
    third = F.greatest(F.ceil(F.col("_n") / 3), F.lit(1))
    tested = tested.withColumn("third", F.least(F.ceil(F.col("_rn") / third), F.lit(3))).drop("_rn", "_n", "_chunk")
    rest = v.filter("vr IS NULL").withColumn("adjusted", F.lit(None).cast("double")).withColumn("third", F.lit(None).cast("bigint"))
    reason = F.when(F.col("vr").isNull(), F.when(F.col("bars") < 30, "too few contiguous hours").otherwise("no usable variance"))
    return (tested.unionByName(rest).withColumn("significant", F.coalesce(F.col("adjusted") < alpha, F.lit(False)))
            .withColumn("excluded", reason))


def random_walk_summary(report: DataFrame) -> DataFrame:
    """Totals over the tested items, and the mean ratio per thickness third."""
    t = report.filter("vr IS NOT NULL")
    sig = F.col("significant")
    total = t.agg(F.count(F.lit(1)).alias("items"), F.count_if(sig).alias("significant"), F.count_if(sig & (F.col("vr") < 1)).alias("reversal"),
                  F.count_if(sig & (F.col("vr") > 1)).alias("momentum"), F.median("vr").alias("vr"), F.avg("per_bar").alias("per_bar"))
    thirds = t.groupBy("third").agg(F.count(F.lit(1)).alias("items"), F.count_if(sig).alias("significant"),
                                    F.count_if(sig & (F.col("vr") < 1)).alias("reversal"), F.count_if(sig & (F.col("vr") > 1)).alias("momentum"),
                                    F.avg("vr").alias("vr"), F.avg("per_bar").alias("per_bar"))
    return total.withColumn("third", F.lit(0).cast("bigint")).unionByName(thirds)
