"""Event studies and difference-in-differences on daily and hourly bars."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidebook.functions.exact import ratio
from tidebook.functions.timeutil import KST, hour_number, iso_dow, local_ts
from tidebook.plans.split import null_safe_join
from tidebook.session import reuse


def event_window_7(series: DataFrame, events: DataFrame, before: str, days: int = 7) -> DataFrame:
    """Means of the seven days before and from the event; ready only when all fourteen were observed.

    `series` has item_id, day, value; `events` has event_id, item_id, event_day. The figures depend on the item and the
    day only, so each such pair fans out once to its fourteen days, which meet the series by an equi join; its events
    then take them over, however many there are.
    """
    z = F.lit(before).cast("date")
    e = events.select("item_id", "event_day").distinct()
    e = e.select("item_id", "event_day", F.explode(F.sequence(F.lit(-days), F.lit(days - 1))).alias("o"))
    e = e.withColumn("day", F.date_add("event_day", F.col("o")))
    j = e.join(series.filter(F.col("day") < z).select("item_id", "day", "value"), ["item_id", "day"], "left")
    pre, post = F.when(F.col("o") < 0, F.col("value")), F.when(F.col("o") >= 0, F.col("value"))
    g = j.groupBy("item_id", "event_day").agg(F.count(pre).alias("pre_n"), F.count(post).alias("post_n"), F.avg(pre).alias("_a"), F.avg(post).alias("_b"))
    g = g.withColumn("ready", (F.col("pre_n") == days) & (F.col("post_n") == days) & (F.date_add("event_day", days - 1) < z))
    shown = lambda c: F.when(F.col("ready"), c)
    g = null_safe_join(events.select("event_id", "item_id", "event_day"), g, ["item_id", "event_day"])
    return g.select("event_id", "item_id", "event_day", "pre_n", "post_n", "ready", shown(F.col("_a")).alias("pre"), shown(F.col("_b")).alias("post"),
                    F.when(F.col("ready") & (F.col("_a") > 0), (F.col("_b") / F.col("_a") - 1) * 100).alias("change"))


def event_stage_3(daily: DataFrame, stages: DataFrame, effect: DataFrame, today: str, each: int = 3) -> DataFrame:
    """Three completed observations on either side of a stage, with the common weekday pattern taken out.

    Observations of an item are numbered once; a stage only needs its place in that order, which all stages of that
    item and day share. `daily` may have a column
    `basis`: items of another basis than trade need no quantity and get none.
    """
    t = F.lit(today).cast("date")
    basis = F.col("basis") if "basis" in daily.columns else F.lit("trade")
    d = daily.withColumn("traded", basis == "trade").filter((F.col("day") < t) & (F.col("vwap") > 0) & (~F.col("traded") | (F.col("qty") > 0)))
    d = d.select("item_id", "day", "vwap", "qty", "traded")
    ks = effect.agg(F.count(F.lit(1)).alias("ks"), F.avg("ret").alias("mean_ret"))
    d = d.withColumn("k", iso_dow("day")).join(effect.select("k", "ret", "vol"), "k", "left")
    mean_ret, n_k = ks.select("mean_ret").scalar(), ks.select("ks").scalar()
    d = d.withColumn("adj_p", F.col("vwap") / F.exp((F.coalesce("ret", mean_ret) - mean_ret) / 100))
    d = d.withColumn("adj_q", F.col("qty") / F.when(F.col("vol") != 0, F.col("vol")).otherwise(1.0))
    order = Window.partitionBy("item_id").orderBy("day")
    obs = d.withColumn("no", F.row_number().over(order)).select("item_id", "day", "no", "adj_p", "adj_q", "traded")
    first = obs.groupBy("item_id").agg(F.min("day").alias("first_day"), F.bool_and("traded").alias("traded"))
    marks = (obs.select("item_id", "day", F.lit(1).alias("seen"))
             .unionByName(stages.filter("stage_day IS NOT NULL").select("item_id", F.col("stage_day").alias("day"), F.lit(0).alias("seen")).distinct()))
    earlier = Window.partitionBy("item_id").orderBy("day", "seen").rowsBetween(Window.unboundedPreceding, 0)   # days of the calendar
    place = marks.withColumn("place", F.sum("seen").over(earlier)).filter("seen = 0").select("item_id", F.col("day").alias("stage_day"), "place")
    near = place.withColumn("no", F.explode(F.sequence(F.col("place") - each + 1, F.col("place") + each))).join(obs.drop("traded"), ["item_id", "no"])
    side = lambda c, after: F.avg(F.when((F.col("no") > F.col("place")) == F.lit(after), F.col(c)))
    cnt = lambda after: F.count_if((F.col("no") > F.col("place")) == F.lit(after))
    g = near.groupBy("item_id", "stage_day").agg(cnt(False).alias("_bn"), cnt(True).alias("_an"), side("adj_p", False).alias("_bp"), side("adj_p", True).alias("_ap"),
                                                side("adj_q", False).alias("_bq"), side("adj_q", True).alias("_aq"))
    j = stages.join(first, "item_id", "left").join(g, ["item_id", "stage_day"], "left")
    n0 = lambda c: F.coalesce(c, F.lit(0))
    state = (F.when(F.col("stage_day").isNull(), "missing").when(F.col("first_day").isNull() | (F.col("stage_day") < F.col("first_day")), "before")
             .when(F.col("stage_day") > t, "scheduled").when((n0("_bn") < each) | (n0("_an") < each), "waiting")
             .when(n_k < 7, "weekday").otherwise("ready"))
    j = j.withColumn("state", state)
    pct = lambda a, b: F.when(F.col("state") == "ready", (F.col(a) / F.nullif(F.col(b), F.lit(0.0)) - 1) * 100)
    return j.select("event_id", "item_id", "stage_day", "state", pct("_ap", "_bp").alias("price"), F.when(F.col("traded"), pct("_aq", "_bq")).alias("qty"))


def _moves(bars: DataFrame, before_h: int, after_h: int) -> DataFrame:
    """For every bar as the first hour after an anchor: price and quantity change, if all hours are there."""
    b = bars.filter("vwap > 0 AND qty > 0 AND n > 0").withColumn("t", hour_number("hour"))
    w = Window.partitionBy("item_id").orderBy("t")
    pre, post = w.rangeBetween(-before_h, -1), w.rangeBetween(0, after_h - 1)
    s = b.withColumns({"_bn": F.count(F.lit(1)).over(pre), "_an": F.count(F.lit(1)).over(post), "_bg": F.sum("gold").over(pre), "_ag": F.sum("gold").over(post),
                       "_bq": F.sum("qty").over(pre), "_aq": F.sum("qty").over(post)})
    s = s.filter((F.col("_bn") == before_h) & (F.col("_an") == after_h))
    return s.select("item_id", F.col("hour").alias("anchor"), ratio(F.col("_bg"), F.col("_bq")).alias("before_price"), ratio(F.col("_ag"), F.col("_aq")).alias("after_price"),
                    ((F.col("_aq") / after_h / (F.col("_bq") / before_h) - 1) * 100).alias("qty_pct")) \
        .withColumn("price_pct", 100 * (F.col("after_price") / F.col("before_price") - 1))


# Fewest references per mode.
LEAST_REFERENCES = {"all": 20, "noThursday": 20, "Tuesday": 4}


def hourly_event_study(bars: DataFrame, events: DataFrame, before_h: int, after_h: int, tz: str = KST,
                       modes: Sequence[str] = ("all", "noThursday", "Tuesday"), back: int = 28) -> DataFrame:
    """Change around an hour against the same hours of the 28 days before the announcement.

    `events` has event_id, item_id, at, announced. Every possible anchor's change is formed once by windows
    over the bars. The figures depend on the item and the two hours only: each such triple looks up its anchor and its
    references by equality, and its events take them over, however many there are.
    """
    m = _moves(bars, before_h, after_h)
    key = ["item_id", "at", "announced"]
    cases = reuse(events.select(*key).distinct())
    actual = cases.join(m.withColumnRenamed("anchor", "at"), ["item_id", "at"], "left").select(
        *key, "before_price", "after_price", F.col("price_pct").alias("actual_pct"), F.col("qty_pct").alias("actual_qty_pct"))
    a = cases.withColumn("anchor", F.explode(F.transform(F.sequence(F.lit(1), F.lit(back)), lambda i: F.col("at") - F.make_dt_interval(days=i))))
    a = a.filter(F.col("anchor") + F.expr(f"INTERVAL {after_h} HOURS") <= F.col("announced"))
    dow = lambda ts: F.weekday(local_ts(ts, tz))
    span = F.sequence(F.col("anchor") - F.expr(f"INTERVAL {before_h} HOURS"), F.col("anchor") + F.expr(f"INTERVAL {after_h - 1} HOURS"), F.expr("INTERVAL 1 HOUR"))
    rule = {"all": F.lit(True), "noThursday": ~F.exists(span, lambda h: dow(h) == 3), "Tuesday": dow(F.col("anchor")) == 1}
    a = a.withColumn("mode", F.explode(F.filter(F.array(*[F.when(rule[x], F.lit(x)) for x in modes]), lambda x: x.isNotNull())))
    refs = a.join(m.select("item_id", "anchor", "price_pct"), ["item_id", "anchor"]).groupBy(*key, "mode").agg(
        F.count(F.lit(1)).alias("references"), F.percentile("price_pct", F.lit(.5)).alias("median"), F.percentile("price_pct", F.lit(.05)).alias("low"),
        F.percentile("price_pct", F.lit(.95)).alias("high"))
    grid = actual.withColumn("mode", F.explode(F.array(*[F.lit(x) for x in modes])))
    j = null_safe_join(grid, refs, [*key, "mode"], "left").withColumn("references", F.coalesce("references", F.lit(0)))
    need = F.lit(None).cast("int")
    for x in modes:
        need = F.when(F.col("mode") == x, LEAST_REFERENCES[x]).otherwise(need)
    p = F.col("actual_pct")
    status = (F.when(p.isNull() | (F.col("references") < need), "insufficient")
              .when((p < F.col("low")) | (p > F.col("high")), "outside the usual range").otherwise("no clear sign"))
    j = j.withColumn("excess_pp", p - F.col("median")).withColumn("status", status)
    return null_safe_join(events.select("event_id", *key), j, key).drop("at", "announced")


def event_path(bars: DataFrame, events: DataFrame, around: int = 24, base_h: int = 6) -> DataFrame:
    """Hourly path around an event as an index of the six hours before it."""
    b = bars.select("item_id", "hour", "vwap", "qty", "n", "gold")
    e = events.select("item_id", "at").distinct()         # one path for all events of an item and hour
    pre = e.withColumn("hour", F.explode(F.transform(F.sequence(F.lit(1), F.lit(base_h)), lambda i: F.col("at") - F.make_dt_interval(hours=i))))
    pre = pre.join(b.filter("vwap > 0 AND qty > 0 AND n > 0"), ["item_id", "hour"]).groupBy("item_id", "at").agg(
        F.when(F.count(F.lit(1)) == base_h, ratio(F.sum("gold"), F.sum("qty"))).alias("base"))
    path = e.withColumn("offset", F.explode(F.sequence(F.lit(-around), F.lit(around - 1)))).withColumn("hour", F.col("at") + F.make_dt_interval(hours=F.col("offset")))
    j = path.join(b.select("item_id", "hour", "vwap", "qty"), ["item_id", "hour"], "left").join(pre, ["item_id", "at"], "left")
    j = events.select("event_id", "item_id", "at").join(j, ["item_id", "at"])
    return j.select("event_id", "item_id", "offset", "hour", F.col("vwap").alias("price"), (100 * F.col("vwap") / F.col("base")).alias("index"), "qty")


def study_prices(daily: DataFrame, members: DataFrame, through: str, min_trades: int = 5) -> DataFrame:
    """Usable member prices: enough trades, not after `through`, before the day the member expires.

    `members` has item_id, side and expires_day.
    """
    j = daily.join(members, "item_id")
    ok = (F.col("n") >= min_trades) & (F.col("day") <= F.lit(through).cast("date")) & (F.col("expires_day").isNull() | (F.col("day") < F.col("expires_day")))
    return reuse(j.filter(ok).select("item_id", "side", "day", "vwap"))


def side_logs(prices: DataFrame, groups: DataFrame) -> DataFrame:
    """Equal-weight log price per variant, side and day when every member of the side is there.

    `groups` has variant, side, item_id.
    """
    size = groups.groupBy("variant", "side").agg(F.count(F.lit(1)).alias("size"))
    g = (prices.select("item_id", "day", "vwap").join(groups, "item_id").groupBy("variant", "side", "day")
         .agg(F.count(F.lit(1)).alias("_n"), F.avg(F.log("vwap")).alias("v")).join(size, ["variant", "side"]))
    return g.filter(F.col("_n") == F.col("size")).select("variant", "side", "day", "v")


def did_excess(logs: DataFrame) -> DataFrame:
    """Treatment less control per variant and day."""
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("v")))
    g = logs.groupBy("variant", "day").agg(side("treatment").alias("t"), side("control").alias("c"))
    return reuse(g.filter("t IS NOT NULL AND c IS NOT NULL").withColumn("value", F.col("t") - F.col("c")))


def did_contrast(excess: DataFrame, windows: DataFrame, through: str, share: float = .8) -> DataFrame:
    """Effect between two windows; pending until the later one is over, insufficient below 80 % valid days.

    `windows` has variant, label, b0, b1, a0, a1. A window is spread over its days and meets the series by equality.
    """
    days = lambda a, z, part: windows.select("variant", "label", F.lit(part).alias("part"), F.explode(F.sequence(a, z)).alias("day"))
    w = days("b0", "b1", "pre").unionByName(days("a0", "a1", "post"))
    j = w.join(excess.select("variant", "day", "value"), ["variant", "day"], "left")
    cond = {p: F.col("part") == p for p in ("pre", "post")}
    g = j.groupBy("variant", "label").agg(
        *[F.count_if(cond[p]).alias(f"{p}_days") for p in cond], *[F.count(F.when(cond[p], F.col("value"))).alias(f"{p}_valid") for p in cond],
        *[F.avg(F.when(cond[p], F.col("value"))).alias(f"_{p}") for p in cond], F.max(F.when(cond["post"], F.col("day"))).alias("_end"))
    need = lambda p: F.ceil(F.col(f"{p}_days") * share)
    status = (F.when(F.col("_end") > F.lit(through).cast("date"), "pending")
              .when((F.col("pre_valid") < need("pre")) | (F.col("post_valid") < need("post")), "insufficient").otherwise("ready"))
    g = g.withColumn("status", status).withColumn("log_effect", F.when(F.col("status") == "ready", F.col("_post") - F.col("_pre")))
    return g.select("variant", "label", "status", "pre_days", "pre_valid", "post_days", "post_valid", "log_effect", (F.expm1("log_effect") * 100).alias("relative_pct"))


def study_groups(members: DataFrame, leave_out: int = 4) -> DataFrame:
    """Variants of the design: as planned, without one of the first controls, and one control posing as treated.

    The member list is a fixed configuration of a few dozen rows; variants pair members with members.
    """
    base = members.filter(F.col("side").isin("treatment", "control")).select("side", "item_id", "position")
    main = base.select(F.lit("main").alias("variant"), "side", "item_id")
    c = base.filter("side = 'control'")
    ids = lambda rows: rows.agg(F.sort_array(F.collect_list("item_id"))).scalar()
    omit = (base.withColumn("out", F.explode(ids(c.filter(F.col("position") <= leave_out)))).filter(F.col("item_id") != F.col("out"))
            .select(F.concat(F.lit("without "), "out").alias("variant"), "side", "item_id"))
    space = (c.withColumn("out", F.explode(ids(c)))
             .select(F.concat(F.lit("posing "), "out").alias("variant"), F.when(F.col("item_id") == F.col("out"), "treatment").otherwise("control").alias("side"), "item_id"))
    return main.unionByName(omit).unionByName(space)


def placebo_windows(spark, first: str, last: str, width: int = 7, variant: str = "main") -> DataFrame:
    """Seven days against the next seven for every date of a range."""
    d = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("d"))
    return d.select(F.lit(variant).alias("variant"), F.date_format("d", "yyyy-MM-dd").alias("label"), F.date_sub("d", width).alias("b0"), F.date_sub("d", 1).alias("b1"),
                    F.col("d").alias("a0"), F.date_add("d", width - 1).alias("a1"))


def study_audit(daily: DataFrame, members: DataFrame, first: str, last: str, through: str, min_trades: int = 5) -> DataFrame:
    """Per member: first and last day, and the valid, absent, thin and after-expiry days of the baseline."""
    z = F.least(F.lit(last).cast("date"), F.lit(through).cast("date"))
    spine = members.withColumn("day", F.explode(F.sequence(F.lit(first).cast("date"), z)))
    d = daily.filter(F.col("day") <= F.lit(through).cast("date")).select("item_id", "day", "vwap", "n")
    j = spine.join(d, ["item_id", "day"], "left")
    alive = F.col("expires_day").isNull() | (F.col("day") < F.col("expires_day"))
    g = j.groupBy("item_id", "side").agg(
        F.count(F.lit(1)).alias("expected"), F.count_if((F.col("n") >= min_trades) & alive).alias("valid"), F.count_if(F.col("n").isNull()).alias("no_row"),
        F.count_if(F.col("n") < min_trades).alias("thin"))
    life = d.join(members.select("item_id", "expires_day"), "item_id").groupBy("item_id").agg(
        F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count_if(F.col("day") >= F.col("expires_day")).alias("after_expiry"))
    return g.join(life, "item_id", "left").withColumn("after_expiry", F.coalesce("after_expiry", F.lit(0)))


def group_coverage(prices: DataFrame, members: DataFrame, first: str, last: str) -> DataFrame:
    """Baseline days on which a whole side is priced."""
    size = members.groupBy("side").agg(F.count(F.lit(1)).alias("size"))
    p = prices.filter(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date"))).groupBy("side", "day").agg(F.count(F.lit(1)).alias("_n"))
    return size.join(p, "side", "left").groupBy("side").agg(F.count_if(F.col("_n") == F.col("size")).alias("days"))


def pre_event_margin(prices: DataFrame, members: DataFrame, first: str, last: str, through: str, fee: float = .03, band: float = 3, share: float = .8) -> DataFrame:
    """Daily margin of the parts over the bundle (position 1 of the treatment) before the event."""
    t = members.filter("side = 'treatment'").select("item_id", "position")
    size = t.agg(F.count(F.lit(1))).scalar()
    span = F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    bundle = F.col("position") == 1
    d = (prices.filter(span).select("item_id", "day", "vwap").join(t, "item_id").groupBy("day")
         .agg(F.count(F.lit(1)).alias("_n"), F.sum(F.when(~bundle, F.col("vwap"))).alias("_parts"), F.max(F.when(bundle, F.col("vwap"))).alias("_b")))
    d = d.filter(F.col("_n") == size).withColumn("m", (F.col("_parts") * (1 - fee) / F.col("_b") - 1) * 100)
    days = F.datediff(F.lit(last).cast("date"), F.lit(first).cast("date")) + 1
    g = d.agg(F.count(F.lit(1)).alias("valid"), F.avg("m").alias("mean_pct"), F.min("m").alias("min_pct"), F.max("m").alias("max_pct"), F.avg((F.abs("m") > band).cast("int")).alias("outside_share"))
    g = g.withColumn("status", F.when(F.lit(through) < F.lit(last), "pending").when(F.col("valid") < F.ceil(days * share), "insufficient").otherwise("ready"))
    only = lambda c: F.when(F.col("status") == "ready", F.col(c)).alias(c)
    return g.select("status", "valid", only("mean_pct"), only("min_pct"), only("max_pct"), only("outside_share"))


def did_sensitivity(excess: DataFrame, before: tuple[str, str], after: tuple[str, str], z: float = 1.959964, power: float = .841621, least: int = 20) -> DataFrame:
    """Smallest effect a daily random walk with the baseline's step size would let show, per variant."""
    spark = excess.sparkSession
    d = lambda s: F.lit(s).cast("date")
    prev = excess.select("variant", F.date_add("day", 1).alias("day"), F.col("value").alias("_p"))
    base = excess.filter(F.col("day").between(d(before[0]), d(before[1])))
    steps = base.join(prev.filter(F.col("day") > d(before[0])), ["variant", "day"]).withColumn("s", F.col("value") - F.col("_p"))
    sigma = steps.groupBy("variant").agg(F.count(F.lit(1)).alias("differences"), F.stddev_samp("s").alias("sigma"))
    days = spark.range(1).select(F.explode(F.sequence(d(before[0]), d(after[1]))).alias("day"))
    length = lambda w: F.datediff(d(w[1]), d(w[0])) + 1
    inside = lambda w: F.col("day").between(d(w[0]), d(w[1]))
    weight = F.when(inside(after), 1 / length(after)).otherwise(0.0) - F.when(inside(before), 1 / length(before)).otherwise(0.0)
    rest = Window.partitionBy(F.lit(0)).orderBy("day").rowsBetween(0, Window.unboundedFollowing)
    factor = days.withColumn("w", weight).withColumn("tail", F.sum("w").over(rest)).filter(F.col("day") > d(before[0])).agg(F.sqrt(F.sum(F.col("tail") * F.col("tail")))).scalar()
    out = sigma.withColumn("variance_factor", factor).withColumn("log_effect", F.when(F.col("differences") >= least, (z + power) * F.col("sigma") * F.col("variance_factor")))
    return out.withColumn("relative_pct", F.expm1("log_effect") * 100)


def did_diagnostic(excess: DataFrame, least: int = 7) -> DataFrame:
    """Slope of the excess per day and correlation of the two sides' daily changes, per variant."""
    prev = excess.select("variant", F.date_add("day", 1).alias("day"), F.col("t").alias("_t"), F.col("c").alias("_c"))
    j = excess.join(prev, ["variant", "day"], "left").withColumns({"dt": F.col("t") - F.col("_t"), "dc": F.col("c") - F.col("_c")})
    x = F.datediff("day", F.lit("2000-01-01").cast("date")).cast("double")
    g = j.groupBy("variant").agg(F.count(F.lit(1)).alias("valid"), F.regr_slope("value", x).alias("_s"), F.count("dt").alias("_n"), F.corr("dt", "dc").alias("_r"))
    ok = F.col("valid") >= least
    return g.select("variant", "valid", F.when(ok, F.col("_s")).alias("slope_per_day"), F.when(ok & (F.col("_n") >= 3), F.col("_r")).alias("change_corr"))


def min_trades_groups(daily: DataFrame, members: DataFrame, through: str, thresholds: Sequence[int]) -> DataFrame:
    """Treatment and control logs for several thresholds at once; the threshold names the variant."""
    j = daily.join(members.filter(F.col("side").isin("treatment", "control")), "item_id")
    ok = (F.col("day") <= F.lit(through).cast("date")) & (F.col("expires_day").isNull() | (F.col("day") < F.col("expires_day")))
    levels = F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: F.col("n") >= t)
    e = j.filter(ok).withColumn("_t", F.explode(levels))
    size = members.groupBy("side").agg(F.count(F.lit(1)).alias("size"))
    g = e.groupBy(F.concat(F.lit("n>="), F.col("_t").cast("string")).alias("variant"), "side", "day").agg(F.count(F.lit(1)).alias("_n"), F.avg(F.log("vwap")).alias("v"))
    return g.join(size, "side").filter(F.col("_n") == F.col("size")).select("variant", "side", "day", "v")
