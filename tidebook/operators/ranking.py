"""Turnover rankings, floors and the choice of what to track."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidebook.functions.exact import exact_sum, ratio
from tidebook.functions.timeutil import as_ts, hours_ago, seconds_between
from tidebook.plans.quantiles import exact_quantiles
from tidebook.plans.split import newest, order_key
from tidebook.session import reuse


def last_sales(trades: DataFrame, as_of: str, limit: int = 100) -> DataFrame:
    """The latest `limit` sales per item, what one response shows; Spark limits groups before the shuffle."""
    order = Window.partitionBy("item_id").orderBy(F.desc("sold_date"), F.desc("id"))
    return (trades.filter(F.col("sold_date") <= as_ts(as_of))
            .withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= limit).drop("_rn"))


def turnover_estimate(trades: DataFrame, as_of: str, limit: int = 100) -> DataFrame:
    """24 h turnover from one response; a response that does not reach back 24 h is scaled up and marked."""
    recent = F.col("sold_date") >= hours_ago(as_of, 24)
    sales = last_sales(trades, as_of, limit)
    s = sales.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("_n"), F.min("sold_date").alias("_a"), F.max("sold_date").alias("_z"),
        F.coalesce(exact_sum(F.col("unit_price") * F.col("qty"), recent), F.lit(0)).cast("double").alias("_gold"),
        F.coalesce(F.sum(F.when(recent, F.col("qty"))), F.lit(0)).alias("observed_qty"),
        F.count_if(recent).alias("trades"), F.max_by("unit_price", order_key(sales, ["sold_date", "id"])).alias("last_price"))
    full = (F.col("_n") == limit) & (F.col("_a") > hours_ago(as_of, 24))
    covered = F.greatest(F.lit(60.0), seconds_between(F.col("_z"), F.col("_a")) * F.col("_n") / (F.col("_n") - 1))
    span = F.when(full, covered / 60)
    gold = F.when(full, F.col("_gold") * 1440 / (covered / 60)).otherwise(F.col("_gold"))
    return s.select("item_id", F.floor(gold + 0.5).alias("turnover"), "observed_qty", "trades", "last_price",
                    span.alias("span_minutes"), F.when(full, "estimated").otherwise("api_complete").alias("basis"))


def collected_turnover(trades: DataFrame, as_of: str) -> DataFrame:
    """24 h totals of items whose sales are all collected."""
    recent = trades.filter((F.col("sold_date") > hours_ago(as_of, 24)) & (F.col("sold_date") <= as_ts(as_of)))
    return recent.groupBy("item_id").agg(
        exact_sum(F.col("unit_price") * F.col("qty")).cast("bigint").alias("turnover"), F.sum("qty").alias("observed_qty"),
        F.count(F.lit(1)).alias("trades"), F.max_by("unit_price", order_key(recent, ["sold_date", "id"])).alias("last_price"),
        F.lit(None).cast("double").alias("span_minutes"), F.lit("collected").alias("basis"))


def turnover_rank(estimates: DataFrame, collected: DataFrame, keep: int = 100) -> DataFrame:
    """Collected totals replace estimates; the `keep` largest, ties by item."""
    rows = estimates.join(collected.select("item_id"), "item_id", "left_anti").unionByName(collected)
    order = [F.desc("turnover"), F.asc("item_id")]
    top = rows.orderBy(*order).limit(keep)
    return (top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
            .withColumn("factor", F.when(F.col("span_minutes") > 0, 1440 / F.col("span_minutes"))))


def liquidity_scan(trades: DataFrame, as_of: str, limit: int = 100, least: int = 30) -> DataFrame:
    """Minutes per trade and median price of the latest sales; at most `limit` prices are gathered per item."""
    sales = last_sales(trades, as_of, limit)
    s = sales.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("trades"), (seconds_between(F.max("sold_date"), F.min("sold_date")) / 60).alias("span_min"),
        F.sort_array(F.collect_list("unit_price")).alias("_p"))
    return (s.filter(F.col("trades") >= least)
            .select("item_id", "trades", "span_min", F.element_at("_p", (F.floor(F.col("trades") / 2) + 1).cast("int")).alias("median"),
                    (F.col("span_min") / F.col("trades")).alias("minutes_per_trade")))


def universe_select(catalog: DataFrame, include: str, exclude: str | None, tracked: DataFrame) -> DataFrame:
    """Catalogue names matching a pattern and not tracked yet."""
    rows = catalog.filter(F.col("item_name").rlike(include))
    if exclude:
        rows = rows.filter(~F.col("item_name").rlike(exclude))
    return rows.join(tracked.select("item_id"), "item_id", "left_anti")


def market_universe(catalog: DataFrame, kind: str, card: str) -> DataFrame:
    """Stackable goods that are not cards."""
    return catalog.filter((F.col("item_kind") == kind) & ~F.col("item_name").rlike(card))


def type_histogram(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("item_type").agg(F.count(F.lit(1)).alias("items"))


# A search fragment needs a Hangul syllable and none of these brackets.
HANGUL, BRACKETS = "[가-힣]", r"[\[\]():]"


def name_bigrams(catalog: DataFrame, script: str = HANGUL) -> DataFrame:
    """Distinct two-character fragments of names, with the number of names that contain each."""
    n = F.length("item_name")
    grams = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(F.col("item_name"), i, F.lit(2)))
    return (catalog.filter(n >= 2).select("item_id", F.explode(F.array_distinct(grams)).alias("gram"))
            .filter(F.col("gram").rlike(script) & ~F.col("gram").rlike(BRACKETS))
            .groupBy("gram").agg(F.count(F.lit(1)).alias("names")))


def floor_index(observations: DataFrame) -> DataFrame:
    """Per complete scan: lowest entity, floor-index quantiles of the entity lows, and listing totals.

    `observations` has scan_id, item_id, status, min_price, listing_count.
    """
    whole = (observations.groupBy("scan_id")
             .agg(F.count(F.lit(1)).alias("scanned"), F.count_if(F.col("status").isin("failed", "pending")).alias("_bad"))
             .filter("_bad = 0").drop("_bad"))
    seen = observations.filter((F.col("status") == "observed") & F.col("min_price").isNotNull())
    floors = exact_quantiles(
        seen, ["scan_id"], "min_price", [("p10", "floor", .1), ("median", "floor", .5)],
        carry={"_id": F.min("item_id"), "_l": F.sum("listing_count")},
        extra=[F.min("min_price").alias("min_unit_price"), F.min_by("_id", "min_price").alias("min_item_id"),
               F.sum("_w").alias("with_listings"), F.sum("_l").alias("total_listings")])
    return whole.join(floors, "scan_id")


def cheapest_k(rows: DataFrame, responses: DataFrame, k: int = 10) -> DataFrame:
    """The k cheapest distinct listings of a scan and their mean, or NULL when they cannot be trusted.

    A malformed row, fewer than k listings beside a capped response, or a capped response that ends below the
    k-th price withholds the result. `responses` has scan_id and the highest price of each capped response.
    """
    bad = (F.col("cnt").isNull() | (F.col("cnt") < 1) | F.col("auction_no").isNull() | F.col("unit_price").isNull()
           | (F.col("unit_price") <= 0))
    per_scan = rows.groupBy("scan_id").agg(F.max(bad).alias("malformed"))
    unique = newest(rows.filter(~bad), ["scan_id", "auction_no"], ["position"], ["unit_price"])
    order = Window.partitionBy("scan_id").orderBy("unit_price", "auction_no")
    top = (unique.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= k)
           .groupBy("scan_id").agg(F.count(F.lit(1)).alias("found"), F.max("unit_price").alias("kth"),
                                   F.sum("unit_price").alias("_sum"),
                                   F.sort_array(F.collect_list(F.struct("unit_price", "auction_no"))).alias("_top")))
    caps = responses.groupBy("scan_id").agg(F.min("boundary").alias("boundary"))
    out = per_scan.join(top, "scan_id", "left").join(caps, "scan_id", "left")
    hidden = F.col("boundary").isNotNull() & ((F.coalesce("found", F.lit(0)) < k) | (F.col("boundary") < F.col("kth")))
    trusted = ~F.col("malformed") & ~hidden
    return out.select("scan_id", "malformed", "found", trusted.alias("trusted"),
                      F.when(trusted & (F.col("found") == k), F.col("_sum") / k).alias("mean_price"),
                      F.when(trusted, F.array_join(F.col("_top.auction_no"), ",")).alias("listings"))


def matched_floor_change(observations: DataFrame, min_common: int = 20) -> DataFrame:
    """Hour-over-hour log change of the p10 floor: all entities, and only those seen in both scans."""
    bad = observations.filter(F.col("status").isin("failed", "pending")).select("scan_id").distinct()
    v = (observations.join(bad, "scan_id", "left_anti").filter((F.col("status") == "observed") & (F.col("min_price") > 0))
         .select("scan_id", "item_id", F.col("min_price").alias("p")))
    v = reuse(v)
    p10 = lambda df, value, name: exact_quantiles(df, ["scan_id"], value, [(name, "floor", .1)], extra=[F.max("_n").alias(f"{name}_n")])
    every = p10(v, "p", "all")
    prior = every.select((F.col("scan_id") + F.expr("INTERVAL 1 HOUR")).alias("scan_id"), F.col("all").alias("old"), F.col("all_n").alias("before"))
    both = v.join(v.select((F.col("scan_id") + F.expr("INTERVAL 1 HOUR")).alias("scan_id"), "item_id", F.col("p").alias("q")), ["scan_id", "item_id"])
    out = (every.join(prior, "scan_id").join(p10(both, "p", "new_m"), "scan_id").join(p10(both, "q", "old_m").drop("old_m_n"), "scan_id")
           .filter(F.col("new_m_n") >= min_common))
    log100 = lambda a, b: F.log(F.col(a) / F.col(b)) * 100
    return (out.select("scan_id", F.col("new_m_n").alias("common"), "before", F.col("all_n").alias("after"),
                       log100("all", "old").alias("raw"), log100("new_m", "old_m").alias("matched"))
            .withColumn("difference", F.col("raw") - F.col("matched")))
