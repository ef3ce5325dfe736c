"""Current-market summary as of one instant."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidebook.functions.exact import exact_sum, pct_change, ratio
from tidebook.functions.timeutil import as_ts, hour_of, hours_ago, local_day, seconds_between
from tidebook.operators.candles import ask_rows
from tidebook.plans.split import newest, order_key, trailing_sums
from tidebook.session import reuse


def _span_days(ts: str) -> Column:
    return seconds_between(F.max(ts), F.min(ts)) / 86400


def _vwap(where: Column) -> Column:
    return ratio(exact_sum(F.col("unit_price") * F.col("qty"), where), F.sum(F.when(where, F.col("qty"))))


def trade_agg_24h(trades: DataFrame, as_of: str, tiered: str | None = None) -> DataFrame:
    """Count, span and the prices of the last 24 h and of the 24 h before, in one pass over the sales."""
    ts = F.col("sold_date")
    last = ts > hours_ago(as_of, 24)
    before = ts.between(hours_ago(as_of, 48), hours_ago(as_of, 24))
    t = trades.filter(ts <= as_ts(as_of))
    if tiered:
        t = t.filter(F.col("category") != tiered)
    return t.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("trades"), _span_days("sold_date").alias("span_days"), _vwap(last).alias("vwap24"),
        _vwap(before).alias("vwap_prev"), F.coalesce(F.sum(F.when(last, F.col("qty"))), F.lit(0)).alias("qty24"))


def ask_agg_24h(snapshots: DataFrame, as_of: str, tiered: str, basis: str = "ask0") -> DataFrame:
    """The same figures from the lowest asks of the tiered category."""
    ts, p = F.col("captured_at"), F.col("min_unit_price")
    return (ask_rows(snapshots.filter(ts <= as_ts(as_of)), basis, tiered).groupBy("item_id").agg(
        F.count(F.lit(1)).alias("trades"), _span_days("captured_at").alias("span_days"),
        F.avg(F.when(ts > hours_ago(as_of, 24), p)).alias("vwap24"),
        F.avg(F.when(ts.between(hours_ago(as_of, 48), hours_ago(as_of, 24)), p)).alias("vwap_prev"))
        .withColumn("qty24", F.lit(0).cast("bigint")))


def vwap_1h(trades: DataFrame, as_of: str, tiered: str | None = None) -> DataFrame:
    """Price of the last hour: (as_of - 1 h, as_of]."""
    t = trades.filter((F.col("sold_date") > hours_ago(as_of, 1)) & (F.col("sold_date") <= as_ts(as_of)))
    if tiered:
        t = t.filter(F.col("category") != tiered)
    return t.groupBy("item_id").agg(_vwap(F.lit(True)).alias("vwap1h"), F.count(F.lit(1)).alias("trades1h"),
                                    F.sum("qty").alias("qty1h"))


def last_trade(trades: DataFrame, as_of: str) -> DataFrame:
    return newest(trades.filter(F.col("sold_date") <= as_ts(as_of)), ["item_id"], ["sold_date", "id"],
                  ["unit_price", "sold_date"])


def last_snapshot(snapshots: DataFrame, as_of: str, tiered: str, basis: str = "ask0") -> DataFrame:
    """Newest book per item: plain books and tier 0, or the highest tier only."""
    s = snapshots.filter(F.col("captured_at") <= as_ts(as_of))
    if basis == "ask0":
        s = s.filter((F.col("category") != tiered) | (F.col("upgrade") == 0))
    else:
        s = s.filter((F.col("category") == tiered) & (F.col("upgrade") > 0) & (F.col("upgrade") == F.col("upgrade_max")))
    return newest(s, ["item_id"], ["captured_at", "id"], ["upgrade", "listing_count", "min_unit_price", "median"])


def _sale_figures(trades: DataFrame, as_of: str, tiered: str) -> DataFrame:
    """All that a summary takes from the sales, as conditional aggregates over one scan."""
    ts, gold = F.col("sold_date"), F.col("unit_price") * F.col("qty")
    t = trades.filter((ts <= as_ts(as_of)) & (F.col("category") != tiered))
    day, before, hour = ts > hours_ago(as_of, 24), ts.between(hours_ago(as_of, 48), hours_ago(as_of, 24)), ts > hours_ago(as_of, 1)
    qty = lambda where: F.sum(F.when(where, F.col("qty")))
    price = lambda where: ratio(exact_sum(gold, where), qty(where))
    return t.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("_trades"), _span_days("sold_date").alias("_span"), price(day).alias("_vwap24"), price(before).alias("_vwap_prev"),
        qty(day).alias("_qty24"), price(hour).alias("vwap1h"), F.count_if(hour).alias("trades1h"), qty(hour).alias("qty1h"),
        F.max_by("unit_price", order_key(t, ["sold_date", "id"])).alias("_last"), F.max("sold_date").alias("last_trade_at"))


def _ask_figures(snapshots: DataFrame, as_of: str, tiered: str) -> DataFrame:
    """All that a summary takes from the books: the newest of each kind, and the asks of the tiered category by tier."""
    ts, ask = F.col("captured_at"), F.col("category") == tiered
    s = snapshots.filter(ts <= as_ts(as_of))
    top = ask & (F.col("upgrade") > 0) & (F.col("upgrade") == F.col("upgrade_max"))
    plain = ~ask | (F.col("upgrade") == 0)
    key = order_key(s, ["captured_at", "id"])
    newest_of = lambda c, where: F.max_by(c, F.when(where, key))
    p = F.col("min_unit_price")
    out = [newest_of(c, where).alias(n) for where, names in
           ((plain, {"listing_count": "listings", "min_unit_price": "min_ask", "median": "median_ask"}),
            (top, {"upgrade": "max_upgrade", "listing_count": "max_listings", "min_unit_price": "max_last_price"})) for c, n in names.items()]
    for where, mark in ((ask & (F.coalesce("upgrade", F.lit(0)) == 0) & (p > 0), "ask"), (top & (p > 0), "max")):
        at = lambda more, where=where: F.when(where & more, p)
        out += [F.count_if(where).alias(f"_{mark}_n"), seconds_between(F.max(F.when(where, ts)), F.min(F.when(where, ts))).alias(f"_{mark}_span"),
                F.avg(at(ts > hours_ago(as_of, 24))).alias(f"_{mark}_24"), F.avg(at(ts.between(hours_ago(as_of, 48), hours_ago(as_of, 24)))).alias(f"_{mark}_prev")]
    return s.groupBy("item_id").agg(*out)


def item_summary(items: DataFrame, trades: DataFrame, snapshots: DataFrame, as_of: str, tiered: str) -> DataFrame:
    """One row per tracked item; book-priced items take their figures from the asks.

    Sales and books are each read once and reduced to one row per item by conditional aggregates, so the joins run
    on small rows.
    """
    out = (items.filter("tracked").select("item_id", "category").join(_sale_figures(trades, as_of, tiered), "item_id", "left")
           .join(_ask_figures(snapshots, as_of, tiered), "item_id", "left"))
    ask = F.col("category") == tiered
    either = lambda book, sale: F.when(ask, book).otherwise(sale)
    zero = lambda c, name=None: F.coalesce(c, F.lit(0)).alias(name or c)
    return out.select(
        "item_id", "category", either(F.lit("ask0"), F.lit("trade")).alias("price_basis"), zero(either(F.col("_ask_n"), F.col("_trades")), "trades"),
        F.coalesce(either(F.col("_ask_span") / 86400, F.col("_span")), F.lit(0.0)).alias("span_days"),
        F.coalesce(either(F.col("min_ask"), F.col("_last")), F.lit(0)).alias("last_price"),
        "last_trade_at", "vwap1h", zero("trades1h"), zero("qty1h"), either(F.col("_ask_24"), F.col("_vwap24")).alias("vwap24"),
        either(F.col("_ask_prev"), F.col("_vwap_prev")).alias("vwap_prev"), zero(either(F.lit(0).cast("bigint"), F.col("_qty24")), "qty24"),
        zero("listings"), "min_ask", "median_ask", "max_upgrade", zero("_max_n", "max_trades"), "max_last_price", F.col("_max_24").alias("max_vwap24"),
        F.col("_max_prev").alias("max_vwap_prev"), zero("max_listings"))


def market_metrics(summary: DataFrame) -> DataFrame:
    """Representative price, change, turnover, liquidity grade and ask gap."""
    ask = F.col("price_basis") == "ask0"
    per_day = F.when(F.col("span_days") > 0.5, F.col("trades") / F.col("span_days")).otherwise(F.col("trades") * 2.0)
    grade = F.when(per_day >= 60, "A").when(per_day >= 20, "B").when(per_day >= 5, "C").otherwise("D")
    change = lambda new, old: F.when((F.col(new) != 0) & (F.col(old) != 0), pct_change(F.col(new), F.col(old)))
    return summary.withColumns({
        "display_price": F.when(~ask, F.col("vwap1h")).when(F.col("last_price") > 0, F.col("last_price").cast("double")),
        "chg": change("vwap24", "vwap_prev"), "max_chg": change("max_vwap24", "max_vwap_prev"),
        "turnover": F.when(ask, 0.0).otherwise(F.coalesce("vwap24", F.col("last_price").cast("double")) * F.col("qty24")),
        "gap": F.when(~ask & (F.col("min_ask") > 0) & (F.col("vwap24") > 0), pct_change(F.col("min_ask"), F.col("vwap24"))),
        "grade": F.when(~ask, grade)})


def price_position(daily: DataFrame, prices: DataFrame, today: str, window: int = 30, least: int = 14) -> DataFrame:
    """Mid-rank percentile of a price among the item's last completed days; NULL when too few."""
    recent = Window.partitionBy("item_id").orderBy(F.desc("day"))
    days = (daily.filter((F.col("day") < F.lit(today).cast("date")) & (F.col("vwap") > 0))
            .withColumn("_rn", F.row_number().over(recent)).filter(F.col("_rn") <= window))
    j = days.join(prices.select("item_id", "price"), "item_id")
    out = j.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("days"), F.count_if(F.col("vwap") < F.col("price")).alias("below"),
        F.count_if(F.col("vwap") == F.col("price")).alias("same"), F.min("vwap").alias("low"), F.max("vwap").alias("high"),
        F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.max("price").alias("price"))
    ready = (F.col("price") > 0) & (F.col("days") >= least)
    pct = (F.col("below") + F.col("same") / 2) / F.col("days") * 100
    return out.withColumn("ready", F.coalesce(ready, F.lit(False))).withColumn("percentile", F.when(F.col("ready"), pct))


def ask_gap_asof(snapshots: DataFrame, trades: DataFrame, as_of: str, tiered: str, days: int = 7) -> DataFrame:
    """Lowest ask against the price of the 24 h before that very snapshot; one row per item and second."""
    since = hours_ago(as_of, 24 * days)
    probes = (snapshots.filter((F.col("captured_at") > since) & (F.col("captured_at") <= as_ts(as_of))
                               & (F.col("category") != tiered) & (F.col("min_unit_price") > 0))
              .select("item_id", "captured_at", "id", "min_unit_price"))
    facts = (trades.filter((F.col("sold_date") > since - F.expr("INTERVAL 24 HOURS")) & (F.col("sold_date") <= as_ts(as_of))
                           & (F.col("category") != tiered))
             .select("item_id", "sold_date", (F.col("unit_price") * F.col("qty")).cast("decimal(20,0)").alias("gold"),
                     F.col("qty").cast("decimal(10,0)").alias("q")))
    got = trailing_sums(probes, facts, ["item_id"], "captured_at", "sold_date", "24 HOURS", {"gold": "gold", "q": "q"})
    got = (got.withColumn("vwap", ratio(F.col("gold"), F.col("q"))).filter("vwap > 0")
           .withColumn("second", F.date_trunc("second", "captured_at")))
    return (newest(got, ["item_id", "second"], ["captured_at", "id"], ["min_unit_price", "vwap"])
            .withColumn("gap", pct_change(F.col("min_unit_price"), F.col("vwap"))))


def stock_hourly_last(snapshots: DataFrame, as_of: str, tiered: str, hours: int = 168) -> DataFrame:
    """Last book of each hour per item and tier over the last week, intermediate tiers left out."""
    first = F.date_trunc("hour", as_ts(as_of)) - F.expr(f"INTERVAL {hours - 1} HOURS")
    tier = F.when(F.col("category") == tiered, (F.col("upgrade") == 0) | ((F.col("upgrade") > 0) & (F.col("upgrade") == F.col("upgrade_max")))) \
        .otherwise(F.col("upgrade").isNull())
    s = snapshots.filter((F.col("captured_at") >= first) & (F.col("captured_at") <= as_ts(as_of)) & tier)
    return newest(s.withColumn("hour", hour_of("captured_at")), ["item_id", "upgrade", "hour"], ["captured_at", "id"],
                  ["captured_at", "total_qty", "listing_count", "min_unit_price"])


def depth_ladder(listings: DataFrame) -> DataFrame:
    """Quantity on offer per item and price; `listings` holds the open ones."""
    return (listings.filter((F.col("cur_count") > 0) & (F.col("unit_price") > 0))
            .groupBy("item_id", "unit_price").agg(F.sum("cur_count").alias("qty")))


def depth_quote(ladder: DataFrame, target: int) -> DataFrame:
    """Average cost of filling `target` units, best price first; NULL when the book is too thin.

    Every level offers at least one unit, so only the `target` cheapest levels of an item can matter.
    """
    ladder = reuse(ladder)
    order = Window.partitionBy("item_id").orderBy("unit_price")
    levels = ladder.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= target)
    levels = levels.withColumn("_prev", F.coalesce(F.sum("qty").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    take = F.least(F.col("qty"), F.greatest(F.lit(target) - F.col("_prev"), F.lit(0)))
    filled = (levels.withColumn("take", take).groupBy("item_id").agg(
        F.sum("take").alias("filled"), F.sum(F.col("take") * F.col("unit_price")).alias("_cost"),
        F.count_if(F.col("take") > 0).alias("levels_used")))
    whole = ladder.groupBy("item_id").agg(F.sum("qty").alias("total_qty"), F.min("unit_price").alias("best_ask"),
                                          F.min_by("qty", "unit_price").alias("best_qty"))
    return filled.join(whole, "item_id").select(
        "item_id", F.lit(target).alias("target"), "filled", "levels_used",
        F.when(F.col("filled") == target, F.col("_cost") / target).alias("avg_cost"), "total_qty", "best_ask", "best_qty")


def event_fanout(calendar: DataFrame, items: DataFrame, pairs_a_task: int = 1_000_000) -> DataFrame:
    """(event, item) pairs: the listed items, or every item for an event that names none.

    An event for everybody is by definition paired with the whole dimension. Those pairs form a grid of events by items, cut
    into tiles of about `pairs_a_task`: events are dealt over `rows` keys and items over `columns`, both taken from
    the measured sizes so that the fewest rows are sent, and an event and an item meet in the tile of their two keys. A
    single event with very many items is cut along the items, many events with few items along the events.
    """
    everyone = F.coalesce(F.size("related"), F.lit(0)) <= 0
    named = calendar.filter(~everyone).withColumn("item_id", F.explode("related")).drop("related")
    general = calendar.filter(everyone).drop("related")
    rows, columns = tiles(general.count(), items.count(), pairs_a_task)
    keys = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))
    ids = items.select("item_id", F.pmod(F.xxhash64("item_id"), F.lit(columns)).alias("_c"), keys(rows).alias("_r"))
    general = general.select("*", F.pmod(F.xxhash64("id"), F.lit(rows)).alias("_r"), keys(columns).alias("_c"))
    return named.unionByName(general.join(ids, ["_r", "_c"]).drop("_r", "_c"))


def tiles(events: int, items: int, pairs_a_task: int) -> tuple[int, int]:
    """Rows and columns of a grid of events by items with tiles of about `pairs_a_task` pairs; each event is sent once a
    column and each item once a row, so the cheapest grid has tiles with about as many events as items."""
    needed = -(-events * items // pairs_a_task)
    rows = min(max(1, round(math.sqrt(needed * events / max(1, items)))), max(1, needed), max(1, events))
    return rows, min(max(1, -(-needed // rows)), max(1, items))


def top_movers(metrics: DataFrame, direction: str, keep: int = 10, min_qty: int = 100) -> DataFrame:
    """Largest rises or falls among liquid items, ties by id."""
    up = direction == "up"
    rows = metrics.filter((F.col("price_basis") == "trade") & (F.col("vwap24") > 0) & (F.col("vwap_prev") > 0)
                          & (F.col("qty24") >= min_qty) & ((F.col("chg") > 0) if up else (F.col("chg") < 0)))
    order = [F.desc("chg") if up else F.asc("chg"), F.asc("item_id")]
    top = rows.orderBy(*order).limit(keep)
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def category_turnover(metrics: DataFrame, extra: DataFrame) -> DataFrame:
    """Turnover per category; `extra` (item_id, category) lists further memberships."""
    own = metrics.select("item_id", "category", "turnover")
    more = metrics.select("item_id", "turnover").join(extra, "item_id").select("item_id", "category", "turnover")
    return own.unionByName(more).groupBy("category").agg(F.sum("turnover").alias("turnover"), F.count(F.lit(1)).alias("items"))


def market_list(metrics: DataFrame, category: str | None, text: str, sort: str, descending: bool = True,
                keep: int | None = None) -> DataFrame:
    """Category and name search with any sort column, missing values last."""
    plain = lambda c: F.regexp_replace(F.lower(c), r"\s", "")
    rows = metrics.filter(plain(F.col("item_id")).contains(plain(F.lit(text))))
    if category:
        rows = rows.filter(F.col("category") == category)
    order = [F.desc_nulls_last(sort) if descending else F.asc_nulls_last(sort), F.asc("item_id")]
    return rows.orderBy(*order) if keep is None else rows.orderBy(*order).limit(keep)


def set_cost(summary: DataFrame) -> DataFrame:
    """Cost of one item per slot and of the whole set, by role."""
    price = F.when(F.col("min_ask") > 0, F.col("min_ask")).otherwise(F.coalesce("last_price", F.lit(0)))
    slots = summary.groupBy("role", "slot").agg(F.count(F.lit(1)).alias("cards"), F.sum(price).alias("cost"),
                                                F.max("last_price").alias("dearest"))
    role = Window.partitionBy("role")
    return slots.withColumn("set_cost", F.sum("cost").over(role))


def stat_transition(base: Column, top: Column) -> Column:
    """Merge two ' · ' separated stat lines into 'name a→b'; show both when the names differ."""
    shape = r"^(.*?)\s+([+-]?\d+(?:\.\d+)?%?)$"
    parts = lambda c: F.split(c, " · ")
    name = lambda p: F.regexp_extract(p, shape, 1)
    val = lambda p: F.regexp_extract(p, shape, 2)
    same = ((F.size(parts(base)) == F.size(parts(top)))
            & F.forall(F.concat(parts(base), parts(top)), lambda p: p.rlike(shape))
            & (F.transform(parts(base), name) == F.transform(parts(top), name)))
    merged = F.array_join(F.zip_with(parts(base), parts(top), lambda a, b: F.concat(
        name(a), F.lit(" "), F.when(val(a) == val(b), val(a)).otherwise(F.concat(val(a), F.lit("→"), val(b))))), " · ")
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    return (F.when(blank(base), F.when(blank(top), F.lit("")).otherwise(F.concat(F.lit("top "), top)))
            .when(blank(top) | (base == top), base).when(same, merged)
            .otherwise(F.concat(F.lit("base "), base, F.lit(" → top "), top)))


def bundle_margin_24h(trades: DataFrame, bundles: DataFrame, as_of: str, fee: float = 0.03) -> DataFrame:
    """Value of the parts after the fee against the bundle; only when every part traded.

    `bundles` has bundle_id and part_id.
    """
    recent = trades.filter((F.col("sold_date") > hours_ago(as_of, 24)) & (F.col("sold_date") <= as_ts(as_of)))
    price = recent.groupBy("item_id").agg(_vwap(F.lit(True)).alias("vwap"), F.count(F.lit(1)).alias("n"))
    parts = bundles.join(price.select(F.col("item_id").alias("part_id"), "vwap"), "part_id", "left")
    total = parts.groupBy("bundle_id").agg(
        F.count(F.lit(1)).alias("required"), F.count("vwap").alias("observed"), F.sum("vwap").alias("_sum"))
    whole = F.col("required") == F.col("observed")
    return (total.join(price.select(F.col("item_id").alias("bundle_id"), F.col("vwap").alias("bundle_vwap"), F.col("n").alias("bundle_n")),
                       "bundle_id", "left")
            .select("bundle_id", "required", "observed", "bundle_vwap", "bundle_n",
                    F.when(whole, F.col("_sum")).alias("parts_sum"),
                    F.when(whole & (F.col("bundle_vwap") > 0), F.col("_sum") * (1 - fee) - F.col("bundle_vwap")).alias("difference"))
            .withColumn("pct", F.col("difference") / F.col("bundle_vwap") * 100))


def bundle_margin_daily(daily: DataFrame, bundles: DataFrame, stock: DataFrame, until: str, fee: float = 0.03,
                        benchmark: DataFrame | None = None) -> DataFrame:
    """The same by day until the expiry day, with stock and a benchmark index beside it."""
    d = daily.filter(F.col("day") <= F.lit(until).cast("date"))
    parts = (bundles.join(d.select(F.col("item_id").alias("part_id"), "day", "vwap"), "part_id")
             .groupBy("bundle_id", "day").agg(F.count("vwap").alias("observed"), F.sum("vwap").alias("_sum")))
    need = bundles.groupBy("bundle_id").agg(F.count(F.lit(1)).alias("required"))
    own = d.select(F.col("item_id").alias("bundle_id"), "day", F.col("vwap").alias("bundle_vwap"), F.col("qty").alias("bundle_qty"))
    out = (own.join(need, "bundle_id").join(parts, ["bundle_id", "day"], "left")
           .join(stock.select(F.col("item_id").alias("bundle_id"), "day", F.col("value").alias("stock")), ["bundle_id", "day"], "left"))
    if benchmark is not None:
        out = out.join(benchmark.select("day", F.col("value").alias("benchmark")), "day", "left")
    whole = F.col("observed") == F.col("required")
    return (out.withColumn("parts_sum", F.when(whole, F.col("_sum")))
            .withColumn("margin", F.col("parts_sum") * (1 - fee) - F.col("bundle_vwap")).drop("_sum", "required"))


def upgrade_economics(summary: DataFrame, floor: Column, cards_per_tier: float = 2.5) -> DataFrame:
    """Expected material for the highest tier against what that tier sells for."""
    last, top = F.col("last_price"), F.col("max_last_price")
    rows = summary.filter((F.col("price_basis") == "ask0") & (F.col("max_upgrade") > 0))
    return (rows.select("item_id", "last_price", "max_last_price", (F.col("max_upgrade") * cards_per_tier).alias("expected_cards"))
            .withColumn("material_cost", F.col("expected_cards") * floor)
            .withColumn("premium", F.when((last > 0) & (top > 0), (top - last).cast("double")))
            .withColumn("expected_total", F.when(last > 0, last + F.col("material_cost")))
            .withColumn("difference", F.col("premium") - F.col("material_cost")))


def market_meta(bars: DataFrame, items: DataFrame, deltas: DataFrame, as_of: str, tz: str) -> DataFrame:
    """Totals shown beside the market: sales, items, first and last day, quantity seen leaving the book in 7 days."""
    spark_one = bars.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("trades"), local_day(F.min("hour"), tz).alias("first_day"),
                         local_day(F.max("hour"), tz).alias("last_day"))
    live = deltas.filter((F.col("reason") != "expired") & F.col("invalidated_at").isNull()
                         & (F.col("observed_at") > hours_ago(as_of, 168)))
    return spark_one.select(
        "trades", items.filter("tracked").agg(F.count(F.lit(1))).scalar().alias("items"), "first_day", "last_day",
        live.agg(F.coalesce(F.sum("qty_sold"), F.lit(0))).scalar().alias("depletion_qty"))
