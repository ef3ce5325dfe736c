"""Bind the given tables to the market model: sales, listings, snapshots, runs, sources, notices.

Only projections and one-pass aggregates happen here, so every binding grows with the given tables.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidebook.operators.candles import candles_1h
from tidebook.operators.ingest import book_snapshot
from tidebook.session import pin_utc

AS_OF = "2024-01-30 12:00:00"


@dataclass
class Inputs:
    spark: SparkSession
    folder: str
    as_of: str = AS_OF

    def __post_init__(self) -> None:
        pin_utc(self.spark)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def stream_table(self, name: str) -> DataFrame:
        schema = self.table(name).schema
        return self.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(self.folder)

    def stream_trades(self, wide: bool = True) -> DataFrame:
        return self.trades(wide, self.stream_table("events"))

    def _events(self, events: DataFrame | None = None) -> DataFrame:
        return (self.table("events") if events is None else events).select(
            F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("sold_date"), "user_id",
            F.col("event_type").alias("category"),
            F.round(F.col("value") * 100).cast("bigint").alias("unit_price"),
            F.regexp_extract("props", r'"k"\s*:\s*(-?\d+)', 1).cast("int").alias("k"))

    def trades(self, wide: bool = True, events: DataFrame | None = None) -> DataFrame:
        """Sales of 40 items (`wide`) or of 5 busy items."""
        item = F.concat_ws("-", "category", (F.col("user_id") % 8).cast("string")) if wide else F.col("category")
        return self._events(events).select(
            "id", item.alias("item_id"), "category", "sold_date", "unit_price",
            (F.lit(1) + F.col("k") % 10).cast("int").alias("qty"), F.lit(0).alias("reinforce"), "user_id", "k")

    def items(self, wide: bool = True) -> DataFrame:
        return (self.trades(wide).groupBy("item_id", "category").agg(F.min("sold_date").alias("added_at"))
                .select("item_id", "category", F.lit(True).alias("tracked"),
                        F.lit(3600).alias("poll_interval_sec"), "added_at"))

    def book_rows(self, wide: bool = True) -> DataFrame:
        """Open-book rows as polled: one poll per item and hour; `error` plays the tiered category."""
        tier = F.when(F.col("category") == "error", F.when(F.col("k") % 2 == 0, 0).otherwise(3))
        return self.trades(wide).select(
            "id", "item_id", "category", F.date_trunc("hour", "sold_date").alias("batch"),
            F.col("sold_date").alias("seen_at"), "unit_price", "qty", tier.cast("int").alias("upgrade"),
            F.when(F.col("category") == "error", 3).cast("int").alias("upgrade_max"))

    def snapshots(self, wide: bool = True) -> DataFrame:
        return book_snapshot(self.book_rows(wide))

    def listing_rows(self) -> DataFrame:
        """Observations of open listings; a listing is one (type, user) pair, a poll is one item-day."""
        day = F.date_trunc("day", "sold_date")
        return self.trades().select(
            F.concat_ws(":", "category", F.col("user_id").cast("string")).alias("auction_no"), "item_id",
            "category", day.alias("batch"), F.col("sold_date").alias("observed_at"), "id", "unit_price",
            F.col("k").alias("cur_count"),
            F.when(F.col("k") % 3 != 0, F.col("k") + 1).cast("int").alias("reg_count"),
            (day + F.make_dt_interval(days=1 + F.col("k") % 5)).alias("expire_date"),
            F.when((F.col("category") == "error") & (F.col("user_id") % 4 < 3),
                   F.element_at(F.array(F.lit(0), F.lit(3), F.lit(1)), (F.col("user_id") % 4 + 1).cast("int")))
            .cast("int").alias("upgrade"),
            F.when((F.col("category") == "error") & (F.col("user_id") % 4 < 3), 3).cast("int").alias("upgrade_max"))

    def runs(self) -> DataFrame:
        """One poll per item and hour; part of the polls of `error` items failed."""
        hour = F.date_trunc("hour", "sold_date")
        failed = (F.col("category") == "error") & (F.hour("hour") % 4 == 0)
        return (self.trades().groupBy("item_id", "category", hour.alias("hour"))
                .agg(F.min("sold_date").alias("started_at"), F.max("sold_date").alias("finished_at"),
                     F.count(F.lit(1)).cast("int").alias("sold_rows"), F.sum("qty").cast("int").alias("listing_rows"))
                .withColumn("saturated", F.col("sold_rows") >= 3)
                .withColumn("error", F.when(failed, F.lit("timeout"))))

    def candles(self, wide: bool = True) -> DataFrame:
        return candles_1h(self.trades(wide), ["item_id", "category"])

    def raw_max_id(self, before: str = "2024-01-29 12:00:00"):
        """Highest sale id known when the bars were last built, as a scalar subquery."""
        return self._events().filter(F.col("sold_date") < before).agg(F.max("id")).scalar()

    def known_bars(self, wide: bool = True) -> DataFrame:
        """Bars as stored: built from the sales known at that time."""
        t = self.trades(wide)
        return candles_1h(t.filter(F.col("id") <= self.raw_max_id()), ["item_id", "category"])

    def source_trades(self) -> DataFrame:
        """The same history held by three overlapping sources."""
        t = self.trades()
        day = F.dayofmonth("sold_date")
        a = t.filter(day <= 12).withColumn("source", F.lit("A")).withColumn("source_rank", F.lit(0))
        b = t.filter((day >= 10) & (F.col("id") % 2 == 0)).withColumn("source", F.lit("B")).withColumn("source_rank", F.lit(1))
        c = t.filter((day >= 10) & (F.col("id") % 2 == 1)).withColumn("source", F.lit("C")).withColumn("source_rank", F.lit(2))
        return a.unionByName(b).unionByName(c)

    def source_snapshots(self) -> DataFrame:
        s = self.snapshots()
        day = F.dayofmonth("captured_at")
        a = s.filter(day <= 12).withColumn("source", F.lit("A")).withColumn("source_rank", F.lit(0))
        b = s.filter(day >= 10).withColumn("source", F.lit("B")).withColumn("source_rank", F.lit(1))
        c = s.filter(day >= 18).withColumn("source", F.lit("C")).withColumn("source_rank", F.lit(2))
        return a.unionByName(b).unionByName(c)

    def owners(self, wide: bool = True) -> DataFrame:
        """Ownership epochs: A until day 11, B until day 20, C from then on."""
        epoch = lambda s, a, b: F.struct(
            F.lit(s).alias("source"), F.lit(a).cast("timestamp").alias("valid_from"),
            F.lit(b).cast("timestamp").alias("valid_to"))
        epochs = F.array(epoch("A", None, "2024-01-11 00:00:00"),
                         epoch("B", "2024-01-11 00:00:00", "2024-01-20 00:00:00"),
                         epoch("C", "2024-01-20 00:00:00", None))
        return self.items(wide).select("item_id", F.explode(epochs).alias("e")).select("item_id", "e.*")

    def calendar(self) -> DataFrame:
        """Dated events; some name their items, some apply to all."""
        t = self.trades()
        item = F.col("item_id")
        related = (F.when(F.col("k") % 3 == 1, F.array(item))
                   .when(F.col("k") % 3 == 2, F.array_distinct(F.array(item, F.concat(F.col("category"), F.lit("-0"))))))
        return t.select("id", F.concat(F.lit("notice "), F.col("id").cast("string")).alias("name"),
                        F.col("category").alias("type"), (F.col("sold_date") - F.expr("INTERVAL 1 DAY")).alias("announced_at"),
                        F.col("sold_date").alias("starts_at"), (F.col("sold_date") + F.expr("INTERVAL 3 DAYS")).alias("ends_at"),
                        related.alias("related"))

    def health_checks(self) -> DataFrame:
        """Check lines of three sources."""
        t = self.trades()
        source = F.element_at(F.array(*[F.lit(s) for s in "ABC"]), (F.col("user_id") % 3 + 1).cast("int"))
        return t.select("id", source.alias("source"), F.col("sold_date").alias("checked_at"),
                        F.when(F.col("k") != 50, F.col("k") / 2).alias("gap_min"),
                        F.when(F.col("k") != 75, F.when(F.col("k") % 10 == 0, F.col("k") % 4).otherwise(0)).cast("bigint").alias("stale_items"))

    def source_epochs(self) -> DataFrame:
        """Times in which each source is expected to report: A until day 20, B from day 11, C from day 20."""
        rows = ("SELECT * FROM VALUES ('A', NULL, TIMESTAMP '2024-01-20'), ('B', TIMESTAMP '2024-01-11', NULL), "
                "('C', TIMESTAMP '2024-01-20', NULL) AS e(source, valid_from, valid_to)")
        return self.spark.sql(rows)

    def scan_observations(self) -> DataFrame:
        """One scan per hour over the items seen in it."""
        low = F.min(F.when(F.col("k") % 3 != 0, F.col("unit_price")))
        return (self.trades().groupBy(F.date_trunc("hour", "sold_date").alias("scan_id"), "item_id")
                .agg(low.alias("min_price"), F.count_if(F.col("k") % 3 != 0).alias("listing_count"), F.min("k").alias("_k"))
                .withColumn("status", F.when(F.col("_k") == 0, "failed").when(F.col("min_price").isNotNull(), "observed").otherwise("empty"))
                .drop("_k"))

    def catalog(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").cast("string").alias("item_id"), F.col("p_name").alias("item_name"),
                                         F.col("p_type").alias("item_type"), F.col("p_brand").alias("item_kind"))

    def notices(self) -> DataFrame:
        return self.table("pages").select("page_id", "url", "html")

    def volume_sales(self) -> DataFrame:
        """Order lines as day-grain sales, for volume."""
        return self.table("lineitem").select(
            F.col("l_suppkey").cast("string").alias("item_id"), F.col("l_shipdate").cast("timestamp").alias("sold_date"),
            F.round(F.col("l_extendedprice") / F.col("l_quantity")).cast("bigint").alias("unit_price"),
            F.col("l_quantity").cast("int").alias("qty"), F.col("l_orderkey").alias("id"),
            F.col("l_linenumber").alias("reinforce"))
