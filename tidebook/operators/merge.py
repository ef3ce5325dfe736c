"""One history out of several sources with time-sliced ownership."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidebook.functions.timeutil import as_ts, hour_of
from tidebook.operators.candles import candles_1h
from tidebook.operators.ingest import SALE_KEY
from tidebook.plans.split import chunk_offsets, first_keys, newest, numbered, order_key, rows_of

def _slice(source_id: Column, chunk_rows: int, *before: Column) -> Column:
    """What orders the slices: the ranks `before`, whatever their size, then the stretch of ids."""
    return F.struct(*[c.alias(f"_{i}") for i, c in enumerate(before)], F.floor(source_id / chunk_rows).alias("_ids"))


_FIRST = ["source_rank", "source_id"]


def _firsts(rows: DataFrame, key: Sequence[str], chunk_rows: int, late: Sequence[Column] = (), **more: Column) -> DataFrame:
    """The place of the first copy of every key, its slice of the new numbers, and `more` aggregates over all copies."""
    place = order_key(rows, _FIRST)
    found = first_keys(rows, key, _FIRST, _rank=F.min_by("source_rank", place), _id=F.min_by("source_id", place), **more)
    return found.withColumn("_slice", _slice(F.col("_id"), chunk_rows, *late, F.col("_rank"))).drop("_rank", "_id")


def _renumbered(rows: DataFrame, key: Sequence[str], firsts: DataFrame) -> DataFrame:
    """The first copies, numbered slice by slice. The slices are counted on `firsts`, a few numbers a key, so the facts are
    fetched once and neither counted nor written."""
    offsets = chunk_offsets(firsts, [], "_slice", {"n": F.count(F.lit(1))})
    inside = Window.partitionBy("_slice").orderBy("source_id")
    found = rows_of(rows, key, _FIRST, firsts).withColumn("_i", F.row_number().over(inside))
    return found.join(offsets, "_slice").withColumn("id", F.col("_before_n") + F.col("_i")).drop("_slice", "_i", "_before_n")


def merge_trades(sources: DataFrame, as_of: str, key: Sequence[str] = SALE_KEY, chunk_rows: int = 1 << 20) -> DataFrame:
    """One row per natural key, the copy of the lowest (rank, id) kept, renumbered in that order.

    The first copies are found on keys and places alone, combined before the shuffle; the rows themselves are fetched by a
    join on the same keys.
    """
    rows = sources.filter(F.col("sold_date") <= as_ts(as_of)).withColumnRenamed("id", "source_id")
    return _renumbered(rows, key, _firsts(rows, key, chunk_rows))


def merge_guards(sources: DataFrame, payload: Sequence[str], key: Sequence[str] = SALE_KEY) -> DataFrame:
    """Keys repeated inside one source, and keys whose content differs between sources."""
    per_source = sources.groupBy("source", *key).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(*payload)).alias("a"), F.max(F.struct(*payload)).alias("z"))
    repeated = per_source.filter("n > 1").select(F.lit("repeated").alias("kind"), "source", *key)
    differing = (per_source.groupBy(*key).agg(F.min("a").alias("a"), F.max("z").alias("z"))
                 .filter(~F.col("a").eqNullSafe(F.col("z")))
                 .select(F.lit("conflict").alias("kind"), F.lit(None).cast("string").alias("source"), *key))
    return repeated.unionByName(differing)


def owner_guards(owners: DataFrame, observed: DataFrame, ts: str) -> DataFrame:
    """Overlapping epochs, holes between epochs, and items with observations nobody owns.

    An item's epochs are a short configured list, so they are walked in time order by a window.
    """
    far = F.lit("9999-12-31").cast("timestamp")
    order = Window.partitionBy("item_id").orderBy(F.asc_nulls_first("valid_from"), F.asc_nulls_last("valid_to"))
    o = owners.withColumn("_end", F.coalesce("valid_to", far)).withColumn(
        "_reached", F.max("_end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    o = o.withColumn("_prev", F.lag("_end").over(order)).withColumn("_no", F.row_number().over(order))
    start = F.coalesce("valid_from", F.lit("0001-01-01").cast("timestamp"))
    overlap = o.filter(F.col("_reached") > start).select("item_id", F.lit("overlap").alias("kind"), "valid_from")
    gap = o.filter((F.col("_no") > 1) & ~F.col("_prev").eqNullSafe(F.col("valid_from")) & ~(F.col("_reached") > start)) \
        .select("item_id", F.lit("gap").alias("kind"), "valid_from")
    epochs = owners.groupBy("item_id").agg(F.collect_list(F.struct("valid_from", "valid_to")).alias("_e"))
    inside = F.exists("_e", lambda e: (e["valid_from"].isNull() | (e["valid_from"] <= F.col(ts)))
                      & (e["valid_to"].isNull() | (F.col(ts) < e["valid_to"])))
    lost = (observed.select("item_id", ts).join(epochs, "item_id", "left")
            .filter(~F.coalesce(inside, F.lit(False))).groupBy("item_id").agg(F.min(ts).alias("valid_from"))
            .select("item_id", F.lit("unowned").alias("kind"), "valid_from"))
    return overlap.unionByName(gap).unionByName(lost)


def owned(rows: DataFrame, owners: DataFrame, start: Column, end: Column | None = None) -> DataFrame:
    """Rows observed by the source that owns their item at that time: equal (item, source), then [from, to)."""
    end = start if end is None else end
    o = owners.select("item_id", "source", "valid_from", "valid_to")
    inside = ((F.col("valid_from").isNull() | (F.col("valid_from") <= start))
              & (F.col("valid_to").isNull() | (end < F.col("valid_to"))))
    return rows.join(o, ["item_id", "source"]).filter(inside).drop("valid_from", "valid_to")


def merge_snapshots(sources: DataFrame, owners: DataFrame, as_of: str, chunk_rows: int = 1 << 20) -> DataFrame:
    """Owned snapshots of all sources, renumbered by (rank, id)."""
    rows = sources.filter(F.col("captured_at") <= as_ts(as_of)).withColumnRenamed("id", "source_id")
    mine = owned(rows, owners, F.col("captured_at"))
    mine = mine.withColumn("_slice", _slice(F.col("source_id"), chunk_rows, F.col("source_rank")))
    return numbered(mine, [], "_slice", ["source_id", "item_id", "captured_at"], "id").drop("_slice")


def snapshot_conflicts(merged: DataFrame) -> DataFrame:
    """Owned snapshots that claim the same item, time and tier."""
    return (merged.groupBy("item_id", "captured_at", F.coalesce("upgrade", F.lit(-1)).alias("tier"))
            .agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1"))


def owned_hours(bars: DataFrame, owners: DataFrame) -> DataFrame:
    """Bars counted per item and source: wholly inside an epoch of the source, or cut by its end."""
    last = F.col("hour") + F.expr("INTERVAL '59:59.999999' MINUTE TO SECOND")
    o = owners.select("item_id", "source", "valid_from", "valid_to")
    begun = ((F.col("valid_from").isNull() | (F.col("valid_from") <= F.col("hour")))
             & (F.col("valid_to").isNull() | (F.col("hour") < F.col("valid_to"))))
    j = bars.select("item_id", "source", "hour").join(o, ["item_id", "source"]).filter(begun)
    cut = F.coalesce(last >= F.col("valid_to"), F.lit(False))
    return j.groupBy("item_id", "source").agg(F.count_if(~cut).alias("owned_bars"), F.count_if(cut).alias("boundary_bars"))


def unify_items(items: DataFrame, owners: DataFrame) -> DataFrame:
    """Dimension rows of the source whose epoch is still open."""
    return items.join(owners.filter("valid_to IS NULL").select("item_id", "source"), ["item_id", "source"])


def unify_eligible(sources: DataFrame, states: DataFrame, as_of: str, key: Sequence[str] = SALE_KEY,
                   chunk_rows: int = 1 << 20) -> DataFrame:
    """Merged sales; a sale counts once any source had aggregated its copy. Those are numbered first.

    `states` has source and raw_max_id.
    """
    rows = sources.filter(F.col("sold_date") <= as_ts(as_of)).withColumnRenamed("id", "source_id").join(states, "source")
    counted = F.bool_or(F.col("source_id") <= F.col("raw_max_id"))
    firsts = _firsts(rows, key, chunk_rows, [F.when(F.col("eligible"), 0).otherwise(1)], eligible=counted)
    return _renumbered(rows.drop("raw_max_id"), key, firsts)


def unify_candles(frozen: DataFrame, unified: DataFrame, raw_from: str) -> DataFrame:
    """Frozen bars before `raw_from`, bars rebuilt from the counted sales after."""
    start = as_ts(raw_from)
    rebuilt = candles_1h(unified.filter(F.col("eligible") & (F.col("sold_date") >= start)))
    return frozen.filter(F.col("hour") < start).select(*rebuilt.columns).unionByName(rebuilt)


DELTA_KEY = ["auction_no", "item_id", "observed_at", "reason"]


def unify_deltas(deltas: DataFrame, owners: DataFrame) -> DataFrame:
    """Owned depletion events with the latest refutation any source recorded."""
    refuted = deltas.groupBy(*DELTA_KEY).agg(F.max("invalidated_at").alias("invalidated_at"))
    return owned(deltas.drop("invalidated_at"), owners, F.col("observed_at")).join(refuted, DELTA_KEY)


def unify_globals(rows: DataFrame, epochs: DataFrame, ts: str, as_of: str) -> DataFrame:
    """Market-wide tables cut by source epochs."""
    inside = ((F.col("valid_from").isNull() | (F.col("valid_from") <= F.col(ts)))
              & (F.col("valid_to").isNull() | (F.col(ts) < F.col("valid_to"))) & (F.col(ts) <= as_ts(as_of)))
    return rows.join(epochs, "source").filter(inside).drop("valid_from", "valid_to")


def epoch_continuity(epochs: DataFrame) -> DataFrame:
    """Epochs that do not start where the one before ended; the list is configuration."""
    order = Window.partitionBy(F.lit(0)).orderBy(F.asc_nulls_first("valid_from"))
    return (epochs.withColumn("_p", F.lag("valid_to").over(order)).withColumn("_n", F.row_number().over(order))
            .filter((F.col("_n") > 1) & ~F.col("_p").eqNullSafe(F.col("valid_from"))).drop("_p", "_n"))


def overlay_live(archived: DataFrame, live: DataFrame, key: Sequence[str], state_table: bool = False) -> DataFrame:
    """Live rows replace archived rows of the same key; a state table is replaced as a whole."""
    if state_table:
        return live
    both = archived.withColumn("_p", F.lit(0)).unionByName(live.withColumn("_p", F.lit(1)))
    return newest(both, key, ["_p"], [c for c in live.columns if c not in key]).select(*live.columns)
