"""Nested and flat exports, and writers that replace only what changed."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidebook.session import reuse


def _nested(df: DataFrame, order: str, name: str) -> DataFrame:
    cols = [order, *[c for c in df.columns if c not in ("item_id", order)]]
    return df.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias(name))


def export_series(items: DataFrame, parts: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """One nested record per item.

    `parts` maps a field to (bars, order column). Bars have one row per item and calendar step, so the arrays
    of an item are bounded by the calendar.
    """
    out = items.select("item_id", "category")
    for name, (df, order) in parts.items():
        out = out.join(_nested(df, order, name), "item_id", "left")
    return out


def split_series(series: DataFrame, heavy: str, drop_inside: dict[str, list[str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(core, side): the heavy field moves to its own output and leaves its length behind."""
    series = reuse(series)
    size = F.coalesce(F.size(heavy), F.lit(0))
    core = series.withColumn(f"{heavy}_count", F.when(size > 0, size)).drop(heavy)
    for field, names in (drop_inside or {}).items():
        core = core.withColumn(field, F.col(field).dropFields(*names))
    return core, series.filter(size > 0).select("item_id", heavy)


def write_series(series: DataFrame, path: str) -> None:
    series.write.mode("overwrite").partitionBy("item_id").json(path)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_days(df: DataFrame, ts: str, path: str, sort: str = "item_id") -> None:
    """Replace only the days present in `df`; rows of a day are laid out by item and time for pruning.

    Files are ranges of (day, item, time) between sampled points, so their number follows the session's partitions and a
    busy day or item is spread over as many as its rows need.
    """
    (df.withColumn("day", F.to_date(ts)).repartitionByRange("day", sort, ts).sortWithinPartitions("day", sort, ts)
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path))
