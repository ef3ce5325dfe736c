"""Helpers for bars: one row per (item, hour) or (item, day).

A series has at most one row per calendar step, so a window over one item is bounded by the calendar and
not by the number of raw rows.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def islands(df: DataFrame, keys: Sequence[str], step: Column, name: str = "island") -> DataFrame:
    """Give rows of one contiguous run (step numbers rising by one) a common island number."""
    w = Window.partitionBy(*keys).orderBy("_step")
    return (df.withColumn("_step", step).withColumn(name, F.col("_step") - F.row_number().over(w)).drop("_step"))


def runs(df: DataFrame, keys: Sequence[str], step: Column) -> DataFrame:
    """One row per contiguous run: first step, last step, length."""
    marked = islands(df.withColumn("_s", step), keys, F.col("_s"))
    return marked.groupBy(*keys, "island").agg(
        F.min("_s").alias("first_step"), F.max("_s").alias("last_step"), F.count(F.lit(1)).alias("length")
    ).drop("island")


def day_spine(spark, first: str | Column, last: str | Column, name: str = "day") -> DataFrame:
    a = F.lit(first).cast("date") if isinstance(first, str) else first
    b = F.lit(last).cast("date") if isinstance(last, str) else last
    return spark.range(1).select(F.explode(F.sequence(a, b)).alias(name))
