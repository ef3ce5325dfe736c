"""Exact quantiles of groups of any size.

Values are first counted per (group, value), so repeated prices collapse before the shuffle. The ordered
walk over a group's values is cut into bands, about 6 % wide or between sampled split points; a band's starting
rank comes from the band totals. Four rank rules are offered and never mixed:

``floor``     element floor(n*q), clamped to the last one, of the sorted values (zero based)
``floor_n1``  element floor(q*(n-1))
``linear``    linear interpolation at position q*(n-1)
``weighted``  smallest value whose cumulative weight reaches q times the total weight
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidebook.plans.split import null_safe_join

Spec = tuple[str, str, float]          # output column, rule, q


def price_band(value: Column) -> Column:
    """Monotone band number of a value: bands of equal ratio at every magnitude, down to the smallest doubles."""
    size = F.abs(value.cast("double"))
    return F.when(size == 0, 0.0).otherwise(F.signum(value) * (F.floor(F.log(size) * 16) + 12_000))


def sampled_bands(hist: DataFrame, keys: Sequence[str], value: str, splits: int) -> DataFrame:
    """Add _band, numbered by split points that a quantile sketch takes from each group's distinct values, so bands
    hold about equally many of them however the values are spread."""
    q = F.array(*[F.lit(i / splits) for i in range(1, splits)])
    points = F.array_distinct(F.percentile_approx(F.col(value).cast("double"), q, F.lit(100 * splits)))
    if keys:
        marked = null_safe_join(hist, hist.groupBy(*keys).agg(points.alias("_points")), keys, "left")
    else:
        marked = hist.withColumn("_points", hist.agg(points).scalar())
    return marked.withColumn("_band", F.size(F.filter("_points", lambda p: p < F.col(value)))).drop("_points")


def value_counts(df: DataFrame, keys: Sequence[str], value: str, weight: str | None,
                 carry: dict[str, Column] | None = None) -> DataFrame:
    """Rows (or weights) per group and distinct value; `carry` adds aggregates kept beside the count."""
    w = F.sum(F.col(weight)) if weight else F.count(F.lit(1))
    return (df.filter(F.col(value).isNotNull()).groupBy(*keys, value)
            .agg(w.cast("bigint").alias("_w"), *[c.alias(n) for n, c in (carry or {}).items()]))


def ranked_values(hist: DataFrame, keys: Sequence[str], value: str, splits: int = 0) -> DataFrame:
    """Add the half-open rank range [_lo, _hi) each distinct value fills, and the group total _n.

    Values are ordered in bands: of equal ratio, which costs nothing, or with `splits` between split points taken from the
    values, for few large groups whose values may crowd.
    """
    hist = sampled_bands(hist, keys, value, splits) if splits else hist.withColumn("_band", price_band(F.col(value)))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    bands = (hist.groupBy(*keys, "_band").agg(F.sum("_w").alias("_bw"))
             .withColumn("_before", F.sum("_bw").over(
                 group.orderBy("_band").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_bw"))
             .withColumn("_n", F.sum("_bw").over(group)).drop("_bw"))
    inside = (Window.partitionBy(*keys, "_band").orderBy(value)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = null_safe_join(hist.withColumn("_run", F.sum("_w").over(inside)), bands, [*keys, "_band"])
    return (placed.withColumn("_hi", F.col("_before") + F.col("_run"))
            .withColumn("_lo", F.col("_hi") - F.col("_w"))
            .drop("_band", "_run", "_before"))


def _at_rank(value: str, rank: Column) -> Column:
    return F.min(F.when((F.col("_lo") <= rank) & (rank < F.col("_hi")), F.col(value)))


def quantile_columns(value: str, specs: Sequence[Spec]) -> list[Column]:
    n = F.col("_n")
    out = []
    for name, rule, q in specs:
        if rule == "floor":
            out.append(_at_rank(value, F.least(F.floor(n * F.lit(q)), n - 1)).alias(name))
        elif rule == "floor_n1":
            out.append(_at_rank(value, F.floor((n - 1) * F.lit(q))).alias(name))
        elif rule == "weighted":
            out.append(F.min(F.when(F.col("_hi") >= n * F.lit(q), F.col(value))).alias(name))
        elif rule == "linear":
            pos = (n - 1) * F.lit(q)
            low = _at_rank(value, F.floor(pos)).cast("double")
            high = _at_rank(value, F.ceil(pos)).cast("double")
            part = F.max(pos - F.floor(pos))
            out.append((low + (high - low) * part).alias(name))
        else:
            raise ValueError(f"unknown quantile rule {rule}")
    return out


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, specs: Sequence[Spec],
                    weight: str | None = None, carry: dict[str, Column] | None = None,
                    extra: Sequence[Column] = (), splits: int = 0) -> DataFrame:
    """One row per group with the requested quantiles; `splits` as in `ranked_values`.

    `carry` names aggregates formed per distinct value; `extra` folds them (and the value, `_w`, `_n`).
    """
    hist = value_counts(df, keys, value, weight, carry)
    return ranked_values(hist, keys, value, splits).groupBy(*keys).agg(*quantile_columns(value, specs), *extra)
