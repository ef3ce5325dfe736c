"""Ordered work over groups of any size.

A plain window puts every row of a group into one task. The helpers here cut a group into ordered
chunks (an hour, a price band), work inside the chunks in parallel and add what came before from the
chunk totals, whose number is bounded by the calendar or by the price scale.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidebook.session import reuse


def _partition(keys: Sequence[str]) -> list:
    return list(keys) if keys else [F.lit(0)]


def chunk_offsets(df: DataFrame, keys: Sequence[str], chunk: str, totals: dict[str, Column]) -> DataFrame:
    """(keys, chunk) with, per total, the sum over all earlier chunks of the same keys."""
    sums = df.groupBy(*keys, chunk).agg(*[c.alias(f"_t_{n}") for n, c in totals.items()])
    before = Window.partitionBy(*_partition(keys)).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    for name in totals:
        kind = F.sum(f"_t_{name}").over(before)
        sums = sums.withColumn(f"_before_{name}", F.coalesce(kind, F.lit(0).cast(kind_type(sums, name))))
    return sums.drop(*[f"_t_{n}" for n in totals])


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join where NULL keys meet; the keys come from the left side."""
    cond = F.lit(True)
    for c in on:
        cond = cond & F.col(f"_l.{c}").eqNullSafe(F.col(f"_r.{c}"))
    extra = [F.col(f"_r.{c}") for c in right.columns if c not in on]
    return left.alias("_l").join(right.alias("_r"), cond, how).select("_l.*", *extra)


def kind_type(df: DataFrame, name: str) -> str:
    return "decimal(38,0)" if "decimal" in df.schema[f"_t_{name}"].dataType.simpleString() else "bigint"


def numbered(df: DataFrame, keys: Sequence[str], chunk: str, order: Sequence, name: str = "rn") -> DataFrame:
    """row_number over `keys` in (chunk, order) sequence; no task holds more than one chunk of a key."""
    offsets = chunk_offsets(df, keys, chunk, {"n": F.count(F.lit(1))})
    inside = Window.partitionBy(*keys, chunk).orderBy(*order)
    placed = null_safe_join(df.withColumn("_rn", F.row_number().over(inside)), offsets, [*keys, chunk])
    return placed.withColumn(name, F.col("_before_n") + F.col("_rn")).drop("_rn", "_before_n")


_SMALL = ("timestamp", "date", "int", "smallint", "tinyint")
_FIXED = ("timestamp", "date", "int", "smallint", "tinyint", "bigint", "double", "float", "boolean")


def _kind(df: DataFrame, col: str) -> str:
    return df.schema[col].dataType.simpleString()


def order_key(df: DataFrame, order: Sequence[str]) -> Column:
    """One value that sorts as the columns `order` do, NULL first, for max_by and min_by.

    Whole numbers and times, alone or a small one before another, become one fixed-width number, which a hash
    aggregate can hold. Other columns stay a struct; Spark then sorts each task's rows before it aggregates.
    """
    kinds = [_kind(df, c) for c in order]
    if any(k not in (*_SMALL, "bigint") for k in kinds) or len(kinds) > 2 or (len(kinds) == 2 and kinds[0] not in _SMALL):
        return F.struct(*order)
    as_number = {"timestamp": F.unix_micros, "date": F.unix_date}
    whole = [as_number.get(k, F.col)(c).cast("bigint") for k, c in zip(kinds, order)]
    low = F.coalesce(whole[-1], F.lit(-(1 << 63)))
    if len(whole) == 1:
        return low
    high = F.coalesce(whole[0], F.lit(-(1 << 62)))        # times and small numbers stay within 62 bits
    return high.cast("decimal(20,0)") * F.lit(Decimal(1 << 64)) + low.cast("decimal(20,0)")


def _extreme(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str] | None, by: Callable) -> DataFrame:
    cols = list(cols) if cols is not None else [c for c in df.columns if c not in keys]
    key = order_key(df, order)
    if all(_kind(df, c) in _FIXED for c in cols):
        return df.groupBy(*keys).agg(*[by(F.col(c), key).alias(c) for c in cols])
    return df.groupBy(*keys).agg(by(F.struct(*cols), key).alias("_r")).select(*keys, "_r.*")


def newest(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str] | None = None) -> DataFrame:
    """The last row of each group as a partial aggregate; no group is gathered.

    Rows of fixed-width columns in an order that `order_key` packs need no sort; others are sorted within their task.
    """
    return _extreme(df, keys, order, cols, F.max_by)


def oldest(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str] | None = None) -> DataFrame:
    """The first row of each group; see `newest`."""
    return _extreme(df, keys, order, cols, F.min_by)


def first_keys(df: DataFrame, keys: Sequence[str], order: Sequence[str], by: Callable = F.min, **more: Column) -> DataFrame:
    """(keys, _k) with the smallest (or, by F.max, largest) packed order of every group, and `more` aggregates.

    Only the keys and one fixed-width number are read, combined on the map side by hash and shuffled.
    """
    return df.groupBy(*keys).agg(by(order_key(df, order)).alias("_k"), *[c.alias(n) for n, c in more.items()])


def rows_of(df: DataFrame, keys: Sequence[str], order: Sequence[str], firsts: DataFrame, repeated: bool = False) -> DataFrame:
    """The rows that `first_keys` names, with its other columns: an arg-max of any payload without a sorted aggregate.

    The order must tell the rows of a group apart; with `repeated`, rows of equal order may be equal and count once.
    """
    found = null_safe_join(df.withColumn("_k", order_key(df, order)), firsts, [*keys, "_k"]).drop("_k")
    return found.distinct() if repeated else found


def global_ranks(df: DataFrame, keys: Sequence[str], value: str, tie: str, splits: int = 256) -> DataFrame:
    """Add _rn, the place by (value, tie) within `keys`, _n, the size of the group, and _chunk, a stretch of places.

    The stretches lie between values sampled by a quantile sketch, so they follow the data; a task orders one of them, and
    its places start after the counts of the stretches before it, of which there are at most `splits`.
    """
    q = F.array(*[F.lit(i / splits) for i in range(1, splits)])
    points = F.array_distinct(F.percentile_approx(F.col(value).cast("double"), q, F.lit(10_000)))
    if keys:
        marked = null_safe_join(df, df.groupBy(*keys).agg(points.alias("_points")), keys, "left")
    else:
        marked = df.withColumn("_points", df.agg(points).scalar())
    chunk = F.coalesce(F.size(F.filter("_points", lambda p: p < F.col(value))), F.lit(0))
    marked = reuse(marked.withColumn("_chunk", chunk.cast("bigint")).drop("_points"))
    whole = Window.partitionBy(*_partition(keys))
    sizes = chunk_offsets(marked, keys, "_chunk", {"n": F.count(F.lit(1))})
    counts = null_safe_join(sizes, marked.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_c")), [*keys, "_chunk"])
    counts = counts.withColumn("_n", F.sum("_c").over(whole)).drop("_c")
    inside = Window.partitionBy(*keys, "_chunk").orderBy(value, tie)
    placed = null_safe_join(marked.withColumn("_i", F.row_number().over(inside)), counts, [*keys, "_chunk"])
    return placed.withColumn("_rn", F.col("_i") + F.col("_before_n")).drop("_i", "_before_n")


def trailing_sums(probes: DataFrame, facts: DataFrame, keys: Sequence[str], probe_ts: str, fact_ts: str,
                  width: str, values: dict[str, str]) -> DataFrame:
    """For each probe row, sums of the facts in (t - width, t].

    Written as a difference of two running totals, C(t) - C(t - width), so a probe needs two marks instead
    of a range scan. Facts are first summed per instant; running totals are formed per (key, hour) and
    lifted by the totals of the earlier hours, so a key that owns most rows spreads over its hours.
    """
    zero = {n: F.lit(0).cast("decimal(38,0)").alias(n) for n in values}
    payload = [c for c in probes.columns if c not in keys]
    sums = (facts.groupBy(*keys, F.col(fact_ts).alias("_ts"))
            .agg(*[F.sum(F.col(c)).cast("decimal(38,0)").alias(n) for n, c in values.items()]))
    empty = F.lit(None).cast(probes.select(F.struct(*payload)).schema[0].dataType)
    fact_marks = sums.select(*keys, "_ts", F.lit(0).alias("_kind"), F.lit(0).alias("_sign"),
                             empty.alias("_p"), *values)
    ends = F.array(*[F.struct(ts.alias("_ts"), F.lit(sign).alias("_sign")) for sign, ts in
                     ((1, F.col(probe_ts)), (-1, F.col(probe_ts) - F.expr(f"INTERVAL {width}")))])
    probe_marks = probes.select(*keys, F.struct(*payload).alias("_p"), F.explode(ends).alias("_e"))
    marks = fact_marks.unionByName(probe_marks.select(*keys, "_e._ts", F.lit(1).alias("_kind"), "_e._sign", "_p", *zero.values()))
    marks = reuse(marks.withColumn("_chunk", F.date_trunc("hour", "_ts")))      # both inputs are read once
    offsets = chunk_offsets(marks, keys, "_chunk", {n: F.sum(n) for n in values})
    running = (Window.partitionBy(*keys, "_chunk").orderBy("_ts", "_kind")
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inside = marks
    for n in values:
        inside = inside.withColumn(f"_in_{n}", F.sum(n).over(running))
    inside = inside.filter("_kind = 1")
    joined = inside.join(offsets, [*keys, "_chunk"], "inner")
    return (joined.groupBy(*keys, "_p")
            .agg(*[F.sum(F.col("_sign") * (F.col(f"_in_{n}") + F.col(f"_before_{n}"))).alias(n) for n in values])
            .select(*keys, "_p.*", *values))
