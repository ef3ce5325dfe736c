"""Content-addressed archive buckets, incremental copies and proven retention."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tidebook.functions.timeutil import as_ts, hours_ago
from tidebook.plans.split import newest


def row_text(df: DataFrame, cols: Sequence[str]) -> Column:
    """Unambiguous text of a row: instants as microseconds, NULL as \\N, fields split by the unit separator."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    one = lambda c: F.unix_micros(c) if isinstance(kinds[c], T.TimestampType) else F.col(c)
    return F.array_join(F.array(*[F.coalesce(one(c).cast("string"), F.lit("\\N")) for c in cols]), "\x1f")


def row_digest(df: DataFrame, cols: Sequence[str]) -> Column:
    return F.sha2(row_text(df, cols), 256)


_PARTS = 8


def bucket_signature(df: DataFrame, bucket: Column, cols: Sequence[str], name: str = "bucket") -> DataFrame:
    """Rows, bytes and content hash per bucket.

    Every row is hashed; the eight 32-bit words of the hashes are summed and the sums hashed again. The sums
    do not depend on row order and combine on the map side, so a bucket of any size needs no sort and no
    gathering, and 38 digits hold the sums. Two buckets agree exactly when they hold the same rows the same number of times.
    """
    text = row_text(df, cols)
    d = df.select(bucket.alias(name), F.octet_length(text).alias("_b"), F.sha2(text, 256).alias("_d"))
    word = lambda i: F.sum(F.conv(F.substring("_d", 1 + 8 * i, 8), 16, 10).cast("decimal(28,0)"))
    g = d.groupBy(name).agg(F.count(F.lit(1)).alias("rows"), F.sum("_b").alias("bytes"),
                            *[word(i).alias(f"_w{i}") for i in range(_PARTS)])
    sums = F.concat_ws(",", *[F.col(f"_w{i}").cast("string") for i in range(_PARTS)])
    return g.select(name, "rows", "bytes", F.sha2(sums, 256).alias("hash"))


def changed_buckets(signatures: DataFrame, manifest: DataFrame, name: str = "bucket") -> DataFrame:
    """What to fetch and what to reuse against the manifest of the last copy."""
    old = manifest.select(name, F.col("hash").alias("_old"))
    j = signatures.join(old, name, "left")
    return j.withColumn("action", F.when(F.col("hash").eqNullSafe(F.col("_old")), "reuse").otherwise("fetch")).drop("_old")


def ensure_budget(plan: DataFrame, limit: int) -> int:
    """Planned bytes; refuses before anything is fetched when they exceed the limit."""
    planned = plan.filter("action = 'fetch'").agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    if planned > limit:
        raise ValueError(f"planned {planned} bytes exceed the limit of {limit}")
    return planned


def archive_merge(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """New rows win, rows the source has deleted stay."""
    rest = [c for c in new.columns if c not in key]
    a = old.select(*key, F.struct(*rest).alias("_old"))
    b = new.select(*key, F.struct(*rest).alias("_new"))
    return a.join(b, list(key), "full_outer").select(*key, F.coalesce("_new", "_old").alias("_r")).select(*key, "_r.*")


def archive_continuity(manifests: DataFrame, key: str, limit_days: int = 6) -> DataFrame:
    """initial, ok, or gap once two copies were too far apart; a gap stays on record."""
    order = Window.partitionBy(key).orderBy("created_at")
    wide = (F.unix_micros("created_at") - F.unix_micros(F.lag("created_at").over(order))) > limit_days * 86_400_000_000
    m = manifests.withColumn("_gap", F.coalesce(wide.cast("int"), F.lit(0))).withColumn("_no", F.row_number().over(order))
    sticky = F.max("_gap").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (m.withColumn("continuity", F.when(F.col("_no") == 1, "initial").when(sticky == 1, "gap").otherwise("ok"))
            .drop("_gap", "_no"))


def archive_select(df: DataFrame, start: str | None, end: str | None, items: Sequence[str] | None, begin_col: str | None,
                   end_col: Column | None = None, partition: str | None = None) -> DataFrame:
    """Rows of a time span and of chosen items; rows without an item or time are market-wide and stay.

    With `partition` (a day column) the span also prunes partitions; open intervals cannot be pruned by start.
    """
    if items and "item_id" in df.columns:
        df = df.filter(F.col("item_id").isNull() | F.col("item_id").isin(list(items)))
    if begin_col is None:
        return df
    last = F.col(begin_col) if end_col is None else end_col
    if start:
        df = df.filter(last >= as_ts(start))
        if partition and end_col is None:
            df = df.filter(F.col(partition) >= F.to_date(as_ts(start)))
    if end:
        df = df.filter(F.col(begin_col) < as_ts(end))
        if partition:
            df = df.filter(F.col(partition) <= F.to_date(as_ts(end)))
    return df


def archive_verify(source: DataFrame, copy: DataFrame, bucket: Column, key: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Per bucket: row counts, repeated keys in the copy, and whether the contents agree."""
    a = bucket_signature(source, bucket, cols).select("bucket", F.col("rows").alias("source_rows"), F.col("hash").alias("_a"))
    b = bucket_signature(copy, bucket, cols).select("bucket", F.col("rows").alias("copy_rows"), F.col("hash").alias("_b"))
    rep = (copy.groupBy(bucket.alias("bucket"), *key).agg((F.count(F.lit(1)) - 1).alias("_x"))
           .groupBy("bucket").agg(F.sum("_x").alias("repeated")))
    j = a.join(b, "bucket", "full_outer").join(rep, "bucket", "left")
    return j.select("bucket", F.coalesce("source_rows", F.lit(0)).alias("source_rows"), F.coalesce("copy_rows", F.lit(0)).alias("copy_rows"),
                    F.coalesce("repeated", F.lit(0)).alias("repeated"), F.col("_a").eqNullSafe(F.col("_b")).alias("equal"))


def schema_upgrade(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old shards gain the nullable columns that new shards have."""
    missing = set(old.columns) - set(new.columns)
    if missing:
        raise ValueError(f"columns may only be added, not dropped: {sorted(missing)}")
    return old.unionByName(new, allowMissingColumns=True)


def rebucket_hourly(df: DataFrame, ts: str) -> DataFrame:
    """Add the day and hour an hourly layout is partitioned by; write it with partitionBy('day', 'hour')."""
    return df.withColumn("day", F.to_date(ts)).withColumn("hour", F.hour(ts))


def tier_keepers(listings: DataFrame) -> DataFrame:
    """The last row at the highest known tier of every item, which retention must leave."""
    known = listings.filter(F.col("upgrade_max").isNotNull())
    return newest(known, ["item_id"], ["upgrade_max", "last_seen_at", "auction_no"], ["auction_no"]).select("auction_no")


def prune_proven(table: DataFrame, proofs: DataFrame, key: Sequence[str], cols: Sequence[str], expired: Column,
                 keepers: DataFrame | None = None) -> DataFrame:
    """Rows left after deleting those that are past retention and whose exact content the archive proves.

    `proofs` has the key and the digest of every verified archived row.
    """
    marked = table.withColumn("digest", row_digest(table, cols))
    doomed = marked.filter(expired).join(proofs.select(*key, "digest"), [*key, "digest"], "left_semi").select(*key)
    if keepers is not None:
        doomed = doomed.join(keepers, list(key), "left_anti")
    return table.join(doomed, list(key), "left_anti")


def age_retention(df: DataFrame, ts: str, as_of: str, days: int) -> DataFrame:
    """Rows young enough to stay."""
    return df.filter(F.col(ts) >= hours_ago(as_of, 24 * days))
