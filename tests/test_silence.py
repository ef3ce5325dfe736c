"""Keyed listings over slots: the rules walked one by one, and calls that do not grow with the listings."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebook.streaming import jobs
from tidebook.streaming.run import run_parts

DAY = 86_400_000


def _walked(batches, late, silence):
    """Each batch of rows (listing, id, seen, count, expire) one by one, then the timers behind the watermark; times in ms."""
    held, events, mark = {}, [], 0
    for rows in batches:
        for rows, mark in ((rows, mark), ([], max(mark, max(r[2] for r in rows) - late))):
            for name, _, seen, count, expire in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
                if name in held and count < held[name][0]:
                    events.append((name, "partial", held[name][0] - count, held[name][0], count, seen))
                held[name] = (count, expire, max(min(expire, seen + silence), mark + 1))
            told = {r[0] for r in rows}
            for name in [k for k, v in held.items() if k not in told and v[2] < mark]:
                count, expire, _ = held.pop(name)
                if expire <= mark or count:
                    events.append((name, "expired", 0, count, count, mark) if expire <= mark else (name, "vanished_before_expiry", count, count, 0, mark))
    return sorted(events)


@pytest.mark.parametrize("slots", [1, 5])
def test_silence_follows_the_rules(spark, slots):
    rng, start = np.random.default_rng(4), 1704067200000
    batches = [[(f"l{rng.integers(40)}", 100 * b + i, start + b * 2 * DAY + int(rng.integers(DAY)), int(rng.integers(6)), start + int(rng.integers(1, 40)) * DAY)
                for i in range(30)] for b in range(5)]
    parts = [spark.createDataFrame(rows, "auction_no string, id long, s long, cur_count long, e long").select(
        "auction_no", "id", F.timestamp_millis("s").alias("observed_at"), "cur_count", F.timestamp_millis("e").alias("expire_date")) for rows in batches]
    got = run_parts(parts, lambda s: jobs.stream_listing_silence(s, slots=slots))
    found = got.select("auction_no", "reason", "qty_sold", "prev_count", "new_count", F.unix_millis("observed_at")).collect()
    assert sorted(map(tuple, found)) == _walked(batches, DAY // 12, 2 * DAY)
    assert {r["reason"] for r in found} == {"partial", "expired", "vanished_before_expiry"}


def test_calls_do_not_grow_with_listings(spark, monkeypatch):
    """3,000 listings seen twice each: a batch calls the function once a slot, not once a listing."""
    calls = spark.sparkContext.accumulator(0)
    heard = jobs._heard

    def counted(*args):
        calls.add(1)
        yield from heard(*args)
    monkeypatch.setattr(jobs, "_heard", counted)
    rows = spark.range(6000).select(F.concat(F.lit("l"), (F.col("id") % 3000).cast("string")).alias("auction_no"), "id",
                                    F.timestamp_millis(1704067200000 + F.col("id")).alias("observed_at"), (9000 - F.col("id")).alias("cur_count"),
                                    F.timestamp_millis(F.lit(1704067200000 + DAY)).alias("expire_date"))
    got = run_parts([rows], lambda s: jobs.stream_listing_silence(s))
    assert got.where("reason = 'partial' and qty_sold = 3000").count() == 3000 and calls.value <= 2 * 1024
