"""Streaming forms of the ingest, bar and health operators.

Input is a stream of typed sales, listing rows or checks; the functions add watermarks and state only. Output
modes are stated per job.
"""
from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidebook.functions.exact import exact_sum, ratio
from tidebook.operators.health import AlarmLadder
from tidebook.operators.ingest import LISTING_CAP, SALE_KEY
from tidebook.plans.split import order_key


def stream_sales(sales: DataFrame, late: str = "2 hours", key: Sequence[str] = SALE_KEY, response: str | None = None) -> DataFrame:
    """Overlapping polls to one row per sale (append); state is dropped behind the watermark.

    With `response`, the time of the poll that returned a row, equal sales of one response are true twins: they are numbered
    within their response, in the order of their ids, and the k-th of them is the same sale in every response that returns it.
    A response is complete when the watermark has passed it; its counts are the first state, the sales given out the
    second. Without `response` the rows carry their number (`dup_seq`) themselves.
    """
    if response is None:
        return sales.withWatermark("sold_date", late).dropDuplicatesWithinWatermark(list(key))
    natural = [k for k in key if k != "dup_seq"]
    counted = sales.withWatermark(response, late).groupBy(response, *natural).agg(F.array_sort(F.collect_list("id")).alias("_ids"))
    numbered = counted.select(response, *natural, F.posexplode("_ids").alias("_seq", "id")).withColumn("dup_seq", F.col("_seq").cast("bigint"))
    return numbered.drop("_seq").dropDuplicatesWithinWatermark([*natural, "dup_seq"])


def _bar(df: DataFrame, window: Column, keys: Sequence[str]) -> DataFrame:
    order = order_key(df, ["sold_date", "id"])
    g = df.groupBy(window.alias("w"), *keys).agg(
        F.min_by("unit_price", order).alias("o"), F.max("unit_price").alias("h"), F.min("unit_price").alias("l"),
        F.max_by("unit_price", order).alias("c"), exact_sum(F.col("unit_price") * F.col("qty")).alias("gold"),
        F.sum("qty").cast("bigint").alias("qty"), F.count(F.lit(1)).alias("n"))
    return g.select(*keys, F.col("w.start").alias("start"), "o", "h", "l", "c", "gold", "qty", "n")


def stream_candles(sales: DataFrame, late: str = "2 hours") -> DataFrame:
    """Hourly bars (update): a late sale inside the watermark re-opens its bar, later ones go to the batch refresh."""
    return _bar(sales.withWatermark("sold_date", late), F.window("sold_date", "1 hour"), ["item_id"])


def stream_watermark(sales: DataFrame, raw_max_id: int, late: str = "2 hours") -> DataFrame:
    """Sales past the aggregation boundary per hour (update): waiting, not wrong."""
    s = sales.withWatermark("sold_date", late)
    g = s.groupBy(F.window("sold_date", "1 hour").alias("w")).agg(F.count_if(F.col("id") > raw_max_id).alias("pending"), F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("start"), "pending", "n")


def stream_rolling_24h(sales: DataFrame, late: str = "2 hours") -> DataFrame:
    """24 h price sliding by the hour (append). Sales are first folded into hours, so only bars are multiplied."""
    s = sales.withWatermark("sold_date", late)
    hours = s.groupBy(F.window("sold_date", "1 hour").alias("w"), "item_id").agg(
        exact_sum(F.col("unit_price") * F.col("qty")).alias("gold"), F.sum("qty").cast("bigint").alias("qty"), F.count(F.lit(1)).alias("n"))
    g = hours.groupBy(F.window(F.window_time("w"), "24 hours", "1 hour").alias("d"), "item_id").agg(
        F.sum("gold").alias("gold"), F.sum("qty").alias("qty"), F.sum("n").alias("n"))
    return g.select("item_id", F.col("d.end").alias("as_of"), ratio(F.col("gold"), F.col("qty")).alias("vwap24"), "qty", "n")


def stream_game_day(sales: DataFrame, late: str = "2 hours", offset: str = "21 hours") -> DataFrame:
    """Business days that start at 06:00 local time, 21:00 UTC (append)."""
    return _bar(sales.withWatermark("sold_date", late), F.window("sold_date", "1 day", "1 day", offset), ["item_id"])


def stream_activity_session(sales: DataFrame, late: str = "2 hours", gap: str = "90 minutes") -> DataFrame:
    """Stretches of hours that all have sales (append). A gap between one and two hours joins neighbouring hours only."""
    s = sales.withColumn("hour", F.date_trunc("hour", "sold_date")).withWatermark("hour", late)
    g = s.groupBy(F.session_window("hour", gap).alias("s"), "item_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("sold_date").alias("first_sale"), F.max("sold_date").alias("last_sale"))
    return g.select("item_id", "first_sale", "last_sale", "n")


_LISTING_OUT = "auction_no string, item_id string, unit_price bigint, reason string, qty_sold bigint, prev_count bigint, new_count bigint, _at bigint"
_POLL_STATE = T.StructType().add("at", "long").add("ceiling", "long").add("rows", "binary")
_OPEN_KEY, _OPEN = T.StructType().add("auction_no", "string"), T.StructType().add("unit_price", "long").add("cur_count", "long").add("expire", "long")


class ListingState(StatefulProcessor):
    """The open listings of an item: a list of polls still to come in order, and a map from listing to its last sighting.

    A timer at each poll's own time settles it when the watermark gets there, so polls that arrive out of order, in one batch or in
    several, are settled in the order they were made.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._polls = handle.getListState("polls", _POLL_STATE)
        self._open = handle.getMapState("open", _OPEN_KEY, _OPEN)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        times = set()
        for frame in rows:
            for at, ceiling, listings in frame[["at", "ceiling", "listings"]].itertuples(index=False, name=None):
                data = pickle.dumps([(x["auction_no"], x["unit_price"], x["cur_count"], x["expire"]) for x in listings])
                self._polls.appendValue((int(at), None if pd.isna(ceiling) else int(ceiling), data))
                times.add(-(-int(at) // 1000))  # timers count milliseconds
        for t in times:
            self._handle.registerTimer(t)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        reached = timerValues.getCurrentWatermarkInMs() * 1000
        polls = list(self._polls.get())
        due, waiting = [p for p in polls if p[0] <= reached], [p for p in polls if p[0] > reached]
        if not due:  # settled together with an earlier one
            return
        self._polls.put(waiting) if waiting else self._polls.clear()
        before = {k[0]: tuple(v) for k, v in self._open.iterator()}
        held, events = dict(before), []
        for at, ceiling, data in sorted(due, key=lambda p: p[0]):
            events += _settled(held, at, ceiling, pickle.loads(data))
        for listing in before.keys() - held.keys():
            self._open.removeKey((listing,))
        for listing, value in held.items():
            if before.get(listing) != value:
                self._open.updateValue((listing,), value)
        if events:
            out = pd.DataFrame(events, columns=["auction_no", "unit_price", "reason", "qty_sold", "prev_count", "new_count", "_at"])
            out.insert(1, "item_id", key[0])
            yield out

    def close(self) -> None:
        pass


def _settled(held: dict, at: int, ceiling: int | None, rows: list[tuple]) -> list[tuple]:
    """Events of one poll; `held` follows it. A listing that is missing is gone if it has expired, if the response was not cut
    off, or if it was cheaper than the dearest row of a response that was."""
    events, seen = [], {r[0] for r in rows}
    for listing in [k for k in held if k not in seen]:
        price, count, expire = held[listing]
        expired = at >= expire
        if expired or ceiling is None or price < ceiling:
            del held[listing]
            if expired or count > 0:
                events.append((listing, price, "expired" if expired else "vanished_before_expiry", 0 if expired else count, count, count if expired else 0, at))
    for listing, price, count, expire in rows:
        if listing in held and count < held[listing][1]:
            events.append((listing, price, "partial", held[listing][1] - count, held[listing][1], count, at))
        held[listing] = (price, count, expire)
    return events


def poll_rows(seen: DataFrame, polls: DataFrame | None = None, cap: int = LISTING_CAP) -> DataFrame:
    """One row per poll of an item with its listings, as a response arrives: `seen` has one row per listing and poll, and
    `polls` (item_id, batch) also those that returned nothing. `ceiling` is the dearest price of a response that was cut off."""
    listing = F.struct("auction_no", "unit_price", F.col("cur_count").cast("bigint").alias("cur_count"), F.unix_micros("expire_date").alias("expire"))
    full = seen.groupBy("item_id", "batch").agg(F.collect_list(listing).alias("listings"),
                                                F.when(F.count(F.lit(1)) >= cap, F.max("unit_price")).alias("ceiling"))
    if polls is not None:
        full = polls.select("item_id", "batch").distinct().join(full, ["item_id", "batch"], "left")
    empty = F.array().cast(full.schema["listings"].dataType)
    return full.select("item_id", "batch", F.coalesce("listings", empty).alias("listings"), "ceiling")


def stream_listing_state(polls: DataFrame, late: str = "1 day", slots: int = 8) -> DataFrame:
    """Depletion events of listings (append), from a stream of `poll_rows`: falling counts, listings gone, listings expired.

    Absence is judged by polls, empty and capped ones included, not by silence. The listings of an item are dealt over `slots`
    states; each of them sees every poll of the item, but only its own listings, so a busy item is worked on in parallel.
    """
    dealt = (polls.withWatermark("batch", late).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
             .withColumn("listings", F.expr(f"filter(listings, x -> pmod(xxhash64(x.auction_no), {slots}) = slot)"))
             .withColumn("at", F.unix_micros("batch")))
    events = dealt.groupBy("item_id", "slot").transformWithStateInPandas(
        statefulProcessor=ListingState(), outputStructType=T.StructType.fromDDL(_LISTING_OUT), outputMode="Append", timeMode="EventTime")
    return events.withColumn("observed_at", F.timestamp_micros("_at")).drop("_at")


_SILENCE_OUT = "auction_no string, reason string, qty_sold bigint, prev_count bigint, new_count bigint, observed_at timestamp"
_SILENCE_STATE = "listings binary"
_HELD = {"count": "int64", "expire": "int64", "due": "int64"}


def _ms(times: pd.Series) -> np.ndarray:
    return times.to_numpy("datetime64[ms]").astype("int64")


def _heard(frames: Iterator[pd.DataFrame], state: GroupState, silence_ms: int) -> Iterator[pd.DataFrame]:
    """Events of the listings of one slot. `held` has the last count, the expiry and the due time of each listing; a listing that is heard of
    in this batch is not due in it."""
    at = state.getCurrentWatermarkMs()
    held = pickle.loads(state.get[0]) if state.exists else pd.DataFrame(columns=[*_HELD]).astype(_HELD)
    events, heard = [], held.iloc[:0]
    if not state.hasTimedOut:
        rows = pd.concat(list(frames)).sort_values(["auction_no", "observed_at", "id"])
        names, counts = rows["auction_no"].to_numpy(), rows["cur_count"].to_numpy("int64")
        first, last = np.append(True, names[1:] != names[:-1]), np.append(names[1:] != names[:-1], True)
        before, known = np.roll(counts, 1), held.index.get_indexer(names[first])
        before[first] = np.where(known >= 0, np.append(held["count"].to_numpy(), 0)[known], counts[first])
        fell = counts < before
        events.append((names[fell], "partial", (before - counts)[fell], before[fell], counts[fell], rows["observed_at"][fell].to_numpy()))
        expire = _ms(rows["expire_date"])[last]
        due = np.minimum(expire, _ms(rows["observed_at"])[last] + silence_ms)
        heard = pd.DataFrame({"count": counts[last], "expire": expire, "due": np.maximum(due, at + 1)}, index=names[last])
        held = held[~held.index.isin(heard.index)]
    gone, held = held[held["due"] < at], pd.concat([held[held["due"] >= at], heard])
    late = gone["expire"] <= at
    for some, reason in ((gone[late], "expired"), (gone[~late & (gone["count"] > 0)], "vanished_before_expiry")):
        count, none = some["count"].to_numpy(), np.zeros(len(some), dtype="int64")
        events.append((some.index, reason, *((none, count, count) if reason == "expired" else (count, count, none)), pd.Timestamp(at, unit="ms")))
    if len(held):
        state.update((pickle.dumps(held),))
        state.setTimeoutTimestamp(max(int(held["due"].min()), at + 1))
    elif state.exists:
        state.remove()
    for some in events:
        if len(some[0]):
            yield pd.DataFrame(dict(zip(("auction_no", "reason", "qty_sold", "prev_count", "new_count", "observed_at"), some)))


def stream_listing_silence(rows: DataFrame, late: str = "2 hours", silence: str = "2 days", slots: int = 1024) -> DataFrame:
    """Depletion events of keyed listings (append): falling counts at once, silence or expiry by event-time timers.

    For sources that tell of no polls: a listing counts as gone when nothing was heard of it for `silence`. Listings are dealt over
    `slots` states, so the calls of a batch are bounded and each works on many listings; a slot's timer is the first of its listings'.
    """
    silence_ms = int(pd.Timedelta(silence).total_seconds() * 1000)

    def step(key, frames, state):
        yield from _heard(frames, state, silence_ms)
    dealt = rows.withWatermark("observed_at", late).select("auction_no", "id", "observed_at", "cur_count", "expire_date",
                                                           F.pmod(F.xxhash64("auction_no"), F.lit(slots)).alias("slot"))
    return dealt.groupBy("slot").applyInPandasWithState(step, _SILENCE_OUT, _SILENCE_STATE, "append", GroupStateTimeout.EventTimeTimeout)


_ALARM_STATE = T.StructType().add("recoveries", T.ArrayType(T.DoubleType())).add("last_alert", "double")
_ACTION = "source string, checked_at timestamp, gap_min double, stale_items bigint, action string"


class AlarmState(StatefulProcessor):
    """The alarm ladder of a source: its recent recoveries and its last alert. Rows are slots, so a batch of them is bounded by
    the calendar."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("ladder", _ALARM_STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        slots = pd.concat(list(rows)).sort_values("checked_at")
        ladder = AlarmLadder(*self._state.get()) if self._state.exists() else AlarmLadder()
        minutes = (slots["checked_at"] - pd.Timestamp(0)) / pd.Timedelta(minutes=1)
        slots["action"] = [ladder.check(*r) for r in zip(minutes, slots["gap_min"], slots["stale_items"])]
        self._state.update((ladder.recoveries, ladder.last_alert))
        yield slots[["source", "checked_at", "gap_min", "stale_items", "action"]]

    def close(self) -> None:
        pass


def stream_health(checks: DataFrame, late: str = "2 hours", slot: str = "5 minutes") -> DataFrame:
    """Alarm action of every source and slot (append). Checks are first folded into slots, the worst of each, which closes behind the
    watermark; only slots reach the alarm state, in order, since all slots of a batch come after those of the batch before."""
    slots = (checks.withWatermark("checked_at", late).groupBy(F.window("checked_at", slot).alias("w"), "source")
             .agg(F.coalesce(F.max("gap_min"), F.lit(0.0)).alias("gap_min"), F.coalesce(F.max("stale_items"), F.lit(0)).cast("bigint").alias("stale_items"))
             .select("source", F.col("w.start").alias("checked_at"), "gap_min", "stale_items"))
    return slots.groupBy("source").transformWithStateInPandas(
        statefulProcessor=AlarmState(), outputStructType=T.StructType.fromDDL(_ACTION), outputMode="Append", timeMode="None")
