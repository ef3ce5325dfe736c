"""Token packing by best-two-fit over counts of lengths."""
from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidebook.llm.shared import hold, small_batches
from tidebook.llm.tokens import kept_ids, slices, together

CAPACITY = 1024
END_ID = 2
#: Characters on whose classes every Unicode version agrees.
_PLAIN = re.compile("[\x20-\x7e\n\xa1-ɏ]*")
#: Parts without white space but for a first space: a line end before or after them is always a token of its own.
_WORD = re.compile(r" ?\S+")


def byte_encoder(json_path: str, ranks_path: str | None):
    """Encoder of parts by the byte-level vocabulary; plain characters go to its faster reader, if there is one."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer
    exact = Tokenizer.from_file(json_path)
    exact.encode_special_tokens = True
    fast = None
    if ranks_path:
        import base64

        import public_tokenizers
        import tiktoken
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str, kind: int = 0):
        if fast and (kind == 2 or _PLAIN.fullmatch(text)):
            return fast.encode_to_numpy(text, allowed_special=set(), disallowed_special=())
        return exact.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def kind(part: str) -> int:
        return 0 if not _WORD.fullmatch(part) else 2 if fast and _PLAIN.fullmatch(part) else 1
    return together(encode, "\n", int(encode("\n")[0]), kind)


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids; only the first may be shorter than the capacity."""
    first = (n - 1) % capacity + 1
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def token_pieces(docs: DataFrame, json_path: str, ranks_path: str | None, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of (doc_id, text), with the task that made them and their rank there among pieces as long."""
    out = (T.StructType([docs.schema["doc_id"]]).add("piece", "integer").add("start", "long").add("length", "integer")
           .add("ids_crc32", "long").add("task", "integer").add("rank", "long"))
    arrow = to_arrow_schema(out)

    def run(batches):
        ids_of = kept_ids(("bytes", json_path, ranks_path), lambda: byte_encoder(json_path, ranks_path), END_ID)
        seen, task = np.zeros(capacity + 1, dtype=np.int64), TaskContext.get().partitionId()
        for batch in batches:
            names = batch.column("doc_id")
            for at, to, buf, offsets in slices(batch.column("text")):
                ids, first = ids_of.of(buf, offsets)
                rows: list[list] = [[] for _ in range(6)]
                doc = []
                for d in range(to - at):
                    a = int(first[d])
                    for k, (start, n) in enumerate(cut(int(first[d + 1]) - a, capacity)):
                        crc = zlib.crc32(ids[a + start:a + start + n])
                        doc.append(at + d)
                        for into, value in zip(rows, (k, start, n, crc, task, seen[n])):
                            into.append(value)
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays([names.take(pa.array(doc, pa.int64())).cast(arrow.field("doc_id").type),
                                                  *(pa.array(r, f.type) for r, f in zip(rows, list(arrow)[1:]))], schema=arrow)

    return docs.mapInArrow(run, out)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset, copies): the pieces of a length whose ranks start there go
    to as many consecutive sequences.

    Best-two-fit on the counts: a sequence takes the longest piece left and then, again and again, the longest that
    still fits; when none does, its smallest piece gives way to the two pieces left whose sum comes closest to the gap
    this opens, if they fill it better. The pattern is repeated while the counts last, so the work depends on
    the number of lengths, not of documents.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for n, c in counts.items():
        left[n] = c
    given, rows, sequence = np.zeros(capacity + 1, dtype=np.int64), [], 0
    while left.any():
        take = np.zeros(capacity + 1, dtype=np.int64)
        room, pattern = capacity, []
        while room:
            fit = np.flatnonzero((left - take)[:room + 1] > 0)
            if not len(fit):
                break
            n = int(fit[-1])
            times = min(room // n, int(left[n] - take[n]))
            pattern += [n] * times
            take[n] += times
            room -= n * times
        if room and len(pattern):
            small = pattern[-1]
            pair = _best_two(left - take, room + small)
            if pair and sum(pair) > small:
                take[small] -= 1
                pattern.pop()
                pattern += pair
                for n in pair:
                    take[n] += 1
        used = np.flatnonzero(take)
        copies = int((left[used] // take[used]).min())
        offset = 0
        for n in pattern:
            rows.append((n, given[n], sequence, offset, copies))
            given[n] += copies
            offset += n
        left -= take * copies
        sequence += copies
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def _best_two(left: np.ndarray, room: int) -> list[int] | None:
    """The two lengths left whose sum comes closest to `room` without exceeding it."""
    below = left[:room + 1]
    have = np.flatnonzero(below > 0)
    if not len(have):
        return None
    longest = np.where(below > 0, np.arange(room + 1), 0)
    np.maximum.accumulate(longest, out=longest)
    a = have[have <= room // 2]
    b = longest[room - a]
    good = (b > a) | ((b == a) & (below[a] > 1))
    if not good.any():
        return None
    best = np.argmax(np.where(good, a + b, -1))
    return [int(b[best]), int(a[best])]


def pack(docs: DataFrame, json_path: str, ranks_path: str | None = None, doc_id: str = "doc_id",
         text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """All documents in as few sequences of at most `capacity` tokens as best-two-fit needs.

    A document is its ids and the id 2. A longer one is cut into pieces of `capacity`; its first piece may be shorter.
    Output per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Packing needs only how many pieces there are of each length, at most `capacity` numbers, which the driver turns into
    a list of patterns. A piece finds its place from its rank among the pieces of its length: its rank within its
    task, counted while tokenising, after the totals of the earlier tasks.

    A null or empty text has the end id only. Repeated rows are packed as often as they occur; ids may be null. An empty
    table gives no rows. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    made = hold(token_pieces(source, json_path, ranks_path, capacity))
    totals = made.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in totals.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = plan(counts, capacity)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    placed = made.join(offsets, ["task", "length"]).withColumn("rank", F.col("rank") + F.col("_before"))
    keep = ["doc_id", "piece", "start", "length", "ids_crc32"]
    out = T.StructType([made.schema[c] for c in keep]).add("sequence_id", "long").add("offset", "long")
    arrow = to_arrow_schema(out)
    # lengths and ranks as one sorted number each: a piece belongs to the last plan row that does not exceed it
    marks = (rows[:, 0] << 48) + rows[:, 1]

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(marks, (length.astype(np.int64) << 48) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(rows[at, 2] + rank - rows[at, 1]), pa.array(rows[at, 3])], schema=arrow)

    return placed.select(*keep, "rank").mapInArrow(place, out).withColumn("length", F.col("length").cast("bigint"))
