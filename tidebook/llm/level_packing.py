"""Online packing by the sum of squares of the level counts."""
from __future__ import annotations

import os
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidebook.llm.shared import small_batches
from tidebook.llm.tokens import kept_ids, lowered, slices, together

CAPACITY = 4096
END_ID = 2
#: Windows a task keeps open at most; their ids are held until they are full.
OPEN = 1024
#: Pieces a task collects before it hands them on.
ROWS = 1 << 14

Piece = tuple[object, int, np.ndarray, int]  # doc_id, start, ids, ids of the whole document


class Levels:
    """The partially filled windows of a task by fill level, and the count of each level.

    An item of s ids goes to the level h for which the sum of the squared counts grows least when a window moves from h
    to h + s; a new window is level 0, and a full one leaves the array. Of equal levels the fullest is taken. With `open`
    windows open no new one starts: an item that fits none of them fills up the fullest and its rest is placed alike.
    """

    def __init__(self, capacity: int = CAPACITY, most: int = OPEN) -> None:
        self.capacity, self.most, self.n_open = capacity, most, 0
        self.count = np.zeros(capacity + 1, dtype=np.int64)
        self.windows: list[deque[list[Piece]]] = [deque() for _ in range(capacity)]
        # growth of the sum by a window that leaves a level and by one that comes to it; a full window costs nothing
        self._leave, self._come = np.full(capacity + 1, np.iinfo(np.int64).max >> 1), np.ones(capacity + 1, dtype=np.int64)
        self._leave[0], self._come[capacity] = 0, 0

    def _change(self, level: int, by: int) -> None:
        if 0 < level < self.capacity:
            n = self.count[level] = self.count[level] + by
            self._leave[level] = 1 - 2 * n if n else np.iinfo(np.int64).max >> 1
            self._come[level] = 2 * n + 1
            self.n_open += by

    def level(self, s: int) -> int | None:
        """The level an item of s ids goes to."""
        self._leave[0] = 0 if self.n_open < self.most else np.iinfo(np.int64).max >> 1
        growth = self._leave[:self.capacity - s + 1] + self._come[s:]
        best = len(growth) - 1 - int(np.argmin(growth[::-1]))
        return best if self._leave[best] < np.iinfo(np.int64).max >> 1 else None

    def put(self, piece: Piece, level: int) -> list[Piece] | None:
        """Place a piece in a window of that level; the window, if this fills it."""
        window = self.windows[level].popleft() if level else []
        window.append(piece)
        to = level + len(piece[2])
        self._change(level, -1)
        self._change(to, 1)
        if to == self.capacity:
            return window
        self.windows[to].append(window)
        return None

    def place(self, piece: Piece) -> Iterator[list[Piece]]:
        """Place an item; windows that it fills."""
        level = self.level(len(piece[2]))
        while level is None:
            level = int(np.flatnonzero(self.count)[-1])
            head, piece = split(piece, self.capacity - level)
            yield self.put(head, level)
            level = self.level(len(piece[2]))
        full = self.put(piece, level)
        if full:
            yield full

    def close(self) -> Iterator[list[Piece]]:
        """Close the open windows without padding: the emptiest are cut up to fill the fullest, and what is left at the
        end, less than a window, becomes sequences whose lengths are powers of two."""
        left = deque(w for level in range(self.capacity - 1, 0, -1) for w in self.windows[level])
        spare: deque[Piece] = deque()
        while left:
            window = left.popleft()
            room = self.capacity - sum(len(p[2]) for p in window)
            while room and (spare or left):
                if not spare:
                    spare.extend(left.pop())
                piece = spare.popleft()
                if len(piece[2]) > room:
                    piece, rest = split(piece, room)
                    spare.appendleft(rest)
                window.append(piece)
                room -= len(piece[2])
            if room:
                spare.extend(window)
            else:
                yield window
        while spare:
            room = 1 << (sum(len(p[2]) for p in spare).bit_length() - 1)
            room, window = min(room, self.capacity), []
            while room:
                piece = spare.popleft()
                if len(piece[2]) > room:
                    piece, rest = split(piece, room)
                    spare.appendleft(rest)
                window.append(piece)
                room -= len(piece[2])
            yield window


def split(piece: Piece, at: int) -> tuple[Piece, Piece]:
    doc_id, start, ids, whole = piece
    return (doc_id, start, ids[:at], whole), (doc_id, start + at, ids[at:], whole)


def word_encoder(path: str):
    """Encoder of parts by a tokenizer file that drops white space; names of special tokens in a text are ordinary text."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    encode = lambda text, _=0: tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
    mark = encode("\x01")  # white space on both sides keeps it apart; it vanishes
    return together(encode, "\n\x01\n", mark[0], lambda part: int(len(mark) == 1 and "\x01" not in part))


def pack_levels(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, most: int = OPEN) -> DataFrame:
    """All documents in sequences of `capacity` tokens, placed online in one pass without a shuffle.

    A document is its ids by the tokenizer file `path` and the id 2. Its whole windows are sequences of their own; the rest is
    placed by `Levels`, in the order of the rows. Each task keeps its own level array, so tasks need nothing of each other, and a
    task that is run again repeats its result. The windows open at a task's end are closed by cutting documents: every
    sequence has `capacity` tokens, but for at most log2(capacity) of a task whose lengths are smaller powers of two.

    Output per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A null or empty text has the end id
    only. Repeated rows are packed as often as they occur; ids may be null. An empty table gives no rows. Other columns
    are not read.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = (T.StructType([source.schema["doc_id"]]).add("start", "long").add("length", "long").add("ids_crc32", "long").add("doc_tokens", "long")
           .add("sequence_id", "long").add("offset", "long"))
    arrow = to_arrow_schema(out)

    def run(batches):
        ids_of = kept_ids(("words", path), lambda: word_encoder(path), END_ID)
        levels, sequence, rows = Levels(capacity, most), TaskContext.get().partitionId() << 40, []

        def filled(window: list[Piece]) -> None:
            nonlocal sequence
            offset = 0
            for i, start, ids, whole in window:
                rows.append((i, start, len(ids), zlib.crc32(np.ascontiguousarray(ids)), whole, sequence, offset))
                offset += len(ids)
            sequence += 1

        def taken() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
            rows.clear()
            return made

        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for at, to, buf, offsets in slices(batch.column("text")):
                ids, first = ids_of.of(lowered(buf), offsets)
                for d in range(at, to):
                    a, b = int(first[d - at]), int(first[d - at + 1])
                    whole = b - a
                    for start in range(0, whole - capacity + 1, capacity):
                        filled([(names[d], start, ids[a + start:a + start + capacity], whole)])
                    rest = whole % capacity
                    if rest:
                        for window in levels.place((names[d], whole - rest, ids[b - rest:b].copy(), whole)):
                            filled(window)
                if len(rows) >= ROWS:
                    yield taken()
        for window in levels.close():
            filled(window)
        if rows:
            yield taken()

    return source.mapInArrow(run, out)
