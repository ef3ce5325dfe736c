"""Class-based bigram model: words are put into classes by exchange, texts are scored by class steps and words in classes."""
from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidebook.llm.shared import NOT_SPACE, U64, Words, bit_filter, fold, hold, mixed, passes, pieces, signed, small_batches, written

FOLDS, HELD_OUT = 7, 2
EXCHANGED = 2000     # most frequent words, whose classes the others start from
LEAST = 3            # occurrences from which on exchange places a word
CLASSES = 48         # classes of placed words
ENDINGS = 32         # classes of all other words, known or not, by their last three bytes
HEAD = 1 << 18       # words whose counts and classes every task holds, at most; those of the others are joined
SETTLED = 0.01       # share of the words, or growth of the information in a step, below which exchange has settled
PRIOR = 5.0          # weight of the classes' shares in the probability of a step
END = np.int64(0x7E4D5F3C2B1A0987)  # stands for the end of a document among the words' hashes
_KEEP = 2_000_000    # counted values that a task gathers before it sends them on
_BITS = 22           # of the filter that knows most words outside the head that are not placed
_BLOCK = 1 << 12     # words of the head whose profiles are one row
_FAR = 250_000       # occurrences of placed words outside the head whose profiles are one row, about


def endings(words: Words) -> np.ndarray:
    """Class of a word by its last three bytes (fewer, if it is shorter)."""
    n = words.end - words.start
    code = words.buf[words.end - 1].astype(U64)
    for k in (2, 3):
        code |= np.where(n >= k, words.buf[np.maximum(words.end - k, 0)], 0).astype(U64) << U64(8 * (k - 1))
    return (mixed(code) % U64(ENDINGS)).astype(np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, g, c) of all tokens of (text): hash, ending class and number. The end of a document is a token."""
    out = T.StructType().add("h", "long").add("g", "integer").add("c", "long")
    arrow = to_arrow_schema(out)

    def run(batches):
        kept, size, ends = [], 0, 0

        def sent():
            h, g = (np.concatenate(x) for x in zip(*kept))
            order = np.argsort(h)
            h = h[order]
            at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])[:len(h)])
            return pa.RecordBatch.from_arrays([pa.array(h[at]), pa.array(g[order[at]].astype(np.int32)), pa.array(np.diff(at, append=len(h)))], schema=arrow)

        for batch in batches:
            for part, words in pieces(batch, "text", NOT_SPACE):
                kept.append((signed(words.hash), endings(words)))
                size, ends = size + len(words.hash), ends + part.num_rows
                if size >= _KEEP:
                    yield sent()
                    kept, size = [], 0
        if kept:
            yield sent()
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([END]), pa.array([-1], pa.int32()), pa.array([ends])], schema=arrow)

    return docs.select("text").mapInArrow(run, out).groupBy("h", "g").agg(F.sum("c").alias("c"))


class Places:
    """Where hashes stand among sorted ones: those with the same first bits are few, and are compared one after another."""

    BITS = 20

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = hashes
        self.first = np.searchsorted(self._top(hashes), np.arange((1 << self.BITS) + 1)).astype(np.int32)

    def _top(self, h: np.ndarray) -> np.ndarray:
        return (h >> (64 - self.BITS)) + (1 << (self.BITS - 1))

    def of(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(a place, whether the hash stands there)."""
        if not len(self.hashes):
            return np.zeros(len(h), dtype=np.int64), np.zeros(len(h), dtype=bool)
        top = self._top(h)
        at = self.first[top]
        found = self.hashes[np.minimum(at, len(self.hashes) - 1)] == h
        open_ = np.flatnonzero(~found)
        while len(open_):
            at[open_] += 1
            open_ = open_[at[open_] < self.first[top[open_] + 1]]
            here = self.hashes[at[open_]] == h[open_]
            found[open_[here]] = True
            open_ = open_[~here]
        return np.minimum(at, len(self.hashes) - 1), found


@dataclass
class Units:
    """Placed words by number, and the numbers of everything else: endings, then the end of a document."""
    hashes: np.ndarray  # sorted
    of: np.ndarray      # number of each

    @property
    def end(self) -> int:
        return len(self.hashes) + ENDINGS

    @cached_property
    def places(self) -> Places:
        return Places(self.hashes)

    def numbered(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(units of all tokens, index of each document's first token); every document ends with `end`."""
        h = signed(words.hash)
        unit = len(self.hashes) + endings(words)
        if len(self.hashes):
            at, found = self.places.of(h)
            unit = np.where(found, self.of[at], unit)
        return self.sequence(words, unit)

    def sequence(self, words: Words, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seq = np.full(len(unit) + words.n_docs, self.end, dtype=np.int64)
        seq[np.arange(len(unit)) + words.doc] = unit
        return seq, words.first[:-1] + np.arange(words.n_docs)

    def candidates(self, words: Words, seq: np.ndarray, flags: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all tokens, whether each may be a placed word outside the head); the others' classes are at hand."""
        h = np.zeros(len(seq), dtype=np.int64)
        if flags is None:
            return h, np.zeros(len(seq), dtype=bool)
        h[np.arange(len(words.hash)) + words.doc] = signed(words.hash)
        maybe = np.flatnonzero((seq >= len(self.hashes)) & (seq < self.end))
        found = np.zeros(len(seq), dtype=bool)
        found[maybe] = passes(flags, h[maybe], _BITS)
        return h, found


def unit_pairs(docs: DataFrame, units: Units) -> DataFrame:
    """(a, b, n): how often unit b follows unit a in (text); a document begins after an end."""
    out = T.StructType().add("a", "integer").add("b", "integer").add("n", "long")
    arrow = to_arrow_schema(out)
    many = units.end + 1

    def run(batches):
        kept, size = [], 0

        def sent():
            code, n = np.unique(np.concatenate(kept), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array((code // many).astype(np.int32)), pa.array((code % many).astype(np.int32)), pa.array(n)], schema=arrow)

        for batch in batches:
            for _, words in pieces(batch, "text", NOT_SPACE):
                seq, _ = units.numbered(words)
                before = np.concatenate([[units.end], seq[:-1]])
                kept.append(before * many + seq)
                size += len(seq)
                if size >= _KEEP:
                    yield sent()
                    kept, size = [], 0
        if kept:
            yield sent()

    return docs.select("text").mapInArrow(run, out).groupBy("a", "b").agg(F.sum("n").alias("n"))


def _profiles(pairs: DataFrame, classes: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """For every unit, how often each class stands after it and before it; units times classes numbers."""
    out = T.StructType().add("u", "integer").add("side", "integer").add("g", "integer").add("n", "long")
    arrow = to_arrow_schema(out)

    def run(batches):
        for batch in batches:
            a, b, n = (batch.column(c).to_numpy() for c in "abn")
            for side, u, g in ((0, a, classes[b]), (1, b, classes[a])):
                code, at = np.unique(u.astype(np.int64) * many + g, return_inverse=True)
                total = np.bincount(at, weights=n).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array((code // many).astype(np.int32)), pa.array(np.full(len(code), side, dtype=np.int32)),
                                                  pa.array((code % many).astype(np.int32)), pa.array(total)], schema=arrow)

    found = pairs.mapInArrow(run, out).groupBy("u", "side", "g").agg(F.sum("n").alias("n")).toArrow()
    u, side, g, n = (found.column(c).to_numpy() for c in ("u", "side", "g", "n"))
    both = np.zeros((2, len(classes), many))
    both[side, u, g] = n
    return both[0], both[1]


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-9)), 0.0)


def information(steps: np.ndarray) -> float:
    """Mutual information of neighbouring classes, in nats."""
    total = steps.sum()
    return float((_xlogx(steps).sum() - _xlogx(steps.sum(axis=0)).sum() - _xlogx(steps.sum(axis=1)).sum() + _xlogx(total)) / max(total, 1))


def exchange(pairs: DataFrame, n_words: int) -> np.ndarray:
    """Class of every unit.

    Words start in classes by rank. In each round the tasks count which classes surround each word, from all pairs;
    then each word in turn leaves its class and enters the one that raises the likelihood of the class steps
    most. Rounds end when few words move, or when the steps tell hardly more. Only the tables of words by classes reach
    the driver; their size is set by the parameters.
    """
    many = CLASSES + ENDINGS + 1
    classes = np.concatenate([np.arange(n_words) % CLASSES, CLASSES + np.arange(ENDINGS + 1)]).astype(np.int64)
    told = -1.0
    while True:
        after, before = _profiles(pairs, classes, many)
        steps = np.zeros((many, many))
        np.add.at(steps, classes, after)
        if information(steps) <= told * (1 + SETTLED / 10):
            return classes
        told = information(steps)
        moved = 0
        for w in range(n_words):
            own, r, l = classes[w], after[w], before[w]
            total = r.sum()
            if not total:
                continue
            steps[own] -= r
            steps[:, own] -= l
            np.maximum(steps, 0, out=steps)
            some = steps[:CLASSES]
            size = some.sum(axis=1)
            gain = (_xlogx(some + r) - _xlogx(some)).sum(axis=1)
            some = steps[:, :CLASSES]
            gain += (_xlogx(some + l[:, None]) - _xlogx(some)).sum(axis=0) - 2 * (_xlogx(size + total) - _xlogx(size))
            new = int(np.argmax(gain))
            steps[new] += r
            steps[:, new] += l
            moved += new != own
            classes[w] = new
        if moved <= SETTLED * n_words:
            return classes


def _packed(*columns: np.ndarray) -> bytes:
    """Numbers by byte planes, as many as they need, the first column as differences, so that little is left of them."""
    columns = [np.ascontiguousarray(c, dtype=np.int64).view(U64) for c in (np.diff(columns[0], prepend=0), *columns[1:])]
    wide = [max(1, -(-int(c.max(initial=0)).bit_length() // 8)) for c in columns]
    return bytes(wide) + zstandard.compress(b"".join(c.view(np.uint8)[k::8].tobytes() for c, w in zip(columns, wide) for k in range(w)), 1)


def _unpacked(data: bytes, many: int) -> list[np.ndarray]:
    wide = list(data[:many])
    planes = iter(np.frombuffer(zstandard.decompress(data[many:]), dtype=np.uint8).reshape(sum(wide), -1))
    out = []
    for w in wide:
        first, *more = (next(planes) for _ in range(w))
        out.append(first.astype(np.int64))
        for k, plane in enumerate(more, 1):
            out[-1].view(np.uint8)[k::8] = plane
    return [np.cumsum(out[0]), *out[1:]]


def _summed(n: np.ndarray, *keys: np.ndarray) -> list[np.ndarray]:
    """The distinct keys in order, and the sums of n."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    keys = [k[order] for k in keys]
    at = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)])) if len(n) else np.empty(0, dtype=np.int64)
    return [*[k[at] for k in keys], np.add.reduceat(n[order], at) if len(n) else n]


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct of sorted values, and the index of each."""
    new = np.concatenate([[True], values[1:] != values[:-1]])[:len(values)]
    return values[new], np.cumsum(new) - 1


@dataclass
class Profiles:
    """How often each class stands after (side 0) or before (side 1) each word, as rows of many words.

    Words of the head are dealt to the blocks in turn, so the most frequent ones are not together: word w is number w // near_blocks
    of block w % near_blocks. A row tells it by that number and side * MANY + class; another word by its hash. Hashes also
    come with 2 * MANY + their class, if they are placed, and 3 * MANY + their ending.

    `neighbours` counts once which words stand beside which; each round sets classes for words in that table (`of_near`, `of_far`).
    `of_texts`, `pairs` and `of_pairs` tell the same straight from the texts.
    """
    n_words: int
    units_end: int
    far_blocks: int

    SCHEMA = T.StructType().add("block", "long").add("data", "binary")

    def __post_init__(self) -> None:
        self.many, self.classes, self.block = CLASSES + ENDINGS + 1, CLASSES, _BLOCK  # tasks get them with the object
        self.near_blocks = self.units_end // self.block + 1
        self.arrow = to_arrow_schema(self.SCHEMA)

    def rows(self, near: tuple, far: tuple) -> pa.RecordBatch:
        """Counts (code, n) of the head and (hash, code, n) of other words, dealt into blocks."""
        code, n = near
        w, step = code // (2 * self.many), code % (2 * self.many)
        out = self.dealt(w % self.near_blocks, w // self.near_blocks * 2 * self.many + step, n)
        return self.batch(out + self.dealt(self.far_block(far[0]), *far))

    def far_block(self, h: np.ndarray) -> np.ndarray:
        return self.near_blocks + (mixed(h.view(U64)) % U64(self.far_blocks)).astype(np.int64)

    def dealt(self, block: np.ndarray, *columns: np.ndarray) -> list[tuple[int, bytes]]:
        """The columns, packed by block."""
        order = np.argsort(block, kind="stable")
        block, columns = block[order], [c[order] for c in columns]
        at = np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(block))
        return [(int(block[i]), _packed(*(c[i:j] for c in columns))) for i, j in zip(at[:-1], at[1:])]

    def batch(self, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], f.type) for i, f in enumerate(self.arrow)], schema=self.arrow)

    def neighbours(self, docs: DataFrame, known) -> DataFrame:
        """How often which words stand beside each, as rows of a block.

        Rows of words of the head: (number * 2 + side) * units + the unit that stands there, and how often; neighbours that may be placed
        words outside the head are left to those. Rows of the latter, one a block: hash, kind, value and how often, by
        kind: 0 and 1 the unit at that side, 2 and 3 the hash of another such word at side 0 and 1, 4 their own ending.
        """
        many, blank = self.units_end + 1, np.empty(0, dtype=np.int64)

        def run(batches):
            units, flags = known.value
            near, far, size, code, n = [], [], 0, blank, blank
            for batch in batches:
                for _, words in pieces(batch, "text", NOT_SPACE):
                    seq, _ = units.numbered(words)
                    h, open_ = units.candidates(words, seq, flags)
                    x = np.roll(np.arange(len(seq)), 1)  # a document begins after an end, which is where the one before it ends
                    at = ~open_ & ~open_[x]
                    near.append(seq[x[at]] * many + seq[at])
                    y = np.flatnonzero(open_)
                    if len(y):
                        for side, z in ((0, (y + 1) % len(seq)), (1, x[y])):
                            far.append((h[y], np.where(open_[z], 2 + side, side), np.where(open_[z], h[z], seq[z])))
                        far.append((h[y], np.full(len(y), 4), seq[y] - len(units.hashes)))
                    size += len(seq)
                    if size >= _KEEP:
                        values, more = np.unique(np.concatenate(near), return_counts=True)
                        code, n = _summed(np.concatenate([n, more]), np.concatenate([code, values]))
                        near, size = [], 0
                        if len(code) >= _KEEP // 2 or sum(len(x[0]) for x in far) >= _KEEP // 2:
                            yield sent(code, n, far)
                            far, code, n = [], blank, blank
            if near:
                values, more = np.unique(np.concatenate(near), return_counts=True)
                code, n = _summed(np.concatenate([n, more]), np.concatenate([code, values]))
            if len(code) or far:
                yield sent(code, n, far)

        def sent(code, n, far):
            out, span = [], self.block * 2 * many
            first, second = code // many, code % many
            for side, w, other in ((0, first, second), (1, second, first)):
                key = w % self.near_blocks * span + (w // self.near_blocks * 2 + side) * many + other
                order = np.argsort(key)
                key, times = key[order], n[order]
                cuts = np.searchsorted(key, np.arange(self.near_blocks + 1) * span)
                out += [(b, _packed(key[i:j] - b * span, times[i:j])) for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])) if i < j]
            if far:
                columns = [np.concatenate(c).astype(np.int64) for c in zip(*far)]
                columns = _summed(np.ones(len(columns[0]), dtype=np.int64), *columns)
                out += self.dealt(self.far_block(columns[0]), *columns)
            return self.batch(out)

        def merge(batches):
            near, size, far = {}, Counter(), {}
            for batch in batches:
                for block, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist()):
                    if block >= self.near_blocks:
                        far.setdefault(block, []).append(data)
                        continue
                    near.setdefault(block, []).append(_unpacked(data, 2))
                    size[block] += len(near[block][-1][0])
                    if size[block] >= _KEEP // 2:  # a block of any size in rows of some megabytes
                        yield summed(block, near.pop(block))
                        size[block] = 0
            for block in list(near):
                yield summed(block, near.pop(block))
            for block in list(far):
                *keys, n = (np.concatenate(x) for x in zip(*(_unpacked(d, 4) for d in far.pop(block))))
                yield self.batch([(block, _packed(*_summed(n, *keys)))])

        def summed(block, parts):
            code, n = (np.concatenate(x) for x in zip(*parts))
            return self.batch([(block, _packed(*_summed(n, code)))])

        rows = docs.select("text").mapInArrow(run, self.SCHEMA)
        return rows.repartition(self.near_blocks + self.far_blocks, "block").mapInArrow(merge, self.SCHEMA)

    def of_near(self, neighbours: DataFrame, classes: np.ndarray) -> DataFrame:
        """From the neighbours of words of the head whose classes are at hand."""
        units, many = self.units_end + 1, self.many

        def run(batches):
            last, total = None, None
            for batch in batches:
                for block, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist()):
                    if last is not None and block != last:
                        yield sent(last, total)
                    if block != last:
                        last, total = block, np.zeros(self.block * 2 * many)
                    code, n = _unpacked(data, 2)
                    total += np.bincount(code // units * many + classes[code % units], weights=n, minlength=len(total))
            if last is not None:
                yield sent(last, total)

        def sent(block, total):
            code = np.flatnonzero(total)
            return self.batch([(block, _packed(code, total[code]))])

        return neighbours.where(F.col("block") < self.near_blocks).mapInArrow(run, self.SCHEMA)

    def of_far(self, neighbours: DataFrame, tail: DataFrame, classes: np.ndarray) -> DataFrame:
        """From the rows of words outside the head, which meet the classes of their block: what stands beside them, and they beside
        others. Those that turn out not to be placed belong to their endings."""
        many = self.many

        def packed(batches):
            kept = []
            for batch in batches:
                kept.append([batch.column(c).to_numpy().astype(np.int64) for c in "hk"])
            if kept:
                h, k = (np.concatenate(x) for x in zip(*kept))
                order = np.argsort(h)
                yield self.batch(self.dealt(self.far_block(h[order]), h[order], k[order]))

        def run(batches):
            for batch in batches:
                for data, found in zip(batch.column("data").to_pylist(), batch.column("classes").to_pylist()):
                    h, kind, value, n = _unpacked(data, 4)
                    w, word = _runs(h)
                    own, placed = np.zeros(len(w), dtype=np.int64), np.zeros(len(w), dtype=bool)
                    at = kind == 4
                    own[word[at]] = self.classes + value[at]
                    for x in found or []:
                        of, k = _unpacked(x, 2)
                        i = np.minimum(np.searchsorted(w, of), len(w) - 1)
                        i, k = i[w[i] == of], k[w[i] == of]
                        own[i], placed[i] = k, True
                    side, near, far = kind % 2, kind < 2, (kind == 2) | (kind == 3)
                    mine = np.where(near, side * many + classes[np.where(near, value, 0)], 3 * many + value)
                    theirs = (1 - side) * many + own[word]
                    here = near | at
                    beside = _summed(n[near], value[near] * 2 * many + theirs[near])
                    others = _summed(np.concatenate([n[here], n[far], np.ones(placed.sum(), dtype=np.int64)]),
                                     np.concatenate([h[here], value[far], w[placed]]), np.concatenate([mine[here], theirs[far], 2 * many + own[placed]]))
                    yield self.rows(beside, others)

        held = tail.select("h", "k").mapInArrow(packed, self.SCHEMA).groupBy("block").agg(F.collect_list("data").alias("classes"))
        return neighbours.join(held.hint("merge"), "block", "left").select("data", "classes").mapInArrow(run, self.SCHEMA)

    def of_texts(self, docs: DataFrame, known, classes: np.ndarray) -> DataFrame:
        """From the neighbours whose classes are at hand. `known` are the units and the filter, broadcast once for all rounds."""
        many, blank = self.many, np.empty(0, dtype=np.int64)

        def run(batches):
            units, flags = known.value
            near, far, size, code, n = [], [], 0, blank, blank
            for batch in batches:
                for _, words in pieces(batch, "text", NOT_SPACE):
                    seq, _ = units.numbered(words)
                    h, open_ = units.candidates(words, seq, flags)
                    # a document begins after an end, which is where the one before it ends
                    here = np.arange(len(seq))
                    for side, x, y in ((0, np.roll(here, 1), here), (1, here, np.roll(here, 1))):
                        step = side * many + classes[seq[y]].astype(np.int64)
                        at = ~open_[y] & ~open_[x]
                        near.append(seq[x[at]] * 2 * many + step[at])
                        at = ~open_[y] & open_[x]
                        far.append((h[x[at]], step[at]))
                    far.append((h[open_], 3 * many + seq[open_] - len(units.hashes)))
                    size += 2 * len(seq)
                    if size >= _KEEP:
                        values, more = np.unique(np.concatenate(near), return_counts=True)
                        code, n = _summed(np.concatenate([n, more]), np.concatenate([code, values]))
                        near, size = [], 0
                        if len(code) >= _KEEP or sum(len(x) for x, _ in far) >= _KEEP // 4:
                            yield sent(code, n, far)
                            far, code, n = [], blank, blank
            if near:
                values, more = np.unique(np.concatenate(near), return_counts=True)
                code, n = _summed(np.concatenate([n, more]), np.concatenate([code, values]))
            if len(code) or far:
                yield sent(code, n, far)

        def sent(code, n, far):
            h, step = (np.concatenate(x) for x in zip(*far)) if far else (blank, blank)
            return self.rows((code, n), _summed(np.ones(len(h), dtype=np.int64), h, step))

        return docs.select("text").mapInArrow(run, self.SCHEMA)

    def pairs(self, docs: DataFrame, known) -> DataFrame:
        """(far, w, side, b, e): the neighbours b that may be placed words outside the head, with their endings; the same in all rounds."""
        out = T.StructType().add("far", "boolean").add("w", "long").add("side", "integer").add("b", "long").add("e", "integer")
        arrow = to_arrow_schema(out)

        def run(batches):
            units, flags = known.value
            for batch in batches:
                for _, words in pieces(batch, "text", NOT_SPACE):
                    seq, _ = units.numbered(words)
                    h, open_ = units.candidates(words, seq, flags)
                    y = np.flatnonzero(open_)
                    for side, x in ((0, y - 1), (1, (y + 1) % len(seq))):
                        yield pa.RecordBatch.from_arrays([pa.array(open_[x]), pa.array(np.where(open_[x], h[x], seq[x])), pa.array(np.full(len(y), side, dtype=np.int32)),
                                                          pa.array(h[y]), pa.array((seq[y] - len(units.hashes)).astype(np.int32))], schema=arrow)

        return docs.select("text").mapInArrow(run, out)

    def of_pairs(self, pairs: DataFrame, tail: DataFrame) -> DataFrame:
        """From the neighbours whose classes are joined; those that turn out not to be placed belong to their endings."""
        many, blank = self.many, np.empty(0, dtype=np.int64)
        rows = pairs.join(tail.select(F.col("h").alias("b"), "k").hint("merge"), "b", "left").select(
            "far", "w", (F.col("side") * many + F.coalesce("k", F.col("e") + CLASSES)).cast("long").alias("code"))

        def run(batches):
            kept, size = [], 0

            def sent():
                far, w, code = (np.concatenate(x) for x in zip(*kept))
                one = np.ones(len(w), dtype=np.int64)
                return self.rows(_summed(one[~far], w[~far] * 2 * many + code[~far]), _summed(one[far], w[far], code[far]))

            for batch in batches:
                kept.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                size += batch.num_rows
                if size >= _KEEP // 2:
                    yield sent()
                    kept, size = [], 0
            if kept:
                yield sent()

        def own(batches):
            for batch in batches:
                h, k = (batch.column(c).to_numpy().astype(np.int64) for c in "hk")
                yield self.rows((blank, blank), _summed(np.ones(len(h), dtype=np.int64), h, 2 * many + k))

        return rows.mapInArrow(run, self.SCHEMA).unionAll(tail.select("h", "k").mapInArrow(own, self.SCHEMA))

    def merged(self, rows: DataFrame) -> DataFrame:
        """One row a block."""
        def run(batches):
            near, far = {}, {}
            for batch in batches:
                for block, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist()):
                    if block >= self.near_blocks:
                        far.setdefault(block, []).append(data)
                        continue
                    if block not in near:
                        near[block] = np.zeros(self.block * 2 * self.many, dtype=np.int64)
                    code, n = _unpacked(data, 2)
                    near[block][code] += n
            for block in list(near):
                total = near.pop(block)
                code = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([_packed(code, total[code])])], schema=self.arrow)
            for block in list(far):
                h, code, n = (np.concatenate(x) for x in zip(*(_unpacked(d, 3) for d in far.pop(block))))
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([_packed(*_summed(n, h, code))])], schema=self.arrow)

        return rows.repartition(self.near_blocks + self.far_blocks, "block").mapInArrow(run, self.SCHEMA)

    def words(self, block: int, data: bytes, classes: np.ndarray) -> tuple:
        """(words, whether they are placed, their classes), (index of the word, side, class, n)."""
        many = self.many
        if block < self.near_blocks:
            code, n = _unpacked(data, 2)
            w, word = _runs(code // (2 * many))
            w, code = w * self.near_blocks + block, code % (2 * many)
            return (w, w < self.n_words, classes[w].astype(np.int64)), (word, code // many, code % many, n)
        h, code, n = _unpacked(data, 3)
        w, word = _runs(h)
        own, placed = np.zeros(len(w), dtype=np.int64), np.zeros(len(w), dtype=bool)
        at = code >= 3 * many
        own[word[at]] = self.classes + code[at] - 3 * many
        at = (code >= 2 * many) & ~at
        own[word[at]], placed[word[at]] = code[at] - 2 * many, True
        at = code < 2 * many
        return (w, placed, own), (word[at], code[at] // many, code[at] % many, n[at])


def class_steps(profiles: DataFrame, how: Profiles, classes: np.ndarray) -> np.ndarray:
    """How often each class follows each."""
    out = T.StructType().add("k", "integer").add("g", "integer").add("n", "long")
    arrow, many = to_arrow_schema(out), how.many

    def run(batches):
        total = np.zeros((many, many), dtype=np.int64)
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist()):
                (_, _, own), (word, side, g, n) = how.words(block, data, classes)
                np.add.at(total, (own[word[side == 0]], g[side == 0]), n[side == 0])
        k, g = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(g.astype(np.int32)), pa.array(total[k, g])], schema=arrow)

    steps = np.zeros((many, many))
    for r in profiles.mapInArrow(run, out).groupBy("k", "g").agg(F.sum("n").alias("n")).collect():
        steps[r["k"], r["g"]] = r["n"]
    return steps


def best_classes(profiles: DataFrame, how: Profiles, classes: np.ndarray, steps: np.ndarray, turn: int) -> DataFrame:
    """(far, w, k): the class that raises the likelihood of the class steps most, once the word has left its own. Of words outside the
    head, those that are not asked come too, with the class they have."""
    out = T.StructType().add("far", "integer").add("w", "long").add("k", "integer")
    arrow = to_arrow_schema(out)

    logs = [_xlogx(steps), _xlogx(steps.T)]

    def gains(S, own, word, g, n, other, log):
        """By word and class: what Σ x log x of the rows of S gains; `other` is what the word adds to its own column."""
        to = np.zeros((len(own), CLASSES))
        if not len(word):
            return to
        x, was = S[:CLASSES, g].T.copy(), log[:CLASSES, g].T.copy()
        at = np.flatnonzero(own[word] < CLASSES)
        x[at, own[word[at]]] -= n[at]
        same = np.flatnonzero(g == own[word])
        x[same] -= other[word[same], :CLASSES]
        np.maximum(x, 0, out=x)
        was[at, own[word[at]]] = _xlogx(x[at, own[word[at]]])
        was[same] = _xlogx(x[same])
        x += n[:, None]
        first = np.flatnonzero(np.diff(word, prepend=-1))
        to[word[first]] = np.add.reduceat(x * np.log(x) - was, first, axis=0)
        return to

    def chosen(own, word, side, g, n):
        around = np.zeros((2, len(own), len(steps)))
        around[side, word, g] = n
        total = around[0].sum(axis=1)
        gain = sum(gains(S, own, word[side == i], g[side == i], n[side == i], around[1 - i], logs[i]) for i, S in ((0, steps), (1, steps.T)))
        size = np.tile(steps.sum(axis=1)[:CLASSES], (len(own), 1))
        at = np.flatnonzero(own < CLASSES)
        size[at, own[at]] = np.maximum(size[at, own[at]] - total[at], 0)
        gain -= 2 * (_xlogx(size + total[:, None]) - _xlogx(size))
        return np.argmax(gain, axis=1)

    def run(batches):
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist()):
                (w, placed, own), (word, side, g, n) = how.words(block, data, classes)
                order = np.argsort(word, kind="stable")
                word, side, g, n = word[order], side[order], g[order], n[order].astype(float)
                asked = np.flatnonzero(placed & ((own >= CLASSES) | (mixed(w.view(U64)) % U64(2) == U64(turn % 2))))
                new = own.copy()
                for a in range(0, len(asked), 500):
                    some = asked[a:a + 500]
                    lo, hi = np.searchsorted(word, [some[0], some[-1] + 1])
                    index = np.full(len(w), -1)
                    index[some] = np.arange(len(some))
                    at = np.flatnonzero(index[word[lo:hi]] >= 0) + lo
                    new[some] = chosen(own[some], index[word[at]], side[at], g[at], n[at])
                sent = np.flatnonzero(placed) if block >= how.near_blocks else asked
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sent), int(block >= how.near_blocks), dtype=np.int32)), pa.array(w[sent]),
                                                  pa.array(new[sent].astype(np.int32))], schema=arrow)

    return profiles.mapInArrow(run, out)


def place(docs: DataFrame, units: Units, classes: np.ndarray, tail: DataFrame | None,
          tail_tokens: int = 0) -> tuple[np.ndarray, DataFrame | None, np.ndarray, np.ndarray | None]:
    """Classes of all units, of the placed words outside the head, the counts of class steps, and the filter of the words outside.

    In each round the tasks count the classes around every word and choose its best class against the steps of all
    classes. Words without a class enter one at once; of the others a half is asked in each round, by hash, so that words do
    not change places for ever. Rounds end when the steps tell hardly more. Classes of words in the head and the steps reach
    the driver. How often which words stand side by side is counted and written once, so no round reads the texts; rows of words
    outside the head meet the classes of their block in a join. The counts of a round stay on the executors' disks until its end.
    """
    told, best, turn = -1.0, None, 0
    how, flags, far = Profiles(len(units.hashes), units.end, 1 + tail_tokens // _FAR), None, None
    if tail is not None:
        tail = hold(tail)
        flags = bit_filter(tail, "h", _BITS)
    known, classes = docs.sparkSession.sparkContext.broadcast((units, flags)), classes.astype(np.uint8)
    counts = written(how.neighbours(docs, known))
    known.destroy()
    if tail is not None:
        far = counts.where(F.col("block") >= how.near_blocks).repartition(how.far_blocks, "block").persist(StorageLevel.DISK_ONLY)
    while True:
        rows = how.of_near(counts, classes)
        if tail is not None:
            rows = rows.unionAll(how.of_far(far, tail, classes))
        profiles = how.merged(rows).persist(StorageLevel.DISK_ONLY)
        steps = class_steps(profiles, how, classes)
        now = information(steps)
        if turn > 2 and now <= told * (1 + SETTLED):
            profiles.unpersist()
            if far is not None:
                far.unpersist()
            classes, tail, steps = (classes, tail, steps) if now > told else best
            return classes.astype(np.int64), tail, steps, flags
        if turn and now > told:  # before the first round, words still stand in the classes of their endings
            told, best = now, (classes, tail, steps)
        turn += 1
        moved = hold(best_classes(profiles, how, classes, steps, turn))
        profiles.unpersist()
        near = moved.where("far = 0").toArrow()
        classes = classes.copy()
        classes[near.column("w").to_numpy()] = near.column("k").to_numpy()
        if tail is not None:
            tail = moved.where("far = 1").select(F.col("w").alias("h"), "k")


@dataclass
class Model:
    units: Units
    classes: np.ndarray      # of units
    steps: np.ndarray        # log10 probability of a class after a class
    frequent: np.ndarray     # log10 probability of a placed word of the head in its class
    sizes: np.ndarray        # tokens of each class
    tail: bool               # whether words outside the head are placed
    share: np.ndarray        # by ending: log10 of what known words have of the class, by tokens
    unknown: np.ndarray      # by ending: log10 probability of an unknown word
    head: np.ndarray         # sorted hashes of the words whose counts are at hand
    counts: np.ndarray       # of those
    tokens: int
    kinds: int
    ends: int
    flags: np.ndarray | None = None  # lets the placed words outside the head through, and few others

    def base(self, c):
        return np.log10(c + 1.0) - np.log10(self.tokens + self.kinds + 1.0)


def train(docs: DataFrame) -> tuple[Model, DataFrame]:
    """A model of (text), and the table (h, g, c, k) of all its words' counts; k is the class of placed words outside the
    head. All documents given are counted, and all words of LEAST or more occurrences are placed."""
    table = hold(word_counts(docs))
    size = table.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"), F.sum(F.when(F.col("h") == int(END), F.col("c"))).alias("e")).first()
    level = F.floor(F.log2("c") * 8).cast("int")
    by_level = sorted(((r["l"], r["n"]) for r in table.groupBy(level.alias("l")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    lowest, room = 1 << 30, HEAD
    for l, n in by_level:
        if n > room:
            break
        lowest, room = l, room - n
    head = table.where((level >= lowest) & (F.col("h") != int(END))).toArrow()
    h, c, g = (head.column(x).to_numpy() for x in ("h", "c", "g"))
    top = np.lexsort((h, -c))
    top = top[c[top] >= LEAST]
    first = top[:EXCHANGED]

    def numbered(chosen):
        order = np.argsort(h[chosen])
        return Units(h[chosen][order], order.astype(np.int32))

    start = exchange(hold(unit_pairs(docs, numbered(first))), len(first))
    units = numbered(top)
    classes = np.concatenate([start[:len(first)], CLASSES + g[top[len(first):]], CLASSES + np.arange(ENDINGS + 1)]).astype(np.int64)
    tail = table.where((level < lowest) & (F.col("c") >= LEAST) & (F.col("g") >= 0)).select("h", (F.col("g") + CLASSES).alias("k"))
    beyond = table.where((level < lowest) & (F.col("c") >= LEAST) & (F.col("g") >= 0)).agg(F.sum("c").alias("n")).first()["n"]
    classes, tail, steps, flags = place(docs, units, classes, tail if beyond else None, beyond or 0)
    # what exchange has not placed belongs to its ending
    frequent = table.where((F.col("g") >= 0) & (F.col("c") < LEAST))
    n, kinds, once = np.zeros(ENDINGS), np.zeros(ENDINGS), np.zeros(ENDINGS)
    for r in frequent.groupBy("g").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"), F.sum((F.col("c") == 1).cast("int")).alias("once")).collect():
        n[r["g"]], kinds[r["g"]], once[r["g"]] = r["n"], r["v"], r["once"]
    unknown = (once + 1) / (n + kinds + 2)
    sizes = steps.sum(axis=0)
    shares = (sizes + 0.5) / (sizes.sum() + 0.5 * len(sizes))
    steps = np.log10((steps + PRIOR * shares) / (steps.sum(axis=1, keepdims=True) + PRIOR))
    with np.errstate(divide="ignore"):
        words = np.log10(c[top] / np.maximum(sizes[classes[:len(top)]], 1))
        share = np.log10((1 - unknown) / np.maximum(n, 1))
    order = np.argsort(h)
    model = Model(units, classes, steps, words, sizes, tail is not None, share, np.log10(unknown), h[order], c[order],
                  int(size["n"] or 0), int(size["v"]), int(size["e"] or 0), flags)
    return model, table.withColumn("k", F.lit(None).cast("int")) if tail is None else table.join(tail, "h", "left")


def score(docs: DataFrame, model: Model, table: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of `docs`: doc_id, n_tokens, n_known, train_tokens, base_score, score (log10 probability of the text).

    Tokens are lower-cased words and one end. Steps between classes and words of the head are summed where the text is
    read; each other word is sent once per document to meet its count, and the sums meet by document. If words outside the
    head are placed, each occurrence of a word that may be one is sent with the classes beside it, to meet its own.
    A word is known if training has it. Its class is its own or, by its ending, that of all words that end alike, in which
    unknown words together have the share of words seen once. base_score is the add-one score of single words.

    Null or empty texts have the end only. Without training text every word is unknown. Repeated rows score alike.
    """
    small_batches(docs.sparkSession)
    sums = T.StructType().add("doc_id", docs.schema[doc_id].dataType).add("n_tokens", "long").add("n_known", "long").add("base_score", "double").add("score", "double")
    out = (T.StructType().add("uid", "long").add("h", "long").add("g", "integer").add("n", "long").add("of", sums)
           .add("p", "integer").add("q", "integer").add("h0", "long").add("g0", "integer"))
    arrow = to_arrow_schema(out)
    m = model

    def run(batches):
        uid = TaskContext.get().partitionId() << 40
        # words with a unit are words whose counts are at hand, so one look finds both
        head, unit_of = Places(m.head), np.full(max(len(m.head), 1), -1)
        unit_of[np.searchsorted(m.head, m.units.hashes)] = m.units.of
        counts = m.counts if len(m.head) else np.zeros(1, dtype=np.int64)
        base_of, log_of = m.base(counts), np.log10(np.maximum(counts, 1))
        for batch in batches:
            for part, words in pieces(batch, "text", NOT_SPACE):
                rows = part.num_rows
                h = signed(words.hash)
                at, near = head.of(h)
                unit = np.where(near, unit_of[at], -1)
                seq, first = m.units.sequence(words, np.where(unit >= 0, unit, len(m.units.hashes) + endings(words)))
                cls = m.classes[seq]
                before = np.concatenate([[cls[-1]], cls[:-1]])
                value = m.steps[before, cls]
                base = np.full(len(seq), m.base(m.ends) if m.ends else m.base(0))
                known = np.full(len(seq), bool(m.ends))
                at_word = np.arange(len(words.hash)) + words.doc
                unit = seq[at_word]
                placed = unit < len(m.units.hashes)
                g = np.where(placed, 0, unit - len(m.units.hashes))
                own = np.where(near, m.share[g] + log_of[at], 0.0)
                if len(m.frequent):
                    own = np.where(placed, m.frequent[np.minimum(unit, len(m.frequent) - 1)], own)
                token, open_ = m.units.candidates(words, seq, m.flags if m.tail else None)
                value[open_ | np.roll(open_, 1)] = 0.0
                value[at_word] += own
                base[at_word] = np.where(near, base_of[at], 0.0)
                known[at_word] = near
                ids = np.arange(rows) + uid
                uid += rows
                of = pa.StructArray.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(words.first) + 1), pa.array(np.add.reduceat(known.astype(np.int64), first)),
                     pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(value, first))], fields=list(arrow.field("of").type))
                lone = [pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(signed(mixed(ids.astype(U64)))), pa.array(np.zeros(rows, dtype=np.int32)),
                                                  pa.array(np.zeros(rows, dtype=np.int64)), of, *lone], schema=arrow)
                # words whose classes are at hand, once a document
                far = np.flatnonzero(~near & ~open_[at_word])
                _, once, n = np.unique(mixed(words.hash[far] ^ mixed(words.doc[far].astype(U64))), return_index=True, return_counts=True)
                far = far[once]
                lone = [pa.nulls(len(far), f.type) for f in list(arrow)[4:]]
                yield pa.RecordBatch.from_arrays([pa.array(ids[words.doc[far]]), pa.array(h[far]), pa.array(g[far].astype(np.int32)), pa.array(n), *lone], schema=arrow)
                # the others, each with the classes before and after it, or the word before it if that is one of them
                at = np.flatnonzero(open_)
                if len(at):
                    doc = np.repeat(np.arange(rows), np.diff(np.append(first, len(seq))))[at]
                    again, more, ending = open_[at - 1], open_[at + 1], seq - len(m.units.hashes)
                    i32 = lambda x, none=None: pa.array(x.astype(np.int32), mask=none)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[doc]), pa.array(token[at]), i32(ending[at]), pa.array(np.ones(len(at), dtype=np.int64)), pa.nulls(len(at), arrow.field("of").type),
                         i32(before[at], again), i32(cls[at + 1], more), pa.array(token[at - 1], mask=~again), i32(ending[at - 1], ~again)], schema=arrow)

    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = source.mapInArrow(run, out).join(table.select("h", "c", "k"), "h", "left")
    step = F.lit(0.0)
    if m.tail:
        # rows without a word before meet their own word again, so they stay spread
        rows = rows.withColumn("_h", F.coalesce("h0", "h")).join(table.select(F.col("h").alias("_h"), F.col("k").alias("k0")).hint("merge"), "_h", "left")
        steps, own = F.lit(m.steps.ravel()), F.coalesce("k", F.col("g") + CLASSES)
        at = lambda a, b: F.coalesce(F.element_at(steps, (a * m.steps.shape[1] + b + 1).cast("int")), F.lit(0.0))
        step = at(F.col("p"), own) + at(own, F.col("q")) + at(F.coalesce("k0", F.col("g0") + CLASSES), F.when(F.col("h0").isNotNull(), own))
    of = lambda values: F.element_at(F.array(*[F.lit(float(x)) for x in values]), F.col("g") + 1)
    c = F.coalesce("c", F.lit(0))
    size = F.element_at(F.array(*[F.lit(float(np.log10(max(x, 1)))) for x in model.sizes]), F.col("k") + 1)
    floor = F.lit(float(np.log10(model.tokens + model.kinds + 1.0)))
    return (rows.groupBy("uid").agg(
        F.max("of.doc_id").alias("doc_id"), F.sum("of.n_tokens").alias("n_tokens"),
        F.sum(F.coalesce("of.n_known", F.lit(0)) + F.when(c > 0, F.col("n")).otherwise(0)).alias("n_known"),
        F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        F.sum(F.coalesce("of.base_score", F.lit(0.0)) + F.col("n") * (F.log10(c + 1) - floor)).alias("base_score"),
        F.sum(F.coalesce("of.score", F.lit(0.0)) + step + F.when(F.col("n") > 0, F.col("n") * F.when(F.col("k").isNotNull(), F.log10(c) - size).when(c > 0, of(model.share) + F.log10(F.greatest(c, F.lit(1)))).otherwise(of(model.unknown))).otherwise(0.0)).alias("score"))
        .drop("uid"))


def training(docs: DataFrame, parts: int = FOLDS, kept_out: int = HELD_OUT) -> DataFrame:
    """Texts of the documents outside the fold."""
    return docs.where(fold(F.col("doc_id"), parts) != kept_out).select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
