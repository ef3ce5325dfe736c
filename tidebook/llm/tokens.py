"""Token ids of whole batches of texts, gathered from the ids of distinct parts."""
from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa

from tidebook.llm.shared import U64, mixed, text_bytes

#: Ids of distinct parts a Python worker keeps, over all of its tasks; beyond that the parts met least are dropped between slices, which
#: changes no result.
MEMORY = 3 << 20
#: Bytes of the parts it keeps, likewise.
TEXT = 8 << 20
#: Distinct parts it keeps, likewise, besides those of one slice. Each takes some 50 bytes, and a worker lives on when its stage is over: several of
#: an executor's workers have their memory while later stages run.
PARTS = 200_000
#: What a use of a part counts for one slice later.
FADING = np.float32(0.9)
#: Bytes of a part whose hash is formed from words of 8 bytes together with those of all others; longer ones, which are few, have theirs formed alone.
LONG = 256
#: Text looked at together: many parts of a slice are the same.
SLICE_BYTES = 1 << 20

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F]] = True
#: Bytes that may begin a white-space character beyond ASCII.
_WIDE = np.zeros(256, dtype=bool)
_WIDE[[0xC2, 0xE1, 0xE2, 0xE3]] = True
#: ASCII letters and digits, and ASCII signs without the apostrophe, which tokenizers join to letters.
_ALNUM, _SIGN = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_SIGN[0x21:0x7F] = True
_ALNUM[0x30:0x3A] = _ALNUM[0x41:0x5B] = _ALNUM[0x61:0x7B] = True
_SIGN &= ~_ALNUM
_SIGN[0x27] = False
#: Parts that are tokenized in one call.
_TOGETHER = 200


def cuts(buf: np.ndarray) -> np.ndarray:
    """Marks of the bytes before which a buffer of UTF-8 is cut: before a space between two characters that are surely no white space, and
    between a letter or digit and an ASCII sign. Of other letters only those of Latin-1 are looked at."""
    cut = np.zeros(len(buf), dtype=bool)
    at = np.flatnonzero(buf == 0x20)
    at = at[(at > 0) & (at < len(buf) - 1)]
    good = ~_WHITE[buf[at - 1]] & ~_WHITE[buf[at + 1]] & ~_WIDE[buf[at + 1]]
    for back in (2, 3):  # a character of two or three bytes before the space
        good &= (buf[at - 1] < 0x80) | (at < back) | ~_WIDE[buf[np.maximum(at - back, 0)]]
    cut[at[good]] = True
    letter, sign = _ALNUM[buf], _SIGN[buf]
    two = np.flatnonzero(buf[:-1] == 0xC3)
    two = two[(buf[two + 1] != 0x97) & (buf[two + 1] != 0xB7)]
    letter[two] = letter[two + 1] = True
    cut[1:] |= (letter[:-1] & sign[1:]) | (sign[:-1] & letter[1:])
    return cut


def lowered(buf: np.ndarray) -> np.ndarray:
    """ASCII capitals in lower case, for tokenizers that lower-case after composing characters. A capital before a
    character that may combine with it stays."""
    capital = (buf >= 0x41) & (buf <= 0x5A)
    capital[:-1] &= (buf[1:] < 0x80) | (buf[1:] == 0xC3)
    return buf + (capital * np.uint8(32)).astype(np.uint8)


def together(encode: Callable[[str, int], Sequence[int]], between: str, mark: int, kind: Callable[[str], int]) -> Callable[[list[str]], list]:
    """Ids of many parts by few calls of `encode` (text, kind). Parts of one kind above 0 are joined by `between`, which is one
    token, `mark`, wherever it stands, and the ids are split there; if that gives another number of parts, each is encoded
    alone, as parts of kind 0 are."""

    def run(parts: list[str]) -> list:
        found: list = [None] * len(parts)
        groups: dict[int, list[int]] = {}
        for k, p in enumerate(parts):
            groups.setdefault(kind(p), []).append(k)
        for of, members in groups.items():
            for at in range(0, len(members) if of else 0, _TOGETHER):
                some = members[at:at + _TOGETHER]
                ids = np.asarray(encode(between.join([parts[k] for k in some]), of), dtype="<u4")
                ends = np.flatnonzero(ids == mark)
                if len(ends) == len(some) - 1:
                    a = 0
                    for k, b in zip(some, [*ends.tolist(), len(ids)]):
                        found[k] = ids[a:b]
                        a = b + 1
        for k, ids in enumerate(found):
            if ids is None:
                found[k] = np.asarray(encode(parts[k], 0), dtype="<u4")
        return found
    return run


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows of a text column, about SLICE_BYTES at a time (one row at least): first row, end, bytes, offsets of the rows."""
    buf, offsets = text_bytes(column)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
        yield at, to, buf[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
        at = to


def _grown(values: np.ndarray, n: int) -> np.ndarray:
    return values if n <= len(values) else np.concatenate([values, np.zeros(max(n, 2 * len(values)) - len(values), dtype=values.dtype)])


def _hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes."""
    words = np.ndarray(len(data), dtype="<u8", buffer=np.append(data, np.zeros(8, dtype=np.uint8)), strides=(1,))
    h = mixed(sizes.astype(U64))
    at = np.flatnonzero(sizes <= LONG)
    for k in range(0, LONG, 8):
        at = at[sizes[at] > k]
        if not len(at):
            break
        spare = (8 * np.maximum(k + 8 - sizes[at], 0)).astype(U64)
        h[at] = mixed(h[at] ^ ((words[starts[at] + k] << spare) >> spare))
    for k in np.flatnonzero(sizes > LONG):
        h[k] = int.from_bytes(hashlib.blake2b(data[starts[k]:starts[k] + sizes[k]], digest_size=8).digest(), "little")
    return h


def _gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Spans of an array, one after another."""
    before = np.cumsum(sizes) - sizes
    return values[np.repeat(starts - before, sizes) + np.arange(sizes.sum())]


class _Spans:
    """Runs of values in one growing array: run k is bound[k] to bound[k + 1]."""

    def __init__(self, dtype: str) -> None:
        self.n, self.data, self.bound = 0, np.zeros(1 << 16, dtype=dtype), np.zeros(1 << 14, dtype=np.int64)

    def add(self, values: np.ndarray, sizes: np.ndarray) -> None:
        first, used = self.n, int(self.bound[self.n])
        self.n += len(sizes)
        self.data, self.bound = _grown(self.data, used + len(values)), _grown(self.bound, self.n + 1)
        self.data[used:used + len(values)] = values
        self.bound[first + 1:self.n + 1] = used + np.cumsum(sizes)

    def span(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = self.bound[runs]
        return start, self.bound[runs + 1] - start

    def only(self, runs: np.ndarray) -> _Spans:
        made, (start, size) = _Spans(self.data.dtype), self.span(runs)
        made.add(_gathered(self.data, start, size), size)
        return made


class Ids:
    """Ids of texts under an encoder whose tokens never cross the cuts of `cuts`.

    The parts of a batch are dictionary-encoded, only parts not met before are tokenized, and the ids of the
    texts are gathered from theirs. Parts are found again by the hashes of their bytes, which are then compared.
    """

    def __init__(self, encode: Callable[[list[str]], list[np.ndarray]], end: int) -> None:
        self._encode = encode
        self._ids, self._texts = _Spans("<u4"), _Spans("u1")
        self._ids.add(np.array([end]), np.ones(1, dtype=np.int64))  # slot 0 is the end of a text
        self._texts.add(np.empty(0, dtype=np.uint8), np.zeros(1, dtype=np.int64))
        self._worth = np.zeros(1, dtype=np.float32)  # of each slot: its uses in slices, older ones for less
        self._index(np.empty(0, dtype=U64), np.empty(0, dtype=np.int32))

    def _index(self, keys: np.ndarray, slots: np.ndarray) -> None:
        self._keys, self._slots = keys, slots  # hashes in order, and their slots

    @property
    def _pool(self) -> np.ndarray:
        return self._ids.data

    def _drop(self) -> None:
        """Keeps the parts worth most, half as many parts, ids and bytes as there may be."""
        order = np.argsort(-self._worth[self._slots], kind="stable")[:PARTS // 2]
        ids, texts = (np.cumsum(x.span(self._slots[order])[1]) for x in (self._ids, self._texts))
        order = np.sort(order[(ids <= MEMORY // 2) & (texts <= TEXT // 2)])
        runs = np.concatenate([np.zeros(1, dtype=np.int32), self._slots[order]])
        self._ids, self._texts, self._worth = self._ids.only(runs), self._texts.only(runs), self._worth[runs]
        self._index(self._keys[order], np.arange(1, len(runs), dtype=np.int32))

    def _learn(self, parts: pa.LargeStringArray) -> np.ndarray:
        """The slot of each of some different parts."""
        data, offsets = text_bytes(parts)
        starts, sizes = offsets[:-1], np.diff(offsets)
        h = _hashes(data, starts, sizes)
        slot = np.zeros(len(parts), dtype=np.int64)
        if len(self._keys):
            at = np.minimum(np.searchsorted(self._keys, h), len(self._keys) - 1)
            near = np.flatnonzero(self._keys[at] == h)
            found = self._slots[at[near]]
            start, size = self._texts.span(found)
            same = size == sizes[near]
            near, found, start, size = near[same], found[same], start[same], size[same]
            differs = _gathered(data, starts[near], size) != _gathered(self._texts.data, start, size)
            same = np.add.reduceat(np.append(differs, False), np.cumsum(size) - size) == 0 if len(size) else np.empty(0, dtype=bool)
            slot[near[same]] = found[same]
        new = np.flatnonzero(slot == 0)
        if len(new):
            ids = self._encode(parts.take(pa.array(new)).to_pylist())
            slot[new] = np.arange(self._ids.n, self._ids.n + len(new))
            self._ids.add(np.concatenate(ids), np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)))
            self._texts.add(_gathered(data, starts[new], sizes[new]), sizes[new])
            self._worth = np.append(self._worth, np.zeros(len(new), dtype=np.float32))
            keys, first = np.unique(h[new], return_index=True)
            at = np.searchsorted(self._keys, keys)
            fresh = (at == len(self._keys)) | (self._keys[np.minimum(at, len(self._keys) - 1)] != keys) if len(self._keys) else np.ones(len(keys), dtype=bool)
            self._index(np.insert(self._keys, at[fresh], keys[fresh]), np.insert(self._slots, at[fresh], slot[new[first[fresh]]]))
        self._worth *= FADING
        self._worth[slot] += 1
        return slot

    def of(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts in a buffer of UTF-8, each with the end id, and the first id of every text."""
        if self._ids.n > PARTS or self._ids.bound[self._ids.n] > MEMORY or self._texts.bound[self._texts.n] > TEXT:
            self._drop()
        cut = cuts(buf)
        cut[offsets[:-1][offsets[:-1] < len(buf)]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts, len(buf)).astype(np.int64)
        column = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(buf)))
        coded = column.dictionary_encode()
        slot = self._learn(coded.dictionary)[coded.indices.to_numpy()]
        # the end of each text comes after its parts
        last = np.searchsorted(starts, offsets[1:], "left")
        slot = np.insert(slot, last, 0)
        start, size = self._ids.span(slot)
        before = np.concatenate([[0], np.cumsum(size)])
        ids = self._pool[np.repeat(start - before[:-1], size) + np.arange(before[-1])]
        return ids, before[np.concatenate([[0], last + np.arange(1, len(last) + 1)])]


_KEPT: dict[tuple, Ids] = {}


def kept_ids(key: tuple, encoder: Callable[[], Callable[[list[str]], list[np.ndarray]]], end: int) -> Ids:
    """The `Ids` of this worker under `key`: a worker runs many tasks, and their texts share most words."""
    if key not in _KEPT:
        _KEPT[key] = Ids(encoder(), end)
    return _KEPT[key]
