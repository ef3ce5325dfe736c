"""Phrases that stand together more often than their parts, mined from FM-indexes over word ids."""
from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidebook.llm.shared import U64, Words, bit_filter, mixed, passes, pieces, shared_folder, signed, small_batches

LEAST = 10        # occurrences of a candidate
TOP = 2000        # phrases of a language in the report
INSIDE = 50       # per cent of a phrase's occurrences that lie in a longer candidate which replaces it
#: Candidates of a part of a language, as a multiple of the report.
PART_TOPS = 16
#: Words of a shard (one document at least).
SHARD_WORDS = 1 << 20
#: Bits of the filters on frequent words and pairs.
BITS = 24
#: Rounds in which pairs and triples are summed (a power of two): the shuffle of one round is on disk at a time.
ROUNDS = 4
#: Bytes of a row group of the indexes, whose rows have some megabytes each.
GROUP = 16 << 20

#: Words end at blanks and tabs, and at the signs that end a piece.
_ENDS = np.zeros(256, dtype=bool)
_ENDS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_KIND = ~_ENDS
_KIND[[0x20, 0x09]] = False

_WORD = T.StructType().add("lang", "string").add("word", "string").add("h", "long").add("n", "long")
_INDEX = (T.StructType().add("shard", "long").add("words", T.ArrayType(_WORD)).add("sizes", "binary")
         .add("left", "binary").add("right", "binary"))


def _packed(values: np.ndarray) -> bytes:
    """Numbers of 32 bits, compressed byte plane by byte plane."""
    return zstandard.compress(np.ascontiguousarray(values.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


def _order(*keys: np.ndarray) -> np.ndarray:
    """Positions ordered by one or two keys (not negative), equal ones as they stand."""
    key, n = keys[0].astype(np.int64), len(keys[0])
    for more in keys[1:]:
        key = key * (int(more.max(initial=0)) + 1) + more
    bits = max(1, (n - 1).bit_length())
    if int(key.max(initial=0)).bit_length() + bits < 63:
        return np.sort((key << bits) | np.arange(n)) & ((1 << bits) - 1)
    return np.argsort(key, kind="stable")


def _starts(*columns: np.ndarray) -> np.ndarray:
    """First positions of runs of equal rows."""
    new = np.ones(len(columns[0]), dtype=bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


class Index:
    """The FM-index of a text of symbols, 0 at the end of every piece, over phrases of up to three words.

    Row j belongs to the j-th suffix in the order of its first two symbols; so the suffixes that begin with a phrase of one or
    two words, and by their counts those of three, are an interval of rows. `sizes` counts each symbol, which gives
    the intervals of single symbols. `left` is the Burrows-Wheeler transform: the symbol before each suffix. `right` is
    that of the reversed text: the symbols after the occurrences of a symbol, whose interval is the same in both; they are kept
    in order within it, since an extension needs only how often each stands there. A phrase grows to the right by the
    symbols that `right` holds in its interval, and to the left by those of `left`; the stable order of `left` is the
    last-to-first mapping, which puts the intervals of the longer phrases one after another.
    """

    def __init__(self, sizes: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
        self.sizes, self.left, self.right = sizes, left, right

    @classmethod
    def of(cls, text: np.ndarray, symbols: int) -> Index:
        after = np.roll(text, -1)
        rows = _order(text, after)
        return cls(np.bincount(text, minlength=symbols), np.roll(text, 1)[rows].astype(np.int32), after[rows].astype(np.int32))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Extension of all words to the right: (first, second, count) of every pair, in the order of the rows."""
        first = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        at = _starts(first, self.right)
        return first[at], self.right[at], np.diff(np.append(at, len(first)))

    def triples(self, first: np.ndarray, second: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Extension of all pairs to the left: (symbol before, pair extended, pair that begins the triple, count)."""
        pair = np.repeat(np.arange(len(count), dtype=np.int32), count)
        order = _order(self.left)
        before, rest = self.left[order], pair[order]
        at = _starts(before, rest)
        return before[at], rest[at], pair[at], np.diff(np.append(at, len(before)))


def _salt(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


class _Shard:
    """Text gathered for one index: word hashes by chunk, and each chunk's distinct words."""

    def __init__(self) -> None:
        self.n, self.parts, self.keys, self.words, self.langs, self.distinct = 0, [], [], [], [], 0

    def add(self, langs: pa.Array, words: Words) -> None:
        if not len(words.hash):
            return
        names = langs.to_pylist()
        codes = {name: U64(_salt(name)) for name in set(names)}
        key = mixed(words.hash ^ np.array([codes[x] for x in names], dtype=U64)[words.doc])
        distinct, where, inverse = np.unique(key, return_index=True, return_inverse=True)
        ends = np.concatenate([[0], np.cumsum(_ENDS[words.buf])])
        last = np.ones(len(key), dtype=bool)  # of its piece
        last[:-1] = (words.doc[1:] != words.doc[:-1]) | (ends[words.start[1:]] != ends[words.end[:-1]])
        self.parts.append((inverse + self.distinct, last))
        start, size = words.start[where], words.end[where] - words.start[where]
        to = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        data = words.buf[np.repeat(start - to[:-1], size) + np.arange(to[-1])]
        self.words.append(pa.LargeStringArray.from_buffers(len(where), pa.py_buffer(to), pa.py_buffer(data)))
        self.langs.append(langs.take(pa.array(words.doc[where])).cast(pa.large_string()))
        self.keys.append(distinct)
        self.distinct += len(distinct)
        self.n += len(key)

    def row(self, shard: int) -> pa.RecordBatch:
        """The index of the text. Symbols are numbered by falling count, so most are small numbers."""
        keys, where, symbol = np.unique(np.concatenate(self.keys), return_index=True, return_inverse=True)
        counts = sum(np.bincount(symbol[words], minlength=len(keys)) for words, _ in self.parts)
        by_count = np.argsort(-counts, kind="stable")
        number = np.empty(len(keys), dtype=np.int32)
        number[by_count] = np.arange(1, len(keys) + 1)
        symbol, keys, where = number[symbol], keys[by_count], where[by_count]
        chunks = []
        for words, last in self.parts:
            at = np.arange(len(words)) + np.concatenate([[0], np.cumsum(last[:-1])])
            chunk = np.zeros(len(words) + int(last.sum()), dtype=np.int32)
            chunk[at] = symbol[words]
            chunks.append(chunk)
        self.parts.clear()
        index = Index.of(np.concatenate(chunks), len(keys) + 1)
        arrow = to_arrow_schema(_INDEX)
        entry = arrow.field("words").type.value_type
        columns = [pa.concat_arrays(self.langs).take(pa.array(where)), pa.concat_arrays(self.words).take(pa.array(where)),
                   pa.array(signed(keys)), pa.array(index.sizes[1:].astype(np.int64))]
        structs = pa.StructArray.from_arrays([c.cast(entry.field(k).type) for k, c in enumerate(columns)], fields=list(entry))
        steps = np.diff(index.right, prepend=np.int32(0))
        return pa.RecordBatch.from_arrays(
            [pa.array([shard]), pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), structs).cast(arrow.field("words").type),
             *(pa.array([_packed(x)], pa.binary()) for x in (index.sizes, index.left, steps))], schema=arrow)


def shards(docs: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One FM-index for each run of about `shard_words` words of (lang, text), with its words and their counts."""
    def run(batches):
        shard, made = _Shard(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for part, words in pieces(batch, "text", _KIND):
                shard.add(part.column("lang"), words)
                if shard.n >= shard_words:
                    yield shard.row(made)
                    shard, made = _Shard(), made + 1
        if shard.n:
            yield shard.row(made)
    return docs.mapInArrow(run, _INDEX)


def _over(index: DataFrame, out: str, grams: Callable[[np.ndarray, Index], tuple[np.ndarray, ...]]) -> DataFrame:
    """Rows of `grams` of every shard."""
    schema = T.StructType.fromDDL(out)
    arrow = to_arrow_schema(schema)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (r for k in range(batch.num_rows) for r in batch.slice(k, 1).to_pylist()):
                keys = np.concatenate([np.zeros(1, dtype=np.uint64), np.array(row["keys"], dtype=np.int64).view(np.uint64)])  # symbol 0 is no word
                index = Index(_unpacked(row["sizes"]), _unpacked(row["left"]), np.cumsum(_unpacked(row["right"]), dtype=np.int32))
                table = pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in grams(keys, index)], schema=arrow)
                for at in range(0, table.num_rows, 1 << 16):
                    yield table.slice(at, 1 << 16)
    return index.select(F.col("words.h").alias("keys"), "sizes", "left", "right").mapInArrow(run, schema)


def _joint(first, second):
    """One number for a pair of words, the same in numpy and in Spark."""
    if isinstance(first, Column):
        return F.shiftleft(first, 1).bitwiseXOR(F.shiftrightunsigned(first, 63)).bitwiseXOR(second)
    return ((first << U64(1)) | (first >> U64(63))) ^ second


def _saved(df: DataFrame, path: str, **options) -> DataFrame:
    """A table in the shared folder: it ends the lineage, and no row of it is lost with an executor.

    The shuffles it came from are deleted after a garbage collection on the driver, which is asked for here."""
    df.write.options(**options).parquet(path)
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _frequent(index: DataFrame, words: int, grams: Callable[[np.ndarray, Index], tuple[np.ndarray, ...]], least: int, path: str) -> DataFrame:
    """Phrases of `words` words (h1, h2, ..., n) that occur `least` times or more, summed over the shards in ROUNDS rounds: a round
    takes the phrases whose hash falls to it, from all shards, and writes a table of its own."""
    keys, tables = [f"h{k + 1}" for k in range(words)], []
    for k in range(ROUNDS):
        def of_round(hashes: np.ndarray, index: Index, k: int = k) -> tuple[np.ndarray, ...]:
            found = grams(hashes, index)
            mine = (reduce(_joint, found[:-1]) & U64(ROUNDS - 1)) == U64(k)
            return tuple(c[mine] for c in found)
        summed = _over(index, ", ".join(f"{c} bigint" for c in [*keys, "n"]), of_round).groupBy(*keys).agg(F.sum("n").alias("n"))
        tables.append(_saved(summed.where(F.col("n") >= least), f"{path}/{k}"))
    return index.sparkSession.read.schema(tables[0].schema).parquet(*[f"{path}/{k}" for k in range(ROUNDS)])


def counted(docs: DataFrame, folder: str, least: int = LEAST, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Words (lang, word, h, n), pairs (h1, h2, n) and triples (h1, h2, h3, n) that occur `least` times or more, and words of each
    lang (lang, n).

    The indexes are built once and written to `folder`, as are the counts. Their counts are summed across shards level by level: a phrase
    can be frequent only if both its parts are, so a shard reports a pair of frequent words, a triple of two frequent
    pairs, found by a filter of fixed size; what passes it wrongly is summed exactly and fails the threshold. Pairs and triples are summed
    in rounds, so that only a part of them is in a shuffle at a time. Words are known by 64-bit hashes of language and word, which are verified to be one to one over the whole vocabulary.
    """
    source = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    small_batches(docs.sparkSession)
    # Parquet looks at sizes after 100 rows only, which are all shards of a task here: a page would hold them all, and so would the buffers
    # that it is compressed and read in
    index = _saved(shards(source, shard_words), f"{folder}/index", **{
        "parquet.block.size": GROUP, "parquet.page.row.count.limit": 1, **{f"parquet.{x}.size.row.check.{y}": 1 for x in ("block", "page") for y in ("min", "max")}})
    entries = index.select(F.explode("words").alias("w")).select("w.lang", "w.word", "w.h", "w.n")
    vocabulary = _saved(entries.groupBy("lang", "word", "h").agg(F.sum("n").alias("n")), f"{folder}/words")
    if vocabulary.groupBy("h").count().where("count > 1").limit(1).count():
        raise ValueError("two words of this vocabulary have one hash; change the salt of the languages")
    words = vocabulary.where(F.col("n") >= least)
    totals = vocabulary.groupBy("lang").agg(F.sum("n").cast("bigint").alias("total"))
    flags = bit_filter(words, "h", BITS)

    def pairs(keys: np.ndarray, index: Index) -> tuple[np.ndarray, ...]:
        known = passes(flags, keys, BITS)
        known[0] = False
        first, second, n = index.pairs()
        keep = known[first] & known[second]
        return keys[first[keep]], keys[second[keep]], n[keep]
    two = _frequent(index, 2, pairs, least, f"{folder}/pairs")
    joint = bit_filter(two.select(_joint(F.col("h1"), F.col("h2")).alias("h")), "h", BITS)

    def triples(keys: np.ndarray, index: Index) -> tuple[np.ndarray, ...]:
        first, second, n = index.pairs()
        known = (first > 0) & (second > 0) & passes(joint, _joint(keys[first], keys[second]), BITS)
        before, rest, begin, count = index.triples(first, second, n)
        keep = known[rest] & known[begin]
        return keys[before[keep]], keys[first[rest[keep]]], keys[second[rest[keep]]], count[keep]
    return words, two, _frequent(index, 3, triples, least, f"{folder}/triples"), totals


def _score(a: str, l: str, r: str) -> Column:  # noqa: E741
    """floor(1000000 a a / (l r)), exact for counts of up to 13 digits."""
    wide = lambda c: f"CAST({c} AS DECIMAL(13, 0))"
    return F.expr(f"(CAST(1000000 AS DECIMAL(7, 0)) * ({wide(a)} * {wide(a)})) div ({wide(l)} * {wide(r)})")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, inside: int = INSIDE, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The `top` phrases of two or three words of each lang, by how often the words stand together against their parts.

    A phrase of count a is cut where it is weakest, into parts of counts l and r: its score is the smallest
    floor(1000000 a a / (l r)). Phrases never cross a sign of `.,;:!?` or a line end. A phrase that lies in a longer
    candidate holding `inside` per cent of its occurrences or more is left out, whether or not that one stays.

    Output: lang, rank, phrase, a, l, r, n (words of the lang), score. Null texts are empty; a null lang is `und`. Repeated rows count
    as often as they occur. Ties are settled by a, then the phrase in byte order. A lang without candidates has no
    row, and an empty table none. Other columns are not read.
    """
    folder = f"{shared_folder(docs.sparkSession)}/phrases-{uuid.uuid4().hex}"
    words, two, three, totals = counted(docs, folder, least, shard_words)
    word = lambda k: words.select(F.col("h").alias(f"h{k}"), F.col("word").alias(f"w{k}"), F.col("n").alias(f"n{k}"))
    part = lambda a, b, name: two.select(F.col("h1").alias(a), F.col("h2").alias(b), F.col("n").alias(name))
    longer = three.withColumnRenamed("n", "a").join(part("h1", "h2", "begin"), ["h1", "h2"]).join(part("h2", "h3", "rest"), ["h2", "h3"])
    longer = _saved(longer, f"{folder}/longer")
    covered = (longer.where(100 * F.col("a") >= inside * F.col("begin")).select("h1", "h2")
               .union(longer.where(100 * F.col("a") >= inside * F.col("rest")).select("h2", "h3")).distinct())
    first = words.select(F.col("h").alias("h1"), F.col("word").alias("w1"), F.col("n").alias("n1"), "lang")
    pairs = (two.withColumnRenamed("n", "a").join(covered, ["h1", "h2"], "left_anti").join(first, "h1").join(word(2), "h2")
             .select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("n1").alias("l"), F.col("n2").alias("r"), _score("a", "n1", "n2").alias("score")))
    cut = lambda l, r: F.struct(_score("a", l, r).alias("score"), F.col(l).alias("l"), F.col(r).alias("r"))  # noqa: E731, E741
    triples = (longer.join(first, "h1").join(word(2), "h2").join(word(3), "h3")
               .select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", cut("n1", "rest").alias("one"), cut("begin", "n3").alias("two"))
               .select("lang", "phrase", "a", F.when(F.col("two.score") < F.col("one.score"), F.col("two")).otherwise(F.col("one")).alias("c"))
               .select("lang", "phrase", "a", "c.l", "c.r", "c.score"))
    # the best of each part of a language come before the best of the language, so no task reads all its candidates
    parts = max(1, (two.count() + longer.count()) // (PART_TOPS * top))
    best = [F.desc("score"), F.desc("a"), "phrase"]
    ranked = pairs.unionByName(triples).withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    for keys in (["lang", "_part"], ["lang"]):
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*best))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
