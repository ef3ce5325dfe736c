"""Benchmark decontamination by winnowing."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidebook.llm.shared import ALNUM, Words, bit_filter, hold, passes, pieces, small_batches

WINDOW = 13  # words that count as shared when they run together
GRAM = 7     # words of a fingerprint
BITS = 22    # of the filter on fingerprints
SIDE = WINDOW - GRAM  # a window reaches at most so many words beyond a fingerprint in it

_TEXTS = T.ArrayType(T.StringType())
_SPAN = (T.StructType().add("k", "integer").add("h", "long").add("at", "integer")
         .add("left", _TEXTS).add("gram", _TEXTS).add("right", _TEXTS))


def selected(words: Words) -> np.ndarray:
    """Word indices of the winnowed grams: the rightmost smallest hash of every SIDE + 1 neighbouring grams.

    Any WINDOW words hold SIDE + 1 grams, so each has a selected gram, and equal windows select alike.
    """
    at, h = words.grams(GRAM)
    if len(at) <= SIDE:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    view = np.lib.stride_tricks.sliding_window_view(h, SIDE + 1)
    pick = SIDE - np.argmin(view[:, ::-1], axis=1) + np.arange(len(view))
    inside = words.doc[at[:len(view)]] == words.doc[at[SIDE:]]
    pick = np.unique(pick[inside])
    return at[pick], h[pick]


def _span(words: Words, i: int, h: np.uint64, k: int, side: int) -> dict:
    """The gram of k words at word i with up to `side` words around it, nearest first on the left."""
    d = words.doc[i]
    lo, hi = max(words.first[d], i - side), min(words.first[d + 1], i + k + side)
    text = [words.buf[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(words.start[lo:hi], words.end[lo:hi])]
    return {"k": k if side else -k, "h": int(h.view(np.int64)), "at": int(i - words.first[d]),
            "left": text[:i - lo][::-1], "gram": text[i - lo:i - lo + k], "right": text[i - lo + k:]}


def fingerprints(items: DataFrame) -> DataFrame:
    """Fingerprints of (item, text) with their contexts. An item shorter than a window has one gram, all its words,
    marked by a negative k: a match of it is a whole window."""
    out = T.StructType([items.schema["item"], *_SPAN.fields])
    arrow = to_arrow_schema(out)

    def run(batches):
        for batch in batches:
            for part, words in pieces(batch, "text", ALNUM):
                ids, rows = part.column("item").to_pylist(), []
                for i, h in zip(*selected(words)):
                    rows.append({"item": ids[words.doc[i]], **_span(words, i, h, GRAM, SIDE)})
                size = np.diff(words.first)
                for d in np.flatnonzero((size > 0) & (size < WINDOW)):
                    at, h = words.grams(size[d])
                    i = words.first[d]
                    rows.append({"item": ids[d], **_span(words, i, h[np.searchsorted(at, i)], int(size[d]), 0)})
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return items.mapInArrow(run, out)


def marked(docs: DataFrame, flags: np.ndarray, short: list[int]) -> DataFrame:
    """(doc_id, n_words, spans) of (doc_id, text): the fingerprints that some benchmark item may share."""
    out = T.StructType([docs.schema["doc_id"]]).add("n_words", "long").add("spans", T.ArrayType(_SPAN))
    arrow = to_arrow_schema(out)

    def run(batches):
        for batch in batches:
            for part, words in pieces(batch, "text", ALNUM):
                spans = [[] for _ in range(part.num_rows)]
                for k, side, at, h in [(GRAM, SIDE, *selected(words)), *((n, 0, *words.grams(n)) for n in short)]:
                    for j in np.flatnonzero(passes(flags, h, BITS)):
                        spans[words.doc[at[j]]].append(_span(words, at[j], h[j], k, side))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(words.first)), pa.array(spans, arrow.field("spans").type)],
                    schema=arrow)

    return docs.mapInArrow(run, out)


def _shared(a: str, b: str) -> Column:
    """Length of the common start of two arrays of words."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x == y)
    miss = F.array_position(same, False)
    return F.when(miss == 0, n).otherwise(miss - 1).cast("int")


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id",
                  text: str = "text") -> DataFrame:
    """Documents that repeat WINDOW words of a benchmark item, or a whole shorter item.

    Input: `docs` (doc_id, text, ...), `items` (item_id, text, ...); other columns are not read. Output per row of
    `docs`: doc_id, n_words, n_hit (words inside a shared window), items (sorted texts of the ids of items with shared
    windows), contaminated (n_hit > 0 and 20 * n_hit >= n_words).

    Grams of GRAM words are winnowed on both sides; fingerprints meet in an equi join, and a match is extended by
    comparing the words around it, so hash collisions count for nothing. Every shared window holds a fingerprint and
    lies within SIDE words of it, which is why the contexts suffice. A bitmap of fixed size keeps fingerprints without
    partner out of the shuffle.

    Null or empty texts have no words and no hits. Items without words match nothing; rows that repeat an item id
    count as one item, a null id marks words but is not listed. Repeated document rows get a row each.
    """
    small_batches(docs.sparkSession)
    prints = hold(fingerprints(items.select(F.col(item_id).alias("item"), F.col(text).cast("string").alias("text"))))
    short = [-r["k"] for r in prints.where("k < 0").select("k").distinct().collect()]  # at most WINDOW - 1 lengths
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    base = hold(marked(source, bit_filter(prints, "h", BITS), short)
                .withColumn("_uid", F.monotonically_increasing_id()))
    spans = base.where(F.size("spans") > 0).select("_uid", F.explode("spans").alias("s")).select("_uid", "s.*")
    other = prints.select("item", "k", "h", *[F.col(c).alias(f"{c}_b") for c in ("left", "gram", "right")]).distinct()
    hits = (spans.join(other, ["k", "h"]).where("gram = gram_b")
            .withColumn("l", _shared("left", "left_b")).withColumn("r", _shared("right", "right_b"))
            .where((F.col("k") < 0) | (F.col("l") + F.col("r") + GRAM >= WINDOW))
            .select("_uid", "item", (F.col("at") - F.col("l")).alias("a"),
                    (F.col("at") + F.abs("k") + F.col("r")).alias("b"))
            .distinct())
    hits = hold(hits)
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n"))
    union = F.aggregate(
        F.array_sort(F.collect_set(F.struct("a", "b"))), zero,
        lambda acc, x: F.struct(F.greatest(acc["end"], x["b"]).alias("end"),
                                (acc["n"] + F.greatest(x["b"] - F.greatest(acc["end"], x["a"]), F.lit(0))).cast("bigint").alias("n")))
    words = hits.select("_uid", "a", "b").distinct().groupBy("_uid").agg(union["n"].alias("n_hit"))
    named = (hits.select("_uid", F.col("item").cast("string").alias("item")).distinct().groupBy("_uid")
             .agg(F.array_sort(F.collect_list("item")).alias("items")))
    none = F.array().cast("array<string>")
    return (base.select("_uid", "doc_id", "n_words")
            .join(words, "_uid", "left").join(named, "_uid", "left")
            .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
                    F.coalesce("items", none).alias("items"))
            .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))))
