"""Interaction of filters, audited by an incremental stream with retractions."""
from __future__ import annotations

import itertools
import json
import math
import pickle
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidebook.llm.shared import shared_folder
from tidebook.streaming.run import state_store

FILTERS = "ABCDE"
#: Bit of the filter that depends on other rows; the others are functions of the text.
COPY = 1 << FILTERS.index("E")
ALL = (1 << len(FILTERS)) - 1
#: Available files are dealt over about so many micro-batches.
BATCHES = 4
#: Texts that share one state entry. Their number of entries follows the table.
TEXTS_PER_SLOT = 64
#: Rows a task folds before it hands them on.
FOLDED_ROWS = 1 << 16

_COUNTED = T.StructType().add("part", "string").add("mask", "integer").add("good", "boolean").add("toxic", "boolean").add("n", "long")
_FOLDED = (T.StructType().add("slot", "long").add("digest", "binary").add("part", "string").add("mask", "integer").add("good", "boolean")
           .add("toxic", "boolean").add("known", "boolean").add("id", "long").add("first", "long").add("n", "long"))


def failures(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns `keep` and `mask`, the bits of the filters A to D that `text` fails; one bit a filter, A lowest.

    The measures are a step of their own: a text is split once, however often the filters refer to its words.
    """
    words = F.array_remove(F.split("text", "[\\x20\\x09-\\x0D]+"), "")
    measured = docs.select(*keep, F.size(words).alias("_w"), F.size(F.array_distinct(words)).alias("_d"), F.length("text").alias("_n"),
                           F.regexp_count("text", F.lit("[A-Z]")).alias("_c"), F.col("text").rlike("[#$%&*|]").alias("_s"))
    w, d, n, c = (F.col(k).cast("bigint") for k in ("_w", "_d", "_n", "_c"))
    failed = (w < 200, 100 * d < 50 * w, 100 * c > 2 * n, F.col("_s"))
    return measured.select(*keep, sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(failed)), F.lit(0)).alias("mask"))


def _folded(docs: DataFrame) -> DataFrame:
    """Rows folded within each task by text, part, mask and marks: how many there are, their smallest id and how many
    hold it. A text that a third of all rows share reaches its state as a few rows of every task."""
    arrow = to_arrow_schema(_FOLDED)
    keys = ["slot", "digest", "part", "mask", "good", "toxic", "known"]

    def fold(batches: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        ids = pa.Table.from_batches(batches).group_by([*keys, "id"]).aggregate([([], "count_all")]).sort_by("id")
        out = ids.group_by(keys, use_threads=False).aggregate([("id", "first"), ("count_all", "first"), ("count_all", "sum")])
        out = out.rename_columns({"id_first": "id", "count_all_first": "first", "count_all_sum": "n"})
        return out.select(arrow.names).cast(arrow).combine_chunks().to_batches()

    def run(batches):
        kept, rows = [], 0
        for batch in batches:
            kept.append(batch)
            rows += batch.num_rows
            if rows >= FOLDED_ROWS:
                yield from fold(kept)
                kept, rows = [], 0
        if rows:
            yield from fold(kept)
    return docs.mapInArrow(run, _FOLDED)


def _step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State of a text: its smallest id so far and the rows that hold it, counted by part and marks. A smaller id retracts
    those rows from the counters of their mask and adds them to the counters of the mask with the copy filter."""
    texts: dict = pickle.loads(state.get[0]) if state.exists else {}
    delta, by_text = Counter(), defaultdict(list)
    for frame in frames:
        for digest, part, mask, good, toxic, known, i, first, n in frame[_FOLDED.names[1:]].itertuples(index=False, name=None):
            if known:
                by_text[bytes(digest)].append((part, mask, good, toxic, i, first, n))
            else:
                delta[part, mask, good, toxic] += n
    for digest, rows in by_text.items():
        mask, least, holders = rows[0][1], min(r[4] for r in rows), {}
        if digest in texts:
            before, held = texts[digest]
            if before <= least:
                least, holders = before, held
            else:
                for (part, good, toxic), n in held.items():
                    delta[part, mask, good, toxic] -= n
                    delta[part, mask | COPY, good, toxic] += n
        for part, _, good, toxic, i, first, n in rows:
            first = first if i == least else 0
            if first:
                holders[part, good, toxic] = holders.get((part, good, toxic), 0) + first
                delta[part, mask, good, toxic] += first
            if n > first:
                delta[part, mask | COPY, good, toxic] += n - first
        texts[digest] = (least, holders)
    state.update((pickle.dumps(texts),))
    yield pd.DataFrame([(*k, n) for k, n in delta.items() if n], columns=_COUNTED.names)


def documents_stream(spark: SparkSession, path: str, batches: int = BATCHES) -> DataFrame:
    """The files of a table as a stream of about `batches` micro-batches. The path is given as a pattern of itself, since
    a stream reads a table that is one file only as a pattern."""
    table, path = spark.read.parquet(path), path.rstrip("/")
    return (spark.readStream.schema(table.schema).option("maxFilesPerTrigger", max(1, -(-len(table.inputFiles()) // batches)))
            .parquet(f"{path[:-1]}[{path[-1]}]"))


def counters(docs: DataFrame, labels: DataFrame, slots: int, folder: str | None = None) -> DataFrame:
    """(part, mask, good, toxic, n): documents of a stream by the filters they fail. Runs the stream over all that is there.

    The counters are sums of changes. Every micro-batch writes its changes under its own number, so one that is repeated
    after a failure replaces itself; state and progress lie in the shared folder, so a stream given the same `folder`
    again goes on with the files that are new. `slots` is the number of state entries and stays the same for a folder.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/audit-{uuid.uuid4().hex}"
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    marks.write.mode("overwrite").parquet(f"{folder}/marks")
    marks = spark.read.parquet(f"{folder}/marks")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.col("doc_id").cast("bigint").alias("id"),
                       text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))
    rows = failures(rows, ["part", "id", "digest"]).join(marks, "id", "left").select(
        F.pmod(F.xxhash64("digest"), F.lit(slots)).alias("slot"), "digest", "part", "mask", F.coalesce("good", F.lit(False)).alias("good"),
        F.coalesce("toxic", F.lit(False)).alias("toxic"), F.col("id").isNotNull().alias("known"), F.coalesce("id", F.lit(0)).alias("id"))
    changes = _folded(rows).groupBy("slot").applyInPandasWithState(_step, _COUNTED, "texts binary", "update", GroupStateTimeout.NoTimeout)

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")

    with state_store(spark):
        query = (changes.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
                 .foreachBatch(write).start())
    query.awaitTermination()
    spark.createDataFrame([], _COUNTED).write.mode("overwrite").parquet(f"{folder}/changes/batch=-1")  # there may have been no batch
    return spark.read.schema(_COUNTED).parquet(f"{folder}/changes").groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")).where("n <> 0")


def _orders() -> list[dict]:
    """Order, step, set of the filters before, filter and set of that filter, for every step of every order."""
    rows = []
    for order in itertools.permutations(range(len(FILTERS))):
        name, before = "".join(FILTERS[k] for k in order), 0
        for step, k in enumerate(order, 1):
            rows.append({"o": name, "s": step, "f": before, "b": k, "m": 1 << k})
            before |= 1 << k
    return rows


def interactions(counted: DataFrame) -> DataFrame:
    """Every step of every order of the filters, for every part of `counters`.

    A part is one row of sums, one for each set of filters: the documents that pass all of the set. All figures of
    a step are differences of two of them, and a filter's share over all orders weighs each set by the orders that put
    it first. Parts are aggregated before the shuffle; nothing else is compared between rows.
    """
    sets = range(ALL + 1)
    passed = lambda s, more: F.coalesce(F.sum(F.when((F.col("mask").bitwiseAND(s) == 0) & more, F.col("n"))), F.lit(0))
    sums = counted.groupBy("part").agg(*[F.array(*[passed(s, more) for s in sets]).alias(c) for c, more in
                                         (("k", F.lit(True)), ("g", F.col("good")), ("t", F.col("toxic")))])
    weight = [math.factorial(s.bit_count()) * math.factorial(len(FILTERS) - 1 - s.bit_count()) if s != ALL else 0 for s in sets]
    shapley = F.array(*[sum((F.lit(weight[s]) * (F.col("k")[s] - F.col("k")[s | 1 << b]) for s in sets if not s >> b & 1), F.lit(0))
                        for b in range(len(FILTERS))])
    orders = F.from_json(F.lit(json.dumps(_orders())), "array<struct<o:string,s:int,f:int,b:int,m:int>>")
    rows = sums.select("part", "k", "g", "t", shapley.alias("h"), F.explode(orders).alias("r"))
    first, bit = F.col("r.f"), F.col("r.m")
    then = first.bitwiseOR(bit)
    at = lambda c, i: F.element_at(c, i + 1)
    removed = at("k", first) - at("k", then)
    return rows.select("part", F.col("r.o").alias("filter_order"), F.col("r.s").alias("step"), at("k", then).alias("kept"), removed.alias("removed"),
                       (at("k", F.lit(0)) - at("k", bit) - removed).alias("redundant"),
                       (at("k", F.lit(ALL).bitwiseXOR(bit)) - at("k", F.lit(ALL))).alias("unique_fails"),
                       (at("g", first) - at("g", then)).alias("good_lost"), (at("t", first) - at("t", then)).alias("toxic_lost"),
                       at("h", F.col("r.b")).alias("shapley"))


def audit(spark: SparkSession, path: str, labels: DataFrame, texts_per_slot: int = TEXTS_PER_SLOT, batches: int = BATCHES,
          folder: str | None = None) -> DataFrame:
    """Five filters on the table of documents at `path`, in all 120 orders, for every part (source).

    Filters: A fewer than 200 words, B less than half of the words distinct, C more than 2 % capitals, D a sign of
    `#$%&*|`, E the text of a smaller doc_id anywhere in the table. A to D look at one row; E is settled by a stream
    over the files, whose state is kept by text (256-bit digest).

    A null text is empty; a null source is the part ''. Rows that repeat an id and a text are copies of smaller ids
    only, not of each other. A row without id is a copy of nothing and nothing is a copy of it; it has no labels. A label is held
    by an id if any of its label rows says so. An empty table gives no rows. Other columns are not read.
    """
    slots = max(1, spark.read.parquet(path).count() // texts_per_slot)
    return interactions(counters(documents_stream(spark, path, batches), labels, slots, folder))
