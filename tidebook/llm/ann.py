"""Nearest vectors by a permutation index: pivots in order of nearness, inverted by pivot, ranked by footrule."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidebook.llm.shared import hold

PIVOTS = 128         # at most
PREFIX = 48          # nearest pivots of a vector, in whose files it stands
SHARE, LEAST = 0.25, 300  # of a part's vectors that are reranked for a query, nearest by footrule distance, and no fewer than this
PART_ROWS = 4096     # vectors, and queries, that a task compares at a time


def usable(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(vec_id, v) of finite vectors that are not zero, as doubles."""
    v = F.col(vector).cast("array<double>")
    good = (F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists(v, lambda x: x != 0))
    return vectors.where(good).select(F.col(id_col).alias("vec_id"), v.alias("v"))


def permutation(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest pivots of each row, nearest first, ties to the earlier pivot."""
    unit = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
    return np.argsort(-np.round(unit @ pivots.T, 12), axis=1, kind="stable")[:, :prefix].astype(np.int32)


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k vectors of largest cosine for each query: query_id, rank, vec_id, score.

    `queries` is a subset of `vectors` with the same columns; a query's own row is no candidate. Equal vectors are one
    entry of the index with their k + 1 smallest ids, so a vector that a third of the rows hold is compared once.
    Pivots are a bounded sample of the entries (PIVOTS, by hash); every entry is represented by its PREFIX nearest pivots in
    order. The index is dealt by a hash into parts of about PART_ROWS entries; a part has one file for each pivot, with the
    places that the pivot takes in its entries' orders. Blocks of queries meet all parts. For a query, the files of its own
    pivots give the footrule distances, the nearest SHARE of the part is reranked by cosine, and k + 1 ids leave the task.

    Vectors that are null or zero, or hold null or non-finite numbers, take part on neither side. Vectors of different
    length never meet. Rows that repeat an id with the same vector count once. Fewer than k candidates give fewer rows;
    ties go to the smaller id.
    """
    entries = usable(vectors, id_col, vector).distinct()
    # ids of an entry are first cut to the smallest in parts, so no list holds all ids of a common vector
    parts = entries.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(256)))
    few = lambda c: F.slice(F.array_sort(c), 1, k + 1)
    entries = hold(parts.groupBy("v", "part").agg(few(F.collect_list("vec_id")).alias("ids"))
                   .groupBy("v").agg(few(F.flatten(F.collect_list("ids"))).alias("ids"))
                   .select("v", "ids", F.size("v").alias("dim"), F.element_at("ids", 1).alias("entry")))
    asked = usable(queries, id_col, vector).withColumnRenamed("vec_id", "query_id").distinct().join(entries.select("v", "entry", "dim"), "v")
    asked = hold(asked.select("query_id", "entry", "dim"))
    sizes = {r["dim"]: r["count"] for r in entries.groupBy("dim").count().collect()}
    found = [_within(entries.where(F.col("dim") == d), asked.where(F.col("dim") == d), d, n, k) for d, n in sizes.items()]
    if not found:
        return asked.select("query_id", F.lit(1).alias("rank"), F.col("entry").alias("vec_id"), F.lit(0.0).alias("score")).where("false")
    best = found[0]
    for other in found[1:]:
        best = best.union(other)
    # entries' results meet the queries that hold the entry's vector
    top = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (asked.join(best, asked["entry"] == best["asked"]).where("vec_id != query_id")
            .select("query_id", "vec_id", "score").withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _within(entries: DataFrame, asked: DataFrame, dim: int, n: int, k: int) -> DataFrame:
    """(asked, vec_id, score): the k + 1 nearest ids of each asked entry, among vectors of one length."""
    many = min(PIVOTS, n)
    sample = entries.orderBy(F.xxhash64("v"), "entry").limit(many).select("v").toArrow().column("v").combine_chunks()
    pivots = _rows(sample, dim)
    pivots = pivots / np.abs(pivots).max(axis=1, keepdims=True)
    pivots = pivots / np.linalg.norm(pivots, axis=1, keepdims=True)
    prefix = min(PREFIX, many)
    id_type = entries.schema["entry"].dataType
    out = T.StructType([entries.schema["entry"], entries.schema["v"], entries.schema["ids"]]).add("order", T.ArrayType(T.IntegerType()))
    arrow = to_arrow_schema(out)

    def order(batches):
        for batch in batches:
            perm = permutation(_rows(batch.column("v"), dim), pivots, prefix) if batch.num_rows else np.empty((0, prefix), dtype=np.int32)
            offsets = np.arange(len(perm) + 1, dtype=np.int32) * prefix
            yield pa.RecordBatch.from_arrays([batch.column("entry"), batch.column("v"), batch.column("ids"), pa.ListArray.from_arrays(offsets, pa.array(perm.ravel()))], schema=arrow)

    index = hold(entries.select("entry", "v", "ids").mapInArrow(order, out))
    wanted = index.join(asked.select("entry").distinct(), "entry", "left_semi")
    parts, blocks = -(-n // PART_ROWS), max(1, -(-wanted.count() // PART_ROWS))
    one_of = lambda m: F.pmod(F.xxhash64("entry"), F.lit(m)).cast("int")
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    columns = ["part", "block", "entry", "v", "ids", "order", "ask"]
    posts = index.withColumn("part", one_of(parts)).withColumn("block", each(blocks)).withColumn("ask", F.lit(0)).select(*columns)
    probes = wanted.withColumn("block", one_of(blocks)).withColumn("part", each(parts)).withColumn("ask", F.lit(1)).select(*columns)
    near = T.StructType().add("asked", id_type).add("vec_id", id_type).add("score", "double")
    near_arrow = to_arrow_schema(near)

    def compare(table: pa.Table) -> pa.Table:
        ask = table.column("ask").to_numpy() == 1
        v, perm = (_rows(table.column(c).combine_chunks(), w) for c, w in (("v", dim), ("order", prefix)))
        entry, ids = table.column("entry").to_numpy(), table.column("ids").to_pylist()
        data = np.flatnonzero(~ask)
        files = np.full((many, len(data)), prefix, dtype=np.int16)
        files[perm[data], np.arange(len(data))[:, None]] = np.arange(prefix, dtype=np.int16)
        x = np.ascontiguousarray(v[data].T)
        norms = squares(x)
        taken = min(len(data), max(LEAST, 2 * k + 2, int(np.ceil(SHARE * len(data)))))
        a, b, s = [], [], []
        for q in np.flatnonzero(ask) if len(data) else ():
            apart = np.zeros(len(data), dtype=np.int32)
            for place, pivot in enumerate(perm[q]):
                # what both orders hold moves by the difference; what only one holds counts as standing behind the other
                apart += np.abs(files[pivot] - np.int16(place)) + files[pivot]
            rank = np.argpartition(apart, taken - 1)
            rank = rank[:taken] if taken == len(data) else np.flatnonzero(apart <= apart[rank[taken - 1]])
            cosine = cosines(v[q], x[:, rank], norms[rank])
            floor = -np.partition(-cosine, min(k, len(cosine) - 1))[min(k, len(cosine) - 1)]
            rows = sorted((-cosine[i], y) for i in np.flatnonzero(cosine >= floor) for y in ids[data[rank[i]]])[:k + 1]
            a += [entry[q]] * len(rows)
            b += [y for _, y in rows]
            s += [-c for c, _ in rows]
        return pa.Table.from_arrays([pa.array(a, near_arrow.field(0).type), pa.array(b, near_arrow.field(1).type), pa.array(s, pa.float64())], schema=near_arrow)

    found = posts.union(probes).groupBy("part", "block").applyInArrow(compare, near)
    top = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("_r", F.row_number().over(top)).where(F.col("_r") <= k + 1).drop("_r")


def squares(x: np.ndarray) -> np.ndarray:
    total = np.zeros(x.shape[1])
    for row in x:
        total += row * row
    return np.sqrt(total)


def cosines(q: np.ndarray, x: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Cosines of q with the columns of x in double precision, summed in one order, so equal vectors score equally."""
    dot = np.zeros(x.shape[1])
    for j in range(len(q)):
        dot += q[j] * x[j]
    return dot / (squares(q[:, None])[0] * norms)
