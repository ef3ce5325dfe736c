"""Near-duplicate documents: MinHash signatures joined by a multi-index on their chunks."""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidebook.llm.shared import NOT_SPACE, U64, Words, bit_filter, hold, mixed, passes, pieces, signed, small_batches

SHINGLE, SIMILARITY = 5, 75      # words; percent of the union
SYMBOLS, CHUNKS = 64, 16         # 16-bit symbols of a signature, and its chunks
PER_CHUNK = SYMBOLS // CHUNKS
#: Signatures that differ in at most so many symbols share a chunk with at most one error: 16 chunks with two
#: errors each would make 32. A pair at the limit of similarity differs in 16 on average, with a deviation of 3.5.
DISTANCE = 2 * CHUNKS - 1
BLOCK = 1 << 20                  # numbers (of sets, signatures and buckets) of the members that a task compares with others
BITS = 20

_SEEDS = mixed(np.arange(1, SYMBOLS + 1, dtype=U64))
_FACTORS = mixed(np.arange(1001, SYMBOLS + 1001, dtype=U64)) | U64(1)


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the runs of SHINGLE words; of a shorter document, of all its words."""
    at, h = words.grams(SHINGLE)
    size = np.diff(words.first)
    few = np.flatnonzero((size > 0) & (size < SHINGLE))
    if not len(few):
        return words.doc[at], h
    doc = np.concatenate([words.doc[at], few])
    h = np.concatenate([h, np.array([words.whole(d) for d in few], dtype=U64)])
    order = np.argsort(doc, kind="stable")
    return doc[order], h[order]


def signature(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Lowest 16 bits of the smallest value of SYMBOLS hash functions over each set; sets are h[first[i]:first[i+1]]."""
    out = np.empty((len(first), SYMBOLS), dtype=np.uint16)
    for k in range(SYMBOLS):
        values = (h ^ _SEEDS[k]) * _FACTORS[k]
        values ^= values >> U64(32)
        out[:, k] = (np.minimum.reduceat(values, first) & U64(0xFFFF)).astype(np.uint16)
    return out


def profiles(docs: DataFrame) -> DataFrame:
    """(doc_id, n, s1, s2, sig) of (doc_id, text): number of distinct shingles, hash of their set, signature."""
    out = (T.StructType([docs.schema["doc_id"]]).add("n", "long").add("s1", "long").add("s2", "long").add("sig", "binary"))
    arrow = to_arrow_schema(out)

    def run(batches):
        for batch in batches:
            for part, words in pieces(batch, "text", NOT_SPACE):
                doc, h = shingles(words)
                rows = part.num_rows
                first = np.searchsorted(doc, np.arange(rows + 1))
                full = np.flatnonzero(np.diff(first))
                n, sets, sig = np.zeros(rows, dtype=np.int64), np.zeros((rows, 2), dtype=np.int64), [b""] * rows
                if len(full):
                    symbols = signature(h, first[full])
                    for j, d in enumerate(full):
                        own = np.unique(h[first[d]:first[d + 1]])
                        n[d] = len(own)
                        sets[d] = np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=16).digest(), dtype=np.int64)
                        sig[d] = symbols[j].tobytes()
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(sets[:, 0]), pa.array(sets[:, 1]), pa.array(sig, pa.binary())], schema=arrow)

    return docs.mapInArrow(run, out)


def bucket_keys(classes: DataFrame) -> DataFrame:
    """(key, id) for every chunk and each of its symbols left out: equal keys mean a chunk with at most one error."""
    out = T.StructType().add("key", "long").add("id", classes.schema["id"].dataType)
    arrow = to_arrow_schema(out)

    def run(batches):
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype=np.uint16).reshape(-1, CHUNKS, PER_CHUNK).astype(U64)
            ids = batch.column("id")
            for c in range(CHUNKS):
                for gone in range(PER_CHUNK):
                    key = np.full(len(sig), c * PER_CHUNK + gone, dtype=U64)
                    for s in range(PER_CHUNK):
                        if s != gone:
                            key = (key << U64(16)) | sig[:, c, s]
                    yield pa.RecordBatch.from_arrays([pa.array(signed(key)), ids], schema=arrow)

    return classes.select("id", "sig").mapInArrow(run, out)


def _near(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose signatures differ in at most DISTANCE symbols and whose sizes allow the similarity."""
    out = T.StructType([pairs.schema["a"], pairs.schema["b"]])
    arrow = to_arrow_schema(out)

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(-1, SYMBOLS) for c in ("sig", "sig_b"))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], schema=arrow).filter(pa.array((x != y).sum(axis=1) <= DISTANCE))

    one = classes.select(F.col("id").alias("a"), "n", "sig")
    two = classes.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b"))
    wide = pairs.join(two, "b").join(one, "a").where((100 * F.least("n", "n_b") >= SIMILARITY * F.greatest("n", "n_b")))
    return wide.select("a", "b", "sig", "sig_b").mapInArrow(run, out)


def full_sets(ids: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, set) of the ids (id): sorted hashes of all shingles. The texts are read again; a bitmap of fixed size drops most
    documents that are not asked for before they are cut into shingles, a join the rest."""
    flags = bit_filter(ids.select(F.xxhash64("id").alias("h")), "h", BITS)
    out = T.StructType([classes.schema["id"]]).add("set", T.ArrayType(T.LongType()))
    arrow = to_arrow_schema(out)

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(passes(flags, batch.column("h").to_numpy(), BITS)))
            for part, words in pieces(batch, "text", NOT_SPACE):
                doc, h = shingles(words)
                first = np.searchsorted(doc, np.arange(part.num_rows + 1))
                sets = [np.unique(h[a:b]) for a, b in zip(first[:-1], first[1:])]
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                values = pa.array(signed(np.concatenate(sets))) if sets else pa.array([], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(offsets, values)], schema=arrow)

    sets = docs.where("doc_id is not null").select("doc_id", "text", F.xxhash64("doc_id").alias("h")).mapInArrow(run, out)
    return hold(sets.join(ids, "id", "left_semi").join(classes.select("id", "n"), "id").where(F.size("set") == F.col("n")).drop("n"))


def confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= SIMILARITY * union, counted on the full sets of shingles."""
    ids = hold(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    sets = full_sets(ids, docs, classes)
    both = (pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
            .join(sets.select(F.col("id").alias("a"), "set"), "a"))
    common = F.size(F.array_intersect("set", "set_b"))
    return (both.withColumn("c", common)
            .where(100 * F.col("c") >= SIMILARITY * (F.size("set") + F.size("set_b") - F.col("c"))).select("a", "b").distinct())


def components(edges: DataFrame) -> DataFrame:
    """(id, label) of every id in edges (a, b): the smallest id that it reaches. Labels spread over edges and then
    jump to their label's label, so that long chains take few rounds; no neighbourhood is gathered."""
    edges = hold(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = hold(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("label")))
    while True:
        spread = (edges.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id"))
                  .agg(F.min("label").alias("near")))
        step = labels.join(spread, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = step.select(F.col("id").alias("label"), F.col("label").alias("far"))
        new = hold(step.join(jump, "label").select("id", "old", F.least("label", "far").alias("label")))
        changed = new.where("label != old").limit(1).count()
        labels = new.select("id", "label")
        if not changed:
            return labels


def _across(multi: DataFrame, labels: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between members of a bucket that stand in different components, found without listing pairs.

    Buckets of one leader are looked at together. Members outside the leader's component are dealt into blocks and all members
    into parts, by the size of what they hold; a block meets a part in one task, where a member of both stands once, which compares signatures, then full sets, nearest first, and
    returns one link at most for a member and a component. A pair that shares several buckets is looked at under the
    leader of the first of them only.
    """
    one = multi.select("leader", "id").union(multi.select("leader", F.col("leader").alias("id"))).distinct()
    rows = one.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    home = labels.select(F.col("id").alias("leader"), F.col("label").alias("home"))
    rows = rows.join(home, "leader", "left").withColumn("out", F.col("label") != F.coalesce("home", "leader")).drop("home")
    held = F.col("n") + 2 * SYMBOLS
    size = lambda n: F.ceil(F.sum(n) / BLOCK).cast("int")
    open_buckets = (rows.join(classes.select("id", "n"), "id").groupBy("leader")
                    .agg(size(F.when(F.col("out"), held).otherwise(0)).alias("blocks"), size(held).alias("parts")).where("blocks > 0"))
    rows = hold(rows.join(open_buckets, "leader"))
    sets = full_sets(hold(rows.select("id").distinct()), docs, classes)
    under = (multi.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.shiftrightunsigned("key", 48).cast("int").alias("k"), "leader"))).alias("u"))
             .select("id", F.col("u.k").alias("keys"), F.col("u.leader").alias("leaders")))
    known = sets.join(classes.select("id", "sig"), "id").join(under, "id")
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keep = ["leader", "block", "part", "asks", "told", "id", "label", "out"]
    asks = (rows.where("out").withColumn("block", dealt("blocks")).withColumn("part", each("parts"))
            .withColumn("asks", F.lit(True)).withColumn("told", F.col("part") == dealt("parts")).select(*keep))
    told = (rows.withColumn("part", dealt("parts")).withColumn("block", each("blocks")).where(~F.col("out") | (F.col("block") != dealt("blocks")))
            .withColumn("asks", F.lit(False)).withColumn("told", F.lit(True)).select(*keep))
    id_type = classes.schema["id"].dataType
    out = T.StructType().add("a", id_type).add("b", id_type)
    arrow = to_arrow_schema(out)

    def compare(table):
        column = lambda c: table.column(c).combine_chunks().to_numpy(zero_copy_only=False)
        ids, label, asks, told, out_of = (column(c) for c in ("id", "label", "asks", "told", "out"))
        leader = table.column("leader")[0].as_py()
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), dtype=np.uint16).reshape(-1, SYMBOLS)
        sets = table.column("set").combine_chunks()
        first, values = sets.offsets.to_numpy(), sets.values.to_numpy()
        n = np.diff(first)
        leaders = np.full((len(ids), SYMBOLS), -1, dtype=np.int64)
        here = np.zeros((len(ids), SYMBOLS), dtype=bool)
        keys, under = (table.column(c).combine_chunks() for c in ("keys", "leaders"))
        row = np.repeat(np.arange(len(ids)), np.diff(keys.offsets.to_numpy()))
        leaders[row, keys.flatten().to_numpy()], here[row, keys.flatten().to_numpy()] = under.flatten().to_numpy(), True
        others = np.flatnonzero(told)
        a, b = [], []
        for x in np.flatnonzero(asks):
            may = (label[others] != label[x]) & (100 * np.minimum(n[others], n[x]) >= SIMILARITY * np.maximum(n[others], n[x]))
            may &= ~out_of[others] | (ids[others] > ids[x])
            at = others[may]
            same = sig[at] == sig[x]
            apart = SYMBOLS - same.sum(axis=1)
            # the key of a chunk without one symbol is shared if the chunk's other symbols agree
            agree = same.reshape(-1, CHUNKS, PER_CHUNK)
            shared = (agree.sum(axis=2, keepdims=True) - agree >= PER_CHUNK - 1).reshape(-1, SYMBOLS) & here[x]
            right = shared.any(axis=1) & (apart <= DISTANCE)
            right &= leaders[x][shared.argmax(axis=1)] == leader
            order = np.flatnonzero(right)[np.argsort(apart[right], kind="stable")]
            linked = set()
            mine = values[first[x]:first[x + 1]]
            for y in at[order]:
                if label[y] in linked:
                    continue
                both = np.concatenate([mine, values[first[y]:first[y + 1]]])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= SIMILARITY * (len(both) - common):
                    linked.add(label[y])
                    a.append(min(ids[x], ids[y]))
                    b.append(max(ids[x], ids[y]))
        return pa.Table.from_arrays([pa.array(a, arrow.field("a").type), pa.array(b, arrow.field("b").type)], schema=arrow)

    return asks.union(told).join(known, "id").groupBy("leader", "block", "part").applyInArrow(compare, out).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Groups of documents whose sets of five-word shingles are alike to at least 75 percent, directly or by others.

    Output per row of `docs`: doc_id, n_shingles, component_id (smallest doc_id reachable), kept.

    Documents with the same set are one class, joined with nothing but its smallest id. Signatures of 64 symbols meet if
    a chunk of four agrees but for one; that finds every pair within DISTANCE. In a bucket, members are first checked
    against its smallest id; when that has settled most groups, members that are still in different
    components are compared with each other, block by block. All links are confirmed on the full sets. Pairs of
    a group are never listed.

    Null or empty texts, or texts without words, have no shingles, stay alone and are kept. Documents of fewer than
    five words have all their words as the one shingle. Repeated rows of an id share its result. Null ids take
    part in no group and are kept. An empty table gives no rows. Other columns are not read. Ids are integers.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    base = hold(profiles(source))
    known = base.where("n > 0 and doc_id is not null")
    least = known.groupBy("s1", "s2").agg(F.min("doc_id").alias("id"))
    classes = hold(known.withColumnRenamed("doc_id", "id").join(least, ["id", "s1", "s2"]).dropDuplicates(["id", "s1", "s2"]))
    keys = bucket_keys(classes)
    several = keys.groupBy("key").agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("m")).where("m > 1")
    multi = hold(keys.join(several.select("key", "leader"), "key"))
    stars = hold(_near(multi.where("id != leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct(), classes))
    links = hold(confirmed(stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), source, classes))
    labels = components(links)

    def open_pairs(pairs: DataFrame) -> DataFrame:
        one, two = (labels.select(F.col("id").alias(c), F.col("label").alias(f"{c}_label")) for c in "ab")
        wide = pairs.join(one, "a", "left").join(two, "b", "left")
        return wide.where(F.coalesce("a_label", "a") != F.coalesce("b_label", "b")).select("a", "b")

    pairs = hold(open_pairs(stars))
    if pairs.limit(1).count():
        links = hold(links.union(confirmed(pairs, source, classes)))
        labels = components(links)
    found = hold(_across(multi, labels, source, classes))
    if found.limit(1).count():
        labels = components(links.union(found))
    found = (classes.join(labels, "id", "left").select("s1", "s2", F.coalesce("label", "id").alias("label"))
             .groupBy("s1", "s2").agg(F.min("label").alias("label")))
    return (base.join(found, ["s1", "s2"], "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("label")).otherwise(F.col("doc_id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))
