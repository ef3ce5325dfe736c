"""Text quality from how well dictionaries of good and bad text compress a document."""
from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidebook.llm.shared import hold, labelled, logistic_rows, sigmoid, small_batches, text_bytes

FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
BLOCK = 2048                # bytes that are compressed at a time, so that a dictionary tells in all of a long text
GROUP_BYTES = 4 << 20       # text that is made into one dictionary at a time, about; the dictionaries of groups are made into one
DICTIONARY, LEVEL = 64 << 10, 3


def _blocks(text: bytes) -> list[bytes]:
    return [text[i:i + BLOCK] for i in range(0, len(text), BLOCK)]


def dictionary(samples: list[bytes]) -> bytes:
    """A dictionary from blocks of text; of the text as it is where there is too little to train one."""
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICTIONARY:] or b"\n" * 8


class Compressors:
    """Sizes of a text by itself, with the dictionary of good and with that of bad text."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        options = {"level": LEVEL, "write_checksum": False, "write_content_size": False, "write_dict_id": False}
        self._all = [zstandard.ZstdCompressor(**options)]
        for d in (good, bad):
            known = zstandard.ZstdCompressionDict(d)
            known.precompute_compress(level=LEVEL)
            self._all.append(zstandard.ZstdCompressor(dict_data=known, **options))

    def features(self, text: bytes) -> tuple[float, float, float]:
        """The difference of the dictionaries' sizes and the plain size, both by the text's size, and its logarithm."""
        if not text:
            return 0.0, 1.0, 0.0
        blocks = _blocks(text)
        alone, good, bad = (sum(len(c.compress(b)) for b in blocks) for c in self._all)
        return (bad - good) / max(good, bad), alone / len(text), float(np.log(len(text)))


def _columns(x: np.ndarray) -> np.ndarray:
    """What the curve is fitted on: the difference, the compressed share for long and for short texts."""
    diff, share, size = x.T
    short = np.exp(-np.exp(size) / 400)
    return np.column_stack([diff, diff * np.abs(diff), np.minimum(share, 1.2), np.minimum(share, 1.2) ** 2, short, diff * short, share * short])


class Model:
    def __init__(self, good: bytes, bad: bytes, curve: np.ndarray) -> None:
        self.good, self.bad, self.curve = good, bad, curve

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(_columns(x) @ self.curve[:-1] + self.curve[-1])


def measured(texts: DataFrame, good: bytes, bad: bytes, keep: list[str]) -> DataFrame:
    """Columns `keep` of (text, ...) with the three features of the whole text."""
    out = T.StructType([texts.schema[c] for c in keep])
    for c in ("_diff", "_share", "_size"):
        out = out.add(c, "double")
    arrow = to_arrow_schema(out)

    def run(batches):
        sizes = Compressors(good, bad)
        for batch in batches:
            buf, offsets = text_bytes(batch.column(batch.schema.get_field_index("text")))
            x = np.array([sizes.features(buf[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), *map(pa.array, x.T)], schema=arrow)

    return texts.select(*keep, "text").mapInArrow(run, out)


def dictionaries(blocks: DataFrame) -> dict[int, bytes]:
    """The dictionary of each class from all blocks (y, doc_id, at, block) of its text.

    Blocks are dealt into groups of about GROUP_BYTES, each of which is made into a dictionary by itself; the dictionaries,
    cut into blocks, are the text of the next turn, until one is left of each class.
    """
    out = T.StructType().add("y", "integer").add("block", "binary")

    def one(table):
        y, block = table.column("y")[0].as_py(), table.column("block").to_pylist()
        block.sort(key=lambda b: (zlib.crc32(b), b))
        return pa.table({"y": pa.array([y], pa.int32()), "block": pa.array([dictionary(block)], pa.binary())})

    rows = blocks.select("y", F.xxhash64("doc_id", "at").alias("place"), "block")
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.sum(F.length("block")).alias("n")).collect()}
    while True:
        groups = F.lit(1)
        for y, n in sizes.items():
            groups = F.when(F.col("y") == y, F.lit(max(1, -(-(n or 0) // GROUP_BYTES)))).otherwise(groups)
        made = rows.withColumn("_group", F.pmod(F.col("place"), groups)).groupBy("y", "_group").applyInArrow(one, out)
        if all((n or 0) <= GROUP_BYTES for n in sizes.values()):
            return {r["y"]: bytes(r["block"]) for r in made.collect()}
        made = hold(made)
        sizes = {r["y"]: r["n"] for r in made.groupBy("y").agg(F.sum(F.length("block")).alias("n")).collect()}
        cut = F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.length("block") - 1) / BLOCK)), lambda i: F.substring("block", (i * BLOCK + 1).cast("int"), F.lit(BLOCK))))
        rows = made.select("y", cut.alias("block")).select("y", F.xxhash64("block").alias("place"), "block")


def train(docs: DataFrame, labels: DataFrame, parts: int = FOLDS, kept_out: int = HELD_OUT) -> Model:
    """Builds the dictionaries from half of the labelled documents and fits the curve on the other half.

    Documents of the fold `kept_out` never enter; all others that have a label do, with their whole texts.
    """
    small_batches(docs.sparkSession)
    sample = labelled(docs, labels, "quality", parts, kept_out)
    sample = sample.withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(2)))
    out = T.StructType().add("y", "integer").add("doc_id", sample.schema["doc_id"].dataType).add("at", "long").add("block", "binary")
    arrow = to_arrow_schema(out)

    def cut(batches):
        for batch in batches:
            for part in (batch.slice(i, 100) for i in range(0, batch.num_rows, 100)):
                buf, offsets = text_bytes(part.column(part.schema.get_field_index("text")))
                rows = [(int(y), i, at, b) for y, i, a, z in zip(part.column("y").to_pylist(), part.column("doc_id").to_pylist(), offsets[:-1], offsets[1:])
                        for at, b in enumerate(_blocks(buf[a:z].tobytes()))]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 4, arrow)], schema=arrow)

    made = dictionaries(sample.where("part = 0").select("text", "y", "doc_id").mapInArrow(cut, out))
    made = {y: made.get(y) or dictionary([]) for y in (1, 0)}
    rest = hold(measured(sample.where("part = 1").select("text", F.col("y").cast("int").alias("y")), made[1], made[0], ["y"]))
    if rest.select("y").distinct().count() < 2:  # nothing to tell apart: the share of the labels, which no held-out one enters
        totals = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
        curve = np.zeros(8)
        curve[-1] = np.log((totals.get(1, 0) + 0.5) / (totals.get(0, 0) + 0.5))
        return Model(made[1], made[0], curve)
    return Model(made[1], made[0], logistic_rows(rest, _columns, 1e-5))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All rows and columns of `docs` with score (0 to 1, higher is better text).

    The whole text is compressed block by block with either dictionary; the difference of the sizes by the larger
    one, and the share that compression leaves without a dictionary, go through the fitted curve. Null is an
    empty text; its features are those of a text that compression does not shorten.
    """
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() not in ("score", "_diff", "_share", "_size")]
    own = {c: f"_c{i}" for i, c in enumerate(kept)}
    source = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    out = T.StructType([T.StructField(n, docs.schema[c].dataType) for c, n in own.items()]).add("score", "double")
    arrow = to_arrow_schema(out)

    def run(batches):
        sizes = Compressors(model.good, model.bad)
        for batch in batches:
            buf, offsets = text_bytes(batch.column(batch.num_columns - 1))
            x = np.array([sizes.features(buf[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(model.scores(x))], schema=arrow)

    return source.mapInArrow(run, out).select(*[F.col(n).alias(c) for c, n in own.items()], "score")
