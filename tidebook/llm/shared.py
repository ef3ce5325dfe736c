"""Helpers of the text operators: byte-level words and hashes in numpy, held intermediates, folds, bounded filters."""
from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

U64 = np.uint64
#: Documents of a task are worked on in pieces of about this many bytes (one document at least).
CHUNK_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words are runs of bytes that are no white space. Every separator is ASCII, so UTF-8 text can be cut bytewise.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Words are runs of digits, ASCII letters and all characters beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_STEP = U64(0xD1342543DE82EF95)


class _Powers:
    """Powers of the base and of its inverse, as long as any piece of text has needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                steps = np.full(max(n, CHUNK_BYTES + 1), base, dtype=U64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=U64))
        return self.up, self.down


_POWERS = _Powers()


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit over the word."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


class Words:
    """The words of some documents: `doc` (index), `start` and `end` (bytes in `buf`), `hash` (64 bits)."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> None:
        self.buf, self.n_docs, self.base = LOWER[buf], len(offsets) - 1, offsets
        inside = kind[buf]
        before = np.empty_like(inside)
        before[:1], before[1:] = False, inside[:-1]
        starts_doc = offsets[:-1][offsets[:-1] < len(buf)]
        before[starts_doc] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[-1:], after[:-1] = False, inside[1:]
        after[starts_doc[starts_doc > 0] - 1] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        #: words of document d are first[d] to first[d + 1]
        self.first = np.searchsorted(self.doc, np.arange(self.n_docs + 1))
        up, down = _POWERS.upto(len(buf) + 1)
        self._sums = np.zeros(len(buf) + 1, dtype=U64)
        np.cumsum((self.buf.astype(U64) + U64(1)) * up[:len(buf)], out=self._sums[1:])
        self.hash = self.hashed(self.start, self.end)

    def hashed(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of spans of bytes; equal spans have equal hashes wherever they stand."""
        _, down = _POWERS.upto(len(self.buf) + 1)
        h = (self._sums[end] - self._sums[start]) * down[start]
        return mixed(h + (end - start).astype(U64) * _STEP)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of every run of k words inside a document."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=U64)
        h = self.hash[:n].copy()
        for j in range(1, k):
            h = h * _STEP + self.hash[j:j + n]
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1:k - 1 + n])
        return at, mixed(h[at] + U64(k))

    def whole(self, d: int) -> int:
        """Hash of all words of one document, as `grams` has it for a run of as many."""
        h = U64(0)
        with np.errstate(over="ignore"):
            for x in self.hash[self.first[d]:self.first[d + 1]]:
                h = h * _STEP + x if h else x
        return mixed(np.array([h], dtype=U64) + U64(self.first[d + 1] - self.first[d]))[0]


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null is empty."""
    col = pc.fill_null(col.cast(pa.large_string()), "")
    if not len(col):
        return np.empty(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = col.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[col.offset:col.offset + len(col) + 1]
    if data is None or offsets[-1] == offsets[0]:
        return np.empty(0, dtype=np.uint8), offsets - offsets[0]
    return np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, text: str, kind: np.ndarray) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Slices of a batch with their words, about CHUNK_BYTES of text at a time."""
    buf, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1)
        yield (batch.slice(at, to - at),
               Words(buf[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at], kind))
        at = to


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Rows per Arrow batch: documents are long, so fewer of them go to Python at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one on a single machine."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or (known.get() if known.isDefined() else None)
    if not folder:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    if known.isEmpty():
        sc.setCheckpointDir(folder)
    return folder


def hold(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder; lost executors lose nothing of it.

    Spark deletes shuffle files of frames that nobody refers to any more only after a garbage collection on the
    driver. That one is asked for here, so a loop of rounds takes the disk of one round.
    """
    shared_folder(df.sparkSession)
    held = df.checkpoint()
    df.sparkSession.sparkContext._jvm.System.gc()
    return held


def written(df: DataFrame) -> DataFrame:
    """The rows as compressed files in the shared folder, for tables of whole texts that are read several times."""
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; null ids count as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def labelled(docs: DataFrame, labels: DataFrame, label: str, parts: int, kept_out: int) -> DataFrame:
    """(doc_id, text, y) of all labelled training documents, written to the shared folder, since training reads them several times.

    Ids of the fold `kept_out` of `parts` never enter, nor do ids whose label rows disagree. Texts and labels meet by a
    shuffle, so neither has to fit into a task.
    """
    known = (labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
             .where(fold(F.col("doc_id"), parts) != kept_out)
             .groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("_y")).where("y = _y").select("doc_id", "y"))
    texts = (docs.where(fold(F.col("doc_id"), parts) != kept_out)
             .select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    return written(texts.join(known.hint("merge"), "doc_id"))


def bit_filter(hashes: DataFrame, col: str, bits: int = 20) -> np.ndarray:
    """One flag for each value of the top `bits` of a 64-bit column: at most 2**bits numbers reach the driver.

    It lets tasks drop rows that no join partner can meet. However many hashes there are, it stays this
    size; it then lets more rows through to the join, which decides.
    """
    flags = np.zeros(1 << bits, dtype=bool)
    top = hashes.select(F.shiftrightunsigned(F.col(col), 64 - bits).cast("int").alias("b")).distinct()
    found = top.toArrow().column("b").to_numpy()
    flags[found] = True
    return np.packbits(flags)


def passes(flags: np.ndarray, hashes: np.ndarray, bits: int = 20) -> np.ndarray:
    top = (hashes.view(U64) >> U64(64 - bits)).astype(np.int64)
    return (flags[top >> 3] >> (7 - (top & 7)).astype(np.uint8)) & 1 == 1


def _newton(sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], width: int, total: float, l2: float, rounds: int) -> np.ndarray:
    """Weights of a logistic regression by Newton steps, from the gradient and the hessian of the rows at given weights."""
    w = np.zeros(width)
    ridge = np.full(width, l2 * max(1.0, total))
    ridge[-1] = 1e-6
    for _ in range(rounds):
        gradient, hessian = sums(w)
        step = np.linalg.solve(hessian + np.diag(ridge + 1e-9), gradient + ridge * w)
        w = w - step / max(1.0, np.abs(step).max() / 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _slopes(x: np.ndarray, y: np.ndarray, w: np.ndarray, weights: np.ndarray | float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return x.T @ (weights * (p - y)), (x * (weights * p * (1 - p))[:, None]).T @ x


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, weights: np.ndarray | None = None,
             rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression by Newton steps; the last one is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    sample = np.ones(len(x)) if weights is None else weights
    return _newton(lambda w: _slopes(x, y, w, sample), x.shape[1], sample.sum(), l2, rounds)


def logistic_rows(rows: DataFrame, columns: Callable[[np.ndarray], np.ndarray], l2: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """The same over the rows of a held table (y, numbers...), of any number: each step is a pass in which a task sends
    the sums of its rows. `columns` makes what the weights belong to out of the numbers."""
    out = T.StructType().add("s", T.ArrayType(T.DoubleType()))
    arrow = to_arrow_schema(out)
    width = columns(np.zeros((1, len(rows.columns) - 1))).shape[1] + 1

    def sums(w):
        def run(batches):
            gradient, hessian = np.zeros(width), np.zeros((width, width))
            for batch in batches:
                y, *x = (c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns)
                g, h = _slopes(np.column_stack([columns(np.column_stack(x)), np.ones(len(y))]), y, w)
                gradient, hessian = gradient + g, hessian + h
            yield pa.RecordBatch.from_pydict({"s": [[*gradient, *hessian.ravel()]]}, schema=arrow)

        found = np.sum([r["s"] for r in rows.mapInArrow(run, out).collect()], axis=0)
        return found[:width], found[width:].reshape(width, width)

    return _newton(sums, width, rows.count(), l2, rounds)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))
