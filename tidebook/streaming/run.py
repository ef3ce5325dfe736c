"""Run a stream over the files present and read the result back."""
from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F


#: Memory of all state stores of an executor, beside the heap.
STORE_MB = 128


def work_folder(spark: SparkSession) -> str:
    """A fresh folder under the shared checkpoint folder of the cluster. On one machine a temporary one will do; on a cluster
    executors could not read each other's part of it, so a folder must be set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB: on local disk with a log of changes in the checkpoint folder, so
    neither the heap nor a batch's writes grow with the state. All stores of an executor share one bounded memory, and
    those of streams that have ended are closed soon; nothing is allocated ahead, for there may be many small stores. The session's own settings are put back."""
    prefix = "spark.sql.streaming.stateStore."
    own = {prefix + "providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
           prefix + "rocksdb.changelogCheckpointing.enabled": "true", prefix + "rocksdb.boundedMemoryUsage": "true",
           prefix + "rocksdb.maxMemoryUsageMB": str(STORE_MB), prefix + "rocksdb.writeBufferSizeMB": "4", prefix + "maintenanceInterval": "10s",
           prefix + "rocksdb.allowFAllocate": "false"}
    before = {k: spark.conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def run_available(stream: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Process what is there and return every emitted row with its batch number.

    Batches are written under their own number, so a batch repeated after a failure replaces itself.
    """
    spark, schema = stream.sparkSession, stream.schema
    folder = folder or work_folder(spark)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
    with state_store(spark):
        q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return spark.read.schema(schema.add("batch", "integer")).parquet(f"{folder}/out")


def run_parts(parts: Sequence[DataFrame], job: Callable[[DataFrame], DataFrame], mode: str = "append", folder: str | None = None) -> DataFrame:
    """A table that arrives in parts, one after another: each is added to the files of the source, and the stream goes on from its
    state with what is new. Every part is at least one micro-batch of its own."""
    spark = parts[0].sparkSession
    folder = folder or work_folder(spark)
    for part in parts:
        part.write.mode("append").parquet(f"{folder}/source")
        out = run_available(job(spark.readStream.schema(part.schema).parquet(f"{folder}/source")), mode, folder)
    return out


def newest_update(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The last update of every key, for streams in update mode."""
    cols = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*cols), "batch").alias("_r")).select(*keys, "_r.*")
