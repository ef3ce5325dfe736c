"""Session settings the operators rely on."""
from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "tidebook", master: str | None = None, **conf: str) -> SparkSession:
    """UTC session with adaptive execution; cluster settings given by the launcher are kept."""
    builder = (SparkSession.builder.appName(app)
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
               .config("spark.sql.sources.partitionOverwriteMode", "dynamic"))
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def pin_utc(spark: SparkSession) -> SparkSession:
    """Every timestamp rule of the library is stated in UTC, so the session must be too."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def reuse(df: DataFrame) -> DataFrame:
    """Hold an intermediate that a plan reads several times.

    It goes to the shared checkpoint folder when the cluster names one, which also ends its lineage. Otherwise
    it is persisted; blocks lost with an executor are computed again from the input.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder and spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        return df.checkpoint()
    return df.persist(StorageLevel.MEMORY_AND_DISK)
