"""A corpus from documents to packed sequences. Each stage reads what the stage before it wrote."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidebook.llm import decontam, neardup, packing, pii, toxicity
from tidebook.llm.queries import table, vocabulary
from tidebook.llm.shared import shared_folder

#: No SQL: the first stage is a trained decoder and classifier, the last one tokenizes.
ORACLE_SQL = None


def detoxified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text does not score as toxic."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.withColumnRenamed("score", "_score") if "score" in docs.columns else docs, model)
    return scored.where(F.col("score") < toxicity.THRESHOLD).select(*docs.columns)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id; rows that repeat its id leave one."""
    kept = neardup.near_duplicates(docs).where("kept").select("doc_id").distinct()
    unnamed = docs.where("doc_id is null")
    return docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns).unionByName(unnamed)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without much text of the benchmark."""
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by their kinds; n_chars follows the text."""
    _, model = pii.find(docs)
    out = pii.redacted(docs, model)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences."""
    return packing.pack(docs, *vocabulary())


STAGES = [("toxicity", detoxified), ("near_duplicates", deduplicated), ("decontamination", decontaminated), ("personal_data", redacted),
          ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage returns is written to the shared folder and read by the next."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
