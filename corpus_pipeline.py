"""A training corpus from documents, in five stages; counted as part of the ``llm`` subpackage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's documents. All but the last return the columns of documents.

1. quality: documents that the quality scorer rejects go; null and wordless texts are rejected.
2. dedup: of each group of near-duplicates (five-word shingles, similarity 0.8 or more) the smallest id stays.
3. decontamination: documents of which at least one word in twenty lies in a benchmark window go.
4. pii: spans of personal data are replaced in the texts; n_chars follows.
5. mixing: the training mixture, a row for each use of a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrain.llm import decontam, mixing, pii, quality, simhash
from docgrain.llm.shared import materialise


#: Rows that go to a Python worker at once: texts are long, and batches are held on both sides.
BATCH_ROWS = 1000


def _small_batches(spark: SparkSession) -> None:
    """Have the stage's workers get their rows in small batches; it changes no result."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score well."""
    _small_batches(spark)
    return quality.keep_good(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    _small_batches(spark)
    return simhash.keep_one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate."""
    _small_batches(spark)
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced."""
    _small_batches(spark)
    clean = pii.redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return clean.select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of all documents that are left."""
    _small_batches(spark)
    return mixing.mix(docs)


STAGES = [
    ("quality", quality_stage),
    ("dedup", dedup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
]

#: The scorer, the trees and the wide fingerprints are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
