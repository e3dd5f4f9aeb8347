"""From documents to packed sequences: toxicity, near copies, personal data, mixing, packing.

Every stage works on all rows that its predecessor kept, written as Parquet in
between.  All but the last return the columns of ``documents``.

Python workers take rows in batches of ``BATCH`` bytes.  What a stage returns
runs later, so this is a setting of the session, which stays; a session that has
one of its own keeps it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reconcord.llm.common import Stage
from reconcord.llm.op1_entropy_mixing import mixed_documents
from reconcord.llm.op2_pii import redact
from reconcord.llm.op3_packing import best_fit_pack
from reconcord.llm.op4_toxicity_mil import drop_toxic
from reconcord.llm.op6_ngram_jaccard import drop_near_copies

#: A batch of 10000 rows, Spark's usual bound, is 30 MB of texts, of which a worker holds several copies and the JVM two.
BATCH = 4 << 20
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(spark: SparkSession) -> None:
    if spark.conf.get(_BYTES, None) is None:
        spark.conf.set(_BYTES, str(BATCH))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose noisy-or score is under one half."""
    bounded(spark)
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near copies."""
    bounded(spark)
    return drop_near_copies(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with personal data replaced by its kind; n_chars follows the text."""
    bounded(spark)
    out = redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    bounded(spark)
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in the sequences."""
    bounded(spark)
    return best_fit_pack(docs)


STAGES = [("toxicity", toxicity), ("ngram_jaccard", near_copies), ("pii", personal_data), ("entropy_mixing", mixing), ("packing", packing)]

#: SQL cannot express the trained stages; tests hold the run against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = Stage(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES[:-1]:
        docs = stage.keep(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
