"""A training corpus in five stages, each one operator of ``cadenza.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet to the shared folder and read back as the next one's
documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import langid, packing, secret_scan, similar, simhash, toxicity
from cadenza.llm.common import keeping_columns, materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.clean_documents(docs, model)


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be identified go."""
    return langid.identified_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8, by SimHash index and exact check) stays."""
    return simhash.representatives(docs, similar.near_duplicates)


@keeping_columns("doc_id", "text", "lang", "source", "n_chars")
def _redacted(docs: DataFrame) -> DataFrame:
    names = docs.columns
    redacted = secret_scan.redact(docs.withColumn("_chars", F.length("text")))
    n_chars = F.when(F.col("n_chars") == F.col("_chars"), F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return redacted.withColumn("n_chars", n_chars).select(*names)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking secrets are replaced; n_chars follows the text where it did before."""
    return _redacted(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left becomes token sequences of at most 2048."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_identified),
    ("simhash_neardup", drop_near_duplicates),
    ("secret_scans", redact_secrets),
    ("best_fit_packing", pack_sequences),
]

#: Classifiers and tokenizers have no SQL form. The tests hold the near-duplicate stage against brute force over all
#: pairs, and the other stages against what their operators say of each document, which have tests of their own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents: the rows of the last one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
