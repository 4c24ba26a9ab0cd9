"""Cleaning of a document corpus in stages; each stage's rows are written as Parquet and read again by the next."""

from merklake.llm import bpe, decontaminate, jaccard, secrets, toxicity
from merklake.llm.queries import VOCABULARY
from merklake.sources.scratch import materialize
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Nearest examples and exact merging have no SQL form; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the labelled examples nearest to them do not mark as toxic."""
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles of similarity 0.8 or more."""
    return jaccard.keep_one(docs, jaccard.Rule(words=5, percent=80))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no ten-word window with a benchmark item."""
    return decontaminate.remove_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in them replaced; n_chars is that of the new text."""
    return secrets.redact(docs).withColumn("n_chars", F.char_length("text").cast("bigint"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, token ids and their number."""
    ids = bpe.encode(docs, VOCABULARY, ["doc_id", "lang", "source"])
    return ids.withColumn("n_tokens", F.size("ids").cast("bigint"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("secrets", redact_secrets),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
