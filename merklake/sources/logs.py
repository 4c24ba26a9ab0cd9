"""Logs as leaf tables. A leaf: log id, dense index, opaque value, two nanosecond times."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from merklake.functions.hashing import leaf_hash
from merklake.schemas import LEAVES

EVENTS_LOG, DOCUMENTS_LOG = 1, 2

# Columns of the given tables that are read, so that no file is opened to infer them.
TABLES = {
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, n_chars BIGINT",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "conversations": "conv_id BIGINT, turn BIGINT, text STRING",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def read_leaves(spark: SparkSession, path: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """Stored leaves, optionally the range [start, end) only; the bounds reach the Parquet scan."""
    leaves = spark.read.schema(LEAVES).parquet(path)
    if start is not None:
        leaves = leaves.where(F.col("leaf_index") >= start)
    if end is not None:
        leaves = leaves.where(F.col("leaf_index") < end)
    return leaves


def with_leaf_hash(leaves: DataFrame) -> DataFrame:
    return leaves.withColumn("merkle_leaf_hash", leaf_hash(F.col("leaf_value")))


def _unix_micros(ts: Column) -> Column:
    """Microseconds since the epoch of a time without zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01'"), ts)


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as log 1. Event times are microseconds; the last three digits are made up."""
    events = read_table(spark, sf_dir, "events")
    queue = _unix_micros(F.col("ts")) * 1000 + F.col("event_id") % 1000
    text = F.concat_ws("|", F.col("event_id").cast("string"), F.col("user_id").cast("string"), "event_type", "props")
    return events.select(
        F.lit(EVENTS_LOG).cast("bigint").alias("log_id"),
        F.col("event_id").alias("leaf_index"),
        text.cast("binary").alias("leaf_value"),
        queue.alias("queue_ts_nanos"),
        (queue + (F.col("event_id") % 7 - 1) * 1000003).alias("integrate_ts_nanos"),
    )


def documents_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as log 2. It has equal leaves."""
    documents = read_table(spark, sf_dir, "documents")
    queue = F.lit(1704067200000000000) + F.col("doc_id") * 1000000007
    return documents.select(
        F.lit(DOCUMENTS_LOG).cast("bigint").alias("log_id"),
        F.col("doc_id").alias("leaf_index"),
        F.col("text").cast("binary").alias("leaf_value"),
        queue.alias("queue_ts_nanos"),
        (queue + F.col("n_chars")).alias("integrate_ts_nanos"),
    )


def both_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_log(spark, sf_dir).unionByName(documents_log(spark, sf_dir))
