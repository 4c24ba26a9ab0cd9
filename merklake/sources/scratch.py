"""Intermediate tables, written once and read back.

A written table cuts the lineage, survives lost executors, and lets later scans prune columns
and rows. It lives in the folder the session names in `spark.checkpoint.dir`, or else in the warehouse.
"""

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def new_location(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries run inside go when these end; the written table stands for them."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def materialize(df: DataFrame, name: str, sort_by: list[str] | None = None) -> DataFrame:
    """Write `df` and return a reader of the written table."""
    spark = df.sparkSession
    location = new_location(spark, name)
    out = df.sortWithinPartitions(*sort_by) if sort_by else df
    with _shuffles_removed(spark):
        out.write.parquet(location)
    return spark.read.schema(df.schema).parquet(location)
