"""Logs that still grow: leaves as a stream, and how far each log is whole.

A micro-batch is summed to four bit masks a bundle and written under its own number, so a batch that runs again, after a loss or a
stop, replaces its rows. The stream itself keeps no state: masks of all batches are merged when progress is asked for, and a
leaf that arrives twice sets the same bit.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from merklake.constants import TILE_WIDTH
from merklake.functions.paths import leaf_index
from merklake.operators import checks

MASKS = [f"m{k}" for k in range(TILE_WIDTH // 64)]
ARRIVED = "log_id bigint, bundle_index bigint, rows bigint, max_index bigint, " + ", ".join(f"{m} bigint" for m in MASKS)


def watch(arrivals: DataFrame, location: str, checkpoint: str) -> None:
    """Record all leaves (log_id, leaf_index) of a stream that have come since the last call, and end.

    `checkpoint` holds the stream's place in its source. Rows without a log, or without an index of 0 or more, count nowhere.
    """
    arrivals.sparkSession.createDataFrame([], ARRIVED).write.mode("overwrite").parquet(f"{location}/batch=-1")

    def record(batch: DataFrame, number: int) -> None:
        counts = checks.bundle_counts(batch.where("log_id is not null and leaf_index >= 0"))
        counts.drop("distinct_rows").write.mode("overwrite").parquet(f"{location}/batch={number}")

    stream = arrivals.select("log_id", "leaf_index").writeStream.foreachBatch(record)
    stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _absent(slot: Column) -> Column:
    mask = F.element_at(F.array(*MASKS), F.shiftright(slot, 6) + 1)
    return F.call_function("shiftright", mask, slot % 64).bitwiseAND(F.lit(1)) == 0


def progress(spark: SparkSession, location: str, expected: DataFrame) -> DataFrame:
    """Of each log in `expected` (log_id, tree_size): leaves arrived, repeated rows, `dense_size`, and whether that reaches tree_size.

    dense_size is the longest prefix without a gap. It ends in the first bundle that lacks a leaf, or where a whole bundle is followed by
    none; bundles are joined with their neighbours, one row to one row, so a long log is never put in order in one task.
    """
    stored = spark.read.schema(ARRIVED).parquet(location)
    merged = stored.groupBy("log_id", "bundle_index").agg(F.sum("rows").alias("rows"), *[F.bit_or(m).alias(m) for m in MASKS])
    held = sum((F.bit_count(m).cast("bigint") for m in MASKS), F.lit(0).cast("bigint"))
    merged = merged.withColumn("held", held)

    full = F.col("held") == TILE_WIDTH
    inside = merged.where(~full).select(
        "log_id", leaf_index(F.col("bundle_index"), F.element_at(F.filter(F.sequence(F.lit(0), F.lit(TILE_WIDTH - 1)), _absent), 1)).alias("end")
    )
    followed = merged.where(full).select("log_id", (F.col("bundle_index") + 1).alias("bundle_index"))
    followed = followed.unionByName(expected.select("log_id", F.lit(0).cast("bigint").alias("bundle_index")))
    between = followed.join(merged.select("log_id", "bundle_index"), ["log_id", "bundle_index"], "left_anti")
    ends = inside.unionByName(between.select("log_id", leaf_index(F.col("bundle_index"), F.lit(0)).alias("end")))

    counted = merged.groupBy("log_id").agg(F.sum("held").alias("arrived"), F.sum("rows").alias("came"))
    dense = ends.groupBy("log_id").agg(F.min("end").alias("dense_size"))
    zero = F.lit(0).cast("bigint")
    return expected.select("log_id", "tree_size").join(counted, "log_id", "left").join(dense, "log_id", "left").select(
        "log_id",
        "tree_size",
        F.coalesce("arrived", zero).alias("arrived"),
        F.coalesce(F.col("came") - F.col("arrived"), zero).alias("repeated"),
        F.coalesce("dense_size", zero).alias("dense_size"),
        F.coalesce(F.col("dense_size") >= F.col("tree_size"), F.lit(False)).alias("complete"),
    )
