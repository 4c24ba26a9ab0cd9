"""Request batches, faulty copies and other inputs, all derived from whole tables."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from merklake.functions.hashing import leaf_hash
from merklake.sources import logs


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a source of requests: log 3 is unknown, and log 2 is a twelfth as long as the others."""
    log_id = 1 + F.col("o_custkey") % 3
    base = F.when(log_id == 2, F.call_function("div", F.col("o_orderkey"), F.lit(12))).otherwise(F.col("o_orderkey"))
    return logs.read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("request_id"), log_id.alias("log_id"), base.alias("base"), F.col("o_custkey").alias("c")
    )


def by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).select(
        "request_id",
        "log_id",
        (F.col("base") - 40).alias("leaf_index"),
        (F.col("base") - 60 + F.col("c") % 7 * 20).alias("tree_size"),
    )


def consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).select(
        "request_id",
        "log_id",
        (F.col("base") - 30).alias("first_tree_size"),
        (F.col("base") - 60 + F.col("c") % 5 * (F.col("base") % 97 + 30)).alias("second_tree_size"),
    )


def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.when(F.col("c") % 4 == 0, F.lit(0)).otherwise(F.col("base") - 20)
    return _orders(spark, sf_dir).select("request_id", "log_id", first.alias("first_tree_size"))


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mostly short ranges, and every 5,000th reaches past any log."""
    count = F.when(F.col("request_id") % 5000 == 77, F.lit(10_000_000)).otherwise((F.col("c") % 9 - 1) * 5)
    return _orders(spark, sf_dir).select(
        "request_id", "log_id", (F.col("base") - 40).alias("start_index"), count.alias("count")
    )


def by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of all leaves, of pages (in no log) and digests of the wrong length."""
    leaves = logs.both_logs(spark, sf_dir)
    index = F.col("leaf_index")
    known = leaves.select(
        (index * 4 + F.col("log_id") - 1).alias("request_id"),
        "log_id",
        leaf_hash(F.col("leaf_value")).alias("leaf_hash"),
        F.when(F.col("log_id") == 1, index + 1 + (index % 5 - 2) * 3).otherwise(index + 50).alias("tree_size"),
    )
    pages = logs.read_table(spark, sf_dir, "pages").select(
        (F.col("page_id") * 4 + 2).alias("request_id"),
        (F.col("page_id") % 3 + 1).alias("log_id"),
        leaf_hash(F.col("html").cast("binary")).alias("leaf_hash"),
        F.col("page_id").alias("tree_size"),
    )
    short = logs.read_table(spark, sf_dir, "conversations").select(
        ((F.col("conv_id") * 1000 + F.col("turn")) * 4 + 3).alias("request_id"),
        F.lit(1).cast("bigint").alias("log_id"),
        F.unhex(F.md5("text")).alias("leaf_hash"),
        F.lit(10).cast("bigint").alias("tree_size"),
    )
    return known.unionByName(pages).unionByName(short)


def faulty_copy(leaves: DataFrame) -> DataFrame:
    """A copy with planted faults: leaves dropped or doubled, values and times changed or missing."""
    index = F.col("leaf_index")

    def at(remainder: int) -> Column:
        return index % 101 == remainder

    copy = leaves.where(~at(7)).select(
        "log_id",
        "leaf_index",
        F.when(at(11), F.concat("leaf_value", F.lit(bytearray(b"!")))).otherwise(F.col("leaf_value")).alias("leaf_value"),
        F.when(at(13), F.col("queue_ts_nanos") + 1).when(~at(17), F.col("queue_ts_nanos")).alias("queue_ts_nanos"),
        F.when(at(19), F.col("integrate_ts_nanos") - 1).otherwise(F.col("integrate_ts_nanos")).alias("integrate_ts_nanos"),
    )
    return copy.unionByName(copy.where(at(23)))


def value_faults(leaves: DataFrame) -> DataFrame:
    """A copy of the same size with one value in 1,009 changed."""
    changed = F.col("leaf_index") % 1009 == 5
    return leaves.withColumn(
        "leaf_value", F.when(changed, F.concat("leaf_value", F.lit(bytearray(b"!")))).otherwise(F.col("leaf_value"))
    )


def changed_copy(leaves: DataFrame) -> DataFrame:
    """A copy that is a whole log too: values and times changed here and there, and shorter by three leaves."""
    index = F.col("leaf_index")
    last = leaves.groupBy("log_id").agg((F.max("leaf_index") - 3).alias("_last"))
    changed = value_faults(leaves).withColumns(
        {
            "queue_ts_nanos": F.when(index % 1013 == 7, F.col("queue_ts_nanos") + 1).otherwise(F.col("queue_ts_nanos")),
            "integrate_ts_nanos": F.when(index % 1019 == 3, F.col("integrate_ts_nanos") - 1).otherwise(F.col("integrate_ts_nanos")),
        }
    )
    return changed.join(F.broadcast(last), "log_id").where(index <= F.col("_last")).drop("_last")  # a row per log, of which there are two


def _doubled_entries(index: DataFrame) -> DataFrame:
    return index.unionByName(index.where("leaf_index % 97 = 5"))


def _changed_tiles(tiles: DataFrame) -> DataFrame:
    """Some hashes of the lowest level changed, and a level too many."""
    changed = (F.col("tile_level") == 0) & (F.col("tile_index") % 3 == 2)
    more = tiles.where("tile_level = 0 and tile_index = 0").withColumn("tile_level", F.lit(7))
    return tiles.withColumn("hashes", F.when(changed, F.reverse(F.hex("hashes")).cast("binary")).otherwise(F.col("hashes"))).unionByName(more)


# Faults for the tables of a store, as they are stored.
STORE_FAULTS = {
    "bundles": lambda bundles: bundles.where("bundle_index % 5 != 1"),
    "tiles": _changed_tiles,
    "paths": lambda paths: paths.where("log_id != 1"),
    "hash_index": _doubled_entries,
    "frontier": lambda frontier: frontier,
}
