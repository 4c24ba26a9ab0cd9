"""Leaf hash to leaf index: one row per leaf, addressed by the first four hex digits."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from merklake.constants import PREFIX_HEX, SUFFIX_BYTES
from merklake.functions import digests
from merklake.operators.joins import HOT_ROWS, lookup_join, match_join, small_join
from merklake.schemas import STORED_INDEX

KEYS = ["log_id", "prefix", "suffix"]
DIRECTORY_DIGITS = 1  # leading digits of the hash that name a directory, for logs of any size


def build(leaves: DataFrame) -> DataFrame:
    """Index rows (log_id, prefix, suffix, leaf_index) of leaves with valid digests."""
    digest = F.col("merkle_leaf_hash")
    return leaves.where(digests.is_digest(digest)).select(
        "log_id",
        digests.prefix(digest).alias("prefix"),
        digests.suffix(digest).alias("suffix"),
        "leaf_index",
    )


def write(index: DataFrame, location: str) -> None:
    """Store the index in one directory per log and leading digits, sorted by key.

    Logs stored there before stay. The rebalance splits a directory that many copies of one leaf make heavy, and merges light ones.
    """
    (
        index.withColumn("prefix_dir", F.substring("prefix", 1, DIRECTORY_DIGITS))
        .hint("rebalance", "log_id", "prefix_dir")
        .sortWithinPartitions("log_id", "prefix_dir", "prefix", "suffix")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("log_id", "prefix_dir")
        .parquet(location)
    )


def read(spark: SparkSession, location: str) -> DataFrame:
    """A stored index. The schema is given: digits in a directory name must stay text."""
    return spark.read.schema(STORED_INDEX).parquet(location)


def smallest(index: DataFrame) -> DataFrame:
    """One row per hash: equal leaves answer with their first index. Copies are combined before the shuffle."""
    return index.groupBy(*[c for c in [*KEYS, "prefix_dir"] if c in index.columns]).agg(
        F.min("leaf_index").alias("leaf_index")
    )


def split_key(requests: DataFrame, digest: Column) -> DataFrame:
    return requests.withColumn("prefix", digests.prefix(digest)).withColumn("suffix", digests.suffix(digest))


def _keyed(requests: DataFrame, index: DataFrame, digest: Column) -> tuple[DataFrame, list[str]]:
    """Requests with the index's key columns, and the names of these."""
    keyed = split_key(requests, digest)
    if "prefix_dir" not in index.columns:
        return keyed, list(KEYS)
    # The directory is part of the key, so the scan reads only directories asked for.
    return keyed.withColumn("prefix_dir", F.substring("prefix", 1, DIRECTORY_DIGITS)), [*KEYS, "prefix_dir"]


def matches(requests: DataFrame, index: DataFrame, digest: Column, hot_pairs: int = HOT_ROWS) -> DataFrame:
    """Requests, once for each leaf of the log that has the hash, with its `match_index`."""
    keyed, keys = _keyed(requests, index, digest)
    found = index.select(*keys, F.col("leaf_index").alias("match_index"))
    return match_join(keyed, found, keys, F.col("request_id"), F.col("match_index"), hot_pairs).drop("prefix", "suffix", "prefix_dir")


def lookup(requests: DataFrame, index: DataFrame, digest: Column, hot_rows: int = HOT_ROWS, copies: bool = False) -> DataFrame:
    """Add `found_index` to requests (request_id, log_id, …); null where the hash is not in the log. With `copies`, also
    `found_copies`, the number of leaves that have the hash."""
    keyed, keys = _keyed(requests, index, digest)

    def answers(wanted: DataFrame) -> DataFrame:
        if copies:
            return wanted.groupBy(*keys).agg(F.min("leaf_index").alias("found_index"), F.count("*").alias("found_copies"))
        return smallest(wanted).withColumnRenamed("leaf_index", "found_index")

    return lookup_join(keyed, index, keys, hot_rows=hot_rows, prepare=answers).drop("prefix", "suffix", "prefix_dir")


def prefixes(index: DataFrame) -> DataFrame:
    """Distinct (log_id, prefix), at most 65,536 per log."""
    return index.select("log_id", "prefix").distinct()


def prefix_exists(requests: DataFrame, index: DataFrame, digest: Column) -> DataFrame:
    """Add `prefix_found`: whether the log has any leaf under the prefix of the hash asked for."""
    keyed = requests.withColumn("prefix", digests.prefix(digest))
    joined = lookup_join(
        keyed, index, ["log_id", "prefix"], prepare=lambda wanted: prefixes(wanted).withColumn("_known", F.lit(True))
    )
    return joined.withColumn("prefix_found", F.coalesce(F.col("_known"), F.lit(False))).drop("_known")


def membership(requests: DataFrame, index: DataFrame, digest: Column) -> DataFrame:
    """Add `is_member`. The answer is exact: no hash is taken for present that is not."""
    return lookup(requests, index, digest).withColumn("is_member", F.col("found_index").isNotNull()).drop("found_index")


def stats(index: DataFrame) -> DataFrame:
    """Entries, index bytes and share of entries, per log and prefix."""
    per_prefix = index.groupBy("log_id", "prefix").agg(
        F.count("*").alias("entries"), F.sum(F.length("suffix") + 8).alias("entry_bytes")
    )
    totals = per_prefix.groupBy("log_id").agg(
        F.sum("entries").alias("log_entries"), F.count("*").alias("log_prefixes")
    )
    # At most 65,536 rows per log on one side and one on the other.
    return per_prefix.join(totals, "log_id").select(
        "log_id",
        "prefix",
        "entries",
        "entry_bytes",
        "log_prefixes",
        (F.col("entries") / F.col("log_entries")).alias("entry_share"),
    )


def integrity(index: DataFrame, logs: DataFrame) -> DataFrame:
    """Checks per prefix against the log (log_id, tree_size): key lengths, index range, index counted once."""
    per_leaf = index.groupBy("log_id", "prefix", "leaf_index").agg(
        F.count("*").alias("copies"),
        F.max(F.when(F.length("suffix") == SUFFIX_BYTES, 0).otherwise(1)).alias("bad_suffix"),
    )
    per_prefix = per_leaf.groupBy("log_id", "prefix").agg(
        F.sum("copies").alias("entries"),
        F.count("*").alias("distinct_indices"),
        F.min("leaf_index").alias("min_index"),
        F.max("leaf_index").alias("max_index"),
        F.max("bad_suffix").alias("bad_suffix"),
    )
    error = (
        F.when(F.col("tree_size").isNull(), F.lit("UNKNOWN_LOG"))
        .when(~F.col("prefix").rlike(f"^[0-9a-f]{{{PREFIX_HEX}}}$"), F.lit("BAD_PREFIX"))
        .when(F.col("bad_suffix") > 0, F.lit("BAD_SUFFIX_LENGTH"))
        .when(F.col("entries") != F.col("distinct_indices"), F.lit("INDEX_REPEATED"))
        .when((F.col("min_index") < 0) | (F.col("max_index") >= F.col("tree_size")), F.lit("INDEX_OUT_OF_RANGE"))
    )
    return small_join(per_prefix, logs.select("log_id", "tree_size"), ["log_id"]).select(
        "log_id", "prefix", "entries", "distinct_indices", "min_index", "max_index", error.alias("error_code")
    )


def total_entries(index: DataFrame, logs: DataFrame) -> DataFrame:
    """Per log: entries in the index against the size of the log."""
    counted = index.groupBy("log_id").agg(F.count("*").alias("entries"))
    return logs.select("log_id", "tree_size").join(counted, "log_id", "left").select(
        "log_id",
        "tree_size",
        F.coalesce("entries", F.lit(0)).alias("entries"),
        (F.coalesce("entries", F.lit(0)) == F.col("tree_size")).alias("ok"),
    )
