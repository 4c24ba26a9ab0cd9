"""Entry bundles: up to 256 leaf values in one object, with their timestamps as metadata."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merklake.constants import ENTRIES_DIR, MAX_ENTRY_BYTES, TILE_HEIGHT, TILE_WIDTH
from merklake.functions import timestamps
from merklake.functions.binding import let
from merklake.functions.hashing import leaf_hash
from merklake.functions.paths import bundle_of, leaf_index, parse_entries_path, part_of, slot_of


def _joined(parts: Column) -> Column:
    """All parts as one value, by pairwise rounds: each byte is copied once per round, not once per part."""

    def merge_pairs(acc: Column, _: Column) -> Column:
        pairs = F.sequence(F.lit(0), F.call_function("div", F.size(acc) - 1, F.lit(2)).cast("int"))
        return F.transform(
            pairs,
            lambda i: F.concat(
                F.element_at(acc, i * 2 + 1),
                F.coalesce(F.try_element_at(acc, i * 2 + 2), F.lit(bytearray(b""))),
            ),
        )

    rounds = F.array(*[F.lit(k) for k in range(TILE_HEIGHT)])
    return F.element_at(F.aggregate(rounds, parts, merge_pairs), 1)


def encode(leaves: DataFrame, by_part: bool = False) -> DataFrame:
    """Bundles (log_id, bundle_index, width, oversize, bytes, metadata) of leaves, in one shuffle.

    An entry too long for its two-byte length leaves the whole bundle without bytes and is counted
    in `oversize`; it is never dropped in silence. Copies of one leaf fall together. A bundle with a gap or with
    different leaves for one index has no bytes either, and `width` counts what was given.

    `by_part` adds the storage directory `part` and deals bundles out by ranges of even size, so that they can be
    written to their directories without another shuffle of all values.
    """
    bundle = bundle_of(F.col("leaf_index"))
    keys = ["log_id", "bundle_index"]
    leaves = leaves.withColumn("bundle_index", bundle)
    if by_part:
        keys.append("part")
        leaves = leaves.withColumn("part", part_of(bundle)).repartitionByRange("log_id", "bundle_index")
    slot = slot_of(F.col("leaf_index"))
    length = F.length("leaf_value")
    entry = F.concat(
        F.unhex(F.lpad(F.hex(slot), 2, "0")), F.unhex(F.lpad(F.hex(length), 4, "0")), F.col("leaf_value")
    )
    fits = length <= MAX_ENTRY_BYTES
    grouped = leaves.groupBy(*keys).agg(
        F.sort_array(F.collect_set(F.when(fits, entry))).alias("entries"),
        F.count_if(~fits).alias("oversize"),
        F.sort_array(
            F.collect_set(timestamps.pair(slot, F.col("queue_ts_nanos"), F.col("integrate_ts_nanos")))
        ).alias("pairs"),
        F.max(slot).alias("last"),
    )
    sound = (F.size("entries") == F.size("pairs")) & (F.col("last") + 1 == F.size("pairs"))
    bodies = F.transform(F.col("entries"), lambda e: F.substring(e, F.lit(2), F.length(e) - 1))
    return grouped.select(
        *keys,
        F.size("pairs").alias("width"),
        "oversize",
        F.when((F.col("oversize") == 0) & (F.size("entries") > 0) & sound, _joined(bodies)).alias("bytes"),
        timestamps.build(F.col("pairs")).alias("metadata"),
    )


def timestamp_pairs(leaves: DataFrame) -> DataFrame:
    """Only the timestamp metadata (log_id, bundle_index, width, metadata), without reading values."""
    return (
        leaves.groupBy("log_id", bundle_of(F.col("leaf_index")).alias("bundle_index"))
        .agg(
            F.sort_array(
                F.collect_set(
                    timestamps.pair(
                        slot_of(F.col("leaf_index")), F.col("queue_ts_nanos"), F.col("integrate_ts_nanos")
                    )
                )
            ).alias("pairs")
        )
        .select(
            "log_id",
            "bundle_index",
            F.size("pairs").alias("width"),
            timestamps.build(F.col("pairs")).alias("metadata"),
        )
    )


def entry_starts(data: Column) -> Column:
    """Zero-based start of each entry's length field, and one past the last; null when the bytes are cut short.

    `data` should be bound by let(): every step reads it.
    """

    def step(acc: Column, _: Column) -> Column:
        at = F.element_at(acc, -1)
        size = F.conv(F.hex(F.substring(data, at + 1, F.lit(2))), 16, 10).cast("int")
        return F.when(at < F.length(data), F.concat(acc, F.array(at + 2 + size))).otherwise(acc)

    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(TILE_WIDTH)), F.array(F.lit(0)), lambda acc, k: step(acc, k)
    )
    return F.when(F.element_at(walked, -1) == F.length(data), walked)


def entry_at(data: Column, starts: Column, slot: Column) -> Column:
    """The entry of a slot, null when the bundle has no such slot."""
    here = F.try_element_at(starts, (slot + 1).cast("int"))
    past = F.try_element_at(starts, (slot + 2).cast("int"))
    return F.when(past.isNotNull(), F.substring(data, here + 3, past - here - 2))


def _opened() -> Column:
    """Entries of a bundle with slot, value and times, in the order of their slots; null where it cannot be read."""

    def leaf(data: Column, starts: Column, slot: Column) -> Column:
        return F.struct(
            slot.alias("slot"),
            entry_at(data, starts, slot).alias("value"),
            timestamps.parse(F.col("metadata"), slot).alias("times"),
        )

    def leaves(data: Column, starts: Column) -> Column:
        slots = F.sequence(F.lit(0), F.size(starts) - 2)
        return F.when(F.size(starts) > 1, F.transform(slots, lambda slot: leaf(data, starts, slot)))

    return let(F.col("bytes"), lambda data: let(entry_starts(data), lambda starts: leaves(data, starts)))


def decode_whole(bundles: DataFrame) -> DataFrame:
    """Bundles (log_id, bundle_index) with `leaves`, the entry of slot k at place k: leaf_value, merkle_leaf_hash (computed again), both
    times and error_code. Null where a bundle is missing or cannot be read."""

    def leaf(own: Column) -> Column:
        return F.struct(
            own["value"].alias("leaf_value"),
            leaf_hash(own["value"]).alias("merkle_leaf_hash"),
            own["times"]["queue_ts_nanos"].alias("queue_ts_nanos"),
            own["times"]["integrate_ts_nanos"].alias("integrate_ts_nanos"),
            own["times"]["error_code"].alias("error_code"),
        )

    return bundles.select("log_id", "bundle_index", F.transform(_opened(), leaf).alias("leaves"))


def decode(bundles: DataFrame) -> DataFrame:
    """Leaves of bundles, with hashes computed again and timestamps from the metadata.

    A bundle that is missing or cannot be read gives one row with `error_code` and no leaf.
    """
    # Entries are cut out inside the bundle and then unrolled, so its bytes are not copied once per leaf.
    unrolled = bundles.select(
        "log_id", "bundle_index", F.col("bytes").isNull().alias("absent"), F.explode_outer(_opened()).alias("leaf")
    )
    return unrolled.select(
        "log_id",
        "bundle_index",
        leaf_index(F.col("bundle_index"), F.col("leaf.slot")).alias("leaf_index"),
        F.col("leaf.value").alias("leaf_value"),
        leaf_hash(F.col("leaf.value")).alias("merkle_leaf_hash"),
        F.col("leaf.times.queue_ts_nanos").alias("queue_ts_nanos"),
        F.col("leaf.times.integrate_ts_nanos").alias("integrate_ts_nanos"),
        F.when(F.col("absent"), F.lit("BUNDLE_MISSING"))
        .when(F.col("leaf").isNull(), F.lit("BUNDLE_CORRUPT"))
        .otherwise(F.col("leaf.times.error_code"))
        .alias("error_code"),
    )


def attach_metadata(objects: DataFrame, pairs: DataFrame) -> DataFrame:
    """Metadata by object path: rows (log_id, path) joined with the timestamps of the bundle they name.

    Paths other than entry bundles have none. A bundle without timestamps, or with a count that
    differs from the width in its name, is reported in `error_code`.
    """
    parsed = objects.withColumn("_at", parse_entries_path(F.col("path"))).select(
        *objects.columns, F.col("_at.index").alias("bundle_index"), F.col("_at.partial").alias("partial")
    )
    joined = parsed.join(
        pairs.select("log_id", "bundle_index", "metadata"), ["log_id", "bundle_index"], "left"
    )
    expected = F.when(F.col("partial") > 0, F.col("partial")).otherwise(F.lit(TILE_WIDTH))
    error = (
        F.when(~F.startswith(F.col("path"), F.lit(ENTRIES_DIR)), F.lit(None))
        .when(F.col("bundle_index").isNull(), F.lit("BAD_PATH"))
        .when(F.col("metadata").isNull(), F.lit("NO_TIMESTAMPS"))
        .when(F.size("metadata") != expected, F.lit("COUNT_MISMATCH"))
    )
    return joined.select(
        *objects.columns,
        "bundle_index",
        "partial",
        F.when(error.isNull(), F.col("metadata")).alias("metadata"),
        error.alias("error_code"),
    )
