"""What a request batch is answered from.

A store is written in generations: every migration, and every growth of a log, writes its rows under a name of its own, and last of all
one row per log into the manifest, which says what generations the log is made of. Readers take each log's latest row and, by it,
rows of the stored tables. So a copy is published at one instant, whatever was written before it, a run that stops
leaves the published copies alone, and readers that are at work go on with the one they began with.
"""

import time
import uuid

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from merklake.constants import DIGEST_BYTES
from merklake.functions import checkpoints, paths
from merklake.operators import bundles as bundle_ops
from merklake.operators import hashindex, merkle, proofs
from merklake.operators.joins import explode_range, small_join
from merklake.schemas import CHECKPOINTS, FRONTIER, HASH_TILES, MANIFEST, STORED_BUNDLES, STORED_INDEX, STORED_PATHS
from merklake.sources import objects
from merklake.sources.logs import with_leaf_hash
from merklake.sources.scratch import materialize


@dataclass
class LogStore:
    """Tables of all registered logs.

    logs: log_id, origin, tree_size, root_hash, frozen_time_nanos — one row per log.
    paths: lowest hash tiles with the chain above. bundles: values and times. index: hash to leaf.
    """

    logs: DataFrame
    paths: DataFrame | None = None
    bundles: DataFrame | None = None
    index: DataFrame | None = None


@dataclass
class StoredTables:
    """What a migration wrote, table by table."""

    checkpoints: DataFrame
    bundles: DataFrame
    tiles: DataFrame
    paths: DataFrame
    index: DataFrame


TABLES = {"bundles": STORED_BUNDLES, "tiles": HASH_TILES, "paths": STORED_PATHS, "hash_index": STORED_INDEX, "frontier": FRONTIER}


def new_generation() -> str:
    return uuid.uuid4().hex


def generation_path(location: str, table: str, generation: str) -> str:
    return f"{location}/{table}/generation={generation}"


def publish(rows: DataFrame, location: str) -> None:
    """Add manifest rows (CHECKPOINTS and generations), one per log. From then on readers see what they name."""
    rows.withColumn("version", F.lit(time.time_ns())).select(*MANIFEST.names).write.mode("append").parquet(f"{location}/manifest")


def read_manifest(spark: SparkSession, location: str) -> DataFrame:
    """The latest row of every log, as of now: written out, so that all tables are read by the same."""
    rows = spark.read.schema(MANIFEST).parquet(f"{location}/manifest")
    latest = rows.groupBy("log_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "log_id"]), "version").alias("_row"))
    return materialize(latest.select("log_id", "_row.*"), "manifest")


def _generations(spark: SparkSession, location: str, table: str) -> DataFrame:
    """All rows of a stored table, published or not, with the generation that its directory names."""
    schema = StructType([*TABLES[table].fields, StructField("generation", StringType())])
    return spark.read.schema(schema).parquet(f"{location}/{table}")


def _current(spark: SparkSession, location: str, table: str, manifest: DataFrame, patch: bool = False) -> DataFrame:
    """Rows of the generations the manifest names, with `_until`, and `_patch` if asked for."""
    stored = _generations(spark, location, table)
    parts = manifest.select("log_id", F.explode("generations").alias("g")).select(
        "log_id", "g.generation", F.col("g.until").alias("_until"), *([F.col("g.patch").alias("_patch")] if patch else [])
    )
    # Spark prunes directories only for a filtered key table.
    return small_join(stored, parts.where("generation != ''"), ["log_id", "generation"], "inner").drop("generation")


def read_stored(spark: SparkSession, location: str, manifest: DataFrame | None = None) -> StoredTables:
    """The published copy of every log. Rows that a later generation replaced are left out; chains of earlier
    generations are brought up to date by the chain of the leaf that came next, which the manifest keeps."""
    manifest = read_manifest(spark, location) if manifest is None else manifest

    def replaced(index: str, level: Column | int) -> Column:
        height = level * 8 + 8 if isinstance(level, Column) else F.lit(8 * level + 8)
        return F.coalesce(F.col(index) >= F.call_function("shiftright", "_until", height), F.lit(False))

    bundles = _current(spark, location, "bundles", manifest).where(~replaced("bundle_index", 0)).drop("_until")
    tiles = _current(spark, location, "tiles", manifest).where(~replaced("tile_index", F.col("tile_level"))).drop("_until")
    paths_ = _current(spark, location, "paths", manifest, patch=True).where(~replaced("tile_index", 0))
    first_leaf = F.shiftleft("tile_index", 8)
    moved = proofs.moved_chain(first_leaf, F.col("upper"), F.col("_until"), F.col("_patch"), from_level=8)
    upper = F.when(F.col("_until").isNull(), F.col("upper")).otherwise(moved)
    return StoredTables(
        checkpoints=manifest.select(*CHECKPOINTS.names),
        bundles=bundles,
        tiles=tiles,
        paths=paths_.withColumn("upper", upper).drop("_until", "_patch"),
        index=_current(spark, location, "hash_index", manifest).drop("_until"),
    )


def read_frontier(spark: SparkSession, location: str, manifest: DataFrame) -> DataFrame:
    """log_id, tree_size, tile_level, hashes: the incomplete tiles at the right edge of every log, at most one per level."""
    last = manifest.select("log_id", "tree_size", F.element_at("generations", -1)["generation"].alias("generation"))
    return small_join(_generations(spark, location, "frontier"), last, ["log_id", "generation"], "inner").select("log_id", "tree_size", "tile_level", "hashes")


def registered_logs(registry: DataFrame, checkpoints_table: DataFrame) -> DataFrame:
    """Checkpoints of registered logs. The frozen time served is the registry's; `frozen_time_differs`
    marks logs whose checkpoint has another one. A log without a checkpoint has null size and root."""
    stored = checkpoints_table.select(
        "log_id", "origin", "tree_size", "root_hash", F.col("frozen_time_nanos").alias("_stored")
    )
    return registry.select("log_id", "frozen_time_nanos").join(stored, "log_id", "left").select(
        "log_id",
        "origin",
        "tree_size",
        "root_hash",
        "frozen_time_nanos",
        (~F.col("frozen_time_nanos").eqNullSafe(F.col("_stored"))).alias("frozen_time_differs"),
    )


def store_from_leaves(leaves: DataFrame, parts: tuple[str, ...] = ("paths", "bundles", "index")) -> LogStore:
    """A store straight from leaves with both times, for logs that are not migrated.

    The frozen time of a log is its last integrate time.
    """
    slim = materialize(
        with_leaf_hash(leaves).select("log_id", "leaf_index", "merkle_leaf_hash", "integrate_ts_nanos"), "leaves"
    )
    tree = merkle.build_tree(slim)
    frozen = slim.groupBy("log_id").agg(F.max("integrate_ts_nanos").alias("frozen_time_nanos"))
    logs = tree.roots().join(frozen, "log_id").select(
        "log_id",
        F.concat(F.lit("log-"), F.col("log_id").cast("string")).alias("origin"),
        "tree_size",
        "root_hash",
        "frozen_time_nanos",
    )
    return LogStore(
        logs=materialize(logs, "logs"),
        paths=tree.paths() if "paths" in parts else None,
        bundles=bundle_ops.encode(leaves) if "bundles" in parts else None,
        index=hashindex.build(slim) if "index" in parts else None,
    )


def write_by_part(df: DataFrame, index: str, location: str) -> None:
    """Store bundles or tiles in directories by log and part, sorted.

    Rows without a `part` yet are brought together by it first, heavy parts in several tasks.
    """
    if "part" not in df.columns:
        df = df.withColumn("part", paths.part_of(F.col(index))).hint("rebalance", "log_id", "part")
    write_by_log(df.sortWithinPartitions("log_id", "part", index), location, "part")


def write_by_log(df: DataFrame, location: str, *directories: str) -> None:
    """Store in directories by log."""
    out = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("log_id", *directories)
    out.parquet(location)


def open_store(spark: SparkSession, location: str, registry: DataFrame) -> LogStore:
    """The store that migrations wrote, as published now, for the logs in the registry."""
    stored = read_stored(spark, location)
    return LogStore(
        logs=materialize(registered_logs(registry, stored.checkpoints), "logs"), paths=stored.paths, bundles=stored.bundles, index=stored.index
    )


def _folder(rows: DataFrame) -> Column:
    """Where a log's objects lie under the base: the registry's location, or else a folder named by the log id."""
    name = F.col("log_id").cast("string")
    return F.concat(F.coalesce("location", name) if "location" in rows.columns else name, F.lit("/"))


def export_objects(location: str, base: str, spark: SparkSession, registry: DataFrame | None = None) -> None:
    """Write a migrated store as objects in the public layout, each log in its location; checkpoints last."""
    tables = read_stored(spark, location)
    logs = tables.checkpoints
    if registry is not None:
        logs = materialize(logs.join(registry.select("log_id", "location"), "log_id"), "exported_logs")
    sizes = logs.select("log_id", "tree_size", *(["location"] if registry is not None else []))
    folder = _folder(sizes)

    stored = small_join(tables.bundles, sizes, ["log_id"], "inner")
    partial = paths.partial_width(F.col("bundle_index"), F.col("tree_size"))
    entries = stored.select(
        F.concat(folder, paths.entries_path(F.col("bundle_index"), partial)).alias("path"), "bytes", "metadata"
    )
    objects.write_objects(entries, base)
    objects.write_metadata(entries, base, lambda _: F.col("metadata"))

    tiles = small_join(tables.tiles, sizes.drop("tree_size"), ["log_id"], "inner")
    width = F.when(F.col("width") == 256, F.lit(0)).otherwise(F.col("width"))
    objects.write_objects(
        tiles.select(
            F.concat(folder, paths.tile_path(F.col("tile_level"), F.col("tile_index"), width)).alias("path"),
            F.col("hashes").alias("bytes"),
        ),
        base,
    )

    text = checkpoints.render(F.col("origin"), F.col("tree_size"), F.col("root_hash"))
    frozen = F.create_map(F.lit("TimestampNanos"), F.col("frozen_time_nanos").cast("string"))
    points = logs.select(
        F.concat(folder, F.lit("checkpoint")).alias("path"), text.cast("binary").alias("bytes"), frozen.alias("metadata")
    )
    objects.write_metadata(points, base, lambda _: F.col("metadata"))
    objects.write_objects(points, base)


def _located(logs: DataFrame) -> DataFrame:
    return logs.select("log_id", "tree_size", *(["location"] if "location" in logs.columns else []))


def store_from_objects(spark: SparkSession, base: str, registry: DataFrame) -> LogStore:
    """A store from objects in the public layout alone. Tiles hold the leaf hashes, so chains and index come from these; a
    tile that is missing or of the wrong size has no hashes, and nothing above it is given out."""
    points = read_checkpoints(spark, base, registry).join(registry.select("log_id", "location"), "log_id")
    points = materialize(points, "checkpoints")
    known = points.where("error_code is null and tree_size > 0")
    tiles = read_hash_tiles(spark, base, known)
    whole = F.length("hashes") == F.col("width") * DIGEST_BYTES
    tiles = materialize(tiles.select("log_id", "tile_index", F.when(whole, F.col("hashes")).alias("hashes")), "hash_tiles")
    each = tiles.where("hashes is not null").select("log_id", "tile_index", F.posexplode(merkle.unpack_hashes(F.col("hashes"))))
    leaves = each.select("log_id", paths.leaf_index(F.col("tile_index"), F.col("pos")).alias("leaf_index"), F.col("col").alias("merkle_leaf_hash"))
    good = points.where("error_code is null").select(*CHECKPOINTS.names)
    return LogStore(
        logs=materialize(registered_logs(registry, good), "logs"),
        paths=materialize(merkle.tree_from_tiles(tiles).paths(), "paths"),
        bundles=read_bundles(spark, base, known),
        index=hashindex.build(leaves),
    )


def read_checkpoints(spark: SparkSession, base: str, registry: DataFrame) -> DataFrame:
    """Checkpoint objects of registered logs, parsed; `error_code` where one is missing or bad."""
    wanted = registry.select("log_id", F.concat(_folder(registry), F.lit("checkpoint")).alias("path"))
    read = objects.fetch_objects(wanted, base).join(objects.read_metadata(spark, base), "path", "left")
    parsed = checkpoints.parse(F.col("bytes").cast("string"))
    return read.withColumn("_p", parsed).select(
        "log_id",
        "_p.origin",
        "_p.tree_size",
        "_p.root_hash",
        F.try_element_at("metadata", F.lit("timestampnanos")).try_cast("bigint").alias("frozen_time_nanos"),
        F.when(~F.col("found"), F.lit("OBJECT_NOT_FOUND")).otherwise(F.col("_p.error_code")).alias("error_code"),
    )


def read_bundles(spark: SparkSession, base: str, logs: DataFrame) -> DataFrame:
    """Entry bundle objects of logs (log_id, tree_size, location if given), by computed names: nothing is listed."""
    last = paths.bundle_of(F.col("tree_size") - 1)
    named = explode_range(_located(logs), F.lit(0).cast("bigint"), last, "bundle_index")
    partial = paths.partial_width(F.col("bundle_index"), F.col("tree_size"))
    wanted = named.select(
        "log_id",
        "bundle_index",
        F.concat(_folder(named), paths.entries_path(F.col("bundle_index"), partial)).alias("path"),
    )
    read = objects.fetch_objects(wanted, base).join(objects.read_metadata(spark, base), "path", "left")
    return read.select(
        "log_id",
        "bundle_index",
        F.size("metadata").alias("width"),
        F.lit(0).cast("bigint").alias("oversize"),
        "bytes",
        "metadata",
        "path",
        "found",
    )


def read_hash_tiles(spark: SparkSession, base: str, logs: DataFrame) -> DataFrame:
    """Lowest hash tile objects of logs (log_id, tree_size, location if given), by computed names."""
    last = paths.bundle_of(F.col("tree_size") - 1)
    named = explode_range(_located(logs), F.lit(0).cast("bigint"), last, "tile_index")
    partial = paths.partial_width(F.col("tile_index"), F.col("tree_size"))
    wanted = named.select(
        "log_id",
        "tile_index",
        F.concat(_folder(named), paths.tile_path(F.lit(0), F.col("tile_index"), partial)).alias("path"),
        paths.expected_width(F.col("tile_index"), F.col("tree_size")).alias("width"),
    )
    return objects.fetch_objects(wanted, base).withColumnRenamed("bytes", "hashes")
