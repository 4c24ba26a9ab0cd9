"""Validation of a copy: every leaf, hash lookup and proof of two logs compared."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merklake.functions.hashing import hex_lower
from merklake.functions.paths import part_of
from merklake.operators import bundles, checks, compare, hashindex, merkle, proofs
from merklake.operators.joins import HOT_ROWS, fits_broadcast, small_join
from merklake.plans.migrate import leaf_facts
from merklake.plans.store import StoredTables
from merklake.sources.scratch import materialize


def differing_logs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Logs whose lowest tiles are not all equal. Proofs and lookups depend on nothing else."""

    def tiles(df: DataFrame, side: str) -> DataFrame:
        return df.select("log_id", "tile_index", merkle.tile_root(F.col("levels")).alias(side))

    return (
        tiles(left, "l")
        .join(tiles(right, "r"), ["log_id", "tile_index"], "full_outer")
        .where(~F.col("l").eqNullSafe(F.col("r")))
        .select("log_id")
        .distinct()
    )


def _lookups(slim: DataFrame, hot_rows: int) -> DataFrame:
    """For every leaf, the index its hash leads to."""
    rows = slim.select("log_id", "leaf_index", "merkle_leaf_hash", F.col("leaf_index").alias("request_id"))
    return hashindex.lookup(rows, hashindex.build(slim), F.col("merkle_leaf_hash"), hot_rows)


def _not_dense(left: DataFrame, right: DataFrame) -> DataFrame:
    """Logs that are not exactly the indices 0 to n - 1 on both sides: log_id, leaf_index (null), field, left, right."""

    def sizes(side: DataFrame, name: str) -> DataFrame:
        shown = F.concat_ws(" rows, ", "rows", F.concat("distinct_rows", F.lit(" indices up to "), F.col("size_by_index") - 1))
        return checks.completeness(side).select("log_id", F.col("complete").alias(f"_{name}"), shown.alias(name))

    both = sizes(left, "left").join(sizes(right, "right"), "log_id", "full_outer")
    return both.where(~(F.coalesce("_left", F.lit(False)) & F.coalesce("_right", F.lit(False)))).select(
        "log_id", F.lit(None).cast("bigint").alias("leaf_index"), F.lit("not_dense").alias("field"), "left", "right"
    )


def _without(rows: DataFrame, logs: DataFrame) -> DataFrame:
    marked = small_join(rows, logs.select("log_id", F.lit(True).alias("_sparse")), ["log_id"])
    return marked.where("_sparse is null").drop("_sparse")


def validate_copy(left: DataFrame, right: DataFrame, strict: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """All differences (log_id, leaf_index, field, left, right) between two copies of leaves.

    Proofs and lookups are compared for the logs whose tiles differ; equal tiles give equal ones. A log that has
    gaps or repeated indices on either side has no proofs to compare: it gets one row of the field `not_dense`.
    """
    differences = compare.compare_leaves(left, right, strict).drop("expected")
    slim_l, slim_r = (materialize(leaf_facts(side), "facts") for side in (left, right))
    sparse = materialize(_not_dense(slim_l, slim_r), "sparse_logs")
    dense_l, dense_r = (materialize(_without(side, sparse), "dense") for side in (slim_l, slim_r))
    tree_l, tree_r = merkle.build_tree(dense_l), merkle.build_tree(dense_r)

    changed = materialize(differing_logs(tree_l.tiles[0], tree_r.tiles[0]), "changed_logs")

    def proofs_of(tree: merkle.Tree) -> DataFrame:
        paths = small_join(tree.paths(), changed, ["log_id"], "inner")
        return proofs.all_inclusion_proofs(paths).select(
            "log_id", "leaf_index", F.col("leaf_index").alias("proof_index"), "hashes"
        )

    proof_differences = compare.compare_proofs(proofs_of(tree_l), proofs_of(tree_r)).drop("step")

    def looked_up(slim: DataFrame, name: str) -> DataFrame:
        return _lookups(small_join(slim, changed, ["log_id"], "inner"), hot_rows).select("log_id", "leaf_index", F.col("found_index").alias(name))

    lookups = looked_up(dense_l, "left").join(looked_up(dense_r, "right"), ["log_id", "leaf_index"])
    lookup_differences = lookups.where(~F.col("left").eqNullSafe(F.col("right"))).select(
        "log_id",
        "leaf_index",
        F.lit("hash_lookup").alias("field"),
        F.col("left").cast("string").alias("left"),
        F.col("right").cast("string").alias("right"),
    )
    return differences.unionByName(proof_differences).unionByName(lookup_differences).unionByName(sparse)


def _unequal(left: DataFrame, right: DataFrame, keys: list[str], field: str, first_leaf: Column) -> DataFrame:
    """Rows of two tables (keys, shown) that differ or are on one side only, as differences."""
    met = left.withColumnRenamed("shown", "left").join(right.withColumnRenamed("shown", "right"), keys, "full_outer")
    return met.where(~F.col("left").eqNullSafe(F.col("right"))).select(
        "log_id", first_leaf.cast("bigint").alias("leaf_index"), F.lit(field).alias("field"), "left", "right"
    )


def _sizes_off(expected: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Expected logs without a checkpoint, or with one of another size, as differences."""
    met = expected.join(checkpoints.select("log_id", F.col("tree_size").alias("_stored")), "log_id", "left")
    return met.where(~F.col("tree_size").eqNullSafe(F.col("_stored"))).select(
        "log_id",
        F.lit(None).cast("bigint").alias("leaf_index"),
        F.when(F.col("_stored").isNull(), F.lit("checkpoint_missing")).otherwise(F.lit("size_differs")).alias("field"),
        F.col("tree_size").cast("string").alias("left"),
        F.col("_stored").cast("string").alias("right"),
    )


def validate_store(leaves: DataFrame, stored: StoredTables, strict: bool = False, expected: DataFrame | None = None) -> DataFrame:
    """All differences (log_id, leaf_index, field, left, right) between leaves and the store a migration made of them.

    Every stored table is compared with what the leaves give: bundles leaf by leaf, hash tiles, path tiles with their
    chains, index entries, and checkpoints. Differences of a tile are at its first leaf. `expected` (log_id, tree_size) has
    the logs and prefixes that the store is to hold; without it these are all logs of `leaves`, whole. What the store lacks
    of them is a difference, and so is its checkpoint if missing or of another size; other leaves do not count.
    """
    if expected is None:
        expected = leaves.groupBy("log_id").agg((F.max("leaf_index") + 1).alias("tree_size"))
    expected = materialize(expected.select("log_id", "tree_size"), "expected")
    sizes = expected.withColumnRenamed("tree_size", "_size")
    source = small_join(leaves, sizes, ["log_id"], "inner").where("leaf_index < _size").drop("_size")
    read = bundles.decode(stored.bundles).where("leaf_index is not null and error_code is null")
    found = compare.compare_leaves(source, read.select(*[c for c in source.columns if c in read.columns]), strict).drop("expected")

    facts = materialize(leaf_facts(source), "facts")
    tree = merkle.build_tree(facts)
    tile = ["log_id", "tile_level", "tile_index"]
    span = F.pow(F.lit(256), F.col("tile_level") + 1)

    def tiles(df: DataFrame) -> DataFrame:
        return df.select(*tile, F.sha2("hashes", 256).alias("shown"))

    def paths(df: DataFrame) -> DataFrame:
        return df.select("log_id", "tile_index", F.sha2(F.to_json(F.struct("levels", "upper")), 256).alias("shown"))

    def entries(df: DataFrame) -> DataFrame:
        return df.select("log_id", "leaf_index", F.concat("prefix", hex_lower(F.col("suffix"))).alias("shown"))

    def points(df: DataFrame) -> DataFrame:
        return df.select("log_id", F.concat_ws(" ", "tree_size", hex_lower(F.col("root_hash"))).alias("shown"))

    known = stored.checkpoints.where("tree_size > 0")
    none = F.lit(None)
    for part in (
        _unequal(tiles(tree.hash_tiles()), tiles(stored.tiles), tile, "hash_tile", F.col("tile_index") * span),
        _unequal(paths(tree.paths()), paths(stored.paths), ["log_id", "tile_index"], "path_tile", F.col("tile_index") * 256),
        _unequal(entries(hashindex.build(facts)), entries(stored.index), ["log_id", "leaf_index"], "index_entry", F.col("leaf_index")),
        _unequal(points(tree.roots().join(known.select("log_id"), "log_id", "left_semi")), points(known), ["log_id"], "checkpoint", none),
        _sizes_off(expected, stored.checkpoints),
    ):
        found = found.unionByName(part)
    return found


def _bundle_prints(stored: StoredTables) -> DataFrame:
    """Two short rows per bundle (log_id, part, bundle_index, kind, print): of its leaf hashes, and of its times."""
    hashes = stored.tiles.where("tile_level = 0").select(
        "log_id", part_of(F.col("tile_index")).alias("part"), F.col("tile_index").alias("bundle_index"),
        F.lit("hashes").alias("kind"), F.sha2("hashes", 256).alias("print"),
    )
    times = F.sha2(F.to_json(F.map_entries("metadata")), 256)
    return hashes.unionByName(
        stored.bundles.select("log_id", part_of(F.col("bundle_index")).alias("part"), "bundle_index", F.lit("times").alias("kind"), times.alias("print"))
    )


def _of_keys(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows with one of the keys; few keys are broadcast, so that directories without any are not read."""
    return rows.join(F.broadcast(keys) if fits_broadcast(keys) else keys, on, "left_semi")


def differing_bundles(left: StoredTables, right: StoredTables) -> DataFrame:
    """(log_id, part, bundle_index) of bundles whose leaf hashes or times are not the same on both sides, from the top down.

    Prints of bundles are added up, in any order, to one per part of about a million leaves. Only parts that differ are looked
    into, bundle by bundle, so equal copies shuffle a row per part. No value is read.
    """
    sides = [_bundle_prints(side) for side in (left, right)]
    whole, bundle = ["log_id", "part"], ["log_id", "part", "bundle_index", "kind"]

    def summed(rows: DataFrame, name: str) -> DataFrame:
        def xor(salt: str) -> Column:
            return F.bit_xor(F.xxhash64(F.lit(salt), "bundle_index", "kind", "print"))

        return rows.groupBy(*whole).agg(F.struct(F.count("*").alias("n"), xor("a").alias("a"), xor("b").alias("b")).alias(name))

    parts = summed(sides[0], "l").join(summed(sides[1], "r"), whole, "full_outer")
    parts = materialize(parts.where(~F.col("l").eqNullSafe(F.col("r"))).select(*whole), "differing_parts").where("part >= 0")
    inside = [_of_keys(rows, parts, whole).select(*bundle, F.col("print").alias(name)) for rows, name in zip(sides, "lr", strict=True)]
    met = inside[0].join(inside[1], bundle, "full_outer")
    return materialize(met.where(~F.col("l").eqNullSafe(F.col("r"))).select(*bundle[:3]).distinct(), "differing_bundles")


def compare_stored(left: StoredTables, right: StoredTables, strict: bool = False) -> DataFrame:
    """All differences of the leaves of two stores, as compare_leaves() gives them; only bundles that differ are opened."""
    keys = differing_bundles(left, right).where("bundle_index >= 0")

    def leaves(side: StoredTables) -> DataFrame:
        opened = bundles.decode(_of_keys(side.bundles, keys, ["log_id", "part", "bundle_index"]))
        return opened.where("leaf_index is not null and error_code is null").drop("bundle_index", "error_code")

    return compare.compare_leaves(leaves(left), leaves(right), strict)
