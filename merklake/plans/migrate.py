"""Migration: leaves in, a verified store out, all logs in one job.

Values are read once to hash them, and twice to pack them into bundles, as their ranges are found first. Everything else works
on a slim table of hashes. The manifest is written last, so a reader sees a whole copy or the one before.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merklake.constants import MAX_ENTRY_BYTES, TILE_WIDTH
from merklake.functions.hashing import empty_root, leaf_hash
from merklake.functions.paths import bundle_of, part_of
from merklake.operators import bundles as bundle_ops
from merklake.operators import checks, compare, hashindex, merkle, proofs
from merklake.operators.joins import small_join
from merklake.plans import store
from merklake.plans.store import write_by_log, write_by_part
from merklake.schemas import CHECKPOINTS, MANIFEST
from merklake.sources.scratch import materialize


@dataclass
class Migration:
    """checkpoints: of the logs migrated. findings: log_id, error_code, rows, first_index of every log that was left out."""

    checkpoints: DataFrame
    findings: DataFrame


def _found(problems: DataFrame, code: Column, index: Column | None = None) -> DataFrame:
    first = F.min(index) if index is not None else F.lit(None).cast("bigint")
    return problems.groupBy("log_id", code.alias("error_code")).agg(F.count("*").alias("rows"), first.alias("first_index"))


def leaf_facts(leaves: DataFrame) -> DataFrame:
    """Slim row per leaf: index, hash, length and `error_code`. A hash that comes with a leaf is checked."""
    computed = leaf_hash(F.col("leaf_value"))
    if "merkle_leaf_hash" not in leaves.columns:
        leaves = leaves.withColumn("merkle_leaf_hash", computed)
    checked = checks.leaf_findings(leaves)
    return checked.select(
        "log_id",
        "leaf_index",
        computed.alias("merkle_leaf_hash"),
        F.length("leaf_value").alias("value_bytes"),
        F.coalesce(
            F.col("error_code"),
            F.when(computed != F.col("merkle_leaf_hash"), F.lit("HASH_MISMATCH")),
            F.when(F.length("leaf_value") > MAX_ENTRY_BYTES, F.lit("ENTRY_TOO_LONG")),
        ).alias("error_code"),
    )


def _bounds(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Size to migrate of every log named once, and findings of the others."""
    bounds = checks.migration_bounds(sources)
    named = bounds.groupBy("log_id").agg(F.count("*").alias("_named"))
    bounds = materialize(bounds.join(named, bounds["log_id"].eqNullSafe(named["log_id"])).drop(named["log_id"]), "bounds")
    reason = F.when(F.col("status") != checks.OK, F.col("reason")).when(F.col("_named") > 1, F.lit("LOG_REPEATED"))
    findings = _found(bounds.withColumn("_reason", reason).where("_reason is not null"), F.col("_reason"))
    return bounds.where((F.col("status") == checks.OK) & (F.col("_named") == 1)).drop("_named"), findings


def _without(rows: DataFrame, findings: DataFrame) -> DataFrame:
    return rows.join(findings.select("log_id").distinct(), "log_id", "left_anti")


def _write_generation(location: str, bundles: DataFrame, tree: merkle.Tree, facts: DataFrame, good: DataFrame) -> str:
    """Store what a migration made of the logs in `good`, under a new generation that no reader looks at yet."""
    generation = store.new_generation()

    def of_good(rows: DataFrame) -> DataFrame:
        return small_join(rows, good, ["log_id"], "inner")

    def path(table: str) -> str:
        return store.generation_path(location, table, generation)

    tiles = of_good(tree.hash_tiles())
    write_by_part(bundle_ops.encode(of_good(bundles), by_part=True), "bundle_index", path("bundles"))
    write_by_log(tiles, path("tiles"), "tile_level")
    write_by_log(tiles.where(F.col("width") < TILE_WIDTH).select("tile_level", "width", "hashes", "log_id"), path("frontier"))
    write_by_part(of_good(tree.paths()), "tile_index", path("paths"))
    hashindex.write(hashindex.build(of_good(facts)), path("hash_index"))
    return generation


def _one_generation(generation: str) -> Column:
    return F.struct(F.lit(generation).alias("generation"), F.lit(None).alias("until"), F.lit(None).alias("patch"))


def migrate(leaves: DataFrame, sources: DataFrame, location: str, origin: str = "log") -> Migration:
    """Migrate logs into a store, which may hold others already.

    `sources` has one row per log: log_id, tree_size, root_hash, timestamp_nanos, finish (-1: all).
    When all of a log is migrated the rebuilt root must equal the source's; for a shorter prefix the
    root is the prefix's own. A log with any problem is left out and named in the findings; the others go on. Every
    log of `sources` is in the checkpoints or in the findings. A log that the store holds is replaced as a whole, at once.
    """
    bounds, findings = _bounds(sources)
    wanted = bounds.select("log_id", F.col("migrate_size").alias("tree_size"))

    chosen = small_join(leaves, wanted.withColumnRenamed("tree_size", "_size"), ["log_id"], "inner")
    chosen = chosen.where(F.col("leaf_index").isNull() | (F.col("leaf_index") < F.col("_size"))).drop("_size")
    facts = materialize(leaf_facts(chosen), "facts")
    sizes = materialize(checks.completeness(facts, wanted.where("tree_size > 0")), "sizes")
    findings = (
        findings.unionByName(_found(facts.where("error_code is not null"), F.col("error_code"), F.col("leaf_index")))
        .unionByName(_found(sizes.where(~F.col("complete")), F.lit("INCOMPLETE")))
    )
    findings = materialize(findings, "findings")
    sound = materialize(_without(wanted, findings), "sound_logs")

    tree = merkle.build_tree(small_join(facts, sound.select("log_id"), ["log_id"], "inner"))
    roots = materialize(tree.roots(), "roots")
    findings, good = _verified(roots, bounds, sound, findings)
    generation = _write_generation(location, chosen, tree, facts, good)

    empty = bounds.where("migrate_size = 0").select(
        "log_id", F.lit(0).cast("bigint").alias("tree_size"), empty_root().alias("root_hash")
    )
    rows = small_join(roots.unionByName(empty), good, ["log_id"], "inner").join(bounds.select("log_id", "timestamp_nanos"), "log_id")
    rows = rows.select(
        "log_id", F.lit(origin).alias("origin"), "tree_size", "root_hash", F.col("timestamp_nanos").alias("frozen_time_nanos"),
        F.array(_one_generation(generation)).cast(MANIFEST["generations"].dataType).alias("generations"),
    )
    rows = materialize(rows, "checkpoints")
    store.publish(rows, location)
    return Migration(rows.select(*CHECKPOINTS.names), findings)


def _verified(roots: DataFrame, bounds: DataFrame, sound: DataFrame, findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings with logs whose root is not the source's, and the logs that have none."""
    whole = bounds.where("migrate_size = tree_size and tree_size > 0").join(sound.select("log_id"), "log_id", "left_semi")
    verified = compare.verify_roots(roots.join(whole.select("log_id"), "log_id", "left_semi"), whole)
    findings = materialize(findings.unionByName(_found(verified.where(~F.col("ok")), F.lit("ROOT_DIFFERS"))), "findings")
    return findings, materialize(_without(sound, findings).select("log_id"), "good_logs")


def grow(leaves: DataFrame, sources: DataFrame, location: str) -> Migration:
    """Bring logs of a store up to a longer prefix of their source; only leaves past the stored sizes are read.

    `sources` as for migrate(). New tiles are joined with the frontier of the stored tree, so the root is that of the whole
    log, and where all of the log is migrated it must equal the source's: a stored prefix that is no prefix of the source
    is found so. The last bundle and the incomplete tiles are replaced; the rest stays as it is stored, and the chains of old tiles
    are brought up to date when read. A log that the store lacks (LOG_NOT_STORED), that would shrink (SIZE_SHRINKS), or has any
    problem of migrate() is named in the findings and stays as published; one that has its size already stays too, without a finding.
    """
    spark = leaves.sparkSession
    manifest = store.read_manifest(spark, location)
    bounds, findings = _bounds(sources)
    known = manifest.select("log_id", F.col("tree_size").alias("stored_size"))
    bounds = materialize(bounds.join(known, "log_id", "left"), "bounds")
    problem = F.when(F.col("stored_size").isNull(), F.lit("LOG_NOT_STORED")).when(F.col("migrate_size") < F.col("stored_size"), F.lit("SIZE_SHRINKS"))
    findings = findings.unionByName(_found(bounds.withColumn("_problem", problem).where("_problem is not null"), F.col("_problem")))
    bounds = bounds.where("migrate_size > stored_size")
    sizes = materialize(bounds.select("log_id", "stored_size", "migrate_size"), "sizes")

    # The least stored size is known here, so the bound reaches the scan; each log's own is joined.
    lowest = sizes.agg(F.coalesce(F.min("stored_size"), F.lit(0)).alias("lowest")).first()["lowest"]
    index = F.col("leaf_index")
    chosen = small_join(leaves.where(index.isNull() | (index >= lowest)), sizes, ["log_id"], "inner")
    chosen = chosen.where(index.isNull() | index.between(F.col("stored_size"), F.col("migrate_size") - 1)).select(*leaves.columns)
    facts = materialize(leaf_facts(chosen), "facts")
    added = F.col("migrate_size") - F.col("stored_size")
    counted = sizes.join(checks.completeness(facts).select("log_id", "rows", "distinct_rows"), "log_id", "left")
    partial = counted.where(~F.coalesce((F.col("rows") == added) & (F.col("distinct_rows") == added), F.lit(False)))
    findings = (
        findings.unionByName(_found(facts.where("error_code is not null"), F.col("error_code"), F.col("leaf_index")))
        .unionByName(_found(partial, F.lit("INCOMPLETE")))
    )
    findings = materialize(findings, "findings")
    sound = materialize(_without(sizes, findings), "sound_logs")

    frontier = store.read_frontier(spark, location, manifest.join(sound.select("log_id"), "log_id", "left_semi"))
    tree = merkle.build_tree(small_join(facts, sound.select("log_id"), ["log_id"], "inner"), frontier=materialize(frontier, "frontier"))
    roots = materialize(tree.roots(), "roots")
    findings, good = _verified(roots, bounds, sound, findings)

    stored = store.read_stored(spark, location, manifest)
    bundle = bundle_of(F.col("stored_size"))
    tails = sizes.where(F.col("stored_size") % TILE_WIDTH > 0).select("log_id", bundle.alias("bundle_index"), part_of(bundle).alias("part"))
    tail = bundle_ops.decode(small_join(stored.bundles, tails.where("bundle_index >= 0"), ["log_id", "part", "bundle_index"], "inner"))
    values = ["log_id", "leaf_index", "leaf_value", "queue_ts_nanos", "integrate_ts_nanos"]
    generation = _write_generation(location, tail.select(*values).unionByName(chosen.select(*values)), tree, facts, good)

    grown = small_join(sizes, good, ["log_id"], "inner").select("log_id", "stored_size", bundle.alias("_tile"), part_of(bundle).alias("part"))
    tiles = spark.read.schema(store.TABLES["paths"]).parquet(store.generation_path(location, "paths", generation))
    tiles = tiles.select("log_id", "part", F.col("tile_index").alias("_tile"), "levels", "upper")
    newer = grown.join(tiles, ["log_id", "part", "_tile"]).select(
        "log_id", "stored_size", merkle.leaf_chain(F.col("stored_size"), F.col("levels"), F.col("upper")).alias("_newer")
    )
    earlier, last = F.slice("generations", 1, F.size("generations") - 1), F.element_at("generations", -1)

    def kept(g: Column) -> Column:
        patch = proofs.moved_chain(g["until"], g["patch"], F.col("stored_size"), F.col("_newer"))
        return F.struct(g["generation"].alias("generation"), g["until"].alias("until"), patch.alias("patch"))

    now = F.array(F.struct(last["generation"].alias("generation"), F.col("stored_size").alias("until"), F.col("_newer").alias("patch")), _one_generation(generation))
    kind = MANIFEST["generations"].dataType
    rows = (
        manifest.select("log_id", "origin", "generations")
        .join(newer, "log_id")
        .join(roots.select("log_id", "tree_size", "root_hash"), "log_id")
        .join(bounds.select("log_id", F.col("timestamp_nanos").alias("frozen_time_nanos")), "log_id")
        .select(*CHECKPOINTS.names, F.concat(F.transform(earlier, kept).cast(kind), now.cast(kind)).alias("generations"))
    )
    rows = materialize(rows, "checkpoints")
    store.publish(rows, location)
    return Migration(rows.select(*CHECKPOINTS.names), findings)
