"""Ordered rules: request validation, migration bounds, leaf input, completeness."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merklake.constants import DIGEST_BYTES, TILE_WIDTH
from merklake.functions.digests import is_digest
from merklake.functions.paths import bundle_of, expected_width, leaf_index, slot_of
from merklake.operators.joins import explode_range

OK = "OK"
INVALID = "INVALID_ARGUMENT"
NOT_FOUND = "NOT_FOUND"
INTERNAL = "INTERNAL"
BEYOND = "SIZE_BEYOND_LOG"


def _first_match(rules: list[tuple[Column, str, str]]) -> Column:
    """STRUCT<status, reason> of the first rule that holds."""
    chain = None
    for condition, status, reason in rules:
        hit = F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))
        chain = F.when(condition, hit) if chain is None else chain.when(condition, hit)
    return chain.otherwise(F.struct(F.lit(OK).alias("status"), F.lit(None).cast("string").alias("reason")))


def request_rules(kind: str) -> list[tuple[Column, str, str]]:
    """Rules of one call, in the order they are tried. `log_known` is false for a log that is not registered;
    `known_size` is null where a registered one has no readable checkpoint.

    A null argument breaks the first rule that reads it.
    """
    col = F.col
    unknown = (~col("log_known"), INVALID, "UNKNOWN_LOG")
    unreadable = (col("known_size").isNull(), INTERNAL, "CHECKPOINT_MISSING")
    size = [(col("tree_size") <= 0, INVALID, "TREE_SIZE_NOT_POSITIVE")]
    index = [
        (col("leaf_index") < 0, INVALID, "LEAF_INDEX_NEGATIVE"),
        (col("leaf_index") >= col("tree_size"), INVALID, "LEAF_INDEX_NOT_IN_TREE"),
    ]
    beyond = [(col("tree_size") > col("known_size"), OK, BEYOND)]
    rules = {
        "inclusion_proof": [*size, *index, *beyond],
        "inclusion_proof_by_hash": [
            *size,
            (~is_digest(col("leaf_hash")), INVALID, "LEAF_HASH_LENGTH"),
            *beyond,
        ],
        "consistency_proof": [
            (col("first_tree_size") <= 0, INVALID, "FIRST_SIZE_NOT_POSITIVE"),
            (col("second_tree_size") <= 0, INVALID, "SECOND_SIZE_NOT_POSITIVE"),
            (col("second_tree_size") < col("first_tree_size"), INVALID, "SIZES_REVERSED"),
            (col("second_tree_size") > col("known_size"), INVALID, "SECOND_SIZE_BEYOND_LOG"),
        ],
        "latest_root": [(col("first_tree_size") < 0, INVALID, "FIRST_SIZE_NEGATIVE")],
        "entry_and_proof": [
            *size,
            *index,
            (col("leaf_index") >= col("known_size"), NOT_FOUND, "LEAF_NOT_IN_LOG"),
        ],
        "leaves_by_range": [
            (col("start_index") < 0, INVALID, "START_NEGATIVE"),
            (col("count") <= 0, INVALID, "COUNT_NOT_POSITIVE"),
        ],
    }
    return [unknown, unreadable, *((F.coalesce(broken, F.lit(status == INVALID)), status, reason) for broken, status, reason in rules[kind])]


def validate(requests: DataFrame, kind: str) -> DataFrame:
    """Add status and reason to requests that carry `known_size`."""
    known = requests
    if "log_known" not in requests.columns:
        known = requests.withColumn("log_known", F.col("known_size").isNotNull())
    known = known.withColumn("log_known", F.coalesce("log_known", F.lit(False)))
    return known.withColumn("_verdict", _first_match(request_rules(kind))).select(
        *requests.columns, F.col("_verdict.status").alias("status"), F.col("_verdict.reason").alias("reason")
    )


def lookup_verdict(found_index: Column, tree_size: Column) -> Column:
    """Verdict after a hash lookup."""
    return _first_match(
        [
            (found_index.isNull(), NOT_FOUND, "LEAF_HASH_NOT_FOUND"),
            (found_index >= tree_size, NOT_FOUND, "LEAF_NOT_AT_TREE_SIZE"),
        ]
    )


def migration_bounds(sources: DataFrame) -> DataFrame:
    """Size to migrate for each (log_id, tree_size, finish); finish -1 stands for the whole log. A null is INVALID."""
    finish = F.when(F.col("finish") == -1, F.col("tree_size")).otherwise(F.col("finish"))
    verdict = _first_match(
        [
            (F.col("log_id").isNull(), INVALID, "LOG_ID_MISSING"),
            (F.col("finish").isNull() | F.col("tree_size").isNull(), INVALID, "BOUND_MISSING"),
            (F.col("finish") > F.col("tree_size"), INVALID, "FINISH_BEYOND_LOG"),
            (finish < 0, INVALID, "FINISH_NEGATIVE"),
        ]
    )
    return sources.select(
        *sources.columns,
        F.when(verdict["status"] == OK, finish).alias("migrate_size"),
        verdict["status"].alias("status"),
        verdict["reason"].alias("reason"),
    )


def leaf_findings(leaves: DataFrame) -> DataFrame:
    """Add `error_code` to leaves whose index, value, given hash or times, where given, cannot be migrated."""
    digest = F.col("merkle_leaf_hash")
    error = (
        F.when(F.col("leaf_index").isNull() | (F.col("leaf_index") < 0), F.lit("INDEX_OUT_OF_RANGE"))
        .when(F.col("leaf_value").isNull(), F.lit("VALUE_MISSING"))
        .when(digest.isNull() | (F.length(digest) == 0), F.lit("HASH_MISSING"))
        .when(F.length(digest) != DIGEST_BYTES, F.lit("HASH_LENGTH"))
    )
    if {"queue_ts_nanos", "integrate_ts_nanos"} <= set(leaves.columns):
        queue, integrate = F.col("queue_ts_nanos"), F.col("integrate_ts_nanos")
        # Metadata holds their difference.
        error = error.when(queue.isNull() | integrate.isNull(), F.lit("TIME_MISSING")).when(
            F.try_subtract(integrate, queue).isNull(), F.lit("TIME_OUT_OF_RANGE")
        )
    return leaves.withColumn("error_code", error)


def _slot_masks(index: Column) -> list[Column]:
    """Four 64-bit masks that hold which of a bundle's 256 slots have a leaf."""
    slot = slot_of(index)
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), (slot % 64).cast("int"))
    return [
        F.bit_or(F.when(F.shiftright(slot, 6) == k, one).otherwise(F.lit(0).cast("bigint"))).alias(f"m{k}")
        for k in range(TILE_WIDTH // 64)
    ]


def bundle_counts(leaves: DataFrame) -> DataFrame:
    """Rows and distinct slots per bundle. Buffers are a few numbers, so repeated indices cost nothing."""
    masks = [f"m{k}" for k in range(TILE_WIDTH // 64)]
    return (
        leaves.groupBy("log_id", bundle_of(F.col("leaf_index")).alias("bundle_index"))
        .agg(F.count("*").alias("rows"), F.max("leaf_index").alias("max_index"), *_slot_masks(F.col("leaf_index")))
        .withColumn("distinct_rows", sum((F.bit_count(m).cast("bigint") for m in masks), F.lit(0).cast("bigint")))
    )


def completeness(leaves: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Per log: rows, distinct indices, size by the last index, and the size expected if given."""
    per_log = (
        bundle_counts(leaves)
        .groupBy("log_id")
        .agg(
            F.sum("rows").alias("rows"),
            F.sum("distinct_rows").alias("distinct_rows"),
            (F.max("max_index") + 1).alias("size_by_index"),
        )
    )
    if expected is None:
        out = per_log.withColumn("tree_size", F.col("size_by_index"))
    else:
        out = expected.select("log_id", "tree_size").join(per_log, "log_id", "full_outer")
    zero = F.lit(0).cast("bigint")
    out = out.select(
        "log_id",
        "tree_size",
        *[F.coalesce(F.col(c), zero).alias(c) for c in ("rows", "distinct_rows", "size_by_index")],
    )
    return out.withColumn("repeated", F.col("rows") - F.col("distinct_rows")).withColumn(
        "complete",
        F.coalesce(
            (F.col("rows") == F.col("tree_size"))
            & (F.col("distinct_rows") == F.col("tree_size"))
            & (F.col("size_by_index") == F.col("tree_size")),
            F.lit(False),
        ),
    )


def gaps(leaves: DataFrame, logs: DataFrame) -> DataFrame:
    """Every missing index of logs (log_id, tree_size), as (log_id, bundle_index, missing, first, last, indices).

    One row per bundle that lacks leaves; bundles with no leaf at all included.
    """
    sizes = logs.where("tree_size > 0").select("log_id", "tree_size")
    wanted = explode_range(
        sizes, F.lit(0).cast("bigint"), bundle_of(F.col("tree_size") - 1), "bundle_index"
    )
    found = bundle_counts(leaves)
    masks = F.array(*[F.coalesce(F.col(f"m{k}"), F.lit(0).cast("bigint")) for k in range(TILE_WIDTH // 64)])
    width = expected_width(F.col("bundle_index"), F.col("tree_size"))

    def absent(slot: Column) -> Column:
        mask = F.element_at("masks", F.shiftright(slot, 6) + 1)
        return F.call_function("shiftright", mask, slot % 64).bitwiseAND(F.lit(1)) == 0

    return (
        wanted.join(found, ["log_id", "bundle_index"], "left")
        .withColumn("masks", masks)
        .withColumn("slots", F.filter(F.sequence(F.lit(0), width - 1), absent))
        .where(F.size("slots") > 0)
        .select(
            "log_id",
            "bundle_index",
            F.size("slots").alias("missing"),
            leaf_index(F.col("bundle_index"), F.element_at("slots", 1)).alias("first_missing"),
            leaf_index(F.col("bundle_index"), F.element_at("slots", -1)).alias("last_missing"),
            F.transform("slots", lambda s: leaf_index(F.col("bundle_index"), s)).alias("indices"),
        )
    )
