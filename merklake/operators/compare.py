"""Differences between two copies of a log, one row per differing field."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merklake.functions.hashing import hex_lower, hex_preview, leaf_hash

KEYS = ["log_id", "leaf_index"]
_DIFF = "array<struct<field:string,left:string,right:string>>"


def _digest_rows(leaves: DataFrame) -> DataFrame:
    """One short row per index: values are replaced by their hashes before any shuffle.

    An index that occurs more than once keeps its smallest row and its count, so repeated rows are
    reported once and never paired with each other.
    """
    given = F.col("merkle_leaf_hash") if "merkle_leaf_hash" in leaves.columns else leaf_hash(F.col("leaf_value"))
    short = leaves.select(
        *KEYS,
        F.struct(
            leaf_hash(F.col("leaf_value")).alias("value_hash"),
            given.alias("given_hash"),
            hex_preview(F.col("leaf_value")).alias("preview"),
            F.col("queue_ts_nanos").alias("queue"),
            F.col("integrate_ts_nanos").alias("integrate"),
        ).alias("row"),
    )
    return short.groupBy(*KEYS).agg(F.min("row").alias("row"), F.count("*").alias("copies"))


def _diff(condition: Column, field: str, left: Column, right: Column) -> Column:
    return F.when(
        condition,
        F.struct(F.lit(field).alias("field"), left.cast("string").alias("left"), right.cast("string").alias("right")),
    )


def compare_leaves(left: DataFrame, right: DataFrame, strict: bool = False) -> DataFrame:
    """Differences (log_id, leaf_index, field, left, right, expected).

    Times are compared when both sides have one; `strict` compares missing ones as well.
    `expected` is the hash of the left value, given with hash differences.
    """
    joined = (
        _digest_rows(left)
        .select(*KEYS, F.col("row").alias("l"), F.col("copies").alias("lc"))
        .join(_digest_rows(right).select(*KEYS, F.col("row").alias("r"), F.col("copies").alias("rc")), KEYS, "full_outer")
    )
    both = F.col("l").isNotNull() & F.col("r").isNotNull()
    here, absent = F.lit("present"), F.lit("missing")

    def differs(name: str, optional: bool) -> Column:
        a, b = F.col(f"l.{name}"), F.col(f"r.{name}")
        return both & ((a != b) if optional and not strict else ~a.eqNullSafe(b))

    found = F.array_compact(
        F.array(
            _diff(
                ~both,
                "presence",
                F.when(F.col("l").isNull(), absent).otherwise(here),
                F.when(F.col("r").isNull(), absent).otherwise(here),
            ),
            _diff(both & (F.col("lc") != F.col("rc")), "copies", F.col("lc"), F.col("rc")),
            _diff(differs("value_hash", False), "leaf_value", F.col("l.preview"), F.col("r.preview")),
            _diff(
                differs("given_hash", False),
                "merkle_leaf_hash",
                hex_lower(F.col("l.given_hash")),
                hex_lower(F.col("r.given_hash")),
            ),
            _diff(differs("queue", True), "queue_ts_nanos", F.col("l.queue"), F.col("r.queue")),
            _diff(differs("integrate", True), "integrate_ts_nanos", F.col("l.integrate"), F.col("r.integrate")),
        )
    ).cast(_DIFF)
    return joined.select(*KEYS, F.explode(found).alias("d"), F.col("l.value_hash").alias("_expected")).select(
        *KEYS,
        "d.field",
        "d.left",
        "d.right",
        F.when(F.col("d.field") == "merkle_leaf_hash", hex_lower(F.col("_expected"))).alias("expected"),
    )


def compare_proofs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Differences of proofs (log_id, leaf_index, proof_index, hashes), at most one hash step per leaf.

    Each side holds one proof per leaf; `proof_index` is the index the proof itself names.
    """
    joined = left.select(*KEYS, F.col("proof_index").alias("li"), F.col("hashes").alias("lh")).join(
        right.select(*KEYS, F.col("proof_index").alias("ri"), F.col("hashes").alias("rh")), KEYS, "full_outer"
    )
    absent = F.col("lh").isNull() | F.col("rh").isNull()
    same_length = F.size("lh") == F.size("rh")
    index_differs = ~(
        F.col("li").eqNullSafe(F.col("ri"))
        & F.col("li").eqNullSafe(F.col("leaf_index"))
    )
    step = F.array_position(F.zip_with("lh", "rh", lambda a, b: a.eqNullSafe(b)), F.lit(False)).cast("int")
    found = F.array_compact(
        F.array(
            _diff(
                absent,
                "proof_missing",
                F.when(F.col("lh").isNull(), F.lit("0")).otherwise(F.lit("1")),
                F.when(F.col("rh").isNull(), F.lit("0")).otherwise(F.lit("1")),
            ),
            _diff(~absent & index_differs, "proof_leaf_index", F.col("li"), F.col("ri")),
            _diff(~absent & ~same_length, "proof_hash_count", F.size("lh"), F.size("rh")),
            _diff(
                ~absent & same_length & (step > 0),
                "proof_hash",
                hex_lower(F.get(F.col("lh"), step - 1)),
                hex_lower(F.get(F.col("rh"), step - 1)),
            ),
        )
    ).cast(_DIFF)
    return joined.select(*KEYS, F.explode(found).alias("d"), (step - 1).alias("_step")).select(
        *KEYS,
        "d.field",
        F.when(F.col("d.field") == "proof_hash", F.col("_step")).alias("step"),
        "d.left",
        "d.right",
    )


def difference_counts(differences: DataFrame) -> DataFrame:
    return differences.groupBy("log_id", "field").agg(F.count("*").alias("differences"))


def verify_roots(computed: DataFrame, expected: DataFrame) -> DataFrame:
    """(log_id, expected size and root, actual size and root, ok) for every log on either side."""
    return (
        expected.select("log_id", F.col("tree_size").alias("expected_size"), F.col("root_hash").alias("expected_root"))
        .join(
            computed.select("log_id", F.col("tree_size").alias("actual_size"), F.col("root_hash").alias("actual_root")),
            "log_id",
            "full_outer",
        )
        .withColumn(
            "ok",
            F.col("expected_size").eqNullSafe(F.col("actual_size"))
            & F.col("expected_root").eqNullSafe(F.col("actual_root")),
        )
    )
