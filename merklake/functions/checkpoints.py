"""Checkpoint text and the serialised log root."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fixed_hex(number: Column, n_bytes: int) -> Column:
    return F.lpad(F.hex(number), 2 * n_bytes, "0")


def render(origin: Column, tree_size: Column, root_hash: Column) -> Column:
    """Three lines: origin, size, root hash in base 64."""
    return F.concat(
        origin, F.lit("\n"), tree_size.cast("string"), F.lit("\n"), F.base64(root_hash), F.lit("\n")
    )


def parse(text: Column) -> Column:
    """STRUCT<origin, tree_size, root_hash, error_code>; extra lines are allowed and ignored."""
    lines = F.split(text, "\n", 4)
    origin = F.get(lines, F.lit(0))
    size_text = F.get(lines, F.lit(1))
    size = F.when(size_text.rlike("^[0-9]+$"), size_text.try_cast("bigint"))
    root = F.try_to_binary(F.get(lines, F.lit(2)), F.lit("base64"))
    error = (
        F.when(text.isNull() | (F.size(lines) < 4), F.lit("CHECKPOINT_TOO_SHORT"))
        .when(origin == "", F.lit("CHECKPOINT_NO_ORIGIN"))
        .when(size.isNull(), F.lit("CHECKPOINT_BAD_SIZE"))
        .when(root.isNull(), F.lit("CHECKPOINT_BAD_ROOT"))
    )
    good = error.isNull()
    return F.struct(
        F.when(good, origin).alias("origin"),
        F.when(good, size).alias("tree_size"),
        F.when(good, root).alias("root_hash"),
        error.alias("error_code"),
    )


def log_root(tree_size: Column, root_hash: Column, timestamp_nanos: Column) -> Column:
    return F.struct(
        tree_size.alias("tree_size"),
        root_hash.alias("root_hash"),
        timestamp_nanos.alias("timestamp_nanos"),
    )


def log_root_bytes(tree_size: Column, root_hash: Column, timestamp_nanos: Column) -> Column:
    """The public TLS form: version 1, size, root with a length byte, time, revision 0, no metadata."""
    return F.unhex(
        F.concat(
            F.lit("0001"),
            _fixed_hex(tree_size, 8),
            _fixed_hex(F.length(root_hash), 1),
            F.hex(root_hash),
            _fixed_hex(timestamp_nanos, 8),
            _fixed_hex(F.lit(0), 8),
            _fixed_hex(F.lit(0), 2),
        )
    )
