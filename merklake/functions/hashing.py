"""Merkle hashes as column expressions (RFC 6962 over SHA-256)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from merklake.constants import DIGEST_BYTES, LEAF_TAG, NODE_TAG


def _tag(tag: bytes) -> Column:
    return F.lit(bytearray(tag))


def leaf_hash_hex(value: Column) -> Column:
    return F.sha2(F.concat(_tag(LEAF_TAG), value), 256)


def leaf_hash(value: Column) -> Column:
    return F.unhex(leaf_hash_hex(value))


def node_hash(left: Column, right: Column) -> Column:
    return F.unhex(F.sha2(F.concat(_tag(NODE_TAG), left, right), 256))


def empty_root() -> Column:
    """Root of a log without leaves."""
    return F.unhex(F.sha2(F.lit(bytearray(b"")), 256))


def pack_hashes(hashes: Column) -> Column:
    """Hashes one after the other, the bytes of a stored tile."""
    return F.unhex(F.array_join(F.transform(hashes, F.hex), ""))


def unpack_hashes(packed: Column) -> Column:
    """Hashes of a stored tile; null when its length is no multiple of a digest."""
    last = F.call_function("div", F.length(packed), F.lit(DIGEST_BYTES)).cast("int") - 1
    return F.when(
        (F.length(packed) > 0) & (F.length(packed) % DIGEST_BYTES == 0),
        F.transform(
            F.sequence(F.lit(0), last), lambda i: F.substring(packed, i * DIGEST_BYTES + 1, F.lit(DIGEST_BYTES))
        ),
    )


def hex_lower(value: Column) -> Column:
    return F.lower(F.hex(value))


def hex_preview(value: Column, n_bytes: int = 16) -> Column:
    """The first bytes of a value, as hex, for reports."""
    return hex_lower(F.substring(value, 1, n_bytes))
