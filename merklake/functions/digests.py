"""Split of a leaf hash into the four-digit prefix and the rest."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from merklake.constants import DIGEST_BYTES, PREFIX_BYTES, SUFFIX_BYTES
from merklake.functions.hashing import hex_lower


def is_digest(value: Column) -> Column:
    return F.coalesce(F.length(value) == DIGEST_BYTES, F.lit(False))


def prefix(digest: Column) -> Column:
    return hex_lower(F.substring(digest, 1, PREFIX_BYTES))


def suffix(digest: Column) -> Column:
    return F.substring(digest, PREFIX_BYTES + 1, SUFFIX_BYTES)
