"""Positions of leaves in bundles and the object names of the tiled layout."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from merklake.constants import ENTRIES_DIR, TILE_DIR, TILE_HEIGHT, TILE_WIDTH

PART_BITS = 12
WIDE = "decimal(38,0)"

# Three-digit groups, an x before all but the last, and the width of a partial object.
INDEX_PATTERN = r"^((?:x[0-9]{3}/)*[0-9]{3})(?:\.p/([0-9]{1,3}))?$"


def bundle_of(index: Column) -> Column:
    return F.shiftright(index, TILE_HEIGHT)


def wide_bundle_of(index: Column) -> Column:
    """As `bundle_of`, exact for decimal numbers too, which 64 bits need not hold."""
    index = index.cast(WIDE)
    return ((index - F.pmod(index, F.lit(TILE_WIDTH))) / TILE_WIDTH).cast(WIDE)


def part_of(bundle: Column) -> Column:
    """Directory of a stored bundle or tile: one per 4,096 of them, about a million leaves."""
    return F.shiftright(bundle, PART_BITS)


def slot_of(index: Column) -> Column:
    return index.bitwiseAND(F.lit(TILE_WIDTH - 1)).cast("bigint")


def leaf_index(bundle: Column, slot: Column) -> Column:
    return bundle * TILE_WIDTH + slot


def partial_width(bundle: Column, size: Column) -> Column:
    """Rows in the last, partial object; 0 stands for a full one."""
    return F.when(bundle == F.shiftright(size, TILE_HEIGHT), size % TILE_WIDTH).otherwise(F.lit(0)).cast("int")


def wide_partial_width(bundle: Column, size: Column) -> Column:
    """As `partial_width`, for a bundle of `wide_bundle_of`."""
    return F.when(bundle == wide_bundle_of(size), size % TILE_WIDTH).otherwise(F.lit(0)).cast("int")


def expected_width(bundle: Column, size: Column) -> Column:
    """Rows an object must hold in a log of that size; 0 when the log does not reach it."""
    return F.greatest(F.lit(0), F.least(F.lit(TILE_WIDTH), size - bundle * TILE_WIDTH)).cast("int")


def index_path(index: Column, partial: Column) -> Column:
    digits = index.cast("string")
    padded = F.lpad(digits, F.ceil(F.length(digits) / 3).cast("int") * 3, F.lit("0"))
    grouped = F.regexp_replace(padded, r"([0-9]{3})(?=[0-9])", "x$1/")
    suffix = F.when(partial > 0, F.concat(F.lit(".p/"), partial.cast("string"))).otherwise(F.lit(""))
    return F.concat(grouped, suffix)


def entries_path(bundle: Column, partial: Column) -> Column:
    return F.concat(F.lit(ENTRIES_DIR), index_path(bundle, partial))


def entries_path_for_leaf(index: Column, size: Column) -> Column:
    """Of a leaf index and a log size of any integer or decimal type."""
    bundle = wide_bundle_of(index)
    return entries_path(bundle, wide_partial_width(bundle, size))


def tile_path(level: Column, index: Column, partial: Column) -> Column:
    return F.concat(F.lit(TILE_DIR), level.cast("string"), F.lit("/"), index_path(index, partial))


def parse_index_path(text: Column) -> Column:
    """STRUCT<index, partial> of the part after the directory; a null index marks a bad path."""
    width = F.regexp_extract(text, INDEX_PATTERN, 2)
    partial = F.when(width == "", F.lit(0)).otherwise(width.try_cast("int"))
    digits = F.regexp_replace(F.regexp_extract(text, INDEX_PATTERN, 1), "[x/]", "")
    good = text.rlike(INDEX_PATTERN) & partial.between(0, TILE_WIDTH - 1) & ~((width != "") & (partial == 0))
    return F.struct(
        F.when(good, digits.try_cast("bigint")).alias("index"),
        F.when(good, partial).alias("partial"),
    )


def parse_entries_path(path: Column) -> Column:
    """As `parse_index_path`, for a whole path; other objects than entry bundles give nulls."""
    return parse_index_path(
        F.when(
            F.startswith(path, F.lit(ENTRIES_DIR)),
            F.regexp_replace(path, "^" + ENTRIES_DIR, ""),
        ).otherwise(F.lit(""))
    )
