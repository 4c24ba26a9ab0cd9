"""Explicit schemas of the stored tables and of the request tables. Nothing is inferred."""

from pyspark.sql import types as T

_LONG, _INT, _STR, _BIN = T.LongType(), T.IntegerType(), T.StringType(), T.BinaryType()


def _struct(*fields):
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


METADATA = T.MapType(_STR, _STR)

REGISTRY = _struct(("log_id", _LONG), ("frozen_time_nanos", _LONG), ("location", _STR))

LEAVES = _struct(
    ("log_id", _LONG),
    ("leaf_index", _LONG),
    ("leaf_value", _BIN),
    ("merkle_leaf_hash", _BIN),
    ("queue_ts_nanos", _LONG),
    ("integrate_ts_nanos", _LONG),
)

CHECKPOINTS = _struct(
    ("log_id", _LONG),
    ("origin", _STR),
    ("tree_size", _LONG),
    ("root_hash", _BIN),
    ("frozen_time_nanos", _LONG),
)

BUNDLES = _struct(
    ("log_id", _LONG),
    ("bundle_index", _LONG),
    ("width", _INT),
    ("oversize", _LONG),
    ("bytes", _BIN),
    ("metadata", METADATA),
)

# Bundles and path tiles are stored in directories by log and part.
STORED_BUNDLES = T.StructType([*BUNDLES.fields, T.StructField("part", _LONG)])

HASH_TILES = _struct(
    ("log_id", _LONG), ("tile_index", _LONG), ("width", _INT), ("hashes", _BIN), ("tile_level", _INT)
)

_CHAIN = T.ArrayType(_struct(("level", _INT), ("own", _BIN), ("sib", _BIN)))
PATHS = _struct(
    ("log_id", _LONG),
    ("tile_index", _LONG),
    ("width", _INT),
    ("levels", T.ArrayType(T.ArrayType(_BIN))),
    ("upper", _CHAIN),
)

# Tables of a store are written by generation; a log's row in the manifest says which rows of each are its own. `until`: the size at
# which the next generation begins; `patch`: the chain of the leaf of that index in the tree as it is now.
_GENERATION = _struct(("generation", _STR), ("until", _LONG), ("patch", _CHAIN))
MANIFEST = T.StructType(
    [*CHECKPOINTS.fields, T.StructField("version", _LONG), T.StructField("generations", T.ArrayType(_GENERATION))]
)
# What a directory of a generation holds: rows, and sums of two hashes of each.
RECORDS = _struct(
    ("log_id", _LONG), ("generation", _STR), ("stored_table", _STR), ("directory", _STR), ("rows", _LONG),
    ("sum_a", T.DecimalType(30, 0)), ("sum_b", T.DecimalType(30, 0)),
)
# Hashes of the incomplete tiles at the right edge, one row per tile level of a log.
FRONTIER = _struct(("tile_level", _INT), ("width", _INT), ("hashes", _BIN), ("log_id", _LONG))

HASH_INDEX = _struct(("log_id", _LONG), ("prefix", _STR), ("suffix", _BIN), ("leaf_index", _LONG))
STORED_INDEX = _struct(
    ("prefix", _STR), ("suffix", _BIN), ("leaf_index", _LONG), ("log_id", _LONG), ("prefix_dir", _STR)
)

OBJECTS = _struct(("path", _STR), ("bytes", _BIN))
OBJECT_METADATA = _struct(("path", _STR), ("metadata", METADATA), ("version", _LONG))

STORED_PATHS = T.StructType([*PATHS.fields, T.StructField("part", _LONG)])

# Request tables, one per call. request_id must be unique within a batch.
REQUESTS = {
    "inclusion_proof": _struct(
        ("request_id", _LONG), ("log_id", _LONG), ("leaf_index", _LONG), ("tree_size", _LONG)
    ),
    "inclusion_proof_by_hash": _struct(
        ("request_id", _LONG), ("log_id", _LONG), ("leaf_hash", _BIN), ("tree_size", _LONG)
    ),
    "consistency_proof": _struct(
        ("request_id", _LONG), ("log_id", _LONG), ("first_tree_size", _LONG), ("second_tree_size", _LONG)
    ),
    "latest_root": _struct(("request_id", _LONG), ("log_id", _LONG), ("first_tree_size", _LONG)),
    "entry_and_proof": _struct(
        ("request_id", _LONG), ("log_id", _LONG), ("leaf_index", _LONG), ("tree_size", _LONG)
    ),
    "leaves_by_range": _struct(
        ("request_id", _LONG), ("log_id", _LONG), ("start_index", _LONG), ("count", _LONG)
    ),
}
