"""Fixed values of the log layout. They must equal the public formats, so do not tune them."""

# Entry bundles and hash tiles hold this many rows; a tile spans this many tree levels.
TILE_WIDTH = 256
TILE_HEIGHT = 8

# SHA-256 digests, and their split into the index prefix and suffix.
DIGEST_BYTES = 32
PREFIX_BYTES = 2
PREFIX_HEX = 4
SUFFIX_BYTES = 30

# RFC 6962 domain separation.
LEAF_TAG = b"\x00"
NODE_TAG = b"\x01"

# A bundle entry carries its length in two bytes.
MAX_ENTRY_BYTES = 65535

# Limit of a stored object's metadata, keys and values together.
METADATA_LIMIT_BYTES = 8192

# Object names.
CHECKPOINT_PATH = "checkpoint"
ENTRIES_DIR = "tile/entries/"
TILE_DIR = "tile/"
FROZEN_TIME_KEY = "TimestampNanos"

# Largest magnitudes of a 64-bit integer in base 36.
INT64_MAX_BASE36 = "1y2p0ij32e8e7"
INT64_MIN_BASE36 = "1y2p0ij32e8e8"
