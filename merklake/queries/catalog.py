"""All registered queries: name to (spark, sf_dir) -> DataFrame."""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from merklake.constants import MAX_ENTRY_BYTES, METADATA_LIMIT_BYTES
from merklake.functions import base36, checkpoints, paths, timestamps
from merklake.functions.hashing import hex_lower, hex_preview, leaf_hash, leaf_hash_hex
from merklake.operators import bundles, checks, compare, hashindex, joins, merkle, proofs
from merklake.plans import migrate, selfcheck, store, validate
from merklake.plans.answer import answer
from merklake.queries import inputs
from merklake.schemas import LEAVES, RECORDS, REQUESTS
from merklake.sources import logs, objects, registry
from merklake.sources.scratch import materialize, new_location
from merklake.streaming import arrivals

QUERIES = {}


def query(function, name=None):
    QUERIES[name or function.__name__] = function
    return function


def _hex_list(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, hex_lower), ",")


def _flat(responses: DataFrame) -> DataFrame:
    """Responses in plain columns: hashes as hex text, the root in three columns."""
    out = []
    for name, kind in responses.dtypes:
        if name == "root":
            out += [
                F.col("root.tree_size").alias("root_size"),
                hex_lower(F.col("root.root_hash")).alias("root_hash"),
                F.col("root.timestamp_nanos").alias("root_time"),
            ]
        elif kind == "array<binary>":
            out.append(_hex_list(F.col(name)).alias(name))
        elif name == "leaf_value":
            out.append(F.length(name).cast("bigint").alias("value_bytes"))
        elif kind == "binary":
            out.append(hex_lower(F.col(name)).alias(name))
        else:
            out.append(F.col(name))
    return responses.select(*out)


def _hashed(spark, sf_dir) -> DataFrame:
    return logs.with_leaf_hash(logs.both_logs(spark, sf_dir))


def _sha(value: Column) -> Column:
    return F.sha2(value, 256)


# Registry


@query
def registry_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry from configuration entries; the first registration of a log wins; bad entries have a code."""
    suppliers = logs.read_table(spark, sf_dir, "supplier")
    customers = logs.read_table(spark, sf_dir, "customer")

    def entries(df, key, name, order):
        frozen = F.col(key) * 1000003
        return df.select(
            F.lit(order).alias("position"),
            F.when(F.col(key) % 10 == 9, F.concat(F.lit("log-"), F.col(key).cast("string")))
            .otherwise(F.col(key).cast("string"))
            .alias("key"),
            F.to_json(F.struct(frozen.alias("frozenTime"), F.col(name).alias("bucketName"))).alias("value"),
        )

    parsed = registry.from_entries(
        entries(suppliers, "s_suppkey", "s_name", 1).unionByName(entries(customers, "c_custkey", "c_name", 2))
    )
    known = registry.first_registered(parsed.where("error_code is null").drop("key", "error_code"), "position")
    asked = logs.read_table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey").alias("log_id")
    )
    return joins.small_join(asked, known, ["log_id"]).select(
        "l_orderkey",
        "l_linenumber",
        "log_id",
        "frozen_time_nanos",
        "location",
        F.when(F.col("location").isNull(), F.lit(checks.INVALID)).otherwise(F.lit(checks.OK)).alias("status"),
    )


@query
def registry_errors(spark, sf_dir):
    """Configuration entries with keys that are no log id or values that are no configuration."""
    customers = logs.read_table(spark, sf_dir, "customer")
    key = (
        F.when(F.col("c_nationkey") % 5 == 0, F.concat(F.lit("+"), F.col("c_custkey").cast("string")))
        .when(F.col("c_nationkey") % 5 == 1, F.col("c_name"))
        .when(F.col("c_nationkey") % 5 == 2, F.lit("9223372036854775808"))
        .otherwise(F.col("c_custkey").cast("string"))
    )
    value = F.when(F.col("c_nationkey") % 5 == 3, F.lit("{}")).otherwise(
        F.to_json(F.struct(F.col("c_custkey").alias("frozenTime"), F.col("c_mktsegment").alias("bucketName")))
    )
    out = registry.from_entries(customers.select("c_custkey", key.alias("key"), value.alias("value")))
    return out.select("c_custkey", "key", "log_id", "frozen_time_nanos", "location", "error_code")


# Functions


def _leaf_hash(spark, sf_dir):
    leaves = logs.both_logs(spark, sf_dir)
    return leaves.select("log_id", "leaf_index", leaf_hash_hex(F.col("leaf_value")).alias("leaf_hash"))


query(_leaf_hash, "leaf_hash")


@query
def leaf_range_scan(spark, sf_dir):
    """Leaves stored as a table and read back by index range, here the whole of it."""
    location = new_location(spark, "leaves")
    leaves = _hashed(spark, sf_dir).select(*LEAVES.names)
    leaves.sortWithinPartitions("log_id", "leaf_index").write.parquet(location)
    size = leaves.agg((F.max("leaf_index") + 1).alias("n")).first()["n"] or 0
    return logs.read_leaves(spark, location, 0, size).select(
        "log_id",
        "leaf_index",
        F.length("leaf_value").cast("bigint").alias("value_bytes"),
        hex_lower(F.col("merkle_leaf_hash")).alias("merkle_leaf_hash"),
        "queue_ts_nanos",
        "integrate_ts_nanos",
    )


@query
def value_preview(spark, sf_dir):
    leaves = logs.both_logs(spark, sf_dir)
    return leaves.select("log_id", "leaf_index", hex_preview(F.col("leaf_value")).alias("preview"))


@query
def bundle_offsets(spark, sf_dir):
    leaves = logs.both_logs(spark, sf_dir).select("log_id", "leaf_index")
    bundle, slot = paths.bundle_of(F.col("leaf_index")), paths.slot_of(F.col("leaf_index"))
    return leaves.select(
        "*", bundle.alias("bundle_index"), slot.alias("slot"), paths.leaf_index(bundle, slot).alias("back")
    )


@query
def object_paths(spark, sf_dir):
    """Names of bundles and tiles for indices up to many groups of digits, with full and partial widths. Indices are decimals,
    as in a large table 64 bits do not hold them."""
    orders = logs.read_table(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast(paths.WIDE)
    index = key * key * F.col("o_custkey")
    size = index + F.col("o_custkey") % 300 + 1
    bundle = paths.wide_bundle_of(index)
    return orders.select(
        "o_orderkey",
        paths.entries_path_for_leaf(index, size).alias("entries_path"),
        paths.tile_path(F.col("o_custkey") % 6, bundle, paths.wide_partial_width(bundle, size)).alias("tile_path"),
    )


def _some_paths(spark, sf_dir) -> DataFrame:
    orders = logs.read_table(spark, sf_dir, "orders")
    key, kind = F.col("o_orderkey"), F.col("o_custkey") % 8
    good = paths.index_path(key * 977, F.lit(0))
    text = (
        F.when(kind == 0, F.concat(F.lit("tile/entries/"), good))
        .when(kind == 1, F.concat(F.lit("tile/entries/"), good, F.lit(".p/"), (key % 300).cast("string")))
        .when(kind == 2, F.concat(F.lit("tile/0/"), good))
        .when(kind == 3, F.concat(F.lit("tile/entries/"), key.cast("string")))
        .when(kind == 4, F.concat(F.lit("tile/entries/x"), good))
        .when(kind == 5, F.concat(F.lit("tile/entries/"), good, F.lit(".p/")))
        .when(kind == 6, F.lit("checkpoint"))
        .otherwise(F.concat(F.lit("tile/entries/"), F.lpad((key % 1000).cast("string"), 3, "0")))
    )
    return orders.select("o_orderkey", text.alias("path"))


@query
def path_parse(spark, sf_dir):
    at = paths.parse_entries_path(F.col("path"))
    return _some_paths(spark, sf_dir).select("*", at["index"].alias("index"), at["partial"].alias("partial"))


@query
def base36_roundtrip(spark, sf_dir):
    leaves = logs.both_logs(spark, sf_dir)
    queue, offset = F.col("queue_ts_nanos"), F.col("integrate_ts_nanos") - F.col("queue_ts_nanos")
    return leaves.select(
        "log_id",
        "leaf_index",
        base36.encode(queue).alias("queue_text"),
        base36.encode(offset).alias("offset_text"),
        base36.decode(base36.encode(queue)).alias("queue_back"),
        base36.decode(base36.encode(offset)).alias("offset_back"),
    )


@query
def base36_decode(spark, sf_dir):
    """Text that is base 36, text that is not, signs, leading zeros, and numbers past 64 bits."""
    documents = logs.read_table(spark, sf_dir, "documents")
    kind, key = F.col("doc_id") % 7, F.col("doc_id").cast("string")
    text = (
        F.when(kind == 0, F.concat("lang", key))
        .when(kind == 1, F.concat(F.lit("-"), "lang", key))
        .when(kind == 2, F.concat(F.lit("+000"), F.upper("lang"), key))
        .when(kind == 3, F.concat("lang", F.lit("!"), key))
        .when(kind == 4, F.concat(F.lit("zzzzzzzzzzzz"), key))
        .when(kind == 5, F.lit(""))
        .otherwise(F.concat(F.lit("1y2p0ij32e8e"), F.substring(key, 1, 1)))
    )
    return documents.select("doc_id", text.alias("text")).withColumn("number", base36.decode(F.col("text")))


@query
def nanos_timestamps(spark, sf_dir):
    leaves = logs.both_logs(spark, sf_dir)
    queue = F.col("queue_ts_nanos")
    stamp, rest = timestamps.as_timestamp(queue), timestamps.sub_micros(queue)
    return leaves.select(
        "log_id",
        "leaf_index",
        F.unix_micros(stamp).alias("micros"),
        rest.alias("rest"),
        timestamps.from_timestamp(stamp, rest).alias("back"),
    )


# Timestamp metadata


def _metadata_text(metadata: Column) -> Column:
    return F.array_join(F.transform(F.map_entries(metadata), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")


@query
def ts_metadata_build(spark, sf_dir):
    built = bundles.timestamp_pairs(logs.both_logs(spark, sf_dir))
    return built.select("log_id", "bundle_index", "width", _metadata_text(F.col("metadata")).alias("metadata"))


@query
def metadata_size(spark, sf_dir):
    built = bundles.timestamp_pairs(logs.both_logs(spark, sf_dir))
    size = timestamps.byte_size(F.col("metadata"))
    return built.select(
        "log_id", "bundle_index", size.alias("metadata_bytes"), (size <= METADATA_LIMIT_BYTES).alias("within_limit")
    )


@query
def ts_metadata_parse(spark, sf_dir):
    built = bundles.timestamp_pairs(logs.both_logs(spark, sf_dir))
    slots = F.sequence(F.lit(0), F.col("width") - 1)
    parsed = F.transform(
        slots, lambda slot: F.struct(slot.alias("slot"), timestamps.parse(F.col("metadata"), slot).alias("times"))
    )
    return built.select("log_id", "bundle_index", F.explode(parsed).alias("leaf")).select(
        "log_id",
        paths.leaf_index(F.col("bundle_index"), F.col("leaf.slot")).alias("leaf_index"),
        "leaf.times.queue_ts_nanos",
        "leaf.times.integrate_ts_nanos",
        "leaf.times.error_code",
    )


@query
def ts_metadata_errors(spark, sf_dir):
    """Good and bad metadata values; slot 10 is asked for, key "a"."""
    orders = logs.read_table(spark, sf_dir, "orders")
    kind, number = F.col("o_custkey") % 6, base36.encode(F.col("o_orderkey"))
    key = F.when(kind == 0, F.lit("b")).otherwise(F.lit("a"))
    value = (
        F.when(kind == 1, F.concat(number, number))
        .when(kind == 2, F.concat(F.lit("not@valid "), number))
        .when(kind == 3, F.concat(number, F.lit(" 12 3")))
        .when(kind == 4, F.concat(number, F.lit(" -"), number))
        .otherwise(F.concat(number, F.lit(" "), number))
    )
    times = timestamps.parse(F.create_map(key, value), F.lit(10))
    return orders.select(
        "o_orderkey",
        times["queue_ts_nanos"].alias("queue_ts_nanos"),
        times["integrate_ts_nanos"].alias("integrate_ts_nanos"),
        times["error_code"].alias("error_code"),
    )


@query
def metadata_attach(spark, sf_dir):
    """Metadata looked up by object name; bundle 1's name promises a width it does not have."""
    leaves = logs.both_logs(spark, sf_dir)
    pairs = bundles.timestamp_pairs(leaves)
    partial = F.when(F.col("width") == 256, F.lit(0)).otherwise(F.col("width"))
    entries = pairs.select(
        "log_id",
        paths.entries_path(
            F.col("bundle_index"), F.when(F.col("bundle_index") == 1, F.lit(9)).otherwise(partial)
        ).alias("path"),
    )
    tiles = pairs.select("log_id", paths.tile_path(F.lit(0), F.col("bundle_index"), partial).alias("path"))
    beyond = pairs.select("log_id", paths.entries_path(F.col("bundle_index") + 1_000_000, F.lit(0)).alias("path"))
    broken = pairs.select("log_id", F.concat(F.lit("tile/entries/q"), F.col("bundle_index").cast("string")).alias("path"))
    named = entries.unionByName(tiles).unionByName(beyond).unionByName(broken)
    return bundles.attach_metadata(named, pairs).select(
        "log_id", "path", F.size("metadata").alias("entries"), timestamps.byte_size(F.col("metadata")).alias("metadata_bytes"), "error_code"
    )


# Bundles


@query
def bundle_encode(spark, sf_dir):
    encoded = bundles.encode(logs.both_logs(spark, sf_dir))
    return encoded.select(
        "log_id",
        "bundle_index",
        "width",
        "oversize",
        F.length("bytes").alias("n_bytes"),
        _sha(F.col("bytes")).alias("bytes_sha256"),
    )


@query
def bundle_decode(spark, sf_dir):
    decoded = bundles.decode(bundles.encode(logs.both_logs(spark, sf_dir)))
    return decoded.select(
        "log_id",
        "bundle_index",
        "leaf_index",
        F.length("leaf_value").cast("bigint").alias("value_bytes"),
        hex_lower(F.col("merkle_leaf_hash")).alias("merkle_leaf_hash"),
        "queue_ts_nanos",
        "integrate_ts_nanos",
        "error_code",
    )


# Trees


def _tile_rows(tiles: DataFrame) -> DataFrame:
    return tiles.select("log_id", "tile_level", "tile_index", "width", _sha(F.col("hashes")).alias("hashes_sha256"))


@query
def tiles_level0(spark, sf_dir):
    tree = merkle.build_tree(_hashed(spark, sf_dir))
    return _tile_rows(merkle.Tree(tree.tiles[:1]).hash_tiles())


@query
def tiles_all(spark, sf_dir):
    return _tile_rows(merkle.build_tree(_hashed(spark, sf_dir)).hash_tiles())


@query
def merkle_root(spark, sf_dir):
    roots = merkle.build_tree(_hashed(spark, sf_dir)).roots()
    return roots.select("log_id", "tree_size", hex_lower(F.col("root_hash")).alias("root_hash"))


@query
def prefix_roots(spark, sf_dir):
    """The root of every size that either log ever had."""
    tree = merkle.build_tree(_hashed(spark, sf_dir))
    every = proofs.prefix_roots(tree.paths(), tree.roots())
    return every.select("log_id", "tree_size", hex_lower(F.col("root_hash")).alias("root_hash"))


@query
def adjacent_consistency(spark, sf_dir):
    """A consistency proof from every size of both logs to the next, each verified against the roots of both sizes."""
    tree = merkle.build_tree(_hashed(spark, sf_dir))
    known = proofs.prefix_roots(tree.paths(), tree.roots())
    verified = proofs.verify_adjacent(proofs.adjacent_consistency(tree.paths()), known)
    return verified.withColumn("hashes", _hex_list(F.col("hashes")))


@query
def adjacent_consistency_faults(spark, sf_dir):
    """Adjacent proofs of both logs against the roots of a copy with changed values: how many sizes fail, from which on.

    A proof from a power of two builds on the old root it is given, so there it shows the added leaf alone, which the copy has too.
    """
    leaves = logs.both_logs(spark, sf_dir)
    tree = merkle.build_tree(logs.with_leaf_hash(leaves))
    copy = merkle.build_tree(logs.with_leaf_hash(inputs.value_faults(leaves)))
    verified = proofs.verify_adjacent(proofs.adjacent_consistency(tree.paths()), proofs.prefix_roots(copy.paths(), copy.roots()))
    failed = F.array_compact(F.array(F.when(~F.col("first_ok"), "FIRST_ROOT_DIFFERS"), F.when(~F.col("second_ok"), "SECOND_ROOT_DIFFERS")))
    return verified.select("log_id", "first_tree_size", F.explode(failed).alias("error_code")).groupBy("log_id", "error_code").agg(
        F.count("*").alias("sizes"), F.min("first_tree_size").alias("first_size")
    )


@query
def prefix_root_lookup(spark, sf_dir):
    """Roots of the sizes that requests ask for; sizes no log had, and unknown logs, have none."""
    tree = merkle.build_tree(_hashed(spark, sf_dir))
    asked = inputs.by_index(spark, sf_dir).select("request_id", "log_id", "tree_size")
    found = proofs.roots_at(asked, tree.paths(), materialize(tree.roots(), "roots"))
    return found.withColumn("root_hash", hex_lower(F.col("root_hash")))


@query
def root_verify(spark, sf_dir):
    """Roots of a copy with changed values against the source's."""
    leaves = logs.both_logs(spark, sf_dir)
    source = merkle.build_tree(logs.with_leaf_hash(leaves)).roots()
    copy = merkle.build_tree(logs.with_leaf_hash(inputs.value_faults(leaves).where("log_id = 2").unionByName(
        leaves.where("log_id = 1")
    ))).roots()
    verified = compare.verify_roots(copy, source)
    return verified.select(
        "log_id",
        "expected_size",
        hex_lower(F.col("expected_root")).alias("expected_root"),
        "actual_size",
        hex_lower(F.col("actual_root")).alias("actual_root"),
        "ok",
    )


def _logs(spark, sf_dir) -> DataFrame:
    return store.store_from_leaves(logs.both_logs(spark, sf_dir), ()).logs


@query
def checkpoint_text(spark, sf_dir):
    text = checkpoints.render(F.col("origin"), F.col("tree_size"), F.col("root_hash"))
    return _logs(spark, sf_dir).select("log_id", text.alias("checkpoint"))


@query
def signed_log_root(spark, sf_dir):
    fields = [F.col(c) for c in ("tree_size", "root_hash", "frozen_time_nanos")]
    return _logs(spark, sf_dir).select(
        "log_id",
        "tree_size",
        "frozen_time_nanos",
        hex_lower(checkpoints.log_root_bytes(*fields)).alias("log_root"),
    )


@query
def checkpoint_parse(spark, sf_dir):
    """Checkpoint texts made from customers, good and bad."""
    customers = logs.read_table(spark, sf_dir, "customer")
    kind, key = F.col("c_nationkey") % 6, F.col("c_custkey").cast("string")
    root = F.unhex(F.sha2("c_name", 256))
    text = (
        F.when(kind == 0, F.concat_ws("\n", "c_name", key))
        .when(kind == 1, F.concat(F.lit("\n"), key, F.lit("\n"), F.base64(root), F.lit("\n")))
        .when(kind == 2, F.concat("c_name", F.lit("\n-"), key, F.lit("\n"), F.base64(root), F.lit("\n")))
        .when(kind == 3, F.concat("c_name", F.lit("\n"), key, F.lit("\n*not base64*\n")))
        .when(kind == 4, F.concat(checkpoints.render(F.col("c_name"), F.col("c_custkey"), root), F.lit("more\nlines\n")))
        .otherwise(checkpoints.render(F.col("c_name"), F.col("c_custkey"), root))
    )
    parsed = checkpoints.parse(F.col("text"))
    return customers.select("c_custkey", text.alias("text")).select(
        "c_custkey",
        parsed["origin"].alias("origin"),
        parsed["tree_size"].alias("tree_size"),
        hex_lower(parsed["root_hash"]).alias("root_hash"),
        parsed["error_code"].alias("error_code"),
    )


# Hash index


@query
def hash_index_build(spark, sf_dir):
    index = hashindex.build(_hashed(spark, sf_dir))
    return index.select("log_id", "prefix", hex_lower(F.col("suffix")).alias("suffix"), "leaf_index")


@query
def hash_index_stats(spark, sf_dir):
    return hashindex.stats(hashindex.build(_hashed(spark, sf_dir)))


@query
def distinct_prefixes(spark, sf_dir):
    return hashindex.prefixes(hashindex.build(_hashed(spark, sf_dir)))


@query
def index_integrity(spark, sf_dir):
    """Integrity of an index that also has records of a log shifted past its end."""
    leaves = _hashed(spark, sf_dir)
    index = hashindex.build(leaves)
    sizes = materialize(checks.completeness(leaves).select("log_id", "tree_size"), "sizes")
    shifted = index.where("log_id = 2").withColumn("leaf_index", F.col("leaf_index") * 2)
    return hashindex.integrity(index.where("log_id = 1").unionByName(shifted), sizes)


@query
def index_totals(spark, sf_dir):
    leaves = _hashed(spark, sf_dir)
    return hashindex.total_entries(hashindex.build(leaves), checks.completeness(leaves))


@query
def hash_lookup(spark, sf_dir):
    found = hashindex.lookup(
        inputs.by_hash(spark, sf_dir), hashindex.build(_hashed(spark, sf_dir)), F.col("leaf_hash")
    )
    return found.select("request_id", "log_id", "found_index")


@query
def prefix_exists(spark, sf_dir):
    index = hashindex.build(_hashed(spark, sf_dir))
    found = hashindex.prefix_exists(inputs.by_hash(spark, sf_dir), index, F.col("leaf_hash"))
    return found.select("request_id", "log_id", "prefix", "prefix_found")


@query
def membership(spark, sf_dir):
    index = hashindex.build(_hashed(spark, sf_dir))
    return hashindex.membership(inputs.by_hash(spark, sf_dir), index, F.col("leaf_hash")).select(
        "request_id", "log_id", "is_member"
    )


@query
def stored_index_lookup(spark, sf_dir):
    """The same lookup against the stored, partitioned index."""
    location = new_location(spark, "hash_index")
    index = hashindex.build(_hashed(spark, sf_dir))
    hashindex.write(index, location)
    stored = hashindex.read(spark, location)
    found = hashindex.lookup(inputs.by_hash(spark, sf_dir), stored, F.col("leaf_hash"))
    return found.select("request_id", "log_id", "found_index")


# Requests


def _answered(spark, sf_dir, kind, requests, parts, **options) -> DataFrame:
    served = store.store_from_leaves(logs.both_logs(spark, sf_dir), parts)
    return _flat(answer(requests, kind, served, **options))


@query
def inclusion_proof(spark, sf_dir):
    return _answered(spark, sf_dir, "inclusion_proof", inputs.by_index(spark, sf_dir), ("paths",))


@query
def inclusion_proof_requested_size(spark, sf_dir):
    return _answered(
        spark, sf_dir, "inclusion_proof", inputs.by_index(spark, sf_dir), ("paths",), mode="requested"
    )


@query
def inclusion_proof_by_hash(spark, sf_dir):
    return _answered(spark, sf_dir, "inclusion_proof_by_hash", inputs.by_hash(spark, sf_dir), ("paths", "index"))


@query
def inclusion_proofs_all_matches(spark, sf_dir):
    """A proof of every leaf that has the hash asked for, not of the first alone."""
    return _answered(spark, sf_dir, "inclusion_proof_by_hash", inputs.by_hash(spark, sf_dir), ("paths", "index"), all_matches=True)


@query
def consistency_proof(spark, sf_dir):
    return _answered(spark, sf_dir, "consistency_proof", inputs.consistency(spark, sf_dir), ("paths",))


@query
def latest_root(spark, sf_dir):
    return _answered(spark, sf_dir, "latest_root", inputs.latest(spark, sf_dir), ("paths",))


@query
def entry_and_proof(spark, sf_dir):
    return _answered(spark, sf_dir, "entry_and_proof", inputs.by_index(spark, sf_dir), ("paths", "bundles"))


@query
def leaves_by_range(spark, sf_dir):
    return _answered(spark, sf_dir, "leaves_by_range", inputs.ranges(spark, sf_dir), ("bundles",))


@query
def request_validation(spark, sf_dir):
    """Verdicts of all six calls."""
    sizes = checks.completeness(logs.both_logs(spark, sf_dir)).select("log_id", F.col("tree_size").alias("known_size"))
    sizes = materialize(sizes, "sizes")
    by_index = inputs.by_index(spark, sf_dir)
    batches = {
        "inclusion_proof": by_index,
        "inclusion_proof_by_hash": inputs.by_hash(spark, sf_dir),
        "consistency_proof": inputs.consistency(spark, sf_dir),
        "latest_root": inputs.latest(spark, sf_dir),
        "entry_and_proof": by_index,
        "leaves_by_range": inputs.ranges(spark, sf_dir),
    }
    out = None
    for kind, requests in batches.items():
        names = [f.name for f in REQUESTS[kind] if f.name not in ("request_id", "log_id")]
        for k, name in enumerate(names):  # each argument is null in one row of 13
            requests = requests.withColumn(name, F.when(F.col("request_id") % 13 != 3 + k, F.col(name)))
        checked = checks.validate(joins.small_join(requests, sizes, ["log_id"]), kind)
        part = checked.select(F.lit(kind).alias("kind"), "request_id", "log_id", "status", "reason")
        out = part if out is None else out.unionByName(part)
    return out


@query
def proof_missing_tile(spark, sf_dir):
    """Requests to a store without the second tile of any log: no proof that needs it is given."""
    whole = store.store_from_leaves(logs.both_logs(spark, sf_dir), ("paths",))
    cut = store.LogStore(logs=whole.logs, paths=materialize(whole.paths.where("tile_index != 1"), "cut_paths"))
    by_index = inputs.by_index(spark, sf_dir)
    answers = {
        "inclusion": answer(by_index, "inclusion_proof", cut),
        "inclusion_requested": answer(by_index, "inclusion_proof", cut, mode="requested"),
        "consistency": answer(inputs.consistency(spark, sf_dir), "consistency_proof", cut),
        "latest": answer(inputs.latest(spark, sf_dir), "latest_root", cut),
    }
    out = None
    for kind, rows in answers.items():
        part = rows.select(
            F.lit(kind).alias("kind"), "request_id", "status", "reason",
            ((F.col("status") == "INTERNAL") & F.col("hashes").isNull() & F.col("root").isNull()).alias("without_proof"),
        )
        out = part if out is None else out.unionByName(part)
    return out


@query
def all_inclusion_proofs(spark, sf_dir):
    """Proof of every leaf of both logs."""
    every = proofs.all_inclusion_proofs(merkle.build_tree(_hashed(spark, sf_dir)).paths())
    return every.select("log_id", "leaf_index", hex_lower(F.col("leaf_hash")).alias("leaf_hash"), _hex_list(F.col("hashes")).alias("hashes"))


@query
def proof_verify(spark, sf_dir):
    """Every proof led back to a root and compared with the log's."""
    tree = merkle.build_tree(_hashed(spark, sf_dir))
    every = joins.small_join(proofs.all_inclusion_proofs(tree.paths()), materialize(tree.roots(), "roots"), ["log_id"])
    led = proofs.root_from_inclusion(F.col("leaf_index"), F.col("tree_size"), F.col("leaf_hash"), F.col("hashes"))
    return every.groupBy("log_id").agg(
        F.count("*").alias("proofs"), F.count_if(led == F.col("root_hash")).alias("verified")
    )


# Input checks


@query
def migration_bounds(spark, sf_dir):
    orders = logs.read_table(spark, sf_dir, "orders")
    sources = orders.select(
        F.col("o_orderkey").alias("log_id"),
        F.col("o_custkey").alias("tree_size"),
        (F.col("o_orderkey") % 2000 - 3).alias("finish"),
    )
    return checks.migration_bounds(sources)


@query
def leaf_quarantine(spark, sf_dir):
    """Leaves made from conversations, with missing, short and long hashes and missing values."""
    turns = logs.read_table(spark, sf_dir, "conversations")
    kind = (F.col("conv_id") + F.col("turn")) % 6
    digest = leaf_hash(F.col("text").cast("binary"))
    leaves = turns.select(
        F.col("conv_id").alias("log_id"),
        F.when(kind == 5, -F.col("turn") - 1).otherwise(F.col("turn")).alias("leaf_index"),
        F.when(kind != 4, F.col("text").cast("binary")).alias("leaf_value"),
        F.when(kind == 0, F.lit(bytearray(b"")))
        .when(kind == 1, F.substring(digest, 1, 31))
        .when(kind == 2, F.concat(digest, F.lit(bytearray(b"x"))))
        .otherwise(digest)
        .alias("merkle_leaf_hash"),
    )
    found = checks.leaf_findings(leaves)
    return found.select("log_id", "leaf_index", "error_code")


def _sparse_log(spark, sf_dir) -> DataFrame:
    """Lineitem keyed by order as a log: with gaps, and indices that occur many times."""
    return logs.read_table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 2).alias("log_id"), F.col("l_orderkey").alias("leaf_index")
    )


@query
def completeness(spark, sf_dir):
    sizes = logs.read_table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 3).alias("log_id")).agg(
        (F.max("o_orderkey") + 1).alias("tree_size")
    )
    return checks.completeness(_sparse_log(spark, sf_dir), sizes)


@query
def completeness_gaps(spark, sf_dir):
    """Every missing index; log 2 has no leaf at all."""
    sizes = logs.read_table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 3).alias("log_id")).agg(
        (F.max("o_orderkey") + 1).alias("tree_size")
    )
    found = checks.gaps(_sparse_log(spark, sf_dir), sizes)
    return found.select(
        "log_id", "bundle_index", "missing", "first_missing", "last_missing", F.array_join("indices", ",").alias("indices")
    )


# Comparison


@query
def compare_leaves(spark, sf_dir):
    leaves = logs.both_logs(spark, sf_dir)
    return compare.compare_leaves(leaves, inputs.faulty_copy(leaves))


@query
def compare_leaves_strict(spark, sf_dir):
    leaves = logs.both_logs(spark, sf_dir)
    return compare.compare_leaves(leaves, inputs.faulty_copy(leaves), strict=True)


@query
def diff_counts(spark, sf_dir):
    leaves = logs.both_logs(spark, sf_dir)
    return compare.difference_counts(compare.compare_leaves(leaves, inputs.faulty_copy(leaves)))


@query
def growing_completeness(spark, sf_dir):
    """Both logs as a stream: progress when some leaves are late, when these have come too, and after a start without news."""
    leaves = logs.both_logs(spark, sf_dir).select("log_id", "leaf_index")
    source, seen, place = (new_location(spark, name) for name in ("arrivals", "arrived", "arrivals_place"))
    expected = materialize(checks.completeness(leaves).select("log_id", "tree_size"), "expected")
    late = F.col("leaf_index") % 1009 == 1000
    steps = []
    for step, come in enumerate([leaves.where(~late), leaves.where(late), None]):
        if come is not None:
            come.write.mode("append").parquet(source)
        arrivals.watch(spark.readStream.schema(leaves.schema).parquet(source), seen, place)
        # Written out, as the next step adds to what it reads.
        now = materialize(arrivals.progress(spark, seen, expected), "progress")
        steps.append(now.select(F.lit(step).alias("step"), *now.columns))
    return reduce(DataFrame.unionByName, steps)


@query
def compare_proofs(spark, sf_dir):
    """Proofs of all leaves of both logs and of a copy with changed values, one proof in 50 taken away."""
    leaves = logs.both_logs(spark, sf_dir)

    def every(df):
        tree = merkle.build_tree(logs.with_leaf_hash(df))
        return proofs.all_inclusion_proofs(tree.paths()).select(
            "log_id", "leaf_index", F.col("leaf_index").alias("proof_index"), "hashes"
        )

    copy = every(inputs.value_faults(leaves)).where("leaf_index % 50 <> 3").select(
        "log_id",
        "leaf_index",
        F.when(F.col("leaf_index") % 50 == 4, F.col("proof_index") + 1).otherwise(F.col("proof_index")).alias("proof_index"),
        F.when(F.col("leaf_index") % 50 == 5, F.slice("hashes", 1, 2)).otherwise(F.col("hashes")).alias("hashes"),
    )
    return compare.compare_proofs(every(leaves), copy)


@query
def validate_copy(spark, sf_dir):
    """A whole validation: leaves, lookups and proofs. Counts per kind of difference."""
    leaves = logs.both_logs(spark, sf_dir)
    changed = inputs.value_faults(leaves.where("log_id = 2")).unionByName(leaves.where("log_id = 1"))
    return compare.difference_counts(validate.validate_copy(leaves, changed))


@query
def validate_faulty_copy(spark, sf_dir):
    """Both logs against a copy with leaves dropped, doubled and changed: findings, and no proofs of what is no whole log."""
    leaves = logs.both_logs(spark, sf_dir)
    return compare.difference_counts(validate.validate_copy(leaves, inputs.faulty_copy(leaves)))


# Objects and migration


@query
def validate_store(spark, sf_dir):
    """The migrated store with faults planted in every table, against the leaves: differences by log and field. Expected are
    all logs but those that the migration itself reports as left out (`migrate_findings`)."""
    done, location = _migrated(spark, sf_dir)
    leaves = logs.both_logs(spark, sf_dir)
    expected = leaves.groupBy("log_id").agg((F.max("leaf_index") + 1).alias("tree_size")).join(done.findings, "log_id", "left_anti")
    stored = store.read_stored(spark, location)
    faulty = store.StoredTables(
        checkpoints=stored.checkpoints.withColumn("root_hash", F.when(F.col("log_id") == 1, F.reverse(F.hex("root_hash")).cast("binary")).otherwise(F.col("root_hash"))),
        bundles=stored.bundles.where("bundle_index % 5 != 1"),
        tiles=stored.tiles.where("tile_level != 0 or tile_index % 3 != 2"),
        paths=stored.paths.where("tile_index % 7 != 3"),
        index=stored.index.where("leaf_index % 97 != 5"),
    )
    return compare.difference_counts(validate.validate_store(leaves, faulty, expected=expected))


def _migrated(spark, sf_dir) -> tuple[migrate.Migration, str]:
    """Both logs migrated. A text that no bundle can hold keeps its log out; the findings say so."""
    leaves = logs.both_logs(spark, sf_dir)
    tree = merkle.build_tree(logs.with_leaf_hash(leaves))
    sources = materialize(
        tree.roots().select(
            "log_id",
            "tree_size",
            "root_hash",
            (F.col("log_id") * 1_000_000_007).alias("timestamp_nanos"),
            F.lit(-1).cast("bigint").alias("finish"),
        ),
        "sources",
    )
    location = new_location(spark, "store")
    return migrate.migrate(leaves, sources, location, "origin"), location


@query
def migrate_logs(spark, sf_dir):
    done, _ = _migrated(spark, sf_dir)
    return done.checkpoints.select("log_id", "origin", "tree_size", hex_lower(F.col("root_hash")).alias("root_hash"), "frozen_time_nanos")


@query
def migrate_findings(spark, sf_dir):
    """Logs that could not be migrated, and why: both logs, and copies of them with faults in leaves, bounds and roots."""
    leaves, n = logs.both_logs(spark, sf_dir), F.col("leaf_index")
    events = leaves.where(f"log_id = {logs.EVENTS_LOG}")
    null = F.lit(None).cast("bigint")

    def copy(log: int, df: DataFrame) -> DataFrame:
        return df.withColumn("log_id", F.lit(log).cast("bigint"))

    value = F.when(n % 211 != 3, F.col("leaf_value"))
    faulty = (
        leaves.unionByName(copy(11, events.withColumn("queue_ts_nanos", F.when(n % 97 != 5, F.col("queue_ts_nanos")))))
        .unionByName(copy(12, events.withColumn("integrate_ts_nanos", F.when(n % 89 != 7, F.col("integrate_ts_nanos")))))
        .unionByName(copy(13, events.withColumn("leaf_value", value)))
        .unionByName(copy(14, events.where(n % 500 != 9)))
        .unionByName(copy(15, events.unionByName(events.where(n == 20))))
        .unionByName(copy(16, events.withColumn("queue_ts_nanos", F.when(n == 4, F.lit(-(2**63) + 1)).otherwise(F.col("queue_ts_nanos")))))
    )
    roots = merkle.build_tree(logs.with_leaf_hash(leaves)).roots()
    mine = roots.where(f"log_id = {logs.EVENTS_LOG}").drop("log_id")
    whole = F.lit(-1).cast("bigint")
    size = F.col("tree_size")
    # log, size, finish, and whether the source's root is another one
    planned = [
        *((log, size, whole, False) for log in range(11, 17)), (21, size, null, False), (22, null, whole, False), (23, size, size + 1, False),
        (24, size, F.lit(-2).cast("bigint"), False), (25, size, F.lit(0).cast("bigint"), False), (26, size, whole, False), (26, size, F.lit(9).cast("bigint"), False),
        (27, size, whole, False), (28, size, whole, True), (None, size, whole, False),
    ]
    sources = roots.withColumn("finish", whole)
    for log, tree_size, finish, other in planned:
        root = F.unhex(F.sha2(F.hex("root_hash").cast("binary"), 256)) if other else F.col("root_hash")
        sources = sources.unionByName(
            mine.select(F.lit(log).cast("bigint").alias("log_id"), tree_size.alias("tree_size"), root.alias("root_hash"), finish.alias("finish"))
        )
    sources = materialize(sources.withColumn("timestamp_nanos", F.lit(7).cast("bigint")), "sources")
    given = faulty.unionByName(copy(28, events))  # of log 27 there is no leaf
    return migrate.migrate(given, sources, new_location(spark, "store")).findings


@query
def migrated_entries(spark, sf_dir):
    """Every request of the batch answered from a migrated store."""
    done, location = _migrated(spark, sf_dir)
    written = done.checkpoints
    registered = written.select("log_id", "frozen_time_nanos", F.lit("here").alias("location"))
    served = store.open_store(spark, location, registered)
    return _flat(answer(inputs.by_index(spark, sf_dir), "entry_and_proof", served))


def _grown(spark, sf_dir) -> tuple[migrate.Migration, str]:
    """Logs that bundles can hold, migrated up to a third, then grown to two thirds, and then as a whole."""
    leaves = logs.both_logs(spark, sf_dir)
    fit = materialize(leaves.groupBy("log_id").agg(F.max(F.length("leaf_value")).alias("most")).where(F.col("most") <= MAX_ENTRY_BYTES), "fit")
    tree = merkle.build_tree(logs.with_leaf_hash(leaves))
    whole = materialize(tree.roots().join(fit.select("log_id"), "log_id", "left_semi"), "whole")
    location = new_location(spark, "store")

    def sources(finish: Column) -> DataFrame:
        return whole.select("*", (F.col("log_id") * 1_000_000_007).alias("timestamp_nanos"), finish.cast("bigint").alias("finish"))

    size = F.col("tree_size")
    migrate.migrate(leaves, sources(F.call_function("div", size, F.lit(3))), location, "origin")
    migrate.grow(leaves, sources(F.call_function("div", size * 2, F.lit(3))), location)
    return migrate.grow(leaves, sources(F.lit(-1)), location), location


@query
def migrate_grown(spark, sf_dir):
    """Proof of every leaf from a store that has grown twice: its earlier tiles with their chains brought up to date."""
    _, location = _grown(spark, sf_dir)
    every = proofs.all_inclusion_proofs(store.read_stored(spark, location).paths)
    return every.select("log_id", "leaf_index", hex_lower(F.col("leaf_hash")).alias("leaf_hash"), _hex_list(F.col("hashes")).alias("hashes"))


@query
def grown_entries(spark, sf_dir):
    """Every request of the batch answered from a store that has grown twice."""
    done, location = _grown(spark, sf_dir)
    registered = done.checkpoints.select("log_id", "frozen_time_nanos", F.lit("here").alias("location"))
    served = store.open_store(spark, location, registered)
    return _flat(answer(inputs.by_index(spark, sf_dir), "entry_and_proof", served))


def _stored(spark, leaves: DataFrame) -> store.StoredTables:
    roots = merkle.build_tree(logs.with_leaf_hash(leaves)).roots()
    sources = materialize(roots.select("*", F.lit(1).cast("bigint").alias("timestamp_nanos"), F.lit(-1).cast("bigint").alias("finish")), "sources")
    location = new_location(spark, "store")
    migrate.migrate(leaves, sources, location)
    return store.read_stored(spark, location)


@query
def compare_by_descent(spark, sf_dir):
    """Two stores compared from parts down to leaves: what a changed copy differs in, with only differing bundles opened."""
    leaves = logs.both_logs(spark, sf_dir)
    long = leaves.where(F.length("leaf_value") > MAX_ENTRY_BYTES).select("log_id").distinct()
    fit = leaves.join(materialize(long, "long"), "log_id", "left_anti")
    return validate.compare_stored(_stored(spark, fit), _stored(spark, inputs.changed_copy(fit)))


@query
def store_self_check(spark, sf_dir):
    """A migrated store against its own records, after faults in a copy of its files: bundles lost, index entries doubled, tiles
    changed, one log's paths gone, a directory that no one recorded."""
    _, location = _migrated(spark, sf_dir)
    selfcheck.record(spark, location)
    faulty = new_location(spark, "faulty_store")
    for table, faults in inputs.STORE_FAULTS.items():
        rows = spark.read.schema(StructType([*store.TABLES[table].fields, RECORDS["generation"]])).parquet(f"{location}/{table}")
        named = selfcheck.DIRECTORY[table]
        faults(rows).write.partitionBy("generation", "log_id", *([named] if named else [])).parquet(f"{faulty}/{table}")
    for table in ("manifest", "records"):
        spark.read.parquet(f"{location}/{table}").write.parquet(f"{faulty}/{table}")
    return selfcheck.self_check(spark, faulty).drop("generation")


@query
def object_sink_roundtrip(spark, sf_dir):
    """Migrated store exported as objects and read back by computed names: every leaf, from bytes."""
    done, location = _migrated(spark, sf_dir)
    written = done.checkpoints
    base = new_location(spark, "objects")
    store.export_objects(location, base, spark)
    points = store.read_checkpoints(spark, base, written)
    read = store.read_bundles(spark, base, points)
    return bundles.decode(read).select(
        "log_id",
        "leaf_index",
        hex_lower(F.col("merkle_leaf_hash")).alias("merkle_leaf_hash"),
        "queue_ts_nanos",
        "integrate_ts_nanos",
        "error_code",
    )


@query
def answers_from_objects(spark, sf_dir):
    """Every request of the batch answered from exported objects alone, each log in a location of its own."""
    done, location = _migrated(spark, sf_dir)
    base = new_location(spark, "objects")
    place = F.concat(F.lit("bucket/"), F.col("log_id").cast("string"), F.lit("/frozen"))
    registered = done.checkpoints.select("log_id", "frozen_time_nanos", place.alias("location"))
    store.export_objects(location, base, spark, registered)
    served = store.store_from_objects(spark, base, registered)
    return _flat(answer(inputs.by_index(spark, sf_dir), "entry_and_proof", served))


@query
def object_tiles_root(spark, sf_dir):
    """Roots rebuilt from exported hash tiles alone, against the exported checkpoints."""
    done, location = _migrated(spark, sf_dir)
    written = done.checkpoints
    base = new_location(spark, "objects")
    store.export_objects(location, base, spark)
    points = store.read_checkpoints(spark, base, written)
    tree = merkle.tree_from_tiles(store.read_hash_tiles(spark, base, points))
    return compare.verify_roots(tree.roots(), points).select(
        "log_id", "actual_size", hex_lower(F.col("actual_root")).alias("actual_root"), "ok"
    )


@query
def object_listing(spark, sf_dir):
    """Names between a prefix and a suffix, after writing one object per hash prefix."""
    index = hashindex.build(_hashed(spark, sf_dir))
    base = new_location(spark, "listing")
    named = hashindex.stats(index).select(
        F.concat(F.lit("hashmap/"), "prefix", F.when(F.col("log_id") == 1, F.lit(".shard")).otherwise(F.lit(".other"))).alias("path"),
        F.col("entries").cast("string").cast("binary").alias("bytes"),
    )
    objects.write_objects(named, base)
    return objects.list_objects(spark, base, "hashmap/", ".shard")


@query
def object_read_metadata(spark, sf_dir):
    """Objects made from pages with metadata, read back by name; names never written are not found."""
    pages = logs.read_table(spark, sf_dir, "pages")
    base = new_location(spark, "pages")
    key = F.lpad(F.col("page_id").cast("string"), 9, "0")
    named = pages.select(
        F.concat(F.lit("page/"), key).alias("path"), F.col("html").cast("binary").alias("bytes"), "url", "page_id"
    )
    objects.write_objects(named, base)
    given = F.create_map(F.lit("Url"), F.col("url"), F.lit("Kind"), F.lit("page"))
    existing = F.when(F.col("page_id") % 2 == 0, F.create_map(F.lit("Kind"), F.lit("old"), F.lit("Kept"), F.lit("yes")))
    objects.write_metadata(
        named, base, lambda path: F.when(~F.endswith(path, F.lit("5")), given), existing
    )
    asked = named.select("path").unionByName(pages.select(F.concat(F.lit("missing/"), key).alias("path")))
    read = objects.fetch_objects(asked, base).join(objects.read_metadata(spark, base), "path", "left")
    return read.select(
        "path",
        "found",
        F.length("bytes").cast("bigint").alias("n_bytes"),
        F.try_element_at("metadata", F.lit("url")).alias("url"),
        F.try_element_at("metadata", F.lit("kind")).alias("kind"),
        F.try_element_at("metadata", F.lit("kept")).alias("kept"),
    )
