import random

import pytest
from pyspark.sql import functions as F

from merklake.operators import bundles, checks, compare, hashindex, joins
from merklake.sources.scratch import materialize, new_location

LEAF = "log_id long, leaf_index long, leaf_value binary, queue_ts_nanos long, integrate_ts_nanos long"


def leaves(spark, n, log=1, start=0):
    rng = random.Random(n)
    rows = [(log, i, bytearray(rng.randbytes(rng.choice([0, 1, 5, 300]))), 10**18 + i, 10**18 + i * 3 - 50) for i in range(start, n)]
    return spark.createDataFrame(rows, LEAF), rows


def test_bundle_bytes_and_round_trip(spark):
    df, rows = leaves(spark, 300)
    # Copies of leaves do not change a bundle.
    encoded = bundles.encode(df.unionByName(df.where("leaf_index < 100"))).orderBy("bundle_index").collect()
    assert [(r.bundle_index, r.width, r.oversize) for r in encoded] == [(0, 256, 0), (1, 44, 0)]
    for r in encoded:
        part = rows[r.bundle_index * 256 :][: r.width]
        assert bytes(r.bytes) == b"".join(len(v).to_bytes(2, "big") + bytes(v) for _, _, v, _, _ in part)
    back = bundles.decode(bundles.encode(df)).orderBy("leaf_index").collect()
    assert [(r.log_id, r.leaf_index, r.leaf_value, r.queue_ts_nanos, r.integrate_ts_nanos) for r in back] == rows
    assert {r.error_code for r in back} == {None}


def test_entry_length_limit(spark):
    df = spark.createDataFrame([(1, 0, bytearray(65535), 1, 1), (1, 256, bytearray(65536), 1, 1), (1, 257, bytearray(1), 1, 1)], LEAF)
    got = {r.bundle_index: (r.oversize, r.bytes and len(r.bytes), r.width) for r in bundles.encode(df).collect()}
    assert got == {0: (0, 65537, 1), 1: (1, None, 2)}


def test_broken_bundles_are_reported(spark):
    rows = [(1, 0, bytearray(b"\x00\x05abc"), {"0": "1 1"}), (1, 1, bytearray(b"\x00\x01a\x00"), {"0": "1 1"}), (1, 2, bytearray(b"\x00\x01a\x00\x01b"), {"0": "1 1"}), (1, 3, None, None)]
    df = spark.createDataFrame(rows, "log_id long, bundle_index long, bytes binary, metadata map<string,string>")
    got = sorted((r.bundle_index, r.leaf_index, r.error_code) for r in bundles.decode(df).collect())
    assert got == [
        (0, None, "BUNDLE_CORRUPT"), (1, None, "BUNDLE_CORRUPT"), (2, 512, None), (2, 513, "TIMESTAMP_MISSING"), (3, None, "BUNDLE_MISSING")
    ]


def test_attach_metadata(spark):
    df, _ = leaves(spark, 300)
    pairs = bundles.timestamp_pairs(df)
    names = {"tile/entries/000": None, "tile/entries/001.p/44": None, "tile/entries/001": "COUNT_MISMATCH", "tile/entries/002": "NO_TIMESTAMPS", "tile/entries/zz": "BAD_PATH", "tile/0/000": None, "checkpoint": None}
    objects = spark.createDataFrame([(1, p) for p in names], "log_id long, path string")
    got = {r.path: r for r in bundles.attach_metadata(objects, pairs).collect()}
    assert {p: r.error_code for p, r in got.items()} == names
    assert len(got["tile/entries/001.p/44"].metadata) == 44 and got["tile/0/000"].metadata is None


def index_of(spark, rows):
    df = spark.createDataFrame(rows, "log_id long, leaf_index long, merkle_leaf_hash binary")
    return hashindex.build(df)


@pytest.mark.parametrize("hot_rows", [1_000_000, 3])
def test_hash_lookup(spark, hot_rows):
    def digest(i):
        return bytearray(bytes([i % 7, i % 3]) + bytes([i]) * 30)

    # Half of the requests ask for one hash, which every third leaf has.
    rows = [(1, i, digest(0 if i % 3 == 0 else i)) for i in range(200)] + [(2, 9, digest(1)), (2, 5, bytearray(3))]
    asked = [(i, 1, digest(0 if i % 2 else i)) for i in range(250)] + [(900, 2, digest(1)), (901, 2, digest(2)), (902, 3, digest(1)), (903, 1, None)]
    requests = spark.createDataFrame(asked, "request_id long, log_id long, leaf_hash binary")
    smallest = {}
    for log, i, h in rows:
        if len(h) == 32:
            smallest.setdefault((log, bytes(h)), i)
    want = {r: smallest.get((log, bytes(h))) if h else None for r, log, h in asked}
    index = index_of(spark, rows)
    for source in (index, _stored(spark, index)):
        got = hashindex.lookup(requests, source, F.col("leaf_hash"), hot_rows).collect()
        assert len(got) == len(asked) and {r.request_id: r.found_index for r in got} == want
    member = {r.request_id: r.is_member for r in hashindex.membership(requests, index, F.col("leaf_hash")).collect()}
    assert member == {r: i is not None for r, i in want.items()}
    prefixes = {(log, bytes(h[:2])) for log, _, h in rows if len(h) == 32}
    found = {r.request_id: r.prefix_found for r in hashindex.prefix_exists(requests, index, F.col("leaf_hash")).collect()}
    assert found == {r: bool(h) and (log, bytes(h[:2])) in prefixes for r, log, h in asked}


def _stored(spark, index):
    location = new_location(spark, "index")
    hashindex.write(index, location)
    return hashindex.read(spark, location)


def test_index_with_digits_only_in_directory_names(spark):
    index = index_of(spark, [(1, 0, bytearray(32))])
    requests = spark.createDataFrame([(1, 1, bytearray(32))], "request_id long, log_id long, leaf_hash binary")
    assert hashindex.lookup(requests, _stored(spark, index), F.col("leaf_hash")).first().found_index == 0


def test_index_integrity(spark):
    rows = [(1, "0000", bytearray(30), 0), (1, "0001", bytearray(30), 1), (1, "0001", bytearray(30), 1), (1, "0002", bytearray(29), 2), (1, "0003", bytearray(30), 4), (1, "00G0", bytearray(30), 3), (2, "0000", bytearray(30), 0)]
    index = spark.createDataFrame(rows, "log_id long, prefix string, suffix binary, leaf_index long")
    logs = spark.createDataFrame([(1, 4)], "log_id long, tree_size long")
    got = {(r.log_id, r.prefix): r.error_code for r in hashindex.integrity(index, logs).collect()}
    assert got == {(1, "0000"): None, (1, "0001"): "INDEX_REPEATED", (1, "0002"): "BAD_SUFFIX_LENGTH", (1, "0003"): "INDEX_OUT_OF_RANGE", (1, "00G0"): "BAD_PREFIX", (2, "0000"): "UNKNOWN_LOG"}
    assert [(r.log_id, r.entries, r.ok) for r in hashindex.total_entries(index, logs).collect()] == [(1, 6, False)]
    stats = {(r.log_id, r.prefix): (r.entries, r.entry_bytes, r.log_prefixes) for r in hashindex.stats(index).collect()}
    assert stats[1, "0001"] == (2, 76, 5)


def test_gaps_and_completeness(spark):
    rng = random.Random(4)
    size = {1: 1000, 2: 700, 3: 40_000, 4: 0}
    present = {1: [i for i in range(1000) if rng.random() < 0.9], 2: list(range(700)), 3: [5, 39_999], 4: []}
    rows = [(log, i) for log, ids in present.items() for i in ids] + [(1, present[1][0])] * 500
    df = spark.createDataFrame(rows, "log_id long, leaf_index long")
    logs = spark.createDataFrame(list(size.items()), "log_id long, tree_size long")
    missing = {(r.log_id, i) for r in checks.gaps(df, logs).collect() for i in r.indices}
    assert missing == {(log, i) for log in size for i in set(range(size[log])) - set(present[log])}
    for r in checks.gaps(df, logs).collect():
        assert (r.missing, r.first_missing, r.last_missing) == (len(r.indices), r.indices[0], r.indices[-1])
    got = {r.log_id: r for r in checks.completeness(df, logs).collect()}
    assert {k: (r.rows, r.distinct_rows, r.repeated, r.complete) for k, r in got.items()} == {
        1: (len(present[1]) + 500, len(present[1]), 500, False), 2: (700, 700, 0, True), 3: (2, 2, 0, False), 4: (0, 0, 0, True)
    }


def test_explode_range(spark):
    df = spark.createDataFrame([(1, 0, 0), (2, 5, 100_000), (3, 9, 8), (4, 16_383, 16_384)], "request_id long, a long, b long")
    out = joins.explode_range(df, F.col("a"), F.col("b"), "i")
    got = {r.request_id: (r.n, r.lo, r.hi) for r in out.groupBy("request_id").agg(F.count_distinct("i").alias("n"), F.min("i").alias("lo"), F.max("i").alias("hi")).collect()}
    assert got == {1: (1, 0, 0), 2: (99_996, 5, 100_000), 4: (2, 16_383, 16_384)} and out.count() == 99_999


@pytest.mark.parametrize("hot_rows", [1_000_000, 10])
def test_lookup_join_keeps_every_row(spark, hot_rows):
    many = materialize(spark.range(3000).select(F.col("id").alias("request_id"), F.when(F.col("id") % 3 > 0, F.when(F.col("id") % 3 == 1, F.lit(7)).otherwise(F.col("id") % 50)).alias("k")), "many")
    one = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    out = joins.lookup_join(many, one, ["k"], hot_rows=hot_rows).collect()
    assert len(out) == 3000 and all(r.v == (None if r.k is None or r.k >= 40 else r.k * 2) for r in out)


def test_compare_leaves(spark):
    left = [(1, i, bytearray(b"v%d" % i), 100 + i, 200 + i) for i in range(8)]
    right = [list(r) for r in left if r[1] != 0] + [[1, 9, bytearray(b"x"), 1, 2]]
    right[0][2] = bytearray(b"other")
    right[1][3] += 1
    right[2][4] -= 1
    right[3][3] = None
    right.append(list(left[7]))
    a, b = spark.createDataFrame(left, LEAF), spark.createDataFrame([tuple(r) for r in right], LEAF)

    def fields(strict):
        return sorted((r.leaf_index, r.field, r.left, r.right) for r in compare.compare_leaves(a, b, strict).collect() if r.field != "merkle_leaf_hash")

    want = [
        (0, "presence", "present", "missing"), (1, "leaf_value", b"v1".hex(), b"other".hex()), (2, "queue_ts_nanos", "102", "103"),
        (3, "integrate_ts_nanos", "203", "202"), (7, "copies", "1", "2"), (9, "presence", "missing", "present"),
    ]
    assert fields(False) == want
    assert fields(True) == sorted([*want, (4, "queue_ts_nanos", "104", None)], key=lambda r: (r[0], r[1]))
    hashes = [r for r in compare.compare_leaves(a, b).collect() if r.field == "merkle_leaf_hash"]
    assert [(r.leaf_index, r.left == r.expected, r.right == r.expected) for r in hashes] == [(1, True, False)]
    counts = {r.field: r.differences for r in compare.difference_counts(compare.compare_leaves(a, b)).collect()}
    assert counts["presence"] == 2
    assert compare.compare_leaves(a, a).count() == 0


def test_compare_proofs(spark):
    h = [bytearray([i]) * 32 for i in range(5)]
    left = [(1, i, i, [h[0], h[1], h[2]]) for i in range(6)]
    right = [(1, 0, 0, [h[0], h[1], h[2]]), (1, 1, 2, [h[0], h[1], h[2]]), (1, 2, 2, [h[0], h[1]]), (1, 3, 3, [h[0], h[3], h[4]]), (1, 4, 9, [h[4], h[1], h[2]])]
    kind = "log_id long, leaf_index long, proof_index long, hashes array<binary>"
    got = sorted((r.leaf_index, r.field, r.step) for r in compare.compare_proofs(spark.createDataFrame(left, kind), spark.createDataFrame(right, kind)).collect())
    assert got == [(1, "proof_leaf_index", None), (2, "proof_hash_count", None), (3, "proof_hash", 1), (4, "proof_hash", 0), (4, "proof_leaf_index", None), (5, "proof_missing", None)]


def test_hot_leaf_in_a_hot_bundle(spark):
    from merklake.plans.answer import answer
    from merklake.plans.store import store_from_leaves
    from merklake.schemas import REQUESTS

    df, rows = leaves(spark, 600)
    served = store_from_leaves(df, ("bundles",))
    # A third of the requests ask for one leaf, and all their ranges overlap.
    asked = [(i, 1, 300 if i % 3 == 0 else i, 1 + i % 4) for i in range(590)]
    out = answer(spark.createDataFrame(asked, REQUESTS["leaves_by_range"]), "leaves_by_range", served, hot_rows=5).collect()
    got = sorted((r.request_id, r.leaf_index, bytes(r.leaf_value)) for r in out)
    assert got == sorted((i, k, bytes(rows[k][2])) for i, _, s, n in asked for k in range(s, min(s + n, 600)))
