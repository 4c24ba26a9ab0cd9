import json
import os

import pytest
from pyspark.sql import functions as F

from merklake.operators import bundles, hashindex, joins
from merklake.plans import migrate, store, validate
from merklake.plans.answer import answer
from merklake.schemas import CHECKPOINTS, LEAVES, REGISTRY, REQUESTS
from merklake.sources import logs, objects, registry
from merklake.sources.scratch import materialize, new_location
from tests.reference_tree import Brute, leaf

N = {1: 300, 2: 5}


def rows_of(log):
    return [(log, i, bytearray(b"entry-%d-%d" % (log, i if i != 40 else 3)), 10**18 + i, 10**18 + 7 * i) for i in range(N[log])]


@pytest.fixture(scope="module")
def leaves(spark):
    kind = "log_id long, leaf_index long, leaf_value binary, queue_ts_nanos long, integrate_ts_nanos long"
    return materialize(spark.createDataFrame(rows_of(1) + rows_of(2), kind), "leaves")


@pytest.fixture(scope="module")
def brute():
    return {log: Brute([leaf(bytes(r[2])) for r in rows_of(log)]) for log in N}


def sources(spark, brute, finish=-1, wrong=False):
    rows = [(log, n, bytearray(32) if wrong else bytearray(brute[log].root(0, n)), 77 + log, finish) for log, n in N.items()]
    return spark.createDataFrame(rows, "log_id long, tree_size long, root_hash binary, timestamp_nanos long, finish long")


@pytest.fixture(scope="module")
def migrated(spark, leaves, brute):
    location = new_location(spark, "store")
    migrate.migrate(leaves, sources(spark, brute), location, "example.org/log")
    return location


@pytest.fixture(scope="module")
def served(spark, migrated):
    entries = spark.createDataFrame([(1, 500, "a"), (2, 79, "b")], REGISTRY)
    return store.open_store(spark, migrated, entries)


def ask(spark, served, kind, *rows, **options):
    requests = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], REQUESTS[kind])
    out = answer(requests, kind, served, **options).collect()
    if kind != "leaves_by_range":
        assert len(out) == len(rows)
    return sorted(out, key=lambda r: (r.request_id, r.leaf_index if kind == "leaves_by_range" and r.leaf_index is not None else -1))


def test_checkpoints(served, brute):
    got = {r.log_id: (r.origin, r.tree_size, bytes(r.root_hash), r.frozen_time_nanos, r.frozen_time_differs) for r in served.logs.collect()}
    # The registry's time is served; log 1's differs from its checkpoint's.
    assert got == {log: ("example.org/log", n, brute[log].root(0, n), {1: 500, 2: 79}[log], log == 1) for log, n in N.items()}


def test_inclusion_rules(spark, served, brute):
    got = ask(spark, served, "inclusion_proof", (9, 0, 1), (9, -1, 0), (1, -1, 0), (1, -1, 5), (1, 5, 5), (1, 3, 301), (1, 299, 300), (1, 3, 9), (2, 4, 5))
    assert [(r.status, r.reason) for r in got] == [
        ("INVALID_ARGUMENT", "UNKNOWN_LOG"), ("INVALID_ARGUMENT", "UNKNOWN_LOG"), ("INVALID_ARGUMENT", "TREE_SIZE_NOT_POSITIVE"),
        ("INVALID_ARGUMENT", "LEAF_INDEX_NEGATIVE"), ("INVALID_ARGUMENT", "LEAF_INDEX_NOT_IN_TREE"), ("OK", "SIZE_BEYOND_LOG"),
        ("OK", None), ("OK", None), ("OK", None),
    ]
    assert all(r.root is None for r in got[:5]) and all(r.hashes is None for r in got[:6])
    assert tuple(got[5].root) == (300, brute[1].root(0, 300), 500)
    assert [bytes(h) for h in got[7].hashes] == brute[1].inclusion(3, 300) and got[7].proof_tree_size == 300
    asked = ask(spark, served, "inclusion_proof", (1, 3, 9), mode="requested")[0]
    assert [bytes(h) for h in asked.hashes] == brute[1].inclusion(3, 9) and asked.proof_tree_size == 9


@pytest.mark.parametrize("hot_rows", [1_000_000, 1])
def test_by_hash_rules(spark, served, brute, hot_rows):
    h = brute[1].hashes
    got = ask(
        spark, served, "inclusion_proof_by_hash",
        (9, bytearray(h[0]), 1), (1, bytearray(h[0]), 0), (1, bytearray(31), 5), (1, None, 5), (1, bytearray(31), 301), (1, bytearray(32), 301),
        (1, bytearray(32), 300), (1, bytearray(h[9]), 9), (1, bytearray(h[9]), 10), (1, bytearray(h[40]), 300), (2, bytearray(h[0]), 5),
        hot_rows=hot_rows,
    )
    assert [(r.status, r.reason) for r in got] == [
        ("INVALID_ARGUMENT", "UNKNOWN_LOG"), ("INVALID_ARGUMENT", "TREE_SIZE_NOT_POSITIVE"), ("INVALID_ARGUMENT", "LEAF_HASH_LENGTH"),
        ("INVALID_ARGUMENT", "LEAF_HASH_LENGTH"), ("INVALID_ARGUMENT", "LEAF_HASH_LENGTH"), ("OK", "SIZE_BEYOND_LOG"),
        ("NOT_FOUND", "LEAF_HASH_NOT_FOUND"), ("NOT_FOUND", "LEAF_NOT_AT_TREE_SIZE"), ("OK", None), ("OK", None), ("NOT_FOUND", "LEAF_HASH_NOT_FOUND"),
    ]
    # Leaves 3 and 40 are equal: the first one answers.
    assert [r.proof_leaf_index for r in got[8:10]] == [9, 3] and all(r.proof_leaf_index is None for r in got[:8])
    assert [bytes(x) for x in got[9].hashes] == brute[1].inclusion(3, 300)


def test_consistency_rules(spark, served, brute):
    got = ask(spark, served, "consistency_proof", (9, 1, 1), (1, 0, 0), (1, 1, 0), (1, 5, 4), (1, 5, 301), (1, 5, 5), (1, 300, 300), (1, 5, 300), (1, 256, 299))
    assert [(r.status, r.reason) for r in got[:5]] == [
        ("INVALID_ARGUMENT", x) for x in ("UNKNOWN_LOG", "FIRST_SIZE_NOT_POSITIVE", "SECOND_SIZE_NOT_POSITIVE", "SIZES_REVERSED", "SECOND_SIZE_BEYOND_LOG")
    ]
    assert [[bytes(h) for h in r.hashes] for r in got[5:]] == [[], [], brute[1].consistency(5, 300), brute[1].consistency(256, 299)]
    assert {r.proof_leaf_index for r in got[5:]} == {0}


def test_latest_root_rules(spark, served, brute):
    got = ask(spark, served, "latest_root", (9, 0), (1, -1), (1, 0), (1, 300), (1, 7), (1, 301))
    assert [r.reason for r in got] == ["UNKNOWN_LOG", "FIRST_SIZE_NEGATIVE", None, None, None, None]
    assert [r.hashes for r in got[:4]] == [None, None, None, []] and got[5].hashes is None
    assert [bytes(h) for h in got[4].hashes] == brute[1].consistency(7, 300)


def test_entry_rules(spark, served, brute):
    got = ask(spark, served, "entry_and_proof", (9, 0, 1), (1, 0, 0), (1, -1, 1), (1, 1, 1), (1, 300, 301), (1, 299, 400), (1, 256, 300), (2, 0, 1))
    assert [(r.status, r.reason) for r in got] == [
        *[("INVALID_ARGUMENT", x) for x in ("UNKNOWN_LOG", "TREE_SIZE_NOT_POSITIVE", "LEAF_INDEX_NEGATIVE", "LEAF_INDEX_NOT_IN_TREE")],
        ("NOT_FOUND", "LEAF_NOT_IN_LOG"), ("OK", None), ("OK", None), ("OK", None),
    ]
    for r in got[5:]:
        want = rows_of(r.log_id)[r.leaf_index]
        assert (r.leaf_value, r.queue_ts_nanos, r.integrate_ts_nanos) == want[2:] and bytes(r.merkle_leaf_hash) == leaf(bytes(want[2]))
        assert [bytes(h) for h in r.hashes] == brute[r.log_id].inclusion(r.leaf_index, N[r.log_id])
    assert all(r.leaf_value is None and r.hashes is None for r in got[:5])


@pytest.mark.parametrize("hot_rows", [1_000_000, 1])
def test_ranges(spark, served, hot_rows):
    asked = [(9, 0, 1), (1, -1, 1), (1, 0, 0), (1, 0, -5), (1, 300, 5), (1, 250, 10), (1, 298, 2**62), (2, 0, 5), (1, 0, 300), (1, 255, 1)]
    got = ask(spark, served, "leaves_by_range", *asked, hot_rows=hot_rows)
    by_request = {}
    for r in got:
        by_request.setdefault(r.request_id, []).append(r)
    assert [by_request[i][0].reason for i in range(5)] == ["UNKNOWN_LOG", "START_NEGATIVE", "COUNT_NOT_POSITIVE", "COUNT_NOT_POSITIVE", None]
    assert [len(by_request[i]) for i in range(10)] == [1, 1, 1, 1, 1, 10, 2, 5, 300, 1]
    assert by_request[4][0].leaf_index is None and by_request[4][0].root.tree_size == 300
    for i, (log, start, _) in enumerate(asked):
        if i > 4:
            for k, r in enumerate(by_request[i]):
                assert (r.log_id, r.leaf_index, r.leaf_value, r.queue_ts_nanos, r.integrate_ts_nanos) == rows_of(log)[start + k]
                assert bytes(r.merkle_leaf_hash) == leaf(bytes(r.leaf_value)) and r.status == "OK"


@pytest.mark.parametrize("dealt_from", [1, 256])
def test_ranges_are_dealt_out_by_bundle(spark, served, monkeypatch, dealt_from):
    """A range goes to the shuffle as a row per bundle, not per leaf, whether it is dealt out on the way or not."""
    from merklake.plans import answer as module

    seen, whole = [], module.split_join
    monkeypatch.setattr(module, "split_join", lambda many, *args: seen.append(many.count()) or whole(many, *args))
    monkeypatch.setattr(module, "WIDE_RANGE", dealt_from, raising=False)
    asked = [(1, 0, 300), (1, 10, 10**7), (1, 256, 44), (2, 1, 3), (2, 0, 10**7), (1, 255, 2)]
    got = ask(spark, served, "leaves_by_range", *asked)
    assert [(r.request_id, r.leaf_index) for r in got] == [(i, k) for i, (log, start, count) in enumerate(asked) for k in range(start, min(start + count, N[log]))]
    assert all(r.leaf_value == rows_of(r.log_id)[r.leaf_index][2] for r in got)
    assert seen == [9]


def test_ordered_answers(spark, served):
    requests = spark.createDataFrame([(2, 1, 250, 10), (1, 1, 298, 9), (3, 2, 0, 5)], REQUESTS["leaves_by_range"])
    got = [(r.request_id, r.leaf_index) for r in answer(requests, "leaves_by_range", served, ordered=True).collect()]
    assert got == sorted(got) and len(got) == 17


def test_bad_bundles_answer_with_internal(spark, served):
    broken = served.bundles.withColumn("metadata", F.map_filter("metadata", lambda k, _: k != "5")).withColumn(
        "bytes", F.when(F.col("bundle_index") == 1, F.lit(bytearray(b"\x00\x09x"))).otherwise(F.col("bytes"))
    )
    bad = store.LogStore(served.logs, served.paths, broken, served.index)
    got = ask(spark, bad, "entry_and_proof", (1, 5, 300), (1, 6, 300), (1, 260, 300))
    assert [(r.status, r.reason, r.leaf_value is None) for r in got] == [
        ("INTERNAL", "TIMESTAMP_MISSING", True), ("OK", None, False), ("INTERNAL", "LEAF_UNREADABLE", True),
    ]
    got = ask(spark, bad, "leaves_by_range", (1, 4, 3))
    assert [(r.leaf_index, r.status) for r in got] == [(4, "OK"), (5, "INTERNAL"), (6, "OK")]


def test_ranges_over_a_bundle_that_is_lost(spark, served):
    """Each leaf of a bundle that is not there, or cannot be read, has its row."""
    for lost in (served.bundles.where("bundle_index != 1"), served.bundles.withColumn("bytes", F.when(F.col("bundle_index") != 1, F.col("bytes")))):
        bad = store.LogStore(served.logs, served.paths, lost, served.index)
        got = ask(spark, bad, "leaves_by_range", (1, 255, 3))
        assert [(r.leaf_index, r.status, r.reason, r.leaf_value is None) for r in got] == [
            (255, "OK", None, False), (256, "INTERNAL", "LEAF_UNREADABLE", True), (257, "INTERNAL", "LEAF_UNREADABLE", True),
        ]


def test_migrating_a_prefix(spark, leaves, brute):
    location = new_location(spark, "store")
    one = sources(spark, brute).where("log_id = 1").withColumn("finish", F.lit(257).cast("long"))
    written = migrate.migrate(leaves, one, location).checkpoints.collect()
    assert [(r.log_id, r.tree_size, bytes(r.root_hash)) for r in written] == [(1, 257, brute[1].root(0, 257))]


def test_migration_leaves_bad_logs_out(spark, leaves, brute):
    def found(df=leaves, **options):
        location = new_location(spark, "store")
        done = migrate.migrate(df, sources(spark, brute, **options), location)
        # No checkpoint of a bad log: nobody takes the copy for whole.
        stored = store.read_stored(spark, location).checkpoints if done.checkpoints.take(1) else None
        good = {r.log_id for r in stored.collect()} if stored is not None else set()
        findings = {(r.log_id, r.error_code, r.rows, r.first_index) for r in done.findings.collect()}
        assert good == set(N) - {f[0] for f in findings}
        return findings

    assert found(finish=301) == {(1, "FINISH_BEYOND_LOG", 1, None), (2, "FINISH_BEYOND_LOG", 1, None)}
    assert found(finish=-2) == {(1, "FINISH_NEGATIVE", 1, None), (2, "FINISH_NEGATIVE", 1, None)}
    assert found(wrong=True) == {(1, "ROOT_DIFFERS", 1, None), (2, "ROOT_DIFFERS", 1, None)}
    assert found(leaves.unionByName(leaves.where("leaf_index = 3 and log_id = 1"))) == {(1, "INCOMPLETE", 1, None)}
    assert found(leaves.where("leaf_index <> 3 or log_id = 2")) == {(1, "INCOMPLETE", 1, None)}
    long_value = F.when((F.col("leaf_index") == 3) & (F.col("log_id") == 2), F.lit(bytearray(65536))).otherwise(F.col("leaf_value"))
    assert (2, "ENTRY_TOO_LONG", 1, 3) in found(leaves.withColumn("leaf_value", long_value))
    hashed = logs.with_leaf_hash(leaves)
    wrong = hashed.withColumn("merkle_leaf_hash", F.when(F.col("leaf_index") == 2, F.lit(bytearray(32))).otherwise(F.col("merkle_leaf_hash")))
    assert found(wrong) == {(1, "HASH_MISMATCH", 1, 2), (2, "HASH_MISMATCH", 1, 2)}


def test_adding_a_log_and_repeating_one(spark, leaves, brute):
    location, all_ = new_location(spark, "store"), sources(spark, brute)
    for log in (1, 2, 1):
        assert migrate.migrate(leaves, all_.where(f"log_id = {log}"), location).findings.count() == 0
    registry_ = spark.createDataFrame([(1, 500, "a"), (2, 79, "b"), (3, 1, "c")], REGISTRY)
    got = ask(spark, store.open_store(spark, location, registry_), "entry_and_proof", (1, 299, 300), (2, 4, 5), (3, 0, 1), (4, 0, 1))
    assert [(r.status, r.reason) for r in got] == [("OK", None), ("OK", None), ("INTERNAL", "CHECKPOINT_MISSING"), ("INVALID_ARGUMENT", "UNKNOWN_LOG")]
    assert [len(r.hashes) for r in got[:2]] == [len(brute[1].inclusion(299, 300)), len(brute[2].inclusion(4, 5))]


def test_no_proof_without_its_tiles(spark, served):
    cut = store.LogStore(served.logs, served.paths.where("tile_index != 1"), served.bundles, served.index.where("leaf_index > 250"))
    lost = ("INTERNAL", "TILE_MISSING", None)

    def shown(kind, *rows, **options):
        return [(r.status, r.reason, r.hashes) for r in ask(spark, cut, kind, *rows, **options)]

    assert shown("inclusion_proof", (1, 270, 300)) == [lost]
    assert shown("inclusion_proof", (1, 5, 280), mode="requested") == [lost]
    assert shown("inclusion_proof_by_hash", (1, bytearray(leaf(b"entry-1-270")), 300)) == [lost]
    assert shown("consistency_proof", (1, 270, 300)) == [lost] and shown("consistency_proof", (1, 5, 280)) == [lost]
    assert shown("latest_root", (1, 270)) == [lost]
    assert [r[0] for r in shown("inclusion_proof", (1, 5, 300))] == ["OK"]


def test_validating_a_store(spark, leaves, migrated):
    stored = store.read_stored(spark, migrated)
    assert validate.validate_store(leaves, stored).count() == 0
    bad = bytearray(32)
    faulty = store.StoredTables(
        checkpoints=stored.checkpoints.withColumn("root_hash", F.when(F.col("log_id") == 2, F.lit(bad)).otherwise(F.col("root_hash"))),
        bundles=stored.bundles.where("log_id = 1 or bundle_index != 0"),
        tiles=stored.tiles.where("log_id = 2 or tile_level != 0 or tile_index != 1"),
        paths=stored.paths.withColumn("upper", F.when(F.col("tile_index") == 1, F.col("upper")).otherwise(F.slice("upper", 1, 3))),
        index=stored.index.where("leaf_index != 290"),
    )
    found = {(r.log_id, r.leaf_index, r.field) for r in validate.validate_store(leaves, faulty).collect()}
    lost = {(2, i, "presence") for i in range(5)}
    kinds = {f for _, _, f in found}
    assert {(1, 256, "hash_tile"), (1, 0, "path_tile"), (1, 290, "index_entry"), (2, None, "checkpoint")} <= found
    assert kinds == {"hash_tile", "path_tile", "index_entry", "checkpoint"} | ({"presence"} if lost <= found else kinds)
    assert len([f for f in found if f[0] == 2 and f[1] is not None and f[2] not in ("path_tile",)]) == 5


def test_validating_a_store_that_lacks_a_log(spark, leaves, migrated):
    stored = store.read_stored(spark, migrated)

    def found(**changed):
        faulty = store.StoredTables(**{n: changed.get(n, getattr(stored, n)) for n in ("checkpoints", "bundles", "tiles", "paths", "index")})
        return {(r.log_id, r.leaf_index, r.field, r.left, r.right) for r in validate.validate_store(leaves, faulty).collect()}

    assert found(checkpoints=stored.checkpoints.where("log_id = 1")) == {(2, None, "checkpoint_missing", "5", None)}
    lacking = found(**{n: getattr(stored, n).where("log_id = 1") for n in ("checkpoints", "bundles", "tiles", "paths", "index")})
    assert {r[:3] for r in lacking} == {(2, None, "checkpoint_missing"), (2, 0, "hash_tile"), (2, 0, "path_tile")} | {(2, i, f) for i in range(5) for f in ("presence", "index_entry")}
    small = F.when(F.col("log_id") == 1, F.lit(10).cast("bigint")).otherwise(F.col("tree_size"))
    short = found(checkpoints=stored.checkpoints.withColumn("tree_size", small), index=stored.index.where("leaf_index != 290"))
    assert {r[:3] for r in short} == {(1, None, "size_differs"), (1, None, "checkpoint"), (1, 290, "index_entry")}
    prefix = spark.createDataFrame([(1, 300)], "log_id bigint, tree_size bigint")
    only = store.StoredTables(*(getattr(stored, n).where("log_id = 1") for n in ("checkpoints", "bundles", "tiles", "paths", "index")))
    assert validate.validate_store(leaves, only, expected=prefix).count() == 0


def test_gaps_and_conflicts_take_no_slot(spark, leaves, brute):
    gap = store.store_from_leaves(leaves.where("leaf_index <> 7"))
    got = ask(spark, gap, "inclusion_proof", (1, 8, 200), (2, 4, 5))
    assert [(r.status, r.reason) for r in got] == [("INTERNAL", "TILE_MISSING"), ("OK", None)]
    again = leaves.unionByName(leaves.where("log_id = 1 and leaf_index = 7").withColumn("leaf_value", F.lit(bytearray(b"other"))))
    got = ask(spark, store.store_from_leaves(again), "entry_and_proof", (1, 8, 200), (1, 290, 300), (2, 4, 5))
    assert [r.status for r in got] == ["INTERNAL", "INTERNAL", "OK"]
    found = validate.validate_copy(leaves, leaves.where("log_id = 2 or leaf_index <> 7")).collect()
    assert sorted((r.log_id, r.leaf_index, r.field) for r in found if r.field == "not_dense") == [(1, None, "not_dense")]
    assert {r.field for r in found} == {"not_dense", "presence"} or len(found) == 2


def test_empty_log(spark, leaves, brute):
    empty = spark.createDataFrame([(8, 0, bytearray(32), 1, -1)], "log_id long, tree_size long, root_hash binary, timestamp_nanos long, finish long")
    written = migrate.migrate(leaves, empty.unionByName(sources(spark, brute)), new_location(spark, "store"))
    got = {r.log_id: (r.tree_size, bytes(r.root_hash).hex()[:8]) for r in written.checkpoints.collect()}
    assert got[8] == (0, "e3b0c442") and got[1][0] == 300


def test_object_layout(spark, migrated, leaves, brute):
    base = new_location(spark, "objects")
    store.export_objects(migrated, base, spark)
    store.export_objects(migrated, base, spark)  # Writing again replaces objects by equal ones.
    root = base.removeprefix("file:")
    names = {os.path.relpath(os.path.join(d, f), root) for d, _, fs in os.walk(root) for f in fs if "_object_metadata" not in d}
    assert names == {
        "1/checkpoint", "1/tile/0/000", "1/tile/0/001.p/44", "1/tile/1/000.p/1", "1/tile/entries/000", "1/tile/entries/001.p/44",
        "2/checkpoint", "2/tile/0/000.p/5", "2/tile/entries/000.p/5",
    }
    with open(f"{root}/1/tile/0/001.p/44", "rb") as f:
        assert f.read() == b"".join(brute[1].hashes[256:])
    known = spark.createDataFrame([(1,), (2,), (3,)], "log_id long")
    points = {r.log_id: r for r in store.read_checkpoints(spark, base, known).collect()}
    assert points[1].tree_size == 300 and bytes(points[1].root_hash) == brute[1].root(0, 300) and points[1].frozen_time_nanos == 78
    assert points[3].error_code == "OBJECT_NOT_FOUND"
    sizes = spark.createDataFrame(list(N.items()), "log_id long, tree_size long")
    back = bundles.decode(store.read_bundles(spark, base, sizes)).orderBy("log_id", "leaf_index").collect()
    assert [(r.log_id, r.leaf_index, r.leaf_value, r.queue_ts_nanos, r.integrate_ts_nanos) for r in back] == rows_of(1) + rows_of(2)
    assert {r.found for r in store.read_hash_tiles(spark, base, sizes).collect()} == {True}


def test_objects_and_metadata(spark, monkeypatch):
    base = new_location(spark, "objects")
    rows = [("a/x 1", b"1", {"K": "old", "Only": "1"}), ("a/ünï", b"", None), ("b/big", b"z" * 5_000_000, None), ("a/y.s", b"2", None), ("a/.s", b"3", None)]
    df = spark.createDataFrame([(p, bytearray(b), m) for p, b, m in rows], "path string, bytes binary, old map<string,string>")
    objects.write_objects(df, base)
    given = F.create_map(F.lit("K"), F.lit("https://example.com/?a=b&c=d"))
    objects.write_metadata(df, base, lambda p: F.when(~F.startswith(p, F.lit("b/")), given), F.col("old"))
    asked = df.select("path").unionByName(spark.createDataFrame([("none",)], "path string"))
    got = {r.path: r for r in objects.fetch_objects(asked, base).join(objects.read_metadata(spark, base), "path", "left").collect()}
    assert {p: bytes(r.bytes) for p, r in got.items() if r.found} == {p: b for p, b, _ in rows}
    assert not got["none"].found and got["b/big"].metadata is None
    # However small the pieces handed on, the same objects arrive.
    monkeypatch.setattr(objects, "READ_BYTES", 1)
    assert {r.path: r.found for r in objects.fetch_objects(asked.coalesce(1), base).collect()} == {p: r.found for p, r in got.items()}
    assert got["a/x 1"].metadata == {"k": "https://example.com/?a=b&c=d", "only": "1"}
    assert [r.name for r in objects.list_objects(spark, base, "a/", ".s").collect()] == ["y"]


def test_registry(spark, tmp_path):
    path = tmp_path / "registry.json"
    path.write_text(json.dumps({"123456": {"frozenTime": 1741241241, "bucketName": "b"}, "-7": {}}, indent=2))
    assert sorted(tuple(r) for r in registry.read_config(spark, str(path)).collect()) == [(-7, 0, ""), (123456, 1741241241, "b")]
    path.write_text('{"12x": {}}')
    with pytest.raises(ValueError, match="BAD_LOG_ID"):
        registry.read_config(spark, str(path))
    rows = [(2, 1, 5, "second"), (1, 1, 9, "first"), (3, 4, 1, "only")]
    df = spark.createDataFrame(rows, "position int, log_id long, frozen_time_nanos long, location string")
    assert sorted(tuple(r) for r in registry.first_registered(df, "position").collect()) == [(1, 9, "first"), (4, 1, "only")]


def test_validation_of_a_copy(spark, leaves):
    assert validate.validate_copy(leaves, leaves).count() == 0
    changed = leaves.withColumn("leaf_value", F.when((F.col("log_id") == 2) & (F.col("leaf_index") == 4), F.lit(bytearray(b"!"))).otherwise(F.col("leaf_value")))
    fields = {}
    for r in validate.validate_copy(leaves, changed).collect():
        assert r.log_id == 2
        fields.setdefault(r.field, set()).add(r.leaf_index)
    # Every other leaf's proof has the changed leaf in it.
    assert fields == {"leaf_value": {4}, "merkle_leaf_hash": {4}, "proof_hash": {0, 1, 2, 3}}


def test_leaf_range_scan_is_pushed_down(spark, leaves):
    location = new_location(spark, "leaves")
    logs.with_leaf_hash(leaves).select(*LEAVES.names).write.parquet(location)
    part = logs.read_leaves(spark, location, 10, 20).where("log_id = 1").select("leaf_index")
    assert sorted(r.leaf_index for r in part.collect()) == list(range(10, 20))
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(leaf_index,10)" in plan and "LessThan(leaf_index" in plan and "leaf_value" not in plan


def test_many_logs_fall_back_from_broadcast(spark, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 24)
    many = spark.range(100).select(F.col("id").alias("request_id"), (F.col("id") % 12).alias("log_id"))
    one = spark.range(10).select(F.col("id").alias("log_id"), (F.col("id") * 3).alias("v"))
    assert all(r.v == (r.log_id * 3 if r.log_id < 10 else None) for r in joins.small_join(many, one, ["log_id"]).collect())
    assert joins.small_join(many, one, ["log_id"], "inner").count() == sum(1 for i in range(100) if i % 12 < 10)


def test_only_directories_asked_for_are_read(spark, served):
    requests = spark.createDataFrame([(1, 2, 3, 5)], REQUESTS["inclusion_proof"])
    plan = answer(requests, "inclusion_proof", served)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("dynamicpruning") >= 1 and "Cartesian" not in plan and "NestedLoop" not in plan
    asked = spark.createDataFrame([(1, 2, bytearray(32))], "request_id long, log_id long, leaf_hash binary")
    found = hashindex.lookup(asked, served.index, F.col("leaf_hash"))
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()
