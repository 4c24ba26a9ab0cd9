import random

import pytest
from pyspark.sql import functions as F

from merklake.operators import merkle, proofs
from merklake.plans.answer import answer
from merklake.plans.store import LogStore
from merklake.schemas import REQUESTS
from merklake.sources.scratch import materialize
from tests.reference_tree import Brute, leaf

# Leaves and roots of the first n of them, fixed values.
LEAVES = ["", "00", "10", "2021", "3031", "40414243", "5051525354555657", "606162636465666768696a6b6c6d6e6f"]
ROOTS = [
    "6e340b9cffb37a989ca544e6bb780a2c78901d3fb33738768511a30617afa01d",
    "fac54203e7cc696cf0dfcb42c92a1d9dbaf70ad9e621f4bd8d98662f00e3c125",
    "aeb6bcfe274b70a14fb067a5e5578264db0fa9b51af5e0ba159158f329e06e77",
    "d37ee418976dd95753c1c73862b9398fa2a2cf9b4ff0fdfe8b30cd95209614b7",
    "4e3bbb1f7b478dcfe71fb631631519a3bca12c9aefca1612bfce4c13a86264d4",
    "76e67dadbcdf1e10e1b74ddc608abd2f98dfb16fbce75277b5232a127f2087ef",
    "ddb89be403809e325750d3d263cd78929c2942b7942a34b77e122c9594a74c8c",
    "5dc9da79a70659a9ad559cb701ded9a2ab9d823aad2f4960cfe370eff4604328",
]
SIZES = [1, 2, 3, 255, 256, 257, 511, 513, 600, 1000, 65537]


def value(log, i):
    return f"{log}:{i}".encode()


@pytest.fixture(scope="module")
def brutes():
    return {n: Brute([leaf(value(n, i)) for i in range(n)]) for n in SIZES}


@pytest.fixture(scope="module")
def store(spark):
    rows = spark.createDataFrame([(n,) for n in SIZES], "log_id long").select(
        "log_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("log_id") - 1)).alias("leaf_index")
    )
    value_col = F.concat_ws(":", "log_id", "leaf_index").cast("binary")
    leaves = materialize(
        rows.select("log_id", "leaf_index", F.unhex(F.sha2(F.concat(F.lit(bytearray(b"\0")), value_col), 256)).alias("merkle_leaf_hash")),
        "leaves",
    )
    tree = merkle.build_tree(leaves)
    logs = tree.roots().select("log_id", F.lit("o").alias("origin"), "tree_size", "root_hash", F.lit(7).cast("long").alias("frozen_time_nanos"))
    return LogStore(logs=materialize(logs, "logs"), paths=materialize(tree.paths(), "paths"))


def test_golden_roots(spark):
    rows = [(n, i, bytearray.fromhex(LEAVES[i])) for n in range(1, 9) for i in range(n)]
    df = spark.createDataFrame(rows, "log_id long, leaf_index long, v binary")
    leaves = df.withColumn("merkle_leaf_hash", F.unhex(F.sha2(F.concat(F.lit(bytearray(b"\0")), "v"), 256)))
    got = {r.log_id: r.root_hash.hex() for r in merkle.build_tree(leaves).roots().collect()}
    assert got == {n: ROOTS[n - 1] for n in range(1, 9)}


def test_roots(store, brutes):
    got = {r.log_id: (r.tree_size, bytes(r.root_hash)) for r in store.logs.collect()}
    assert got == {n: (n, b.root(0, n)) for n, b in brutes.items()}


def _pairs(n):
    rng = random.Random(n)
    edges = [t for t in {1, 2, 3, 127, 128, 129, 255, 256, 257, 511, 512, 513, n - 1, n, 4096, 65535, 65536} if 1 <= t <= n]
    if n <= 16:
        edges = list(range(1, n + 1))
    edges += [rng.randint(1, n) for _ in range(15)]
    return [(a, b) for a in edges for b in edges if a <= b]


def test_inclusion_at_any_size(spark, store, brutes):
    rows = [(i, *r) for i, r in enumerate((n, m - 1, t) for n in SIZES for m, t in _pairs(n))]
    requests = spark.createDataFrame(rows, REQUESTS["inclusion_proof"])
    out = answer(requests, "inclusion_proof", store, mode="requested").collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.status == "OK" and r.proof_tree_size == r.tree_size
        assert [bytes(h) for h in r.hashes] == brutes[r.log_id].inclusion(r.leaf_index, r.tree_size), r
    frozen = answer(requests, "inclusion_proof", store).collect()
    for r in frozen:
        assert [bytes(h) for h in r.hashes] == brutes[r.log_id].inclusion(r.leaf_index, r.log_id)
        assert r.root.tree_size == r.log_id and r.root.timestamp_nanos == 7


def test_consistency_at_any_sizes(spark, store, brutes):
    rows = [(i, *r) for i, r in enumerate((n, m, t) for n in SIZES for m, t in _pairs(n))]
    requests = spark.createDataFrame(rows, REQUESTS["consistency_proof"])
    # Hot keys are split from the second row on: the results must not change.
    for hot_rows in (1_000_000, 1):
        out = answer(requests, "consistency_proof", store, hot_rows=hot_rows).collect()
        assert len(out) == len(rows)
        for r in out:
            want = brutes[r.log_id].consistency(r.first_tree_size, r.second_tree_size)
            assert [bytes(h) for h in r.hashes] == want, r


def test_latest_root(spark, store, brutes):
    rows = [(i, n, t) for i, (n, t) in enumerate((n, t) for n in SIZES for t in (0, 1, n // 2, n, n + 1))]
    for r in answer(spark.createDataFrame(rows, REQUESTS["latest_root"]), "latest_root", store).collect():
        assert bytes(r.root.root_hash) == brutes[r.log_id].root(0, r.log_id)
        t = r.first_tree_size
        if 1 <= t <= r.log_id:
            assert [bytes(h) for h in r.hashes] == brutes[r.log_id].consistency(t, r.log_id)
        else:
            assert r.hashes is None


def test_every_leaf_proof_leads_to_the_root(store):
    every = proofs.all_inclusion_proofs(store.paths).join(store.logs, "log_id")
    led = proofs.root_from_inclusion(F.col("leaf_index"), F.col("tree_size"), F.col("leaf_hash"), F.col("hashes"))
    checked = every.select((led == F.col("root_hash")).alias("ok")).groupBy("ok").count().collect()
    assert [(r.ok, r["count"]) for r in checked] == [(True, sum(SIZES))]


def test_consistency_proofs_lead_to_both_roots(spark, store, brutes):
    rows = [(i, 600, a, b) for i, (a, b) in enumerate((a, b) for a in range(1, 41) for b in range(a + 1, 42))]
    out = answer(spark.createDataFrame(rows, REQUESTS["consistency_proof"]), "consistency_proof", store)
    roots = spark.createDataFrame([(t, bytearray(brutes[600].root(0, t))) for t in range(1, 42)], "t long, r binary")
    joined = out.join(roots.toDF("first_tree_size", "r1"), "first_tree_size").join(roots.toDF("second_tree_size", "r2"), "second_tree_size")
    led = proofs.roots_from_consistency(F.col("first_tree_size"), F.col("second_tree_size"), F.col("r1"), F.col("hashes"))
    bad = joined.select("first_tree_size", "second_tree_size", (led["first_root"] == F.col("r1")).alias("a"), (led["second_root"] == F.col("r2")).alias("b")).where("not (a and b)").count()
    assert joined.count() == len(rows) and bad == 0


def test_hash_tiles_hold_perfect_nodes_only(spark, store, brutes):
    rows = [(600, i, bytearray(h)) for i, h in enumerate(brutes[600].hashes)]
    leaves = spark.createDataFrame(rows, "log_id long, leaf_index long, merkle_leaf_hash binary")
    # A repeated copy of a leaf changes nothing.
    tree = merkle.build_tree(leaves.unionByName(leaves.where("leaf_index < 300")))
    got = {(r.tile_level, r.tile_index): (r.width, bytes(r.hashes)) for r in tree.hash_tiles().collect()}
    want = {(0, k): brutes[600].hashes[256 * k : 256 * k + 256] for k in range(3)}
    want[1, 0] = [brutes[600].root(0, 256), brutes[600].root(256, 512)]
    assert got == {k: (len(v), b"".join(v)) for k, v in want.items()}
    stored = tree.hash_tiles().where("tile_level = 0")
    assert merkle.tree_from_tiles(stored).roots().first().root_hash == brutes[600].root(0, 600)


def test_prefix_roots(spark, store, brutes):
    """Every size up to 1,000, and for the large log those around tiles, against the recursive definition."""
    got = {(r.log_id, r.tree_size): bytes(r.root_hash) for r in proofs.prefix_roots(store.paths, store.logs).collect()}
    assert got.keys() == {(n, t) for n in SIZES for t in range(1, n + 1)}
    for n in SIZES:
        sizes = range(1, n + 1) if n <= 1000 else [1, 255, 256, 257, 511, 512, 4096, 4097, 65280, 65281, 65535, 65536, 65537]
        assert all(got[n, t] == brutes[n].root(0, t) for t in sizes)
    asked = [(n, t) for n in SIZES for t in (-1, 0, 1, n // 2, n, n + 1)] + [(5, 1), (None, 1), (600, None)]
    table = spark.createDataFrame(asked, "log_id long, tree_size long")
    for r in proofs.roots_at(table, store.paths, store.logs).collect():
        known = r.log_id in SIZES and r.tree_size is not None and 0 <= r.tree_size <= r.log_id
        assert (r.root_hash and bytes(r.root_hash)) == (brutes[r.log_id].root(0, r.tree_size) if known else None)


def test_prefix_roots_need_their_tile(store):
    cut = store.paths.where("log_id = 600").withColumn("levels", F.when(F.col("tile_index") != 1, F.col("levels")))
    rows = proofs.prefix_roots(cut, store.logs.where("log_id = 600")).collect()
    assert {r.tree_size for r in rows if r.root_hash is None} == set(range(256, 512)) and len(rows) == 600
