"""Stores that grow, and their publication at one instant."""

import pytest
from pyspark.sql import functions as F

from merklake.operators import compare, hashindex
from merklake.plans import migrate, store, validate
from merklake.plans.answer import answer
from merklake.schemas import REQUESTS
from merklake.sources.scratch import materialize, new_location
from tests.reference_tree import Brute, leaf

STEPS = {1: [5, 256, 600], 2: [0, 513, 600], 3: [65_530, 65_530, 66_000], 4: [255, 257, 600]}
SIZE = {log: steps[-1] for log, steps in STEPS.items()}


def value(log, i):
    return b"%d:%d" % (log, i)


@pytest.fixture(scope="module")
def leaves(spark):
    rows = spark.createDataFrame(list(SIZE.items()), "log_id long, n long").select(
        "log_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("leaf_index")
    )
    made = rows.select(
        "*", F.concat_ws(":", "log_id", "leaf_index").cast("binary").alias("leaf_value"),
        (F.col("leaf_index") + 10**18).alias("queue_ts_nanos"), (F.col("leaf_index") * 3 + 10**18).alias("integrate_ts_nanos"),
    )
    return materialize(made, "leaves")


@pytest.fixture(scope="module")
def brutes():
    return {log: Brute([leaf(value(log, i)) for i in range(n)]) for log, n in SIZE.items()}


def sources(spark, brutes, finish, logs=SIZE, **other):
    rows = [(log, SIZE[log], bytearray(other.get("root") or brutes[log].root(0, SIZE[log])), 7, finish(log)) for log in logs]
    return spark.createDataFrame(rows, "log_id long, tree_size long, root_hash binary, timestamp_nanos long, finish long")


def differences(spark, leaves, location, sizes):
    expected = spark.createDataFrame(list(sizes.items()), "log_id long, tree_size long")
    found = validate.validate_store(leaves, store.read_stored(spark, location), expected=expected)
    return [tuple(r) for r in found.where("field != 'checkpoint_missing' or right is not null").collect()]


def test_growth_is_as_a_whole_migration(spark, leaves, brutes):
    """After two growths every stored table equals what all leaves give, over tile levels and partial tiles alike."""
    location = new_location(spark, "store")
    for k in range(3):
        step = migrate.migrate if k == 0 else migrate.grow
        done = step(leaves, sources(spark, brutes, lambda log: STEPS[log][k]), location)
        assert done.findings.count() == 0
        changed = {log for log in SIZE if k == 0 or STEPS[log][k] > STEPS[log][k - 1]}
        assert {r.log_id: (r.tree_size, bytes(r.root_hash)) for r in done.checkpoints.collect()} == {
            log: (STEPS[log][k], brutes[log].root(0, STEPS[log][k])) for log in changed
        }
    assert differences(spark, leaves, location, SIZE) == []
    manifest = store.read_manifest(spark, location).collect()
    assert {r.log_id: [g.until for g in r.generations] for r in manifest} == {
        1: [5, 256, None], 2: [0, 513, None], 3: [65_530, None], 4: [255, 257, None]
    }

    registry = spark.createDataFrame([(log, 7, "x") for log in SIZE], "log_id long, frozen_time_nanos long, location string")
    served = store.open_store(spark, location, registry)
    rows = [(i, log, m, t) for i, (log, m, t) in enumerate((log, m, t) for log in SIZE for t in (1, 5, 255, 256, 257, 513, 600) for m in (1, 4, 200, 256, 512) if m <= t)]
    for r in answer(spark.createDataFrame(rows, REQUESTS["consistency_proof"]), "consistency_proof", served).collect():
        assert [bytes(h) for h in r.hashes] == brutes[r.log_id].consistency(r.first_tree_size, r.second_tree_size)


def test_growth_reads_no_old_leaf(spark, leaves, brutes):
    location, only = new_location(spark, "store"), [1, 4]
    migrate.migrate(leaves, sources(spark, brutes, lambda log: 300, only), location)
    unread = F.when(F.col("leaf_index") < 300, F.raise_error(F.lit("an old leaf was read"))).otherwise(F.col("leaf_value"))
    done = migrate.grow(leaves.withColumn("leaf_value", unread.cast("binary")), sources(spark, brutes, lambda log: -1, only), location)
    assert done.findings.count() == 0 and done.checkpoints.count() == 2
    assert differences(spark, leaves, location, {1: 600, 4: 600}) == []


def test_logs_that_cannot_grow_stay(spark, leaves, brutes):
    location, only = new_location(spark, "store"), [1, 2]
    migrate.migrate(leaves, sources(spark, brutes, lambda log: 300, only), location)

    def findings(df=leaves, logs=(1,), finish=-1, **other):
        done = migrate.grow(df, sources(spark, brutes, lambda log: finish, logs, **other), location)
        assert done.checkpoints.count() == 0
        return {(r.log_id, r.error_code, r.first_index) for r in done.findings.collect()}

    assert findings(logs=(4,)) == {(4, "LOG_NOT_STORED", None)}
    assert findings(finish=299) == {(1, "SIZE_SHRINKS", None)}
    assert findings(finish=300) == set()
    assert findings(finish=None) == {(1, "BOUND_MISSING", None)}
    assert findings(leaves.where("leaf_index != 400")) == {(1, "INCOMPLETE", None)}
    assert findings(leaves.where("leaf_index < 300")) == {(1, "INCOMPLETE", None)}
    assert findings(leaves.withColumn("queue_ts_nanos", F.when(F.col("leaf_index") != 301, F.col("queue_ts_nanos")))) == {(1, "TIME_MISSING", 301)}
    # The source has another first leaf than the one stored, though growth never reads it.
    other = Brute([leaf(b"other"), *brutes[1].hashes[1:]]).root(0, 600)
    assert findings(root=other) == {(1, "ROOT_DIFFERS", None)}
    assert differences(spark, leaves, location, {1: 300, 2: 300}) == []


@pytest.mark.parametrize("step", ["migrate", "grow"])
def test_stopped_writes_leave_the_published_copy(spark, leaves, brutes, monkeypatch, step):
    """A run that stops after any of its writes changes nothing for readers; repeated, it publishes."""
    location = new_location(spark, "store")
    migrate.migrate(leaves, sources(spark, brutes, lambda log: 300, [1]), location)
    again = getattr(migrate, step)
    run = [0]

    class Stopped(Exception):
        pass

    def stopping(function, name):
        def call(*args, **kwargs):
            run[0] -= 1
            if run[0] < 0:
                raise Stopped(name)
            return function(*args, **kwargs)

        return call

    for module, name in ((migrate, "write_by_part"), (migrate, "write_by_log"), (hashindex, "write"), (store, "publish")):
        monkeypatch.setattr(module, name, stopping(getattr(module, name), name))
    names = ["write_by_part", "write_by_log", "write_by_log", "write_by_part", "write", "publish"]
    for writes in range(6) if step == "grow" else (0, 5):
        run[0] = writes
        with pytest.raises(Stopped) as stopped:
            again(leaves, sources(spark, brutes, lambda log: -1, [1]), location)
        assert str(stopped.value) == names[writes]
        stored = store.read_stored(spark, location)
        assert [(r.tree_size, bytes(r.root_hash)) for r in stored.checkpoints.collect()] == [(300, brutes[1].root(0, 300))]
        assert (stored.index.count(), stored.bundles.count(), stored.paths.count()) == (300, 2, 2)
    assert differences(spark, leaves, location, {1: 300}) == []
    run[0] = 6
    again(leaves, sources(spark, brutes, lambda log: -1, [1]), location)
    assert differences(spark, leaves, location, {1: 600}) == []




def test_descent_opens_differing_bundles_only(spark, leaves, brutes):
    """Differences as compare_leaves() finds them; values of bundles that are equal are never read."""
    mine = leaves.where("log_id in (1, 2)")
    copy = mine.withColumn("leaf_value", F.when((F.col("log_id") == 1) & (F.col("leaf_index") == 300), F.lit(bytearray(b"x"))).otherwise(F.col("leaf_value")))
    copy = copy.withColumn("queue_ts_nanos", F.when((F.col("log_id") == 2) & (F.col("leaf_index") == 520), 5).otherwise(F.col("queue_ts_nanos")))
    copy = materialize(copy.where("log_id = 1 or leaf_index < 599"), "copy")
    hashes = {1: [*brutes[1].hashes], 2: brutes[2].hashes[:599]}
    hashes[1][300] = leaf(b"x")

    def stored(df, roots):
        location = new_location(spark, "store")
        rows = [(log, n, bytearray(root), 7, -1) for log, (n, root) in roots.items()]
        done = migrate.migrate(df, spark.createDataFrame(rows, "log_id long, tree_size long, root_hash binary, timestamp_nanos long, finish long"), location)
        assert done.findings.count() == 0
        tables = store.read_stored(spark, location)
        equal = ((F.col("log_id") == 1) & (F.col("bundle_index") != 1)) | ((F.col("log_id") == 2) & (F.col("bundle_index") != 2))
        unread = F.when(equal, F.raise_error(F.lit("an equal bundle was opened"))).otherwise(F.col("bytes"))
        return store.StoredTables(tables.checkpoints, tables.bundles.withColumn("bytes", unread.cast("binary")), tables.tiles, tables.paths, tables.index)

    left = stored(mine, {log: (600, brutes[log].root(0, 600)) for log in (1, 2)})
    right = stored(copy, {log: (len(h), Brute(h).root(0, len(h))) for log, h in hashes.items()})
    got = {tuple(r) for r in validate.compare_stored(left, right).collect()}
    assert {(r[0], r[1], r[2]) for r in got} == {(1, 300, "leaf_value"), (1, 300, "merkle_leaf_hash"), (2, 520, "queue_ts_nanos"), (2, 599, "presence")}
    assert got == {tuple(r) for r in compare.compare_leaves(mine, copy).collect()}
    assert validate.differing_bundles(left, left).count() == 0
