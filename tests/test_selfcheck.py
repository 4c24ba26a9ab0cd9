"""Stores held against their own records."""

import glob

import pytest
from pyspark.sql import functions as F

from merklake.plans import migrate, selfcheck, store
from merklake.sources.scratch import materialize, new_location
from tests.reference_tree import Brute, leaf

SIZE = {1: 700, 2: 0, 3: 300}


@pytest.fixture(scope="module")
def leaves(spark):
    rows = spark.createDataFrame([(log, n) for log, n in SIZE.items() if n], "log_id long, n long")
    rows = rows.select("log_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("leaf_index"))
    made = rows.select(
        "*", F.concat_ws(":", "log_id", "leaf_index").cast("binary").alias("leaf_value"),
        (F.col("leaf_index") + 10**18).alias("queue_ts_nanos"), (F.col("leaf_index") * 3 + 10**18).alias("integrate_ts_nanos"),
    )
    return materialize(made, "leaves")


def sources(spark, finish):
    rows = [(log, n, bytearray(Brute([leaf(b"%d:%d" % (log, i)) for i in range(n)]).root(0, n)), 7, min(finish, n)) for log, n in SIZE.items() if n]
    rows.append((2, 0, None, 7, 0))
    return spark.createDataFrame(rows, "log_id long, tree_size long, root_hash binary, timestamp_nanos long, finish long")


def problems(spark, location):
    return {(r.log_id, r.stored_table, r.directory, r.problem) for r in selfcheck.self_check(spark, location).collect()}


@pytest.fixture
def recorded(spark, leaves):
    location = new_location(spark, "store")
    migrate.migrate(leaves, sources(spark, 400), location)
    selfcheck.record(spark, location)
    return location


def spoil(location, pattern):
    """Overwrite the files that match, as decay would; how many there were."""
    files = glob.glob(f"{location}/{pattern}/*.parquet".replace("file:", ""))
    for name in files:
        with open(name, "r+b") as file:
            file.write(b"spoiled bytes")
            file.truncate()
    return len(files)


def test_sound_store_and_growth(spark, leaves, recorded):
    assert problems(spark, recorded) == set()
    before = selfcheck.read_records(spark, recorded).count()
    selfcheck.record(spark, recorded)
    assert selfcheck.read_records(spark, recorded).count() == before
    migrate.grow(leaves, sources(spark, 700), recorded)
    assert problems(spark, recorded) == {(1, None, None, "not_recorded")}
    selfcheck.record(spark, recorded)
    assert problems(spark, recorded) == set()
    assert selfcheck.read_records(spark, recorded).count() > before


def test_files_that_cannot_be_read(spark, recorded):
    assert spoil(recorded, "bundles/generation=*/log_id=1/part=0") and spoil(recorded, "hash_index/generation=*/log_id=3/prefix_dir=a")
    assert problems(spark, recorded) == {(1, "bundles", "0", "missing"), (3, "hash_index", "a", "missing")}


def test_tables_that_are_gone(spark, recorded):
    bare = new_location(spark, "bare")
    for table in ("manifest", "records"):
        spark.read.parquet(f"{recorded}/{table}").write.parquet(f"{bare}/{table}")
    found = problems(spark, bare)
    assert {p for *_, p in found} == {"missing"}
    assert len(found) == selfcheck.read_records(spark, recorded).count()


def test_records_that_are_gone(spark, recorded):
    bare = new_location(spark, "bare")
    spark.read.parquet(f"{recorded}/manifest").write.parquet(f"{bare}/manifest")
    assert problems(spark, bare) == {(1, None, None, "not_recorded"), (3, None, None, "not_recorded")}


def test_swapped_nulls_and_order(spark):
    """Equal rows in any order give equal sums; values that change places do not."""
    schema = store.TABLES["hash_index"]

    def sums(rows):
        df = spark.createDataFrame(rows, schema)
        return df.agg(F.sum(selfcheck._row_hash(schema, 1)), F.sum(selfcheck._row_hash(schema, 2))).first()

    first, second = ("0a", None, 1, 1, "0"), (None, bytearray(b"0a"), 1, 1, "0")
    assert sums([first, second]) == sums([second, first])
    assert sums([first]) != sums([second])
    assert sums([first, first]) != sums([first]) and sums([first, first, second]) != sums([first, second, second])
