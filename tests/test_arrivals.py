"""Streams of arriving leaves, their progress, and joins with many rows a key on both sides."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from merklake.operators import joins
from merklake.sources import registry
from merklake.streaming import arrivals

SCHEMA = "log_id bigint, leaf_index bigint"


@pytest.fixture
def log(spark, tmp_path):
    """Call with rows to let them arrive; gives progress by log."""
    source, seen, place = (str(tmp_path / name) for name in ("source", "seen", "place"))
    spark.createDataFrame([], SCHEMA).write.parquet(source)
    expected = spark.createDataFrame([(1, 600), (2, 3), (3, 0), (4, None)], "log_id bigint, tree_size bigint")

    def come(rows, start=True):
        if rows:
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        if start:
            arrivals.watch(spark.readStream.schema(SCHEMA).parquet(source), seen, place)
        return {r.log_id: tuple(r)[2:] for r in arrivals.progress(spark, seen, expected).collect()}

    return come


def test_progress_by_steps(log):
    assert log([])[1] == (0, 0, 0, False)
    # The second bundle before the first: nothing is dense yet.
    state = log([(1, i) for i in range(256, 512)] + [(2, 0), (2, 2), (None, 5), (2, None), (2, -1)])
    assert state == {1: (256, 0, 0, False), 2: (2, 0, 1, False), 3: (0, 0, 0, True), 4: (0, 0, 0, False)}
    state = log([(1, i) for i in range(256)] + [(2, 1), (2, 2)])
    assert state[1] == (512, 0, 512, False) and state[2] == (3, 1, 3, True)
    # No news: another start doubles nothing.
    assert log([]) == state
    # A gap in the last bundle, then growth past the size expected.
    assert log([(1, i) for i in range(512, 700) if i != 555])[1] == (699, 0, 555, False)
    assert log([(1, 555)])[1] == (700, 0, 700, True)


def test_a_batch_that_runs_again_replaces_its_rows(log, spark, tmp_path):
    state = log([(1, i) for i in range(100)])
    again = spark.createDataFrame([(1, i) for i in range(100)], SCHEMA)
    batch = max(int(p.name.split("=")[1]) for p in (tmp_path / "seen").glob("batch=*"))
    arrivals.checks.bundle_counts(again).drop("distinct_rows").write.mode("overwrite").parquet(str(tmp_path / f"seen/batch={batch}"))
    assert log([], start=False) == state


@pytest.mark.parametrize("hot_pairs", [1, 7, 100, 10**6])
def test_match_join(spark, hot_pairs):
    many = [(i, k) for i, k in enumerate(["a"] * 40 + ["b"] * 3 + ["c", "d"] + [None] * 4)]
    other = [(i, k) for i, k in enumerate(["a"] * 30 + ["b"] + ["c"] * 50 + ["e"] * 9 + [None] * 4)]
    left, right = spark.createDataFrame(many, "request_id bigint, k string"), spark.createDataFrame(other, "j bigint, k string")
    met = joins.match_join(left, right, ["k"], F.col("request_id"), F.col("j"), hot_pairs)
    assert Counter((r.request_id, r.j) for r in met.collect()) == Counter((i, j) for i, a in many for j, b in other if a is not None and a == b)


YAML = """# registry
other:
  77:
    frozenTime: 5
logMap:
  123456:   # first
    frozenTime: 1741241241
    bucketName: "logs-one"

  "-7":
    bucketname: 'two words'
  8:
"""


def test_yaml_registry(spark, tmp_path):
    path = tmp_path / "config.yaml"
    path.write_text(YAML)
    rows = {tuple(r) for r in registry.read_config(spark, str(path)).collect()}
    assert rows == {(123456, 1741241241, "logs-one"), (-7, 0, "two words"), (8, 0, "")}


@pytest.mark.parametrize("text", ["logMap:\n  12: {frozenTime: 1}\n", "logMap:\n  - 12\n", "logMap:\n  12:\n    frozenTime: soon\n", "logMap:\n  abc:\n    frozenTime: 1\n"])
def test_bad_yaml(spark, tmp_path, text):
    path = tmp_path / "config.yml"
    path.write_text(text)
    with pytest.raises(ValueError):
        registry.read_config(spark, str(path))
