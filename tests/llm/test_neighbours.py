import numpy as np

from merklake.llm import queries
from merklake.llm.neighbours import Settings, nearest, probe_order

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(ids, vectors, wanted, k):
    out = {}
    for q in wanted:
        scores = (vectors * vectors[ids.index(q)]).sum(axis=1)
        best = sorted((-s, i) for s, i in zip(scores.tolist(), ids, strict=True) if i != q)[:k]
        out[q] = [(i, -s) for s, i in best]
    return out


def found(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_recall_on_the_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    ids, vectors = [r.vec_id for r in rows], np.array([r.embedding for r in rows], dtype=np.float64)
    truth = brute(ids, vectors, [i for i in ids if i % 20 == 0], 20)
    result = queries.op8_nearest_neighbours(spark, sf_dir).collect()
    assert all(1 <= r.rank <= 20 for r in result)
    got = found(result)
    score = dict(zip(ids, range(len(ids)), strict=True))
    for q, near in got.items():
        assert all(abs(s - vectors[score[q]] @ vectors[score[v]]) < 1e-12 for v, s in near)
        assert near == sorted(near, key=lambda x: (-x[1], x[0]))
    hits = sum(len({i for i, _ in near} & {i for i, _ in got[q]}) for q, near in truth.items())
    assert hits / sum(map(len, truth.values())) >= 0.9


def test_every_cell_gives_exact_neighbours(spark):
    """With slots as wide as the space all rows are candidates; hot cells are split into pieces; norms differ."""
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((300, 8)).astype(np.float32) * rng.uniform(0.1, 3, (300, 1)).astype(np.float32)
    vectors[40:100] = vectors[40]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)]
    odd = [(1000, None, 0), (1001, [0.0] * 8, 0), (1002, [float("nan")] + [1.0] * 7, 0), (1003, [None] + [1.0] * 7, 0), (1004, [1.0] * 3, 0), (None, [1.0] * 8, 0), (1005, [float("inf")] * 8, 0), rows[7]]
    table = spark.createDataFrame(rows + odd, SCHEMA)
    got = found(nearest(table, table.where("vec_id % 20 = 0"), 20, settings=Settings(width=1e6, probes=2, piece=16)).collect())
    truth = brute(list(range(300)), vectors.astype(np.float64), range(0, 300, 20), 20)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in truth.items()}


def test_repeated_rows_take_one_place(spark):
    """25 copies of one row in every cell and piece; one id with 25 vectors of one score."""
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((120, 4)).round(1)
    vectors[0, 3] = 0
    vectors[7] = 2 * vectors[0]
    ids = [*range(120), *[200] * 25]
    aside = np.array([[*(3 * vectors[0, :3]), float(i)] for i in range(25)])  # the last coordinate meets a zero of the query
    rows = [(i, v.tolist(), 0) for i, v in zip(ids, [*vectors, *aside], strict=True)] + [(7, vectors[7].tolist(), 0)] * 24
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    truth = brute([*range(120), 200], np.vstack((vectors, aside[:1])), [0], 20)
    assert {i for i, _ in truth[0]} >= {7, 200}
    for piece in (16, 1000):
        got = found(nearest(table, table.where("vec_id = 0"), 20, settings=Settings(width=1e6, probes=2, piece=piece)).collect())
        assert [i for i, _ in got[0]] == [i for i, _ in truth[0]]


def test_few_and_none(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [1.0, 1.0], 0), (2, [2.0, 0.0], 0)], SCHEMA)
    got = found(nearest(table, table.where("vec_id = 0"), 20, settings=Settings(width=1e6)).collect())
    assert got == {0: [(2, 2.0), (1, 1.0)]}
    assert nearest(table.limit(0), table.limit(0), 5).count() == 0


def test_every_query_gets_its_k(spark, sf_dir, tmp_path):
    """The registered query on few rows, and on rows of which one is so long that all others lie in few cells."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    long = [(r.vec_id, [x * 200 for x in r.embedding] if r.vec_id == 1 else r.embedding, 0) for r in rows]
    for name, own in (("few", [(r.vec_id * 20, r.embedding, 0) for r in rows[:15]]), ("long", long)):
        spark.createDataFrame(own, SCHEMA).write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        got = found(queries.op8_nearest_neighbours(spark, f"{tmp_path}/{name}").collect())
        ids = [i for i, _, _ in own]
        due = min(20, len(own) - 1)
        assert {q: len({i for i, _ in near}) for q, near in got.items()} == {i: due for i in ids if i % 20 == 0}
        if name == "few":
            truth = brute(ids, np.array([v for _, v, _ in own], dtype=np.float64), ids, 20)
            assert {q: [i for i, _ in near] for q, near in got.items()} == {q: [i for i, _ in near] for q, near in truth.items()}


def test_short_queries_probe_on(spark):
    """More rows than one block: further cells first, then all rows in blocks, whatever the settings."""
    rng = np.random.default_rng(8)
    vectors = rng.standard_normal((200, 8))
    table = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>, label int")
    settings = Settings(tables=1, hashes=2, width=0.05, probes=3, piece=32)
    got = found(nearest(table, table.where("vec_id % 4 = 0"), 20, settings=settings).collect())
    truth = brute(list(range(200)), vectors, range(0, 200, 4), 20)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in truth.items()}


def test_probes_come_in_order_of_cost():
    gap = np.array([0.1, 0.6, 0.45])
    steps = probe_order(gap, 27)
    cost = [sum((g if s < 0 else 1 - g) ** 2 for g, s in zip(gap, step, strict=True) if s) for step in steps]
    assert len({tuple(s) for s in steps}) == 27 and np.allclose(cost, sorted(cost))
