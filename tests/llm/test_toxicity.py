import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from merklake.llm import queries
from merklake.llm.toxicity import Index, fit, reject, score, terms_of

LABELS = "doc_id bigint, quality int, toxic int"


def test_nearest_against_brute_force():
    """Block-max search gives the neighbours of a full scan, ties by id."""
    rng = random.Random(4)
    rows = []
    for i in range(700):
        weights = {t: rng.choice([1.0, 2.0, 3.0]) for t in rng.sample(range(40), rng.randrange(1, 6))}
        size = sum(w * w for w in weights.values()) ** 0.5
        rows.append((i * 7 % 701, i % 3 == 0, {t: w / size for t, w in weights.items()}))
    index = Index.build([(i, int(y), v) for i, y, v in rows], 40)
    for own, _, query in rows[:150]:
        all_ = [(round(sum(w * v.get(t, 0) for t, w in query.items()), 9), i) for i, _, v in rows if i != own]
        best = sorted((x for x in all_ if x[0] > 0), key=lambda x: (-x[0], x[1]))[:15]
        found = index.nearest(query, 15, without=own)
        assert [round(s, 9) for s, _, _ in found] == [s for s, _ in best]
        assert len({i for _, i, _ in found}) == len(best) and all((round(s, 9), i) in all_ for s, i, _ in found)


def made(spark, documents):
    rng = random.Random(1)
    plain = [f"{a}{b}" for a in "ka li mo nu pe ri so".split() for b in "la re ti vo zu".split()]
    texts, labels = [], []
    for i in range(600):
        words = [rng.choice(plain) for _ in range(30)]
        toxic = i % 6 == 0
        if toxic:
            words[rng.randrange(30)] = rng.choice(["vexorim", "Vexolat", "GRUMP", "grump"])
        texts.append(" ".join(words))
        labels.append((i, 1, int(toxic)))
    return documents(texts), spark.createDataFrame(labels[:500], LABELS)


def test_held_out(spark, documents):
    docs, labels = made(spark, documents)
    docs = docs.withColumn("toxicity", F.lit("x")).union(documents([(1000, None), (1001, ""), (1002, "vexorumm " * 50_000)]).withColumn("toxicity", F.lit("x")))
    model = fit(docs, labels)
    got = {r.doc_id: r.toxicity for r in score(docs, model).collect()}
    assert len(got) == 603
    assert all((got[i].score >= 0.7) == (i % 6 == 0) for i in range(600))
    assert got[1000].score == got[1001].score < 0.2 and got[1000].neighbours == []
    assert got[1002].score >= 0.7 and got[1002].neighbours[0].toxic == 1
    held = {i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert not held & {n.doc_id for r in got.values() for n in r.neighbours}
    kept = reject(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 502


def test_odd_labels(spark, documents):
    docs, labels = made(spark, documents)
    odd = spark.createDataFrame([(None, 1, 1), (3, 1, None), (9999, 0, 1), (6, 1, 1)], LABELS)
    assert score(docs, fit(docs, labels.union(odd))).where("toxicity.score >= 0.7").count() == 100
    none = score(docs, fit(docs, labels.limit(0)))
    assert none.where("toxicity.score >= 0.7").count() == 0
    assert score(documents([]), fit(documents([]), labels)).count() == 0
    clean = score(docs, fit(docs, labels.where("toxic = 0")))
    assert clean.agg(F.max("toxicity.score")).first()[0] < 0.1


def test_terms():
    assert terms_of("ärger".encode()) == {"ärger ", "ärg", "ärge"}
    assert terms_of(b"ab") == {"ab "}


def test_query(spark, sf_dir):
    rows = queries.op10_toxicity(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and np.isfinite(r.score) and r.predicted == int(r.score >= 0.7)
