import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from merklake.llm import importance, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features_of(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute(docs, target, settings):
    """(doc_id, n_features, weight, score, rank) of each (doc_id, text); rows that tie in all are interchangeable."""
    def counts(texts):
        out = [0] * settings.buckets
        for text in texts:
            for f in features_of(text)[1]:
                out[zlib.crc32(f.encode()) % settings.buckets] += 1
        return out

    s, t = counts(x for _, x in docs), counts(target)
    S, T = sum(s), sum(t)
    gains = [math.floor(1000 * math.log((b + 1) * (S + settings.buckets) / ((a + 1) * (T + settings.buckets)))) for a, b in zip(s, t, strict=True)]
    rows = []
    for i, text in docs:
        n_words, features = features_of(text)
        weight = sum(gains[zlib.crc32(f.encode()) % settings.buckets] for f in features)
        h = int(hashlib.sha256(f"{settings.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((n_words, i, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in rows if r[0] >= settings.least_words), key=lambda r: (-r[4], r[1] is None, r[1] or 0))
    drawn = {}
    for rank, r in enumerate(fit[: settings.percent * len(fit) // 100], 1):
        drawn.setdefault(r, []).append(rank)
    return sorted(((*r[1:], drawn[r].pop() if drawn.get(r) else None) for r in rows), key=str)


def found(spark, docs, target, settings, **options):
    table = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    bench = spark.createDataFrame([(x,) for x in target], "text string")
    out = importance.draw(table, bench, settings, ["doc_id"], **options).select("doc_id", "drawn.*")
    return sorted((tuple(r) for r in out.collect()), key=str)


TARGET = ["the quick brown fox", "Ünï çode words, and more WORDS", None, ""]


def some_docs(n, seed=1):
    rng = random.Random(seed)
    vocabulary = ["the", "Quick", "brown", "fox", "ünï", "çode", "a" * 63, "b" * 64, "c" * 65, "d" * 3000, "x1", "0"]
    return [(i, rng.choice([" ", "--", "\n"]).join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for i in range(n)]


@pytest.mark.parametrize("finish", [importance.FINISH, 1])
def test_against_brute_force(spark, finish):
    docs = [*some_docs(150), (None, "the fox " * 30), (None, None), (7, ""), (9, "..."), (-5, "quick brown " * 5000)]
    settings = importance.Settings(buckets=97, percent=20)
    assert found(spark, docs, TARGET, settings, finish=finish) == brute(docs, TARGET, settings)


def test_ties_and_repeated_rows(spark):
    """The cut goes through rows equal in all, which are a third of all rows."""
    docs = [*some_docs(60), *[(500, "the quick brown fox " * 10)] * 40]
    settings = importance.Settings(percent=30)
    got = found(spark, docs, TARGET, settings, finish=1)
    assert got == brute(docs, TARGET, settings)
    assert sorted(r[4] for r in got if r[4]) == list(range(1, sum(r[4] is not None for r in got) + 1))


def test_each_place_by_medians(spark):
    rng = random.Random(3)
    keys = [(rng.randint(-4, 4), rng.randint(0, 5), i) for i in range(300)]
    table = spark.createDataFrame(keys, "score bigint, tie bigint, serial bigint").repartition(7).cache()
    order = sorted((-s, t, r) for s, t, r in keys)
    for place in (1, 2, 77, 150, 299, 300):
        assert importance.key_at(table, place, finish=1) == order[place - 1]


def test_small_and_empty_tables(spark, documents):
    bench = spark.createDataFrame([], "text string")
    assert importance.draw(documents([]), bench).count() == 0
    rows = importance.draw(documents(["a b", None]), bench, keep=["doc_id"]).collect()
    assert [(r.doc_id, r.drawn.n_features, r.drawn["rank"]) for r in sorted(rows)] == [(0, 3, None), (1, 0, None)]


def test_clashing_columns(spark, documents):
    names = ["row", "id", "n_words", "weight", "score", "tie", "serial", "rank", "at", "part", "drawn", "importance_row"]
    docs = documents([f"word{i} " * 25 for i in range(40)]).select("*", *[F.lit(n).alias(n) for n in names])
    bench = spark.createDataFrame([("word3 word3",)], "text string")
    out = importance.resample(docs, bench, importance.Settings(percent=10))
    assert out.columns == docs.columns and out.count() == 4
    assert out.where(" and ".join(f"{n} = '{n}'" for n in names)).count() == 4
    every = importance.draw(docs, bench)
    assert every.columns == [*[c for c in docs.columns if c != "drawn"], "drawn"] and every.count() == 40


def test_query_against_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = queries.op12_resample(spark, sf_dir)
    assert dict(got.dtypes) == dict.fromkeys(["doc_id", "n_features", "weight", "score", "rank"], "bigint")
    got = sorted((tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)
    assert got == brute(docs, target, importance.Settings())
