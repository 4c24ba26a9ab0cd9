import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from merklake.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id bigint, text string, lang string, source string"


def brute(rows):
    """(lang, source, part, item, value, rank) of rows (text, lang, source), with Python's own integers."""
    counts, seen = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        counts[lang or "", source or ""].update(terms)
        seen[lang or ""].update(set(terms))
    out = []
    for lang in {k for k, _ in counts}:
        kept = sorted(t for t, n in seen[lang].items() if n >= 3)
        sources = [s for k, s in counts if k == lang]

        def share(count, total):
            return 1 + 10**9 * (count + 1) // (total + len(kept))

        totals = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: share(counts[lang, s][t], totals[s]) for t in kept} for s in sources}
        whole = {t: share(sum(counts[lang, s][t] for s in sources), sum(totals.values())) for t in kept}
        for s in sources:
            pairs = [(x, sum((p[s][t] - p[x][t]) ** 2 // p[x][t] for t in kept)) for x in sources if x != s]
            terms = [(t, (p[s][t] - whole[t]) ** 2 // whole[t]) for t in kept if counts[lang, s][t] and p[s][t] > whole[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, 200)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, rank) for rank, (item, value) in enumerate(found[:most], 1)]
    return sorted(out)


def found(spark, rows, **options):
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in divergence.audit(table, **options).select("lang", "source", "part", "item", "value", "rank").collect())


def some_rows(n):
    rng = random.Random(5)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)] + ["Ünï", "ünï", "ÇODE", "a1b", "don't"]
    weights = [1 / (i + 1) for i in range(len(words))]
    return [(" ".join(rng.choices(words, weights, k=rng.randint(0, 120))), rng.choice(["en", "de", None]), f"s{rng.randint(0, 4)}") for _ in range(n)]


ODD = [(None, "en", "quiet"), ("", "en", None), ("1 2 ... 3", None, None), ("alone once", "xx", "only"), ("mostly " * 60_000, "en", "s1"), (None, "yy", "a"), ("x", "yy", "b")]


@pytest.mark.parametrize("chunk_rows", [divergence.CHUNK_ROWS, 100])
def test_against_brute_force(spark, chunk_rows):
    rows = some_rows(200) + ODD + [("same text here", "de", "s2")] * 70
    assert found(spark, rows, chunk_rows=chunk_rows) == brute(rows)


def test_more_terms_than_shown_and_ties(spark):
    """300 terms of equal value: 200 of them are given, by their bytes, from several chunks."""
    terms = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}z" for i in range(300)] + ["éa", "zz"]
    rows = [(" ".join(terms), "en", "many")] * 3 + [("other words here", "en", "few")] * 3
    assert found(spark, rows, chunk_rows=40) == brute(rows)


def test_cells_by_complement():
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 6, 1000), rng.integers(0, 9, 1000)
    a, b = (divergence.Bitmaps(np.flatnonzero(v), v[v > 0]) for v in (x, y))
    cells = divergence.joint_cells(a, b, b.dense(16), 1000)
    want = np.array([[((x == i) & (y == j)).sum() for j in range(9)] for i in range(6)])
    assert (cells == want).all()


def test_shares_are_exact_for_large_counts():
    counts = [0, 5, 10**12, 7 * 10**12 + 3]
    total, kinds = 8 * 10**12, 123_457
    assert divergence.shares(np.array(counts), total, kinds).tolist() == [1 + 10**9 * (c + 1) // (total + kinds) for c in counts]


def test_empty_table_and_clashing_columns(spark, documents):
    assert divergence.audit(documents([])).count() == 0
    docs = documents(["some words", "some words", "some other words"]).select("*", *[F.lit("!").alias(c) for c in ("term", "n", "docs", "chunk", "value", "rank", "part")])
    got = divergence.audit(docs)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"] and got.count() == 0
