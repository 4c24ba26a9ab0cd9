"""Inputs that once crashed an operator, doubled rows or lost them."""

import base64
import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from merklake.llm import bpe, decontaminate, jaccard, neighbours, secrets, token_counts, toxicity, url_filter
from merklake.llm.queries import VOCABULARY

INNER = ["_text", "_bits", "_bucket", "_stretches", "_secrets", "_contamination", "_toxicity", "_rule", "_row", "row", "f0", "f1", "component"]


def spans_of(text):
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    return [(s["kind"], text[s["start"] : s["end"]]) for s in secrets.find_spans(raw, np.array([0, len(raw)]))[0]]


def test_nested_header_is_no_secret():
    header = base64.urlsafe_b64encode(("{" + '"a":' + "[" * 60_000).encode()).decode().rstrip("=")
    assert spans_of(f"{header}.eyJhYmM.{'x' * 20}") == []


def test_token_headers():
    header = base64.urlsafe_b64encode(json.dumps({"alg": "HS256"}).encode()).decode().rstrip("=")
    token = f"{header}.eyJhYmM.{'x' * 20}"
    assert spans_of(f"EYJ{token}") == [("jwt", token)]
    assert spans_of(f"eyJeyJ {token}, {header} {token}") == [("jwt", token)] * 2
    begun = time.perf_counter()
    assert spans_of("eyJa" * 250_000 + " " + token) == [("jwt", token)]
    assert time.perf_counter() - begun < 10


@pytest.mark.parametrize("text, cards", [
    ("2 4111 1111 1111 1111", ["4111 1111 1111 1111"]), ("4111-1111-1111-1111", ["4111-1111-1111-1111"]),
    ("4111 1111 1111 1112", []), ("1" * 40, []), ("94111111111111111", []),
])
def test_cards_after_other_numbers(text, cards):
    assert [s for kind, s in spans_of(text) if kind == "card"] == cards


def test_pages_are_judged_once(spark):
    """1.2 is a number without a suffix, x.1.2 has the suffix 2; both have the domain 1.2."""
    urls = ["http://1.2/a", "http://x.1.2/b", "http://a.co.uk:80/", "http://co.uk/", "http://u@b.a.co.uk/", "http://10.0.0.1:8/", None, "http://x/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").withColumn("_rule", F.lit("mine"))
    outcomes = spark.createDataFrame([(0, True), (1, False), (2, False)], "page_id bigint, good boolean")
    rows = url_filter.judge(pages, outcomes, [url_filter.Rule("block", "x", "/")]).collect()
    assert sorted(r.page_id for r in rows) == list(range(len(urls))) and {r._rule for r in rows} == {"mine"}
    assert url_filter.judge(pages.limit(0), outcomes, []).count() == 0


def test_vectors_of_other_lengths(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(30)] + [(99, [1.0, 2.0, 3.0, 4.0])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = neighbours.nearest(table, table.where("vec_id % 2 = 0"), 20).groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in found} == {i: 20 for i in range(0, 30, 2)}


def test_columns_named_like_inner_ones(spark, documents):
    texts = ["password = hunter22 and more", "same words here in this text now", "same words here in this text now", None, ""] + [f"clean text number {i}" for i in range(9)]
    docs = documents(texts).select("*", *[F.lit(c).alias(c) for c in INNER])
    labels = spark.createDataFrame([(i, 1, int(i == 0)) for i in range(8)], "doc_id bigint, quality int, toxic int")
    bench = spark.createDataFrame([(1, "only other words are benchmark words of this item")], "item_id bigint, text string")

    def same(rows, n):
        kept = rows.select("doc_id", *INNER).collect()
        assert len(kept) == n and all(r[c] == c for r in kept for c in INNER)

    same(token_counts.count_tokens(docs, VOCABULARY), len(texts))
    same(bpe.encode(docs, VOCABULARY), len(texts))
    same(secrets.redact(docs), len(texts))
    same(decontaminate.remove_documents(docs, bench), len(texts))
    same(decontaminate.remove_spans(docs, bench), len(texts))
    same(jaccard.keep_one(docs, jaccard.Rule(5, 80)), len(texts) - 1)
    same(toxicity.reject(docs, labels, threshold=2.0), len(texts))
    for empty in (token_counts.count_tokens(docs.limit(0), VOCABULARY), bpe.encode(docs.limit(0), VOCABULARY), secrets.redact(docs.limit(0))):
        assert empty.count() == 0
