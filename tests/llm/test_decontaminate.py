import re

import pytest
from pyspark.sql import functions as F

from merklake.llm.decontaminate import find_contamination, remove_documents, remove_spans

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(texts, items, window=10):
    out = []
    for text in texts:
        own, hit, found = words_of(text), set(), set()
        for item, item_text in items:
            w = words_of(item_text)
            n = min(window, len(w))
            for i in range(len(w) - n + 1 if n else 0):
                for j in range(len(own) - n + 1):
                    if own[j : j + n] == w[i : i + n]:
                        hit.update(range(j, j + n))
                        found.add(item)
        out.append((len(own), len(hit), sorted(str(x) for x in found if x is not None)))
    return out


LONG = " ".join(f"w{i}" for i in range(25))
ITEMS = [(7, LONG), (10, "Only THREE, words"), (2, None), (3, ""), (None, "nameless item"), (11, "only three words"), (12, "ünï çode")]
TEXTS = [
    None, "", "...", "only three", "x only-three WORDS only three words y", LONG.upper(), "a " + LONG[:60] + " b", "nameless item",
    " ".join(f"w{i}" for i in range(3, 13)) + " gap " + " ".join(f"w{i}" for i in range(12, 22)), "Ünï çode ünï çode", ("z " * 50_000) + LONG, LONG, LONG,
]


@pytest.mark.parametrize("block_rows", [200_000, 3])
def test_against_brute_force(spark, documents, block_rows):
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    rows = find_contamination(documents(TEXTS), bench, ["doc_id"], block_rows=block_rows).orderBy("doc_id").collect()
    assert [(r.contamination.n_words, r.contamination.n_hit, r.contamination["items"]) for r in rows] == brute(TEXTS, ITEMS)


def test_removal(spark, documents):
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    docs = documents(["héllo; Only three\nwords, bye", "clean", None]).withColumn("contamination", F.lit(1))
    assert [r.doc_id for r in remove_documents(docs, bench).orderBy("doc_id").collect()] == [1, 2]
    spans = remove_spans(docs, bench)
    assert spans.columns == docs.columns
    assert [r.text for r in spans.orderBy("doc_id").collect()] == ["héllo; , bye", "clean", None]


def test_empty_tables(spark, documents):
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert find_contamination(documents([]), bench).count() == 0
    rows = find_contamination(documents(["a b"]), bench.limit(0)).collect()
    assert (rows[0].contamination.n_words, rows[0].contamination.n_hit) == (2, 0)
