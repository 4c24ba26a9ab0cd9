import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from merklake.llm import queries
from merklake.llm.jaccard import Rule
from tests.llm import test_decontaminate, test_jaccard, test_secrets


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """Rows of the documents and of each stage, as run() makes them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], sf_dir))
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert out[-1].columns == docs.columns and out[-1].dtypes == docs.dtypes
    return [{r.doc_id: r for r in df.collect()} for df in out]


def test_stages_against_brute_force(spark, sf_dir, stages):
    documents, clean, single, fair, redacted, encoded = stages
    scores = {r.doc_id: r.score for r in queries.op10_toxicity(spark, sf_dir).collect()}
    assert set(clean) == {d for d in documents if scores[d] < 0.7}

    groups = test_jaccard.brute([(d, r.text) for d, r in clean.items()], Rule(5, 80))
    assert set(single) == {d for d, _, first in groups if d == first} and len(single) < len(clean)

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    hits = test_decontaminate.brute([r.text for r in single.values()], items)
    assert set(fair) == {d for d, (_, n, _) in zip(single, hits, strict=True) if n == 0} and len(fair) < len(single)
    assert all(fair[d] == documents[d] for d in fair)

    assert set(redacted) == set(fair)
    for d, r in redacted.items():
        spans = [tuple(map(int, s.split(":")[1:])) for s in test_secrets.brute(fair[d].text)]
        if not re.search(r"gh[pousr]_|npm_|eyJ|[0-9][0-9 -]{11,}", fair[d].text):
            text, at = "", 0
            for start, end in spans:
                if start >= at:
                    text += fair[d].text[at:start] + "[SECRET]"
                at = max(at, end)
            assert r.text == text + fair[d].text[at:]
        assert r.n_chars == len(r.text) and (r.lang, r.source) == (fair[d].lang, fair[d].source)
    assert any(r.text != fair[d].text for d, r in redacted.items())

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert {d: r.ids for d, r in encoded.items()} == {d: library.encode(r.text, add_special_tokens=False).ids for d, r in redacted.items()}
    assert all(r.n_tokens == len(r.ids) for r in encoded.values())


def test_odd_rows_pass_all_stages(spark, sf_dir, documents):
    rows = documents([(1, None), (2, ""), (None, "a text without an id"), (3, "x " * 100_000), (3, "x " * 100_000), (4, "one two")])
    rows = rows.withColumn("contamination", F.lit(1)).withColumn("_secrets", F.lit("s")).withColumn("toxicity", F.lit(2))
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, sf_dir)
    assert sorted(str(r.doc_id) for r in rows.collect()) == ["1", "2", "3", "4", "None"]
    assert corpus_pipeline.drop_near_duplicates(spark, documents([]), sf_dir).count() == 0
