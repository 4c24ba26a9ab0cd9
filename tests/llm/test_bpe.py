import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from merklake.llm import queries
from merklake.llm.bpe import Encoder, compatible, decode, encode, merge_exactly
from merklake.llm.token_counts import Counter, count_tokens
from merklake.llm.vocabulary import load

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def hard_texts():
    rng = random.Random(3)
    points = [c for c in [*range(0x3000), *(rng.randrange(0x3000, 0x110000) for _ in range(2000))] if not 0xD800 <= c < 0xE000]
    out = [f"a{chr(c)} b{chr(c)}{chr(c)} 1{chr(c)}'s" for c in points]
    out += ["".join(rng.choice("aeiou thsnr ABX'sl12  \n\t\x1c\x85") for _ in range(rng.randrange(1, 60))) for _ in range(3000)]
    out += ["a<|endoftext|>b <|endoftext|><|endoftext|> c", "<|endoftext|>", "<|endoftext", "a" * 30_000, "ab" * 20_000, "", " ", "  ", "\n\n a"]
    return [*out, "".join(rng.choice("etaoinshrdlu") for _ in range(5_000)), "aaa aa aaaa " * 3]


def test_against_the_library(library):
    texts, vocab = hard_texts(), load(PATH)
    truth = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in Encoder(vocab).encode(texts)] == truth
    assert Counter(vocab).count(texts) == [len(x) for x in truth]


def test_pairs_and_exact_merging(library):
    vocab, rng = load(PATH), np.random.default_rng(5)
    a, b = rng.integers(0, 50_000, (2, 4_000))
    a[:2000], b[:2000] = a[:2000] % 700, b[:2000] % 700
    exact = [merge_exactly(vocab.tokens[x] + vocab.tokens[y], vocab) for x, y in zip(a, b, strict=True)]
    assert compatible(vocab, a, b).tolist() == [e == [x, y] for e, x, y in zip(exact, a.tolist(), b.tolist(), strict=True)]


def test_operators(spark, documents, library):
    texts = [None, "", "a", "Hello wörld " * 3, "Hello wörld " * 3, "x" * 200_000]
    docs = documents(texts).withColumn("n_tokens", F.lit("?")).withColumn("ids", F.lit(1))
    truth = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    counted = count_tokens(docs, PATH).orderBy("doc_id").collect()
    assert [r.n_tokens for r in counted] == [len(x) for x in truth]
    back = decode(encode(docs, PATH), PATH, out="back").orderBy("doc_id").collect()
    assert [r.ids for r in back] == truth
    assert [r.back for r in back] == [t or "" for t in texts]
    assert encode(documents([]), PATH).count() == 0
    odd = spark.createDataFrame([([64, None, 10**6, 220],), (None,), ([],), ([167],)], "ids array<int>")
    assert [r.text for r in decode(odd, PATH).collect()] == [library.decode([64, 220]), "", "", library.decode([167])]


def test_queries(spark, sf_dir, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op1_token_counts(spark, sf_dir).collect():
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 512)
    for r in queries.op3_bpe(spark, sf_dir).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        sums = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), texts[r.doc_id])]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), *sums)
