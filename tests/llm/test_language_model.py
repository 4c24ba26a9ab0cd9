import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from merklake.llm import language_model, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BEGIN, END = ("<begin>",), ("<end>",)


def tokens_of(text):
    return [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), END]


class Brute:
    """The model in dictionaries, straight from its definition."""

    def __init__(self, texts, order):
        self.order = order
        sequences = [[BEGIN] * (order - 1) + tokens_of(t) for t in texts]
        self.words = Counter(w for s in sequences for w in s[order - 1 :])
        self.counts = {order: Counter(tuple(s[i - order + 1 : i + 1]) for s in sequences for i in range(order - 1, len(s)))}
        for k in range(order - 1, 0, -1):
            lower = Counter()
            for gram, n in self.counts[k + 1].items():
                lower[gram[1:]] += n if gram[1] is BEGIN else 1
            self.counts[k] = lower
        self.discounts, self.contexts = {}, {}
        for k, counts in self.counts.items():
            n = [0, *(sum(c == r for c in counts.values()) for r in (1, 2, 3, 4))]
            found = None
            if all(n[1:]):
                y = n[1] / (n[1] + 2 * n[2])
                found = [0, *(r - (r + 1) * y * n[r + 1] / n[r] for r in (1, 2, 3))]
            self.discounts[k] = found if found and all(0 < found[r] <= r for r in (1, 2, 3)) else [0, 0.5, 1.0, 1.5]
            self.contexts[k] = defaultdict(list)
            for gram, c in counts.items():
                self.contexts[k][gram[:-1]].append(c)

    def p(self, gram):
        k = len(gram)
        if k == 0:
            return 1 / (len(self.words) + 1)
        after = self.contexts[k].get(gram[:-1])
        if not after:
            return self.p(gram[1:])
        d = self.discounts[k]
        c = self.counts[k].get(gram, 0)
        return max(c - d[min(c, 3)], 0) / sum(after) + sum(d[min(x, 3)] for x in after) / sum(after) * self.p(gram[1:])

    def score(self, text):
        own = [BEGIN] * (self.order - 1) + tokens_of(text)
        n, kinds = sum(self.words.values()), len(self.words)
        new = own[self.order - 1 :]
        return (
            len(new), sum(w in self.words for w in new), sum(math.log10((self.words[w] + 1) / (n + kinds + 1)) for w in new),
            sum(math.log10(self.p(tuple(own[i - self.order + 1 : i + 1]))) for i in range(self.order - 1, len(own))),
        )


def check(spark, train, texts, order, **options):
    table = spark.createDataFrame([(t,) for t in train], "text string").repartition(3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(2)
    model = language_model.fit(table, order, **options)
    brute = Brute(train, order)
    got = {r.doc_id: r.model for r in language_model.score(docs, model).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        n_tokens, n_known, base, score = brute.score(text)
        assert (got[i].n_tokens, got[i].n_known) == (n_tokens, n_known)
        assert got[i].base_score == pytest.approx(base, rel=1e-9)
        assert got[i].score == pytest.approx(score, rel=1e-6)
        assert got[i].perplexity == pytest.approx(10 ** (-score / n_tokens), rel=1e-6)
    return model


def some_texts(n, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["The", "the", "ünï", "ÇODE", "x,y", "z" * 2000]
    weights = [1 / (i + 1) for i in range(len(words))]
    return [rng.choice([" ", "\n", " \t"]).join(rng.choices(words, weights, k=rng.randint(0, 40))) for _ in range(n)]


ODD = [None, "", " \n", "never seen words", "the " * 3000, "\x00a\x1f b", "a b"]


@pytest.mark.parametrize("order, share", [(2, 1 << 21), (2, 200), (3, 500)])
def test_against_brute_force(spark, order, share):
    """With a small share, words are split over many buckets, and the begin mark's n-grams too."""
    train = some_texts(80) + ODD + ["the same text again"] * 50
    check(spark, train, some_texts(40, 2) + ODD, order, share=share)


def test_probabilities_add_up(spark):
    model = Brute(some_texts(80), 3)
    words = [*model.words, ("never seen",)]
    for context in ((BEGIN, BEGIN), ("w0", "w1"), ("the", "never"), ("w3", "z" * 2000)):
        assert sum(model.p((*context, w)) for w in words) == pytest.approx(1)


def test_one_word_and_nothing(spark):
    check(spark, ["a"], ["a", "b", "", None], 2)
    check(spark, [], ["a b", None], 2)
    table = spark.createDataFrame([("a b",)], "text string")
    assert language_model.score(spark.createDataFrame([], "text string"), language_model.fit(table)).count() == 0


def test_clashing_columns(spark, documents):
    docs = documents(["a b", "c"]).select("*", *[F.lit(n).alias(n) for n in ("row", "model", "score", "n_tokens")])
    out = language_model.score(docs, language_model.fit(docs))
    assert out.columns == [*[c for c in docs.columns if c != "model"], "model"]
    assert [(r.doc_id, r.row, r.score) for r in out.orderBy("doc_id").collect()] == [(0, "row", "score"), (1, "row", "score")]


def test_query_against_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    brute = Brute([t for i, t in docs if zlib.crc32(str(i).encode()) % 7 != 2], queries.LM_ORDER)
    got = {r.doc_id: r for r in queries.op13_lm_score(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    ahead = 0
    for i, text in docs:
        r, (n_tokens, n_known, base, score) = got[i], brute.score(text)
        held_out = zlib.crc32(str(i).encode()) % 7 == 2
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held_out, n_tokens, n_known, sum(brute.words.values()))
        assert (r.base_score, r.score) == (pytest.approx(base, rel=1e-9), pytest.approx(score, rel=1e-6))
        ahead += (score - base) if held_out else 0
    assert ahead > 0


def test_a_full_bucket_and_a_slice_stay_small(tmp_path):
    """What a worker holds at most for a bucket's lower order and for the words of a slice."""
    words, numbers = 50_000, np.random.default_rng(5)
    before = np.arange(words + 1, dtype="<i8") * 100
    (tmp_path / "words").mkdir()
    (tmp_path / "words" / "0").write_bytes(np.arange(words, dtype="<u8").tobytes() + before.tobytes())
    vocabulary = language_model.Vocabulary(str(tmp_path), np.array([0, words]), np.array([0, 100 * words]), 1000)
    layout = language_model.Layout(vocabulary, 2, language_model.SHARE)
    ids = numbers.integers(0, words, (2, language_model.SHARE))
    text = pa.array([" ".join(map(str, numbers.integers(0, words, 5000))) for _ in range(400)])
    peaks = []
    for work in (lambda: language_model._lower(layout, ids, np.ones(ids.shape[1], dtype=np.int64)), lambda: language_model._slices(text)):
        tracemalloc.start()
        for _ in work():
            pass
        peaks.append(tracemalloc.get_traced_memory()[1] >> 20)
        tracemalloc.stop()
    print(peaks)
    assert peaks[0] < 150 and peaks[1] < 150
