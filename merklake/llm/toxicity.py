"""Toxicity of documents from their nearest labelled examples, by TF-IDF cosine of the terms that mark toxic ones.

This is not the cosine of whole texts, which finds fewer (README).

Terms are words and word beginnings that mark toxic documents in a sample of labelled rows (at most `sample_rows`, those of
smallest id hash); the sample also gives the examples. All other words of a text share one further dimension, weighted by
the root of their number, so that a term counts for less in a longer text. Document frequencies are counted over all
documents. Examples lie in blocks of an inverted index that keeps, for each term and block, the largest weight: a query takes blocks in the order of
their bounds and stops when no bound beats its k-th neighbour, so neighbours are exact. Votes are weighted by similarity,
and leave-one-out votes of the examples calibrate them (a logistic curve). The neighbours found are the evidence.

Broadcast are at most `sample_rows` labels, `max_terms` terms and the examples' weights of these; documents are not shuffled.
Null and empty texts, and texts without any term, have no neighbours; their score is the share of toxic examples among
such. Null labels and labels of null ids are left out, an id labelled both ways is toxic, repeated rows are scored each.
Without toxic examples every score is a base rate. An input column named like the result is replaced.
"""

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merklake.llm.words import ALPHANUMERIC, Words, find_words, text_slices, unused
from merklake.sources.scratch import materialize

SAMPLE_ROWS = 20_000
MAX_TERMS = 4_000
MIN_RATIO, MIN_Z = 8.0, 2.5
NEIGHBOURS, BLOCK = 15, 64
THRESHOLD = 0.7
BEGINNINGS = (3, 4, 5, 6)
_KNOWN_WORDS = 500_000  # words whose terms a task keeps at hand

_FOUND = pa.struct([("score", pa.float64()), ("neighbours", pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.int32())])))])
_FOUND_DDL = "struct<score:double,neighbours:array<struct<doc_id:bigint,similarity:double,toxic:int>>>"


def is_held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1


def terms_of(word: bytes) -> set[str]:
    """The word, marked by a blank at its end, and its beginnings."""
    text = word.decode("utf-8", "replace")
    return {text + " ", *(text[:n] for n in BEGINNINGS if len(text) > n)}


class TermCounter:
    """Counts of known terms in texts. What a word stands for is looked up once and kept by the word's hash."""

    def __init__(self, terms: dict[str, int]):
        self.terms, self.known = terms, {}

    def count(self, words: Words) -> list[Counter]:
        """Of each text, how often each known term occurs in it."""
        out = [Counter() for _ in range(len(words.first) - 1)]
        distinct, at, back = np.unique(words.hashes, return_index=True, return_inverse=True)
        if len(self.known) + len(distinct) > _KNOWN_WORDS:
            self.known = {}
        found = []
        for value, i in zip(distinct.tolist(), at.tolist(), strict=True):
            ids = self.known.get(value)
            if ids is None:
                word = words.lowered[words.start[i] : words.end[i]].tobytes()
                ids = self.known[value] = tuple(sorted(self.terms[t] for t in terms_of(word) if t in self.terms))
            found.append(ids)
        marked = np.array([bool(ids) for ids in found], dtype=bool)
        hits = np.flatnonzero(marked[back]) if len(found) else np.empty(0, dtype=np.int64)
        texts = np.searchsorted(words.first, hits, side="right") - 1
        for t, w in zip(texts.tolist(), back[hits].tolist(), strict=True):
            out[t].update(found[w])
        return out


def _counted(texts: pa.Array, counter: TermCounter) -> Iterator[tuple[Counter, int]]:
    """Term counts and number of words of each text."""
    for _, _, data, offsets in text_slices(texts):
        words = find_words(data, offsets, ALPHANUMERIC)
        yield from zip(counter.count(words), np.diff(words.first).tolist(), strict=True)


@dataclass
class Index:
    """Examples in blocks: each block's terms and weights (example, term), and its largest weight of every term."""

    ids: np.ndarray
    toxic: np.ndarray
    blocks: list[tuple[np.ndarray, np.ndarray]]
    most: np.ndarray  # block, term

    @classmethod
    def build(cls, rows: list[tuple[int, int, dict[int, float]]], n_terms: int) -> "Index":
        # Alike examples next to one another keep the bounds of blocks apart.
        rows = sorted(rows, key=lambda r: (r[1], max(r[2], key=lambda t: (r[2][t], t)), r[0]))
        blocks, most = [], np.zeros((-(-len(rows) // BLOCK), n_terms))
        for b in range(len(most)):
            own = [r[2] for r in rows[b * BLOCK : (b + 1) * BLOCK]]
            terms = np.array(sorted(set().union(*own)), dtype=np.int64)
            place, weights = {t: i for i, t in enumerate(terms.tolist())}, np.zeros((len(own), len(terms)))
            for e, vector in enumerate(own):
                weights[e, [place[t] for t in vector]] = list(vector.values())
            blocks.append((terms, weights))
            most[b, terms] = weights.max(axis=0)
        return cls(np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.int64), blocks, most)

    def nearest(self, query: dict[int, float], k: int, without: int | None = None) -> list[tuple[float, int, int]]:
        """(similarity, doc_id, toxic) of the k nearest examples that share a term, nearest first, ties by smaller id."""
        wanted = np.array(sorted(query), dtype=np.int64)
        weights = np.array([query[t] for t in wanted.tolist()])
        bounds, best = self.most[:, wanted] @ weights, []
        for b in np.argsort(-bounds, kind="stable").tolist():
            least = best[-1][0] - 1e-9 if len(best) == k else 0.0
            if bounds[b] <= least:
                break
            terms, own = self.blocks[b]
            at = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
            there = terms[at] == wanted
            scores = (own[:, at[there]] @ weights[there]).round(12)  # equal vectors tie whatever their block
            near = np.flatnonzero(scores > least)
            found = zip(scores[near].tolist(), self.ids[near + b * BLOCK].tolist(), self.toxic[near + b * BLOCK].tolist(), strict=True)
            best = sorted([*best, *(f for f in found if f[1] != without)], key=lambda x: (-x[0], x[1]))[:k]
        return best


@dataclass
class Model:
    terms: dict[str, int]
    idf: np.ndarray
    index: Index
    base: float  # share of toxic examples
    bare: float  # share of toxic ones among examples without terms
    curve: tuple[float, float] = (0.0, 1.0)
    counter: TermCounter = field(init=False, repr=False)

    def __post_init__(self):
        self.counter = TermCounter(self.terms)

    def vector(self, counts: Counter, n_words: int) -> dict[int, float]:
        raw = {t: (1 + float(np.log(n))) * float(self.idf[t]) for t, n in counts.items()}
        raw[len(self.terms)] = float(n_words) ** 0.5
        size = sum(w * w for w in raw.values()) ** 0.5
        return {t: w / size for t, w in raw.items()}

    def vote(self, found: list[tuple[float, int, int]]) -> float:
        weight = sum(s for s, _, _ in found)
        return (sum(s * y for s, _, y in found) + 0.5 * self.base) / (weight + 0.5)

    def score(self, found: list[tuple[float, int, int]]) -> float:
        if not found:
            return self.bare
        shift, slope = self.curve
        return float(1 / (1 + np.exp(-(shift + slope * _logit(self.vote(found))))))


def _logit(p):
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _calibrated(votes: np.ndarray, truth: np.ndarray) -> tuple[float, float]:
    """Shift and slope of the logistic curve from votes to chances; a ridge keeps it finite where the two are apart."""
    if not len(votes):
        return 0.0, 1.0
    x, beta, prior = np.column_stack((np.ones(len(votes)), _logit(votes))), np.array([0.0, 1.0]), np.array([0.0, 1.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ beta))
        gradient = x.T @ (truth - p) - (beta - prior)
        beta = beta + np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.eye(2), gradient).clip(-2, 2)
    return float(beta[0]), float(max(beta[1], 0.0))


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """doc_id, text, toxic of at most `rows` labelled documents that may be learnt from."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return materialize(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id"), "examples")


def _count_terms(sample: DataFrame, among: list[str] | None) -> DataFrame:
    """term, n: number of texts with each term (of those given), summed in the task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, totals = None if among is None else set(among), Counter()
        for batch in batches:
            for row, stop, data, offsets in text_slices(batch.column("text")):
                words = find_words(data, offsets, ALPHANUMERIC)
                for t in range(stop - row):
                    own = set().union(*map(terms_of, set(words.of(t))))
                    totals.update(own if wanted is None else own & wanted)
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.array(list(totals.values()), pa.int64())], ["term", "n"])

    return sample.select("text").mapInArrow(run, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def _choose_terms(sample: DataFrame, most: int) -> list[str]:
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy((F.col("toxic") > 0).alias("toxic")).count().collect()}
    n_toxic, n_clean = sizes.get(True, 0), sizes.get(False, 0)
    seen = _count_terms(sample.where("toxic > 0"), None).where("n >= 2").orderBy(F.desc("n"), "term").limit(25 * most).collect()
    toxic = {r["term"]: r["n"] for r in seen}
    clean = {r["term"]: r["n"] for r in _count_terms(sample.where("toxic <= 0"), list(toxic)).collect()}
    chosen = []
    for term, t in toxic.items():
        c = clean.get(term, 0)
        ratio = (t + 0.5) / (n_toxic + 1) * (n_clean + 1) / (c + 0.5)
        odds = np.log((t + 0.5) / (n_toxic - t + 0.5) * (n_clean - c + 0.5) / (c + 0.5))
        z = odds / np.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))
        if ratio >= MIN_RATIO and z >= MIN_Z:
            chosen.append((-t * np.log(ratio), term))
    return sorted(term for _, term in sorted(chosen)[:most])


def _frequencies(docs: DataFrame, terms: dict[str, int]) -> tuple[np.ndarray, int]:
    """In how many documents each term occurs, and the number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, totals, n = TermCounter(terms), np.zeros(len(terms) + 1, dtype=np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for _, _, data, offsets in text_slices(batch.column("text")):
                for own in counter.count(find_words(data, offsets, ALPHANUMERIC)):
                    totals[list(own)] += 1
        totals[-1] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(totals))), pa.array(totals)], ["term", "n"])

    counted = docs.select("text").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    totals = np.zeros(len(terms) + 1, dtype=np.int64)
    for r in counted:
        totals[r["term"]] = r["n"]
    return totals[:-1], int(totals[-1])


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, max_terms: int = MAX_TERMS) -> Model:
    sample = _sample(docs, labels, sample_rows)
    terms = {t: i for i, t in enumerate(_choose_terms(sample, max_terms))}
    df, n = _frequencies(docs, terms)
    idf = np.log((n + 1) / (df + 1)) + 1
    empty = Model(terms, idf, Index.build([], len(terms) + 1), 0.0, 0.0)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [empty.vector(c, n) if c else {} for c, n in _counted(batch.column("text"), empty.counter)]
            lists = [pa.array([list(v) for v in own], pa.list_(pa.int32())), pa.array([list(v.values()) for v in own], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), *lists], ["doc_id", "toxic", "terms", "weights"])

    rows = sample.mapInArrow(vectors, "doc_id bigint, toxic int, terms array<int>, weights array<double>").collect()
    examples = [(r["doc_id"], int(r["toxic"] > 0), dict(zip(r["terms"], r["weights"], strict=True))) for r in rows]
    bare = [y for _, y, v in examples if not v]
    model = Model(
        terms, idf, Index.build([e for e in examples if e[2]], len(terms) + 1),
        base=(sum(y for _, y, _ in examples) + 0.1) / (len(examples) + 1), bare=(sum(bare) + 0.1) / (len(bare) + 1),
    )
    votes = [(model.vote(found), y) for i, y, v in examples if v and (found := model.index.nearest(v, NEIGHBOURS, without=i))]
    model.curve = _calibrated(np.array([v for v, _ in votes]), np.array([y for _, y in votes]))
    return model


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, out: str = "toxicity") -> DataFrame:
    """The columns `keep` of `docs` (all by default) and `out`: score, and the neighbours it rests on."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in (docs.columns if keep is None else keep) if c != out]
    text = unused("_text", [*keep, out])
    rows = docs.select(*keep, F.col("text").alias(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = []
            for counts, n in _counted(batch.column(text), own.counter):
                near = own.index.nearest(own.vector(counts, n), NEIGHBOURS) if counts else []
                found.append({"score": own.score(near), "neighbours": [{"doc_id": i, "similarity": s, "toxic": y} for s, i, y in near]})
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(found, _FOUND)], [*keep, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop(text).schema)
    return rows.mapInArrow(run, f"{schema}, `{out}` {_FOUND_DDL}")


def reject(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents scored under the threshold, unchanged."""
    out = unused("_toxicity", docs.columns)
    return score(docs, fit(docs, labels), out=out).where(F.col(out)["score"] < threshold).select(*docs.columns)
