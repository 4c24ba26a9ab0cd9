"""Language-model scoring: an interpolated modified Kneser-Ney n-gram model, counted in Spark, kept as sorted hash arrays.

Words are known by 64-bit hashes. Their counts, summed by Spark, are written as arrays sorted by hash, in shards by hash range; a
word's number is its place there. Texts are then read again, with these arrays mapped into memory, as n-grams of word numbers,
each slice's added up and packed by bucket. A bucket is a range of `share` token places, where an n-gram lies at a hashed
place within those of its first word: so a word, however frequent, covers as many buckets as it fills, and none is larger
than its share. A bucket's task merges its n-grams, writes them as an array sorted by their hash, and hands what the next lower
order needs (contexts' totals, and how many different words an n-gram follows) to that order's buckets, down to single words.
Scoring maps the arrays and looks the distinct n-grams of each slice up in them, so neither the driver nor a task holds the model.

Every text is its words, in lower case, and one end; before it stand `order` - 1 begin marks that are never predicted. Counts of lower
orders are numbers of different words before, but for n-grams that begin with the mark, which keep their own counts. Discounts come from
the counts of counts of each order, and where these lack one of 1 to 4 or give no discount, from FALLBACK. A word never seen, like every other one, has
its part of the uniform share 1 / (V + 1). Equal hashes are taken for equal words and n-grams: with 10^9 of them, one pair in 40 such models.

Arrays lie in the session's folder of written tables, are renamed when whole, and are the same when a lost task is run again. Where that
folder is not mounted as files, a shard is read into the worker's memory instead. Null and empty texts are one end. Repeated rows
count each. Very long texts are handled whole, a slice of their own. Without any training text every token has probability 1.
Extra columns, whatever their names, are carried in a struct; only a column named like the result is replaced.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merklake.llm.words import SPACED, find_words, mixed, text_slices
from merklake.sources.scratch import materialize, new_location

SHARE = 1 << 20  # token places of a bucket, words of a shard
FALLBACK = (0.5, 1.0, 1.5)  # discounts where a corpus is too small to estimate them
_SLICE = 2 << 20  # bytes of texts handled at once
_END = np.uint64(0x5DEECE66D)  # stands for the hash of the end
_STEP = np.uint64(0x9E3779B97F4A7C15)

_TOP = [("key", "<u8"), ("count", "<f4")]
_LOWER = [("key", "<u8"), ("total", "<f8"), ("backoff", "<f8"), ("count", "<f4")]


@cache
def _filesystem(location: str) -> tuple[pafs.FileSystem, str]:
    if "://" in location or location.startswith("file:"):
        return pafs.FileSystem.from_uri(location)
    return pafs.LocalFileSystem(), location


def _write(location: str, name: str, arrays: list[np.ndarray]) -> None:
    """A shard: its arrays one after the other, seen by readers only when whole."""
    filesystem, root = _filesystem(location)
    filesystem.create_dir(f"{root}/{name.rsplit('/', 1)[0]}", recursive=True)
    from pyspark import TaskContext

    part = f"{root}/{name}.part-{TaskContext.get().taskAttemptId()}"
    with filesystem.open_output_stream(part) as out:
        for array in arrays:
            out.write(np.ascontiguousarray(array).data)
    filesystem.move(part, f"{root}/{name}")


@lru_cache(maxsize=8192)
def _mapped(location: str, name: str) -> np.ndarray:
    """The bytes of a shard, mapped where its folder is mounted."""
    filesystem, root = _filesystem(location)
    if isinstance(filesystem, pafs.LocalFileSystem):
        return np.memmap(f"{root}/{name}", dtype=np.uint8, mode="r")
    with filesystem.open_input_stream(f"{root}/{name}") as stream:
        return np.frombuffer(stream.read(), dtype=np.uint8)


def _arrays(location: str, name: str, fields: list[tuple[str, str]]) -> dict[str, np.ndarray]:
    """Arrays of equal length behind each other."""
    raw = _mapped(location, name)
    count, at, out = len(raw) // sum(np.dtype(kind).itemsize for _, kind in fields), 0, {}
    for field, kind in fields:
        size = count * np.dtype(kind).itemsize
        out[field] = raw[at : at + size].view(kind)
        at += size
    return out


def _slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row past the last, hashes of all tokens, place of each text's first token and one past the last)."""
    for row, stop, data, offsets in text_slices(texts, _SLICE):
        words = find_words(data, offsets, SPACED)
        first = words.first + np.arange(stop - row + 1)
        tokens = np.full(first[-1], _END, dtype=np.uint64)
        ends = np.zeros(len(tokens), dtype=bool)
        ends[first[1:] - 1] = True
        tokens[~ends] = words.hashes
        yield row, stop, tokens, first


def _merged(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Place of one of each distinct key, in order of the keys, and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(keys) else np.empty(0, dtype=np.int64)
    return order[first], *(np.add.reduceat(v[order], first) if len(keys) else v for v in values)


@dataclass(frozen=True)
class Vocabulary:
    """Shards of words by ranges of their hash: words and tokens before each shard, and in all."""

    location: str
    words_before: np.ndarray
    tokens_before: np.ndarray
    texts: int

    @property
    def kinds(self) -> int:
        return int(self.words_before[-1])

    @property
    def tokens(self) -> int:
        return int(self.tokens_before[-1])

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number, token place and count of each word; those never seen have the number `kinds` + 1 and count 0."""
        ids, place = np.full(len(hashes), self.kinds + 1, dtype=np.int64), np.zeros(len(hashes), dtype=np.int64)
        count = np.zeros(len(hashes), dtype=np.int64)
        shards = len(self.words_before) - 1
        order = np.argsort(hashes)
        edges = np.searchsorted(_shard_of(hashes[order], shards), np.arange(shards + 1))
        for s in range(shards):
            own, size = order[edges[s] : edges[s + 1]], int(self.words_before[s + 1] - self.words_before[s])
            if not len(own) or not size:
                continue
            raw = _mapped(self.location, f"words/{s}")
            keys, before = raw[: 8 * size].view("<u8"), raw[8 * size :].view("<i8")
            at = np.minimum(np.searchsorted(keys, hashes[own]), size - 1)
            hit = keys[at] == hashes[own]
            own, at = own[hit], at[hit]
            ids[own], place[own] = self.words_before[s] + at, self.tokens_before[s] + before[at]
            count[own] = before[at + 1] - before[at]
        return ids, place, count


def _shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def word_counts(texts: DataFrame) -> DataFrame:
    """hash bigint, n bigint: tokens of all texts of the column `text`."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, tokens, _ in _slices(batch.column(0)):
                kinds, n = np.unique(tokens, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(n)], ["hash", "n"])

    return texts.select("text").mapInArrow(count, "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n"))


def build_vocabulary(texts: DataFrame, location: str, share: int = SHARE) -> Vocabulary:
    counts = materialize(word_counts(texts), "word_counts")
    shards = max(1, -(-counts.count() // share))
    end = counts.where(F.col("hash") == int(_END)).first()

    def store(table: pa.Table) -> pa.Table:
        keys = table.column("hash").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        before = np.concatenate(([0], np.cumsum(table.column("n").to_numpy()[order])))
        shard = table.column("shard")[0].as_py()
        _write(location, f"words/{shard}", [keys[order], before.astype("<i8")])
        return pa.table({"shard": [shard], "words": [len(keys)], "tokens": [int(before[-1])]})

    # As _shard_of, for hashes as signed numbers.
    shard = F.shiftright(F.call_function("shiftrightunsigned", F.col("hash"), F.lit(32)) * shards, 32)
    sizes = counts.withColumn("shard", shard).groupBy("shard").applyInArrow(store, "shard bigint, words bigint, tokens bigint")
    words, tokens = np.zeros(shards + 1, dtype=np.int64), np.zeros(shards + 1, dtype=np.int64)
    for row in materialize(sizes, "word_shards").collect():  # a row per shard
        words[row.shard + 1], tokens[row.shard + 1] = row.words, row.tokens
    return Vocabulary(location, np.cumsum(words), np.cumsum(tokens), end.n if end else 0)


@dataclass(frozen=True)
class Layout:
    """Where n-grams of word numbers lie. The begin mark has the number `kinds`, and its token places follow those of the words."""

    vocabulary: Vocabulary
    order: int
    share: int

    @property
    def begin(self) -> int:
        return self.vocabulary.kinds

    @property
    def buckets(self) -> int:
        places = self.vocabulary.tokens + (self.order - 1) * self.vocabulary.texts
        return max(1, -(-places // self.share))

    def bucket(self, place: np.ndarray, count: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """Bucket of n-grams from their first word's places and the hash of the others."""
        spread = rest % np.maximum(count, 1).astype(np.uint64)
        return ((place + spread.astype(np.int64)) // self.share).astype(np.int64)

    def tokens(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number, place and count of each token; and of the begin mark, one past the last."""
        kinds, back = np.unique(hashes, return_inverse=True)
        marks = (self.begin, self.vocabulary.tokens, (self.order - 1) * self.vocabulary.texts)
        return tuple(np.append(found[back], mark) for found, mark in zip(self.vocabulary.look_up(kinds), marks, strict=True))

    def windows(self, first: np.ndarray) -> np.ndarray:
        """Row j: for every token the place of the token `order` - 1 - j before it; the begin mark's before the text."""
        n = int(first[-1])
        text_start = np.repeat(first[:-1], np.diff(first))
        at = np.arange(n)
        shifted = [np.where(at - back >= text_start, at - back, n) for back in range(self.order - 1, -1, -1)]
        return np.stack(shifted)


def gram_keys(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n-grams (a column each), and of their words but the first."""

    def fold(rows: np.ndarray) -> np.ndarray:
        out = np.zeros(ids.shape[1], dtype=np.uint64)
        for row in rows:
            out = mixed(out * _STEP + row.astype(np.uint64) + np.uint64(1))
        return out

    rest = fold(ids[1:])
    return mixed(rest * _STEP + ids[0].astype(np.uint64) + np.uint64(1)), rest


# Packed n-grams of a bucket. What `data` holds after the word numbers: counts of n-grams; numbers of words before them;
# or the totals of contexts, with the numbers of n-grams of count 1, 2, and 3 or more that begin with them.
_GRAMS, _BEFORE, _CONTEXT, _STATS = 0, 1, 2, 3
_PACKED = pa.schema([("bucket", pa.int64()), ("kind", pa.int64()), ("ids", pa.binary()), ("data", pa.binary())])
_PACKED_DDL = "bucket bigint, kind bigint, ids binary, data binary"


def _packed(kind: int, bucket: np.ndarray, ids: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row per bucket; ids and values have a column per n-gram."""
    order = np.lexsort((*ids[::-1], bucket))
    bucket, ids, values = bucket[order], ids[:, order].astype("<i8" if ids.size and ids.max() >> 31 else "<i4"), values[:, order]
    edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(bucket) else np.empty(0, dtype=np.int64)
    rows = [(int(bucket[a]), kind, ids[:, a:b].tobytes(), values[:, a:b].tobytes()) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PACKED, strict=True)], schema=_PACKED)


def _unpacked(table: pa.Table, kind: int, words: int, kinds: str, fields: int) -> tuple[np.ndarray, np.ndarray]:
    rows = table.filter(pa.array(table.column("kind").to_numpy() == kind))
    ids, values = [np.empty((words, 0), dtype=np.int64)], [np.empty((fields, 0), dtype=kinds)]
    for own, data in zip(rows.column("ids"), rows.column("data"), strict=True):
        data = np.frombuffer(data.as_buffer(), dtype=kinds).reshape(fields, -1)
        own = own.as_buffer()
        ids.append(np.frombuffer(own, dtype="<i8" if own.size == 8 * words * data.shape[1] else "<i4").reshape(words, -1))
        values.append(data)
    return np.concatenate(ids, axis=1), np.concatenate(values, axis=1)


def gram_counts(texts: DataFrame, layout: Layout) -> DataFrame:
    """The n-grams of the highest order, packed by bucket, added up within each slice of texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, hashes, first in _slices(batch.column(0)):
                ids, place, n = layout.tokens(hashes)
                window = layout.windows(first)
                key, rest = gram_keys(ids[window])
                one, times = _merged(key, np.ones(len(key), dtype=np.int64))
                head = window[0, one]
                yield from _packed(_GRAMS, layout.bucket(place[head], n[head], rest[one]), ids[window[:, one]], times[None])

    return texts.select("text").mapInArrow(count, _PACKED_DDL)


def _lower(layout: Layout, ids: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What the next lower order needs of some n-grams, each of which occurs here only."""

    def placed(kind: int, grams: np.ndarray, values: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, rest = gram_keys(grams)
        one, *sums = _merged(key, *values)
        heads = grams[0, one]
        yield from _packed(kind, layout.bucket(*_places(layout, heads), rest[one]), grams[:, one], np.stack(sums))

    by_count = [(count == 1), (count == 2), (count >= 3)]
    yield from placed(_CONTEXT, ids[:-1], [count.astype(np.float64), *(x.astype(np.float64) for x in by_count)])
    yield from placed(_BEFORE, ids[1:], [np.where(ids[1] == layout.begin, count, 1).astype(np.int64)])


def _places(layout: Layout, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token place and count of words by their numbers."""
    vocabulary = layout.vocabulary
    place = np.full(len(ids), vocabulary.tokens, dtype=np.int64)
    count = np.full(len(ids), (layout.order - 1) * vocabulary.texts, dtype=np.int64)
    order = np.argsort(ids)
    edges = np.searchsorted(ids[order], vocabulary.words_before)
    for s in range(len(edges) - 1):
        own = order[edges[s] : edges[s + 1]]
        if len(own):
            size = int(vocabulary.words_before[s + 1] - vocabulary.words_before[s])
            before = _mapped(vocabulary.location, f"words/{s}")[8 * size :].view("<i8")
            at = ids[own] - vocabulary.words_before[s]
            place[own], count[own] = vocabulary.tokens_before[s] + before[at], before[at + 1] - before[at]
    return place, count


def _discounts(stats: np.ndarray) -> tuple[float, float, float]:
    """Of counts 1, 2, and 3 or more, from the numbers of n-grams that occur 1, 2, 3, 4 times."""
    if (stats[:4] <= 0).any():
        return FALLBACK
    y = stats[0] / (stats[0] + 2 * stats[1])
    found = tuple(float(r - (r + 1) * y * stats[r] / stats[r - 1]) for r in (1, 2, 3))
    return found if all(0 < d <= r for r, d in enumerate(found, 1)) else FALLBACK


@dataclass(frozen=True)
class Model:
    """Discounts of each order, from 1; buckets that hold any n-gram, as bits; of the lowest order the total of the counts, and
    the part of it that its discounts leave to the uniform share."""

    layout: Layout
    discounts: list[tuple[float, float, float]]
    filled: list[np.ndarray]
    total: float
    left: float

    def _discounted(self, level: int, count: np.ndarray) -> np.ndarray:
        d = np.array([0.0, *self.discounts[level - 1]])
        return count - d[np.minimum(count, 3).astype(np.int64)]

    def _find(self, level: int, keys: np.ndarray, buckets: np.ndarray) -> dict[str, np.ndarray]:
        """Stored fields of n-grams; zero where there is none. A bucket of -1 is none."""
        fields = _TOP if level == self.layout.order else _LOWER
        out = {name: np.zeros(len(keys)) for name, _ in fields[1:]}
        order = np.lexsort((keys, buckets))
        edges = np.flatnonzero(np.concatenate(([True], buckets[order][1:] != buckets[order][:-1], [True]))) if len(keys) else np.empty(0, np.int64)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            own = order[a:b]
            bucket = int(buckets[own[0]])
            if bucket < 0 or not (self.filled[level - 1][bucket >> 3] >> (bucket & 7)) & 1:
                continue
            stored = _arrays(self.layout.vocabulary.location, f"grams-{level}/{bucket}", fields)
            at = np.minimum(np.searchsorted(stored["key"], keys[own]), len(stored["key"]) - 1)
            hit = stored["key"][at] == keys[own]
            for name, values in out.items():
                values[own[hit]] = stored[name][at[hit]]
        return out

    def _look_up(self, level: int, window: np.ndarray, tokens: tuple[np.ndarray, np.ndarray, np.ndarray]) -> dict[str, np.ndarray]:
        """Fields of the n-gram at every token, each distinct one looked up once."""
        ids, place, count = tokens
        own = ids[window]
        key, rest = gram_keys(own)
        kinds, one, back = np.unique(key, return_index=True, return_inverse=True)
        head = window[0, one]
        known = (own[:, one] <= self.layout.begin).all(axis=0)
        buckets = np.where(known, self.layout.bucket(place[head], count[head], rest[one]), -1)
        return {name: values[back] for name, values in self._find(level, kinds, buckets).items()}

    def log10(self, tokens: tuple[np.ndarray, np.ndarray, np.ndarray], first: np.ndarray) -> np.ndarray:
        """log10 probability of every token."""
        layout = self.layout
        window, uniform = layout.windows(first), 1.0 / (layout.vocabulary.kinds + 1)
        if not self.total:
            return np.full(int(first[-1]), np.log10(uniform))
        found = self._look_up(1, window[-1:], tokens)
        p = np.maximum(self._discounted(1, found["count"]), 0) / self.total + self.left * uniform
        context = self._look_up(1, window[-2:-1], tokens)
        for level in range(2, layout.order + 1):
            count = self._look_up(level, window[-level:], tokens)["count"]
            seen = context["total"] > 0
            total = np.where(seen, context["total"], 1)
            p = np.where(seen, np.maximum(self._discounted(level, count), 0) / total + context["backoff"] * p, p)
            if level < layout.order:
                context = self._look_up(level, window[-level - 1 : -1], tokens)
        return np.log10(p)


def fit(texts: DataFrame, order: int = 2, share: int = SHARE) -> Model:
    """Model of all texts of the column `text`."""
    location = new_location(texts.sparkSession, "language_model")
    layout = Layout(build_vocabulary(texts, location, share), order, share)
    rows, discounts, filled = gram_counts(texts, layout), {}, {}
    for level in range(order, 0, -1):
        rows = materialize(_merge_level(rows, layout, level, discounts.get(level + 1)), f"grams_{level}")
        stats, filled[level] = np.zeros(6), np.zeros((layout.buckets >> 3) + 1, dtype=np.uint8)
        for row in rows.where(F.col("kind") == _STATS).select("bucket", "data").collect():  # six numbers a bucket
            stats += np.frombuffer(row.data, dtype="<f8")
            filled[level][row.bucket >> 3] |= 1 << (row.bucket & 7)
        discounts[level] = _discounts(stats)
        rows = rows.where(F.col("kind") != _STATS)
    n1, n2, _, _, kinds, total = stats
    left = float(np.dot(discounts[1], (n1, n2, kinds - n1 - n2)) / total) if total else 1.0
    levels = range(1, order + 1)
    return Model(layout, [discounts[k] for k in levels], [filled[k] for k in levels], float(total), left)


def _merge_level(rows: DataFrame, layout: Layout, level: int, above: tuple[float, float, float] | None) -> DataFrame:
    """Store the n-grams of one order, bucket by bucket; rows for the next lower order, and each bucket's counts of counts."""
    top = level == layout.order
    location = layout.vocabulary.location

    def merge(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        out: list[pa.RecordBatch] = []
        if top:
            ids, values = _unpacked(table, _GRAMS, level, "<i8", 1)
            key, _ = gram_keys(ids)
            one, count = _merged(key, values[0])
            ids, key = ids[:, one], key[one]
            _write(location, f"grams-{level}/{bucket}", [key, count.astype("<f4")])
        else:
            before_ids, before = _unpacked(table, _BEFORE, level, "<i8", 1)
            context_ids, context = _unpacked(table, _CONTEXT, level, "<f8", 4)
            ids = np.concatenate((before_ids, context_ids), axis=1)
            key, _ = gram_keys(ids)
            nothing = np.zeros(context_ids.shape[1], dtype=np.int64)
            sums = np.concatenate((np.zeros((4, before_ids.shape[1])), context), axis=1)
            one, count, *sums = _merged(key, np.concatenate((before[0], nothing)), *sums)
            ids, key = ids[:, one], key[one]
            total = sums[0]
            backoff = sum(d * n for d, n in zip(above, sums[1:], strict=True)) / np.where(total > 0, total, 1)
            _write(location, f"grams-{level}/{bucket}", [key, total.astype("<f8"), backoff.astype("<f8"), count.astype("<f4")])
            ids, count = ids[:, count > 0], count[count > 0]
        if level > 1 and len(count):
            out += _lower(layout, ids, count)
        numbers = np.array([*((count == r).sum() for r in (1, 2, 3, 4)), len(count), count.sum()], dtype="<f8")
        out.append(pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((bucket, _STATS, b"", numbers.tobytes()), _PACKED, strict=True)], schema=_PACKED))
        return pa.Table.from_batches(out, schema=_PACKED)

    return rows.groupBy("bucket").applyInArrow(merge, _PACKED_DDL)


_SCORES = ("n_tokens", "n_known", "base_score", "score")


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, out: str = "model") -> DataFrame:
    """The columns `keep` (all by default) and `out`: n_tokens, n_known (seen in training), base_score (log10 by counts of
    single words, one added to each), score (the model's log10 probability of the text), perplexity."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != out]
    rows = docs.select(F.struct(*keep).alias("row"), "text")
    kind = rows.schema["row"].dataType.simpleString()
    layout = model.layout
    below = np.log10(float(layout.vocabulary.tokens + layout.vocabulary.kinds + 1))

    def summed(values: np.ndarray, first: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, first[:-1])  # every text has its end

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list[np.ndarray]] = [[np.empty(0, dtype=np.int64)] * 2 + [np.empty(0)] * 2]
            for _, _, hashes, first in _slices(batch.column("text")):
                tokens = layout.tokens(hashes)
                count = tokens[2][:-1]
                found.append([np.diff(first), summed((count > 0).astype(np.int64), first), summed(np.log10(count + 1.0) - below, first), summed(model.log10(tokens, first), first)])
            columns = [pa.array(np.concatenate(c)) for c in zip(*found, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *columns], ["row", *_SCORES])

    scored = rows.mapInArrow(read, f"row {kind}, n_tokens bigint, n_known bigint, base_score double, score double")
    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity")
    return scored.select("row.*", F.struct(*_SCORES, perplexity).alias(out))
