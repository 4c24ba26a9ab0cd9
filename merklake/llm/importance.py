"""Target-distribution importance resampling: documents drawn by how much more likely their features are in a target text set.

Features are all runs of one to three consecutive words, in hashed buckets (CRC-32 of the words joined by blanks). Each
task counts whole texts into one array of buckets, so the shuffle carries one row per task and bucket; the bucket's gain, a
scaled log ratio of target to corpus, goes back as an array of `buckets` numbers, whatever the size of the corpus. A second
pass adds up the gains of each text. A document's key is its weight with Gumbel noise drawn from its id, so the best keys are
a sample without replacement by weight.

The exact cutoff is found by weighted medians of medians: each partition gives the median of its keys that are still open and
their number, and the median of these, weighted by the numbers, leaves at most three quarters of the keys open, however
rows lie. Only a median per partition comes to the driver, and at last at most FINISH keys. Keys are told apart by score,
then doc_id, then a row number, so ties and repeated rows are cut exactly, and only the winners are sorted, over all tasks.

Null and empty texts have no features and weigh 0. A null doc_id has its noise from an empty id and comes last among equal
scores. Repeated rows each count as they are. Very long texts are handled whole, a slice of their own. An empty table, or one with too few
documents of `least_words`, draws nothing; an empty target gives the gains of its prior. Extra columns, whatever their
names, travel in one struct; only a column named like the result is replaced.
"""

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merklake.llm.words import ALPHANUMERIC, Words, find_words, text_slices
from merklake.sources.scratch import materialize

LONGEST = 3  # words in a feature
FINISH = 10_000  # open keys that are sorted at once instead of by further medians
_SHIFTS = 64
_POLYNOMIAL = 0xEDB88320  # of CRC-32, fixed value
_NO_ID = (1 << 63) - 1


@dataclass(frozen=True)
class Settings:
    """`percent` of the documents with `least_words` words at least are drawn; gains and noise are in 1/`scale`."""

    buckets: int = 10_000
    least_words: int = 20
    percent: int = 5
    scale: int = 1000
    seed: int = 42


@cache
def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(_POLYNOMIAL), table >> 1)
    return table


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, given by its values on each of the four bytes."""
    return table[0][crc & 255] ^ table[1][(crc >> 8) & 255] ^ table[2][(crc >> 16) & 255] ^ table[3][crc >> 24]


@cache
def _shift_tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """How a checksum changes as n bytes are appended: for n below _SHIFTS, and for powers of two."""
    bytes_ = np.arange(256, dtype=np.uint32)
    table, small = np.stack([bytes_ << np.uint32(8 * k) for k in range(4)]), []
    for _ in range(_SHIFTS + 1):
        small.append(table)
        table = (table >> 8) ^ _byte_table()[table & 255]
    powers = [small[1]]
    for _ in range(40):
        powers.append(_apply(powers[-1], powers[-1]))
    return np.stack(small[:_SHIFTS]), powers


def _appended(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The part that a checksum has in that of a text with so many bytes more."""
    small, powers = _shift_tables()
    near = np.minimum(lengths, _SHIFTS - 1)
    out = small[near, 0, crc & 255] ^ small[near, 1, (crc >> 8) & 255] ^ small[near, 2, (crc >> 16) & 255] ^ small[near, 3, crc >> 24]
    far = np.flatnonzero(lengths >= _SHIFTS)
    if len(far):
        own, rest = crc[far], lengths[far]
        for k, table in enumerate(powers):
            own = np.where((rest >> k) & 1, _apply(table, own), own)
        out[far] = own
    return out


def _word_crcs(words: Words) -> np.ndarray:
    """CRC-32 of each word, one byte of all words at a time; the few long ones are left to the library."""
    lengths = words.end - words.start
    order = np.argsort(-np.minimum(lengths, _SHIFTS), kind="stable")
    start, sizes = words.start[order], lengths[order]
    state = np.full(len(order), 0xFFFFFFFF, dtype=np.uint32)
    n_long = int(np.searchsorted(-sizes, -_SHIFTS, side="right"))
    table = _byte_table()
    for k in range(int(sizes[n_long]) if n_long < len(sizes) else 0):
        open_ = slice(n_long, int(np.searchsorted(-sizes, -k, side="left")))
        state[open_] = table[(state[open_] ^ words.lowered[start[open_] + k]) & 255] ^ (state[open_] >> 8)
    out = np.empty_like(state)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    for i in order[:n_long].tolist():
        out[i] = zlib.crc32(words.lowered[words.start[i] : words.end[i]].data)
    return out


def feature_buckets(words: Words, buckets: int) -> list[np.ndarray]:
    """For runs of 1, 2, 3 words: the bucket of the run that begins at each word, -1 where the text ends before it."""
    lengths = words.end - words.start
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    own = _word_crcs(words)
    spaced = _appended(np.full(len(own), zlib.crc32(b" "), dtype=np.uint32), lengths) ^ own  # of a blank and the word
    out, crc = [(own % np.uint32(buckets)).astype(np.int64)], own
    for n in range(1, LONGEST):
        count = max(0, len(own) - n)
        crc = _appended(crc[:count], lengths[n:] + 1) ^ spaced[n:]
        bucket = np.full(len(own), -1, dtype=np.int64)
        bucket[:count] = np.where(text[:count] == text[n:], (crc % np.uint32(buckets)).astype(np.int64), -1)
        out.append(bucket)
    return out


def feature_counts(texts: DataFrame, buckets: int) -> DataFrame:
    """bucket bigint, n bigint: occurrences of features in all texts of the column `text`."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(0)):
                for bucket in feature_buckets(find_words(data, offsets, ALPHANUMERIC), buckets):
                    total += np.bincount(bucket[bucket >= 0], minlength=buckets)
        filled = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(filled), pa.array(total[filled])], ["bucket", "n"])

    return texts.select("text").mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def _as_array(counts: DataFrame, buckets: int) -> np.ndarray:
    """At most one row a bucket comes to the driver."""
    out = np.zeros(buckets, dtype=np.int64)
    for row in counts.collect():
        out[row.bucket] = row.n
    return out


def bucket_gains(corpus: DataFrame, target: DataFrame, settings: Settings) -> np.ndarray:
    """Per bucket floor(scale * ln of the target's smoothed share over the corpus's)."""
    s, t = (_as_array(feature_counts(texts, settings.buckets), settings.buckets) for texts in (corpus, target))
    total_s, total_t = int(s.sum()) + settings.buckets, int(t.sum()) + settings.buckets
    ratios = (float((a + 1) * total_s) / float((b + 1) * total_t) for a, b in zip(t.tolist(), s.tolist(), strict=True))
    return np.array([math.floor(settings.scale * math.log(r)) for r in ratios], dtype=np.int64)


def _summed(gains: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_features, weight = [], [], []
            for _, _, data, offsets in text_slices(batch.column("text")):
                words = find_words(data, offsets, ALPHANUMERIC)
                size = np.diff(words.first)
                each = np.zeros(len(words.hashes) + 1, dtype=np.int64)
                for bucket in feature_buckets(words, len(gains)):
                    each[1:] += np.where(bucket >= 0, gains[bucket], 0)
                sums = np.cumsum(each)
                n_words.append(size)
                n_features.append(sum(np.maximum(size - n, 0) for n in range(LONGEST)))
                weight.append(sums[words.first[1:]] - sums[words.first[:-1]])
            columns = [pa.array(np.concatenate(c) if c else np.empty(0, np.int64), pa.int64()) for c in (n_words, n_features, weight)]
            rest = [batch.column("row"), batch.column("id")]
            yield pa.RecordBatch.from_arrays([*rest, *columns], ["row", "id", "n_words", "n_features", "weight"])

    return weigh


def _noise(settings: Settings) -> Column:
    key = F.concat(F.lit(f"{settings.seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(F.lit(-float(settings.scale)) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("bigint")


def weigh(docs: DataFrame, target: DataFrame, settings: Settings = Settings(), keep: list[str] | None = None) -> DataFrame:
    """row (the columns `keep`, all by default), n_words, n_features, weight, score, tie, serial: the last two order equal scores."""
    gains = bucket_gains(docs, target, settings)
    row = F.struct(*(docs.columns if keep is None else keep))
    rows = docs.select(row.alias("row"), F.col("doc_id").cast("bigint").alias("id"), "text")
    kind = rows.schema["row"].dataType.simpleString()
    found = rows.mapInArrow(_summed(gains), f"row {kind}, id bigint, n_words bigint, n_features bigint, weight bigint")
    return found.select(
        "row", "n_words", "n_features", "weight", (F.col("weight") + _noise(settings)).alias("score"),
        F.coalesce("id", F.lit(_NO_ID)).alias("tie"), F.monotonically_increasing_id().alias("serial"),
    )


Key = tuple[int, int, int]  # minus score, tie, serial: the smaller, the better
_KEY = "score bigint, tie bigint, serial bigint"


def _key_column() -> Column:
    return F.struct((-F.col("score")).alias("s"), F.col("tie").alias("t"), F.col("serial").alias("r"))


def _literal(key: Key) -> Column:
    return F.struct(*[F.lit(k).cast("bigint").alias(name) for k, name in zip(key, "str", strict=True)])


def _before(keys: np.ndarray, key: Key) -> np.ndarray:
    a, b, c = keys
    return (a < key[0]) | ((a == key[0]) & ((b < key[1]) | ((b == key[1]) & (c < key[2]))))


def _medians(pivot: Key | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of a partition's keys on either side of the pivot: their number and their median."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.stack([-b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()]) for b in batches]
        keys = np.concatenate(parts, axis=1) if parts else np.empty((3, 0), dtype=np.int64)
        better = np.zeros(keys.shape[1], dtype=bool) if pivot is None else _before(keys, pivot)
        same = np.zeros_like(better) if pivot is None else (keys == np.array(pivot)[:, None]).all(axis=0)
        out = []
        for side, own in ((0, keys[:, better]), (1, keys[:, ~better & ~same])):
            if own.shape[1]:
                middle = np.lexsort(own[::-1])[(own.shape[1] - 1) // 2]
                out.append((side, own.shape[1], *own[:, middle].tolist()))
        columns = zip(*out, strict=True) if out else ([], [], [], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["side", "n", "s", "t", "r"])

    return summarise


def _weighted_median(medians: list[tuple[Key, int]]) -> Key:
    half, seen = sum(n for _, n in medians) / 2, 0
    for key, n in sorted(medians):
        seen += n
        if seen >= half:
            return key
    raise ValueError("no keys")


def key_at(keys: DataFrame, place: int, finish: int = FINISH) -> Key:
    """The key (score, tie, serial) that is number `place` (from 1) from the best; each must occur once."""
    best, worst, pivot, left = None, None, None, place
    while True:
        open_ = keys.select("score", "tie", "serial")
        if worst is not None:
            open_ = open_.where((F.col("score") >= -worst[0]) & (_key_column() < _literal(worst)))
        if best is not None:
            open_ = open_.where((F.col("score") <= -best[0]) & (_key_column() > _literal(best)))
        found = open_.mapInArrow(_medians(pivot), "side bigint, n bigint, s bigint, t bigint, r bigint").collect()
        better = sum(r.n for r in found if r.side == 0)
        if pivot is not None and left == better + 1:
            return pivot
        side = 0 if left <= better else 1
        if pivot is not None:
            best, worst = (best, pivot) if side == 0 else (pivot, worst)
            left -= 0 if side == 0 else better + 1
        medians = [((r.s, r.t, r.r), r.n) for r in found if r.side == side]
        if sum(n for _, n in medians) <= finish:
            last = open_.where(F.lit(True) if pivot is None else (_key_column() < _literal(pivot) if side == 0 else _key_column() > _literal(pivot)))
            return sorted((-r.score, r.tie, r.serial) for r in last.collect())[left - 1]
        pivot = _weighted_median(medians)


def _ranked(winners: DataFrame) -> DataFrame:
    """Rows sorted over all tasks, numbered by their place in the task and the rows of the tasks before it."""
    spark, parts = winners.sparkSession, int(winners.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("score").desc(), F.col("tie"), F.col("serial")]
    placed = winners.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = materialize(placed, "drawn")
    part, before, offsets = F.shiftright("at", 33), 0, []
    for row in sorted(placed.groupBy(part.alias("part")).count().collect()):
        offsets.append((row.part, before))
        before += row["count"]
    starts = spark.createDataFrame(offsets, "part bigint, before bigint")  # a row per partition
    rank = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("rank", rank)


def draw(docs: DataFrame, target: DataFrame, settings: Settings = Settings(), keep: list[str] | None = None, out: str = "drawn", finish: int = FINISH) -> DataFrame:
    """The columns `keep` (all by default) of every document and `out`: n_features, weight, score, and rank where it is drawn."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != out]
    weighed = materialize(weigh(docs, target, settings, keep), "weighed")
    fit = weighed.where(F.col("n_words") >= settings.least_words)
    wanted = settings.percent * fit.count() // 100
    fields = [F.col(c) for c in ("n_features", "weight", "score")]

    def shown(rows: DataFrame, rank: Column) -> DataFrame:
        return rows.select("row.*", F.struct(*fields, rank.cast("bigint").alias("rank")).alias(out))

    if wanted == 0:
        return shown(weighed, F.lit(None))
    cutoff = _literal(key_at(fit, wanted, finish))
    won = (F.col("n_words") >= settings.least_words) & (_key_column() <= cutoff)
    return shown(weighed.where(~won), F.lit(None)).unionByName(shown(_ranked(weighed.where(won)), F.col("rank")))


def resample(docs: DataFrame, target: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents drawn, with the columns of `docs`."""
    found = draw(docs.withColumn("importance_row", F.struct(*docs.columns)), target, settings, ["importance_row"], "importance_draw")
    return found.where("importance_draw.rank is not null").select("importance_row.*")
