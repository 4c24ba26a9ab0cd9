"""Similarity join of documents by the Jaccard index of their word shingles, exact, by partition of the universe.

Sets come in bands of size. In a band the universe of shingles is cut by hash into segments. Two sets that differ in at
most h shingles differ in few enough of any run of segments whose weights reach h + 1 that they agree in one: an ordinary
segment (weight 1) must be equal, a wide one (weight 2) equal but for one deletion. So a set is indexed under its first
segments, as many as the largest partner allows, in its own band and in the next ones that a partner may lie in.
Empty segments would agree everywhere: `slack` further segments stand in for them, and only a set with more empty ones
than that is indexed under these too. How many segments are wide is chosen for each band by cost, from the number of sets
in it (counted over all documents): wide ones cost a row for each shingle but make segments larger, which chance seldom
makes agree.

The `slack` segments come on top of those that a link needs. So a set leaves out, of its plain ones in a band, as many of the
commonest as there is slack, empty ones being the commonest. The order is one for all sets (rows of the bucket,
then the key), so of the segments that two linked sets have in common the least common stays with both. Only buckets of more than COMMON
sets are left: a passage that many texts share makes no large bucket, unless a text holds little else.

Every bucket has a pivot. In rounds each set is compared with one pivot: of those that still lie in another component and were not
tried, the one it shares most buckets with. So a round costs a pair per set, and a group of copies of any size falls into one
component at the first. Then buckets of more than DEPUTIES sets that still hold several components have up to DEPUTIES further
pivots, and each set is compared with the NEAREST of them that it shares most buckets with: in a large group in which not all
link with all, few pivots link with most. What lies in different components after that is compared too, in pairs that parity sketches
(lower bounds of the difference) of 512 and 2,048 bits do not rule out, nor one of 4,096 bits after them; buckets of the same sets
are one, and a pair leaves the join at the first bucket its sets share, as far as SHARED keys of each tell. What is left is verified on the words
themselves, so the components are those of all links. Equal sets (128-bit fingerprints of the shingle hashes) are one set from the start.

Null and empty texts have no set and are linked with nothing. Very long texts are handled whole. Repeated rows are one set. Empty tables
give empty tables.
"""

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merklake.llm.components import extend
from merklake.llm.words import SPACED, Words, find_words, mixed, ngram_hashes, text_slices
from merklake.sources.scratch import materialize

BAND_RATIO = 2.0
CHANCE = 1e-6  # that two shingles of unrelated sets are equal
COARSE_BITS, SKETCH_BITS, FINE_BITS = 512, 2048, 4096
DEPUTIES, NEAREST = 8, 4
COMMON, SPARE_BITS = 8, 16  # sets leave larger buckets than this as far as they can spare them
SHARED = 16  # least keys of a set that go with its rows, so that a pair is found once
ID_FILTER_BITS = 1 << 26  # 8 MB at most, whatever the number of documents


@dataclass(frozen=True)
class Rule:
    """Two sets link when 100 * intersection >= percent * union of their shingles of `words` words."""

    words: int
    percent: int

    def most_different(self, a, b):
        """Largest symmetric difference of linked sets of these sizes."""
        return (a + b) * (100 - self.percent) // (100 + self.percent)

    def largest_partner(self, a):
        return a * 100 // self.percent


@dataclass(frozen=True)
class Band:
    """Sets of `first` to `last` shingles: `wide` segments of weight 2, then `plain` ones of weight 1."""

    number: int
    first: int
    last: int
    wide: int
    plain: int
    slack: int


def cut_bands(rule: Rule, counts: dict[int, int], ratio: float = BAND_RATIO, chance: float = CHANCE) -> list[Band]:
    """Bands for sets of the given sizes, each with its cheapest allocation. counts: number of sets by band number."""
    return [_cheapest(rule, number, first, last, n, chance) for number, (first, last) in enumerate(edges(ratio, len(counts))) for n in [counts[number]]]


def edges(ratio: float, bands: int) -> list[tuple[int, int]]:
    out, first = [], 1
    for _ in range(bands):
        after = max(first + 1, math.floor(first * ratio))
        out.append((first, after - 1))
        first = after
    return out


def _cheapest(rule: Rule, number: int, first: int, last: int, n_sets: int, chance: float) -> Band:
    need = int(rule.most_different(last, last)) + 1

    def price(wide: int) -> tuple[float, Band]:
        segments = need - wide
        size = first / segments
        empty = max(0, need - 2 * wide) * math.exp(-size)
        slack = math.ceil(empty + 3 * math.sqrt(empty))
        rows = n_sets * (need - wide + wide * (first / segments))
        by_chance = sum(n_sets**2 / 2 * k * _poisson(size, chance) for k in (need - 2 * wide, wide * size))
        return rows + by_chance, Band(number, first, last, wide, need - 2 * wide + slack, slack)

    return min((price(w) for w in sorted({0, need // 8, need // 4, need // 2})), key=lambda x: x[0])[1]


def _poisson(size: float, chance: float) -> float:
    """Two unrelated segments of this mean size agree and are not empty."""
    return sum((math.exp(-size) * size**k / math.factorial(k)) ** 2 * chance**k for k in range(1, 8))


def shingle_sets(words: Words, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; the whole sequence where it is shorter than n."""
    grams = ngram_hashes(words.hashes, n)
    first = words.first
    for t in range(len(first) - 1):
        count = first[t + 1] - first[t]
        if count >= n:
            yield np.unique(grams[first[t] : first[t + 1] - n + 1])
        elif count:
            yield ngram_hashes(words.hashes[first[t] : first[t + 1]], int(count))
        else:
            yield np.empty(0, dtype=np.uint64)


def index_keys(own: np.ndarray, rule: Rule, bands: list[Band]) -> np.ndarray:
    """Keys under which a set is found; those of a deletion are odd, those of a segment itself even.

    A key is matched whatever its last bit, so 63 bits tell keys apart.
    """
    return keys_and_lots(own, rule, bands)[0]


def keys_and_lots(own: np.ndarray, rule: Rule, bands: list[Band]) -> tuple[np.ndarray, np.ndarray]:
    """The keys, and the lot of each: number of its band, and how many keys of that lot may go (SPARE_BITS); 0 for one that may not."""
    size, out, lots = len(own), [], []
    largest = int(rule.largest_partner(size))
    spread = mixed(own ^ np.uint64(0x5851F42D4C957F2D))
    for band in bands:
        if band.last < size or band.first > largest or not size:
            continue
        need = int(rule.most_different(size, min(largest, band.last))) + 1 + band.slack
        wide = min(band.wide, (need + 1) // 2)
        plain = max(0, min(band.plain, need - 2 * wide))
        slot = (own % np.uint64(band.wide + band.plain)).astype(np.int64)
        sums = np.zeros(band.wide + band.plain, dtype=np.uint64)
        np.add.at(sums, slot, spread)
        full = np.bincount(slot, minlength=len(sums)) > 0
        chosen = np.concatenate((np.arange(wide), band.wide + np.arange(plain)))
        hollow = ~full[chosen] & (chosen >= band.wide)
        spare = max(0, band.slack - int(hollow.sum()))
        if hollow.sum() <= band.slack:
            chosen = chosen[~hollow]
        tag = mixed(np.uint64(band.number << 32) + np.arange(len(sums), dtype=np.uint64))
        out.append(mixed(sums[chosen] ^ tag[chosen]) & ~np.uint64(1))
        cut = slot < wide
        out.append(mixed((sums[slot[cut]] - spread[cut]) ^ tag[slot[cut]]) | np.uint64(1))
        lot = (band.number << SPARE_BITS) + min(spare, (1 << SPARE_BITS) - 1) if spare else 0
        lots.append(np.concatenate((np.where(chosen >= band.wide, lot, 0), np.zeros(cut.sum(), dtype=np.int64))))
    return (np.concatenate(out), np.concatenate(lots)) if out else (np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64))


def _fingerprint(own: np.ndarray) -> tuple[np.uint64, np.uint64]:
    return mixed(own).sum(dtype=np.uint64), mixed(own ^ np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64)


def _fingerprints(prints: list) -> list[pa.Array]:
    both = np.array(prints, dtype=np.uint64).reshape(-1, 2).view(np.int64)
    return [pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())]


def parity_sketch(own: np.ndarray, bits: int) -> np.ndarray:
    """Parity of the number of shingles in each of `bits` slots, as 64-bit numbers."""
    odd = np.bincount((own >> np.uint64(20)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _lists(sketches: list[np.ndarray], bits: int) -> pa.Array:
    flat, words = pa.array(np.concatenate(sketches) if sketches else np.empty(0, np.int64)), bits // 64
    return pa.ListArray.from_arrays(pa.array(np.arange(0, words * len(sketches) + 1, words, dtype=np.int32)), flat)


def _sets_of(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, prints, sketches = [], [], []
            for _, _, data, offsets in text_slices(batch.column("text")):
                for own in shingle_sets(find_words(data, offsets, SPACED), rule.words):
                    sizes.append(len(own))
                    prints.append(_fingerprint(own))
                    sketches.append(parity_sketch(own, SKETCH_BITS))
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), *_fingerprints(prints), _lists(sketches, SKETCH_BITS)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "f0", "f1", "sketch"])

    return run


def with_fingerprints(docs: DataFrame, rule: Rule) -> DataFrame:
    """All columns, and the fingerprint f0, f1 of the shingle set of `text`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = []
            for _, _, data, offsets in text_slices(batch.column("text")):
                prints += map(_fingerprint, shingle_sets(find_words(data, offsets, SPACED), rule.words))
            names = [n for n in batch.schema.names if n not in ("f0", "f1")]
            columns = [*(batch.column(n) for n in names), *_fingerprints(prints)]
            yield pa.RecordBatch.from_arrays(columns, [*names, "f0", "f1"])

    fields = docs.drop("f0", "f1").schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return docs.mapInArrow(run, f"{schema}, f0 bigint, f1 bigint")


def _keys_of(rule: Rule, bands: list[Band]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, stop, data, offsets in text_slices(batch.column("text")):
                keys, lots, prints = [], [], []
                for own in shingle_sets(find_words(data, offsets, SPACED), rule.words):
                    prints.append(_fingerprint(own))
                    for out, found in zip((keys, lots), keys_and_lots(own, rule, bands), strict=True):
                        out.append(found)
                ends = pa.array(np.cumsum([0, *map(len, keys)], dtype=np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(values)) for values in (np.concatenate(keys).view(np.int64), np.concatenate(lots).astype(np.int32))]
                columns = [batch.column("doc_id").slice(row, stop - row), *_fingerprints(prints), *lists]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "f0", "f1", "keys", "lots"])

    return run


def _shingles(text: str | None, n: int) -> set:
    raw = (text or "").encode()
    own = find_words(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]), SPACED).of(0)
    return {tuple(own)} if len(own) < n else set(zip(*(own[i:] for i in range(n)), strict=False))


def _verified_by(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, a_set = None, set()
        for batch in batches:
            keep = []
            a, a_text, b_text = (batch.column(c) for c in ("a", "a_text", "b_text"))
            for i in range(batch.num_rows):
                if a[i].as_py() != held:
                    held, a_set = a[i].as_py(), _shingles(a_text[i].as_py(), rule.words)
                b_set = _shingles(b_text[i].as_py(), rule.words)
                common = len(a_set & b_set)
                keep.append(100 * common >= rule.percent * (len(a_set) + len(b_set) - common))
            yield pa.RecordBatch.from_arrays([a, batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _may_link(rule: Rule, **sketches: int) -> Column:
    """Sizes and sketches (a_n, b_n, words of sketches by side) that a link does not rule out; by name, the bits of each sketch, coarse ones first."""
    a, b = F.col("a_n"), F.col("b_n")
    sizes = (F.least(a, b) * 100 >= F.greatest(a, b) * rule.percent)
    for name, bits in sketches.items():
        # Word by word, as lambdas are not compiled.
        differ = sum((F.bit_count(F.col(f"a_{name}{k}").bitwiseXOR(F.col(f"b_{name}{k}"))) for k in range(bits // 64)), F.lit(0))
        sizes = sizes & (differ * (100 + rule.percent) <= (a + b) * (100 - rule.percent))
    return sizes


def _in_words(name: str, bits: int) -> list[Column]:
    """A sketch as a column a word, without nulls: the test of a pair on arrays is a method so large that the JVM does not compile it."""
    return [F.coalesce(F.get(name, F.lit(k)), F.lit(0).cast("bigint")).alias(f"{name}{k}") for k in range(bits // 64)]


def _with_sets(pairs: DataFrame, sets: DataFrame, *sides: str) -> DataFrame:
    """All that `sets` tell of the sets at these sides: n_shingles as a_n, other columns by their own names."""
    own = [(c, "n" if c == "n_shingles" else c) for c in sets.columns if c != "set_no"]
    for side in sides:
        pairs = pairs.join(sets.select(F.col("set_no").alias(side), *[F.col(c).alias(f"{side}_{name}") for c, name in own]), side)
    return pairs


def split_by_id(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of `docs` whose doc_id may be among `ids`, and those whose doc_id is not. Whatever the number of ids, they
    are told by a bitmap of bounded size, so only rows that matter go on to a shuffle; an exact join must follow."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(ID_FILTER_BITS))
    bucket, bit = F.call_function("bitmap_bucket_number", slot), F.call_function("bitmap_bit_position", slot)
    bitmap = ids.select(bucket.alias("_bucket"), bit.alias("_bit")).distinct()
    bitmap = bitmap.groupBy("_bucket").agg(F.call_function("bitmap_construct_agg", F.col("_bit")).alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = docs.withColumn("_bucket", bucket).join(F.broadcast(bitmap), "_bucket", "left")
    hit = F.coalesce(F.call_function("getbit", byte, (bit % 8).cast("int")) == 1, F.lit(False))
    return marked.where(hit).select(*docs.columns), marked.where(~hit).select(*docs.columns)


def _finely(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, sketches = [], []
            for _, _, data, offsets in text_slices(batch.column("text")):
                for own in shingle_sets(find_words(data, offsets, SPACED), rule.words):
                    sizes.append(len(own))
                    sketches.append(parity_sketch(own, FINE_BITS))
            columns = [batch.column("set_no"), pa.array(sizes, pa.int64()), _lists(sketches, FINE_BITS), batch.column("text")]
            yield pa.RecordBatch.from_arrays(columns, ["set_no", "n_shingles", "sketch", "text"])

    return run


def _texts(docs: DataFrame, sets: DataFrame, wanted: DataFrame, rule: Rule) -> DataFrame:
    """set_no, n_shingles, sketch (a fine one), text of the wanted sets."""
    ids = materialize(wanted.join(sets, "set_no").select("set_no", "doc_id", "f0", "f1"), "wanted_texts")
    # Any row of a set will do, so texts are dealt out once, by fingerprint, for both the choice of one and the join.
    likely = with_fingerprints(split_by_id(docs, ids)[0], rule).dropDuplicates(["f0", "f1"])
    found = likely.join(ids.select("set_no", "f0", "f1"), ["f0", "f1"]).select("set_no", "text")
    return materialize(found.mapInArrow(_finely(rule), "set_no bigint, n_shingles bigint, sketch array<bigint>, text string"), "texts")


def _likely(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Those of the pairs (a, b of set_no) that sizes and sketches do not rule out, once."""
    sets = sets.select("set_no", "n_shingles", *_in_words("sketch", SKETCH_BITS))
    return materialize(_with_sets(pairs.distinct(), sets, "a", "b").where(_may_link(rule, sketch=SKETCH_BITS)).select("a", "b"), "pairs")


def _verify(pairs: DataFrame, docs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Those of the likely pairs (a, b of set_no) that link: by a fine sketch, and the words of those left."""
    texts = _texts(docs, sets, pairs.select(F.col("a").alias("set_no")).union(pairs.select("b")).distinct(), rule)
    fine = texts.select("set_no", "n_shingles", *_in_words("sketch", FINE_BITS))
    pairs = materialize(_with_sets(pairs, fine, "a", "b").where(_may_link(rule, sketch=FINE_BITS)).select("a", "b"), "near_pairs")
    both = pairs.join(texts.select(F.col("set_no").alias("b"), F.col("text").alias("b_text")), "b")
    both = both.join(texts.select(F.col("set_no").alias("a"), F.col("text").alias("a_text")), "a")
    return materialize(both.mapInArrow(_verified_by(rule), "a bigint, b bigint"), "links")


def _allocated(sets: DataFrame, rule: Rule, ratio: float, chance: float) -> list[Band]:
    largest = sets.agg(F.max("n_shingles")).first()[0] or 1
    firsts, last = [1], 1
    while last <= rule.largest_partner(largest):
        last = max(last + 1, math.floor(last * ratio))
        firsts.append(last)
    band = F.size(F.filter(F.lit(firsts), lambda x: x <= F.col("n_shingles"))) - 1
    counted = {r["band"]: r["count"] for r in sets.groupBy(band.alias("band")).count().collect()}
    return cut_bands(rule, {k: counted.get(k, 0) for k in range(len(firsts))}, ratio, chance)


_DELETION = 1 << 62


@dataclass
class Linked:
    """rows: doc_id, n_shingles, f0, f1 of every document; sets: set_no, f0, f1, doc_id (smallest), n_rows, n_shingles of every
    distinct set; links: pairs a, b of set_no; components: node, component of set_no."""

    rows: DataFrame
    sets: DataFrame
    links: DataFrame
    components: DataFrame


def link(docs: DataFrame, rule: Rule, ratio: float = BAND_RATIO, chance: float = CHANCE) -> Linked:
    """All links of `docs` (doc_id, text) that join components, by the method above."""
    docs = docs.select("doc_id", "text")
    rows = materialize(docs.mapInArrow(_sets_of(rule), "doc_id bigint, n_shingles bigint, f0 bigint, f1 bigint, sketch array<bigint>"), "rows")
    sets = rows.where("n_shingles > 0").groupBy("f0", "f1").agg(
        F.min("doc_id").alias("doc_id"), F.count("*").alias("n_rows"), F.first("n_shingles").alias("n_shingles"),
        F.first("sketch").alias("sketch"),
    )
    sets = materialize(sets.withColumn("set_no", F.monotonically_increasing_id()), "sets")
    bands = _allocated(sets, rule, ratio, chance)
    keyed = docs.mapInArrow(_keys_of(rule, bands), "doc_id bigint, f0 bigint, f1 bigint, keys array<bigint>, lots array<int>").alias("k")
    same = F.col("k.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("k.f0") == F.col("s.f0")) & (F.col("k.f1") == F.col("s.f1"))
    index = materialize(keyed.join(sets.alias("s"), same).select("set_no", "keys", "lots"), "index")
    entries = index.select("set_no", F.explode(F.arrays_zip("keys", "lots")).alias("e")).select(
        F.shiftright("e.keys", 1).alias("key"), (F.col("set_no") + F.col("e.keys").bitwiseAND(1) * F.lit(_DELETION)).alias("member"), F.col("e.lots").alias("lot")
    )
    entries = entries.repartition("key")  # one shuffle for the heads and the join with them
    heads = entries.groupBy("key").agg(F.min("member").alias("pivot"), F.max("member").alias("last"), F.count("*").alias("n"))
    heads = heads.where((F.col("pivot") < F.col("last")) & (F.col("pivot") < F.lit(_DELETION))).select("key", "pivot", "n")
    whole = F.col("member") < F.lit(_DELETION)
    members = entries.join(heads, "key").select(
        "key", "pivot", F.when(whole, F.col("member")).otherwise(F.col("member") - F.lit(_DELETION)).alias("set_no"), whole.alias("whole"), "lot", "n"
    )
    members = _without_spares(materialize(members, "all_buckets"))

    agreed = members.where("set_no != pivot").groupBy("set_no", "pivot").agg(F.count("*").alias("n"))
    best = agreed.groupBy("set_no").agg(F.max_by("pivot", F.struct("n", -F.col("pivot"))).alias("pivot"))
    tried = materialize(best, "tried")
    pairs = tried.select(F.col("pivot").alias("a"), F.col("set_no").alias("b"))
    links = _verify(_likely(pairs, sets, rule), docs, sets, rule)
    grouped = materialize(extend(None, links), "grouped")
    split = _split_buckets(members, grouped)
    near = materialize(_near_deputies(split).join(tried, ["set_no", "pivot"], "left_anti"), "near_deputies")
    if near.take(1):
        pairs = near.select(F.least("set_no", "pivot").alias("a"), F.greatest("set_no", "pivot").alias("b"))
        found = _verify(_likely(pairs, sets, rule), docs, sets, rule)
        links, grouped = materialize(links.union(found), "links"), materialize(extend(grouped, found), "grouped")
        split = _split_buckets(split, grouped)
    rest = _across(split, sets, rule)
    if rest.take(1):
        found = _verify(rest, docs, sets, rule)
        links, grouped = materialize(links.union(found), "links"), extend(grouped, found)
    return Linked(rows.drop("sketch"), sets.drop("sketch"), links, grouped)


def _without_spares(members: DataFrame) -> DataFrame:
    """key, pivot, set_no, whole of the buckets, without the rows that sets can spare in common ones.

    Of a lot, two linked sets have one key more in common than either may drop. Both drop the keys of the largest buckets, in one
    order for all sets, so the last of the common keys in this order stays with both.
    """
    common = F.col("n") > COMMON
    may_go = common & (F.col("lot") > 0)
    number, spare = F.shiftright("lot", SPARE_BITS), F.col("lot").bitwiseAND((1 << SPARE_BITS) - 1)
    order = F.row_number().over(Window.partitionBy("set_no", number).orderBy(F.desc("n"), "key"))
    stay = members.where(may_go).withColumn("order", order).where(F.col("order") > spare).select("key", "set_no", "whole")
    stay = materialize(stay.union(members.where(common & ~may_go).select("key", "set_no", "whole")), "common_buckets")
    heads = stay.groupBy("key").agg(F.min(F.when(F.col("whole"), F.col("set_no"))).alias("pivot"), F.count("*").alias("n"))
    heads = heads.where((F.col("n") > 1) & F.col("pivot").isNotNull()).select("key", "pivot")
    left = stay.join(heads, "key").select("key", "pivot", "set_no", "whole")
    return materialize(members.where(~common).select("key", "pivot", "set_no", "whole").union(left), "buckets")


def _split_buckets(members: DataFrame, grouped: DataFrame) -> DataFrame:
    """Members (with `component`; `main`, that of the pivot; `n`, their number) of the buckets that hold more than one component."""
    known = grouped.select(F.col("node").alias("set_no"), "component")
    labelled = members.select("key", "pivot", "set_no", "whole").join(known, "set_no", "left").withColumn("component", F.coalesce("component", "set_no"))
    mains = labelled.groupBy("key").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"),
        F.max(F.when(F.col("set_no") == F.col("pivot"), F.col("component"))).alias("main"), F.count("*").alias("n"),
    )
    return materialize(labelled.join(mains.where("lo < hi").select("key", "main", "n"), "key"), "split_buckets")


def _near_deputies(split: DataFrame) -> DataFrame:
    """set_no, pivot: sets outside the main components of large buckets, each with the NEAREST deputies it shares most of these with.

    A bucket's deputies are the least whole member of each of DEPUTIES classes, by a hash that is the same in all buckets, so
    buckets of one group have few different ones.
    """
    large = split.where(F.col("n") > DEPUTIES)
    deputy = F.min(F.struct(F.col("set_no").alias("pivot"), F.col("component").alias("of"))).alias("deputy")
    deputies = large.where("whole").groupBy("key", F.pmod(F.xxhash64("set_no"), F.lit(DEPUTIES)).alias("class")).agg(deputy)
    met = large.where("component != main").select("key", "set_no", "component").join(deputies.select("key", "deputy.*"), "key")
    agreed = met.where("component != of").groupBy("set_no", "pivot").agg(F.count("*").alias("n"))
    ranked = F.row_number().over(Window.partitionBy("set_no").orderBy(F.desc("n"), "pivot"))
    return agreed.withColumn("rank", ranked).where(F.col("rank") <= NEAREST).select("set_no", "pivot")


def _one_of_each(split: DataFrame) -> DataFrame:
    """Of buckets that hold the same sets, the one of least key."""
    held = [F.sum(F.xxhash64("set_no", "whole", F.lit(seed)).cast("decimal(20,0)")).alias(f"h{seed}") for seed in range(2)]
    kept = split.groupBy("key").agg(F.count("*").alias("n"), *held).groupBy("n", "h0", "h1").agg(F.min("key").alias("key"))
    return materialize(split.join(kept.select("key"), "key", "left_semi"), "kept_buckets")


def _coarse(k: int) -> Column:
    """Word k of a sketch of fewer bits: slots modulo these."""
    return reduce(Column.bitwiseXOR, [F.col(f"sketch{j}") for j in range(k, SKETCH_BITS // 64, COARSE_BITS // 64)]).alias(f"coarse{k}")


def _meetings(split: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (nearly all once) that share a bucket, lie in different components, and neither sizes nor sketches rule out.

    A bucket's main component is its pivot's; every other member meets all of the bucket that is not in its own component.
    Only pairs that pass leave the join. Two sets whole in one bucket leave it there unless both carry a smaller key of
    another one: they leave the bucket of the least key that both carry, or all they share if there is none.
    """
    shared = F.slice(F.sort_array(F.collect_set(F.when(F.col("whole"), F.col("key")))), 1, SHARED).alias("shared")
    # Sets, their keys and the rows of both sides are dealt out by set_no, so sketches go there once.
    words = sets.select("set_no", "n_shingles", *_in_words("sketch", SKETCH_BITS))
    words = words.select("*", *map(_coarse, range(COARSE_BITS // 64)))
    sets = words.join(split.groupBy("set_no").agg(shared), "set_no")
    other = split.where("component != main").select("key", F.col("set_no").alias("a"), F.col("component").alias("ac"), F.col("whole").alias("aw"))
    every = split.select("key", F.col("set_no").alias("b"), F.col("component").alias("bc"), F.col("whole").alias("bw"), "main")
    met = _with_sets(other, sets, "a").join(_with_sets(every, sets, "b"), "key")
    apart = (F.col("ac") != F.col("bc")) & ((F.col("bc") == F.col("main")) | (F.col("a") < F.col("b"))) & (F.col("aw") | F.col("bw"))
    # Both lists are sorted, so what they share is too.
    before = F.col("aw") & F.col("bw") & F.coalesce(F.get(F.array_intersect("a_shared", "b_shared"), F.lit(0)) < F.col("key"), F.lit(False))
    return met.where(apart & _may_link(rule, coarse=COARSE_BITS, sketch=SKETCH_BITS) & ~before).select("a", "b")


def _across(split: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    return materialize(_meetings(_one_of_each(split), sets, rule).distinct(), "across")


def component_ids(linked: Linked) -> DataFrame:
    """Per row of the documents: doc_id, n_shingles, f0, f1, component_id (smallest doc_id of the component), component_rows (of
    it), component (its own key, as components may have one smallest doc_id, or none; null for a document without words).

    A document without words is linked with nothing; a null doc_id takes the id of its component, where that has one.
    """
    comp = linked.sets.join(linked.components.withColumnRenamed("node", "set_no"), "set_no", "left")
    comp = materialize(comp.withColumn("component", F.coalesce("component", "set_no")).select("f0", "f1", "doc_id", "n_rows", "component"), "classes")
    least = comp.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.sum("n_rows").alias("component_rows"))
    labels = comp.join(least, "component").select("f0", "f1", "component_id", "component_rows", "component")
    worded = linked.rows.where("n_shingles > 0").join(labels, ["f0", "f1"])
    bare = linked.rows.where("n_shingles = 0").select("*", F.col("doc_id").alias("component_id"), F.lit(1).cast("bigint").alias("component_rows"), F.lit(None).cast("bigint").alias("component"))
    return worded.select("doc_id", "n_shingles", "f0", "f1", "component_id", "component_rows", "component").unionByName(bare)


def _same(left: str, right: str) -> Column:
    """Rows of one doc_id, null or not, and one set."""
    return F.col(f"{left}.doc_id").eqNullSafe(F.col(f"{right}.doc_id")) & (F.col(f"{left}.f0") == F.col(f"{right}.f0")) & (F.col(f"{left}.f1") == F.col(f"{right}.f1"))


def _marks(labels: DataFrame) -> DataFrame:
    """doc_id, f0, f1, component, copies (rows like it), head (true for one of them in each component, with its smallest doc_id)."""
    marks = labels.groupBy("doc_id", "f0", "f1", "component_id", "component").agg(F.count("*").alias("copies"))
    heads = marks.where("doc_id <=> component_id").groupBy("component").agg(F.min(F.struct("f0", "f1", "doc_id")).alias("least")).select("least.*")
    # By doc_id too, so a large component is not one task.
    marked = marks.alias("m").join(heads.alias("h"), _same("m", "h"), "left")
    return marked.select("m.doc_id", "m.f0", "m.f1", "m.component", "m.copies", F.col("h.f0").isNotNull().alias("head"))


def keep_one(docs: DataFrame, rule: Rule) -> DataFrame:
    """One row of each component: that with its smallest doc_id. All rows without words stay. Columns are as given.

    Which rows go is told by doc_id and fingerprint. Only texts go to a shuffle whose doc_id is that of a row that goes, or that the
    bitmap takes for one, and of another that stays.
    """
    labels = materialize(component_ids(link(docs, rule)).where("component_rows > 1"), "groups")
    marks = materialize(_marks(labels), "marks")
    gone = marks.where("not head or copies > 1").select("doc_id", "f0", "f1")
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))
    likely, alone = split_by_id(rows, gone.select("doc_id"))
    told = with_fingerprints(likely.select("doc_id", "text"), rule).select("doc_id", "f0", "f1").alias("d")
    stay = materialize(told.join(gone.alias("g"), _same("d", "g"), "left_anti").select("doc_id").distinct(), "stay")
    kept = alone.select("row.*")
    if stay.take(1):
        rest = with_fingerprints(split_by_id(likely, stay)[0], rule).alias("d")
        kept = kept.unionByName(rest.join(gone.alias("g"), _same("d", "g"), "left_anti").select("row.*"))
    repeated = marks.where("head and copies > 1")
    if repeated.take(1):
        heads = with_fingerprints(split_by_id(rows, repeated.select("doc_id"))[0], rule).alias("d")
        heads = heads.join(repeated.alias("r"), _same("d", "r")).select("d.row", "r.component")
        kept = kept.unionByName(heads.dropDuplicates(["component"]).select("row.*"))
    return kept
