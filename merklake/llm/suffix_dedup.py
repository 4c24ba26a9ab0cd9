"""Removal of text that an earlier document has too: every byte in a string of `span` bytes that also starts in a document of
smaller doc_id. Texts are UTF-8 bytes, matches never cross documents, and all are judged on the input.

Suffixes are sampled as induced sorting samples them, where the text itself says so, and the rest follows from the sample.
The samples are minimizers: of the k-byte strings in each window of `span` bytes the one of least hash, leftmost of equals. Equal
windows have equal samples at equal places, so only windows around equal samples need comparing. A sampled suffix carries its
context, the bytes of all windows that chose it:

1. Per sample string, its smallest and largest doc_id; strings of one document have no match and drop out.
2. Of the rest, each distinct context and its smallest doc_id. A sample string with one context is settled: all its windows have
   that first document.
3. Contexts of a string that has several overlap in part: their windows are compared, and each gets its first document.
4. Contexts that no document later than their first ones has drop out. Of the others, every occurrence takes the first documents
   of its windows; windows that have an earlier one are removed.

Steps are Spark aggregations and joins by content, whose sorts spill to disk, so nothing need fit into a task but one text and
`group_rows` contexts of one sample string; strings with more have their windows aggregated by Spark (step 3). Sums are taken
before each shuffle, so a passage in a third of all documents is one row a task. Sample strings and contexts that drop out in
steps 1 and 4 are kept from later ones by bitmaps of bounded size (16 MB each), which only save work. README says how this differs from sorting suffixes.

Null and empty texts and those shorter than `span` stay whole. Rows of a null doc_id stay whole and are no one's earlier
document. Rows of one doc_id are never earlier than each other, whether they repeat or not.
"""

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merklake.llm.jaccard import split_by_id
from merklake.llm.words import _BASE, _MIX, _powers, mixed, text_slices
from merklake.sources.scratch import materialize

SPAN, SAMPLE = 50, 20
GROUP_ROWS = 100_000
FILTER_BITS = 1 << 27
_SLOTS = (37, 10)  # a hash has two bits in the bitmap, by its upper 27 bits and the 27 below
_PLACES = np.uint64((1 << 24) - 1)
_NOTHING = np.uint64((1 << 64) - 1)
_SLICE, _PIECE = 1 << 18, 1 << 16  # bytes of texts at a time, and of those that are sampled at a time
_REMEMBERED = 1 << 20


class Samples:
    """Sampled suffixes of some texts: which text, the first and last window that chose it, and a hash of the sample string."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, span: int, sample: int):
        self.data, self.offsets, self.span, self.sample = data, offsets, span, sample
        found = [self._piece(at, min(at + _PIECE + span - 1, len(data))) for at in range(0, max(1, len(data) - span + 1), _PIECE)]
        self.first, self.last, self.string = (np.concatenate(x) for x in zip(*found, strict=True))
        self.text = np.searchsorted(offsets, self.first, side="right") - 1

    def _piece(self, begin: int, end: int) -> tuple[np.ndarray, ...]:
        span, k, count = self.span, self.sample, end - begin - self.span + 1
        if count < 1:
            return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),)
        loads = np.ascontiguousarray(_loads(self.data[begin:end]))
        least, size, windows = _ordered(loads, end - begin, k), 1, span - k + 1
        while 2 * size <= windows:
            least, size = np.minimum(least[:-size], least[size:]), 2 * size
        if size < windows:
            least = np.minimum(least[: len(least) - (windows - size)], least[windows - size :])
        # Windows that lie in one text, counted from `begin`; the others choose nothing.
        inside = slice(np.searchsorted(self.offsets, begin, side="right") - 1, np.searchsorted(self.offsets, begin + count))
        starts = np.maximum(self.offsets[:-1][inside] - begin, 0)
        ends = np.minimum(self.offsets[1:][inside] - begin - span + 1, count)
        some = starts < ends
        edges = np.concatenate(([0], np.column_stack((starts[some], ends[some])).ravel(), [count]))
        np.copyto(least, _NOTHING, where=np.repeat(np.arange(len(edges) - 1) % 2 == 0, np.diff(edges)))
        at = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1, [count]))
        chose = least[at[:-1]] != _NOTHING
        first, last = at[:-1][chose], at[1:][chose] - 1
        chosen = (least[first] & _PLACES).astype(np.int64)
        return first + begin, last + begin, _hashed([loads[chosen + o] for o in _steps(k)], k)

    def contexts(self, which: np.ndarray) -> np.ndarray:
        """Hashes of the bytes of all windows of the chosen samples: of their length, the words that begin in the first window,
        and those before the end that lie past these words; so every byte is in one."""
        loads, width, span = _loads(self.data), min(8, self.span), self.span
        first, end = self.first[which], self.last[which] + span
        heads = range(0, span - width + 1, width)
        tails = range(width, 2 * span - self.sample - len(heads) * width + width, width)
        words = [loads[first + o] for o in heads] + [loads[np.maximum(first, end - o)] for o in tails]
        return _hashed([(end - first).astype(np.uint64), *words], width)

    def bytes_of(self, which: np.ndarray) -> list[bytes]:
        """Bytes of all windows of the chosen samples."""
        raw = self.data.tobytes()
        return [raw[a : b + self.span] for a, b in zip(self.first[which].tolist(), self.last[which].tolist(), strict=True)]


def _loads(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on as one number; zeros follow the last."""
    padded = np.concatenate((data, np.zeros(8, dtype=np.uint8)))
    return np.ndarray(len(data), dtype="<u8", buffer=padded, strides=(1,))


def _steps(size: int) -> list[int]:
    """Where the numbers that make up `size` bytes begin."""
    return [*range(0, size - 7, 8), *([max(0, size - 8)] if size % 8 else [])]


def _masked(loads: np.ndarray, size: int) -> np.ndarray:
    return loads if size >= 8 else loads & np.uint64((1 << 8 * size) - 1)


def _ordered(loads: np.ndarray, end: int, size: int) -> np.ndarray:
    """Of each string of `size` bytes some upper bits that order it, and its place."""
    count = end - size + 1
    out = np.zeros(count, dtype=np.uint64)
    for o, factor in zip(_steps(size), _powers(1 << 10)[0][1:], strict=False):
        out += _masked(loads[o : o + count], size) * factor
    out &= ~_PLACES
    out |= np.arange(count, dtype=np.uint64)
    return out


def _hashed(words: list[np.ndarray], size: int) -> np.ndarray:
    """A hash of words in their order, of which each is of `size` bytes, if fewer than eight."""
    out = np.zeros(len(words[0]), dtype=np.uint64)
    for word in words:
        out = mixed((out ^ _masked(word, size)) + np.uint64(_BASE))
    return out


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(max(2 * _PIECE, 1 << len(data).bit_length()))  # one table for all pieces
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_MIX[data] * up[: len(data)], out=sums[1:])
    return sums, down


def _hashes_of_windows(sums: np.ndarray, down: np.ndarray, size: int) -> np.ndarray:
    count = len(sums) - size
    return mixed((sums[size:] - sums[:count]) * down[:count])


def window_hashes(data: np.ndarray, size: int) -> np.ndarray:
    return _hashes_of_windows(*_sums(data), size)


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _docs(batch: pa.RecordBatch, rows: np.ndarray) -> pa.Array:
    return pa.array(batch.column("doc_id").to_numpy()[rows])


def _strings(span: int, sample: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, _, data, offsets in text_slices(batch.column("text"), _SLICE):
                found = Samples(data, offsets, span, sample)
                yield pa.RecordBatch.from_arrays([_signed(found.string), _docs(batch, row + found.text)], ["string", "doc_id"])

    return run


def _flagged(strings: np.ndarray, flags: np.ndarray) -> np.ndarray:
    kept = np.arange(len(strings))
    for shift in _SLOTS:
        slot = (strings[kept] >> np.uint64(shift)).astype(np.int64) & (FILTER_BITS - 1)
        kept = kept[np.flatnonzero(flags[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)]
    return kept


def _contexts(span: int, sample: int, shared):
    """Each flagged context once, as far as a task remembers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, known = np.frombuffer(shared.value, dtype=np.uint8), np.zeros(_REMEMBERED, dtype=np.uint64)
        known[0] = 1  # no hash that has this slot
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column("text"), _SLICE):
                found = Samples(data, offsets, span, sample)
                which = _flagged(found.string, flags)
                hashes, fresh = np.unique(found.contexts(which), return_index=True)
                slot = (hashes % np.uint64(_REMEMBERED)).astype(np.int64)
                new = known[slot] != hashes
                known[slot] = hashes
                hashes, which = hashes[new], which[fresh[new]]
                columns = [_signed(found.string[which]), _signed(hashes), pa.array(found.bytes_of(which), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["string", "hash", "context"])

    return run


def _seen(span: int, sample: int, shared):
    """Every flagged sample: its string, its context, and the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.frombuffer(shared.value, dtype=np.uint8)
        for batch in batches:
            for row, _, data, offsets in text_slices(batch.column("text"), _SLICE):
                found = Samples(data, offsets, span, sample)
                which = _flagged(found.string, flags)
                columns = [_signed(found.string[which]), _signed(found.contexts(which)), _docs(batch, row + found.text[which])]
                yield pa.RecordBatch.from_arrays(columns, ["string", "hash", "doc_id"])

    return run


def _occurrences(span: int, sample: int, shared, useful):
    """Every flagged sample whose context is flagged too, with the text it lies in, its first window and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings, contexts = (np.frombuffer(x.value, dtype=np.uint8) for x in (shared, useful))
        for batch in batches:
            for row, _, data, offsets in text_slices(batch.column("text"), _SLICE):
                found = Samples(data, offsets, span, sample)
                which = _flagged(found.string, strings)
                hashes = found.contexts(which)
                likely = _flagged(hashes, contexts)
                if not len(likely):
                    continue
                which, hashes = which[likely], hashes[likely]
                start, end = found.first[which], found.last[which] + 1
                text = found.text[which]
                columns = [
                    _signed(found.string[which]), _signed(hashes), _docs(batch, row + text),
                    pa.array(text_prints(data, offsets)[text]), pa.array(start - offsets[text]), pa.array((end - start).astype(np.int32)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["string", "hash", "doc_id", "print", "start", "n"])

    return run


def text_prints(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """31 bits that tell texts of one doc_id apart."""
    raw = memoryview(np.ascontiguousarray(data))
    digests = [blake2b(raw[a:b], digest_size=4).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    return (np.frombuffer(b"".join(digests), dtype="<u4") >> np.uint32(1)).astype(np.int32)


def _settle(span: int):
    """First document of every window of the contexts of each sample string; strings come together and in order."""

    def settled(rows: list[tuple[int, int, bytes, int, int]]) -> Iterator[tuple[int, int, list[int]]]:
        starts = np.cumsum([0] + [len(r[2]) for r in rows])
        data = np.frombuffer(b"".join(r[2] for r in rows), dtype=np.uint8)
        sizes = np.diff(starts) - span + 1
        owner = np.repeat(np.arange(len(rows)), sizes)
        at = starts[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        windows = window_hashes(data, span)[at] ^ mixed(np.array([r[0] for r in rows], dtype=np.int64).view(np.uint64))[owner]
        first = np.array([r[3] for r in rows], dtype=np.int64)[owner]
        order = np.lexsort((first, windows))
        new = np.concatenate(([True], np.diff(windows[order]) != 0))
        least = np.empty(len(order), dtype=np.int64)
        least[order] = first[order][np.flatnonzero(new)[np.cumsum(new) - 1]]
        for r, a, n in zip(rows, (np.cumsum(sizes) - sizes).tolist(), sizes.tolist(), strict=True):
            if least[a : a + n].min() < r[4]:
                yield r[0], r[1], least[a : a + n].tolist()

    def batch_of(rows: list) -> pa.RecordBatch:
        found = list(settled(rows))
        columns = ([r[i] for r in found] for i in range(3))
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["string", "hash", "firsts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes, int, int]] = []
        for batch in batches:
            held += zip(*(batch.column(c).to_pylist() for c in ("string", "hash", "context", "first", "last")), strict=True)
            cut = len(held)
            while cut and held[cut - 1][0] == held[-1][0]:
                cut -= 1
            if cut >= 2000:
                yield batch_of(held[:cut])
                held = held[cut:]
        if held:
            yield batch_of(held)

    return run


def _windows(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                hashes = window_hashes(np.frombuffer(batch.column("context")[i].as_py(), dtype=np.uint8), span)
                columns = [batch.column(c).take(pa.array(np.full(len(hashes), i))) for c in ("string", "hash", "first")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.arange(len(hashes), dtype=np.int32)), _signed(hashes)], ["string", "hash", "first", "i", "window"])

    return run


_FIRSTS = "string bigint, hash bigint, firsts array<bigint>"


def _first_documents(sized: DataFrame, contexts: DataFrame, span: int, group_rows: int) -> DataFrame:
    """string, hash, firsts: the first document of each window of every context that a later document has too; of all windows
    where there is but one.

    sized: string, hash, first, last (documents), n (contexts of the string); contexts: string, hash, context of strings with
    several, or more. A context alone in its string and in one document has nothing to remove.
    """
    alone = sized.where("n = 1 and first < last").select("string", "hash", F.array("first").alias("firsts"))
    several = contexts.join(sized.where("n > 1"), ["string", "hash"])
    several = several.groupBy("string", "hash").agg(
        F.first("context").alias("context"), F.min("first").alias("first"), F.max("last").alias("last"), F.min("n").alias("n")
    )
    several = materialize(several, "several_contexts")
    some = several.where(F.col("n") <= group_rows).select("string", "hash", "context", "first", "last")
    some = some.repartition("string").sortWithinPartitions("string").mapInArrow(_settle(span), _FIRSTS)
    windows = several.where(F.col("n") > group_rows).select("string", "hash", "context", "first")
    windows = windows.mapInArrow(_windows(span), "string bigint, hash bigint, first bigint, i int, window bigint")
    least = windows.groupBy("string", "window").agg(F.min("first").alias("least"))
    many = windows.join(least, ["string", "window"]).groupBy("string", "hash").agg(F.array_sort(F.collect_list(F.struct("i", "least"))).alias("w"))
    return alone.union(some).union(many.select("string", "hash", F.transform("w", lambda w: w["least"]).alias("firsts")))


def _bitmap(shared: DataFrame, hashed: str = "string") -> bytes:
    """The hashes in a column, two bits each, as a bitmap of 16 MB whatever their number."""
    slots = F.array(*[F.shiftrightunsigned(hashed, shift).bitwiseAND(F.lit(FILTER_BITS - 1)) for shift in _SLOTS])
    slot = F.col("slot")
    parts = shared.select(F.explode(slots).alias("slot")).select(F.floor(slot / 32768).alias("part"), (slot % 32768).alias("bit")).groupBy("part").agg(F.call_function("bitmap_construct_agg", F.col("bit")).alias("bits"))
    out = bytearray(FILTER_BITS // 8)
    for r in parts.toLocalIterator():
        out[r["part"] * 4096 : (r["part"] + 1) * 4096] = r["bits"]
    return bytes(out)


def find_repeats(docs: DataFrame, span: int = SPAN, sample: int = SAMPLE, group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, print, runs (start * 2^32 + length in bytes; they may overlap) of every text that holds strings of an earlier document."""
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    strings = texts.mapInArrow(_strings(span, sample), "string bigint, doc_id bigint")
    strings = strings.groupBy("string").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("string")
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(materialize(strings, "shared_strings")))
    seen = texts.mapInArrow(_seen(span, sample, shared), "string bigint, hash bigint, doc_id bigint")
    first = seen.groupBy("string", "hash").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    # Both sides of the join read the same columns of `first`, so they share its shuffle. A string of one document, let through by
    # the bitmap, has no match.
    strings = first.groupBy("string").agg(F.count("*").alias("n"), F.min("first").alias("least"), F.max("last").alias("most"))
    sized = materialize(first.join(strings.where("least < most").select("string", "n"), "string"), "sized_contexts")
    several = docs.sparkSession.sparkContext.broadcast(_bitmap(sized.where("n > 1")))
    contexts = texts.mapInArrow(_contexts(span, sample, several), "string bigint, hash bigint, context binary")
    firsts = materialize(_first_documents(sized, contexts, span, group_rows), "first_documents")
    # Only occurrences in a context that some document can lose are sent to it.
    useful = docs.sparkSession.sparkContext.broadcast(_bitmap(firsts, "hash"))
    seen = texts.mapInArrow(_occurrences(span, sample, shared, useful), "string bigint, hash bigint, doc_id bigint, print int, start bigint, n int")
    # Sorted by one number, which is cheaper than by two; the condition compares the other one.
    same = (F.col("s.hash") == F.col("f.hash")) & (F.col("s.string").bitwiseXOR(F.col("f.string")) == 0)
    met = seen.alias("s").join(firsts.alias("f"), same).where(F.array_min("firsts") < F.col("doc_id"))
    whole = F.array(_run(F.col("start"), F.col("n") - 1 + span))
    earlier = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("firsts", i) < F.col("doc_id"))
    runs = F.when(F.array_max("firsts") < F.col("doc_id"), whole).otherwise(F.transform(earlier, lambda i: _run(F.col("start") + i, F.lit(span))))
    # A row that repeats has the same runs again; a set holds them once.
    return met.select("doc_id", "print", runs.alias("runs")).groupBy("doc_id", "print").agg(F.flatten(F.collect_set("runs")).alias("runs"))


def _run(start: Column, size: Column) -> Column:
    return F.shiftleft(start, 32) + size.cast("bigint")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, stop, data, offsets in text_slices(batch.column("text"), _SLICE):
            # Runs lie within their texts, so their number is 0 again where the next text begins.
            change = np.zeros(len(data) + 1, dtype=np.int64)
            if "runs" in batch.schema.names:
                lists = batch.column("runs").slice(row, stop - row)
                runs = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                start = np.repeat(offsets[:-1], pc.fill_null(pc.list_value_length(lists), 0).to_numpy()) + (runs >> 32)
                np.add.at(change, start, 1)
                np.add.at(change, start + (runs & 0xFFFFFFFF), -1)
            gone = np.cumsum(change[:-1]) > 0
            # A run ends with its text, also where the next one begins with a run.
            starts, ends = gone.copy(), gone.copy()
            filled = offsets[:-1] < offsets[1:]
            starts[1:] &= ~gone[:-1]
            ends[:-1] &= ~gone[1:]
            starts[offsets[:-1][filled]] = gone[offsets[:-1][filled]]
            ends[offsets[1:][filled] - 1] = gone[offsets[1:][filled] - 1]
            start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
            first = np.searchsorted(start, offsets)
            base = np.repeat(offsets[:-1], np.diff(first))
            spans = pa.StructArray.from_arrays([pa.array(start - base), pa.array(end - base)], ["start", "end"])
            left = data[~gone].tobytes()
            at = np.concatenate(([0], np.cumsum(~gone)))[offsets].tolist()
            kept = pa.array([left[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
            columns = [batch.column("doc_id").slice(row, stop - row), pa.ListArray.from_arrays(pa.array(first, pa.int32()), spans), kept]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "spans", "kept"])


def _printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [p for _, _, data, offsets in text_slices(batch.column("text"), _SLICE) for p in text_prints(data, offsets).tolist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(prints, pa.int32())], ["doc_id", "text", "print"])


def remove_repeats(docs: DataFrame, span: int = SPAN, sample: int = SAMPLE, group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, spans (start, end of the maximal removed runs, in bytes) and kept (the other bytes) of every row of `docs`."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    repeats = materialize(find_repeats(docs, span, sample, group_rows), "runs")
    likely, clean = split_by_id(docs, repeats.select("doc_id"))
    likely = likely.mapInArrow(_printed, "doc_id bigint, text string, print int").join(repeats, ["doc_id", "print"], "left")
    result = "doc_id bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"
    return likely.select("doc_id", "text", "runs").mapInArrow(_cut, result).union(clean.mapInArrow(_cut, result))
