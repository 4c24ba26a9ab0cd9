"""Benchmark decontamination: words of documents that lie in a window of a benchmark item.

The benchmark's windows (n consecutive words; all words of a shorter item) become a hash set that every task gets as
a broadcast of at most `block_rows` rows; a larger benchmark is taken in several such blocks, one pass over the
documents each. A pass hashes all windows of whole texts, looks the hashes up, and verifies each hit word by word.
Documents are never shuffled, so a source or a group of copies of any size needs no splitting.

Null and empty texts have no words and are clean. Null texts of items have no windows; items with a null id hit but
are not listed. Repeated rows, on either side, each count as they are. Very long texts are handled whole;
empty documents give an empty table, and an empty benchmark hits nothing. An input column named like the result is replaced; others may have
any name.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merklake.llm.words import ALPHANUMERIC, find_words, ngram_hashes, text_slices, unused
from merklake.sources.scratch import materialize

WINDOW = 10
BLOCK_ROWS = 200_000
_FLAG_BITS = 22

_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_FOUND = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", pa.list_(_SPAN)), ("items", pa.list_(pa.string()))])
_FOUND_DDL = "struct<n_words:bigint,n_hit:bigint,spans:array<struct<start:bigint,end:bigint>>,items:array<string>>"


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id string, n int, words binary (joined by blanks): one row per window of each item."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, stop, data, offsets in text_slices(batch.column("text")):
                words, out = find_words(data, offsets, ALPHANUMERIC), []
                for t in range(stop - row):
                    own, item = words.of(t), batch.column("item_id")[row + t].as_py()
                    n = min(window, len(own))
                    out += [(item, n, b" ".join(own[i : i + n])) for i in range(len(own) - n + 1) if n]
                names, kinds = ("item_id", "n", "words"), (pa.string(), pa.int32(), pa.binary())
                columns = zip(*out, strict=True) if out else ([], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    ids = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    return ids.mapInArrow(cut, "item_id string, n int, words binary").distinct()


class WindowSet:
    """A block of windows: hashes by window length for the scan, and the words themselves for the check."""

    def __init__(self, rows: list[tuple[str | None, int, bytes]]):
        self.items: dict[bytes, list[str | None]] = {}
        for item, _, words in rows:
            self.items.setdefault(bytes(words), []).append(item)
        self.hashes: dict[int, np.ndarray] = {}
        for n in sorted({n for _, n, _ in rows}):
            own = [bytes(words) for _, k, words in rows if k == n]
            data = np.frombuffer(b"".join(own), dtype=np.uint8)
            found = find_words(data, np.cumsum([0, *map(len, own)]), ALPHANUMERIC)
            self.hashes[n] = np.unique(ngram_hashes(found.hashes, n)[found.first[:-1]])
        self.flags = {n: np.zeros(1 << _FLAG_BITS, dtype=bool) for n in self.hashes}
        for n, hashes in self.hashes.items():
            self.flags[n][hashes >> np.uint64(64 - _FLAG_BITS)] = True

    def suspects(self, hashes: np.ndarray, n: int) -> np.ndarray:
        """Positions whose hash is in the set."""
        at = np.flatnonzero(self.flags[n][hashes >> np.uint64(64 - _FLAG_BITS)])
        known = self.hashes[n]
        slot = np.minimum(np.searchsorted(known, hashes[at]), len(known) - 1)
        return at[known[slot] == hashes[at]]


def _scan(windows: WindowSet, texts: pa.Array, before: pa.Array | None) -> pa.Array:
    out: list[dict] = []
    for row, stop, data, offsets in text_slices(texts):
        words = find_words(data, offsets, ALPHANUMERIC)
        hits: dict[int, list[tuple[int, int]]] = {}
        for n in windows.hashes:
            at = windows.suspects(ngram_hashes(words.hashes, n), n)
            text = np.searchsorted(words.first, at, side="right") - 1
            inside = at + n <= words.first[text + 1]
            for t, i in zip(text[inside].tolist(), at[inside].tolist(), strict=True):
                hits.setdefault(t, []).append((i - int(words.first[t]), n))
        for t, n_words in enumerate(np.diff(words.first).tolist()):
            found = {"n_words": n_words, "n_hit": 0, "spans": [], "items": []}
            earlier = before[row + t].as_py() if before is not None else found
            if t in hits or earlier["spans"]:
                found |= _verified(windows, words, t, hits.get(t, []), data[offsets[t] : offsets[t + 1]], int(offsets[t]), earlier)
            out.append(found)
    return pa.array(out, _FOUND)


def _verified(windows: WindowSet, words, t: int, hits: list[tuple[int, int]], raw: np.ndarray, base: int, earlier: dict) -> dict:
    own, first = words.of(t), int(words.first[t])
    hit, items = np.zeros(len(own) + 2, dtype=bool), set(earlier["items"])
    points = np.cumsum(np.concatenate(([0], (raw & 0xC0) != 0x80)))  # code points before each byte
    start, end = (points[x[first : first + len(own)] - base] for x in (words.start, words.end))
    for span in earlier["spans"]:
        hit[1 + np.searchsorted(start, span["start"]) : 1 + np.searchsorted(start, span["end"])] = True
    for i, n in hits:
        known = windows.items.get(b" ".join(own[i : i + n]))
        if known is not None:
            hit[i + 1 : i + n + 1] = True
            items.update(known)
    edge = np.diff(hit.astype(np.int8))
    runs = zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)
    spans = [{"start": int(start[a]), "end": int(end[b - 1])} for a, b in runs]
    return {"n_hit": int(hit.sum()), "spans": spans, "items": sorted(x for x in items if x is not None)}


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, out: str = "contamination",
    window: int = WINDOW, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The columns `keep` of `docs` (all by default) and `out`: n_words, n_hit, spans (of code points), items (as strings)."""
    spark = docs.sparkSession
    windows = materialize(benchmark_windows(benchmark, window), "benchmark_windows")
    blocks = max(1, -(-windows.count() // block_rows))
    slot = F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks))
    keep = [c for c in (docs.columns if keep is None else keep) if c != out]
    text = unused("_text", [*keep, out])
    rows = docs.select(*keep, F.col("text").alias(text))
    for block in range(blocks):
        chosen = windows.where(slot == block).select("item_id", "n", "words").collect()
        shared = spark.sparkContext.broadcast([tuple(r) for r in chosen])
        last = block == blocks - 1
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop(out, *([text] if last else [])).schema)
        rows = rows.mapInArrow(_pass(shared, out, text, drop_text=last), f"{schema}, `{out}` {_FOUND_DDL}")
        if not last:
            rows = materialize(rows, "contamination")
    return rows


def _pass(shared, out: str, text: str, drop_text: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = WindowSet(shared.value)
        for batch in batches:
            names = batch.schema.names
            before = batch.column(out) if out in names else None
            found = _scan(windows, batch.column(text), before)
            rest = [n for n in names if n != out and not (drop_text and n == text)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), found], [*rest, out])

    return scan


def without_spans(text: Column, spans: Column, filler: str = "") -> Column:
    """`text` with `filler` for the given spans of code points, which are in order and apart."""
    ends = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(spans, lambda s: s["end"]))
    starts = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.char_length(text).cast("bigint")))
    pieces = F.zip_with(ends, starts, lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int")))
    return F.when(F.size(spans) > 0, F.array_join(pieces, filler)).otherwise(text)


def remove_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Documents without any hit word, unchanged."""
    out = unused("_contamination", docs.columns)
    found = find_contamination(docs, benchmark, out=out, window=window)
    return found.where(F.col(out)["n_hit"] == 0).select(*docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """All documents, their hit words and what lies between these taken out of the text."""
    out = unused("_contamination", docs.columns)
    found = find_contamination(docs, benchmark, out=out, window=window)
    cleaned = without_spans(F.col("text"), F.col(out)["spans"])
    return found.withColumn("text", cleaned).select(*docs.columns)
