"""Source divergence audit: how far the word use of each source is from the other sources of its language, and on which terms.

Terms are counted per task and summed by (language, source, term). The kept terms of a language are dealt over chunks by
their hash, so that one chunk's counts of all sources fit a task. In a chunk the terms are bits: for each (source, count) a
bitmap holds the terms that occur so often there. The AND of two sources' bitmaps, with its population count, gives the number
of terms with that pair of counts, a joint cell; cells with a zero count come by complement. A cell counts times f of
its two counts, so the terms themselves are never compared pair by pair. Sums over chunks are the results, as every term is
in one chunk.

Shares p = 1 + floor(10^9 (count + 1) / (N + V)) are divided digit by digit in three steps of 1,000, so they are exact as long as N + V is under
9 * 10^15; f = floor((p - q)^2 / q) and its sum stay under (10^9 + V)^2.

Null text, language and source are read as ''. Repeated rows each count as a document of their own. A source without any kept term
still is one, and has a pair with each other source. A language without kept terms has pairs of value 0 and no terms. Equal values
are ordered by the item's UTF-8 bytes. Very long texts are handled whole. Empty tables give no rows; extra columns are not read.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from merklake.llm.words import find_words, text_slices
from merklake.sources.scratch import materialize

LEAST_DOCUMENTS = 3
TOP_TERMS = 200
CHUNK_ROWS = 200_000  # counts of a chunk, about
UNIT = 1_000_000_000
_SLICE = 4 << 20
_BLOCK = 1 << 21  # AND-ed words held at once

# After lower-casing: letters of ASCII and everything beyond ASCII.
LETTERS = np.ones(256, dtype=bool)
for _first, _last in ((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    LETTERS[_first : _last + 1] = False

_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
_FOUND = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Of each term in some texts: the text's number, and the term."""
    words = find_words(data, offsets, LETTERS)
    ends = np.concatenate(([0], np.cumsum(words.end - words.start))).astype(np.int64)
    letters = words.lowered[LETTERS[words.lowered]]
    each = pa.Array.from_buffers(pa.large_binary(), len(words.start), [None, pa.py_buffer(ends), pa.py_buffer(letters)])
    return np.repeat(np.arange(len(offsets) - 1), np.diff(words.first)), each.dictionary_encode()


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of each one's values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, dtype=np.int64)
    return keys[first], *(np.add.reduceat(v[order], first) if len(keys) else v for v in values)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms by language and source, added up within each slice of texts; one row without a term for every language and source."""
    for batch in batches:
        lang, source = (pc.fill_null(batch.column(k).cast(pa.string()), "").dictionary_encode() for k in (0, 1))
        width = max(1, len(source.dictionary))
        group = lang.indices.to_numpy().astype(np.int64) * width + source.indices.to_numpy()

        def rows(groups: np.ndarray, terms: pa.Array, n: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
            names = [lang.dictionary.take(pa.array(groups // width)), source.dictionary.take(pa.array(groups % width))]
            return pa.RecordBatch.from_arrays([*names, terms, pa.array(n), pa.array(docs)], schema=_COUNTS)

        present = np.unique(group)
        nothing = np.zeros(len(present), dtype=np.int64)
        yield rows(present, pa.array([""] * len(present)), nothing, nothing)
        for row, stop, data, offsets in text_slices(batch.column(2), _SLICE):
            text, terms = _terms(data, offsets)
            if not len(text):
                continue
            many = len(terms.dictionary)
            key, n = _summed(text * many + terms.indices.to_numpy(), np.ones(len(text), dtype=np.int64))
            key, n, docs = _summed(group[row:stop][key // many] * many + key % many, n, np.ones(len(key), dtype=np.int64))
            yield rows(key // many, terms.dictionary.take(pa.array(key % many)).cast(pa.string()), n, docs)


def term_counts(docs: DataFrame, unit: str = "lang", group: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it); a row with the term '' for each lang and source."""
    rows = docs.select(F.col(unit).cast("string"), F.col(group).cast("string"), "text")
    found = rows.mapInArrow(_count, "lang string, source string, term string, n bigint, docs bigint")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(counts: np.ndarray, total: int, kinds: int) -> np.ndarray:
    """1 + floor(UNIT (count + 1) / (total + kinds)), exactly."""
    below = np.int64(total + kinds)
    whole, rest = np.divmod(counts + 1, below)
    for _ in range(3):
        rest *= 1000
        whole = whole * 1000 + rest // below
        rest %= below
    return whole + 1


class Bitmaps:
    """The terms of a source in a chunk, by how often they occur: `bits` of 64 terms each at (count number, word), if any."""

    def __init__(self, terms: np.ndarray, counts: np.ndarray):
        self.counts, number = np.unique(counts, return_inverse=True)
        order = np.lexsort((terms, number))
        number, terms = number[order], terms[order]
        key = number * (1 << 40) + (terms >> 6)
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, dtype=np.int64)
        single = np.uint64(1) << (terms & 63).astype(np.uint64)
        self.number, self.word = number[first], terms[first] >> 6
        self.bits = np.bitwise_or.reduceat(single, first) if len(key) else single
        self.sizes = np.bincount(number, minlength=len(self.counts))

    def dense(self, words: int) -> np.ndarray:
        out = np.zeros((len(self.counts), words), dtype=np.uint64)
        out[self.number, self.word] = self.bits
        return out


def joint_cells(a: Bitmaps, b: Bitmaps, b_dense: np.ndarray, kinds: int) -> np.ndarray:
    """Number of terms by (count in a, count in b); row and column 0 are those of count zero."""
    cells = np.zeros((len(a.counts) + 1, len(b.counts) + 1), dtype=np.int64)
    step = max(1, _BLOCK // max(1, len(b.counts)))
    for at in range(0, len(a.bits) if len(b.counts) else 0, step):
        both = np.bitwise_count(a.bits[at : at + step, None] & b_dense[:, a.word[at : at + step]].T)
        np.add.at(cells[1:, 1:], a.number[at : at + step], both)
    cells[1:, 0] = a.sizes - cells[1:, 1:].sum(axis=1)
    cells[0, 1:] = b.sizes - cells[1:, 1:].sum(axis=0)
    cells[0, 0] = kinds - cells.sum()
    return cells


def _audit_chunk(table: pa.Table) -> pa.Table:
    """Partial sums of all pairs of sources over a chunk's terms, and each source's leading terms of the chunk."""
    lang = table.column("lang")[0].as_py()
    named = pc.is_null(table.column("term"))
    registry, rows = table.filter(named), table.filter(pc.invert(named))
    sources = registry.column("source").combine_chunks()
    totals = registry.column("total").to_numpy()
    kinds = int(registry.column("kinds")[0].as_py())
    out: list[tuple[str, str, str, int]] = []
    if kinds == 0:
        names = sources.to_pylist()
        out = [(a, "pair", b, 0) for a in names for b in names if a != b]
        return _rows(lang, out)

    terms = rows.column("term").combine_chunks().dictionary_encode()
    owner = pc.index_in(rows.column("source").combine_chunks(), value_set=sources).to_numpy(zero_copy_only=False)
    code, n, many = terms.indices.to_numpy().astype(np.int64), rows.column("n").to_numpy(), len(terms.dictionary)
    overall = np.zeros(many, dtype=np.int64)
    np.add.at(overall, code, n)
    # Frequent terms share words of bits, so that a count's bitmap has few of them.
    place = np.empty(many, dtype=np.int64)
    place[np.argsort(-overall, kind="stable")] = np.arange(many)
    alphabet = np.empty(many, dtype=np.int64)
    alphabet[pc.sort_indices(terms.dictionary.cast(pa.binary())).to_numpy()] = np.arange(many)
    q_all = shares(overall, int(totals.sum()), kinds)

    order = np.argsort(owner, kind="stable")
    edges = np.searchsorted(owner[order], np.arange(len(sources) + 1))
    maps: list[Bitmaps] = []
    for s, name in enumerate(sources.to_pylist()):
        own = order[edges[s] : edges[s + 1]]
        maps.append(Bitmaps(place[code[own]], n[own]))
        p, q = shares(n[own], int(totals[s]), kinds), q_all[code[own]]
        over = np.flatnonzero(p > q)
        value = (p[over] - q[over]) ** 2 // q[over]
        first = np.lexsort((alphabet[code[own][over]], -value))[:TOP_TERMS]
        leading = terms.dictionary.take(pa.array(code[own][over][first])).to_pylist()
        out += [(name, "term", item, v) for item, v in zip(leading, value[first].tolist(), strict=True)]

    zero = np.zeros(1, dtype=np.int64)
    p_of = [shares(np.concatenate((zero, m.counts)), int(t), kinds) for m, t in zip(maps, totals, strict=True)]
    names = sources.to_pylist()
    for b in range(len(maps)):
        dense = maps[b].dense((many + 63) >> 6)
        for a in range(b):
            cells = joint_cells(maps[a], maps[b], dense, many)
            at_a, at_b = np.nonzero(cells)
            met, p, q = cells[at_a, at_b], p_of[a][at_a], p_of[b][at_b]
            out.append((names[a], "pair", names[b], int((met * ((p - q) ** 2 // q)).sum())))
            out.append((names[b], "pair", names[a], int((met * ((p - q) ** 2 // p)).sum())))
    return _rows(lang, out)


def _rows(lang: str, rows: list[tuple[str, str, str, int]]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
    arrays = [pa.array([lang] * len(rows), pa.string()), *(pa.array(c, f.type) for c, f in zip(columns, list(_FOUND)[1:], strict=True))]
    return pa.Table.from_arrays(arrays, schema=_FOUND)


def audit(
    docs: DataFrame, unit: str = "lang", group: str = "source", least_documents: int = LEAST_DOCUMENTS, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """lang, source, part, item, value, rank: `pair` rows for each other source of the language, and at most TOP_TERMS `term` rows."""
    same_term = Window.partitionBy("lang", "term")
    flagged = term_counts(docs, unit, group).select(
        "lang", "source", "term", "n", F.sum("docs").over(same_term).alias("in_docs"),
        (F.row_number().over(same_term.orderBy("source")) == 1).cast("bigint").alias("first"),
    )
    kept = flagged.where((F.col("in_docs") >= least_documents) | (F.col("term") == "")).drop("in_docs")
    kept = materialize(kept, "term_counts")
    terms = kept.where("term != ''")
    chunks = max(1, -(-terms.count() // chunk_rows))

    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("term") != "", F.col("first"))).alias("own"))
    langs = groups.groupBy("lang").agg(F.coalesce(F.sum("own"), F.lit(0)).alias("kinds"))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(chunks - 1).cast("bigint"))).alias("chunk")
    registry = groups.join(langs, "lang").select("lang", "source", "total", "kinds", every, F.lit(None).cast("string").alias("term"), F.lit(0).cast("bigint").alias("n"))
    dealt = terms.select(
        "lang", "source", *[F.lit(None).cast("bigint").alias(c) for c in ("total", "kinds")],
        F.pmod(F.xxhash64("term"), F.lit(chunks)).alias("chunk"), "term", "n",
    )
    kind = "lang string, source string, part string, item string, value bigint"
    partial = materialize(registry.unionByName(dealt).groupBy("lang", "chunk").applyInArrow(_audit_chunk, kind), "divergence")

    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    pairs = partial.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    leading = partial.where("part = 'term'").withColumn("rank", place).where(F.col("rank") <= TOP_TERMS)
    return pairs.withColumn("rank", place).unionByName(leading)
