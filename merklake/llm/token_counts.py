"""Token counts of whole texts, by rank-synchronous merging of pre-tokens held as ragged arrays.

All pre-tokens of a batch that the task hasn't counted yet lie in one array of symbols. In a round every sequence looks for
its lowest-rank pair, and all its occurrences are merged, in all sequences at once; sequences without a pair are done, and
the symbols that survive are counted. Counts of pre-tokens are kept in the task, the latest `_KNOWN` at least.

Null and empty texts have no tokens. Strings of special tokens inside a text count as one token each. An input column named
like the result is replaced, others may have any name. Repeated rows are counted each; empty tables give empty ones. Nothing is shuffled.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from merklake.llm.vocabulary import Vocabulary, load, pre_tokens
from merklake.llm.words import unused

_KNOWN = 250_000
_KEPT_LENGTH = 64  # longer pre-tokens are counted anew where they recur
_SYMBOLS = 1 << 20  # merged at once


def merge_all(sequences: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Symbols that survive, and where those of each sequence begin (one more for the end)."""
    sizes = np.fromiter(map(len, sequences), dtype=np.int64, count=len(sequences))
    symbols = vocab.byte_ids[np.frombuffer(b"".join(sequences), dtype=np.uint8)]
    owner = np.repeat(np.arange(len(sequences)), sizes)
    done_symbols, done_owner = [], []
    while len(symbols):
        at = np.where(owner[1:] == owner[:-1], vocab.find_pairs(symbols[:-1], symbols[1:]), -1)
        rank = np.where(at >= 0, vocab.pair_rank[at], len(vocab.pair_rank))
        lowest = np.full(len(sequences), len(vocab.pair_rank))
        np.minimum.at(lowest, owner[:-1], rank)
        open_ = lowest[owner] < len(vocab.pair_rank)
        done_symbols.append(symbols[~open_])
        done_owner.append(owner[~open_])
        merged = np.flatnonzero((rank == lowest[owner[:-1]]) & (at >= 0))
        # Of pairs that overlap (a a a), every second one from the left.
        fresh = np.diff(merged, prepend=-2) > 1
        run = np.maximum.accumulate(np.where(fresh, np.arange(len(merged)), 0))
        merged = merged[(np.arange(len(merged)) - run) % 2 == 0]
        symbols[merged] = vocab.pair_id[at[merged]]
        keep = open_.copy()
        keep[merged + 1] = False
        symbols, owner = symbols[keep], owner[keep]
    symbols, owner = np.concatenate(done_symbols or [symbols]), np.concatenate(done_owner or [owner])
    order = np.argsort(owner, kind="stable")
    return symbols[order], np.searchsorted(owner[order], np.arange(len(sequences) + 1))


class Cache:
    """What a task knows of pre-tokens: two generations, so that those which recur stay when the older one goes."""

    def __init__(self, limit: int):
        self.limit, self.new, self.old = limit, {}, {}

    def missing(self, words: set[str]) -> list[str]:
        """The words it doesn't know; those that it does are in `new` from now on."""
        if len(self.new) + len(words) > self.limit:
            self.old, self.new = self.new, {}
        words = words - self.new.keys()
        for w in words & self.old.keys():
            self.new[w] = self.old[w]
        return sorted(words - self.old.keys())


class Counter:
    def __init__(self, vocab: Vocabulary):
        self.vocab, self.cache = vocab, Cache(_KNOWN)

    def learn(self, words: set[str]) -> dict[str, int]:
        """Counts of words that aren't known yet; the shorter ones are kept, the others returned."""
        fresh = self.cache.missing(words)
        long, batch, size = {}, [], 0
        for i, word in enumerate(fresh):
            batch.append(word)
            size += len(word)
            if size >= _SYMBOLS or i == len(fresh) - 1:
                _, first = merge_all([w.encode() for w in batch], self.vocab)
                for w, n in zip(batch, np.diff(first).tolist(), strict=True):
                    (self.cache.new if len(w) <= _KEPT_LENGTH else long)[w] = n
                batch, size = [], 0
        return long

    def count(self, texts: list[str]) -> list[int]:
        parts = [self.vocab.parts(t) for t in texts]
        words = [[w for p in own if isinstance(p, str) for w in pre_tokens(p)] for own in parts]
        long = self.learn(set().union(*words))
        known = self.cache.new | long if long else self.cache.new
        return [sum(isinstance(p, int) for p in own) + sum(map(known.__getitem__, ws)) for own, ws in zip(parts, words, strict=True)]


def count_tokens(docs: DataFrame, path: str, keep: list[str] | None = None, out: str = "n_tokens") -> DataFrame:
    """The columns `keep` of `docs` (all by default) and `out`, the number of tokens of `text` under the vocabulary at `path`."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != out]
    text = unused("_text", [*keep, out])
    rows = docs.select(*keep, docs["text"].alias(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(load(path))
        for batch in batches:
            counts = [n for texts in text_lists(batch.column(text)) for n in counter.count(texts)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(counts, pa.int64())], [*keep, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop(text).schema)
    return rows.mapInArrow(run, f"{schema}, `{out}` bigint")


def text_lists(texts: pa.Array, limit: int = 1 << 20) -> Iterator[list[str]]:
    """Lists of consecutive texts of about `limit` characters; a null text is an empty one."""
    own, size = [], 0
    for text in texts:
        own.append(text.as_py() or "")
        size += len(own[-1])
        if size >= limit:
            yield own
            own, size = [], 0
    if own:
        yield own
