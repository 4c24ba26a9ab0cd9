"""BPE encoding by speculation, and decoding.

Greedy longest match proposes the tokens of every pre-token. A sequence of tokens is what the merges give exactly when each
adjacent pair of tokens is what the merges give for the pair's bytes; that is tested for all pairs of a batch at once, by
walking down both tokens' merges at the edge where they meet. Only pre-tokens with a pair that fails are merged exactly.

Null and empty texts have no tokens. Strings of special tokens inside a text become these tokens. Decoding joins the tokens'
bytes and writes U+FFFD for what isn't UTF-8; an unknown id or a null is left out; null ids decode to an empty text. An input
column named like the result is replaced, others may have any name. Repeated rows are encoded each; empty tables give empty ones. Nothing is shuffled.
"""

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from merklake.llm.token_counts import Cache, merge_all, text_lists
from merklake.llm.vocabulary import Vocabulary, load, pre_tokens
from merklake.llm.words import unused

_KNOWN = 100_000
_KEPT_LENGTH = 64
_TOKENS = 1 << 18  # decoded at once


class LongestMatch:
    """Greedy longest match of many words in step, by a walk down the tree of the vocabulary's tokens."""

    def __init__(self, ids: dict[bytes, int]):
        nodes, edges = {b"": 0}, []
        for token in ids:
            for n in range(1, len(token) + 1):
                if token[:n] not in nodes:
                    nodes[token[:n]] = len(nodes)
                    edges.append((nodes[token[: n - 1]] << 8 | token[n - 1], nodes[token[:n]]))
        self.keys, self.child = np.array(sorted(edges), dtype=np.int64).T.copy()
        self.id = np.full(len(nodes), -1, dtype=np.int64)
        for token, i in ids.items():
            self.id[nodes[token]] = i

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words, and which word each belongs to."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        data = np.frombuffer(b"".join(words) + b"\0", dtype=np.uint8).astype(np.int64)
        end = np.cumsum(sizes)
        word = np.flatnonzero(sizes)
        at, stop = (end - sizes)[word], end[word]
        node, found, found_end = np.zeros(len(word), dtype=np.int64), np.full(len(word), -1), at.copy()
        tokens, owners = [], []
        while len(word):
            keys = node << 8 | data[at]
            slot = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            goes = (self.keys[slot] == keys) & (at < stop)
            node = np.where(goes, self.child[slot], 0)
            at = at + goes
            token = np.where(goes, self.id[node], -1)
            found, found_end = np.where(token >= 0, token, found), np.where(token >= 0, at, found_end)
            # Where the walk ends, the longest token met is taken, and the walk begins anew behind it.
            tokens.append(found[~goes])
            owners.append(word[~goes])
            at = np.where(goes, at, found_end)
            on = goes | (at < stop)
            word, at, stop, node, found, found_end = (x[on] for x in (word, at, stop, node, found, found_end))
        tokens, owners = np.concatenate(tokens or [word]), np.concatenate(owners or [word])
        order = np.argsort(owners, kind="stable")
        return tokens[order], owners[order]


def compatible(vocab: Vocabulary, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the merges leave each pair of tokens as it is.

    Both tokens are taken apart at the edge where they meet, always the one made last. Were the two parts there a pair that
    merges before the part's own merge took place, the merges would have joined them instead.
    """
    out = np.ones(len(a), dtype=bool)
    live, x, y = np.arange(len(a)), a.astype(np.int64), b.astype(np.int64)
    # What each side is about to become: a merge across the edge wins if it comes before both, on a tie the left one first.
    x_next, y_next = (np.full(len(a), len(vocab.pair_rank)) for _ in range(2))
    while len(live):
        at = vocab.find_pairs(x, y)
        rank = np.where(at >= 0, vocab.pair_rank[at], len(vocab.pair_rank))
        joins = (at >= 0) & (rank < x_next) & (rank <= y_next)
        out[live[joins]] = False
        x_rank, y_rank = vocab.rank[x], vocab.rank[y]
        go = ~joins & ((x_rank >= 0) | (y_rank >= 0))
        live, x, y, x_next, y_next, x_rank, y_rank = (v[go] for v in (live, x, y, x_next, y_next, x_rank, y_rank))
        # The part made last comes apart first; equal ranks are equal tokens, of which the right one was made last.
        x_last = x_rank > y_rank
        x_next, y_next = np.where(x_last, x_rank, x_next), np.where(x_last, y_next, y_rank)
        x, y = np.where(x_last, vocab.right[x], x), np.where(x_last, y, vocab.left[y])
    return out


def merge_exactly(word: bytes, vocab: Vocabulary) -> list[int]:
    """The merges one by one, lowest rank first and leftmost of equals; a queue keeps long words in n log n."""
    token = [int(vocab.byte_ids[b]) for b in word]
    after, before = [*range(1, len(token)), -1], [-1, *range(len(token) - 1)]
    pairs = _pair_table(vocab)
    queue = [(*pairs[p], i, p) for i, p in enumerate(zip(token, token[1:], strict=False)) if p in pairs]
    heapq.heapify(queue)
    while queue:
        _, made, i, pair = heapq.heappop(queue)
        j = after[i]
        if token[i] < 0 or j < 0 or (token[i], token[j]) != pair:
            continue
        token[i], token[j], after[i] = made, -1, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for k in (before[i], i):
            if k >= 0 and after[k] >= 0 and (p := (token[k], token[after[k]])) in pairs:
                heapq.heappush(queue, (*pairs[p], k, p))
    return [t for t in token if t >= 0]


_TABLES: dict[int, dict[tuple[int, int], tuple[int, int]]] = {}


def _pair_table(vocab: Vocabulary) -> dict[tuple[int, int], tuple[int, int]]:
    if id(vocab) not in _TABLES:
        a, b = np.divmod(vocab.pair_keys, vocab.size)
        _TABLES[id(vocab)] = dict(zip(zip(a.tolist(), b.tolist(), strict=True), zip(vocab.pair_rank.tolist(), vocab.pair_id.tolist(), strict=True), strict=True))
    return _TABLES[id(vocab)]


class Encoder:
    def __init__(self, vocab: Vocabulary):
        self.vocab, self.cache, self.match = vocab, Cache(_KNOWN), LongestMatch(vocab.ids)

    def tokens(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words, and where those of each begin (one more for the end)."""
        flat, owner = self.match.propose(words)
        inside = owner[1:] == owner[:-1]
        fits = compatible(self.vocab, flat[:-1][inside], flat[1:][inside])
        wrong = np.zeros(len(words), dtype=bool)
        wrong[owner[:-1][inside][~fits]] = True
        again = np.flatnonzero(wrong).tolist()
        short = [i for i in again if len(words[i]) <= _KEPT_LENGTH]
        merged, first = merge_all([words[i] for i in short], self.vocab)
        parts, owners = [flat[~wrong[owner]], merged], [owner[~wrong[owner]], np.repeat(np.array(short, dtype=np.int64), np.diff(first))]
        for i in again:
            if len(words[i]) > _KEPT_LENGTH:
                parts.append(np.array(merge_exactly(words[i], self.vocab), dtype=np.int64))
                owners.append(np.full(len(parts[-1]), i))
        flat, owner = np.concatenate(parts), np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        return flat[order], np.searchsorted(owner[order], np.arange(len(words) + 1))

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Tokens (as 32-bit numbers) of words that aren't known yet; the shorter ones are kept, the others returned."""
        fresh, long = self.cache.missing(words), {}
        flat, first = self.tokens([w.encode() for w in fresh])
        raw, edges = flat.astype(np.int32).tobytes(), (4 * first).tolist()
        for w, a, b in zip(fresh, edges[:-1], edges[1:], strict=True):
            (self.cache.new if len(w) <= _KEPT_LENGTH else long)[w] = raw[a:b]
        return long

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        parts = [self.vocab.parts(t) for t in texts]
        words = [[w for p in own for w in ((p,) if isinstance(p, int) else pre_tokens(p))] for own in parts]
        long = self.learn({w for w in set().union(*words) if isinstance(w, str)})
        special = {i: i.to_bytes(4, "little") for i in self.vocab.special.values()}
        known = self.cache.new | long | special if long or any(isinstance(p, int) for own in parts for p in own) else self.cache.new
        return [np.frombuffer(b"".join(map(known.__getitem__, own)), dtype=np.int32) for own in words]


def _rows(df: DataFrame, run, keep: list[str], out: str, kind: str) -> DataFrame:
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    return df.mapInArrow(run, f"{schema}{', ' * bool(keep)}`{out}` {kind}")


def encode(docs: DataFrame, path: str, keep: list[str] | None = None, out: str = "ids") -> DataFrame:
    """The columns `keep` of `docs` (all by default) and `out`, the token ids of `text` under the vocabulary at `path`."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != out]
    text = unused("_text", [*keep, out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(load(path))
        for batch in batches:
            at = 0
            for texts in text_lists(batch.column(text)):
                ids = encoder.encode(texts)
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([*(batch.column(n).slice(at, len(texts)) for n in keep), lists], [*keep, out])
                at += len(texts)

    return _rows(docs.select(*keep, docs["text"].alias(text)), run, keep, out, "array<int>")


def decode(rows: DataFrame, path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """All columns and `out`, the text of the token ids in `ids`."""
    keep = [c for c in rows.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = np.array([t or b"" for t in load(path).tokens] + [b""], dtype=object)
        sizes = np.fromiter(map(len, tokens), dtype=np.int64)
        for batch in batches:
            sizes_of = batch.column("_ids").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            group = np.cumsum(sizes_of) // _TOKENS
            cuts = np.unique(np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [batch.num_rows]))).tolist()
            for first, stop in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(first, stop - first)
                flat = part.column("_ids").flatten().fill_null(-1).to_numpy(zero_copy_only=False)
                flat = np.where((flat >= 0) & (flat < len(tokens) - 1), flat, len(tokens) - 1)
                ends = np.cumsum(np.concatenate(([0], sizes_of[first:stop])))
                edges = np.concatenate(([0], np.cumsum(sizes[flat])))[ends].tolist()
                raw = b"".join(tokens[flat].tolist())
                texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(edges[:-1], edges[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in keep), pa.array(texts, pa.string())], [*keep, out])

    return _rows(rows.select(*keep, rows[ids].alias("_ids")), run, keep, out, "string")
