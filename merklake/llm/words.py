"""Words of whole texts as numpy arrays, many texts at a time, over their UTF-8 bytes.

Every separator is ASCII, so a byte of 0x80 or more always belongs to a word. A word is known by a 64-bit
polynomial hash; callers that need more than equality of hashes read the bytes between `start` and `end`.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20  # texts are handled this many bytes at a time; a longer text is a slice of its own

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BASE = 0x9E3779B97F4A7C15
_MIX = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _table(separators: list[tuple[int, int]]) -> np.ndarray:
    out = np.ones(256, dtype=bool)
    for first, last in separators:
        out[first : last + 1] = False
    return out


# After lower-casing: letters and digits of ASCII and everything beyond ASCII.
ALPHANUMERIC = _table([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
# Everything between ASCII white space.
SPACED = _table([(0x20, 0x20), (0x09, 0x0D)])


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, _BASE, dtype=np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def mixed(values: np.ndarray) -> np.ndarray:
    """Bits of 64-bit hashes spread, so that any of them can choose a slot."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


@dataclass
class Words:
    """Words of some texts: word i lies at lowered[start[i]:end[i]]; text t has the words first[t] to first[t + 1]."""

    lowered: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    def of(self, text: int) -> list[bytes]:
        lo, hi = self.first[text], self.first[text + 1]
        if lo == hi:
            return []
        base = self.start[lo]
        raw = self.lowered[base : self.end[hi - 1]].tobytes()
        return [raw[a:b] for a, b in zip((self.start[lo:hi] - base).tolist(), (self.end[lo:hi] - base).tolist(), strict=True)]


def find_words(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray) -> Words:
    """data: the texts' bytes, one after another; offsets: where each begins, and the end of the last."""
    lowered = _LOWER[data]
    inside = word_bytes[lowered]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    filled = offsets[:-1] < offsets[1:]
    at, last = offsets[:-1][filled], offsets[1:][filled] - 1
    begins[at], ends[last] = inside[at], inside[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    size = 1 << max(12, int(len(data)).bit_length())
    up, down = _powers(size)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_MIX[lowered] * up[: len(data)], out=sums[1:])
    hashes = mixed((sums[end] - sums[start]) * down[start])
    return Words(lowered, start, end, np.searchsorted(start, offsets), hashes)


def ngram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words, by its first word; across texts too, which callers leave out."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(count, dtype=np.uint64)
    for i in range(n):
        out = (out + hashes[i : i + count]) * np.uint64(_BASE)
    return mixed(out)


def unused(name: str, taken: list[str]) -> str:
    """A column name that is not among those taken, whatever their case."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name = "_" + name
    return name


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row past the last, bytes, offsets) of consecutive texts; a null text is an empty one."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, ends, values = texts.buffers()
    offsets = np.frombuffer(ends, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(values, dtype=np.uint8) if values is not None else np.empty(0, dtype=np.uint8)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        stop = min(stop, len(texts))
        yield row, stop, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop
