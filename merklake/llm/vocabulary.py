"""Byte-level BPE vocabularies (tokenizers JSON files) as arrays, and the split of texts into pre-tokens.

A file's path is a parameter and must be readable on every executor; each worker process reads it once.
"""

import json
import re
import unicodedata
from dataclasses import dataclass
from functools import cache

import numpy as np
import regex

# White space as Unicode defines it, and the published pattern of byte-level pre-tokens.
_SPACE = r"\t\n\x0B\f\r\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?{other}+|[{space}]+(?![^{space}])|[{space}]+"
# Letters and numbers of Unicode 17, which the tokenizers library (Unicode 16) takes for neither.
_NEWER = """
0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959
10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3
16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6
1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4
1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F
"""


def _byte_letters() -> dict[str, int]:
    """The letter by which the file writes each byte: itself where printable, else the next one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(rest)}


@dataclass
class Vocabulary:
    tokens: list[bytes | None]  # by id
    ids: dict[bytes, int]
    byte_ids: np.ndarray  # id of each single byte
    pair_keys: np.ndarray  # left id * size + right id of every merge, sorted
    pair_rank: np.ndarray
    pair_id: np.ndarray  # what the pair becomes
    left: np.ndarray  # parts of a merged token by id; -1 for a single byte
    right: np.ndarray
    rank: np.ndarray  # of the merge that makes a token; -1 for a single byte
    special: dict[str, int]

    @property
    def size(self) -> int:
        return len(self.tokens)

    def find_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Position of each pair among the merges, or -1."""
        keys = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, at, -1)

    def parts(self, text: str) -> list[str | int]:
        """Stretches of ordinary text and the ids of special tokens between them."""
        if not any(s in text for s in self.special):
            return [text] if text else []
        found = regex.split("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")", text)
        return [self.special.get(x, x) for x in found if x]


@cache
def load(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    letters = _byte_letters()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    size = 1 + max([*spec["model"]["vocab"].values(), *special.values()])
    tokens: list[bytes | None] = [None] * size
    ids = {}
    for word, i in spec["model"]["vocab"].items():
        if word not in special:
            tokens[i] = bytes(letters[c] for c in word)
            ids[tokens[i]] = i
    for word, i in special.items():
        tokens[i] = word.encode()
    left, right, rank = (np.full(size, -1, dtype=np.int64) for _ in range(3))
    pairs = []
    for r, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]):
        x, y, z = (spec["model"]["vocab"][w] for w in (a, b, a + b))
        pairs.append((x * size + y, r, z))
        if rank[z] < 0:
            left[z], right[z], rank[z] = x, y, r
    keys, ranks, made = np.array(sorted(pairs), dtype=np.int64).T
    singles = np.array([ids[bytes([b])] for b in range(256)], dtype=np.int64)
    return Vocabulary(tokens, ids, singles, keys.copy(), ranks.copy(), made.copy(), left, right, rank, special)


@cache
def _patterns() -> tuple["re.Pattern", "regex.Pattern"]:
    """For texts of code points under 256, where classes are short lists, and for all others."""
    narrow = {k: "".join(re.escape(chr(c)) for c in range(256) if unicodedata.category(chr(c))[0] == k) for k in "LN"}
    space = r"\t-\r\x20\x85\xA0"
    classes = {"letter": f"[{narrow['L']}]", "number": f"[{narrow['N']}]", "other": f"[^{space}{narrow['L']}{narrow['N']}]"}
    newer = "".join("-".join(rf"\U{int(x, 16):08X}" for x in r.split("-")) for r in _NEWER.split())
    wide = {"letter": rf"[\p{{L}}--[{newer}]]", "number": rf"[\p{{N}}--[{newer}]]", "other": rf"[[^{_SPACE}\p{{L}}\p{{N}}]||[{newer}]]"}
    return re.compile(_PATTERN.format(space=space, **classes)), regex.compile(_PATTERN.format(space=_SPACE, **wide), regex.VERSION1)


def pre_tokens(text: str) -> list[str]:
    narrow, wide = _patterns()
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return wide.findall(text)
    return narrow.findall(text)
