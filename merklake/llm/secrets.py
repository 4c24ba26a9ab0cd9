"""Secrets in whole texts: keyword prefilter, anchored patterns near its hits, then checks.

An Aho-Corasick automaton finds the keywords of all kinds in one walk over a text; a kind's pattern is tried only where one of
its keywords begins. Long runs of hexadecimal digits have no keyword and are found as runs over the bytes of many texts.
Kinds, in order: assign, access, hex, and those the checksum in the secret itself confirms: github and npm (six base-62 digits
of the CRC-32 of the thirty before them), jwt (the header is a JSON object with "alg"), card (13 to 19 digits that pass Luhn's test).

Matches of a kind are the leftmost that do not overlap; those of different kinds may. Spans are of code points, end exclusive.
A card of whole groups of digits may follow others: where the
longest candidate from one group fails the test, the next group is tried. Null and empty texts have none; empty tables give empty ones, and
repeated rows are scanned each. Very long texts are handled whole, in time that grows with their length. An input column named like
the result is replaced; others may have any name. Nothing is shuffled.
"""

import base64
import json
import re
import zlib
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merklake.llm.decontaminate import without_spans
from merklake.llm.words import text_slices, unused

KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "card")
BASE_KINDS = KINDS[:3]
HEX_RUN = 24
FILLER = "[SECRET]"

_ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_TOKEN = re.compile(rb"(?:gh[pousr]|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
_JWT = re.compile(rb"eyJ([A-Za-z0-9_-]+)\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]{16,}")
_JWT_RUN = re.compile(rb"[A-Za-z0-9_-]+")
_GROUP = re.compile(rb"[0-9]+")
_CARD = re.compile(rb"[0-9](?:[ -]?[0-9]){12,18}(?![0-9])")
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
# Keywords as they are in lower-cased text, and the kind each may begin.
_KEYWORDS = {
    **dict.fromkeys(("password", "passwd", "secret", "token", "apikey", "api_key"), "assign"),
    "akia": "access",
    **dict.fromkeys(("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "github"),
    "npm_": "npm",
    "eyj": "jwt",
}

_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_SPANS_DDL = "array<struct<kind:string,start:bigint,end:bigint>>"


def _checksum_holds(match: re.Match) -> bool:
    value, digits = zlib.crc32(match[1]), ""
    while value:
        value, d = divmod(value, 62)
        digits = _BASE62[d] + digits
    return digits.rjust(6, "0").encode() == match[2]


def _is_header(match: re.Match) -> bool:
    raw = b"eyJ" + match[1]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(raw + b"=" * (-len(raw) % 4)))
    except (ValueError, TypeError, RecursionError):  # the last for headers nested beyond all sense
        return False


def _luhn(match: re.Match) -> bool:
    digits = [c - 48 for c in match[0] if 48 <= c <= 57]
    doubled = [d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
    return len(set(digits)) > 1 and sum(doubled) % 10 == 0


_CHECKS = {
    "assign": (_ASSIGN, lambda m: len(m[1]) >= 6),
    "access": (_ACCESS, lambda m: len(m[0]) >= 20),
    "github": (_TOKEN, _checksum_holds),
    "npm": (_TOKEN, _checksum_holds),
    "jwt": (_JWT, _is_header),
    "card": (_CARD, _luhn),
}


@cache
def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for word, kind in _KEYWORDS.items():
        out.add_word(word, (kind, len(word)))
    out.make_automaton()
    return out


def _runs(inside: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of stretches of at least `least` bytes that don't cross texts."""
    change = np.diff(inside.astype(np.int8), prepend=0, append=0)
    edges = np.unique(np.concatenate((np.flatnonzero(change), offsets)))
    start, end = edges[:-1], edges[1:]
    keep = (end - start >= least) & inside[np.minimum(start, len(inside) - 1)] if len(inside) else np.zeros(len(start), dtype=bool)
    return start[keep], end[keep]


_HEX = np.zeros(256, dtype=bool)
_HEX[[*b"0123456789abcdef"]] = True
_DIGITS = np.zeros(256, dtype=bool)
_DIGITS[[*b"0123456789 -"]] = True


def _by_keywords(raw: bytes) -> list[tuple[int, int, str]]:
    found, passed = [], dict.fromkeys(KINDS, 0)
    for last, (kind, size) in _automaton().iter(raw.lower().decode("latin-1")):
        at = last - size + 1
        pattern, holds = _CHECKS[kind]
        if at >= passed[kind] and (match := pattern.match(raw, at)):
            passed[kind] = match.end()  # what fails the check is passed over too
            if holds(match):
                found.append((at, match.end(), kind))
        elif kind == "jwt" and at >= passed[kind] and raw.startswith(b"eyJ", at):
            passed[kind] = _JWT_RUN.match(raw, at).end()  # what follows the run fails every header that begins in it
    return found


def _cards(raw: bytes) -> list[tuple[int, int, str]]:
    found, at = [], 0
    while match := _CARD.search(raw, at):
        if (match.start() == 0 or not 48 <= raw[match.start() - 1] <= 57) and _luhn(match):
            found.append((match.start(), match.end(), "card"))
            at = match.end()
        else:
            at = _GROUP.match(raw, match.start()).end()
    return found


def find_spans(data: np.ndarray, offsets: np.ndarray) -> list[list[dict]]:
    """Spans of each text, by start and then by kind. data, offsets: as for words."""
    texts = len(offsets) - 1
    found: list[list[tuple[int, int, str]]] = [[] for _ in range(texts)]
    for start, end in zip(*_runs(_HEX[data], offsets, HEX_RUN), strict=True):
        t = int(np.searchsorted(offsets, start, side="right")) - 1
        found[t].append((int(start - offsets[t]), int(end - offsets[t]), "hex"))
    for start, end in zip(*_runs(_DIGITS[data], offsets, 13), strict=True):
        t, base = int(np.searchsorted(offsets, start, side="right")) - 1, int(start)
        cards = _cards(data[base:end].tobytes())
        found[t] += [(a + base - int(offsets[t]), b + base - int(offsets[t]), kind) for a, b, kind in cards]
    out = []
    for t in range(texts):
        own = data[offsets[t] : offsets[t + 1]]
        spans = found[t] + _by_keywords(own.tobytes())
        if spans:
            points = np.cumsum(np.concatenate(([0], (own & 0xC0) != 0x80)))
            spans = sorted((int(points[a]), KINDS.index(kind), int(points[b])) for a, b, kind in spans)
        out.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans])
    return out


def find_secrets(docs: DataFrame, keep: list[str] | None = None, out: str = "secrets") -> DataFrame:
    """The columns `keep` of `docs` (all by default) and `out`: kind, start and end of every secret in `text`."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != out]
    text = unused("_text", [*keep, out])
    rows = docs.select(*keep, docs["text"].alias(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [s for _, _, data, offsets in text_slices(batch.column(text)) for s in find_spans(data, offsets)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(spans, _SPANS)], [*keep, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop(text).schema)
    return rows.mapInArrow(run, f"{schema}, `{out}` {_SPANS_DDL}")


def redact(docs: DataFrame, filler: str = FILLER) -> DataFrame:
    """All documents, each stretch of secrets in the text replaced by `filler`. Columns are as given."""
    secrets, joined = unused("_secrets", docs.columns), unused("_stretches", docs.columns)
    found = find_secrets(docs, out=secrets)
    # Spans that overlap or touch become one: each begins a stretch only if it lies past all before it.
    stretches = F.aggregate(
        secrets,
        F.array().cast("array<struct<start:bigint,end:bigint>>"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= s["start"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(done, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))),
    )
    found = found.withColumn(joined, F.when(F.size(secrets) > 0, stretches).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>")))
    return found.withColumn("text", without_spans(F.col("text"), F.col(joined), filler)).select(*docs.columns)
