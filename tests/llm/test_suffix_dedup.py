import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from merklake.llm import queries, suffix_dedup
from merklake.llm.suffix_dedup import Samples, remove_repeats


def brute(pairs, span):
    seen: dict[bytes, int] = {}
    for doc, text in sorted((p for p in pairs if p[0] is not None), key=lambda p: p[0]):
        raw = (text or "").encode()
        for i in range(len(raw) - span + 1):
            seen.setdefault(raw[i : i + span], doc)
    out = []
    for doc, text in pairs:
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for i in range(len(raw) - span + 1):
            if doc is not None and seen[raw[i : i + span]] < doc:
                gone[i : i + span] = [True] * span
        spans = [i for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1])]
        out.append((doc, sum(gone), len(spans), bytes(b for b, g in zip(raw, gone, strict=True) if not g)))
    return sorted(out, key=str)


def shown(df):
    return sorted(((r.doc_id, sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in df.collect()), key=str)


def corpus():
    rng = random.Random(6)
    words = [w + v for w in "the of and über größe năm".split() for v in ("", "s", "ing", "日本")]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 120))) for _ in range(30)]
    for _ in range(40):
        a, b = rng.choice(texts), rng.choice(texts)
        cut = rng.randrange(len(a) + 1)
        texts.append(rng.choice([a, a[:cut] + b, a[cut:], a + a, a[:cut] + "X" + a[cut:], b[:60] + a[-60:]]))
    texts += ["a" * 300, "a" * 49, "a" * 50, "a" * 51, "ab" * 90, "", "x" * 120_000, "x" * 200]
    rng.shuffle(texts)
    return [*enumerate(texts), (7, texts[3]), (7, texts[7]), (200, None), (None, texts[0]), (None, None), (201, texts[5])]


@pytest.mark.parametrize("span,sample,group_rows", [(50, 24, 100_000), (50, 24, 1), (20, 6, 2)])
def test_against_brute_force(spark, documents, span, sample, group_rows):
    pairs = corpus()
    got = remove_repeats(documents(pairs).withColumnRenamed("lang", "spans"), span, sample, group_rows)
    assert shown(got) == brute(pairs, span)


def test_pieces(spark, documents, monkeypatch):
    from merklake.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "_PIECE", 64)
    pairs = [p for p in corpus() if p[1] is None or len(p[1]) < 5000]
    for pair in pairs[:5]:
        raw = (pair[1] or "").encode()
        import numpy as np

        whole = suffix_dedup.Samples(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]), 50, 24)
        windows = [w for a, b in zip(whole.first.tolist(), whole.last.tolist(), strict=True) for w in range(a, b + 1)]
        assert windows == list(range(max(0, len(raw) - 49)))


def test_empty(spark, documents):
    assert remove_repeats(documents([])).count() == 0


def test_query(spark, sf_dir):
    pairs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    sizes = {d: len(t.encode()) for d, t in pairs}
    truth = [(d, sizes[d], n, s, hashlib.sha256(k).hexdigest()) for d, n, s, k in brute(pairs, 50)]
    got = queries.op6_suffix_dedup(spark, sf_dir).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(truth)


def test_windows_are_found_by_text(monkeypatch):
    """Samples cover the windows of each text and no other, also past the end of a piece, without a search for each byte."""
    rng = random.Random(9)
    texts = ["", "x" * 49, "x" * 50, "", *("".join(rng.choice("abcd") for _ in range(rng.randrange(200))) for _ in range(60)), "y" * 700, "", "z" * 10]
    data, offsets = np.frombuffer("".join(texts).encode(), dtype=np.uint8), np.cumsum([0, *map(len, texts)])
    monkeypatch.setattr(suffix_dedup, "_PIECE", 256)
    searched, search = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *args, **more: searched.append(np.size(v)) or search(a, v, *args, **more))
    found = Samples(data, offsets, 50, 20)
    covered = sorted(w for a, b in zip(found.first.tolist(), found.last.tolist(), strict=True) for w in range(a, b + 1))
    assert covered == [int(o) + w for t, o in zip(texts, offsets) for w in range(len(t) - 49)]
    assert [int(search(offsets, f, side="right")) - 1 for f in found.first] == found.text.tolist()
    assert max(searched) < len(data) / 5 and sum(searched) < len(data) / 2


@pytest.mark.parametrize("span,sample", [(50, 20), (20, 6), (9, 8), (6, 3)])
def test_hashes_tell_strings_and_contexts_apart(span, sample, monkeypatch):
    """Hashes are equal where the bytes are, and no byte is hashed of which no sample tells."""
    rng = random.Random(span)
    texts = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(400))) for _ in range(40)]
    texts += [t[: rng.randrange(len(t) + 1)] + t for t in texts]
    data, offsets = np.frombuffer("".join(texts).encode(), dtype=np.uint8), np.cumsum([0, *map(len, texts)])
    hashed, mix = [], suffix_dedup.mixed
    monkeypatch.setattr(suffix_dedup, "mixed", lambda values: hashed.append(len(values)) or mix(values))
    found = Samples(data, offsets, span, sample)
    assert max(hashed) == len(found.first) < len(data)
    raw = data.tobytes()
    contexts = [raw[a : b + span] for a, b in zip(found.first.tolist(), found.last.tolist(), strict=True)]
    everything = found.contexts(np.arange(len(found.first)))
    assert len(set(contexts)) == len(set(everything.tolist())) == len(set(zip(contexts, everything.tolist(), strict=True)))
    # The string lies in all windows of its context, at one place.
    by_string: dict[int, list[bytes]] = {}
    for string, context in zip(found.string.tolist(), contexts, strict=True):
        by_string.setdefault(string, []).append(context)
    for several in by_string.values():
        assert any(all(several[0][i : i + sample] in c for c in several) for i in range(len(several[0]) - sample + 1))


def test_cut_keeps_texts_apart():
    """A run up to the end of a text and one at the start of the next are two, also with empty texts and rows without runs between."""
    texts, runs = ["abcdef", "", "ghij", None, "klm"], [[(4 << 32) + 2, (3 << 32) + 2], None, [4], None, []]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(texts), pa.array(runs, pa.list_(pa.int64()))], ["doc_id", "text", "runs"])
    (out,) = suffix_dedup._cut(iter([batch]))
    spans = [[(s["start"], s["end"]) for s in row] for row in out.column("spans").to_pylist()]
    assert spans == [[(3, 6)], [], [(0, 4)], [], []]
    assert out.column("kept").to_pylist() == [b"abc", b"", b"", b"", b"klm"]
