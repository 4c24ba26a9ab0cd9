import random
import re

import numpy as np
import pytest

from merklake.llm import jaccard
from merklake.llm.components import components
from merklake.llm.jaccard import Rule, component_ids, cut_bands, index_keys, keep_one, link

TEXTS = ["", None, "  \n", "one", "ONE", "one two", "two one", "a b c", "a b c a b c a b c"]


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words)} if len(words) < n else {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def brute(pairs, rule):
    sets = [shingles(t, rule.words) for _, t in pairs]
    label = list(range(len(pairs)))
    for i in range(len(pairs)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= rule.percent * (len(sets[i]) + len(sets[j]) - common):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for (doc, _), x in zip(pairs, label, strict=True):
        least[x] = min(doc, least.get(x, doc))
    return sorted((doc, len(s), least[x]) for (doc, _), s, x in zip(pairs, sets, label, strict=True))


def corpus(seed):
    rng = random.Random(seed)
    texts = list(TEXTS)
    for _ in range(12):
        base = [rng.choice("red green blue dark light of the and one two".split()) + str(rng.randrange(60)) for _ in range(rng.choice([4, 9, 25, 60, 140]))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(12)):
            own = list(texts[-1].split()) if rng.random() < 0.5 else list(base)
            for _ in range(rng.randrange(1, 4)):
                own[rng.randrange(len(own))] = "x" + str(rng.randrange(99))
            texts.append(" ".join(own))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("rule,many", [(Rule(3, 90), 1), (Rule(5, 80), 1), (Rule(2, 60), 10**6)])
def test_components_against_brute_force(spark, documents, monkeypatch, rule, many):
    """With `many`, bands are cut as for that many times as many sets, so that wide segments are used."""
    monkeypatch.setattr(jaccard, "cut_bands", lambda rule, counts, ratio, chance: cut_bands(rule, {k: n * many for k, n in counts.items()}, ratio, 0.01))
    pairs = corpus(rule.percent)
    got = component_ids(link(documents(pairs), rule)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == brute(pairs, rule)


@pytest.mark.parametrize("percent,chance", [(90, 1e-6), (80, 1e-6), (70, 0.01)])
def test_linked_sets_share_a_key(percent, chance):
    """Pairs as different as a link allows, of many sizes, always meet, and one of the two not by a deletion."""
    rng, rule = np.random.default_rng(percent), Rule(5, percent)
    bands = cut_bands(rule, {k: 10**6 for k in range(14)}, chance=chance)
    assert any(b.wide for b in bands) == (chance > 1e-3)
    for size in [1, 2, 3, 5, 8, 13, 40, 99, 128, 300, 1000] * 8:
        a = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        other = int(rng.integers(size, rule.largest_partner(size) + 1))
        cut = (int(rule.most_different(size, other)) - (other - size)) // 2
        b = np.concatenate((a[max(cut, 0) :], rng.integers(0, 1 << 63, other - size + max(cut, 0), dtype=np.uint64)))
        assert 100 * len(set(a) & set(b)) >= percent * len(set(a) | set(b))
        x, y = (index_keys(np.unique(s), rule, bands) for s in (a, b))
        full = [set(k[k % 2 == 0].tolist()) for k in (x, y)]
        gone = [{v - 1 for v in k[k % 2 == 1].tolist()} for k in (x, y)]
        assert full[0] & full[1] or full[0] & gone[1] or full[1] & gone[0], (size, other)


@pytest.mark.parametrize("percent,chance", [(90, 1e-6), (80, 1e-6), (70, 0.01)])
def test_linked_sets_share_a_key_without_spares(percent, chance):
    """Whatever keys are common, linked sets that drop as many of each lot as they may, the commonest first, share a key still."""
    rng, rule = np.random.default_rng(percent), Rule(5, percent)
    bands = cut_bands(rule, {k: 10**6 for k in range(14)}, chance=chance)
    dropped = 0

    def kept(own, common):
        keys, lots = jaccard.keys_and_lots(own, rule, bands)
        gone = set()
        for lot in set(lots[lots > 0].tolist()):
            of_lot = [k for k in keys[lots == lot].tolist() if common(k)]
            assert all(k % 2 == 0 for k in of_lot)
            gone |= set(sorted(of_lot, key=lambda k: (common(k), k))[-(lot % (1 << jaccard.SPARE_BITS)) :])
        nonlocal dropped
        dropped += len(gone)
        return [k for k in keys.tolist() if k not in gone]

    for size in [1, 2, 3, 5, 8, 13, 40, 99, 128, 300, 1000] * 4:
        a = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        other = int(rng.integers(size, rule.largest_partner(size) + 1))
        cut = (int(rule.most_different(size, other)) - (other - size)) // 2
        b = np.concatenate((a[max(cut, 0) :], rng.integers(0, 1 << 63, other - size + max(cut, 0), dtype=np.uint64)))
        both = set(index_keys(np.unique(a), rule, bands).tolist()) & set(index_keys(np.unique(b), rule, bands).tolist())
        for common in (lambda k: k % 101, lambda k: k % 3, lambda k, both=both: 1 + k % 7 if k in both else 0):
            x, y = (kept(np.unique(s), common) for s in (a, b))
            full = [{k for k in own if k % 2 == 0} for own in (x, y)]
            gone = [{k - 1 for k in own if k % 2 == 1} for own in (x, y)]
            assert full[0] & full[1] or full[0] & gone[1] or full[1] & gone[0], (size, other)
    assert dropped


def test_common_passage_is_no_large_bucket(spark, documents, monkeypatch):
    """Texts that share a passage and nothing else do not all meet in the buckets of it; copies among them are found."""
    rng, rule = random.Random(3), Rule(5, 80)
    passage, texts = [f"p{k}" for k in range(24)], []
    for _ in range(120):
        own = [f"w{rng.randrange(10**7)}" for _ in range(250)]
        at = rng.randrange(250)
        texts.append(" ".join(own[:at] + passage + own[at:]))
    texts += [text.replace(text.split()[40], "other") for text in texts[:6]]
    tables, write = {}, jaccard.materialize
    monkeypatch.setattr(jaccard, "materialize", lambda df, name: tables.setdefault(name, write(df, name)))
    got = component_ids(link(documents(texts), rule)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == brute(list(enumerate(texts)), rule)
    before, after = (max(r["count"] for r in tables[t].groupBy("key").count().collect()) for t in ("all_buckets", "buckets"))
    assert after <= jaccard.COMMON < before


def test_repeated_rows_and_ids(spark, documents):
    docs = documents([(5, "a b c d e f"), (5, "a b c d e f"), (5, "other text of five words"), (9, "a b c d e f"), (3, ""), (3, "")])
    docs = docs.withColumn("f0", docs.lang).withColumn("component_id", docs.lang)
    kept = keep_one(docs, Rule(5, 80))
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(3, ""), (3, ""), (5, "a b c d e f"), (5, "other text of five words")]


def test_null_ids(spark, documents):
    docs = documents([(None, "a b c d e f"), (4, "a b c d e f"), (None, "nothing like it at all"), (None, None)])
    got = component_ids(link(docs, Rule(5, 80))).select("doc_id", "component_id").collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, [(None, 4), (4, 4), (None, None), (None, None)]))
    assert keep_one(docs, Rule(5, 80)).count() == 3


def test_groups_of_one_smallest_id(spark, documents):
    """Two groups without ids, and two headed by one doc_id, are four groups."""
    texts = ["a b c d e f", "nothing like it at all", "some other words in here", "and a last text of seven"]
    ids = [(None, None, None), (None, None), (2, 7, 8), (2, 9)]
    kept = keep_one(documents([(i, t) for own, t in zip(ids, texts, strict=True) for i in own] + [(3, "alone with its words here")]), Rule(5, 80))
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted([("None", texts[0]), ("None", texts[1]), ("2", texts[2]), ("2", texts[3]), ("3", "alone with its words here")])


def test_empty_table(spark, documents):
    assert component_ids(link(documents([]), Rule(3, 90))).count() == 0
    assert keep_one(documents([]), Rule(3, 90)).count() == 0


def varied(n):
    """Texts of one group, a link between some of them: each has a few words of its own."""
    rng = random.Random(n)
    base = [f"w{k}" for k in range(90)]
    texts = []
    for _ in range(n):
        own = list(base)
        for at in rng.sample(range(90), rng.randrange(1, 5)):
            own[at] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    return list(enumerate(texts))


def test_large_group_leaves_few_pairs(spark, documents, monkeypatch):
    """Most of a group is one component before all its pairs are looked at."""
    seen, whole, pairs, rule = [], jaccard._across, varied(150), Rule(5, 80)
    monkeypatch.setattr(jaccard, "_across", lambda *args: seen.append(whole(*args)) or seen[0])
    got = component_ids(link(documents(pairs), rule)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == brute(pairs, rule)
    assert seen[0].count() < 180  # 209 by two rounds of single pivots, 150 with further ones


@pytest.mark.parametrize("seed", range(3))
def test_pairs_of_many_buckets_meet_once(spark, seed):
    """Every pair of different components that shares a bucket in which one is whole; once, if both are whole in all."""
    rng = random.Random(seed)
    component, wide = {s: s % 7 if s < 14 else s for s in range(24)}, seed == 2
    buckets = {key: rng.sample(range(24), rng.randrange(2, 12)) for key in range(-40, 40)}
    buckets |= {key + 1000: held for key, held in list(buckets.items())[:30]}
    rows = [(key, min(held), s, s == min(held) or not wide or rng.random() < 0.5, component[s], component[min(held)], len(held)) for key, held in buckets.items() for s in held]
    split = spark.createDataFrame(rows, "key bigint, pivot bigint, set_no bigint, whole boolean, component bigint, main bigint, n bigint")
    sets = spark.createDataFrame([(s, 50, [0] * (jaccard.COARSE_BITS // 64), [0] * (jaccard.SKETCH_BITS // 64)) for s in range(24)], "set_no bigint, n_shingles bigint, coarse array<bigint>, sketch array<bigint>")
    held = {}
    for key, _, s, whole, *_ in rows:
        held.setdefault(key, []).append((s, whole))
    expected = {frozenset((a, b)) for own in held.values() for a, x in own for b, y in own if component[a] != component[b] and (x or y)}
    met = [frozenset(r) for r in jaccard._meetings(jaccard._one_of_each(split), sets, Rule(5, 80)).collect()]
    assert set(met) == expected and (wide or len(met) <= 1.2 * len(expected))
    assert {frozenset(r) for r in jaccard._across(split, sets, Rule(5, 80)).collect()} == expected


def test_rows_in_doubt_alone_go_on_whole(spark, documents, monkeypatch):
    """Which row of a group stays is told without its other columns; only a doc_id with rows of both kinds needs them."""
    seen, whole = [], jaccard.with_fingerprints
    monkeypatch.setattr(jaccard, "with_fingerprints", lambda docs, rule: seen.append(docs.count() if "row" in docs.columns else 0) or whole(docs, rule))
    pairs, rule = varied(40) + [(100, "a text of its own here")], Rule(5, 80)
    heads = sorted({component for _, _, component in brute(pairs, rule)})
    assert sorted(r.doc_id for r in keep_one(documents(pairs), rule).collect()) == heads
    assert sum(seen) == 0
    both = [(1, "a b c d e f"), (9, "a b c d e f"), (9, "other text of five words"), (9, "other text of five words but longer"), (9, "nothing at all like these words")]
    kept = keep_one(documents(both), rule).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([both[0], *both[2:]])
    assert sum(seen) == 4


def test_one_row_of_a_repeated_head(spark, documents):
    """Rows of the smallest doc_id that are alike, or not alike but of one group, are one row."""
    base = [f"w{k}" for k in range(60)]
    near = " ".join(["x", *base[1:]])
    pairs = [(2, " ".join(base)), (2, " ".join(base)), (2, near), (2, near), (7, near), (2, "far from all of these"), (2, "")]
    kept = sorted((r.doc_id, r.text) for r in keep_one(documents(pairs), Rule(5, 80)).collect())
    assert len(kept) == 3 and kept[:2] == [(2, ""), (2, "far from all of these")] and kept[2] in pairs[:3]


def test_texts_are_dealt_out_once(spark, documents, monkeypatch, capsys):
    """Texts to compare meet their sets where one of each is chosen, and pairs from the join across components aren't sketched again."""
    plans, write = {}, jaccard.materialize
    monkeypatch.setattr(jaccard, "materialize", lambda df, name: plans.setdefault(name, []).append(df) or write(df, name))
    link(documents(varied(60)), Rule(5, 80))
    assert plans["across"] and len(plans["pairs"]) == len(plans["texts"]) - 1
    for df in plans["texts"]:
        df.explain()
        plan = capsys.readouterr().out
        assert "hashpartitioning(f0" in plan and "hashpartitioning(set_no" not in plan


def test_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200)], "a bigint, b bigint")
    got = dict(map(tuple, components(links).collect()))
    assert got == {i: 0 for i in range(61)} | {100: 100, 200: 100}


def test_components_extended_follow_new_links_only(spark, monkeypatch):
    """Links in batches give the components of all; a star that is known does not go through the rounds again."""
    from merklake.llm import components as module

    def frame(links):
        return spark.createDataFrame(links, "a long, b long")

    first = [(0, k) for k in range(1, 200)] + [(500, 501), (700, 701)]
    more = [(3, 150), (199, 501), (900, 901), (901, 700), (42, 43)]
    known = components(frame(first)).localCheckpoint()
    seen, whole = [], module.components
    monkeypatch.setattr(module, "components", lambda links: seen.append(links.count()) or whole(links))
    got = dict(map(tuple, module.extend(known, frame(more)).collect()))
    assert got == dict(map(tuple, whole(frame(first + more)).collect()))
    assert seen == [3]
