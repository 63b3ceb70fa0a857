import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from latentmesh.llm import simhash
from latentmesh.llm import textkernel as tk

from .fixtures import awkward, documents, odd_names, with_clashes, words


def slow_print(text):
    h, off = tk.words(pa.array([text]))
    if not len(h):
        return None
    pairs = tk.shingles(h, off, 2)[0] if len(h) > 1 else tk.mix64(h)
    features = sorted({int(p) >> 20 for p in pairs})
    mixed = [int(x) for x in tk.mix64(np.array(features, np.uint64))]
    out = []
    for w in range(2):
        seed = 0x9E3779B97F4A7C15 * w
        x = [int(v) for v in tk.mix64(np.array([m ^ seed for m in mixed], np.uint64))]
        draw = int(tk.mix64(np.array([mixed[0] ^ (2**64 - 1) ^ seed], np.uint64))[0])
        bits = 0
        for b in range(64):
            twice = 2 * sum(v >> b & 1 for v in x)
            bits |= (1 if twice > len(x) else draw >> b & 1 if twice == len(x) else 0) << b
        out.append(bits)
    return tuple(out)


def slow(texts, radius):
    """Class and number of links of each document that has one, over all pairs."""
    prints = {i: p for i, t in texts.items() if t is not None and (p := slow_print(t))}
    root, links = {i: i for i in prints}, Counter()

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if sum((a ^ b).bit_count() for a, b in zip(prints[i], prints[j])) <= radius:
                links.update([i, j])
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (find(i), links[i]) for i in ids if links[i]}


def slow_groups(texts, radius):
    """The class of each document that isn't the first of it."""
    return {i: r for i, (r, _) in slow(texts, radius).items() if r != i}


def classes(found):
    return {r.doc_id: r.keep_id for r in found.collect() if r.doc_id != r.keep_id}


def near_copies(rng, n=30):
    texts, i = {}, 0
    for _ in range(n):
        base = words(rng, rng.randint(20, 400)).split()
        for _ in range(rng.choice([1, 1, 2, 5])):
            copy = [w if rng.random() > 0.04 else words(rng, 1) for w in base]
            texts[i] = " ".join(copy)
            i += 1
    return texts


def test_fingerprints_equal_brute_force():
    rng = random.Random(3)
    texts = [words(rng, n) for n in (1, 2, 3, 50, 700, 3000)] + ["", None, "A a A a", "ÉÉ é-É"]
    rows, prints = simhash.fingerprints(pa.array(texts))
    got = {int(r): tuple(map(int, p)) for r, p in zip(rows, prints)}
    assert got == {k: p for k, t in enumerate(texts) if t and (p := slow_print(t))}


def test_near_finds_all_pairs_in_the_radius():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, (2, 300), dtype=np.uint64)
    a[:, 150:] = a[:, :150]
    for k in range(150):
        for b in rng.choice(64, rng.integers(0, 40) // 2, replace=False):
            a[rng.integers(2), 150 + k] ^= np.uint64(1) << np.uint64(b)
    exact = np.bitwise_count(a[:, :, None] ^ a[:, None]).astype(int).sum(0)
    for same in (False, True):
        found = [(int(x), int(y)) for p, q in simhash.near(a, a, 28, same, 7, 50) for x, y in zip(p, q)]
        assert sorted(found) == sorted((x, y) for x, y in zip(*np.nonzero(exact <= 28)) if x < y or not same)


@pytest.mark.parametrize("radius", [28, 27, 5, 0])
def test_parts_find_each_pair_in_the_radius_once(radius):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**64, (2, 1200), dtype=np.uint64)
    a[:, 600:] = a[:, :600]
    for k in range(600, 1200):
        for b in rng.choice(128, rng.integers(0, 40), replace=False):
            a[b // 64, k] ^= np.uint64(1) << np.uint64(b % 64)
    a = a[:, rng.permutation(1200)]
    b = np.concatenate([a[:, :200], rng.integers(0, 2**64, (2, 300), dtype=np.uint64)], axis=1)
    for other, same in ((a, True), (b, False)):
        exact = np.bitwise_count(a[:, :, None] ^ other[:, None]).astype(int).sum(0) <= radius
        wanted = sorted((int(x), int(y)) for x, y in zip(*np.nonzero(exact)) if x < y or not same)
        for sizes in ({}, {"block": 64, "held": 128}):
            pairs = [(int(x), int(y)) for part in range(8) for p, q in simhash.near_by_part(a, other, radius, part, same, **sizes) for x, y in zip(p, q)]
            assert sorted((min(x), max(x)) if same else x for x in pairs) == wanted


def test_parts_compare_few_of_all_pairs():
    """Each with each is too many from some million fingerprints on."""
    halves, parts = simhash.shares(simhash.RADIUS)
    assert sum(halves) + 1 == simhash.RADIUS
    assert sum(len(simhash.ball(s)) for s in parts) < 0.06 * (1 << 16)


@pytest.mark.parametrize("wide", [1 << 20, 40])
def test_groups_by_parts_equal_brute_force(spark, monkeypatch, wide):
    monkeypatch.setattr(simhash, "FEW", 0)
    monkeypatch.setattr(simhash, "WIDE", wide)
    texts = near_copies(random.Random(5))
    texts |= {500 + k: texts[k] for k in range(9)} | {600: texts[0]}
    got = {r.doc_id: (r.keep_id, r.links) for r in simhash.groups(documents(spark, list(texts.items()))).collect()}
    assert got == slow(texts, simhash.RADIUS)
    assert got


def test_links_that_connect_are_few_and_enough():
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 200, (2, 5000))
    x, y = x // 2 * 2, y // 2 * 2  # even ones make one class
    label = np.arange(200)
    kept = np.concatenate([part[simhash.join(label, x[part], y[part])] for part in np.split(np.arange(5000), 50)])
    assert len(kept) == 99
    assert (label[::2] == 0).all() and (label[1::2] == np.arange(1, 200, 2)).all()


def test_a_dense_family_gives_no_more_than_a_forest(spark):
    """Of 3,000 fingerprints that are all alike every link is counted and hardly one is written."""
    rng = np.random.default_rng(2)
    n = 3000
    f0 = np.array([sum(1 << int(b) for b in rng.choice(63, 5, replace=False)) for _ in range(n)])
    _, first = np.unique(f0, return_index=True)
    one = spark.createDataFrame([(int(k), 1 + int(k) % 3, int(f0[k]), 7) for k in first], "keep_id long, copies long, f0 long, f1 long")
    found = simhash.links(one).toPandas()
    assert len(found) == 2 * len(first) - 1
    many = found[found["b"].isna()].set_index("a")["links"]
    copies = {int(k): 1 + int(k) % 3 for k in first}
    assert all(many[k] == sum(copies.values()) - c for k, c in copies.items())


@pytest.mark.parametrize("tile", [16384, 7])
def test_groups_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    texts = near_copies(random.Random(1))
    texts |= {500 + k: texts[k] for k in range(9)} | {600: texts[0]}  # exact copies
    got = {r.doc_id: (r.keep_id, r.links) for r in simhash.groups(documents(spark, list(texts.items()))).collect()}
    assert got == slow(texts, simhash.RADIUS)
    assert got


def test_recall_of_planted_copies(spark):
    texts = near_copies(random.Random(2), 80)
    bases: dict = {}
    for i, t in texts.items():
        bases.setdefault(len(t.split()), []).append(i)
    planted = [(g[0], x) for g in bases.values() for x in g[1:] if len(set(texts[g[0]].split()) & set(texts[x].split())) > 10]
    root = {i: i for i in texts} | classes(simhash.groups(documents(spark, list(texts.items()))))
    assert sum(root[a] == root[b] for a, b in planted) >= 0.9 * len(planted)


def test_awkward_rows(spark):
    rows = awkward(random.Random(0))
    docs = with_clashes(documents(spark, rows))
    got = classes(simhash.groups(docs))
    assert got[2] == 1 and got[10] == 1
    assert not {3, 4, 5, 6, 7, 8, 9} & set(got)
    kept = simhash.drop(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 3, 4, 5, None, None, 6, 7, 8, 9, 11])


def test_repeated_rows_stay_once(spark):
    rng = random.Random(9)
    text = words(rng, 30)
    kept = simhash.drop(documents(spark, [(1, text), (1, text), (2, words(rng, 30))]))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2]


def test_names_and_ids_of_any_kind(spark):
    docs = odd_names(documents(spark, [(1, "a b c d"), (2, "a b c d"), (3, "e f g h")]))
    kept = simhash.drop(docs)
    assert kept.columns == docs.columns and kept.count() == 2
    named = docs.withColumn("Doc_ID", F.concat(F.lit("n"), F.col("Doc_ID").cast("string")))
    assert simhash.groups(named).count() == 0 and simhash.drop(named).count() == 3


def test_empty_table(spark):
    docs = documents(spark, [(1, "x")]).where("false")
    assert simhash.groups(docs).count() == 0
    assert simhash.drop(docs).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (100, 102)], "a long, b long")
    assert {r.node: r.root for r in simhash.components(edges).collect()} == {i: 0 for i in range(1, 41)} | {101: 100, 102: 100}


def test_repeated_words_are_no_likeness(spark):
    """Junk of words said over and over is like its copies, not like other junk."""
    rng = random.Random(4)
    texts = {i: " ".join(w for x in words(rng, 8).split() + ["the"] * 2 for w in [x] * 60) for i in range(150)}
    texts[200] = texts[3] + " more"
    assert classes(simhash.groups(documents(spark, list(texts.items())))) == {200: 3}
