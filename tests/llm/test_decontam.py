import math
import random
import re
from collections import Counter

import pytest

from latentmesh.llm import decontam

from .fixtures import awkward, documents, odd_names, with_clashes, words

ITEMS = "item_id long, text string"


def tokens(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())


def slow(docs, items, n=decontam.WORDS, share=decontam.SHARE):
    """(doc, item, matched, shingles, first word) over every window."""
    out = set()
    for i, text in items:
        w = tokens(text)
        if not w or i is None:
            continue
        width = min(n, len(w))
        own = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}
        need = math.ceil(share * len(own) - 1e-9)
        for d, t in docs:
            v = tokens(t)
            s = [tuple(v[k : k + width]) for k in range(len(v) - width + 1)]
            best = max(((len(own & set(s[k : k + len(w) - width + 1])), -k) for k in range(len(s)) if s[k] in own), default=(0, 0))
            if d is not None and best[0] >= need:
                out.add((d, i, best[0], len(own), -best[1]))
    return out


def corpus(seed=0):
    rng = random.Random(seed)
    shared = words(rng, 12)
    items = [(k, words(rng, rng.randint(3, 40))) for k in range(12)] + [(20, shared + " " + words(rng, 10)), (21, shared + " " + words(rng, 9)), (22, None), (23, "!!"), (24, "x y"), (25, "a a a a a a a a a a")]
    docs = []
    for d in range(60):
        parts = words(rng, rng.randint(0, 80)).split()
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            t = (rng.choice(items)[1] or "").split()
            t = [w if rng.random() > rng.choice([0, 0, 0.03, 0.2]) else "other" for w in t][: rng.choice([99, 99, 10])]
            at = rng.randint(0, len(parts))
            parts[at:at] = t
        docs.append((d, " ".join(parts).upper() if d % 7 == 0 else " ".join(parts)))
    return docs, items


@pytest.mark.parametrize("slice_shingles", [1_000_000, 50])
def test_equals_brute_force(spark, slice_shingles):
    for seed in range(3):
        docs, items = corpus(seed)
        got = decontam.holds(documents(spark, docs), spark.createDataFrame(items, ITEMS), slice_shingles=slice_shingles)
        want = slow(docs, items)
        assert {tuple(r) for r in got.collect()} == want
        assert len(want) > 10


def test_clean_keeps_the_others(spark):
    docs, items = corpus(5)
    table, bench = documents(spark, docs), spark.createDataFrame(items, ITEMS)
    dirty = {d for d, *_ in slow(docs, items)}
    kept = decontam.clean(table, bench, slice_shingles=60)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _ in docs if d not in dirty)


def test_awkward_rows(spark):
    rng = random.Random(0)
    rows = awkward(rng)
    bench = spark.createDataFrame([(1, rows[0][1]), (1, rows[0][1]), (None, "a b"), (2, None), (3, "")], ITEMS)
    docs = with_clashes(documents(spark, rows))
    assert {(r.doc_id, r.item_id) for r in decontam.holds(docs, bench).collect()} == {(1, 1), (2, 1), (10, 1)}
    kept = decontam.clean(docs, bench)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([3, 4, 5, None, 6, 7, 8, 9, 11])


def test_empty_tables(spark):
    docs, bench = documents(spark, [(1, "a b c d e f")]), spark.createDataFrame([(1, "a b c d e f")], ITEMS)
    assert decontam.holds(docs.where("false"), bench).count() == 0
    assert decontam.holds(docs, bench.where("false")).count() == 0
    assert decontam.clean(docs, bench.where("false")).count() == 1
    assert decontam.clean(docs, bench).count() == 0


def test_names_and_ids_of_any_kind(spark):
    docs = odd_names(documents(spark, [(1, "a b c d e f g"), (2, "x")]))
    bench = spark.createDataFrame([("1", "a b c d e f"), ("n", "x")], "Item_ID string, Text string")
    assert [(r.doc_id, r.item_id) for r in decontam.holds(docs, bench).collect()] == [(1, 1)]
    kept = decontam.clean(docs, bench)
    assert kept.columns == docs.columns and [r[0] for r in kept.collect()] == [2]


def test_runs_of_words_meet_without_a_gap(spark, monkeypatch):
    """Texts longer than a run, items across its edges and rows that end at them."""
    rng = random.Random(8)
    items = [(k, words(rng, 12)) for k in range(6)]
    docs = [(d, " ".join([words(rng, rng.randint(0, 90)), items[d % 6][1], words(rng, rng.randint(0, 90)), items[(d + 1) % 6][1]])) for d in range(40)]
    monkeypatch.setattr(decontam, "RUN_WORDS", 7)
    kernel = decontam._prepared(documents(spark, docs), decontam._distinct([i for i, _ in items], [t for _, t in items], decontam.WORDS), decontam.SHARE)
    import pyarrow as pa

    found = decontam._search(pa.array([t for _, t in docs]), kernel, decontam._sieve(kernel.hashes))
    got = {(docs[row][0], int(kernel.ids[item]), n, int(kernel.count[item]), first) for row, item, n, first in found}
    assert got == slow(docs, items)
    assert len(got) == 80
