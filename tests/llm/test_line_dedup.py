import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from latentmesh.llm import line_dedup
from latentmesh.llm.line_dedup import Cuckoo, LineIndex

from .fixtures import awkward, documents, odd_names, with_clashes, words


def slow(rows, known=()):
    """Texts by id, after dropping lines that are known or came before."""
    seen, out = set(known), {}
    for i, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        if text is None:
            out[i] = None
            continue
        kept = []
        for line in text.split("\n"):
            if line.strip() and line in seen:
                continue
            seen.add(line)
            kept.append(line)
        out[i] = "\n".join(kept)
    return out


def lined(rng, n, pool):
    return [(i, "\n".join(rng.choice(pool) if rng.random() < 0.6 else words(rng, 4) for _ in range(rng.randint(1, 8)))) for i in range(n)]


def counted(index):
    return {bytes(r.key): r.n for r in index.counts().collect()}


def slots(index):
    return {(r.shard, r.level): np.count_nonzero(np.frombuffer(r.slots, np.uint16)) for r in index.filters.collect()}


def test_equals_brute_force(spark):
    rng = random.Random(0)
    pool = [words(rng, 4) for _ in range(15)] + ["", "  "]
    rows = lined(rng, 120, pool)
    got = line_dedup.dedup(documents(spark, rows), shards=3)
    assert {r.doc_id: r.text for r in got.collect()} == slow(rows)


def test_incremental_and_reversible(spark):
    rng = random.Random(1)
    pool = [words(rng, 4) for _ in range(12)]
    first, second = lined(rng, 60, pool), [(i + 1000, t) for i, t in lined(rng, 60, pool)]
    d1, d2 = documents(spark, first), documents(spark, second)
    one, _ = LineIndex.empty(spark, 4).insert(d1)
    two, gone = one.insert(d2)
    known = {line for _, t in first for line in t.split("\n")}
    assert {r.doc_id: r.text for r in line_dedup.without(d2, gone).collect()} == slow(second, known)
    back = two.delete(d2)
    assert counted(back) == counted(one)
    assert sum(slots(back).values()) == sum(slots(one).values())
    again, gone_again = back.insert(d2)
    assert sorted(map(tuple, gone_again.collect())) == sorted(map(tuple, gone.collect()))
    assert counted(again.compacted()) == counted(two)
    assert counted(two.delete(d1).delete(d2)) == {}
    assert sum(slots(two.delete(d1).delete(d2)).values()) == 0


def test_deleting_the_first_holder_brings_lines_back(spark):
    rng = random.Random(5)
    pool = [words(rng, 4) for _ in range(12)]
    rows = lined(rng, 60, pool)
    batches = [rows[30:], rows[:30]]  # the later ids come first
    index, gone = LineIndex.empty(spark, 4), set()
    for batch in batches:
        index, more = index.insert(documents(spark, batch))
        gone |= set(map(tuple, more.collect()))
    order = [(i, k, line) for batch in batches for i, t in batch for k, line in enumerate(t.split("\n")) if line.strip()]
    for deleted in (range(30, 40), range(0, 50, 3), range(60)):
        index, back = index.withdraw(documents(spark, [r for r in rows if r[0] in deleted]))
        back = list(map(tuple, back.collect()))
        assert set(back) <= gone and len(back) == len(set(back))
        gone -= set(back)
        order = [x for x in order if x[0] not in deleted]
        kept, want = set(), set()
        for i, k, line in order:
            if line in kept:
                want.add((i, k))
            kept.add(line)
        assert {x for x in gone if x[0] not in deleted} == want
        gone = want
    assert counted(index) == {}


@pytest.mark.parametrize("n", [1, 50, 5000])
def test_cuckoo_has_all_keys(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 2**63, n, dtype=np.uint64)
    f = Cuckoo.sized(n)
    lost = f.add(keys)
    assert f.has(np.delete(keys, lost)).all()
    assert len(lost) <= n * 0.01
    assert f.has(rng.integers(0, 2**63, 20_000, dtype=np.uint64)).mean() < 0.002
    assert len(f.remove(np.delete(keys, lost))) == 0
    assert not f.slots.any()


def added(keys, filters):
    """The filters and the keys with their levels."""
    import pandas as pd

    made = line_dedup._add(pd.DataFrame({"shard": 0, "key": keys}), filters)
    return made[made["slots"].notna()], made[made["key"].notna()]


def test_full_filters_grow():
    keys = [i.to_bytes(16, "little") for i in range(9000)]
    made, at = added(keys, line_dedup._rows(0, [Cuckoo.sized(10)]))
    assert len(made) > 1 and sorted(at["key"]) == sorted(keys)
    assert line_dedup._probe(at, made)["maybe"].all()
    assert not any(np.frombuffer(s, np.uint16).any() for s in line_dedup._remove(at, made)["slots"])


def test_surviving_keys_stay_in_the_filters():
    """A key of a later filter has the print and buckets of one of the first; it is the later one that goes."""
    import pandas as pd

    key = lambda x: int(x).to_bytes(8, "little") * 2
    older = Cuckoo.sized(8000)
    prints, at, _ = older._places(np.arange(400_000, dtype=np.uint64))
    last: dict = {}
    pair = next((last[k], i) for i, k in enumerate(zip(prints, at)) if last.setdefault(k, i) != i)  # one print and bucket
    rest = list(range(500_000, 512_000))
    filters, levels = line_dedup._rows(0, []), []
    for group in ([pair[0], *rest[:6000]], rest[6000:], [pair[1]]):
        filters, at = added([key(x) for x in group], filters)
        levels.append(at)
    level = pd.concat(levels)
    assert len(filters) > 1
    of = dict(zip(level["key"], level["level"]))
    assert of[key(pair[0])] != of[key(pair[1])]
    goes = {key(pair[1]), *(key(x) for x in rest[::3])}
    mark = level["key"].map(lambda k: k in goes)
    after = line_dedup._remove(level[mark], filters)
    assert line_dedup._probe(level[~mark], after)["maybe"].all()
    assert sum(np.count_nonzero(np.frombuffer(s, np.uint16)) for s in after["slots"]) == int((~mark).sum())


def test_deletes_over_several_levels(spark):
    index = LineIndex.empty(spark, 1)
    docs = [documents(spark, [(i, "\n".join(f"line {i} {j}" for j in range(400))) for i in range(a, a + 6)]) for a in (0, 6, 12)]
    for d in docs:
        index, _ = index.insert(d)
    assert index.filters.count() > 1
    index = index.delete(docs[1])
    assert sum(slots(index).values()) == 4800 == len(counted(index))
    for d in (docs[0], docs[2]):
        assert index.insert(d.withColumn("doc_id", F.col("doc_id") + 100))[1].count() == 2400


def test_op8_probes_its_filters(spark, monkeypatch):
    asked = []
    known = LineIndex._known
    monkeypatch.setattr(LineIndex, "_known", lambda self, keys: asked.append(known(self, keys)) or asked[-1])
    rows = [(i, f"a\nonly {i}\nb") for i in range(40)]
    assert {r.doc_id: r.text for r in line_dedup.dedup(documents(spark, rows), 2).collect()} == slow(rows)
    assert asked and asked[0].count() == 2


def test_awkward_rows(spark):
    rows = awkward(random.Random(0))
    docs = with_clashes(documents(spark, rows))
    got = {(r.doc_id, r.text): r.removed for r in line_dedup.dedup(docs, 2).collect()}
    base = rows[0][1]
    assert got[1, base] == 0 and got[2, ""] == 1
    assert got[3, None] == 0 and got[4, ""] == 0 and got[7, " \n\t "] == 0
    assert got[None, base] == 0
    assert got[8, rows[10][1]] == 0
    odd = odd_names(documents(spark, [(1, "a\nb"), (2, "b\nc")]))
    assert {tuple(r) for r in line_dedup.dedup(odd, 2).collect()} == {(1, "a\nb", 0), (2, "c", 1)}
    named = documents(spark, [(1, "a\na")]).withColumn("doc_id", F.lit("x"))
    assert [tuple(r) for r in line_dedup.dedup(named, 2).collect()] == [(None, "a\na", 0)]


def test_a_text_of_many_lines_that_go(spark):
    text = "\n".join(f"l{k % 40_000}" for k in range(80_000))
    got = line_dedup.dedup(documents(spark, [(1, text)]), 2).first()
    assert got.removed == 40_000 and got.text == "\n".join(f"l{k}" for k in range(40_000))


def test_empty_table(spark):
    docs = documents(spark, [(1, "x")]).where("false")
    assert line_dedup.dedup(docs, 2).count() == 0
    index, gone = LineIndex.empty(spark, 2).insert(docs)
    assert gone.count() == 0 and index.counts().count() == 0
    assert index.delete(docs).counts().count() == 0


def test_ties_keep_the_first_line(spark):
    got = line_dedup.dedup(documents(spark, [(2, "b\na"), (1, "a\na\nb")]), 2)
    assert {r.doc_id: (r.text, r.removed) for r in got.collect()} == {1: ("a\nb", 1), 2: ("", 2)}
    assert got.where(F.col("removed") > 0).count() == 2


def test_shards_grow_with_the_lines(spark, monkeypatch):
    docs = documents(spark, [(1, "a\nb\nc"), (2, None), (3, "")])
    assert line_dedup.shards_for(docs) == line_dedup.SHARDS
    monkeypatch.setattr(line_dedup, "SHARDS", 1)
    monkeypatch.setattr(line_dedup, "SHARD_LINES", 2)
    assert line_dedup.shards_for(docs) == 2
    assert line_dedup.shards_for(docs.where("false")) == 1
    assert {r.doc_id: r.text for r in line_dedup.dedup(docs).collect()} == {1: "a\nb\nc", 2: None, 3: ""}
