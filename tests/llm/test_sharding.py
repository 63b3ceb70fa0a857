import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from latentmesh.llm import sharding

from .fixtures import awkward, documents, odd_names, with_clashes, words


def slow_difference(sizes, k):
    """Textbook differencing with sets."""
    state = [(tuple([s] + [0] * (k - 1)), [[i]] + [[] for _ in range(k - 1)], n) for n, (i, s) in enumerate(enumerate(sizes))]
    fresh = len(state)
    while len(state) > 1:
        state.sort(key=lambda x: (-(x[0][0] - x[0][-1]), x[2]))
        a, b = state.pop(0), state.pop(0)
        parts = sorted([(a[0][j] + b[0][k - 1 - j], j) for j in range(k)], key=lambda x: (-x[0], x[1]))
        state.append((tuple(p for p, _ in parts), [a[1][j] + b[1][k - 1 - j] for _, j in parts], fresh))
        fresh += 1
    return state[0]


@pytest.mark.parametrize(("n", "k"), [(1, 3), (2, 3), (7, 2), (40, 4), (200, 16)])
def test_difference_equals_brute_force(n, k):
    rng = random.Random(n)
    sizes = sorted((rng.randint(0, 1000) for _ in range(n)), reverse=True)
    parts = np.zeros((n, k), np.int64)
    parts[:, 0] = sizes
    shard, sums = sharding.difference(parts)
    want, members, _ = slow_difference(sizes, k)
    assert tuple(sums) == want
    assert [sorted(np.flatnonzero(shard[:, 0] == s).tolist()) for s in range(k)] == [sorted(m) for m in members]


def test_near_the_optimum():
    rng = random.Random(0)
    for _ in range(20):
        sizes = sorted((rng.randint(1, 50) for _ in range(8)), reverse=True)
        parts = np.zeros((8, 2), np.int64)
        parts[:, 0] = sizes
        best = min(abs(sum(s if c else -s for s, c in zip(sizes, signs))) for signs in product((0, 1), repeat=8))
        sums = sharding.difference(parts)[1]
        assert sums[0] - sums[1] <= best + 12


@pytest.mark.parametrize(("bucket", "fan_in"), [(20_000, 256), (20, 3)])
def test_groups_stay_whole_and_bytes_are_even(spark, bucket, fan_in):
    rng = random.Random(1)
    texts = [words(rng, rng.randint(1, 60)) for _ in range(300)]
    rows = [(i, rng.choice(texts)) for i in range(900)]
    got = sharding.shard(documents(spark, rows), 8, bucket=bucket, fan_in=fan_in).collect()
    assert len(got) == 900
    of, size = {}, [0] * 8
    for r in got:
        assert of.setdefault(r.text, r.shard) == r.shard
        size[r.shard] += len(r.text)
    largest = max(len(t) * sum(x == t for _, x in rows) for t in texts)
    assert max(size) - min(size) <= (largest // 10 if bucket > 300 else largest)  # twenty groups a bucket can't be spread as evenly


@pytest.mark.parametrize(("bucket", "fan_in"), [(1000, 256), (200, 4)])
@pytest.mark.parametrize("giants", [[300], [300, 150, 40, 40, 40]])
def test_giant_groups_are_evened_out(spark, bucket, fan_in, giants):
    rng = random.Random(3)
    sizes = [rng.randint(800, 2400) for _ in range(3000)] + [1000 * g for g in giants]
    groups = spark.createDataFrame(list(enumerate(sizes)), "key long, bytes long")
    got = {r.key: r.shard for r in sharding.plan(groups, 16, bucket, fan_in).collect()}
    assert sorted(got) == list(range(len(sizes)))
    shards = [sum(s for k, s in enumerate(sizes) if got[k] == j) for j in range(16)]
    assert max(shards) - min(shards) <= 2400


def test_same_result_in_any_order(spark):
    rng = random.Random(2)
    docs = documents(spark, [(i, words(rng, 5)) for i in range(100)])
    a, b = ({r.doc_id: r.shard for r in sharding.assign(d, 4).collect()} for d in (docs, docs.orderBy("text").repartition(5)))
    assert a == b


def test_awkward_rows(spark):
    docs = with_clashes(documents(spark, awkward(random.Random(0))))
    got = sharding.shard(docs, 4)
    assert got.columns == [c for c in docs.columns if c != "shard"] + ["shard"]
    rows = got.collect()
    assert len(rows) == docs.count()
    assert len({r.shard for r in rows if r.text == ""}) == 1
    assert all(0 <= r.shard < 4 for r in rows)
    assert sharding.shard(docs.where("false"), 4).count() == 0


def test_names_and_keys_of_any_kind(spark):
    docs = odd_names(documents(spark, [(k, f"text {k}") for k in range(20)]))
    got = sharding.shard(docs, 4)
    assert got.columns == [c for c in docs.columns if c != "SHARD"] + ["shard"] and got.count() == 20
    by = sharding.shard(docs, 4, key=F.col("`a.b`"))
    assert by.count() == 20 and by.select("shard").distinct().count() == 1
