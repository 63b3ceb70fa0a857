"""The joins that shuffle where a side is too large to broadcast give the same."""

import random

import pytest

from latentmesh.llm import exact_dedup, line_dedup, sharding, simhash

from .fixtures import awkward, documents


@pytest.mark.parametrize(
    ("module", "run"),
    [
        (sharding, lambda d: sharding.shard(d, 4, bucket=3, fan_in=2)),
        (line_dedup, lambda d: line_dedup.dedup(d, 2)),
        (exact_dedup, exact_dedup.duplicates),
        (simhash, simhash.drop),
    ],
)
def test_same_rows(spark, monkeypatch, module, run):
    docs = documents(spark, awkward(random.Random(0)) + [(30 + i, f"line {i % 3}\nline {i % 4}") for i in range(20)])
    want = sorted(map(str, run(docs).collect()))
    calls = []
    monkeypatch.setattr(module, "small_or_not", lambda df, *a: calls.append(1) or df.hint("merge"))
    assert sorted(map(str, run(docs).collect())) == want
    assert calls
