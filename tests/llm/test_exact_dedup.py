import random

from pyspark.sql import functions as F

from latentmesh.llm import exact_dedup

from .fixtures import awkward, documents, odd_names, with_clashes, words


def slow(rows):
    first = {}
    for i, t in rows:
        if i is not None and t is not None:
            first[t] = min(i, first.get(t, i))
    return {(i, first[t]) for i, t in rows if i is not None and t is not None and first[t] != i}


def test_equals_brute_force(spark):
    rng = random.Random(0)
    texts = [words(rng, 3) for _ in range(30)]
    rows = [(i, rng.choice(texts)) for i in range(150)]
    assert {tuple(r) for r in exact_dedup.duplicates(documents(spark, rows)).collect()} == slow(rows)


def test_collisions_never_drop_a_text(spark):
    rng = random.Random(1)
    texts = [words(rng, rng.randint(1, 3)) for _ in range(25)]
    rows = [(i, rng.choice(texts)) for i in range(120)]
    weak = lambda text: F.unhex(F.md5(F.substring(text, 1, 1)))
    got = exact_dedup.duplicates(documents(spark, rows), weak)
    assert {tuple(r) for r in got.collect()} == slow(rows)


def test_awkward_rows(spark):
    rows = awkward(random.Random(0))
    got = exact_dedup.duplicates(with_clashes(documents(spark, rows)))
    assert {tuple(r) for r in got.collect()} == {(2, 1), (5, 4)} == slow(rows)


def test_empty_table(spark):
    assert exact_dedup.duplicates(documents(spark, [(1, "x")]).where("false")).count() == 0


def test_names_and_ids_of_any_kind(spark):
    docs = documents(spark, [(1, "a"), (2, "a"), (3, "b")])
    assert [tuple(r) for r in exact_dedup.duplicates(odd_names(docs)).collect()] == [(2, 1)]
    assert exact_dedup.duplicates(docs.selectExpr("concat('n', doc_id) AS doc_id", "text")).count() == 0
