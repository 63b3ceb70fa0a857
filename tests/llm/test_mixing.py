import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from latentmesh.llm import mixing

from .fixtures import awkward, documents, odd_names, with_clashes, words


def slow(rows, weights, seed=mixing.SEED):
    """Copies by (doc_id, source)."""
    tokens = Counter()
    for _, text, source in rows:
        tokens[source] += len((text or "").split())
    total = sum(tokens.values())
    w = {s: weights.get(s, 0.0) if n else 0.0 for s, n in tokens.items()}
    out = Counter()
    for i, _, s in rows:
        rate = total * (w[s] / sum(w.values())) / tokens[s] if tokens[s] and w[s] else 0.0
        draw = int(hashlib.md5(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:13], 16) / 16**13
        n = int(rate) + (draw < rate - int(rate))
        if n:
            out[i, s] += n
    return out


def table(spark):
    rng = random.Random(4)
    rows = [(i, words(rng, rng.randint(1, 80)), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(200)]
    return rows, documents(spark, [(i, t, "en", s, len(t)) for i, t, s in rows])


def test_given_weights_equal_brute_force(spark):
    rows, docs = table(spark)
    weights = {"a": 1.0, "b": 2.0, None: 1.5, "absent": 9.0}
    got = Counter((r.doc_id, r.source) for r in mixing.mix(docs, weights).collect())
    assert got == slow(rows, weights)
    assert not any(s == "c" for _, s in got)


def test_shares_come_out(spark):
    rows, docs = table(spark)
    got = Counter()
    for r in mixing.mix(docs, {"a": 1, "b": 1}).collect():
        got[r.source] += len(r.text.split())
    assert abs(got["a"] / sum(got.values()) - 0.5) < 0.1


def test_copies_are_numbered(spark):
    _, docs = table(spark)
    got = mixing.mix(docs, {"b": 1.0}, copy="copy")
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append(r.copy)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_same_draws_in_any_order(spark):
    _, docs = table(spark)
    a = sorted(r.doc_id for r in mixing.mix(docs).collect())
    b = sorted(r.doc_id for r in mixing.mix(docs.repartition(7)).collect())
    assert a == b


def test_awkward_rows(spark):
    docs = with_clashes(documents(spark, awkward(random.Random(0))))
    got = mixing.mix(docs)
    assert got.columns == docs.columns
    assert got.count() == docs.count()  # one source: its rate is 1
    nothing = documents(spark, [(1, ""), (2, None)])
    assert mixing.mix(nothing).count() == 0
    assert mixing.mix(docs.where("false")).count() == 0


def test_without_broadcast(spark, monkeypatch):
    _, docs = table(spark)
    want = Counter(r.doc_id for r in mixing.mix(docs).collect())
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", 0)
    assert Counter(r.doc_id for r in mixing.mix(docs).collect()) == want


def test_names_and_ids_of_any_kind(spark):
    docs = odd_names(documents(spark, [(k, f"text {k}", "en", "s", 6) for k in range(20)]))
    got = mixing.mix(docs, copy="copy")
    assert got.columns == [c for c in docs.columns if c != "Copy"] + ["copy"] and got.count() == 20
    assert mixing.mix(docs).columns == docs.columns
    named = docs.withColumn("Doc_ID", F.concat(F.lit("n"), F.col("Doc_ID").cast("string")))
    assert mixing.mix(named).count() == 20
