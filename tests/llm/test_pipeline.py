"""The pipeline against the brute-force versions of its stages, over a small fixture."""

import random
from collections import Counter

import corpus_pipeline
from latentmesh.llm import mixing, quality, sharding

from . import test_decontam, test_mixing, test_quality, test_simhash
from .fixtures import documents, words


def corpus(spark, folder):
    rng = random.Random(11)
    bench = [(k, words(rng, 25)) for k in range(5)]
    docs, labels = [], []
    for i in range(260):
        text = words(rng, rng.randint(30, 100))
        bad = i % 5 == 0
        if i % 13 == 6:
            text += " " + bench[i % 5][1]
        if i > 5 and i % 9 == 2:
            text = docs[-1][1] if i % 2 else " ".join(w if rng.random() > 0.03 else "swap" for w in docs[-1][1].split())
        elif bad:
            text = " ".join(w + "###" for w in text.upper().split())
        docs.append((i, text, "en", f"s{i % 3 if i % 2 else 0}", len(text)))
        if not (i > 5 and i % 9 == 2):
            labels.append((i, int(not bad), 0))
    documents(spark, docs).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, bench


def test_stages_equal_brute_force(spark, tmp_path):
    rows, bench = corpus(spark, tmp_path)
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = quality.fit(table, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    good = [r for r in rows if test_quality.slow_score(r[1], model) >= quality.THRESHOLD]
    assert 150 < len(good) < len(rows)
    groups = test_simhash.slow_groups({r[0]: r[1] for r in good}, 28)
    one = [r for r in good if r[0] not in groups]
    assert len(one) < len(good)
    dirty = {d for d, *_ in test_decontam.slow([(r[0], r[1]) for r in one], bench)}
    clean = [r for r in one if r[0] not in dirty]
    assert dirty
    tokens = Counter()
    for r in clean:
        tokens[r[3]] += len(r[1].split())
    want = test_mixing.slow([(r[0], r[1], r[3]) for r in clean], {s: n**mixing.ALPHA for s, n in tokens.items()})

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.source) for r in got) == want
    assert set(got[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars", "shard"}
    of = {}
    assert all(of.setdefault(r.text, r.shard) == r.shard and 0 <= r.shard < sharding.SHARDS for r in got)


def test_stages_keep_the_columns(spark, tmp_path):
    corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "simhash", "decontamination", "mixing", "sharding"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_a_run_can_be_repeated(spark, tmp_path):
    corpus(spark, tmp_path)
    a, b = (sorted((r.doc_id, r.shard) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) for _ in range(2))
    assert a == b
