import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from latentmesh.llm import quality

from .fixtures import awkward, documents, odd_names, with_clashes, words


def labelled(spark, n=400):
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(n):
        text = words(rng, rng.randint(20, 120))
        bad, toxic = i % 4 == 0, i % 10 == 3
        if bad:
            text = " ".join(w + "###" for w in text.upper().split())
        if toxic:
            parts = text.split()
            parts[len(parts) // 2] = "nastyword"
            text = " ".join(parts)
        docs.append((i, text))
        labels.append((i, int(not bad), int(toxic)))
    return documents(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: q == 1 and t == 0 for i, q, t in labels}


def slow_score(text, model):
    text = text or ""
    lower = text.lower()
    tokens = lower.split()
    rate = lambda a, b: a / b if b else 0.0
    terms = len(re.findall(r"(?<![^\W_])(?:" + "|".join([re.escape(t.rstrip("*")) + ("" if t.endswith("*") else r"(?![^\W_])") for t in model.terms]) + ")", lower)) if model.terms else 0
    stats = {
        "n_chars": len(text), "n_words": len(tokens), "n_lines": text.count("\n"), "word_chars": rate(len(text), len(tokens)), "distinct": rate(len(set(tokens)), len(tokens)),
        "upper": rate(sum(c.isupper() for c in text), len(text)), "symbols": rate(sum(not (c.isalnum() or c.isspace() or c in ".,") for c in text), len(text)),
        "bars": rate(text.count("|"), len(text)), "digits": rate(sum(c in "0123456789" for c in text), len(text)), "terms": terms, "term_rate": rate(terms, len(tokens)),
    }
    margin = model.bias + sum(r.weight for r in model.rules if all((stats[n] > at) == above for n, at, above in r.parts))
    return 1 / (1 + math.exp(-margin))


def test_fit_and_score_against_brute_force(spark):
    docs, labels, good = labelled(spark)
    model = quality.fit(docs, labels)
    assert "nastyword" in model.terms
    rows = quality.score(docs, model).collect()
    for r in rows:
        assert abs(r.score - slow_score(r.text, model)) < 1e-9
    assert sum((r.score >= 0.5) == good[r.doc_id] for r in rows) >= 0.97 * len(rows)


def test_held_out_accuracy(spark):
    docs, labels, good = labelled(spark)
    model = quality.fit(docs, labels.where("doc_id % 2 = 0 or doc_id % 10 = 3"))
    rest = [r for r in quality.score(docs, model).collect() if r.doc_id % 2]
    assert sum((r.score >= 0.5) == good[r.doc_id] for r in rest) >= 0.95 * len(rest)


def test_fit_is_bounded(spark):
    docs, labels, _ = labelled(spark, 100)
    assert quality.fit(docs, labels, fit_rows=40) == quality.fit(docs, labels, fit_rows=40)


def test_awkward_rows(spark):
    docs, labels, _ = labelled(spark, 200)
    model = quality.fit(docs, labels)
    odd = with_clashes(documents(spark, awkward(random.Random(1))))
    scored = quality.score(odd.drop("score"), model)
    assert scored.count() == odd.count()
    zeros = {round(r.score, 12) for r in scored.where("text is null or text = ''").collect()}
    assert len(zeros) == 1
    kept = quality.kept(odd, model)
    assert kept.columns == odd.columns
    for r in scored.where("text is not null").collect():
        assert abs(r.score - slow_score(r.text, model)) < 1e-9


def test_nothing_to_fit(spark):
    docs = documents(spark, [(1, "a b c")])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, none)
    assert quality.kept(docs, model).count() == 1
    one = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (2, None, 1)], "doc_id long, quality int, toxic int")
    assert quality.fit(docs, one) == quality.Model()
    assert quality.score(docs.where("false"), model).count() == 0


def test_lasso_zeroes_noise():
    rng = np.random.default_rng(0)
    z = rng.integers(0, 2, (600, 12)).astype(np.float32)
    y = (rng.random(600) < 1 / (1 + np.exp(-(4 * z[:, 0] - 2)))).astype(np.float32)
    w, _ = quality.lasso_logistic(z, y, 0.03, 2000)
    assert w[0] > 1 and np.abs(w[1:]).max() < 0.2 * w[0] and (w == 0).sum() >= 6


def test_names_and_ids_of_any_kind(spark):
    docs, labels, _ = labelled(spark, 200)
    text = F.concat(F.lit("0"), F.col("doc_id").cast("string"))
    model = quality.fit(odd_names(docs.withColumn("doc_id", text)), labels.withColumn("doc_id", text).withColumnRenamed("toxic", "Toxic"))
    assert model == quality.fit(docs, labels)
    odd = odd_names(docs)
    assert quality.kept(odd, model).columns == odd.columns
    assert quality.score(odd, model).columns == [c for c in odd.columns if c != "Score"] + ["score"]


def test_terms_are_those_that_chance_would_not_make(spark):
    """Texts that begin alike count apart, near copies count once, and there is no most of terms."""
    rng = random.Random(6)
    header, slurs = words(rng, 30), [words(rng, 1) + "zzzz" + "abcdefghij"[k % 10] * 3 + str(k) for k in range(90)]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 6 == 0
        text = words(rng, 40).split()
        if toxic:
            text += [s for s in slurs if rng.random() < 0.4]
            rng.shuffle(text)
        rows.append((i, header + " " + " ".join(text)))
        labels.append((i, 1, int(toxic)))
    copied = words(rng, 60)
    for i in range(600, 660):  # one toxic text with a word changed in each copy
        parts = copied.split()
        parts[i % 60] = "changed"
        rows.append((i, " ".join(parts)))
        labels.append((i, 1, 1))
    model = quality.fit(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    stems = [t.rstrip("*") for t in model.terms]
    assert all(any(s.startswith(t) if f"{t}*" in model.terms else s == t for t in stems) for s in slurs)
    assert not any(w.startswith(t) for w in copied.split() if len(w) > 3 for t in stems)


def slow_paths(x, y, rows, depth, least, path=()):
    """The paths of the best regression tree on ``y`` by trying every cut of every statistic."""
    out = [path] if path else []
    if depth == 0 or len(rows) < 2 * least:
        return out
    best, choice = 1e-9, None
    for f in range(x.shape[1]):
        values = sorted(set(x[rows, f]))
        for low, high in zip(values, values[1:]):
            cut = (low + high) / 2
            a, b = [r for r in rows if x[r, f] <= cut], [r for r in rows if x[r, f] > cut]
            if len(a) >= least and len(b) >= least:
                gain = sum(y[a]) ** 2 / len(a) + sum(y[b]) ** 2 / len(b) - sum(y[rows]) ** 2 / len(rows)
                if gain > best + 1e-12:
                    best, choice = gain, (f, cut, a, b)
    if choice:
        f, cut, a, b = choice
        out += slow_paths(x, y, a, depth - 1, least, (*path, (f, cut, False))) + slow_paths(x, y, b, depth - 1, least, (*path, (f, cut, True)))
    return out


def test_trees_equal_brute_force():
    for seed in range(5):
        rng = np.random.default_rng(seed)
        x, y = rng.integers(0, 9, (60, 4)).astype(float) + rng.random((60, 4)), rng.normal(size=60)
        found: list = []
        quality._grow(x, y, np.arange(60), 3, 5, (), found)
        assert found == slow_paths(x, y, list(range(60)), 3, 5)


def test_lasso_is_at_the_least_of_its_objective():
    """No weight can be moved a little, alone, to lower the penalised loss; that suffices for a convex one."""
    rng = np.random.default_rng(1)
    z = rng.integers(0, 2, (400, 8)).astype(np.float32)
    y = (rng.random(400) < 1 / (1 + np.exp(-(2 * z[:, 0] - 3 * z[:, 1] + 0.5)))).astype(np.float32)
    w, b = quality.lasso_logistic(z, y, 0.01, 4000)

    def loss(v):
        m = z.astype(float) @ v[:-1] + v[-1]
        return float(np.mean(np.logaddexp(0, m) - y * m) + 0.01 * np.abs(v[:-1]).sum())

    at = np.append(w.astype(float), b)
    for k in range(9):
        for step in (1e-2, -1e-2):
            moved = at.copy()
            moved[k] += step
            assert loss(moved) >= loss(at) - 1e-7
