import itertools
import random
import time

import numpy as np
import pytest

from latentmesh.llm import pii

from .fixtures import awkward, documents, odd_names, with_clashes, words


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(0)
    return [words(rng, 200) for _ in range(40)]


@pytest.fixture(scope="module")
def model(texts):
    return pii.fit(texts, steps=450)


def planted(n=60):
    """Texts over several windows with spans at known places."""
    rng, draw = random.Random(7), np.random.default_rng(7)
    out = []
    for _ in range(n):
        text, spans = words(rng, rng.randint(5, 400)) + " ", []
        for _ in range(rng.randint(0, 4)):
            before, value, after, kind = pii._made_up(draw, ["alpha", "beta", "gamma"])
            if kind:
                spans.append((len(text) + len(before), len(text) + len(before) + len(value), kind))
            text += before + value + after + " " + words(rng, rng.randint(1, 150)) + " "
        out.append((text, spans))
    return out


def test_gradient_equals_differences():
    rng = np.random.default_rng(1)
    m = pii.fresh_tagger(rng, 4, 3)
    for k in ("embed", "gates", "bias", "out", "out_bias", "move"):
        setattr(m, k, getattr(m, k).astype(np.float64))
    chars = rng.integers(0, 131, (7, 3))
    tags = np.array([[0, 1, 1, 0, 2, 0, 0], [0, 0, 0, 0, 0, 3, 3], [5, 5, 0, 1, 0, 0, 0]]).T
    _, grads = pii.gradient(m, chars, tags)
    for p, g in zip(m.parts(), grads):
        for _ in range(8):
            i = tuple(int(rng.integers(s)) for s in p.shape)
            if p is m.move and not pii._ALLOWED[i]:
                continue
            old, e = p[i], 1e-4
            p[i] = old + e
            up = pii.gradient(m, chars, tags)[0]
            p[i] = old - e
            down = pii.gradient(m, chars, tags)[0]
            p[i] = old
            assert abs((up - down) / (2 * e) - g[i]) < 1e-3


def slow_emissions(m, chars):
    """One window, one step at a time, in double precision."""
    hidden, out = m.out.shape[2], np.tile(m.out_bias.astype(float), (len(chars), 1))
    for d in range(2):
        h, c = np.zeros(hidden), np.zeros(hidden)
        for t in range(len(chars)) if d == 0 else range(len(chars) - 1, -1, -1):
            z = m.gates[d].astype(float) @ np.concatenate([h, m.embed[chars[t]]]) + m.bias[d, :, 0]
            i, f, o = (1 / (1 + np.exp(-z[k * hidden : (k + 1) * hidden])) for k in range(3))
            c = f * c + i * np.tanh(z[3 * hidden :])
            h = o * np.tanh(c)
            out[t] += m.out[d] @ h
    return out


def test_decoding_equals_brute_force():
    rng = np.random.default_rng(3)
    m = pii.fresh_tagger(rng, 5, 4)
    m.out *= 4
    lengths = np.array([6, 5, 3])
    chars = rng.integers(0, 128, (6, 3)).astype(np.uint8)
    got = pii._decode(m, chars, lengths)
    for k, n in enumerate(lengths):
        emit = slow_emissions(m, chars[:n, k])

        def value(path, emit=emit):
            s = sum(emit[t, g] for t, g in enumerate(path))
            return s + sum(m.move[a, b] if pii._ALLOWED[a, b] else -1e4 for a, b in zip(path, path[1:]))

        best = max(itertools.product(range(pii.TAGS), repeat=int(n)), key=value)
        assert value(best) - value(tuple(int(x) for x in got[:n, k])) < 1e-4
        assert not got[n:, k].any()


def test_held_out_accuracy(model):
    cases = planted()
    found = pii.find(model, [t for t, _ in cases])
    want = {(k, *s) for k, (_, spans) in enumerate(cases) for s in spans}
    got = {(k, *s) for k, spans in enumerate(found) for s in spans}
    touched = sum(any(k == q and a < y and x < b for q, x, y, _ in got) for k, a, b, _ in want)
    assert touched >= 0.95 * len(want)
    assert len(want & got) >= 0.85 * len(want)
    assert len(got - want) <= 0.25 * len(want)


def test_windows_cover_and_reconcile(model):
    for n in (1, 95, 96, 768, 769, 5000):
        w = pii.windows(n, 768, 96)
        assert w[0][0] == 0 and w[-1][1] == n and all(a[1] - b[0] == 96 for a, b in zip(w, w[1:]))
    assert pii.reconcile([(0, 5, 1, 3), (3, 9, 2, 9), (9, 12, 1, 1), (3, 9, 2, 2)]) == [(3, 9, 2), (9, 12, 1)]
    cases = [t for t, _ in planted(20)]
    whole, cut = pii.find(model, cases, 100_000, 96), pii.find(model, cases, 300, 96)
    a, b = ({(k, *s) for k, f in enumerate(x) for s in f} for x in (whole, cut))
    assert len(a & b) >= 0.95 * max(len(a), len(b))


@pytest.mark.parametrize(("start", "length"), [(660, 120), (600, 97), (10, 96), (700, 2500), (0, 3000)])
def test_spans_longer_than_the_overlap_stay_whole(monkeypatch, start, length):
    monkeypatch.setattr(pii, "_decode", lambda model, chars, lengths: np.where(chars == pii.codes("X")[0], 5, 0).astype(np.uint8))
    text = "a" * start + "X" * length + "a" * 900 + "X" * 20 + "a" * 500
    want = [(start, start + length, "secret"), (start + length + 900, start + length + 920, "secret")]
    assert pii.find(None, [text]) == [want]


def test_awkward_rows(spark, model):
    rows = awkward(random.Random(0)) + [(20, "mail me.22@mail4.example.com now"), (20, "mail me.22@mail4.example.com now"), (None, "x@mail.example.com")]
    rows.append((21, "word " * 30_000 + "some one.33@mail2.example.com " + "word " * 100))
    got = pii.spans(with_clashes(documents(spark, rows)), model).collect()
    by = [(r.doc_id, r.value) for r in got]
    assert by.count((20, "me.22@mail4.example.com")) == 2
    assert (21, "one.33@mail2.example.com") in by
    texts = dict(rows)
    assert all(texts[r.doc_id][r.start : r.end] == r.value for r in got)
    assert not {3, 4, 5, 7, None} & {r.doc_id for r in got}


def test_training_reads_the_table(spark, texts):
    docs = documents(spark, list(enumerate(texts)))
    seen = {}
    real = pii.fit
    pii.fit = lambda t, seed=0: seen.setdefault("texts", t)
    try:
        pii.train(docs, fit_docs=10)
        assert len(seen.pop("texts")) == 10
        pii.train(docs.where("false"))
        assert seen["texts"] == []
    finally:
        pii.fit = real
    assert real([], steps=1, batch=4, length=16)
    assert pii.spans(docs.where("false"), real([], steps=1, batch=4, length=16)).count() == 0


def test_names_and_ids_of_any_kind(spark, model):
    docs = documents(spark, [(1, "write to someone@mail.example.com today"), (2, "nothing")])
    assert sorted(pii.spans(odd_names(docs), model).collect()) == sorted(pii.spans(docs, model).collect())
    assert pii.spans(docs.selectExpr("concat('n', doc_id) AS doc_id", "text"), model).count() == 0


def test_many_spans_are_reconciled_in_good_time():
    """Against the plain rule on few, and quickly on many."""
    rng = random.Random(1)

    def slow(found):
        taken = []
        for a, b, kind, _ in sorted(pii.joined(found), key=lambda s: (-s[3], s[0], -s[1], s[2])):
            if all(b <= x or y <= a for x, y, _ in taken):
                taken.append((a, b, kind))
        return sorted(taken)

    for n in (3, 30, 300):
        found = [(a, a + rng.randint(1, 20), rng.randint(1, 5), rng.randint(0, 4)) for a in (rng.randrange(4 * n) for _ in range(n))]
        assert pii.reconcile(found) == slow(found)
    began = time.process_time()
    assert len(pii.reconcile([(k, k + 3, 1, 1 + k % 50) for k in range(0, 800_000, 2)])) > 100_000
    assert time.process_time() - began < 20
