"""Personal data by a character-level bidirectional LSTM with CRF transitions, in numpy.

``train`` fits the model on labelled spans: passages of at most ``FIT_DOCS``
documents, in order of a hash of ``doc_id``, at most ``PASSAGE`` characters of
each from a place by hash, in which made-up addresses, numbers and keys are set
at known places, besides those that strict patterns find there already.  ``spans`` then decodes every document in full: windows of
``WINDOW`` characters that overlap by ``OVERLAP`` are decoded side by side, and
of overlapping spans of one document's windows those with the most context
around them are taken first, over the document as a whole.  Pieces of a span
that is longer than the overlap, cut by the windows' edges, are joined before.

A CRF tag is a kind or none.  One kind can only follow another after none.

Defined cases: null and empty texts have no spans.  Rows whose ``doc_id`` is null
or no whole number can't be named and are left out; repeated rows give their spans once each.
``start`` and ``end`` count code points.  Other columns are ignored.  With no
document to take passages from, the training passages consist of made-up words.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import opened, whole_number

KINDS = ("email", "phone", "ip", "card", "secret")
TAGS = 1 + len(KINDS)
FIT_DOCS = 1500
PASSAGE = 8000
WINDOW = 768
OVERLAP = 96
HIDDEN = 10
EMBED = 8
STEPS = 700
_BATCH = 2048
_VOCAB = 131
_PAD = 130


def codes(text: str) -> np.ndarray:
    """A class for each character: ASCII as it is, other letters alike, other characters alike."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    small = np.minimum(points, 129).astype(np.uint8)
    small[(points >= 0xC0) & (points != 0xD7) & (points != 0xF7) & ((points < 0x2000) | (points > 0x2BFF))] = 128
    return small


@dataclass
class Tagger:
    """Embeddings (vocabulary, E), gate weights (2, 4H, H + E), biases (2, 4H, 1), output (2, K, H), output bias (K) and transitions (K, K)."""

    embed: np.ndarray
    gates: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    move: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.gates, self.bias, self.out, self.out_bias, self.move]


def fresh_tagger(rng: np.random.Generator, hidden: int = HIDDEN, embed: int = EMBED) -> Tagger:
    f = np.float32
    bias = np.zeros((2, 4 * hidden, 1), f)
    bias[:, hidden : 2 * hidden] = 1
    move = np.zeros((TAGS, TAGS), f)
    move[0, 1:] = move[1:, 0] = -1
    return Tagger(rng.normal(0, 0.5, (_VOCAB, embed)).astype(f), (rng.normal(0, 1, (2, 4 * hidden, hidden + embed)) / np.sqrt(hidden + embed)).astype(f), bias, (rng.normal(0, 1, (2, TAGS, hidden)) / np.sqrt(hidden)).astype(f), np.array([2] + [0] * (TAGS - 1), f), move)


_ALLOWED = np.zeros((TAGS, TAGS), bool)
_ALLOWED[0] = _ALLOWED[:, 0] = True
np.fill_diagonal(_ALLOWED, True)
_NEVER = np.float32(-1e4)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return np.log(np.exp(x - m).sum(axis)) + m.squeeze(axis)


def gradient(model: Tagger, chars: np.ndarray, tags: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean CRF loss of passages (T, B) and its derivatives by each of the model's parts."""
    steps, batch = chars.shape
    hidden = model.out.shape[2]
    both = np.stack([chars, chars[::-1]])  # the second direction runs over the reversed passage
    x = np.zeros((steps + 1, 2, hidden + model.embed.shape[1], batch), np.float32)
    for d in range(2):
        x[:steps, d, hidden:] = model.embed[both[d]].transpose(0, 2, 1)
    gate = np.empty((steps, 2, 4 * hidden, batch), np.float32)
    cell, squashed = np.zeros((steps + 1, 2, hidden, batch), np.float32), np.empty((steps, 2, hidden, batch), np.float32)
    for t in range(steps):
        z = np.matmul(model.gates, x[t]) + model.bias
        z[:, : 3 * hidden] = _sigmoid(z[:, : 3 * hidden])
        z[:, 3 * hidden :] = np.tanh(z[:, 3 * hidden :])
        gate[t] = z
        cell[t + 1] = z[:, hidden : 2 * hidden] * cell[t] + z[:, :hidden] * z[:, 3 * hidden :]
        squashed[t] = np.tanh(cell[t + 1])
        x[t + 1, :, :hidden] = z[:, 2 * hidden : 3 * hidden] * squashed[t]
    h = x[1:, :, :hidden]
    emit = np.matmul(model.out[0], h[:, 0]) + np.matmul(model.out[1], h[::-1, 1]) + model.out_bias[:, None]
    move = np.where(_ALLOWED, model.move, _NEVER)
    alpha, beta = np.empty_like(emit), np.zeros_like(emit)
    alpha[0] = emit[0]
    for t in range(1, steps):
        alpha[t] = _logsum(alpha[t - 1][:, None] + move[:, :, None], 0) + emit[t]
    for t in range(steps - 2, -1, -1):
        beta[t] = _logsum(move[:, :, None] + (emit[t + 1] + beta[t + 1])[None], 1)
    whole = _logsum(alpha[-1], 0)
    gold = np.take_along_axis(emit, tags[:, None], 1).sum((0, 1)) + move[tags[:-1], tags[1:]].sum(0)
    d_emit = np.exp(alpha + beta - whole)
    pair = np.exp(alpha[:-1, :, None] + move[None, :, :, None] + (emit[1:] + beta[1:])[:, None] - whole)
    d_move = pair.sum((0, 3))
    np.subtract.at(d_move, (tags[:-1].ravel(), tags[1:].ravel()), 1)
    hit = np.take_along_axis(d_emit, tags[:, None], 1) - 1
    np.put_along_axis(d_emit, tags[:, None], hit, 1)
    d_emit /= batch
    back = np.stack([d_emit, d_emit[::-1]], axis=1)  # (T, 2, K, B) in each direction's own order
    d_out = np.einsum("tdkb,tdhb->dkh", back, h, optimize=True)
    d_h = np.matmul(model.out.transpose(0, 2, 1), back)
    d_gates, d_bias = np.zeros_like(model.gates), np.zeros_like(model.bias)
    d_x, d_cell, d_next = np.empty_like(x[:steps]), np.zeros((2, hidden, batch), np.float32), np.zeros((2, hidden, batch), np.float32)
    turned = model.gates.transpose(0, 2, 1).copy()
    for t in range(steps - 1, -1, -1):
        i, f, o, g = (gate[t][:, k * hidden : (k + 1) * hidden] for k in range(4))
        dh = d_h[t] + d_next
        dc = d_cell + dh * o * (1 - squashed[t] ** 2)
        dz = np.concatenate([dc * g * i * (1 - i), dc * cell[t] * f * (1 - f), dh * squashed[t] * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        d_gates += np.matmul(dz, x[t].transpose(0, 2, 1))
        d_bias += dz.sum(2, keepdims=True)
        d_x[t] = np.matmul(turned, dz)
        d_next, d_cell = d_x[t][:, :hidden], dc * f
    d_embed = np.zeros_like(model.embed)
    for d in range(2):
        np.add.at(d_embed, both[d].ravel(), d_x[:, d, hidden:].transpose(0, 2, 1).reshape(-1, model.embed.shape[1]))
    return float((whole - gold).mean()), [d_embed, d_gates, d_bias, d_out, d_emit.sum((0, 2)), d_move / batch * _ALLOWED]


def _decode(model: Tagger, chars: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The best tags (T, B) of windows (T, B) of these lengths, the shortest of which tells from where on to mask."""
    steps, batch = chars.shape
    hidden, least = model.out.shape[2], int(lengths.min())
    gates, bias = model.gates.copy(), model.bias.copy()
    gates[:, : 3 * hidden] *= 0.5  # then tanh serves all gates
    bias[:, : 3 * hidden] *= 0.5
    table = np.ascontiguousarray(model.embed.T)
    weights = np.concatenate([gates, bias], axis=2)
    x = np.zeros((2, hidden + len(table) + 1, batch), np.float32)
    x[:, -1] = 1
    z, c, s = np.empty((2, 4 * hidden, batch), np.float32), np.zeros((2, hidden, batch), np.float32), np.empty((2, hidden, batch), np.float32)
    emit = np.empty((steps, TAGS, batch), np.float32)
    emit[:] = model.out_bias[:, None]
    for t in range(steps):
        u = steps - 1 - t
        np.take(table, chars[t], axis=1, out=x[0, hidden:-1], mode="clip")
        np.take(table, chars[u], axis=1, out=x[1, hidden:-1], mode="clip")
        np.matmul(weights, x, out=z)
        np.tanh(z, out=z)
        sig = z[:, : 3 * hidden]
        sig *= 0.5
        sig += 0.5
        c *= z[:, hidden : 2 * hidden]
        np.multiply(z[:, :hidden], z[:, 3 * hidden :], out=s)
        c += s
        if u >= least:  # the second direction starts at each window's own end
            c[1] *= u < lengths
        np.tanh(c, out=s)
        np.multiply(z[:, 2 * hidden : 3 * hidden], s, out=x[:, :hidden])
        emit[t] += model.out[0] @ x[0, :hidden]
        emit[u] += model.out[1] @ x[1, :hidden]
    for t in range(least, steps):
        emit[t, 1:, t >= lengths] = _NEVER
    stay, enter, leave = np.diag(model.move)[1:, None].copy(), model.move[0, 1:, None].copy(), model.move[:, 0, None].copy()
    kept = np.empty((steps, TAGS - 1, batch), bool)
    origin = np.zeros((steps, batch), np.uint8)
    score = emit[0].copy()
    for t in range(1, steps):
        new, old = score[:1] + enter, score[1:] + stay
        np.greater_equal(old, new, out=kept[t])
        ends = score + leave
        top = ends.max(0)
        came = origin[t]
        for k in range(1, TAGS):
            np.copyto(came, k, where=ends[k] == top)
        came[ends[0] == top] = 0
        np.maximum(new, old, out=new)
        score[1:] = new
        score[0] = top
        score += emit[t]
    tags = np.empty((steps, batch), np.uint8)
    now = score.argmax(0).astype(np.uint8)
    tags[-1] = now
    for t in range(steps - 1, 0, -1):
        before = origin[t].copy()
        inside = np.flatnonzero(now)
        if len(inside):
            k = now[inside]
            before[inside] = np.where(kept[t][k - 1, inside], k, 0)
        now = before
        tags[t - 1] = now
    return tags


def windows(length: int, window: int = WINDOW, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Overlapping windows over all of a text."""
    out, at = [], 0
    while True:
        out.append((at, min(length, at + window)))
        if at + window >= length:
            return out
        at += window - overlap


def joined(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """The same, but overlapping pieces of one kind without context, which windows' edges cut, become their union."""
    out, last = [s for s in found if s[3]], {}
    for a, b, kind, _ in sorted(s for s in found if not s[3]):
        if kind in last and a < last[kind][1] <= b:
            a = last[kind][0]
        elif kind in last:
            out.append((*last[kind], kind, 0))
        last[kind] = (a, b)
    return out + [(a, b, kind, 0) for kind, (a, b) in last.items()]


def reconcile(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int]]:
    """Of (start, end, kind, context) those that don't overlap, the most context first; in order of their starts."""
    taken: list[tuple[int, int, int]] = []  # in order, so that a span's neighbours are found by halving
    for a, b, kind, _ in sorted(joined(found), key=lambda s: (-s[3], s[0], -s[1], s[2])):
        at = bisect.bisect_left(taken, (b,))
        if at == 0 or taken[at - 1][1] <= a:
            taken.insert(at, (a, b, kind))
    return taken


def find(model: Tagger, texts: list[str | None], window: int = WINDOW, overlap: int = OVERLAP) -> list[list[tuple[int, int, str]]]:
    """Spans (start, end, kind) of each text."""
    coded = [codes(t) if t else np.zeros(0, np.uint8) for t in texts]
    place = [(row, a, b) for row, c in enumerate(coded) if len(c) for a, b in windows(len(c), window, overlap)]
    place.sort(key=lambda p: p[1] - p[2])
    raw: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
    for lo in range(0, len(place), _BATCH):
        part = place[lo : lo + _BATCH]
        lengths = np.array([b - a for _, a, b in part])
        chars = np.full((len(part), lengths[0]), _PAD, np.uint8)
        for k, (row, a, b) in enumerate(part):
            chars[k, : b - a] = coded[row][a:b]
        tags = _decode(model, np.ascontiguousarray(chars.T), lengths)
        any_tag = np.flatnonzero(tags.any(0))
        for k in any_tag:
            row, a, b = part[k]
            own = np.concatenate([[0], tags[: b - a, k], [0]])
            cuts = np.flatnonzero(own[1:] != own[:-1])
            for s, e in zip(cuts[:-1], cuts[1:]):
                if own[s + 1]:
                    context = min(int(s) if a else window, int(b - a - e) if b < len(coded[row]) else window)
                    raw[row].append((a + int(s), a + int(e), int(own[s + 1]), context))
    return [[(a, b, KINDS[k - 1]) for a, b, k in reconcile(r)] for r in raw]


_STRICT = re.compile(
    r"(?P<email>[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)|(?P<ip>(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.]*\d))|(?P<phone>\+\d{1,2} ?\(\d{3}\) ?\d{3}-\d{4}|\(\d{3}\) \d{3}-\d{4})|(?P<card>(?<!\d)\d{4}(?:[ -]?\d{4}){3}(?!\d))|(?i:token|key|secret|password)\w* ?[=:] ?[\"']?(?P<secret>[A-Za-z0-9_\-]{16,})|(?<![A-Za-z0-9])(?P<key>AKIA[0-9A-Z]{16}|sk-[A-Za-z0-9]{20,}|ghp_[A-Za-z0-9]{30,})(?![A-Za-z0-9])"
)


def labelled(text: str) -> list[tuple[int, int, str]]:
    """Spans that strict patterns find."""
    return [(*m.span(m.lastgroup), "secret" if m.lastgroup == "key" else m.lastgroup) for m in _STRICT.finditer(text)]


def _made_up(rng: np.random.Generator, words: list[str]) -> tuple[str, str, str, str]:
    """What comes before, a value, what comes after, and its kind; the kind is empty for a value that isn't personal."""
    pick = lambda *a: a[int(rng.integers(len(a)))]
    letters = lambda n, a="abcdefghijklmnopqrstuvwxyz": "".join(rng.choice(list(a), int(n)))
    digits = lambda n: letters(n, "0123456789")
    number = lambda a, b: str(int(rng.integers(a, b)))
    some = lambda n: [words[k] for k in rng.integers(0, len(words), n)]
    kind = pick(*KINDS, *KINDS, "", "", "")
    if kind == "email":
        name = lambda n: pick(letters(n), *[w.lower() for w in some(2) if w.isascii() and w.isalpha()])
        user = name(rng.integers(2, 12)) + pick("", pick(".", "_", "-", "+") + name(rng.integers(1, 8))) + pick("", digits(2), "." + digits(2))
        if rng.random() < 0.3:
            user = user.capitalize()
        return "", f"{user}@{pick('mail', 'post', letters(5), letters(8))}{pick('', digits(1), '-' + letters(3))}{pick('', '.example', '.' + letters(5))}.{pick('com', 'org', 'net', 'de', 'fr', 'es', 'io', 'co.uk')}", "", kind
    if kind == "phone":
        a, b, c = digits(3), pick("555", digits(3)), digits(4)
        return "", pick(f"+{number(1, 99)} ({a}) {b}-{c}", f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"+1-{a}-{b}-{c}", f"{a}-{b}-{c}", f"+{number(20, 99)} {a} {b} {c}", f"+1 {a} {b} {c}"), "", kind
    if kind == "ip":
        return "", ".".join(number(1, 256) for _ in range(4)), "", kind
    if kind == "card":
        a = [pick("4", "5", "3", "6", "9", digits(1)) + digits(3), digits(4), digits(4), digits(4)]
        return "", pick("", "", "", " ", "-").join(a), "", kind
    if kind == "secret":
        upper, mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
        marked = pick("AKIA" + letters(16, upper), "AKIA" + letters(16, upper), "sk-" + letters(32, mixed), "ghp_" + letters(36, mixed))
        if rng.random() < 0.4:
            return "", marked, "", kind
        value = pick(letters(40, "0123456789abcdef"), letters(40, "0123456789abcdef"), letters(rng.integers(12, 33), "0123456789abcdef"), letters(24, mixed), marked)
        if rng.random() < 0.15:
            value = value.upper()
        name, quote = pick("token", "token", "api_key", "secret", "password", "password", "key"), pick('"', '"', "'", "", "")
        return f"{name}{pick(' = ', '=', ': ')}{quote}", value, quote, kind
    if rng.random() < 0.3:
        return pick("Version ", "v", f"{letters(3).upper()} ", f"{letters(2).upper()}-{letters(2).upper()} ", f"{letters(5)} "), f"{number(0, 20)}.{number(0, 20)}{pick('', '.' + number(0, 20), '.')}", "", ""
    if rng.random() < 0.4:
        return "", pick(letters(rng.integers(4, 22)), letters(rng.integers(4, 12)).capitalize(), letters(rng.integers(3, 9)) + "." + letters(3), "".join(some(3)), "".join(some(2)).upper(), letters(rng.integers(4, 16)).upper() + "!!"), "", ""
    return "", pick(number(0, 100), number(0, 5000), f"{number(0, 10)}.{number(0, 10)}", f"{number(1, 10)}.{number(0, 30)}.{number(0, 9)}", f"20{digits(2)}-{number(1, 13)}-{number(1, 32)}", f"{number(0, 24)}:{digits(2)}", f"${number(1, 900)}.{digits(2)}", f"https://{letters(6)}.{letters(3)}/{letters(5)}", f"@{letters(6)}", f'"{letters(6)}"', f"({digits(4)})", f"{number(1, 100)}%", f"{letters(4)}.{letters(3)}", f"n = {number(0, 99)}", f"+{number(1, 50)}"), "", ""


def passages(texts: list[str], n: int, steps: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """``n`` labelled passages of ``steps`` characters: characters and tags, (T, n)."""
    chars, tags = np.full((steps, n), 32, np.int64), np.zeros((steps, n), np.int64)
    words = [w.strip(".,|*#&%$!") or "a" for k in rng.integers(0, len(texts), 20) for w in texts[k].split()] or ["a"]
    for k in range(n):
        text = texts[int(rng.integers(len(texts)))]
        at = int(rng.integers(max(1, len(text) - steps // 2)))
        text = text[at : at + steps]
        spans = [(a, b, kind) for a, b, kind in labelled(text)]
        for _ in range(int(rng.integers(0, 4))):
            before, value, after, kind = _made_up(rng, words)
            gaps = [m.end() for m in re.finditer(r"\s", text)] or [0]
            place = gaps[int(rng.integers(len(gaps)))]
            if any(a < place <= b for a, b, _ in spans):
                continue
            end = ["", "", "", ".", ",", "***", "!!", "&&&"][int(rng.integers(8))] + ["", " ", " ", " ", "\n"][int(rng.integers(5)) if text[place:] == "" else 1 + int(rng.integers(4))]
            put = before + value + after + end
            spans = [(a, b, s) if b <= place else (a + len(put), b + len(put), s) for a, b, s in spans]
            if kind:
                spans.append((place + len(before), place + len(before) + len(value), kind))
            text = text[:place] + put + text[place:]
        text, c = text[:steps], codes(text)[:steps]
        chars[: len(c), k] = c
        chars[len(c) :, k] = _PAD
        for a, b, kind in spans:
            tags[a : min(b, steps), k] = 1 + KINDS.index(kind)
    return chars, tags


def fit(texts: list[str], steps: int = STEPS, seed: int = 0, batch: int = 96, length: int = 128) -> Tagger:
    """A tagger from passages of ``texts``, by Adam with a falling rate."""
    rng = np.random.default_rng(seed)
    texts = [t for t in texts if t and len(t) > 20] or ["".join(rng.choice(list("etaoinshr "), 400)) for _ in range(20)]
    model = fresh_tagger(rng)
    first, second = [np.zeros_like(p) for p in model.parts()], [np.zeros_like(p) for p in model.parts()]
    for step in range(1, steps + 1):
        chars, tags = passages(texts, batch, length, rng)
        _, grads = gradient(model, chars, tags)
        norm = np.sqrt(sum(float((g.astype(np.float64) ** 2).sum()) for g in grads))
        rate = 0.02 * min(1, step / 30) * 0.5 * (1 + np.cos(np.pi * step / (steps + 1)))
        for p, g, m, v in zip(model.parts(), grads, first, second):
            g = g * min(1.0, 5.0 / max(norm, 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def train(docs: DataFrame, fit_docs: int = FIT_DOCS, seed: int = 0) -> Tagger:
    """A tagger from passages of at most ``fit_docs`` documents."""
    texts = opened(docs, "doc_id", "text")[0].select(whole_number("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    chosen = texts.select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(fit_docs)
    # at most fit_docs ids, so the size of this side is bounded
    # and from anywhere in a text at most PASSAGE characters
    start = (1 + F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.greatest(F.length("text") - PASSAGE, F.lit(0)) + 1)).cast("int")
    rows = texts.join(F.broadcast(chosen.distinct()), "doc_id", "left_semi").select("doc_id", F.substring(F.col("text"), start, F.lit(PASSAGE)).alias("text")).orderBy("doc_id", "text").limit(fit_docs).collect()
    return fit([r.text for r in rows], seed=seed)


def spans(docs: DataFrame, model: Tagger | None = None) -> DataFrame:
    """``doc_id, start, end, kind, value`` of everything personal in every document."""
    tagger = docs.sparkSession.sparkContext.broadcast(train(docs) if model is None else model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = [(i, a, b, kind, t[a:b]) for i, t, found in zip(ids, texts, find(tagger.value, texts)) for a, b, kind in found]
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string()), pa.array(columns[4], pa.string())], names=["doc_id", "start", "end", "kind", "value"])

    named = opened(docs, "doc_id", "text")[0].select(whole_number("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    return named.mapInArrow(run, "doc_id long, start long, end long, kind string, value string")
