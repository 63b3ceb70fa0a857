"""Quality classifier: a sparse ensemble of rules over document statistics.

After Friedman and Popescu (2008): small regression trees are boosted on the
labelled statistics, every path from a root becomes a conjunctive rule, a
lasso-penalised logistic regression weighs the rules, and those that keep a
weight are compiled into one Spark column expression.  A document is good if it
is labelled ``quality = 1`` and not ``toxic = 1``.

Two of the statistics count terms found in the labelled documents: words of at
least ``LEAST_LETTERS`` letters, and beginnings of words of as many and up to
``LONGEST_START``, that toxic documents use and hardly any other one.  Near
copies count as one document, and a term is taken if chance would hardly make
any candidate as one-sided: the share of toxic documents to the power of those
that have it, times the number of candidates, must be at most ``FALSE_TERMS``.
Every term that passes is used.

The fit uses at most ``FIT_ROWS`` labelled documents, taken in order of a hash
of ``doc_id``; everything else covers all rows.

Defined cases: a null text counts as an empty one; every statistic of an empty
text is 0, so it gets the score of the rules that hold for zeros.  Other
columns, nulls among them, are carried along, whatever their names.  Labels that
are null or that contradict each other for a ``doc_id`` aren't used, nor those
of an id that isn't a whole number.  Without a good and a rejected label nothing
can be fitted and every document keeps the score 1.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .shared import opened, temporary, whole_number, written

#: Labelled documents used for fitting, at most.
FIT_ROWS = 12000
LEAST_LETTERS = 4
LONGEST_START = 8
#: A term's uses outside of toxic documents, as a share of all, and how many terms chance may make.
STRAY_USES = 0.03
FALSE_TERMS = 0.1
#: A document is kept if its probability of being good is at least this.
THRESHOLD = 0.5
STATISTICS = ("n_chars", "n_words", "n_lines", "word_chars", "distinct", "upper", "symbols", "bars", "digits", "terms", "term_rate")
_COUNTS = ("chars", "words", "lines", "kinds", "upper", "symbols", "bars", "digits", "terms")


def counts(text: Column, terms: tuple[str, ...] = ()) -> dict[str, Column]:
    """What the statistics are made of, as JVM expressions over the whole text."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    chars, lower = F.length(text), F.lower(text)
    words = F.split(lower, r"\s+")
    edges = text.rlike(r"^\s").cast("int") + text.rlike(r"\s\z").cast("int")
    full = text.rlike(r"\S")
    left = lambda pattern: F.length(F.regexp_replace(text, pattern, ""))
    without = lambda mark: chars - F.length(F.replace(text, F.lit(mark), F.lit("")))
    return {
        "chars": chars,
        "words": F.when(full, F.size(words) - edges).otherwise(F.lit(0)),
        "lines": without("\n"),
        "kinds": F.when(full, F.size(F.array_distinct(words)) - F.least(edges, F.lit(1))).otherwise(F.lit(0)),
        "upper": left(r"[^\p{Lu}]++"),
        "symbols": left(r"[\p{L}\p{N}\s.,]++"),
        "bars": without("|"),
        "digits": left(r"[^0-9]++"),
        "terms": F.regexp_count(lower, F.lit(_pattern(terms))) if terms else F.lit(0),
    }


def statistics(held: dict[str, Column]) -> dict[str, Column]:
    """The statistics by name from columns that hold the counts."""
    rate = lambda part, whole: F.when(held[whole] > 0, held[part] / held[whole]).otherwise(F.lit(0.0))
    return {
        "n_chars": held["chars"].cast("double"),
        "n_words": held["words"].cast("double"),
        "n_lines": held["lines"].cast("double"),
        "word_chars": rate("chars", "words"),
        "distinct": rate("kinds", "words"),
        "upper": rate("upper", "chars"),
        "symbols": rate("symbols", "chars"),
        "bars": rate("bars", "chars"),
        "digits": rate("digits", "chars"),
        "terms": held["terms"].cast("double"),
        "term_rate": rate("terms", "words"),
    }


def _pattern(terms: tuple[str, ...]) -> str:
    """Terms that end in ``*`` are beginnings of words."""
    whole = sorted(re.escape(t) for t in terms if not t.endswith("*"))
    starts = sorted(re.escape(t[:-1]) for t in terms if t.endswith("*"))
    either = [f"(?:{'|'.join(whole)})(?![\\p{{L}}\\p{{N}}])"] * bool(whole) + [f"(?:{'|'.join(starts)})"] * bool(starts)
    return rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(either)})"


@dataclass(frozen=True)
class Rule:
    """``weight`` holds where every (statistic, threshold, above) does: above means greater, else at most."""

    parts: tuple[tuple[str, float, bool], ...]
    weight: float = 0.0


@dataclass(frozen=True)
class Model:
    rules: tuple[Rule, ...] = ()
    bias: float = 100.0
    terms: tuple[str, ...] = field(default=())

    def margin(self, columns: dict[str, Column]) -> Column:
        """The log odds of being good as one column expression."""
        total = F.lit(self.bias)
        for rule in self.rules:
            holds = F.lit(True)
            for name, at, above in rule.parts:
                holds = holds & ((columns[name] > at) if above else (columns[name] <= at))
            total = total + F.when(holds, F.lit(rule.weight)).otherwise(F.lit(0.0))
        return total


def _grow(x: np.ndarray, residual: np.ndarray, rows: np.ndarray, depth: int, least: int, path: tuple, out: list[tuple]) -> np.ndarray:
    """A regression tree on ``residual``; adds its paths to ``out`` and returns its predictions for ``rows``."""
    value = np.full(len(rows), residual[rows].mean())
    if path:
        out.append(path)
    if depth == 0 or len(rows) < 2 * least:
        return value
    best, choice = 1e-9, None
    r = residual[rows]
    total = r.sum()
    for f in range(x.shape[1]):
        order = np.argsort(x[rows, f], kind="stable")
        v, s = x[rows[order], f], np.cumsum(r[order])[:-1]
        n = np.arange(1, len(rows))
        gain = s**2 / n + (total - s) ** 2 / (len(rows) - n) - total**2 / len(rows)
        gain[(v[1:] == v[:-1]) | (n < least) | (len(rows) - n < least)] = 0
        k = int(gain.argmax()) if len(gain) else 0
        if len(gain) and gain[k] > best:
            best, choice = gain[k], (f, float((v[k] + v[k + 1]) / 2))
    if choice is None:
        return value
    f, at = choice
    high = x[rows, f] > at
    for side in (False, True):
        value[high == side] = _grow(x, residual, rows[high == side], depth - 1, least, (*path, (f, at, side)), out)
    return value


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.2, seed: int = 0) -> list[tuple]:
    """The paths of boosted trees, each grown on half of the rows."""
    rng = np.random.default_rng(seed)
    score, found = np.zeros(len(y)), []
    least = max(5, len(y) // 400)
    for _ in range(trees):
        residual = y - 1 / (1 + np.exp(-score))
        rows = np.sort(rng.choice(len(y), max(1, (len(y) + 1) // 2), replace=False))
        paths: list[tuple] = []
        _grow(x, residual, rows, depth, least, (), paths)
        for path in paths:
            held = np.all([(x[:, f] > at) == above for f, at, above in path], axis=0)
            if len(path) == depth and held.any():
                score[held] += rate * 4 * residual[held].mean()
        found += paths
    return list(dict.fromkeys(tuple(sorted(p)) for p in found))


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the mean logistic loss plus ``penalty`` times their absolute sum, by accelerated proximal steps."""
    n, m = z.shape
    one = np.hstack([z, np.ones((n, 1))]).astype(np.float32)
    v = np.ones(m + 1, dtype=np.float32)
    for _ in range(30):
        v = one.T @ (one @ v)
        v /= np.linalg.norm(v) or 1
    step = 4 * n / max(float(v @ (one.T @ (one @ v))), 1e-9) / 1.01
    w = look = np.zeros(m + 1, dtype=np.float32)
    t = 1.0
    for _ in range(steps):
        g = one.T @ (1 / (1 + np.exp(-(one @ look))) - y) / np.float32(n)
        new = (look - np.float32(step) * g).astype(np.float32)
        new[:m] = np.sign(new[:m]) * np.maximum(np.abs(new[:m]) - step * penalty, 0)
        u = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look = new + np.float32((t - 1) / u) * (new - w)
        w, t = new, u
    return w[:m], float(w[m])


def fit_rules(x: np.ndarray, y: np.ndarray, names: tuple[str, ...] = STATISTICS, penalty: float = 0.001, seed: int = 0) -> tuple[tuple[Rule, ...], float]:
    """Rules with a weight, and the bias; the classes weigh the same in neither the trees nor the lasso."""
    paths = tree_rules(x, y, seed=seed)
    if not paths:
        p = min(max(y.mean(), 1e-6), 1 - 1e-6)
        return (), float(np.log(p / (1 - p)))
    held = np.stack([np.all([(x[:, f] > at) == above for f, at, above in path], axis=0) for path in paths], axis=1)
    # of rules that hold for the same rows one is enough
    _, first = np.unique(held, axis=1, return_index=True)
    paths, z = [paths[k] for k in sorted(first)], held[:, sorted(first)].astype(np.float32)
    weights, bias = lasso_logistic(z, y.astype(np.float32), penalty)
    kept = [Rule(tuple((names[f], at, above) for f, at, above in path), float(w)) for path, w in zip(paths, weights) if abs(w) > 1e-6]
    return tuple(sorted(kept, key=lambda r: -abs(r.weight))), bias


def _classes(sample: DataFrame) -> dict[int, int]:
    """Classes of near copies among the toxic documents of the bounded sample, by fingerprints as those of ``simhash``."""
    rows = simhash.signatures(sample.where("toxic").select("doc_id", "text")).orderBy("doc_id").collect()
    prints = np.array([(r.f0, r.f1) for r in rows], np.int64).reshape(-1, 2).T.copy().view(np.uint64)
    return {r.doc_id: int(c) for r, c in zip(rows, simhash.labels(prints, simhash.RADIUS))}


def _terms(sample: DataFrame) -> tuple[str, ...]:
    """Words and beginnings of words that tell the toxic documents of the sample from the others."""
    spark = sample.sparkSession
    classes = spark.createDataFrame(list(_classes(sample).items()), "doc_id long, class long")
    n, toxic = sample.agg(F.count_distinct("doc_id"), F.count_distinct(F.when(F.col("toxic"), F.col("doc_id")))).first()
    if not toxic or toxic == n:
        return ()
    words = sample.select("doc_id", "toxic", F.explode(F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= LEAST_LETTERS))).alias("word"))
    starts = F.transform(F.filter(F.sequence(F.lit(LEAST_LETTERS), F.lit(LONGEST_START)), lambda k: k < F.length("word")), lambda k: F.concat(F.substring(F.col("word"), F.lit(1), k), F.lit("*")))
    term = F.explode(F.concat(F.array("word"), starts)).alias("term")
    each = words.groupBy("word").agg(F.sum(F.col("toxic").cast("int")).alias("bad"), F.count("*").alias("uses"))
    by_term = written(each.select("bad", "uses", term).groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("uses").alias("uses")).where("bad > 0"), "quality-terms")
    need = math.log(max(1, by_term.count()) / FALSE_TERMS) / math.log(n / toxic)
    every = by_term.where((F.col("bad") >= need) & (F.col("bad") >= (1 - STRAY_USES) * F.col("uses"))).select("term", "bad")
    # at most fit_rows classes, so the size of this side is bounded
    found = words.where("toxic").join(F.broadcast(classes), "doc_id").select("class", "word", term).join(every, "term").groupBy("term", "bad").agg(F.count_distinct("class").alias("texts"), F.count_distinct("word").alias("forms")).where(F.col("texts") >= need)
    chosen: list[str] = []
    for row in found.orderBy(F.desc("bad"), F.length("term"), "term").collect():
        stem = row.term.rstrip("*")
        if not any(c.endswith("*") and stem.startswith(c[:-1]) or c.rstrip("*") == stem for c in chosen) and not (row.term.endswith("*") and row.forms < 2):
            chosen.append(row.term)
    return tuple(chosen)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, seed: int = 0) -> Model:
    """A model from at most ``fit_rows`` labelled documents."""
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) != 1)
    known = opened(labels, "doc_id", "quality", "toxic")[0].withColumn("doc_id", whole_number("doc_id")).where("doc_id is not null and quality is not null")
    marks = known.groupBy("doc_id").agg(F.min(good).alias("good"), F.max(good).alias("best"), F.max(F.coalesce("toxic", F.lit(0)) == 1).alias("toxic")).where("good = best")
    chosen = marks.select("doc_id", "good", "toxic").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(fit_rows)
    ids = [tuple(r) for r in chosen.collect()]
    if len({good for _, good, _ in ids}) < 2:
        return Model()
    # at most fit_rows ids, so the size of this side is bounded
    spark = docs.sparkSession
    named = F.broadcast(spark.createDataFrame(ids, "doc_id long, good boolean, toxic boolean"))
    with temporary(spark):
        sample = written(opened(docs, "doc_id", "text")[0].select(whole_number("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text")).join(named, "doc_id"), "quality-sample")
        terms = _terms(sample)
        held = sample.select("good", *[c.alias(n) for n, c in counts(F.col("text"), terms).items()])
        rows = held.select("good", *[c.alias(n) for n, c in statistics({n: F.col(n) for n in _COUNTS}).items()]).toPandas()
    if rows.empty or rows["good"].nunique() < 2:
        return Model()
    rows = rows.sort_values([*STATISTICS, "good"])
    rules, bias = fit_rules(rows[list(STATISTICS)].to_numpy(float), rows["good"].to_numpy(float), seed=seed)
    return Model(rules, bias, terms)


def _scored(held: DataFrame, model: Model) -> DataFrame:
    """``held`` with the probability of being good in column ``quality_score``."""
    of_counts, of_statistics = [f"count_{n}" for n in _COUNTS], [f"stat_{n}" for n in STATISTICS]
    # a generator, so that the optimiser can't put the counts in place of each use of them
    once = F.inline(F.array(F.struct(*[c.alias(n) for n, c in zip(of_counts, counts(F.col("text"), model.terms).values())])))
    wide = held.select("*", once)
    wide = wide.withColumns(dict(zip(of_statistics, statistics(dict(zip(_COUNTS, map(F.col, of_counts)))).values())))
    margin = model.margin(dict(zip(STATISTICS, map(F.col, of_statistics))))
    return wide.withColumn("quality_score", 1 / (1 + F.exp(-margin)))


def score(docs: DataFrame, model: Model, to: str = "score") -> DataFrame:
    """``docs`` with the probability of being good in column ``to``, which replaces one of that name."""
    held, closed = opened(docs, "text")
    return closed(_scored(held, model), **{to: "quality_score"})


def kept(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those that the model rejects; their columns and rows are as they were."""
    held, closed = opened(docs, "text")
    return closed(_scored(held, model).where(F.col("quality_score") >= threshold))
