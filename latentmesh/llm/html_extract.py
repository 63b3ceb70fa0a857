"""Main content of web pages by maximum-scoring subsequence.

A page is a sequence of words and tags.  A word scores positive and a tag
negative, with a weight for each tag name; one linear scan finds the contiguous
region of the greatest sum, which is the content.  Comments, scripts and styles
are one tag each and have no words.

The weights come from labelled pages, those with exactly one whole ``article``
element, which marks the content.  An averaged structured perceptron moves the
weights until the best region of such a page is its element; ``article`` and
``main`` tags have no weight, so the model doesn't read its own label.  At most
``FIT_PAGES`` pages are used, in order of a hash of ``page_id``.

Defined cases: a null or empty page, and one without words, has an empty text
and the region (0, 0).  Of regions of equal score the first and then the
shortest is taken.  A tag that the page's end cuts off ends there.  Without
labelled pages all tags weigh the same.  Rows with a null ``page_id`` and
repeated rows are extracted one by one; an id that is no whole number is null;
other columns are ignored.
"""

from __future__ import annotations

import html as html_
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import opened, whole_number

FIT_PAGES = 600
EPOCHS = 8
#: No tag scores more than this.
LEAST = -0.02
#: In a tag a quote begins a value after an equals sign only; elsewhere, as in an unquoted value, it is a character like others.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|</?([a-z][a-z0-9-]*)(?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*+)?)*+(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.I | re.S)
_BREAK = {"p", "br", "div", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "table", "section", "article", "main", "blockquote", "pre", "hr", "nav", "header", "footer", "title", "head", "body"}
_UNWEIGHED = {"article", "main"}
_OTHER = "#other"


@dataclass
class Weights:
    word: float = 1.0
    tags: dict[str, float] = field(default_factory=dict)
    other: float = -8.0

    def of(self, tag: str) -> float:
        return 0.0 if tag in _UNWEIGHED else self.tags.get(tag, self.other)


def pieces(page: str) -> tuple[list[tuple[int, int]], list[str], list[tuple[int, int]]]:
    """Text runs as (start, end), one more than tags; between them the tags' names and places."""
    runs, names, places, at = [], [], [], 0
    for m in _TAG.finditer(page):
        name = (m.group(2) or m.group(1) or _OTHER).lower()
        runs.append((at, m.start()))
        names.append(name)
        places.append(m.span())
        at = m.end()
    runs.append((at, len(page)))
    return runs, names, places


def _counts(page: str, runs: list[tuple[int, int]]) -> list[int]:
    return [len(page[a:b].split()) if b > a else 0 for a, b in runs]


def best(words: list[int], tags: list[str], w: Weights) -> tuple[int, int]:
    """The first and the last text run of the region of the greatest score; (0, -1) if there is no word."""
    top, first, last = 0.0, 0, -1
    total, start = 0.0, 0
    for i, n in enumerate(words):
        if i:
            total += w.of(tags[i - 1])
        if total <= 0:
            total, start = 0.0, i
        total += w.word * n
        if n and total > top:
            top, first, last = total, start, i
    return first, last


def _gold(tags: list[str], places: list[tuple[int, int]], page: str) -> tuple[int, int] | None:
    opened = [i for i, t in enumerate(tags) if t == "article" and not page.startswith("</", places[i][0])]
    closed = [i for i, t in enumerate(tags) if t == "article" and page.startswith("</", places[i][0])]
    if len(opened) != 1 or len(closed) != 1 or opened[0] > closed[0]:
        return None
    return opened[0] + 1, closed[0]


def fit(pages: list[str], epochs: int = EPOCHS) -> Weights:
    """Averaged structured perceptron over the pages that are labelled; words stay positive and tags negative."""
    examples = []
    for page in pages:
        runs, tags, places = pieces(page)
        gold = _gold(tags, places, page)
        if gold is None:
            continue
        words = _counts(page, runs)
        while gold[0] < gold[1] and not words[gold[0]]:
            gold = gold[0] + 1, gold[1]
        while gold[1] > gold[0] and not words[gold[1]]:
            gold = gold[0], gold[1] - 1
        if words[gold[0]]:
            examples.append((words, tags, gold))
    if not examples:
        return Weights()
    names = sorted({t for _, tags, _ in examples for t in tags} - _UNWEIGHED)
    w, sums, n = Weights(1.0, dict.fromkeys(names, -2.0)), dict.fromkeys(names, 0.0), 0
    for epoch in range(epochs):
        rate = 1.0 / (1 + epoch)
        for words, tags, gold in examples:
            found = best(words, tags, w)
            if found != gold:
                net = Counter(tags[gold[0] : gold[1]])
                net.subtract(Counter(tags[found[0] : max(found)]))
                for t in net.keys() & w.tags.keys():
                    w.tags[t] = min(LEAST, w.tags[t] + rate * net[t])
            n += 1
            for t in names:
                sums[t] += w.tags[t]
    mean = {t: s / n for t, s in sums.items()}
    return Weights(1.0, mean, min(mean.values()))


def extract(page: str | None, w: Weights) -> tuple[int, int, str]:
    """Where the content starts and ends in the page, and its text."""
    if not page:
        return 0, 0, ""
    runs, tags, _ = pieces(page)
    words = _counts(page, runs)
    a, b = best(words, tags, w)
    if b < a:
        return 0, 0, ""
    parts = []
    for i in range(a, b + 1):
        if i > a:
            parts.append("\n" if tags[i - 1] in _BREAK else "")
        parts.append(page[runs[i][0] : runs[i][1]])
    text = html_.unescape("".join(parts))
    return runs[a][0], runs[b][1], "\n".join(line for line in (" ".join(x.split()) for x in text.split("\n")) if line)


def train(pages: DataFrame, fit_pages: int = FIT_PAGES, seed: int = 0) -> Weights:
    named = opened(pages, "page_id", "html")[0].select(whole_number("page_id").alias("page_id"), F.col("html").cast("string").alias("html"))
    marked = named.where("page_id is not null").where(F.col("html").contains("<article") & F.col("html").contains("</article"))
    ids = marked.select("page_id").orderBy(F.xxhash64("page_id", F.lit(seed)), "page_id").limit(fit_pages)
    # at most fit_pages ids, so the size of this side is bounded
    rows = marked.join(F.broadcast(ids.distinct()), "page_id", "left_semi").orderBy("page_id", "html").limit(fit_pages).collect()
    return fit([r.html for r in rows])


def content(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """``page_id, start, end, text`` of every page; start and end are places in the page's source."""
    w = train(pages) if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [extract(h.as_py(), w) for h in batch.column(1)]
            a, b, text = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(text, pa.string())], names=["page_id", "start", "end", "text"])

    named = opened(pages, "page_id", "html")[0].select(whole_number("page_id").alias("page_id"), F.col("html").cast("string"))
    return named.mapInArrow(run, "page_id long, start long, end long, text string")
