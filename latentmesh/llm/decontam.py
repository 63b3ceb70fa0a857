"""Benchmark decontamination by a prefix-filtered set join.

The unit is a shingle of ``WORDS`` words.  A document holds a benchmark item if
some window of it, as many words long as the item, has at least ``SHARE`` of
the item's distinct shingles.  The join finds all such pairs without comparing
them all: an item's shingles are ordered by how many documents have them, rare
ones first, and a window with the share must have one of the first
``n - ceil(SHARE * n) + 1``, the prefix.  A document that meets a prefix
shingle is a candidate if it is long enough and if what can still be matched
from that position on reaches the share; the candidates are verified exactly,
over windows of the item's size.

The items' shingles are broadcast in slices of about ``SLICE_SHINGLES``: items
are hashed to slices, and the driver holds one slice at a time; a larger
benchmark takes more passes over the documents.  A document is worked on in
runs of ``RUN_WORDS`` words, so memory doesn't grow with its length but for the
hashes of its words.

Defined cases: an item of fewer than ``WORDS`` words is one shingle of all its
words; an item without words, or with a null text, matches nothing; items of
equal text each match.  A null or empty document holds nothing.  Rows are
judged one by one, so repeated rows get the same result; ``holds`` leaves out
rows with a null ``doc_id`` or an item with a null ``item_id``, and an id that
isn't a whole number is null; ``clean`` judges and keeps rows whatever their
``doc_id`` is.  ``text`` is found whatever its case; other columns may have any
names, dots among them, and are kept by ``clean``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .shared import opened, whole_number, written

WORDS = 5
SHARE = 0.8
SLICE_SHINGLES = 1_000_000
RUN_WORDS = 1 << 15


@dataclass
class Items:
    """Distinct shingles of some items, by item; ``need`` is the number that a window must have."""

    ids: np.ndarray
    size: np.ndarray  # words
    width: np.ndarray  # words of a shingle
    need: np.ndarray
    hashes: np.ndarray  # sorted, distinct over all items
    owners: np.ndarray  # items of each hash, by ``starts``
    starts: np.ndarray
    prefix: np.ndarray  # whether the owner has the hash in its prefix
    count: np.ndarray  # distinct shingles


def _distinct(ids: list[int], texts: list[str], n: int) -> list[tuple[int, int, int, np.ndarray]]:
    """Id, words, width and distinct shingles of each item that has a word."""
    h, off = tk.words(pa.array(texts, pa.string()))
    out = []
    for k, i in enumerate(ids):
        words = h[off[k] : off[k + 1]]
        if len(words):
            width = min(n, len(words))
            s, _, _ = tk.shingles(words, np.array([0, len(words)]), width)
            out.append((i, len(words), width, np.unique(s)))
    return out


def _lookup(values: np.ndarray, table: np.ndarray, sieve: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``values`` that are in the sorted ``table``, and where in it."""
    maybe = np.flatnonzero(sieve[_slot(values, len(sieve))])
    if not len(maybe):
        return maybe, maybe
    at = np.searchsorted(table, values[maybe])
    at[at == len(table)] = 0
    hit = table[at] == values[maybe]
    return maybe[hit], at[hit]


def _slot(values: np.ndarray, slots: int) -> np.ndarray:
    return (values >> np.uint64(65 - slots.bit_length())).astype(np.int64)


def _sieve(table: np.ndarray) -> np.ndarray:
    """A bit for each leading part of a hash, with about 64 slots a hash."""
    bits = np.zeros(1 << min(24, max(16, len(table).bit_length() + 6)), dtype=bool)
    bits[_slot(table, len(bits))] = True
    return bits


def _hits(h: np.ndarray, off: np.ndarray, width: int, table: np.ndarray, sieve: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, word positions in them and places in ``table`` of the rows' shingles that are in it."""
    places, ats = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo in range(0, len(h) - width + 1, RUN_WORDS):
        place, at = _lookup(tk.runs(h[lo : lo + RUN_WORDS + width - 1], width), table, sieve)
        places.append(place + lo)
        ats.append(at)
    place, at = np.concatenate(places), np.concatenate(ats)
    row = np.searchsorted(off, place, side="right") - 1
    whole = place + width <= off[row + 1]  # else it goes on in the next row
    row, place = row[whole], place[whole]
    return row, place - off[row], at[whole]


def _frequencies(share):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, widths = share.value
        sieve, total = _sieve(table), np.zeros(len(table), dtype=np.int64)
        for batch in batches:
            h, off = tk.words(batch.column(0))
            for width in widths:
                row, _, at = _hits(h, off, int(width), table, sieve)
                total += np.bincount(np.unique(row * len(table) + at) % len(table), minlength=len(table))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["at", "docs"])

    return run


def _best(place: np.ndarray, at: np.ndarray, span: int) -> tuple[int, int]:
    """The most distinct ``at`` that have a ``place`` in one span of that length, and the first place of the first such span."""
    order = np.lexsort((at, place))
    place, at = place[order], at[order]
    # the last place where the same shingle was seen before counts once: for each start, an entry is new if its previous equal lies before the start
    by = np.lexsort((place, at))
    before = np.full(len(place), -1, dtype=np.int64)
    same = at[by][1:] == at[by][:-1]
    before[by[1:][same]] = place[by[:-1][same]]
    best, first = 0, 0
    ends = np.searchsorted(place, place + span, side="left")
    for i in range(len(place)):
        if i and place[i] == place[i - 1] or ends[i] - i <= best:
            continue
        n = int((before[i : ends[i]] < place[i]).sum())
        if n > best:
            best, first = n, int(place[i])
    return best, first


def _search(batch_texts: pa.Array, items: Items, sieve: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Row, item, matched shingles and first word of each contained item."""
    h, off = tk.words(batch_texts)
    length = np.diff(off)
    for width in np.unique(items.width):
        row, position, at = _hits(h, off, int(width), items.hashes, sieve)
        if not len(row):
            continue
        owners = items.starts[at + 1] - items.starts[at]
        entry = np.repeat(items.starts[at] - np.concatenate([[0], np.cumsum(owners)[:-1]]), owners) + np.arange(owners.sum())
        row, position, at, item = np.repeat(row, owners), np.repeat(position, owners), np.repeat(at, owners), items.owners[entry]
        # length and positional bounds: enough shingles in the document, and enough from a prefix shingle's first possible window on
        own = items.width[item] == width
        near = np.minimum(length[row] - width + 1, position + items.size[item] - width + 1) - np.maximum(position - (items.size[item] - width), 0)
        anchor = own & items.prefix[entry] & (near >= items.need[item])
        key = row * len(items.ids) + item
        wanted = own & np.isin(key, np.unique(key[anchor]))
        order = np.lexsort((position[wanted], key[wanted]))
        key, position, at = key[wanted][order], position[wanted][order], at[wanted][order]
        for part in np.split(np.arange(len(key)), np.flatnonzero(np.diff(key)) + 1) if len(key) else ():
            i = int(key[part[0]] % len(items.ids))
            if len(part) >= items.need[i]:
                n, first = _best(position[part], at[part], int(items.size[i] - width + 1))
                if n >= items.need[i]:
                    yield int(key[part[0]] // len(items.ids)), i, n, first


def _prepared(docs: DataFrame, items: list, share: float) -> Items:
    """The items' shingles with prefixes by the documents' frequencies."""
    sc = docs.sparkSession.sparkContext
    hashes = np.unique(np.concatenate([s for *_, s in items]))
    known = sc.broadcast((hashes, np.unique([w for _, _, w, _ in items])))
    counts = docs.select(F.col("text").cast("string")).mapInArrow(tk.tidy(_frequencies(known)), "at long, docs long").groupBy("at").agg(F.sum("docs").alias("docs"))
    often = np.zeros(len(hashes), dtype=np.int64)
    for row in counts.collect():  # at most one row for each of the slice's shingles
        often[row["at"]] = row["docs"]
    known.destroy()
    need = np.array([math.ceil(share * len(s) - 1e-9) for *_, s in items])
    owners, at, prefix = [], [], []
    for k, (*_, s) in enumerate(items):
        place = np.searchsorted(hashes, s)
        order = place[np.lexsort((s, often[place]))]
        owners.append(np.full(len(s), k))
        at.append(order)
        prefix.append(np.arange(len(s)) < len(s) - need[k] + 1)
    owners, at, prefix = np.concatenate(owners), np.concatenate(at), np.concatenate(prefix)
    order = np.argsort(at, kind="stable")
    ids, size, width, _ = zip(*items)
    return Items(np.array(ids), np.array(size), np.array(width), need, hashes, owners[order], np.searchsorted(at[order], np.arange(len(hashes) + 1)), prefix[order], np.array([len(s) for *_, s in items]))


_WORD = r"[a-z0-9\x{80}-\x{10FFFF}]++"


def _benchmark(benchmark: DataFrame, words: int, slice_shingles: int) -> Iterator[list]:
    """The items that have words, in slices; nothing for an empty benchmark."""
    named = opened(benchmark, "item_id", "text")[0].select(whole_number("item_id").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    sized = written(named.withColumn("words", F.regexp_count(F.lower("text"), F.lit(_WORD))).where("words > 0"), "decontam-items")
    slices = -(-(sized.agg(F.sum("words")).first()[0] or 0) // slice_shingles)
    for k in range(slices):
        rows = sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k).orderBy("item_id", "text").collect()
        if items := _distinct([r.item_id for r in rows], [r.text for r in rows], words):
            yield items


def _hold(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        sieve = _sieve(items.hashes)
        for batch in batches:
            hits = list(_search(batch.column(1), items, sieve))
            rows, item, n, first = (np.array(c, dtype=np.int64) for c in zip(*hits)) if hits else [np.zeros(0, np.int64)] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array(items.ids[item].astype(np.int64)), pa.array(n.astype(np.int32)), pa.array(items.count[item].astype(np.int32)), pa.array(first)],
                names=["doc_id", "item_id", "matched", "shingles", "first_word"],
            )

    return run


def _without(shared, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        sieve = _sieve(items.hashes)
        for batch in batches:
            stay = np.ones(batch.num_rows, dtype=bool)
            stay[[row for row, *_ in _search(batch.column(at), items, sieve)]] = False
            yield batch.filter(pa.array(stay))

    return run


def holds(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, share: float = SHARE, slice_shingles: int = SLICE_SHINGLES) -> DataFrame:
    """``doc_id, item_id, matched, shingles, first_word`` of each item that a document holds, at its best window."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, matched int, shingles int, first_word long"
    named = opened(docs, "doc_id", "text")[0].select(whole_number("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    found, last = spark.createDataFrame([], schema), None
    for items in _benchmark(benchmark, words, slice_shingles):
        if last is not None:  # a plan needs the items of one slice only
            found = found.unionByName(written(last, "decontam-found"))
        last = named.mapInArrow(tk.tidy(_hold(spark.sparkContext.broadcast(_prepared(named, items, share)))), schema)
    return (found if last is None else found.unionByName(last)).distinct()


def clean(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, share: float = SHARE, slice_shingles: int = SLICE_SHINGLES) -> DataFrame:
    """``docs`` without those that hold an item; their columns and rows are as they were."""
    spark = docs.sparkSession
    kept, closed = opened(docs, "text")
    at, last = kept.columns.index("text"), None
    for items in _benchmark(benchmark, words, slice_shingles):
        if last is not None:
            kept = written(last, "decontam-kept")
        last = kept.mapInArrow(tk.tidy(_without(spark.sparkContext.broadcast(_prepared(kept, items, share)), at)), kept.schema)
    return closed(kept if last is None else last)


_W = "[a-z0-9\\x{80}-\\x{10FFFF}]+"
#: Words as lists, shingles as joined words.
SQL = f"""
WITH iw AS (SELECT item_id, regexp_extract_all(lower(text), '{_W}') AS w FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL)),
i AS (SELECT item_id, len(w) AS size, least({WORDS}, len(w)) AS width, w FROM iw WHERE len(w) > 0),
ish AS (SELECT DISTINCT item_id, size, width, list_aggregate(w[k:k + width - 1], 'string_agg', ' ') AS s FROM (SELECT *, unnest(range(1, size - width + 2)) AS k FROM i)),
n AS (SELECT item_id, size, width, count(*) AS shingles, ceil({SHARE} * count(*) - 1e-9) AS need FROM ish GROUP BY ALL),
dw AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '{_W}') AS w FROM documents WHERE doc_id IS NOT NULL),
dsh AS (SELECT doc_id, width, k - 1 AS pos, list_aggregate(w[k:k + width - 1], 'string_agg', ' ') AS s
  FROM (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS k FROM dw, (SELECT DISTINCT width FROM i) WHERE len(w) >= width)),
m AS (SELECT doc_id, item_id, pos, s, size, dsh.width FROM dsh JOIN ish USING (s, width)),
win AS (SELECT a.doc_id, a.item_id, a.pos, count(DISTINCT b.s) AS matched FROM (SELECT DISTINCT doc_id, item_id, pos FROM m) a JOIN m b ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND b.pos BETWEEN a.pos AND a.pos + b.size - b.width GROUP BY ALL),
best AS (SELECT doc_id, item_id, max(matched) AS matched, arg_max(pos, (matched, -pos)) AS first_word FROM win GROUP BY ALL)
SELECT doc_id, item_id, matched::INTEGER AS matched, shingles::INTEGER AS shingles, first_word::BIGINT AS first_word FROM best JOIN n USING (item_id) WHERE matched >= need
"""
