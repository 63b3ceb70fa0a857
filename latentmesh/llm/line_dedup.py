"""Reversible line dedup: sharded cuckoo filters backed by exact reference counts.

An index consists of tables:

* ``refs``: a log of ``shard, key, doc_id, line, batch, n``: a line's 128-bit
  hash, where it occurs, the insertion that brought it, and 1 or, for deletions,
  -1.  Of a line's occurrences the first by batch, ``doc_id`` and line number is
  the one that stays in the texts.
* ``filters``: for each shard its cuckoo filters, each twice as large as the one
  before it; a new one is added when the last is full, so no key is ever lost.
* ``levels``: a log of ``shard, key, level, n``: which of the filters holds the
  key's print, so that a deletion takes it out of that one and never takes the
  equal print of another key out of an older one.

Inserting documents asks the filters first: a line that no filter has is new,
without a look at the log; only the lines that a filter may have are looked up
exactly.  Deleting documents lowers the counts and takes lines that nothing
refers to any more out of the filters, so deleting what was inserted leaves the
index as it was.  Where the occurrence that stays is deleted and others are
left, the first of them is returned, for its line must come back to its text.
Of a line that is new to the index the first occurrence, by ``doc_id`` and line
number, stays; a line that the index has goes.

Defined cases: lines end at a newline; a line of blanks is no line and always
stays.  Null and empty texts stay as they are.  A row whose ``doc_id`` is null or
no whole number can't be ordered: it stays whole and isn't counted, and its id
is null in the result.  Rows that share a ``doc_id`` are one document: lines of
equal number and text in them are one occurrence.  Columns other than ``doc_id``
and ``text``, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import opened, small_or_not, whole_number, written
from .textkernel import mix64

SHARDS = 64
#: A new index has a shard for so many lines, so that a task can hold a shard's keys and filters.
SHARD_LINES = 1_000_000
#: op8 inserts so many batches, so that the later ones ask the filters of those before.
BATCHES = 2
SLOTS = 4
LOAD = 0.9


class Cuckoo:
    """A cuckoo filter with 16-bit fingerprints and buckets of four, over arrays of 64-bit keys."""

    def __init__(self, slots: np.ndarray):
        self.slots = slots

    @classmethod
    def sized(cls, keys: int) -> Cuckoo:
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, keys) / (SLOTS * LOAD)))))
        return cls(np.zeros((buckets, SLOTS), dtype=np.uint16))

    @property
    def room(self) -> int:
        return int(self.slots.size * LOAD) - int(np.count_nonzero(self.slots))

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = mix64(keys)
        prints = (h >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        first = (h & np.uint64(len(self.slots) - 1)).astype(np.int64)
        return prints, first, self._other(prints, first)

    def _other(self, prints: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return bucket ^ (mix64(prints.astype(np.uint64)) & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        prints, a, b = self._places(keys)
        return (self.slots[a] == prints[:, None]).any(1) | (self.slots[b] == prints[:, None]).any(1)

    def _put(self, prints: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Puts what fits in free slots; returns what didn't."""
        order = np.argsort(bucket, kind="stable")
        at = bucket[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        free = self.slots[at] == 0
        fits = rank < free.sum(1)
        slot = np.argmax(free[fits].cumsum(1) == rank[fits][:, None] + 1, axis=1)
        self.slots[at[fits], slot] = prints[order[fits]]
        return order[~fits]

    def add(self, keys: np.ndarray, rounds: int = 500) -> np.ndarray:
        """Adds keys, each once; returns the positions of those that found no place, of which nothing remains."""
        prints, a, b = self._places(keys)
        left = self._put(prints, a)
        left = left[self._put(prints[left], b[left])]
        lost = []
        for start in left:  # few: buckets are four wide and at most LOAD full
            before = []
            p, at = prints[start], b[start]
            for step in range(rounds):
                free = np.flatnonzero(self.slots[at] == 0)
                if len(free):
                    self.slots[at, free[0]] = p
                    break
                s = (step + int(p)) % SLOTS
                before.append((at, s, self.slots[at, s]))
                p, self.slots[at, s] = self.slots[at, s], p
                at = int(self._other(np.array([p]), np.array([at]))[0])
            else:
                for bucket, s, old in reversed(before):
                    self.slots[bucket, s] = old
                lost.append(start)
        return np.array(lost, dtype=np.int64)

    def remove(self, keys: np.ndarray) -> np.ndarray:
        """Takes one copy of each key's fingerprint out; returns the positions of those that weren't there.

        Equal prints in one of a key's two buckets have the same two buckets, so it doesn't matter which is taken.
        """
        prints, a, b = self._places(keys)
        left = np.arange(len(keys))
        for bucket in (a, b):
            for slot in range(SLOTS):
                hit = np.flatnonzero(self.slots[bucket[left], slot] == prints[left])
                _, first = np.unique(bucket[left[hit]], return_index=True)
                done = hit[first]
                self.slots[bucket[left[done]], slot] = 0
                left = np.delete(left, done)
        return left


def _filters(rows: pd.DataFrame) -> list[Cuckoo]:
    return [Cuckoo(np.frombuffer(b, np.uint16).reshape(-1, SLOTS).copy()) for b in rows.sort_values("level")["slots"]]


def _rows(shard: int, filters: list[Cuckoo]) -> pd.DataFrame:
    return pd.DataFrame({"shard": [shard] * len(filters), "level": range(len(filters)), "slots": [f.slots.tobytes() for f in filters]})


def _hash64(keys: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(keys), np.uint64)[::2].copy() if len(keys) else np.zeros(0, np.uint64)


def _probe(keys: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    """Which keys a filter may have."""
    h, seen = _hash64(keys["key"]), np.zeros(len(keys), dtype=bool)
    for f in _filters(filters):
        seen |= f.has(h)
    return pd.DataFrame({"key": keys["key"], "maybe": seen})


def _add(keys: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    """A shard's filters with new keys, as rows with ``slots``, and the filter that each key is in, as rows with ``key``."""
    shard = int((keys if len(keys) else filters)["shard"].iloc[0])
    found, h = _filters(filters), _hash64(keys["key"])
    left, level = np.argsort(h, kind="stable"), np.zeros(len(h), dtype=np.int32)
    while len(left):
        if not found or found[-1].room <= 0:
            found.append(Cuckoo.sized(max(len(left), 2 * found[-1].slots.size if found else 1024)))
        n = min(len(left), max(1, found[-1].room))
        part, rest = left[:n], left[n:]
        level[part] = len(found) - 1
        lost = found[-1].add(h[part])
        left = np.concatenate([part[lost], rest])
        if len(lost):
            found.append(Cuckoo.sized(max(len(left), 2 * found[-1].slots.size)))
    at = pd.DataFrame({"shard": shard, "level": level, "slots": None, "key": keys["key"].to_numpy()})
    return pd.concat([_rows(shard, found).assign(key=None), at])


def _remove(keys: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    """A shard's filters without keys, each taken out of the filter that it is in."""
    if not len(filters):
        return filters
    found, h = _filters(filters), _hash64(keys["key"])
    level = keys["level"].to_numpy(dtype=np.int64)
    for k, f in enumerate(found):
        if len(f.remove(h[level == k])):
            raise RuntimeError("a filter doesn't hold a key that the index has in it")
    return _rows(int(filters["shard"].iloc[0]), found)


_FILTERS = "shard int, level int, slots binary"
_LEVELS = "shard int, key binary, level int, n int"
_REFS = "shard int, key binary, doc_id long, line int, batch int, n int"
_PLACE = ["shard", "key", "doc_id", "line"]


def _named(docs: DataFrame) -> DataFrame:
    return opened(docs, "doc_id", "text")[0].select(whole_number("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"))


def lines(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, line, key, shard`` of every line that isn't blank."""
    cut = _named(docs).where("doc_id is not null and text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "words")).where(F.col("words").rlike(r"\S"))
    return cut.select("doc_id", "line", F.unhex(F.md5("words")).alias("key")).withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))


@dataclass(frozen=True)
class LineIndex:
    """A version of the index; inserting and deleting return the next one."""

    spark: SparkSession
    refs: DataFrame
    filters: DataFrame
    levels: DataFrame
    shards: int = SHARDS
    batch: int = 0

    @classmethod
    def empty(cls, spark: SparkSession, shards: int = SHARDS) -> LineIndex:
        return cls(spark, spark.createDataFrame([], _REFS), spark.createDataFrame([], _FILTERS), spark.createDataFrame([], _LEVELS), shards)

    def _known(self, keys: DataFrame) -> DataFrame:
        """The rows of ``keys`` that the index counts: a filter may have them, and the log says how often they occur."""
        probed = keys.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(_probe, "key binary, maybe boolean").where("maybe").select("key")
        counts = self.refs.join(probed, "key", "left_semi").groupBy("key").agg(F.sum("n").alias("count")).where("count > 0")
        return counts

    def counts(self) -> DataFrame:
        """``key, n`` of every line that is referred to."""
        return self.refs.groupBy("key").agg(F.sum("n").alias("n")).where("n > 0")

    def compacted(self) -> LineIndex:
        """The same with one row for each occurrence and for each key in the logs."""
        return LineIndex(self.spark, written(_live(self.refs), "lines-refs"), self.filters, written(_held(self.levels), "lines-levels"), self.shards, self.batch)

    def insert(self, docs: DataFrame) -> tuple[LineIndex, DataFrame]:
        """The index with the lines of ``docs``, and ``doc_id, line`` of the occurrences that must go."""
        found = lines(docs, self.shards).select(_PLACE)
        found = written(found.distinct() if _repeats(docs) else found, "lines-found")
        new = written(found.groupBy("shard", "key").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "line")).alias("first")), "lines-new")
        known = written(self._known(new.select("shard", "key")).select("key"), "lines-known") if not self.filters.isEmpty() else self.spark.createDataFrame([], "key binary")
        added = new.join(small_or_not(known, 64), "key", "left_anti")
        made = written(added.select("shard", "key").groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(_add, f"{_FILTERS}, key binary"), "lines-filters")
        filters = made.where("slots is not null").drop("key")
        levels = self.levels.unionByName(made.where("key is not null").select("shard", "key", "level", F.lit(1).alias("n")))
        refs = self.refs.unionByName(found.withColumns({"batch": F.lit(self.batch + 1), "n": F.lit(1)}))
        seen = known.withColumn("seen", F.lit(True))
        heavy = written(new.join(small_or_not(seen, 64), "key", "left").where("n > 1 or seen").select("key", "seen", "first"), "lines-heavy")
        gone = found.join(small_or_not(heavy, 96), "key").where(F.col("seen").isNotNull() | (F.struct("doc_id", "line") != F.col("first"))).select("doc_id", "line")
        return LineIndex(self.spark, refs, filters, levels, self.shards, self.batch + 1), gone

    def delete(self, docs: DataFrame) -> LineIndex:
        """The index without the lines of ``docs``; what was never inserted is passed over."""
        return self.withdraw(docs)[0]

    def withdraw(self, docs: DataFrame) -> tuple[LineIndex, DataFrame]:
        """The index without the lines of ``docs``, and ``doc_id, line`` of the occurrences, gone so far, that must come back."""
        old = written(lines(docs, self.shards).select(_PLACE).distinct(), "lines-old")
        there = written(_live(self.refs.join(old.select("key"), "key", "left_semi")), "lines-there")
        out = written(old.join(there.groupBy(_PLACE).agg(F.max("batch").alias("batch")), _PLACE).withColumn("n", F.lit(-1)), "lines-out")
        left = written(there.join(out.select(*_PLACE, "batch"), [*_PLACE, "batch"], "left_anti"), "lines-left")
        first = lambda df, to: df.groupBy("key").agg(F.min(F.struct("batch", "doc_id", "line")).alias(to))
        back = first(there, "was").join(first(left, "now"), "key").where("was != now").select("now.doc_id", "now.line")
        dead = out.select("key").join(left.select("key"), "key", "left_anti").distinct()
        out_of = written(_held(self.levels.join(dead, "key", "left_semi")), "lines-dead")
        filters = written(out_of.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(_remove, _FILTERS), "lines-filters")
        levels = self.levels.unionByName(out_of.withColumn("n", F.lit(-1)))
        return LineIndex(self.spark, self.refs.unionByName(out), filters, levels, self.shards, self.batch), back


def _held(levels: DataFrame) -> DataFrame:
    """The keys of a log that are in a filter."""
    return levels.groupBy("shard", "key", "level").agg(F.sum("n").cast("int").alias("n")).where("n > 0")


def _live(refs: DataFrame) -> DataFrame:
    """The occurrences of a log that weren't deleted."""
    return refs.groupBy(*_PLACE, "batch").agg(F.sum("n").cast("int").alias("n")).where("n > 0")


def _repeats(docs: DataFrame) -> bool:
    return not _named(docs).where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``doc_id, text, removed``: the texts without the lines that must go, and how many went."""
    numbers = written(gone.groupBy("doc_id").agg(F.collect_set("line").alias("lines")), "lines-gone")
    total = numbers.agg(F.sum(F.size("lines"))).first()[0] or 0
    joined = _named(docs).join(small_or_not(numbers, 48 + 8 * total // max(1, numbers.count())), "doc_id", "left")
    # a generator, so that a text is cut once and not for each of its lines
    cut = joined.select("*", F.inline(F.array(F.struct(F.when(F.col("lines").isNotNull(), F.split("text", "\n")).alias("cut")))))
    left = F.array_except(F.sequence(F.lit(0), F.size("cut") - 1), "lines")
    rest = F.array_join(F.transform(left, lambda i: F.get("cut", i)), "\n")
    return cut.select("doc_id", F.when(F.col("lines").isNull(), F.col("text")).otherwise(rest).alias("text"), F.coalesce(F.size("lines"), F.lit(0)).alias("removed"))


def shards_for(docs: DataFrame) -> int:
    """Shards for the lines of ``docs``, counted by their newlines."""
    text = F.col("text")
    most = _named(docs).agg(F.sum(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    return max(SHARDS, -(-most // SHARD_LINES))


def dedup(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """``doc_id, text, removed`` after inserting ``docs`` in an empty index, in ``BATCHES`` ranges of ``doc_id``, the lowest first."""
    docs, i = _named(docs), F.col("doc_id")
    index, gone = LineIndex.empty(docs.sparkSession, shards or shards_for(docs)), None
    cuts = docs.select(i.cast("double").alias("i")).approxQuantile("i", [k / BATCHES for k in range(1, BATCHES)], 0.05)
    bounds = [None, *sorted({math.floor(x) for x in cuts}), None]
    for low, high in zip(bounds, bounds[1:]):
        index, more = index.insert(docs.where((F.lit(True) if low is None else i > low) & (F.lit(True) if high is None else i <= high)))
        gone = more if gone is None else gone.unionByName(more)
    return without(docs, gone)


SQL = r"""
WITH l AS (SELECT doc_id, text, generate_subscripts(s, 1) AS k, unnest(s) AS line FROM (SELECT doc_id, text, string_split(text, chr(10)) AS s FROM documents)),
r AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, k) AS n, regexp_matches(line, '\S') AS full_line FROM l)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (n = 1 OR NOT full_line), '') AS text, (count(*) FILTER (n > 1 AND full_line))::INTEGER AS removed
FROM r GROUP BY doc_id
"""
