"""Sharding by Karmarkar-Karp differencing.

Documents of one group, copies of one text by default, can't be divided; the
groups are spread over shards so that the shards' bytes are as even as the
differencing method makes them: repeatedly the two partial partitions of the
largest spread become one, the largest part of the one with the smallest part
of the other.

Groups are hashed into buckets of about ``BUCKET``, so that the work and the
memory of a task are bounded whatever the number of groups.  A group that is
larger than a shard's share of a bucket is kept out of them: those, far fewer,
are spread first, by the same method, and what they leave uneven is a row of
each bucket's differencing in proportion to its bytes, so every bucket fills its
part of it.  Of ``FAN_IN`` buckets one is differenced after the others and
evens out what they leave, and so on up to a last one for the whole table.

Defined cases: a null and an empty text have no bytes and are groups of their
own.  Repeated rows are in one group.  With fewer groups than shards some
shards stay empty; an empty table gives an empty result.  Ties are broken by
the group's hash, so the result doesn't depend on the order of the rows.  Other
columns are carried along, whatever their names; one named like the result's
but for case is replaced.
"""

from __future__ import annotations

import heapq
import math
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import opened, small_or_not, written

SHARDS = 16
BUCKET = 20_000
FAN_IN = 256


def difference(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp over the rows of ``parts``, each a partial partition.

    Returns the shard of every part and the shards' sums, largest first.
    """
    n, k = parts.shape
    order = np.argsort(-parts, axis=1, kind="stable")
    sums = list(np.take_along_axis(parts, order, axis=1))
    heap = [(int(s[-1] - s[0]), i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    merges: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heap[0]
        s = sums[a] + sums[b][::-1]
        to = np.argsort(-s, kind="stable")
        s = s[to]
        sums.append(s)
        merges.append((a, b, to))
        heapq.heapreplace(heap, (int(s[-1] - s[0]), len(sums) - 1))
    shard = np.empty((len(sums), k), dtype=np.int32)
    shard[-1] = np.arange(k)
    for at in range(len(merges) - 1, -1, -1):
        a, b, to = merges[at]
        shard[a, to] = shard[n + at]
        shard[b, k - 1 - to] = shard[n + at]
    out = np.empty((n, k), dtype=np.int32)
    np.put_along_axis(out, order, shard[:n], axis=1)
    return out, sums[-1]


def fill(sizes: np.ndarray, before: np.ndarray, seed: int = 0) -> np.ndarray:
    """The shard of each group by differencing the groups together with ``before``, the shards' bytes so far."""
    turn = np.random.default_rng(seed).permutation(len(before))  # else the first shards would get every bucket's odd bytes
    parts = np.zeros((len(sizes) + 1, len(before)), dtype=np.int64)
    parts[:-1, 0] = sizes
    parts[-1] = before[turn]
    shard, _ = difference(parts)
    name = np.empty(len(before), dtype=np.int32)
    name[shard[-1]] = turn
    return name[shard[:-1, 0]]


def _fill(uneven: list[int], total: int):
    """Fills a bucket; ``uneven`` are the shards' bytes of larger groups, to be evened by the ``total`` bytes of all buckets."""

    def run(rows: pd.DataFrame, done: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["bytes", "key"], ascending=[False, True])
        before = np.zeros(len(uneven), dtype=np.int64)
        before[done["shard"].to_numpy(dtype=np.int64)] = done["bytes"]
        share = (int(rows["bytes"].sum()) + int(before.sum())) / max(1, total)
        before += (np.array(uneven, dtype=np.float64) * share).astype(np.int64)
        seed = int(rows["bucket"].iloc[0]) if len(rows) else 0
        return pd.DataFrame({"key": rows["key"], "bucket": rows["bucket"], "bytes": rows["bytes"], "shard": fill(rows["bytes"].to_numpy(), before, seed)})

    return run


def _spread(groups: DataFrame, buckets: int, fan_in: int, uneven: list[int], total: int) -> DataFrame:
    """``key, bucket, bytes, shard`` of groups of which none is large for its bucket."""
    groups = groups.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    width, placed = 1, None
    while True:
        last = width >= buckets

        def turn(at):  # the buckets of this round
            return at == 0 if last else (at % width == 0) & (at % (width * fan_in) != 0)

        if placed is None:
            done = groups.sparkSession.createDataFrame([], "bucket long, shard int, bytes long")
        else:
            done = placed.groupBy((F.floor(F.col("bucket") / width) * width).alias("bucket"), "shard").agg(F.sum("bytes").alias("bytes")).where(turn(F.col("bucket")))
        now = groups.where(turn(F.col("bucket"))).groupBy("bucket").cogroup(done.groupBy("bucket"))
        filled = written(now.applyInPandas(_fill(list(uneven), total), "key long, bucket long, bytes long, shard int"), "sharding-placed")
        placed = filled if placed is None else placed.unionByName(filled)
        if last:
            return placed
        width *= fan_in


def plan(groups: DataFrame, shards: int = SHARDS, bucket: int = BUCKET, fan_in: int = FAN_IN) -> DataFrame:
    """``key, shard`` for the rows ``key, bytes`` of ``groups``, one for each group."""
    bucket = max(bucket, 2 * shards)  # so that large groups are always fewer than all
    rest = written(groups.select("key", "bytes"), "sharding-groups")
    found = []
    while True:
        n, total = rest.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
        buckets = max(1, math.ceil(n / bucket))
        cut = total if buckets == 1 else total // (shards * buckets)
        if n or not found:
            found.append((rest.where(F.col("bytes") <= cut), buckets, total))
        if buckets == 1:
            break
        rest = rest.where(F.col("bytes") > cut)
    uneven, larger, out = [0] * shards, 0, None
    for part, buckets, total in reversed(found):  # the largest groups first
        placed = _spread(part, buckets, fan_in, uneven, total - larger)
        for at, more in placed.groupBy("shard").agg(F.sum("bytes")).collect():
            uneven[at] += more
        larger, out = total, placed if out is None else out.unionByName(placed)
    return out.select("key", "shard")


def content_key(text: Column) -> Column:
    return F.xxhash64(text.cast("string"))


def shard(docs: DataFrame, shards: int = SHARDS, key: Column | None = None, to: str = "shard", bucket: int = BUCKET, fan_in: int = FAN_IN) -> DataFrame:
    """``docs`` with the number of its shard in column ``to``; rows of equal ``key``, by default of equal text, share one."""
    held, closed = opened(docs, "text")
    if key is None:
        keyed = held.withColumn("shard_key", content_key(F.col("text")))
    else:  # it may name any column of docs, so it's worked out beside the renamed ones
        name = f"key-{uuid.uuid4().hex}"
        keyed = opened(docs.select("*", F.xxhash64(key).alias(name)), "text", name)[0].withColumnRenamed(name, "shard_key")
    sizes = keyed.select(F.col("shard_key").alias("key"), F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("bytes"))
    placed = written(plan(sizes.groupBy("key").agg(F.sum("bytes").alias("bytes")), shards, bucket, fan_in), "sharding-plan")
    found = placed.select(F.col("key").alias("shard_key"), F.col("shard").alias("shard_number"))
    return closed(keyed.join(small_or_not(found, 24), "shard_key"), **{to: "shard_number"})


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, shard`` of every document."""
    return shard(opened(docs, "doc_id", "text")[0].select("doc_id", "text"), shards).select("doc_id", "shard")
