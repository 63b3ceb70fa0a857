"""SimHash near-duplicates by exact comparison in tiles.

A fingerprint has 128 bits, each the majority over the text's distinct word
pairs (a text of one word uses that word); in a draw the least pair decides.  Two documents are near duplicates if their
fingerprints differ in at most ``RADIUS`` bits.  Equal fingerprints are folded
first; the distinct ones are ordered by population count and packed in tiles, and
all pairs of tiles whose population counts can be within the radius are compared.
Up to ``FEW`` fingerprints, each with each.  Beyond, the pigeonhole principle
says for each of the eight sixteenths of bits in how few of them a pair must
differ in at least one (``shares``), so a fingerprint is compared only with those
whose sixteen bits are that near, once for each of the eight; a pair counts where
it is found first.  Either way no pair within the radius is missed.  Each document
then belongs to the class of its smallest connected ``doc_id``.

Links aren't written one by one: a pair of tiles gives the number of each
fingerprint's links, all counted, and as many links as it takes to connect what
is connected, so its output and memory are bounded by the tiles however many
texts are alike.

Defined cases: a null text, and a text without a word, has no fingerprint and
is no one's duplicate.  A row whose ``doc_id`` is null or no whole number can't
be named in the result; it isn't compared, and ``drop`` keeps it.  Rows that
share a ``doc_id`` are one document, whose fingerprint is the least of theirs;
``drop`` keeps one such row.  Other columns, whatever their names, are ignored
by ``groups`` and kept by ``drop``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .shared import opened, small_or_not, temporary, whole_number, written

BITS = 128
#: Copies with one word in ten replaced differ in fewer bits (mean 14 for one in twenty); unrelated texts in 64 on average, standard deviation 5.7.
RADIUS = 28
TILE = 16384
#: So many distinct fingerprints are compared each with each; more of them by sixteen bits at a time, in tiles of ``WIDE``.
FEW = 6 * TILE
WIDE = 3 << 18
_LANES = np.uint64(0x0101010101010101)
_RUN = 255
_KEYS = np.arange(1 << 16)
_PARTS = BITS // 16


def _bit_counts(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each row, how many of its hashes have each of 64 bits set; rows must not be empty."""
    counts = np.diff(offsets)
    runs = -(-counts // _RUN)
    first = np.zeros(len(counts), dtype=np.int64)
    np.cumsum(runs[:-1], out=first[1:])
    starts = np.repeat(offsets[:-1], runs) + (np.arange(runs.sum()) - np.repeat(first, runs)) * _RUN
    out = np.empty((len(counts), 64), dtype=np.int64)
    for k in range(8):
        lanes = np.add.reduceat((h >> np.uint64(k)) & _LANES, starts)
        out[:, k::8] = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
    return out


def _features(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that have a word, their distinct word pairs in order (a single word for itself), and the offsets of those."""
    pairs, places, _ = tk.shingles(h, offsets, 2)
    single = np.flatnonzero(np.diff(offsets) == 1)
    row = np.concatenate([np.repeat(np.arange(len(offsets) - 1), np.diff(places)), single]).astype(np.uint64)
    key = np.sort(row << np.uint64(44) | np.concatenate([pairs, tk.mix64(h[offsets[single]])]) >> np.uint64(20))
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    rows, starts = np.unique(key >> np.uint64(44), return_index=True)
    return rows.astype(np.int64), tk.mix64(key & np.uint64((1 << 44) - 1)), np.append(starts, len(key))


def fingerprints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The rows that have a word, and their fingerprints as two columns of 64 bits."""
    h, off = tk.words(texts)
    rows, prints = [np.zeros(0, np.int64)], [np.zeros((0, BITS // 64), np.uint64)]
    for lo, hi in tk.blocks(off, 1 << 18):
        kept, features, cuts = _features(h[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        if not len(kept):
            continue
        n = np.diff(cuts)[:, None]
        both = np.empty((len(kept), BITS // 64), dtype=np.uint64)
        for w in range(BITS // 64):
            seed = np.uint64(0x9E3779B97F4A7C15 * w)
            twice = 2 * _bit_counts(tk.mix64(features ^ seed), cuts)
            even = np.unpackbits(tk.mix64(~features[cuts[:-1]] ^ seed).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
            both[:, w] = np.packbits((twice > n) | (twice == n) & even, axis=1, bitorder="little").view(np.uint64)[:, 0]
        rows.append(kept + lo)
        prints.append(both)
    return np.concatenate(rows), np.concatenate(prints)


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, prints = fingerprints(batch.column(1))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(rows)), pa.array(prints[:, 0].view(np.int64)), pa.array(prints[:, 1].view(np.int64))], names=["doc_id", "f0", "f1"]
        )


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, f0, f1`` of each document that has a fingerprint, once for each ``doc_id``."""
    named = opened(docs, "doc_id", "text")[0].select(whole_number("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    found = named.mapInArrow(tk.tidy(_fingerprint_batches), "doc_id long, f0 long, f1 long")
    return found.groupBy("doc_id").agg(F.min(F.struct("f0", "f1")).alias("f")).select("doc_id", "f.f0", "f.f1")


_TILES = pa.schema([("tile", pa.string()), ("least", pa.int32()), ("most", pa.int32()), ("ids", pa.binary()), ("copies", pa.binary()), ("prints", pa.binary())])


def _pack(size: int):
    """Rows in order of population count, packed in tiles of ``size``."""

    def tiles(table: pa.Table) -> pa.RecordBatch:
        bits = table.column("bits").to_numpy()
        ids, copies, *prints = (np.ascontiguousarray(table.column(c).to_numpy()).tobytes() for c in ("keep_id", "copies", "f0", "f1"))
        return pa.RecordBatch.from_pydict({"tile": [uuid.uuid4().hex], "least": [int(bits.min())], "most": [int(bits.max())], "ids": [ids], "copies": [copies], "prints": [b"".join(prints)]}, schema=_TILES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= size:
                full = pa.Table.from_batches(held)
                at = 0
                while n - at >= size:
                    yield tiles(full.slice(at, size))
                    at += size
                held, n = full.slice(at).to_batches(), n - at
        if n:
            yield tiles(pa.Table.from_batches(held))

    return run


def near(a: np.ndarray, b: np.ndarray, radius: int, same: bool = False, rows: int = 64, columns: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions in ``a`` and in ``b`` (word by fingerprint) within ``radius``, block by block; each pair once if both are the same."""
    for i in range(0, a.shape[1], rows):
        x = a[:, i : i + rows, None]
        for j in range(i // columns * columns if same else 0, b.shape[1], columns):
            y = b[:, None, j : j + columns]
            d = np.bitwise_count(x[0] ^ y[0])
            for w in range(1, len(a)):
                d += np.bitwise_count(x[w] ^ y[w])
            hit = d <= radius
            if hit.any():
                p, q = np.nonzero(hit)
                p, q = p + i, q + j
                if same:
                    once = p < q
                    p, q = p[once], q[once]
                if len(p):
                    yield p, q


def shares(radius: int) -> tuple[list[int], list[int]]:
    """For the halves and for the sixteen-bit parts of a fingerprint, bits that may differ.

    Two within the radius have a half, and in it a part, in which they differ in
    no more bits than these: if each of two halves had more than its share, the
    whole would have more than both shares and one, that is more than the radius.
    A share of -1 is a part that needn't be looked at.
    """
    levels = [[radius]]
    while len(levels[-1]) < _PARTS:
        levels.append([s for r in levels[-1] for s in (r // 2, (r - 1) // 2)])
    return levels[1], levels[-1]


def ball(bits: int) -> np.ndarray:
    """The sixteen-bit numbers with at most so many bits set, zero first."""
    return _KEYS[np.bitwise_count(_KEYS).astype(int) <= bits]


def near_by_part(a: np.ndarray, b: np.ndarray, radius: int, part: int, same: bool = False, block: int = 1 << 15, held: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of ``near`` that differ in few bits of ``part`` and not of one before it; all parts together give each pair once.

    For each value of the part in ``a``, the fingerprints of ``b`` with a value
    near it are gathered, and their halves compared; what passes is compared in full.
    """
    halves, parts = shares(radius)
    half, masks = part // 4, ball(parts[part])
    if not len(masks):
        return

    def by_part(x: np.ndarray) -> tuple[np.ndarray, ...]:
        key = np.ascontiguousarray(x[half]).view(np.uint16)[part % 4 :: 4]
        order, count = np.argsort(key, kind="stable"), np.bincount(key, minlength=len(_KEYS))
        return order, x[half][order], count, np.cumsum(count) - count

    order_a, half_a, count_a, start_a = by_part(a)
    order_b, half_b, count_b, start_b = (order_a, half_a, count_a, start_a) if same else by_part(b)
    differ, many, hit = np.empty(block, np.uint64), np.empty(block, np.uint8), np.zeros(held, bool)
    eights = hit.view(np.uint64)
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def sure() -> tuple[np.ndarray, np.ndarray]:
        p, q = (np.concatenate(side) for side in zip(*found))
        found.clear()
        x = a[:, p] ^ b[:, q]
        in_half = np.bitwise_count(x)
        ok = in_half.sum(axis=0, dtype=int) <= radius
        p, q, x, in_half = p[ok], q[ok], x[:, ok], in_half[:, ok]
        in_part = np.bitwise_count(np.ascontiguousarray(x.T).view(np.uint16))
        fits = (in_part <= np.array(parts)) & np.repeat(in_half.T <= np.array(halves), 4, axis=1)
        first = fits.argmax(axis=1) == part
        return p[first], q[first]

    def passed(pieces: list[tuple[int, ...]], size: int, at: np.ndarray) -> int:
        full = -(-size // 8)
        hit[size : full * 8] = False
        some = np.flatnonzero(eights[:full])
        if not len(some):
            return 0
        place = (some[:, None] * 8 + np.arange(8))[hit.reshape(-1, 8)[some]]
        offset, row, column, width, own = np.array(pieces).T
        k = np.searchsorted(offset, place, side="right") - 1
        down, right = np.divmod(place - offset[k], width[k])
        right += column[k]
        p, q = order_a[row[k] + down], order_b[at[right]]
        if same:  # both have the value, so they meet twice
            once = (right >= own[k]) | (p < q)
            p, q = p[once], q[once]
        found.append((p, q))
        return len(p)

    waiting = 0
    values = np.flatnonzero(count_a)
    group = int(np.clip(held // 2 // (len(masks) * (1 + len(order_b) // len(_KEYS))), 1, 256))
    for g in range(0, len(values), group):
        v = values[g : g + group]
        keys = v[:, None] ^ masks
        counts = count_b[keys]
        if same:  # lesser values were compared with this one in their turn
            counts[keys < v[:, None]] = 0
        totals = counts.sum(axis=1)
        cut = 0
        while cut < len(v):
            to = max(cut + 1, cut + int(np.searchsorted(np.cumsum(totals[cut:]), held, side="right")))
            count = counts[cut:to].ravel()
            end = np.cumsum(count)
            at = np.repeat(start_b[keys[cut:to].ravel()] - (end - count), count)
            at += np.arange(len(at))
            y = half_b.take(at)
            pieces, size, column = [], 0, 0
            for value, total in zip(v[cut:to].tolist(), totals[cut:to].tolist()):
                lo, hi, own, last = int(start_a[value]), int(start_a[value] + count_a[value]), column + int(count_b[value]), column + total
                for j in range(column, last, block):
                    w = min(block, last - j)
                    for i in range(lo, hi, block // w):
                        n = min(block // w, hi - i)
                        m = n * w
                        if size + m > held:
                            waiting += passed(pieces, size, at)
                            pieces, size = [], 0
                            if waiting >= held:
                                yield sure()
                                waiting = 0
                        np.bitwise_xor(half_a[i : i + n, None], y[j : j + w], out=differ[:m].reshape(n, w))
                        np.bitwise_count(differ[:m], out=many[:m])
                        np.less_equal(many[:m], halves[half], out=hit[size : size + m])
                        pieces.append((size, i, j, w, own))
                        size += m
                column = last
            if size:
                waiting += passed(pieces, size, at)
            if waiting >= held:
                yield sure()
                waiting = 0
            cut = to
    if found:
        yield sure()


def join(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of the links ``x, y`` connect what wasn't connected; ``label`` has the least member of each position's class and is brought up to date."""
    at = np.flatnonzero(label[x] != label[y])
    if not len(at):
        return at
    low, high = np.minimum(label[x[at]], label[y[at]]), np.maximum(label[x[at]], label[y[at]])
    _, first = np.unique(low * len(label) + high, return_index=True)
    root: dict[int, int] = {}

    def find(v: int) -> int:
        while (up := root.get(v, v)) != v:
            root[v] = root.get(up, up)
            v = up
        return v

    used = []
    for k, u, v in zip(first.tolist(), low[first].tolist(), high[first].tolist()):
        u, v = find(u), find(v)
        if u != v:
            root[max(u, v)] = min(u, v)
            used.append(k)
    now = np.arange(len(label))
    now[list(root)] = [find(v) for v in list(root)]
    label[:] = now[label]
    return at[used]


def labels(prints: np.ndarray, radius: int) -> np.ndarray:
    """The least position that each of a few fingerprints is connected with."""
    label = np.arange(prints.shape[1])
    for p, q in near(prints, prints, radius, same=True):
        join(label, p, q)
    return label


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                part, same = (batch.column(c)[r].as_py() for c in range(2))
                # the tiles stay where Arrow has them
                ids_a, copies_a, prints_a, ids_b, copies_b, prints_b = (np.frombuffer(batch.column(c)[r].as_buffer(), np.int64) for c in range(2, 8))
                a, b = (x.view(np.uint64).reshape(2, -1) for x in (prints_a, prints_b))
                shift = 0 if same else a.shape[1]
                ids = ids_a if same else np.concatenate([ids_a, ids_b])
                copies = copies_a if same else np.concatenate([copies_a, copies_b])
                label, many = np.arange(len(ids)), np.zeros(len(ids))
                for p, q in near(a, b, radius, same) if part < 0 else near_by_part(a, b, radius, part, same):
                    q = q + shift
                    many += np.bincount(p, copies[q], len(ids)) + np.bincount(q, copies[p], len(ids))
                    new = join(label, p, q)
                    if len(new):
                        yield pa.RecordBatch.from_arrays([pa.array(ids[p[new]]), pa.array(ids[q[new]]), pa.nulls(len(new), pa.int64())], schema=_LINKS)
                at = np.flatnonzero(many)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.nulls(len(at), pa.int64()), pa.array(many[at].astype(np.int64))], schema=_LINKS)

    return run


def links(one: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``a, b, links`` from distinct fingerprints ``keep_id, copies, f0, f1``, whose ``keep_id`` stands for them.

    A row with ``b`` is a link; those rows connect all that is connected.  The
    others say how many documents within the radius ``a`` has in some pair of
    tiles, or in some part of it.  The tiles are rows of a written table.  Their
    product is filtered on the range of population counts before any fingerprint
    reaches Python, and neither side is shuffled.
    """
    bits = one.withColumn("bits", F.bit_count("f0") + F.bit_count("f1")).select("bits", "keep_id", "copies", "f0", "f1")
    n = bits.count()
    each = n <= FEW or 2 * sum(len(ball(s)) for s in shares(radius)[1]) > len(_KEYS)
    ranges = bits.repartitionByRange("bits", "keep_id") if each else bits.repartitionByRange(-(-n // WIDE), "bits", "keep_id")
    packed = ranges.sortWithinPartitions("bits").mapInArrow(tk.tidy(_pack(TILE if each else WIDE)), "tile string, least int, most int, ids binary, copies binary, prints binary")
    tiles = written(packed, "simhash-tiles")
    spark = one.sparkSession
    parts = spark.range(-1, 0, 1, 1) if each else spark.range(0, _PARTS, 1, _PARTS)
    a = tiles.crossJoin(parts.withColumnRenamed("id", "part").hint("shuffle_replicate_nl")).alias("a")
    b = tiles.hint("shuffle_replicate_nl").alias("b")
    apart = F.greatest(F.col("a.least") - F.col("b.most"), F.col("b.least") - F.col("a.most"))
    both = a.join(b, (F.col("a.tile") <= F.col("b.tile")) & (apart <= radius))
    sides = [F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in ("ids", "copies", "prints")]
    return both.select("part", (F.col("a.tile") == F.col("b.tile")).alias("same"), *sides).mapInArrow(tk.tidy(_compare(radius)), "a long, b long, links long")


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node that each node of ``a, b`` is connected with.

    Alternates the large-star and small-star steps of Kiveris et al. (2014) until
    nothing changes; each step is written in the shared folder.  The least
    neighbours are aggregated before they are shuffled and joined, so that the
    many neighbours of a node needn't meet in one task.
    """
    with temporary(edges.sparkSession) as lasting:
        now, mark = written(edges.select("a", "b").distinct(), "components"), None
        while True:
            both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b"), F.col("a")))
            least = both.groupBy("u").agg(F.min("v").alias("m"))
            large = both.join(least, "u").where("v > u").select(F.least("m", "u").alias("a"), F.col("v").alias("b")).where("a != b").distinct()
            down = written(large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "components")
            small = down.join(down.groupBy("u").agg(F.min("v").alias("m")), "u")
            now = written(small.select(F.col("m").alias("a"), F.col("u").alias("b")).union(small.where("v != m").select("m", "v")).where("a != b").distinct(), "components")
            state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            if state == mark:
                break
            mark = state
        return lasting(now.select(F.col("b").alias("node"), F.col("a").alias("root")), "simhash-roots")


def groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``doc_id, keep_id, links`` of each document that has near duplicates.

    ``keep_id``, the smallest id of its class, names the class; ``links`` is the
    number of other documents within the radius.
    """
    found = written(signatures(docs), "simhash")
    one = written(found.groupBy("f0", "f1").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("copies")), "simhash-distinct")
    linked = written(links(one, radius), "simhash-links")
    roots = components(linked.where("b is not null"))
    many = linked.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    like = many.join(roots, F.col("node") == F.col("a"), "left").select(F.col("a").alias("keep_id"), F.coalesce("root", "a").alias("root"), "links")
    whole = one.join(like, "keep_id", "left").where("copies > 1 or root is not null")
    classes = written(whole.select("f0", "f1", F.coalesce("root", "keep_id").alias("keep_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links")), "simhash-classes")
    return found.join(small_or_not(classes, 48), ["f0", "f1"]).select("doc_id", "keep_id", "links")


def drop(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one document of each class of near duplicates."""
    held, closed = opened(docs, "doc_id", "text")
    held = held.withColumn("simhash_id", whole_number("doc_id"))
    gone = written(groups(docs, radius).where("doc_id <> keep_id").select(F.col("doc_id").alias("simhash_id")), "simhash-gone")
    again = written(held.where("simhash_id is not null").groupBy("simhash_id").count().where("count > 1").select("simhash_id"), "simhash-again")
    kept = held.join(small_or_not(gone, 16), "simhash_id", "left_anti")
    if again.isEmpty():
        return closed(kept)
    repeated = small_or_not(again, 16)
    # the least row of each is found before rows are shuffled, so a third of all may share an id
    once = kept.join(repeated, "simhash_id", "left_semi").groupBy("simhash_id").agg(F.min_by(F.struct(*held.columns), F.xxhash64(*held.columns)).alias("row")).select("row.*")
    return closed(kept.join(repeated, "simhash_id", "left_anti").select(*held.columns).unionByName(once))
