"""Exact Jaccard self-join on word n-grams, size-aware: small sets by fixed-size subsets, large ones by inverted lists.

Two sets of a and b shingles link when they share c(a, b) of them at least. A small set emits one key for each
of its subsets of the sizes c that partners ask for; a large set emits its rarest shingles, enough that linked
sets share one, whose inverted lists are then scanned. The boundary between small and large is the cheaper one
by the measured sizes and list lengths. Sets that are equal are one class from the start. The lists first give
each class a link to the list's smallest one, then to a neighbour in another component; where those links don't
yet make a list's classes one component, all remaining pairs of different components are verified. So large groups of near copies cost a few pairs
for each member, and no link between different components is lost.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, Staged, hash_words, join_spread, marks, may_be_marked, scramble, some_rows, stage, text_bytes

SLICES, SKETCH_BITS = 64, 21
SAMPLE = np.uint64(1 << 54)  # shingles below it (1 of 1,024) measure the list lengths
ODD = np.uint64(0x9E3779B97F4A7C15)
#: No boundary lies beyond the size for which a set would send so many subsets: they must fit in a task.
MOST_SUBSETS = 1 << 20


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingles of each text; a text of fewer words is one shingle, one without words has none."""
    for at, to in some_rows(column, 1 << 20):
        words, sizes, _ = hash_words(column.slice(at, to - at), BLANKS)

        def grams(of: np.ndarray, n: int) -> np.ndarray:
            h = np.full(max(0, len(of) - n + 1), n, np.uint64)
            for i in range(n):
                h = h * ODD + of[i : len(of) - n + 1 + i]
            return scramble(h)

        every, end = grams(words, width), np.cumsum(sizes)
        for n, e in zip(sizes.tolist(), end.tolist(), strict=True):
            yield np.unique(every[e - n : e - width + 1]) if n >= width else grams(words[e - n : e], n) if n else words[:0]


def overlap(a: int, b: int, percent: int) -> int:
    """The fewest common shingles of linked sets of a and b."""
    return -(-percent * (a + b) // (100 + percent))


def partners(n: int, percent: int) -> range:
    return range(-(-percent * n // 100), 100 * n // percent + 1)


def subset_sizes(n: int, most: int, percent: int) -> list[int]:
    """Sizes of the subsets that a small set of n emits for partners of up to ``most``."""
    return sorted({overlap(n, m, percent) for m in partners(n, percent) if m <= most})


def _subset_cost(n: int, most: int, percent: int) -> int:
    return sum(math.comb(n, c) for c in subset_sizes(n, most, percent))


def boundary(sizes: dict[int, int], list_length: float, percent: int) -> int:
    """The largest size of a small set: it makes subsets to be sent plus list entries to be scanned the fewest."""

    def cost(b: int) -> float:
        small = sum(k * _subset_cost(n, b, percent) for n, k in sizes.items() if n <= b)
        large = sum(k * (n - -(-percent * n // 100) + 1) * (1 + list_length) for n, k in sizes.items() if 100 * n // percent > b)
        return small + large

    most = 0
    while _subset_cost(most + 1, most + 1, percent) <= MOST_SUBSETS:
        most += 1
    return min(range(most + 1), key=lambda b: (cost(b), b))


def _fingerprint(own: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(own.tobytes())


def _number(fingerprint: bytes) -> int:
    return int.from_bytes(fingerprint[:8], "big", signed=True)


#: Counts from FULL on stand for any number.
BINS, FULL = 64, 255


def histogram(own: np.ndarray) -> bytes:
    """A set's shingles by 6 bits of their hashes: two sets share no more than the sum of the smaller counts."""
    return np.minimum(np.bincount((own & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS), FULL).astype(np.uint8).tobytes()


def early(n, percent: int):
    """How many of a set's first keys can be the first that it shares with a set of its size or larger."""
    return n - -(-2 * percent * n // (100 + percent)) + 1


SCAN = "kind int, doc_id long, n long, print binary, bins binary, number long, counts binary"


def _scan(width: int):
    """Documents with set size and fingerprint (kind 0), slices of the shingle counts (1), sampled shingles (2)."""

    def rows(kind: int, **cols) -> pa.RecordBatch:
        size = len(next(iter(cols.values())))
        kinds = {"doc_id": pa.int64(), "n": pa.int64(), "print": pa.binary(), "bins": pa.binary(), "number": pa.int64(), "counts": pa.binary()}
        arrays = [pa.array(np.full(size, kind, np.int32))] + [cols[c] if c in cols else pa.nulls(size, t) for c, t in kinds.items()]
        return pa.RecordBatch.from_arrays(arrays, names=["kind", *kinds])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(1 << SKETCH_BITS, np.int64), False
        for batch in batches:
            n, prints, bins, every = [], [], [], []
            for own in shingle_sets(batch.column(1), width):
                n.append(len(own))
                prints.append(_fingerprint(own))
                bins.append(histogram(own))
                every.append(own)
            flat = np.concatenate(every) if every else np.zeros(0, np.uint64)
            counts += np.bincount((flat >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
            seen = seen or len(flat) > 0
            yield rows(0, doc_id=batch.column(0), n=pa.array(n, pa.int64()), print=pa.array(prints, pa.binary()), bins=pa.array(bins, pa.binary()))
            few = flat[flat < SAMPLE].astype(np.int64)
            if len(few):
                yield rows(2, number=pa.array(few))
        if seen:
            parts = [zlib.compress(np.minimum(x, 65535).astype(np.uint16).tobytes(), 1) for x in np.split(counts, SLICES)]
            yield rows(1, number=pa.array(np.arange(SLICES)), counts=pa.array(parts, pa.binary()))

    return scan


def _sum_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up slices that come sorted by number."""
    now, total = None, None

    def out():
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())], names=["number", "counts"])

    for batch in batches:
        for i, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            c = np.frombuffer(zlib.decompress(c), np.uint16).astype(np.int64)
            if i != now:
                if now is not None:
                    yield out()
                now, total = i, c
            else:
                total += c
    if now is not None:
        yield out()


def keys_of(own: np.ndarray, counts: np.ndarray, small: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a set and the place of each in its order by rarity (-1: a subset's key)."""
    n = len(own)
    found, places = [], []
    if 0 < n <= small:
        for c in subset_sizes(n, small, percent):
            every = np.array(list(combinations(range(n), c)))
            h = np.full(len(every), 1_000_003 + c, np.uint64)
            for i in range(c):
                h = h * ODD + own[every[:, i]]
            found.append(scramble(h))
            places.append(np.full(len(every), -1, np.int32))
    if n and 100 * n // percent > small:
        order = np.argsort(counts[(own >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")
        rare = own[order[: n - -(-percent * n // 100) + 1]]
        found.append(rare)
        places.append(np.arange(len(rare), dtype=np.int32))
    return (np.concatenate(found), np.concatenate(places)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int32))


def _postings(shared, small: int, width: int, percent: int):
    """Keys with class, size, place in the order by rarity, and late: the set can only be the larger of a pair that meets here first."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.frombuffer(shared.value, np.uint32)
        for batch in batches:
            keys, places, owner, size, late = [], [], [], [], []
            for own in shingle_sets(batch.column(0), width):
                if len(own):
                    k, p = keys_of(own, counts, small, percent)
                    keys.append(k.astype(np.int64))
                    places.append(p)
                    owner.append(np.full(len(k), _number(_fingerprint(own)), np.int64))
                    size.append(np.full(len(k), len(own), np.int32))
                    late.append(p >= early(len(own), percent))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, owner, size, places, late)], names=["key", "fp", "n", "place", "late"])

    return post


class _Carried:
    """What of a batch the next one needs: its last entry, and of that entry's list the first early entry and the last one before."""

    def __init__(self) -> None:
        self.entry, self.lead, self.before = None, None, None


def _stars(percent: int):
    """Lists come sorted by key, n, late, fp. Kind 0: each class with its list's first early one; kind 1: the entries that have a partner in their list.

    A pair's smaller set is an early entry of the first list that both are in. So an early entry has a partner if
    the next entry is near in size or the early one before it is, a late entry if the early one before it is.
    """

    def near(small: np.ndarray, large: np.ndarray) -> np.ndarray:
        return small.astype(np.int64) * 100 >= large.astype(np.int64) * percent

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Carried()

        def found(cols: list[np.ndarray], last: bool) -> pa.RecordBatch | None:
            if held.entry is not None:
                cols = [np.r_[x, y] for x, y in zip(held.entry, cols, strict=True)]
            key, fp, n, place, late = cols
            if not len(key):
                return None
            rows = np.arange(len(key))
            start = np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], rows, 0))
            seen = np.maximum.accumulate(np.where(late, -1, rows))  # the last early entry at or before
            ahead = np.r_[-1, seen[:-1]]
            has = ahead >= start
            before = np.where(has, n[np.maximum(ahead, 0)], 0)
            order = np.flatnonzero(~late)
            first = np.append(order, len(key))[np.searchsorted(order, start)]  # of a list the first early entry
            led = first < rows
            first = np.minimum(first, len(key) - 1)
            lead_fp, lead_n, lead_place = fp[first], n[first], place[first]
            if held.before is not None and held.before[0] == key[0]:
                run = start == 0
                early_now = run & ~has
                before[early_now], has = held.before[1], has | early_now
                lead_fp[run], lead_n[run], lead_place[run], led = *held.lead, led | run
            follows = np.r_[(key[1:] == key[:-1]) & near(n[:-1], n[1:]), False]
            alive = (~late & follows) | (has & near(before, n))
            upto = len(key) if last else len(key) - 1
            need = -(-percent * (lead_n.astype(np.int64) + n) // (100 + percent))
            left = np.minimum(lead_n - np.maximum(lead_place, 0), n - np.maximum(place, 0))
            star = (led & (lead_fp != fp) & near(lead_n, n) & (left >= need))[:upto]
            pairs = np.unique(np.stack([fp[:upto][star], lead_fp[:upto][star]], 1), axis=0) if star.any() else np.zeros((0, 2), np.int64)
            if not last:
                i = len(key) - 1
                held.entry = [x[i:] for x in cols]
                held.before = (key[i], before[i]) if has[i] else None
                held.lead = (lead_fp[i], lead_n[i], lead_place[i]) if has[i] else None
            alive = alive[:upto]
            kind, none = np.r_[np.zeros(len(pairs), np.int32), np.ones(int(alive.sum()), np.int32)], np.zeros(len(pairs), np.int32)
            a, b = np.r_[pairs[:, 0], key[:upto][alive]], np.r_[pairs[:, 1], fp[:upto][alive]]
            return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(a), pa.array(b), pa.array(np.r_[none, n[:upto][alive]]), pa.array(np.r_[none, place[:upto][alive]])], names=["kind", "a", "b", "n", "place"])

        for batch in batches:
            if batch.num_rows:
                yield found([c.to_numpy(zero_copy_only=False) for c in batch.columns], False)
        if held.entry is not None:
            yield found([x[:0] for x in held.entry], True)

    return sweep


def _bins(column: pa.Array) -> np.ndarray:
    counts = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BINS).astype(np.int64)
    counts[counts == FULL] = 1 << 40
    return counts


def list_pairs(fp: np.ndarray, n: np.ndarray, place: np.ndarray, root: np.ndarray, part: np.ndarray, bins: np.ndarray, percent: int, across: bool) -> Iterator[np.ndarray]:
    """Pairs of a list's classes (sorted by size) in different components that can still link; ``across``: of different parts only."""
    roots, at = np.unique(root, return_inverse=True)
    if len(roots) < 2:
        return
    most = np.bincount(at).argmax()
    # each entry outside the largest component is held against the others of its size range, once
    for i in np.flatnonzero(at != most):
        lo, hi = np.searchsorted(n, -(-percent * n[i] // 100)), np.searchsorted(n, 100 * n[i] // percent, "right")
        # from this shingle on, no more can be common than either has left
        need = -(-percent * (n[lo:hi] + n[i]) // (100 + percent))
        left = np.minimum(n[lo:hi] - np.maximum(place[lo:hi], 0), n[i] - max(place[i], 0))
        hit = np.flatnonzero((at[lo:hi] != at[i]) & (left >= need) & ((part[lo:hi] != part[i]) | (not across)) & ((at[lo:hi] == most) | (np.arange(lo, hi) < i)))
        hit = hit[np.minimum(bins[lo:hi][hit], bins[i]).sum(1) >= need[hit]]
        if len(hit):
            other = fp[lo:hi][hit]
            yield np.stack([np.maximum(other, fp[i]), np.minimum(other, fp[i])], 1)


def _some_pairs(percent: int, seed: int):
    """Of each list, neighbours in an order by hash that are in different components and can link.

    They bring large groups together with a few pairs for each member; what they leave is for ``_pairs``.
    """

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows < 2:
                continue
            key, fp, n, _, root = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[:5])
            order = np.lexsort((scramble(key.view(np.uint64) ^ (fp.view(np.uint64) * ODD) + np.uint64(seed)), key))
            a, b = order[:-1], order[1:]
            need = -(-percent * (n[a] + n[b]) // (100 + percent))
            hit = np.flatnonzero((key[a] == key[b]) & (root[a] != root[b]) & (np.minimum(n[a], n[b]) >= need))
            if len(hit):
                a, b, bins = a[hit], b[hit], _bins(batch.column(5))
                likely = np.minimum(bins[a], bins[b]).sum(1) >= need[hit]
                pairs = np.unique(np.stack([np.maximum(fp[a], fp[b])[likely], np.minimum(fp[a], fp[b])[likely]], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return sweep


#: Entries of a list that are compared in one task; a longer list is dealt to parts, and every two parts (and each with itself) make a cell.
LIST_PART = 4096


def in_cells(entries: DataFrame) -> DataFrame:
    """``entries`` (key and others) with part, and across: whether their cell is of two parts; a row for each cell that an entry is in, whose number is cell."""
    many = entries.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > LIST_PART)
    many = stage(many.select("key", F.ceil(F.col("_n") / LIST_PART).cast("int").alias("_parts")), "jaccard_long_lists")
    wide = entries.join(many, "key", "left").withColumn("part", F.pmod(F.xxhash64("class_id"), F.coalesce("_parts", F.lit(1))).cast("int"))
    wide = wide.withColumn("_other", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
    cell = F.least("part", "_other").cast("long") * 1_000_000 + F.greatest("part", "_other")
    return wide.withColumn("cell", F.when(F.col("_parts").isNotNull(), cell).otherwise(F.lit(0).cast("long"))).withColumn("across", (F.col("part") != F.col("_other")).cast("long")).drop("_parts", "_other")


def _pairs(percent: int):
    """Cells come sorted by key, cell and n; what of a cell can meet entries of the next batch is held over."""

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_bins = np.zeros((8, 0), np.int64), np.zeros((0, BINS), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1, 2, 3, 4, 6, 7, 8)])
            cols, bins = np.concatenate([held, cols], 1), np.concatenate([held_bins, _bins(batch.column(5))])
            edges = np.flatnonzero(np.r_[True, (cols[0][1:] != cols[0][:-1]) | (cols[6][1:] != cols[6][:-1]), True])
            found = [x for s, e in zip(edges[:-1], edges[1:], strict=True) for x in list_pairs(*cols[1:6, s:e], bins[s:e], percent, bool(cols[7, s]))]
            held, held_bins = cols[:, edges[-2] :], bins[edges[-2] :]
            reach = held[2] * 100 >= held[2][-1] * percent
            held, held_bins = held[:, reach], held_bins[reach]
            if found:
                every = np.unique(np.concatenate(found), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(every[:, 0]), pa.array(every[:, 1])], names=["a", "b"])

    return sweep


def _plausible(percent: int):
    """Pairs whose histograms allow a link."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = _bins(batch.column(2)), _bins(batch.column(3))
                need = -(-percent * (batch.column(4).to_numpy() + batch.column(5).to_numpy()) // (100 + percent))
                yield batch.select([0, 1]).filter(pa.array(np.minimum(a, b).sum(1) >= need))

    return keep


#: Stands for a missing id where ids are marked.
NO_ID = -(1 << 62)


def _sets(width: int, bitmap, bits: int):
    """fp and shingles of the texts whose id is marked, of equal sets in a batch one."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(may_be_marked(batch.column(0), bitmap.value, bits))
            own = {_number(_fingerprint(x)): x.tobytes() for x in shingle_sets(batch.column(1), width)}
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int64()), pa.array(list(own.values()), pa.binary())], names=["fp", "shingles"])

    return build


def sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """fp and shingles of the classes in ``wanted`` (fp, class_id), from the rows whose id names them. A bitmap of the ids keeps most other texts from being read into sets."""
    bitmap, bits = marks(wanted.select(F.coalesce("class_id", F.lit(NO_ID)).alias("id")))
    texts = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), text_bytes().alias("t"))
    sets = texts.mapInArrow(_sets(width, docs.sparkSession.sparkContext.broadcast(bitmap), bits), "fp long, shingles binary")
    return sets.join(wanted.select("fp"), "fp").dropDuplicates(["fp"]).select("fp", "shingles")


def _verify(percent: int):
    """Groups come as the second class's set (kind 0) and those of the first ones (1): the pairs that link."""

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lead = None, None
        for batch in batches:
            linked = ([], [])
            for b, salt, kind, a, t in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                own = np.frombuffer(t, np.uint64)
                if kind == 0:
                    now, lead = (b, salt), own
                elif now == (b, salt):
                    common = len(np.intersect1d(own, lead, assume_unique=True))
                    if 100 * common >= percent * (len(own) + len(lead) - common):
                        linked[0].append(a)
                        linked[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in linked], names=["a", "b"])

    return sweep


#: Pairs of one class that are verified by one task; a class with more is spread over several.
VERIFY_GROUP = 256


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int, percent: int, staged: Staged) -> DataFrame:
    """Those of ``pairs`` (a, b: fp of ``classes``) whose sets link."""
    ids = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct()
    wanted = staged.put(classes.select("fp", "class_id").join(ids, "fp"), "wanted")
    sets = staged.put(sets_of(docs, wanted, width), "sets")
    many = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("_rows")).withColumn("_k", F.ceil(F.col("_rows") / VERIFY_GROUP))
    salted = join_spread(pairs, staged.put(many, "many"), "b").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("_k")).cast("int"))
    salted = staged.put(salted.select("a", "b", "salt"), "salted")
    one = salted.join(sets, salted["a"] == sets["fp"]).select("b", "salt", F.lit(1).alias("kind"), "a", "shingles")
    heads = salted.select("b", "salt").distinct()
    two = heads.join(sets, heads["b"] == sets["fp"]).select("b", "salt", F.lit(0).alias("kind"), F.col("b").alias("a"), "shingles")
    dealt = two.unionByName(one).repartition("b", "salt").sortWithinPartitions("b", "salt", "kind")
    out = staged.put(dealt.mapInArrow(_verify(percent), "a long, b long"), "links")
    staged.drop(wanted, sets, salted)
    return out


def components(links: DataFrame, staged: Staged | None = None) -> DataFrame:
    """node and root (the smallest node of its component) for every node of ``links`` (a, b): least-neighbour contraction."""
    staged = staged or Staged(links.sparkSession, "components")
    edges = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    edges, roots = staged.put(edges, "edges"), None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a")).toDF("node", "up")
        up = staged.put(both.groupBy("node").agg(F.least("node", F.min("up")).alias("up")), "up")
        while True:  # follow the pointers to their ends
            over = up.select(F.col("node").alias("_n"), F.col("up").alias("_u"))
            step = up.join(over, up["up"] == over["_n"], "left").select("node", F.coalesce("_u", "up").alias("up"), (F.col("_u") < F.col("up")).alias("moved"))
            step = staged.put(step, "up")
            up = step.select("node", "up")
            if step.filter("moved").isEmpty():
                break
        x = up.select(F.col("node").alias("_n"), F.col("up").alias("_u"))
        if roots is None:
            roots = up.withColumnRenamed("up", "root")
        else:
            roots = staged.put(roots.join(x, roots["root"] == x["_n"], "left").select("node", F.coalesce("_u", "root").alias("root")), "roots")
        moved = edges.join(x, edges["a"] == x["_n"]).select(F.col("_u").alias("a"), "b")
        moved = moved.join(x, moved["b"] == x["_n"]).select("a", F.col("_u").alias("b"))
        edges = staged.put(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    return roots if roots is not None else links.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)


def joined(roots: DataFrame, more: DataFrame, staged: Staged) -> DataFrame:
    """``roots`` as ``components`` gives them, with further links: only the components that these bring together are contracted."""
    x, y = roots.toDF("a", "_ra"), roots.toDF("b", "_rb")
    tops = more.join(x, "a", "left").join(y, "b", "left").select(F.coalesce("_ra", "a").alias("a"), F.coalesce("_rb", "b").alias("b"))
    top = components(staged.put(tops.distinct(), "tops"), staged).toDF("_top", "_root")
    new = more.select("a").union(more.select("b")).distinct().toDF("node").join(roots, "node", "left_anti")
    every = roots.unionByName(new.select("node", F.col("node").alias("root")))
    return staged.put(every.join(top, every["root"] == top["_top"], "left").select("node", F.coalesce("_root", "root").alias("root")), "roots")


def jaccard_components(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest id with an equal set) and component_id of every document.

    A-Z count as lower case; words are separated by \\x20 and \\x09-\\x0D. A document without words (null, empty,
    blank) links with nothing. Rows of one doc_id are rows of their own, each with the class and component of its
    own text; rows without an id link as all others do, but only ids name classes and components, so where no
    member has one the name is null. An empty table gives an empty result; further columns of ``docs`` are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spark, staged = docs.sparkSession, Staged(docs.sparkSession, "jaccard")
    put = staged.put
    scan = put(docs.select("doc_id", text_bytes().alias("t")).mapInArrow(_scan(width), SCAN), "scan")
    slices = scan.filter("kind = 1").select("number", "counts")
    summed = slices.repartition(SLICES // 8, "number").sortWithinPartitions("number").mapInArrow(_sum_counts, "number long, counts binary").coalesce(SLICES // 8)
    counts, each = bytearray(4 << SKETCH_BITS), (4 << SKETCH_BITS) // SLICES
    for row in summed.collect():  # 8 MB, 4 bytes for each of the sketch's cells, whatever the input
        counts[row["number"] * each : (row["number"] + 1) * each] = row["counts"]
    members = scan.filter("kind = 0").select("doc_id", F.col("n").alias("n_shingles"), "print", "bins")
    classes = members.filter("n_shingles > 0").groupBy("print").agg(F.min("doc_id").alias("class_id"), F.first("n_shingles").alias("n"), F.first("bins").alias("bins"), F.count(F.lit(1)).alias("_rows"))
    classes = put(classes.withColumn("fp", F.conv(F.hex(F.substring("print", 1, 8)), 16, -10).cast("long")), "classes")
    sizes = {r["n"]: r["k"] for r in classes.groupBy("n").agg(F.count(F.lit(1)).alias("k")).filter(F.col("n") <= 64).collect()}
    lists = scan.filter("kind = 2").groupBy("number").agg(F.count(F.lit(1)).cast("double").alias("k")).agg(F.sum(F.col("k") * F.col("k")) / F.sum("k")).first()[0]
    small = boundary(sizes, lists or 1.0, percent)

    shared = spark.sparkContext.broadcast(bytes(counts))
    posts = docs.select(text_bytes().alias("t")).mapInArrow(_postings(shared, small, width, percent), "key long, fp long, n int, place int, late boolean")
    swept = posts.repartition("key").sortWithinPartitions("key", "n", "late", "fp").mapInArrow(_stars(percent), "kind int, a long, b long, n int, place int")
    swept = put(swept, "lists")

    ids = classes.select("fp", "bins", F.col("n").alias("size"))
    x, y = ids.toDF("a", "_ba", "_na"), ids.toDF("b", "_bb", "_nb")
    stars = swept.filter("kind = 0").select("a", "b").distinct().join(x, "a").join(y, "b")
    tried = put(stars.select("a", "b", "_ba", "_bb", "_na", "_nb").mapInArrow(_plausible(percent), "a long, b long"), "tried")
    roots = components(verified(tried, docs, classes, width, percent, staged), staged)
    entries = put(swept.filter("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("class_id"), "n", "place").distinct(), "entries")
    staged.drop(swept)
    for sweep in (_some_pairs(percent, 1), _some_pairs(percent, 2), None):
        z = roots.toDF("class_id", "_root")
        placed = put(entries.join(z, "class_id", "left").select("key", "class_id", "n", "place", F.coalesce("_root", "class_id").alias("root")), "placed")
        # lists that are one component by now are done with
        still = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("key")
        opened = put(placed.join(still, "key", "left_semi"), "open")
        staged.drop(entries, placed)
        entries = opened.drop("root")
        entries._staged_at = opened._staged_at
        held = opened.join(ids.select(F.col("fp").alias("class_id"), "bins"), "class_id").select("key", "class_id", "n", "place", "root", "bins")
        if sweep is not None:
            left = held.repartition("key").sortWithinPartitions("key", "n", "class_id").mapInArrow(sweep, "a long, b long").distinct()
        else:
            cells = in_cells(held).select("key", "class_id", "n", "place", "root", "bins", "part", "cell", "across")
            left = cells.repartition("key", "cell").sortWithinPartitions("key", "cell", "n", "class_id").mapInArrow(_pairs(percent), "a long, b long").distinct()
        left = put(left.join(tried.union(tried.select("b", "a")), ["a", "b"], "left_anti"), "left")
        if not left.isEmpty():
            more = verified(left, docs, classes, width, percent, staged)
            tried, roots = put(tried.union(left), "tried"), joined(roots, more, staged)
    z = roots.toDF("fp", "_root")
    named = put(classes.select("print", "fp", "class_id", "_rows").join(z, "fp", "left").withColumn("root", F.coalesce("_root", "fp")), "rooted")
    names = put(named.groupBy("root").agg(F.min("class_id").alias("component_id"), F.count(F.lit(1)).alias("_rows")), "names")
    named = put(join_spread(named.select("print", "class_id", "root", F.col("_rows").alias("_members")), names, "root").select("print", "class_id", "component_id", F.col("_members").alias("_rows")), "named")
    some = join_spread(members.filter("n_shingles > 0").drop("bins"), named, "print").select("doc_id", "n_shingles", "class_id", "component_id")
    none = members.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
    out = Staged(spark, "components").put(some.unionByName(none), "documents")
    staged.drop()
    return out
