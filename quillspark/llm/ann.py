"""Approximate nearest neighbours by p-stable hashing with multiprobe.

A table's hash takes floor((a . x + b) / width) for a few Gaussian directions a. A query visits, in every table,
its own bucket and those that differ from it by one step in some of the directions, in the order of the
probability that a neighbour falls there, as many as a bounded sample shows to be needed for the wanted recall.
Width and number of tables are the cheapest on that sample for the numbers of rows and queries at hand. The
candidates of all tables are merged and ranked by exact distance.

Equal vectors are searched for once: a class keeps its k + 1 smallest ids, which are all that a result can show.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Staged

DIRECTIONS, SEED = 6, 11
#: Bucket widths to choose from, as shares of the sample's median distance, and numbers of tables; wanted recall on the sample.
WIDTHS, TABLES, RECALL = (0.4, 0.8, 1.6, 2.2, 3.0), (2, 4, 6), 0.96
#: Rows (those with the smallest class hashes) that all this is fitted on; every row is indexed.
SAMPLE_ROWS, SAMPLE_QUERIES = 2048, 128
#: What dealing a vector to a bucket costs, in computed distances.
SHIPPING = 80
#: Candidates and queries of a bucket that one task holds together; larger buckets are split.
CANDIDATES, QUERIES = 8192, 4096
#: Rows that a task gathers before it drops those that can't be among the nearest.
GATHERED = 200_000
PERTURBED = np.array(sorted(itertools.product((-1, 0, 1), repeat=DIRECTIONS), key=lambda p: sum(map(abs, p))), np.int64)
STEPS = np.concatenate([PERTURBED == -1, PERTURBED == 0, PERTURBED == 1], 1).astype(np.float64)


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    """Equally long vectors of bytes as rows of doubles."""
    data = column.to_pylist()
    return np.frombuffer(b"".join(data), kind).reshape(len(data), -1).astype(np.float64)


def _classes(kind: str):
    """vec_id, class (128 bits of the vector) and the vector as bytes; -0.0 becomes 0.0."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False).astype(kind) + np.zeros(1, kind), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            vectors = [x.tobytes() for x in np.split(flat, ends[:-1])] if len(ends) else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([xxhash.xxh3_128_digest(v) for v in vectors], pa.binary()), pa.array(vectors, pa.binary())], names=["vec_id", "class", "vector"])

    return name


def valid_vectors(vectors: DataFrame) -> DataFrame:
    x = F.col("embedding")
    finite = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    usable = x.isNotNull() & (F.size(x) > 0) & finite & F.exists(x, lambda v: v != 0) & F.col("vec_id").isNotNull()
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(F.coalesce(usable, F.lit(False)))


class Tables:
    """Directions, offsets and width of ``many`` tables, for vectors of one dimension."""

    def __init__(self, dim: int, width: float, spread: float, many: int) -> None:
        rng = np.random.default_rng([SEED, dim])
        self.a = rng.normal(size=(max(TABLES), dim, DIRECTIONS))
        self.b = rng.uniform(0, width, (max(TABLES), DIRECTIONS))
        self.width, self.spread, self.many = width, spread, many

    def places(self, t: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bucket coordinates and the place inside the bucket (0 to 1)."""
        y = (x @ self.a[t] + self.b[t]) / self.width
        return np.floor(y).astype(np.int64), y - np.floor(y)

    def order(self, inside: np.ndarray) -> np.ndarray:
        """Perturbations by estimated success, for every query: a neighbour's offset is Gaussian in each direction."""
        s = self.spread / self.width
        below = lambda z: 0.5 * (1 + np.vectorize(math.erf)(z / math.sqrt(2)))
        low, mid = below(-inside / s), below((1 - inside) / s)
        chances = np.concatenate([low - below((-1 - inside) / s), mid - low, below((2 - inside) / s) - mid], 1)
        return np.argsort(-(np.log(np.maximum(chances, 1e-12)) @ STEPS.T), axis=1, kind="stable")


def bucket_number(t: int, places: np.ndarray) -> np.ndarray:
    h = np.full(len(places), 1_000_003 * (t + 1), np.uint64)
    for i in range(places.shape[1]):
        h = (h ^ places[:, i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.astype(np.int64)


def fit(sample: np.ndarray, k: int, rows: int, queries: int) -> dict | None:
    """Width, spread of a neighbour's offset, tables, and probes a table for the wanted recall, at the least cost for so many rows and queries."""
    if len(sample) < 2:
        return None
    asked = sample[:SAMPLE_QUERIES]
    square = (asked**2).sum(1)[:, None] + (sample**2).sum(1) - 2 * asked @ sample.T
    distance = np.sqrt(np.maximum(square, 0))
    distance[np.arange(len(asked)), np.arange(len(asked))] = np.inf
    near = np.argsort(distance, 1)[:, : min(k, len(sample) - 1)]
    reach = np.take_along_axis(distance, near, 1)
    usual = float(np.median(distance[np.isfinite(distance)])) / math.sqrt(2) or 1.0
    spread = float(np.median(reach)) or usual / 100
    best = None
    for share in WIDTHS:
        tables = Tables(sample.shape[1], share * usual, spread, max(TABLES))
        first = np.full(near.shape, len(PERTURBED))
        met = np.zeros((max(TABLES), len(asked), len(PERTURBED)))  # rows of the sample by table, query and rank of their bucket
        for t in range(max(TABLES)):
            places, inside = tables.places(t, sample)
            rank = np.argsort(tables.order(inside[: len(asked)]), 1)
            for q in range(len(asked)):
                off = places - places[q]
                close = np.flatnonzero((np.abs(off) <= 1).all(1))
                ranks = rank[q, _numbered(off[close])]
                met[t, q] += np.bincount(ranks, minlength=len(PERTURBED))
                where = np.full(len(sample), len(PERTURBED))
                where[close] = ranks
                first[q] = np.minimum(first[q], where[near[q]])
            if t + 1 in TABLES:
                need = int(np.sort(first.ravel())[min(first.size - 1, math.ceil(RECALL * first.size))]) + 1
                probes = min(len(PERTURBED), need)
                visited = met[: t + 1, :, :probes].sum() / len(asked) / len(sample)
                cost = queries * visited * rows + SHIPPING * (t + 1) * (rows + queries * probes)
                if need <= len(PERTURBED) and (best is None or cost < best[0]):
                    best = cost, {"width": share * usual, "spread": spread, "probes": probes, "many": t + 1}
    return best[1] if best else {"width": WIDTHS[-1] * usual, "spread": spread, "probes": len(PERTURBED), "many": max(TABLES)}


NUMBER = np.zeros(3**DIRECTIONS, np.int64)
NUMBER[((PERTURBED + 1) * 3 ** np.arange(DIRECTIONS)).sum(1)] = np.arange(len(PERTURBED))


def _numbered(steps: np.ndarray) -> np.ndarray:
    """Places in PERTURBED of rows of -1, 0 and 1."""
    return NUMBER[((steps + 1) * 3 ** np.arange(DIRECTIONS)).sum(1)]


def _hash(models: dict, kind: str, probe: bool, vectors: bool):
    """Rows (bucket, class, and vector if asked for): of each vector's buckets, or of all buckets that a query visits."""
    size = np.dtype(kind).itemsize

    def rows(buckets: np.ndarray, own: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(buckets), *own.columns[: 1 + vectors]], names=["bucket", "class", "vector"][: 2 + vectors])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Tables] = {}
        for batch in batches:
            sizes = np.array([len(v) // size for v in batch.column(1).to_pylist()], np.int64)
            for dim in np.unique(sizes).tolist():
                own = batch.filter(pa.array(sizes == dim))
                model = models.get(dim)
                if model is None:  # at most one vector of this dimension
                    yield rows(np.full(own.num_rows, dim), own)
                    continue
                x = _matrix(own.column(1), kind)
                tables = made.setdefault(dim, Tables(dim, model["width"], model["spread"], model["many"]))
                for t in range(tables.many):
                    places, inside = tables.places(t, x)
                    if not probe:
                        yield rows(bucket_number(t + dim * max(TABLES), places), own)
                        continue
                    for at in range(0, len(x), 64):
                        best = tables.order(inside[at : at + 64])[:, : model["probes"]]
                        spots = places[at : at + 64][:, None] + PERTURBED[best]
                        taken = own.take(pa.array(np.repeat(np.arange(at, at + len(best)), best.shape[1])))
                        yield rows(bucket_number(t + dim * max(TABLES), spots.reshape(-1, DIRECTIONS)), taken)

    return deal


def distances(queries: np.ndarray, candidates: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of places with their distance: at least the ``k`` nearest candidates of every query, and all as near as the last of them.

    A product of matrices finds which can be so near; their distances are then computed from the differences.
    """
    q2, c2 = (queries**2).sum(1), (candidates**2).sum(1)
    out = []
    for at in range(0, len(queries), 128):
        q = queries[at : at + 128]
        rough = q2[at : at + 128, None] + c2 - 2 * q @ candidates.T
        slack = 1e-12 * candidates.shape[1] * (q2[at : at + 128, None] + c2.max())
        edge = np.partition(rough, k - 1, 1)[:, k - 1 : k] if len(candidates) > k else np.full((len(q), 1), np.inf)
        i, j = np.nonzero(rough <= edge + slack)
        out.append((i + at, j, np.sqrt(((candidates[j] - q[i]) ** 2).sum(1))))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def nearest_rows(q: np.ndarray, c: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of rows that are among the ``k`` nearest different ones of their query, or as near as the last; q and c are pairs of numbers."""
    order = np.lexsort((c[:, 1], c[:, 0], score, q[:, 1], q[:, 0]))
    q, c, score = q[order], c[order], score[order]
    same = (q[1:] == q[:-1]).all(1)
    new = np.append(True, ~(same & (c[1:] == c[:-1]).all(1)))
    order, score, head = order[new], score[new], np.append(True, ~same)[new]
    starts = np.flatnonzero(head)
    group = np.cumsum(head) - 1
    last = np.minimum(starts + k - 1, np.append(starts[1:], len(order)) - 1)
    return order[score <= score[last][group]]


def _search(k: int, kind: str):
    """Cells come as queries (kind 0), then candidates (1): the k nearest of every query that this task has met."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, names, asked = None, [], []
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def halves(digests: list[bytes]) -> np.ndarray:
            return np.frombuffer(b"".join(digests), ">i8").reshape(-1, 2).astype(np.int64)

        def reduced() -> tuple[np.ndarray, ...]:
            q, c, score = (np.concatenate(x) for x in zip(*held, strict=True))
            keep = nearest_rows(q, c, score, k)
            return q[keep], c[keep], score[keep]

        def out(q: np.ndarray, c: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
            names = [pa.array([x.tobytes() for x in d.astype(">i8")], pa.binary()) for d in (q, c)]
            return pa.RecordBatch.from_arrays([*names, pa.array(score)], names=["q", "class", "score"])

        size = 0
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], 1)
            edges = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1), True]) if len(keys) else [0]
            for at, end in zip(edges[:-1], edges[1:], strict=True):
                part, own = batch.slice(at, end - at), tuple(keys[at, :3])
                if own != cell:
                    cell, names, asked = own, [], []
                if keys[at, 3] == 0:
                    names += part.column(4).to_pylist()
                    asked.append(_matrix(part.column(5), kind))
                elif names:
                    i, j, score = distances(np.concatenate(asked), _matrix(part.column(5), kind), k)
                    held.append((halves(names)[i], halves(part.column(4).to_pylist())[j], score))
                    size += len(score)
                    if size > GATHERED:
                        held = [reduced()]
                        size = len(held[0][2])
                        if size > GATHERED // 2:
                            yield out(*held[0])
                            held, size = [], 0
        if held:
            yield out(*reduced())

    return search


def _nearest(index, probes, k: int, kind: str, staged: Staged) -> DataFrame:
    """q, class, score: at least the k nearest of each query in the buckets it visits. ``index`` and ``probes`` give rows with or without vectors."""
    held = index(False).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CANDIDATES)
    asked = probes(False).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > QUERIES)
    held = held.select("bucket", F.ceil(F.col("n") / CANDIDATES).cast("int").alias("parts"))
    asked = asked.select("bucket", F.ceil(F.col("n") / QUERIES).cast("int").alias("blocks"))
    split = staged.put(held.join(asked, "bucket", "full").select("bucket", F.coalesce("parts", F.lit(1)).alias("parts"), F.coalesce("blocks", F.lit(1)).alias("blocks")), "split")

    def cells(rows: DataFrame, number: int) -> DataFrame:
        wide = rows.join(split, "bucket", "left").fillna(1, ["parts", "blocks"])
        own, other = ("blocks", "parts") if number == 0 else ("parts", "blocks")
        wide = wide.withColumn("_own", F.pmod(F.xxhash64("class"), F.col(own)).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        block, part = ("_own", "_other") if number == 0 else ("_other", "_own")
        return wide.select("bucket", F.col(block).alias("block"), F.col(part).alias("part"), F.lit(number).alias("kind"), "class", "vector")

    dealt = cells(probes(True), 0).unionByName(cells(index(True), 1)).repartition("bucket", "block", "part").sortWithinPartitions("bucket", "block", "part", "kind")
    return dealt.mapInArrow(_search(k, kind), "q binary, class binary, score double").distinct()


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` nearest found of each of ``queries`` (vec_id, embedding), itself left out.

    Score: Euclidean distance in double precision; nearest first, ties to the smaller vec_id. Vectors that are
    null, empty, zero or hold null or non-finite components take no part, nor do rows without an id; vectors
    are compared within one dimension. Equal rows count once; a query that meets too few candidates is compared
    with all vectors. An empty table gives an empty result; further columns are not read.
    """
    staged = Staged(vectors.sparkSession, "ann")
    single = all(d.schema["embedding"].dataType == T.ArrayType(T.FloatType(), d.schema["embedding"].dataType.containsNull) for d in (vectors, queries))
    kind = "<f4" if single else "<f8"
    schema = "vec_id long, class binary, vector binary"
    rows = valid_vectors(vectors).mapInArrow(_classes(kind), schema)
    asked = staged.put(valid_vectors(queries).mapInArrow(_classes(kind), schema).select(F.col("vec_id").alias("query_id"), F.col("class").alias("q"), "vector"), "queries")
    first = rows.select("vec_id", "class").withColumn("_r", F.dense_rank().over(Window.partitionBy("class").orderBy("vec_id"))).filter(F.col("_r") <= k + 1)
    ids = first.groupBy("class").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    classes = staged.put(rows.groupBy("class").agg(F.first("vector").alias("vector")).join(ids, "class"), "classes")
    each = staged.put(asked.groupBy(F.col("q").alias("class")).agg(F.first("vector").alias("vector")), "asked")
    width = np.dtype(kind).itemsize
    count = lambda df: {r["dim"] // width: r["n"] for r in df.groupBy(F.length("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()}
    models, sizes = {}, count(each)
    for dim, n in count(classes).items():
        some = classes.filter(F.length("vector") == dim * width).select("class", "vector").orderBy("class").limit(SAMPLE_ROWS).collect()
        models[dim] = fit(np.frombuffer(b"".join(bytes(r["vector"]) for r in some), kind).reshape(len(some), dim).astype(np.float64), k, n, sizes.get(dim, 0))

    def hashed(df: DataFrame, probe: bool):
        return lambda full: df.select("class", "vector").mapInArrow(_hash(models, kind, probe, full), "bucket long, class binary" + ", vector binary" * full)

    found = staged.put(_nearest(hashed(classes, False), hashed(each, True), k + 1, kind, staged), "found")
    few = each.join(found.groupBy("q").agg(F.count(F.lit(1)).alias("n")), F.col("class") == F.col("q"), "left").filter(F.coalesce("n", F.lit(0)) < k + 1)
    few = staged.put(few.select("class", "vector"), "few")
    if not few.isEmpty():
        whole = lambda df: lambda full: df.select(F.length("vector").cast("long").alias("bucket"), "class", *["vector"] * full)
        found = found.unionByName(_nearest(whole(classes), whole(few), k + 1, kind, staged)).distinct()
    named = found.join(classes.select("class", "ids"), "class").withColumn("_first", F.col("ids")[0])
    top = named.withColumn("_r", F.row_number().over(Window.partitionBy("q").orderBy("score", "_first"))).filter(F.col("_r") <= k + 1)
    pairs = asked.select("query_id", "q").distinct().join(top.select("q", "score", F.explode("ids").alias("vec_id")), "q").filter("vec_id <> query_id")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).filter(F.col("rank") <= k)
    out = staged.put(ranked.select("query_id", "rank", "vec_id", "score"), "neighbours")
    staged.drop(asked, classes, each, few)
    return out
