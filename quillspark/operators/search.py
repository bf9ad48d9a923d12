"""Exact cosine search: a vector store is a DataFrame of id, ins_ord and embedding.

For many queries both sides are dealt into blocks whose sizes follow from their counts. A task takes a block of queries as
a matrix, and the rows of a block of the store go by it in order: a product for each stretch of rows, and for every
query the k best so far. The blocks' best are merged; no row stands for a pair of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillspark.functions import vector as V

#: Queries and rows of a block, and rows that are multiplied at once.
QUERY_ROWS, STORE_ROWS, STRETCH = 2048, 1 << 16, 1024
#: Digits to which scores are compared.
DIGITS = 12


def top_k(store: DataFrame, query: Column, k: int, where: Column | None = None) -> DataFrame:
    """id, score of the k nearest to one vector, ties in order of insertion: one scan, k rows a task."""
    rows = store if where is None else store.filter(where)
    rows = rows.withColumn("_e", V.doubles(F.col("embedding")))
    scored = rows.select("id", "ins_ord", (V.dot(F.col("_e"), query) / (V.norm(F.col("_e")) * V.norm(query))).alias("score"))
    return scored.orderBy(F.col("score").desc(), "ins_ord").limit(k).select("id", "score")


class Best:
    """The k best rows of each query so far; rows come in order, so of equal scores the one that is there stays."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.score = k, np.full((n, k), -np.inf)
        self.row = np.full((n, k), None, object)

    def take(self, scores: np.ndarray, rows: np.ndarray) -> None:
        scores = np.where(np.isnan(scores), -np.inf, np.round(scores, DIGITS) + 0.0)
        better = scores > self.score[:, -1:]
        some = np.flatnonzero(better.any(1))
        if len(some):
            every = np.concatenate([self.score[some], np.where(better[some], scores[some], -np.inf)], 1)
            order = np.argsort(-every, 1, kind="stable")[:, : self.k]
            self.score[some] = np.take_along_axis(every, order, 1)
            named = np.concatenate([self.row[some], np.broadcast_to(rows, (len(some), len(rows)))], 1)
            self.row[some] = np.take_along_axis(named, order, 1)


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Vectors as rows; those of another length than the first are zero, which is near nothing."""
    lengths = np.diff(column.offsets.to_numpy())
    width = width if width is not None else int(lengths[0]) if len(lengths) else 0
    if (lengths == width).all() and column.null_count == 0 and column.flatten().null_count == 0:
        return column.flatten().to_numpy().astype(np.float64).reshape(-1, width)
    rows = [x if x is not None and len(x) == width and None not in x else [0.0] * width for x in column.to_pylist()]
    return np.array(rows, np.float64).reshape(-1, width)


def _unit(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(1))


def _searched(k: int, schema: pa.Schema):
    """Rows (qb, sb, kind, query_id, grp, id, ins_ord, vector) come sorted: a block's queries (kind 0), then its rows by group and order."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, asked, matrix, group, best = None, [], None, None, None

        def out() -> Iterator[pa.RecordBatch]:
            if best is not None:
                i, j = np.nonzero(best.score > -np.inf)
                rows = best.row[i, j]
                columns = [[asked[x] for x in i], [group] * len(i), [r[0] for r in rows], [r[1] for r in rows], best.score[i, j]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            qb, sb, kind = (batch.column(i).to_numpy() for i in range(3))
            names, groups, ids, order = (batch.column(i).to_pylist() for i in range(3, 7))
            cut = [0, *(i for i in range(1, len(qb)) if qb[i] != qb[i - 1] or sb[i] != sb[i - 1] or kind[i] != kind[i - 1] or groups[i] != groups[i - 1]), len(qb)]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if (int(qb[a]), int(sb[a])) != key:
                    yield from out()
                    key, asked, matrix, best = (int(qb[a]), int(sb[a])), [], None, None
                if kind[a] == 0:
                    own = _matrix(batch.column(7)[a:b], None if matrix is None else matrix.shape[1])
                    asked, matrix = asked + names[a:b], own if matrix is None else np.concatenate([matrix, own])
                    continue
                if matrix is None:
                    continue
                if best is None or groups[a] != group:
                    yield from out()
                    group, best = groups[a], Best(len(asked), k)
                for at in range(a, b, STRETCH):
                    to = min(b, at + STRETCH)
                    own, rows = _matrix(batch.column(7)[at:to], matrix.shape[1]), np.empty(to - at, object)
                    rows[:] = list(zip(ids[at:to], order[at:to], strict=True))
                    with np.errstate(invalid="ignore", divide="ignore"):
                        best.take((matrix @ own.T) / np.outer(_unit(matrix), _unit(own)), rows)
        yield from out()

    return search


def top_k_groups(store: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, grp, rank, id, ins_ord, score: of every group of ``store`` (id, ins_ord, embedding, grp) the k nearest to each of ``queries`` (query_id, query).

    Any number of queries, rows and groups. Scores equal to DIGITS digits are ties, which go by ins_ord; vectors that are
    null, zero, of another length or hold nulls take no part. A group may lie in several blocks.
    """
    queries, store = queries.filter("query is not null"), store.filter("embedding is not null")
    q, s = max(1, -(-queries.count() // QUERY_ROWS)), max(1, -(-store.count() // STORE_ROWS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    null = lambda df, name: F.lit(None).cast(df.schema[name].dataType).alias(name)
    asked = queries.select(F.pmod(F.xxhash64("query_id"), F.lit(q)).cast("int").alias("qb"), every(s).alias("sb"), F.lit(0).alias("kind"), "query_id", null(store, "grp"), null(store, "id"), F.lit(None).cast("long").alias("ins_ord"), V.doubles(F.col("query")).alias("vector"))
    rows = store.select(every(q).alias("qb"), F.pmod(F.xxhash64("id", "grp"), F.lit(s)).cast("int").alias("sb"), F.lit(1).alias("kind"), null(queries, "query_id"), "grp", "id", F.col("ins_ord").cast("long").alias("ins_ord"), V.doubles(F.col("embedding")).alias("vector"))
    dealt = asked.unionByName(rows).repartition("qb", "sb").sortWithinPartitions("qb", "sb", "kind", "grp", "ins_ord")
    schema = T.StructType([T.StructField(n, t) for n, t in (("query_id", queries.schema["query_id"].dataType), ("grp", store.schema["grp"].dataType), ("id", store.schema["id"].dataType), ("ins_ord", T.LongType()), ("score", T.DoubleType()))])
    found = dealt.mapInArrow(_searched(k, to_arrow_schema(schema)), schema)
    rank = F.row_number().over(Window.partitionBy("query_id", "grp").orderBy(F.col("score").desc(), "ins_ord")).cast("long")
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def top_k_each(store: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, id, score: the k rows of the whole store nearest to each of ``queries`` (query_id, query)."""
    found = top_k_groups(store.select("id", "ins_ord", "embedding", F.lit(0).alias("grp")), queries, k)
    return found.select("query_id", "rank", "id", "score")
