"""How far the sources of a language lie apart in their words: a single-pass index in memory, spilled runs, merged shards.

Every task gathers postings in memory: term, source, count, documents. When these are as many as it may hold it spills
a run, cut by hashes of terms into shards and, within a shard, sorted by term. Shards are merged by a heap of the
runs' chunks, which opens a chunk only when the merge comes to its first term and takes off whole stretches of terms
at a time. Distances between sources are then summed in one stream over terms: a
source's terms are few of all, so the sum starts from the distance of two sources without any words, and every
posting corrects it.
"""

from __future__ import annotations

import heapq
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Staged, some_rows, text_bytes

#: The bytes of [^\x00-\x40\x5B-\x60\x7B-\x7F]+ in UTF-8, and one that parts terms.
TERM, GAP = re.compile(rb"[A-Za-z\x80-\xff]+"), re.compile(rb"[^A-Za-z\x80-\xff]")
MIN_DOCS, ADDED, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Every byte as letters of terms have it, all others blanks.
FOLD = np.array([b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)], np.uint8)
#: A run is spilled at so many postings or bytes of postings.
RUN_POSTINGS, RUN_BYTES = 500_000, 1 << 27
#: Postings of a chunk, and those merged at once; bytes of texts that are looked at together; sources of a tile; terms that are compared at once.
CHUNK, WINDOW, SLICE, TILE, TERMS = 4096, 1 << 17, 1 << 22, 256, 1024


def slices(text: bytes, size: int) -> Iterator[bytes]:
    """``text`` in parts of about ``size`` bytes that end where terms end."""
    at = 0
    while len(text) - at > size:
        gap = GAP.search(text, at + size)
        if gap is None:
            break
        yield text[at : gap.start()]
        at = gap.start()
    yield text[at:] if at else text


RUN = "shard int, lang string, first string, terms array<string>, sources array<string>, counts array<long>, docs array<long>"
POSTINGS = pa.schema([("group", pa.int64()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def postings_of(texts: pa.Array, group: np.ndarray) -> pa.Table:
    """Counts and documents of every term in each group, from a binary column of texts."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    if ends[-1] == ends[0]:
        return POSTINGS.empty_table()
    letters = FOLD[np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]]
    folded = pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer(ends - ends[0]), pa.py_buffer(letters)])
    lists = pc.split_pattern(folded, " ")
    words = lists.flatten().dictionary_encode()
    terms, code = words.dictionary, words.indices.to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    some = code != pc.index(terms, "").as_py()
    each, counts = np.unique(row[some] * len(terms) + code[some], return_counts=True)  # a term in a document
    key = group[each // len(terms)] * len(terms) + each % len(terms)
    order = np.argsort(key, kind="stable")
    key, counts = key[order], counts[order]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    n = np.add.reduceat(counts, starts) if len(key) else counts
    return pa.table([pa.array(key[starts] // len(terms)), terms.take(pa.array(key[starts] % len(terms))), pa.array(n), pa.array(np.diff(np.append(starts, len(key))))], schema=POSTINGS)


def _postings_of_one(text: bytes, group: int) -> pa.Table:
    """The same for one long text, slice by slice."""
    own = Counter()
    for part in slices(text, SLICE):
        own.update(TERM.findall(part.lower()))  # bytes know ASCII letters only
    return pa.table([pa.array([group] * len(own), pa.int64()), pa.array(list(own), pa.binary()).cast(pa.string()), pa.array(list(own.values()), pa.int64()), pa.array([1] * len(own), pa.int64())], schema=POSTINGS)


def _compact(parts: list[pa.Table]) -> pa.Table:
    out = pa.concat_tables(parts).group_by(["group", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return out.rename_columns({"n_sum": "n", "docs_sum": "docs"}).select(POSTINGS.names).cast(POSTINGS)


def _spilled(postings: pa.Table, groups: list[tuple[str, str]], shards: int) -> Iterator[pa.RecordBatch]:
    """A run: the postings by shard, language, term and source, in chunks."""
    if not postings.num_rows:
        return
    coded = postings["term"].combine_chunks().dictionary_encode()
    terms, code = coded.dictionary, coded.indices.to_numpy()
    rank = np.empty(len(terms), np.int64)
    rank[pc.sort_indices(terms).to_numpy()] = np.arange(len(terms))
    shard = np.array([zlib.crc32(t) % shards for t in terms.cast(pa.binary()).to_pylist()], np.int32)[code]
    names = {x: i for i, x in enumerate(sorted({g[0] for g in groups}))}
    group = postings["group"].to_numpy()
    lang = np.array([names[g[0]] for g in groups])[group]
    place = np.empty(len(groups), np.int64)
    place[sorted(range(len(groups)), key=groups.__getitem__)] = np.arange(len(groups))
    order = np.lexsort((place[group], rank[code], lang, shard))
    shard, lang = shard[order], lang[order]
    new = np.append(True, (shard[1:] != shard[:-1]) | (lang[1:] != lang[:-1]))
    first = np.flatnonzero(new)
    within = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    starts = np.flatnonzero(within % CHUNK == 0)
    ends = pa.array(np.append(starts, len(order)), pa.int32())
    take = pa.array(order)
    columns = [terms.take(pa.array(code[order])), pa.array([g[1] for g in groups], pa.string()).take(pa.array(group[order])), postings["n"].combine_chunks().take(take), postings["docs"].combine_chunks().take(take)]
    out = [pa.array(shard[starts]), pa.array(list(names), pa.string()).take(pa.array(lang[starts])), columns[0].take(pa.array(starts)), *(pa.ListArray.from_arrays(ends, c) for c in columns)]
    whole = pa.RecordBatch.from_arrays(out, names=[x.split()[0] for x in RUN.split(", ")])
    for at in range(0, whole.num_rows, 64):
        yield whole.slice(at, 64)


def _runs(shards: int, most: int, most_bytes: int):
    """Postings of each block of rows, spilled when they are too many or too large."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, parts, rows = {}, [], 0
        for batch in batches:
            texts = batch.column(2)
            for at, to in some_rows(texts, SLICE):
                own = np.array([groups.setdefault(g, len(groups)) for g in zip(*(batch.column(i)[at:to].to_pylist() for i in (0, 1)), strict=True)], np.int64)
                if to == at + 1 and len(text := texts[at].as_py()) > SLICE:
                    parts.append(_postings_of_one(text, int(own[0])))
                else:
                    parts.append(postings_of(texts[at:to], own))
                rows += parts[-1].num_rows
                if rows > 2 * most or sum(x.nbytes for x in parts) > most_bytes:
                    parts = [_compact(parts)]
                    rows = parts[0].num_rows
                    if rows > most or parts[0].nbytes > most_bytes // 2:
                        yield from _spilled(parts[0], list(groups), shards)
                        groups, parts, rows = {}, [], 0
        if parts:
            yield from _spilled(_compact(parts), list(groups), shards)

    return build


def heap_merged(chunks: Iterator[tuple], window: int) -> Iterator[list[tuple]]:
    """Sorted chunks (tuples of columns, terms first) come in order of their first terms. Gives parts of them so that no term is in two lists of parts.

    A heap holds what is left of the open chunks by its first term. When that is ``window`` rows or more, all below the
    next chunk's first term is taken off.
    """
    heap, held = [], 0

    def below(bound: str | None) -> list[tuple]:
        parts = []
        while heap and (bound is None or heap[0][0] < bound):
            _, serial, own = heapq.heappop(heap)
            cut = len(own[0]) if bound is None else bisect_left(range(len(own[0])), bound, key=lambda i: own[0][i].as_py())
            parts.append(tuple(c[:cut] for c in own))
            if cut < len(own[0]):
                heapq.heappush(heap, (own[0][cut].as_py(), serial, tuple(c[cut:] for c in own)))
        return parts

    for serial, own in enumerate(chunks):
        first = own[0][0].as_py()
        if held >= window and heap[0][0] < first:
            parts = below(first)
            held -= sum(len(p[0]) for p in parts)
            yield parts
        heapq.heappush(heap, (first, serial, own))
        held += len(own[0])
    if heap:
        yield below(None)


KEPT = "lang string, term string, source string, n long, total long, lead boolean"


def _frequencies(min_docs: int):
    """Runs come sorted by shard, language and first term: counts of every term in enough documents of its language, by source."""

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield (batch.column(0)[i].as_py(), batch.column(1)[i].as_py()), tuple(batch.column(k)[i].values for k in range(3, 7))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, lang), rows in groupby(rows_of(batches), key=lambda r: r[0]):
            for parts in heap_merged((r[1] for r in rows), WINDOW):
                met = pa.table([pa.chunked_array(c) for c in zip(*parts, strict=True)], names=["term", "source", "n", "docs"])
                met = met.group_by(["term", "source"]).aggregate([("n", "sum"), ("docs", "sum")])
                coded = met["term"].combine_chunks().dictionary_encode()
                code = coded.indices.to_numpy()
                total, docs = np.zeros(len(coded.dictionary), np.int64), np.zeros(len(coded.dictionary), np.int64)
                np.add.at(total, code, met["n_sum"].to_numpy())
                np.add.at(docs, code, met["docs_sum"].to_numpy())
                kept = docs[code] >= min_docs
                if kept.any():
                    lead = np.zeros(len(code), bool)
                    lead[np.unique(code, return_index=True)[1]] = True
                    met = met.filter(pa.array(kept)).combine_chunks()
                    out = [pa.array([lang] * met.num_rows, pa.string()), *(met[c].combine_chunks() for c in ("term", "source", "n_sum")), pa.array(total[code[kept]]), pa.array(lead[kept])]
                    yield pa.RecordBatch.from_arrays(out, names=[x.split()[0] for x in KEPT.split(", ")])

    return merge


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + ADDED) / (total + ADDED * terms)), exactly."""
    wide = lambda x: x.cast("decimal(20,0)")
    top, bottom = wide(count + ADDED) * F.lit(SCALE).cast("decimal(10,0)"), wide(total + terms * ADDED)
    return F.call_function("div", top, F.nullif(bottom, wide(F.lit(0)))) + 1


class _Cell:
    """Corrections of all pairs between the members of two tiles, from postings as terms go by."""

    def __init__(self) -> None:
        self.members: list[tuple] = []  # number, and share of a term without postings
        self.pending: list[tuple] = []

    def compare(self, terms: np.ndarray, members: np.ndarray, shares: np.ndarray) -> None:
        z = self.z
        dense, there = np.tile(z, (int(terms[-1]) + 1, 1)), np.zeros((int(terms[-1]) + 1, len(z)), bool)
        dense[terms, members], there[terms, members] = shares, True
        for i in np.unique(members):
            own = np.flatnonzero(there[:, i])
            step = np.abs(dense[own, i][:, None] - dense[own]) - np.abs(z[i] - z)
            self.all[i] += step.sum(0)
            self.only[i] += np.where(there[own], 0, step).sum(0)

    def open(self) -> None:
        self.no = np.array([m[0] for m in self.members])
        self.z = np.array([m[1] for m in self.members], np.int64)
        self.all, self.only = (np.zeros((len(self.z), len(self.z)), np.int64) for _ in range(2))

    def take(self, no: np.ndarray, shares: np.ndarray, terms: np.ndarray, last: bool) -> None:
        """Postings with ascending numbers of their terms; all terms but the last one are complete."""
        self.pending.append((no, shares, terms))
        if last or terms[-1] - self.pending[0][2][0] >= TERMS:
            no, shares, terms = (np.concatenate(x) for x in zip(*self.pending, strict=True))
            end = len(terms) if last else int(np.searchsorted(terms, terms[-1]))
            self.pending = [(no[end:], shares[end:], terms[end:])] if end < len(terms) else []
            at = 0
            while at < end:
                to = min(end, int(np.searchsorted(terms, terms[at] + TERMS)))
                self.compare(terms[at:to] - terms[at], np.searchsorted(self.no, no[at:to]), shares[at:to])
                at = to


def _corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, lo, hi, salt, term, no, share) come sorted; those without a term are the cell's members. Gives lang, a, b (numbers, a < b) and the correction."""
    key, cell, term, number = None, None, None, 0

    def out() -> Iterator[pa.RecordBatch]:
        if cell is not None and hasattr(cell, "z"):
            if cell.pending:
                cell.take(*(x[:0] for x in cell.pending[0]), last=True)
            lang, lo, hi, _ = key
            total = cell.all + cell.only.T
            first, second = cell.no // TILE == lo, cell.no // TILE == hi
            a, b = np.nonzero(first[:, None] & second[None, :] & (cell.no[:, None] < cell.no[None, :]) & (total != 0))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(cell.no[a], pa.int64()), pa.array(cell.no[b], pa.int64()), pa.array(total[a, b], pa.int64())], names=["lang", "a", "b", "correction"])

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        new = np.zeros(n, bool)
        new[0] = True
        for i in range(4):
            new[1:] |= pc.not_equal(batch.column(i)[1:], batch.column(i)[:-1]).to_numpy(zero_copy_only=False)
        no, share = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (5, 6))
        terms = batch.column(4)
        starts = np.flatnonzero(new)
        for s, e in zip(starts, np.append(starts[1:], n), strict=True):
            this = tuple(batch.column(i)[int(s)].as_py() for i in range(4))
            if this != key:
                yield from out()
                key, cell, term = this, _Cell(), None
            own = terms.slice(s, e - s)
            ahead = own.null_count
            cell.members += zip(no[s : s + ahead].tolist(), share[s : s + ahead].tolist(), strict=True)
            if ahead == len(own):
                continue
            if not hasattr(cell, "z"):
                cell.open()
            own = own.slice(ahead)
            changed = np.zeros(len(own), np.int64)
            changed[0] = own[0].as_py() != term
            changed[1:] = pc.not_equal(own[1:], own[:-1]).to_numpy(zero_copy_only=False)
            numbers = number + np.cumsum(changed)
            term, number = own[len(own) - 1].as_py(), int(numbers[-1])
            cell.take(no[s + ahead : e], share[s + ahead : e], numbers, last=False)
    yield from out()


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, run_postings: int = RUN_POSTINGS, run_bytes: int = RUN_BYTES) -> DataFrame:
    """lang, source, part, item, value, rank.

    Terms are runs of letters A-Z and of all characters beyond ASCII, A-Z in lower case. A language keeps the terms
    in at least ``min_docs`` of its documents; a term's share in a group (language and source) or language is ``_share`` of
    its count. Part ``pair``: the summed differences of all kept terms' shares to each other source of the
    language (0 without kept terms). Part ``term``: the ``top`` terms of a group whose share lies most above the language's.

    Every row of ``docs`` is a document, rows with one doc_id or equal texts too. Null text, lang and source count as
    empty; a group without terms has its pairs like all others; a language of one source has none. Ties rank by item
    in UTF-8 order. An empty table gives an empty result; further columns are not read. ``run_postings`` and ``run_bytes``
    say when a run is spilled, not what comes out.
    """
    spark, staged = docs.sparkSession, Staged(docs.sparkSession, "divergence")
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = docs.select(named("lang"), named("source"), text_bytes().alias("t")).mapInArrow(_runs(4 * tasks, run_postings, run_bytes), RUN)
    order = ["shard", "lang", "first"]
    kept = staged.put(runs.repartition("shard").sortWithinPartitions(*order).mapInArrow(_frequencies(min_docs), KEPT), "kept")

    groups = docs.select(named("lang"), named("source")).distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("words"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_words"), F.count_if("lead").alias("terms"))
    totals = groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["words", "lang_words", "terms"])
    by_name = Window.partitionBy("lang").orderBy("source")
    totals = totals.withColumns({"no": F.row_number().over(by_name) - 1, "sources": F.count(F.lit(1)).over(Window.partitionBy("lang")), "bare": _share(F.lit(0), F.col("words"), F.col("terms"))})
    totals = staged.put(totals, "totals")  # a row for each group: Spark broadcasts it where its size allows

    shares = kept.join(totals, ["lang", "source"])
    shares = shares.withColumns({"p": _share(F.col("n"), F.col("words"), F.col("terms")), "q": _share(F.col("total"), F.col("lang_words"), F.col("terms"))})
    ranked = lambda x, part: x.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank"))
    over = shares.filter("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))

    # cells of two tiles of sources; a posting goes to all cells of its tile, and members go ahead of them
    tile = (F.col("no") / TILE).cast("int")
    tiles = F.ceil(F.col("sources") / TILE).cast("int")
    salts = F.greatest(F.lit(1), F.floor(F.lit(tasks) / (tiles * tiles))).cast("int")
    every = lambda x, *more: x.withColumn("_other", F.explode(F.sequence(F.lit(0), tiles - 1))).select("lang", F.least(tile, "_other").alias("lo"), F.greatest(tile, "_other").alias("hi"), *more)
    postings = every(shares, F.pmod(F.xxhash64("term"), salts).cast("int").alias("salt"), "term", "no", F.col("p").alias("share"))
    members = every(totals.filter("terms > 0").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))), "salt", F.lit(None).cast("string").alias("term"), "no", F.col("bare").alias("share"))
    cell = ["lang", "lo", "hi", "salt"]
    dealt = postings.unionByName(members).repartition(*cell).sortWithinPartitions(*cell, F.col("term").asc_nulls_first(), "no")
    corrections = dealt.mapInArrow(_corrections, "lang string, a long, b long, correction long").groupBy("lang", "a", "b").agg(F.sum("correction").alias("correction"))
    x = totals.select("lang", "source", "no", "bare", "terms")
    y = totals.select("lang", F.col("source").alias("item"), F.col("no").alias("_no"), F.col("bare").alias("_bare"))
    pairs = x.join(y, "lang").filter(F.col("no") != F.col("_no"))  # as many rows as the result has
    pairs = pairs.withColumns({"a": F.least("no", "_no").cast("long"), "b": F.greatest("no", "_no").cast("long")}).join(corrections, ["lang", "a", "b"], "left")
    value = F.coalesce(F.col("terms") * F.abs(F.col("bare") - F.col("_bare")), F.lit(0)) + F.coalesce("correction", F.lit(0))
    pairs = pairs.select("lang", "source", "item", value.alias("value"))
    out = Staged(spark, "divergences").put(ranked(pairs, "pair").unionByName(ranked(over, "term").filter(F.col("rank") <= top)), "rows")
    staged.drop()
    return out


SQL = """
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT k) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
gn AS (SELECT lang, source, sum(n) AS words FROM c GROUP BY ALL),
lt AS (SELECT lang, sum(total) AS words, count(*) AS terms FROM kept GROUP BY lang),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
        (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 5) // (coalesce(gn.words, 0) + 5 * lt.terms))::BIGINT AS p,
        (1 + 1000000000::HUGEINT * (kept.total + 5) // (lt.words + 5 * lt.terms))::BIGINT AS q
      FROM g JOIN kept USING (lang) JOIN lt USING (lang) LEFT JOIN gn USING (lang, source) LEFT JOIN c USING (lang, source, term)),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
u AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs
      UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM u
QUALIFY part = 'pair' OR rank <= 50
"""
