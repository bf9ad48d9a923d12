"""Benchmark decontamination: one Aho-Corasick automaton over the normalised test items.

The automaton's letters are word numbers, so a node is a word of a window and a match ends on a word. Normalising
maps every byte to one byte, so word offsets hold in the original text as well. A text is hashed into words once;
only its runs of words that follow each other in some item, and are as long as the shortest window, can hold a
match and go through the automaton.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LETTERS, Lookup, extended, hash_words, rest, scramble, some_rows, text_bytes, with_columns

WIDTH = 10
#: Windows in one automaton (about 10 nodes each, 100 MB). A larger benchmark makes several, which see the same runs one after the other.
MAX_WINDOWS = 100_000
#: Every byte as its lower-case self if it belongs to a word (0-9, a-z, 0x80 and up), else a space.
FOLD = bytes(b or 0x20 for b in LETTERS.tolist())
ODD = np.uint64(0x9E3779B97F4A7C15)


def pair_hashes(words: np.ndarray) -> np.ndarray:
    """Of every two words that follow each other."""
    return scramble(words[:-1] * ODD + words[1:])


def block_of(items: dict[bytes, list]) -> dict:
    """Windows (their words' hashes as bytes) with their items as plain data, so that they can be broadcast."""
    windows = [np.frombuffer(w, np.uint64) for w in items]
    words = np.unique(np.concatenate(windows))
    find = Lookup(words)
    pairs = [pair_hashes(w) for w in windows]
    return {
        "words": words, "windows": [(find(w) + 1).astype(np.int32) for w in windows], "items": list(items.values()), "shortest": min(map(len, windows)),
        "pairs": np.unique(np.concatenate(pairs)), "single": np.unique(np.concatenate([w for w in windows if len(w) == 1] or [words[:0]])),
    }


class Finder:
    """Built where it is used, once for each worker and block."""

    def __init__(self, block: dict) -> None:
        self.number, self.pairs, self.single, self.shortest = Lookup(block["words"]), Lookup(block["pairs"]), Lookup(block["single"]), block["shortest"]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for window, items in zip(block["windows"], block["items"], strict=True):
            self.automaton.add_word(tuple(window.tolist()), (len(window), items))
        self.automaton.make_automaton()

    def runs(self, words: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
        """Ranges of words that can hold a match; none spans two of the texts that end at ``ends``."""
        if not len(words):
            return []
        linked = np.append(self.pairs(pair_hashes(words)) >= 0, False)
        linked[ends[ends > 0] - 1] = False
        alone = self.single(words) >= 0
        starts = np.flatnonzero(np.append(True, ~linked[:-1]))
        stops = np.flatnonzero(~linked) + 1
        long = stops - starts >= max(self.shortest, 2)
        alone &= np.repeat(~long, stops - starts)
        return sorted(zip(starts[long].tolist(), stops[long].tolist(), strict=True)) + [(i, i + 1) for i in np.flatnonzero(alone).tolist()]

    def find(self, words: np.ndarray) -> tuple[list[tuple[int, int]], set]:
        """Spans of hit words (end exclusive) and the items found."""
        spans, items = [], set()
        for end, (n, own) in self.automaton.iter(tuple((self.number(words) + 1).tolist())):
            items.update(own)
            spans.append((end - n + 1, end + 1))
        return spans, items


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h, sizes, _ = hash_words(batch.column(1), LETTERS)
        parts = [x.tobytes() for x in np.split(h, np.cumsum(sizes)[:-1])] if batch.num_rows else []
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, pa.binary())], names=["item", "words"])


def windows(benchmark: DataFrame, width: int, most: int) -> Iterator[dict]:
    """The items' hashed words come to the driver one partition at a time and leave it in blocks of ``most`` different windows."""
    items: dict[bytes, list] = {}
    hashed = benchmark.select(F.col("item_id").cast("string").alias("i"), text_bytes().alias("t")).mapInArrow(_item_words, "item string, words binary")
    for row in hashed.toLocalIterator():
        own = bytes(row["words"])
        for k in range(max(1, len(own) // 8 - width + 1) if own else 0):
            of = items.setdefault(own[8 * k : 8 * (k + width)], [])
            if row["item"] not in of:
                of.append(row["item"])
            if len(items) >= most:
                yield block_of(items)
                items = {}
    if items:
        yield block_of(items)


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _offsets(text: bytes, spans: list[tuple[int, int]]) -> list[dict]:
    """Word spans as code-point spans of the original text."""
    flat, at, places = text.translate(FOLD), 0, []
    for w in flat.split():
        at = flat.index(w, at)
        places.append((at, at + len(w)))
        at += len(w)
    return [{"start": len(text[: places[a][0]].decode("utf-8", "replace")), "end": len(text[: places[b - 1][1]].decode("utf-8", "replace"))} for a, b in spans]


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
ARROW_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _scan(blocks: list, gone: set[str]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders = [Finder(b.value) for b in blocks]
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("_bytes"))
            n_words, n_hit, found, places = [], [], [], []
            for at, to in some_rows(texts, 1 << 20):
                h, sizes, _ = hash_words(texts.slice(at, to - at), LETTERS)
                ends = np.cumsum(sizes)
                hits: dict[int, tuple[list, set]] = {}
                for finder in finders:
                    for a, b in finder.runs(h, ends):
                        spans, items = finder.find(h[a:b])
                        if spans:
                            row = int(np.searchsorted(ends, a, "right"))
                            own = hits.setdefault(row, ([], set()))
                            first = a - int(ends[row] - sizes[row])
                            own[0].extend((first + x, first + y) for x, y in spans)
                            own[1].update(items)
                n_words.append(sizes)
                for row in range(to - at):
                    spans, items = hits.get(row, ((), ()))
                    spans = _joined(spans)
                    n_hit.append(sum(b - a for a, b in spans))
                    found.append(sorted(items, key=lambda i: (i is None, i)))
                    places.append(_offsets(texts[at + row].as_py(), spans) if spans else [])
            yield with_columns(
                batch, gone, n_words=pa.array(np.concatenate(n_words) if n_words else np.zeros(0, np.int64)), n_hit=pa.array(n_hit, pa.int64()), items=pa.array(found, pa.list_(pa.string())),
                spans=pa.array(places, ARROW_SPAN), contaminated=pa.array([x > 0 for x in n_hit], pa.bool_()),
            )

    return scan


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, most: int = MAX_WINDOWS) -> DataFrame:
    """All columns of ``docs`` with n_words, n_hit, items (sorted ids), spans (code points of the original) and contaminated.

    Null and empty texts have no words; an item of fewer than ``width`` words is one window, one without words
    none; repeated items each count, those without an id as one, listed last as null; an empty benchmark hits
    nothing; columns named like an output are replaced.
    """
    outputs = ("n_words", "n_hit", "items", "spans", "contaminated")
    columns = rest(docs, *outputs)
    blocks = [docs.sparkSession.sparkContext.broadcast(b) for b in windows(benchmark, width, most)]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("own"), text_bytes().alias("_bytes"))
    kinds = {"n_words": T.LongType(), "n_hit": T.LongType(), "items": T.ArrayType(T.StringType()), "spans": SPAN, "contaminated": T.BooleanType()}
    out = rows.mapInArrow(_scan(blocks, {"_bytes"}), extended(rows.schema, {"_bytes"}, **kinds))
    return out.select(*[F.col(f"own.`{c}`") for c in columns], *outputs)


SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM benchmark),
iw AS (SELECT item_id, least(10, len(w)) AS n, unnest(list_transform(range(1, greatest(1, len(w) - 9) + 1), lambda k: array_to_string(w[k:k+9], ' '))) AS win FROM i WHERE len(w) > 0),
ns AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, ns.n, unnest(range(1, len(w) - ns.n + 2)) AS k, unnest(list_transform(range(1, len(w) - ns.n + 2), lambda k: array_to_string(w[k:k+ns.n-1], ' '))) AS win FROM d, ns WHERE len(w) >= ns.n),
h AS (SELECT dw.doc_id, dw.k, dw.n, iw.item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win),
hw AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS x FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
