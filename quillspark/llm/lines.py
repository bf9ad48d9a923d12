"""Line deduplication with two Bloom filters, for once-seen and twice-seen line keys.

One scan fills, per partition, a filter of the keys seen and one of the keys seen again; both are merged slice
by slice (a bit that two partitions have set counts as seen twice, so no repeated key is missed). A second scan
sends only keys of the twice-seen filter through the shuffle, where they are counted exactly by a 128-bit
digest; the lines of keys found in enough documents go from all documents but the one with the largest id.

A filter has bits for all lines. Where that is more than a worker should hold, the keys are dealt to several passes
by their hashes, each with filters of its own. The most frequent repeats are known to every worker; texts that
hold others meet them by document, and no other text is shuffled.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Staged, join_spread, marked, marks, most_frequent, rest, scramble, text_bytes

SLICES = 64
MIN_CHARS, MIN_DOCS = 20, 3
#: Bits of a filter for each line, and the most bits in one pass (2**29 bits: 64 MB).
BITS_PER_LINE, PASS_BITS = 8, 1 << 29
#: Most repeated keys that every worker holds with their keeper (24 bytes each), the most frequent ones; all others are joined.
HELD_KEYS = 50_000


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The stripped line with A-Z lower-cased, or None if it has fewer than ``min_chars`` code points."""
    key = line.strip().lower()  # bytes methods know ASCII only: \x20 and \x09-\x0D, A-Z
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return key


def _keys(text: bytes, min_chars: int) -> set[bytes]:
    return {k for line in text.split(b"\n") if (k := line_key(line, min_chars)) is not None}


def _spots(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(bits - 1)
    return (hashes & mask).astype(np.int64), ((hashes >> np.uint64(32)) & mask).astype(np.int64)


def _has(filter_: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    a, b = _spots(hashes, bits)
    return ((filter_[a >> 3] >> (a & 7).astype(np.uint8)) & (filter_[b >> 3] >> (b & 7).astype(np.uint8)) & 1).astype(bool)


def _add(filter_: np.ndarray, hashes: np.ndarray, bits: int) -> None:
    for s in _spots(hashes, bits):
        np.bitwise_or.at(filter_, s >> 3, np.left_shift(np.uint8(1), (s & 7).astype(np.uint8)))


def _hashes(texts: pa.Array, min_chars: int, turn: int, turns: int) -> np.ndarray:
    """Hashes of the keys of each text, of those whose turn it is."""
    found = np.array([xxhash.xxh3_64_intdigest(k) for t in texts.to_pylist() for k in _keys(t, min_chars)], np.uint64)
    return found if turns == 1 else found[scramble(found) % np.uint64(turns) == turn]


def _filters(bits: int, min_chars: int, turn: int, turns: int):
    """Per partition: slices of the once-seen and the twice-seen filter."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        seen = False
        for batch in batches:
            hashes = _hashes(batch.column(0), min_chars, turn, turns)
            if len(hashes):
                seen = True
                each, counts = np.unique(hashes, return_counts=True)
                _add(twice, each[(counts > 1) | _has(once, each, bits)], bits)
                _add(once, each, bits)
        if seen:
            for i, (a, b) in enumerate(zip(np.split(once, SLICES), np.split(twice, SLICES), strict=True)):
                if a.any():
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(a.tobytes(), 1)], pa.binary()), pa.array([zlib.compress(b.tobytes(), 1)], pa.binary())], names=["slice", "once", "twice"])

    return fill


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges slices that come sorted by number, one at a time: memory is that of one slice."""
    now, once, twice = None, None, None

    def out():
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([twice.tobytes()], pa.binary())], names=["slice", "twice"])

    for batch in batches:
        for i, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
            if i != now:
                if now is not None:
                    yield out()
                now, once, twice = i, a.copy(), b.copy()
            else:
                twice |= b | (once & a)
                once |= a
    if now is not None:
        yield out()


def filter_bits(lines: int, most: int) -> tuple[int, int]:
    """Bits of a filter in one pass, and passes."""
    bits = 1 << max(16, math.ceil(math.log2(max(1, lines) * BITS_PER_LINE)))
    return min(bits, most), max(1, bits // most)


def twice_seen(docs: DataFrame, min_chars: int, bits: int, turn: int = 0, turns: int = 1) -> bytes:
    """The twice-seen filter of the lines of one pass; ``bits`` / 8 bytes reach the driver."""
    parts = docs.select(text_bytes().alias("t")).mapInArrow(_filters(bits, min_chars, turn, turns), "slice int, once binary, twice binary")
    merged = parts.repartition(SLICES // 4, "slice").sortWithinPartitions("slice").mapInArrow(_merge, "slice int, twice binary")
    out = bytearray(bits // 8)
    each = bits // 8 // SLICES
    for row in merged.toLocalIterator():
        out[row["slice"] * each : (row["slice"] + 1) * each] = row["twice"]
    return bytes(out)


def _suspects(shared, bits: int, min_chars: int, turn: int, turns: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            keys, owner = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                own = _keys(t, min_chars)
                keys += own
                owner += [i] * len(own)
            if keys:
                hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
                hit = np.flatnonzero(_has(filter_, hashes, bits) & ((turns == 1) | (scramble(hashes) % np.uint64(turns) == turn)))
                ids = batch.column(0).take(pa.array(np.array(owner, np.int64)[hit]))
                yield pa.RecordBatch.from_arrays([ids, pa.array([xxhash.xxh3_128_digest(keys[j]) for j in hit], pa.binary())], names=["doc_id", "key"])

    return scan


def _drop(held, min_chars: int):
    """Texts without the lines of ``held`` keys (key: keeper) that others keep, and of the keys in ``drop``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keepers = held.value
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for doc, t, drop in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                lines, gone, kept = t.split(b"\n"), frozenset(drop or ()), []
                for x in lines:
                    if (k := line_key(x, min_chars)) is not None:
                        h = xxhash.xxh3_128_digest(k)
                        if h in gone or keepers.get(h, doc) != doc:
                            continue
                    kept.append(x)
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
                texts.append(b"\n".join(kept) if n_dropped[-1] else t)
            yield pa.RecordBatch.from_arrays([batch.column(3), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=["own", "text", "n_lines", "n_dropped"])

    return cut


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, pass_bits: int = PASS_BITS, held_keys: int = HELD_KEYS) -> DataFrame:
    """All columns of ``docs``, text without its repeated lines, n_lines and n_dropped.

    Null text counts as empty and comes back empty; rows of one doc_id are one document, a null doc_id the
    smallest; a line twice in one document counts once; an empty table gives an empty result; columns named
    like an output are replaced. No line but those of confirmed keys is touched. ``pass_bits`` and ``held_keys``
    decide how the work is done, not what comes out.
    """
    docs = docs.select(rest(docs, "n_lines", "n_dropped"))
    spark, staged = docs.sparkSession, Staged(docs.sparkSession, "lines")
    text, kind = F.coalesce(F.col("text").cast("string"), F.lit("")), docs.schema["doc_id"].dataType
    n = docs.agg(F.sum(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    bits, turns = filter_bits(n, pass_bits)
    narrow, schema = docs.select("doc_id", text_bytes().alias("t")), T.StructType([T.StructField("doc_id", kind), T.StructField("key", T.BinaryType())])
    found = []
    for turn in range(turns):
        shared = spark.sparkContext.broadcast(twice_seen(docs, min_chars, bits, turn, turns))
        found.append(staged.put(narrow.mapInArrow(_suspects(shared, bits, min_chars, turn, turns), schema).distinct(), "suspects"))
    suspects = reduce(DataFrame.union, found)
    repeats = suspects.groupBy("key").agg(F.count(F.lit(1)).alias("_rows"), F.max("doc_id").alias("keeper")).filter(F.col("_rows") >= min_docs)
    repeats = staged.put(repeats, "repeats")
    held = {bytes(r["key"]): r["keeper"] for r in most_frequent(repeats, "_rows", held_keys)}
    shared = spark.sparkContext.broadcast(held)
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("own")
    rows = docs.select(F.xxhash64(F.col("doc_id").cast("string")).alias("_h"), F.col("doc_id").alias("_id"), text_bytes().alias("_bytes"), own)
    drop = F.lit(None).cast("array<binary>").alias("_drop")
    if repeats.count() > len(held):
        known = spark.createDataFrame([(k,) for k in held], "key binary")
        others = repeats.join(F.broadcast(known), "key", "left_anti")
        drops = join_spread(suspects, others, "key").filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        drops = staged.put(drops.groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_set("key").alias("_drop")).withColumn("_hash", F.xxhash64(F.col("_doc").cast("string"))), "drops")
        bitmap, size = marks(drops.select("_hash"))
        bitmap = spark.sparkContext.broadcast(bitmap)
        # only texts that may hold such lines move
        met = marked(rows, bitmap, size).join(drops, (F.col("_h") == F.col("_hash")) & F.col("_id").eqNullSafe(F.col("_doc")), "left")
        rows = marked(rows, bitmap, size, False).select("_id", "_bytes", drop, "own").unionByName(met.select("_id", "_bytes", "_drop", "own"))
    else:
        rows = rows.select("_id", "_bytes", drop, "own")
    outputs = T.StructType.fromDDL("text string, n_lines long, n_dropped long")
    out = rows.mapInArrow(_drop(shared, min_chars), T.StructType([rows.schema["own"], *outputs]))
    return out.select(*["text" if c == "text" else F.col(f"own.`{c}`") for c in docs.columns], "n_lines", "n_dropped")


SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.pos, k.line, f.key IS NOT NULL AND k.doc_id <> f.keeper AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
