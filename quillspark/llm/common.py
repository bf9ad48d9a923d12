"""Helpers shared by the training-data operators."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.sources.staging import Staged, scratch_dir  # noqa: F401


def stage(df: DataFrame, name: str) -> DataFrame:
    """One table that stays until its reader is done with it."""
    return Staged(df.sparkSession, name).put(df, name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(col: str = "text") -> Column:
    """UTF-8 bytes of a text column; null becomes empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")


#: Keys that ``join_spread`` broadcasts at most: each has 1 / HOT_KEYS or more of all rows, so there can't be more of them.
HOT_KEYS = 1000


def join_spread(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """``rows`` with the facts of their key (inner). ``facts``: a row per key with _rows, how often ``rows`` have it.

    Rows of hot keys stay where they are, as their facts are broadcast; all others meet by key.
    """
    total = facts.agg(F.sum("_rows")).first()[0] or 0
    hot = F.col("_rows") * HOT_KEYS >= F.lit(total)
    few, many = facts.filter(hot).drop("_rows"), facts.filter(~hot).drop("_rows")
    cool = rows.join(F.broadcast(few.select(key)), key, "left_anti").join(many, key)
    return rows.join(F.broadcast(few), key).unionByName(cool)


def most_frequent(rows: DataFrame, by: str, most: int) -> list:
    """The rows with the largest counts ``by``, in no order, as many whole classes of counts (eighths of a power of two) as give ``most`` at most.

    The driver receives a count for each class, and then no other rows than these.
    """
    kind = F.floor(F.log2(by) * 8)
    sizes = {r["kind"]: r["n"] for r in rows.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n")).collect()}
    least, total = None, 0
    for k in sorted(sizes, reverse=True):
        if (total := total + sizes[k]) > most:
            break
        least = k
    return rows.filter(kind >= least).collect() if least is not None else []


def rest(df: DataFrame, *outputs: str) -> list[str]:
    """Columns of ``df`` that are kept beside ``outputs``; a clashing column gives way to the operator's own."""
    taken = {x.lower() for x in outputs}
    return [c for c in df.columns if c.lower() not in taken]


def with_columns(batch: pa.RecordBatch, drop: set[str], **new: pa.Array) -> pa.RecordBatch:
    """``batch`` without the ``drop`` columns and with ``new`` ones at the end."""
    names = [n for n in batch.schema.names if n not in drop]
    arrays = [batch.column(batch.schema.get_field_index(n)) for n in names] + list(new.values())
    return pa.RecordBatch.from_arrays(arrays, names=names + list(new))


def extended(schema: T.StructType, drop: set[str], **new: T.DataType) -> T.StructType:
    """The Spark schema that fits ``with_columns``."""
    kept = [T.StructField(f.name, f.dataType, True) for f in schema if f.name not in drop]
    return T.StructType(kept + [T.StructField(n, t, True) for n, t in new.items()])


def some_rows(column: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of a binary column that hold about ``most`` bytes each, one row at least."""
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to


def scramble(x: np.ndarray) -> np.ndarray:
    """64 well-mixed bits of each number (a fixed bijection)."""
    x = x.astype(np.uint64)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


#: A factor for every byte of a word by its value (0, which parts words, adds nothing) and for every place in a word.
BY_BYTE = np.concatenate([np.zeros(1, np.uint64), scramble(np.arange(1, 256) + (1 << 50))])
BY_PLACE = [scramble(np.arange(1 << 10) + (1 << 40)) | np.uint64(1)]


def hash_words(column: pa.Array, fold: np.ndarray, tails: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a binary column without nulls, their number in each row, and (if asked for) each word's last letters.

    ``fold`` maps every byte: 0 parts words, what else it gives is the word's letter. No word spans two rows. A
    word's hash is the sum of its letters' factors times their places' factors, mixed. The last letters are a number
    below 2**24 that words with the same last three letters share.
    """
    column = column.cast(pa.binary())
    none = np.zeros(0, np.uint64)
    if not len(column) or column.buffers()[2] is None:
        return none, np.zeros(len(column), np.int64), none
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    letters = fold[np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]]]
    if not len(letters):
        return none, np.zeros(len(column), np.int64), none
    ends = ends - ends[0]
    inside = letters != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = ends[1:-1][ends[1:-1] < len(letters)]
    first[edges] = inside[edges]  # a row's end parts words as well
    starts = np.flatnonzero(first)
    if not len(starts):
        return none, np.zeros(len(column), np.int64), none
    place = np.arange(starts[0], len(letters), dtype=np.int32)
    place -= np.repeat(starts.astype(np.int32), np.diff(np.append(starts, len(letters))))
    while len(BY_PLACE[0]) <= (longest := int(place.max())):
        BY_PLACE[0] = scramble(np.arange(2 << longest.bit_length()) + (1 << 40)) | np.uint64(1)
    sums = np.add.reduceat(BY_BYTE[letters[starts[0] :]] * BY_PLACE[0][place], starts - starts[0])
    size = np.add.reduceat(inside[starts[0] :], starts - starts[0], dtype=np.int32)
    last = np.zeros(len(starts), np.uint64)
    for back in range(3 * tails):
        there = size > back
        last = last * np.uint64(256) + np.where(there, letters[starts + np.where(there, size - 1 - back, 0)], 0).astype(np.uint64)
    return scramble(sums + size.astype(np.uint64)), np.diff(np.searchsorted(starts, ends)), last


class Lookup:
    """Places of hashes in a sorted array of different ones, -1 where there is none."""

    def __init__(self, known: np.ndarray) -> None:
        self.known = known.astype(np.uint64)
        bits = max(4, int(len(known)).bit_length() + 2)
        self.shift = np.uint64(64 - bits)
        tops = (self.known >> self.shift).astype(np.int64)
        self.start = np.searchsorted(tops, np.arange(1 << bits))
        self.deepest = int(np.bincount(tops).max()) if len(known) else 0

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, np.int64)
        if self.deepest:
            first, last = self.start[(hashes >> self.shift).astype(np.int64)], len(self.known) - 1
            for k in range(self.deepest):
                at = np.minimum(first + k, last)
                hit = self.known[at] == hashes
                out[hit] = at[hit]
        return out


def fold_table(separator) -> np.ndarray:
    """A ``fold`` for ``hash_words``: A-Z to lower case, bytes for which ``separator`` holds to 0."""
    return np.array([0 if separator(b) else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


#: Words of [^\x20\x09-\x0D]+, A-Z in lower case; byte 0 is a letter there, so it is kept as 0xFF, which UTF-8 never holds.
BLANKS = fold_table(lambda b: b == 0x20 or 0x09 <= b <= 0x0D)
BLANKS[0] = 0xFF
#: Words of [0-9a-z\x80-\xff]+, A-Z in lower case.
LETTERS = fold_table(lambda b: not (b >= 0x80 or 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A))


#: Bits of a marking bitmap for each number, and the most bits at all (128 MB); beyond, more unmarked numbers pass.
MARK_EACH, MARK_MOST, MARK_SLICES = 12, 1 << 30, 64
#: Bytes of a bitmap that come to the driver by one job.
MARK_AT_ONCE = 8 << 20


def _spots(numbers: pa.Array, bits: int) -> np.ndarray:
    return (scramble(numbers.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) & np.uint64(bits - 1)).astype(np.int64)


def _mark(bits: int):
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            spot = _spots(batch.column(0), bits)
            np.bitwise_or.at(own, spot >> 3, np.left_shift(np.uint8(1), (spot & 7).astype(np.uint8)))
        for i, x in enumerate(np.split(own, MARK_SLICES)):
            if x.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([zlib.compress(x.tobytes(), 1)], pa.binary())], names=["slice", "marks"])

    return mark


def _merge_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, total = None, None
    out = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["slice", "marks"])
    for batch in batches:
        for i, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            x = np.frombuffer(zlib.decompress(x), np.uint8)
            if i != now:
                if now is not None:
                    yield out()
                now, total = i, x.copy()
            else:
                total |= x
    if now is not None:
        yield out()


def marks(numbers: DataFrame) -> tuple[bytes, int]:
    """A bitmap of the hashes of ``numbers`` (one column of longs) and its bits, which follow their count."""
    bits = min(MARK_MOST, 1 << max(16, math.ceil(math.log2(max(1, numbers.count()) * MARK_EACH))))
    parts = numbers.mapInArrow(_mark(bits), "slice long, marks binary")
    merged = parts.repartition(MARK_SLICES // 8, "slice").sortWithinPartitions("slice").mapInArrow(_merge_marks, "slice long, marks binary").coalesce(MARK_SLICES // 8)
    out, each = bytearray(bits // 8), bits // 8 // MARK_SLICES
    for row in merged.collect() if len(out) <= MARK_AT_ONCE else merged.toLocalIterator():  # a job for all, or one for each partition
        out[row["slice"] * each : (row["slice"] + 1) * each] = row["marks"]
    return bytes(out), bits


def may_be_marked(numbers: pa.Array, bitmap: bytes, bits: int) -> pa.Array:
    own, spot = np.frombuffer(bitmap, np.uint8), _spots(numbers, bits)
    return pa.array(((own[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1).astype(bool))


def marked(rows: DataFrame, found, bits: int, want: bool = True) -> DataFrame:
    """Of ``rows`` (whose first column is a long) those whose number may be marked, or (not ``want``) surely isn't. ``found``: the broadcast bitmap."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            likely = may_be_marked(batch.column(0), found.value, bits)
            yield batch.filter(likely if want else pc.invert(likely))

    return rows.mapInArrow(keep, rows.schema)
