"""Token ids of a corpus in a binary file format: blocks of a range coder (see ``rans``) in ascending order of ids.

A folder has three Parquet tables. ``model``: every id's frequency, shared by all blocks. ``blocks``: the coded ids;
no block depends on another. A block names the documents whose ids it holds, how many of each, how many ids of its
first document stand in earlier blocks and of its last in later ones. ``parts``: where each run of blocks starts
among all ids.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import rans
from .common import Staged, some_rows, text_bytes

#: Ids of a block and, about, of a run of blocks (one task's share of the ordered ids).
BLOCK, PART = 4 * rans.SEGMENT, 1 << 23
#: Words that a worker remembers the ids of, the longest, and bytes of texts that are coded together.
HELD_WORDS, LONGEST_WORD, TOGETHER = 320_000, 40, 12 << 20
#: Characters that the library gets at a time.
AT_ONCE = 1 << 12
#: Pieces of text that are a run of letters (of any script's that are letters for sure) and a rest, from another ASCII character on.
HALVES = "(?s)\\A(?P<head>[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+)(?P<rest>[!-@\\[-`{-~\n].*)\\z"
#: White space and what might be taken for it; a blank next to one of these is no place to cut.
SPACES = frozenset(map(chr, (*range(0x21), *range(0x7F, 0xA1), 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)))


class Encoder:
    """Ids of texts by a file of the ``tokenizers`` library, as little-endian unsigned numbers of ``width`` bytes.

    A byte-level file without a normalizer parts words before a blank that stands between two other characters than
    white space, and after a run of letters before ASCII's other characters. So what lies between two such places is encoded
    by itself, and remembered. With any other file texts are encoded whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import json

        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        about, words = json.loads(self.library.to_str()), self.library.get_vocab()
        split = about["pre_tokenizer"] or {}
        self.parts = about["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        self.type = "<u2" if max(words.values()) < 1 << 16 else "<u4"
        self.width = int(self.type[2])
        self.blank = np.zeros(max(words.values()) + 1, bool)
        self.blank[[i for w, i in words.items() if w[0] == "\u0120"]] = True  # a blank's letter in such files
        #: Ids of words that follow a blank, and of those that don't under a blank and the word.
        self.held: dict[str, bytes] = {}
        self.lead = len(self.whole([" a"])[0])

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One for each worker: kept with the library's module, as functions and classes of this package travel by value."""
        import tokenizers

        known = vars(tokenizers).setdefault("_encoders", {})
        if path not in known:
            known[path] = cls(path)
        return known[path]

    def _coded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.type) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def whole(self, texts: list[str]) -> list[bytes]:
        """Every text by the library."""
        return [ids.tobytes() for some in grouped(texts) for ids in self._coded(some)]

    def _after_blanks(self, parts: list[str]) -> list[bytes]:
        """Every part as it is coded after a blank, many at a time: a part begins where a token begins with a blank."""
        out = []
        for some in grouped(parts):
            ids = self._coded([" " + " ".join(some)])[0]
            data, starts = ids.tobytes(), (np.flatnonzero(self.blank[ids]) * self.width).tolist()
            out += [data[a:b] for a, b in zip(starts, [*starts[1:], len(data)], strict=True)]
        return out

    def _after_letters(self, parts: list[str]) -> list[bytes]:
        """Every part as it is coded after a letter, or by itself: it begins with another ASCII character than letters and blanks."""
        return [x[self.lead :] for x in self._after_blanks([f"a{p}" for p in parts])]

    def _ids(self, words: pa.Array, blank: bool, learn) -> list[bytes]:
        """Ids of different ``words``, by ``learn`` if nothing remembers them."""
        keys = listed(words)
        names = keys if blank else [f" {k}" for k in keys]
        out = list(map(self.held.get, names))
        fresh = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(fresh, learn([keys[i] for i in fresh]), strict=True):
            out[i] = x
            if len(keys[i]) <= LONGEST_WORD:
                self.held[names[i]] = x
        if len(self.held) > HELD_WORDS:  # what came first is what is frequent
            self.held = dict(islice(self.held.items(), HELD_WORDS // 2))
        return out

    def _known(self, pieces: pa.Array, blank: bool) -> list[bytes]:
        """Ids of all ``pieces`` (after a ``blank`` or not), from those of their letters and of what follows."""
        halves = pc.extract_regex(pieces, HALVES)
        heads = pc.coalesce(pc.struct_field(halves, "head"), pieces).dictionary_encode()
        rests = pc.struct_field(halves, "rest").dictionary_encode()
        first = self._ids(heads.dictionary, blank, self._after_blanks if blank else self.whole)
        then = self._ids(rests.dictionary, False, self._after_letters)
        out = list(map(first.__getitem__, heads.indices.to_numpy().tolist()))
        both = np.flatnonzero(rests.indices.is_valid().to_numpy(zero_copy_only=False))
        for i, k in zip(both.tolist(), rests.indices.drop_null().to_numpy().tolist(), strict=True):
            out[i] += then[k]
        return out

    def __call__(self, texts: pa.Array, end: bytes = b"") -> tuple[pa.Array, np.ndarray]:
        """Ids of every text, and ``end`` after each, as bytes; and the number of ids."""
        if not self.parts:
            out = [x + end for x in self.whole(texts.to_pylist())]
            return pa.array(out, pa.binary()), np.array([len(x) // self.width for x in out], np.int64)
        lists = pc.split_pattern(texts, " ")
        at = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        pieces, of = listed(coded.dictionary), coded.indices.to_numpy().copy()
        easy = np.array(list(map(plain, pieces)), bool)
        ids = self._known(pc.if_else(pa.array(easy), coded.dictionary, "a"), True)
        first = [pieces[k] for k in of[at[:-1]].tolist()]
        odd = np.add.reduceat(~easy[of], at[:-1]) > 0  # texts with a piece that can't be cut from its neighbours
        ahead = self._known(pa.array(["a" if o else p for p, o in zip(first, odd.tolist(), strict=True)], pa.string()), False)
        for i in np.flatnonzero(odd).tolist():
            own = of[at[i] : at[i + 1]]
            ahead[i] = b"".join(self._joined([pieces[k] for k in own], [ids[k] for k in own])) if len(own) > 1 or first[i] else b""
        nothing = len(pieces) + len(first)
        of[np.repeat(odd, np.diff(at))] = nothing
        of[at[:-1]] = len(pieces) + np.arange(len(first))
        of = np.insert(of, at[1:], nothing + 1)
        every = pa.array([*ids, *ahead, b"", end], pa.binary()).take(pa.array(of))
        ends = np.frombuffer(every.buffers()[1], np.int32)[at + np.arange(len(at))]
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(ends), every.buffers()[2]]), np.diff(ends).astype(np.int64) // self.width

    def _joined(self, pieces: list[str], found: list[bytes]) -> Iterator[bytes]:
        """Ids of a text's pieces, those ``found`` for what follows a blank alone; pieces that can't be cut from their neighbours are coded with these."""
        easy = list(map(plain, pieces))
        at = 0
        while at < len(pieces):
            to = at + 1
            while to < len(pieces) and not (easy[to - 1] and easy[to]):
                to += 1
            if at and to == at + 1 and easy[at]:
                yield found[at]
            else:
                yield self._coded([(" " if at else "") + " ".join(pieces[at:to])])[0].tobytes()
            at = to


def listed(words: pa.Array) -> list[str]:
    """A list of ``words``, none of which has a blank; many times faster than ``to_pylist``."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py().split(" ") if len(words) else []


def grouped(texts: list[str]) -> Iterator[list[str]]:
    """Runs of ``texts`` of about AT_ONCE characters each, one text at least: the library holds much more for each token than its id."""
    run = (np.cumsum(np.array(list(map(len, texts)), np.int64)) - 1) // AT_ONCE
    edges = [*np.flatnonzero(np.diff(run, prepend=-2)).tolist(), len(texts)]
    for a, b in zip(edges, edges[1:], strict=False):
        yield texts[a:b]


def plain(piece: str) -> bool:
    """Whether a piece between two blanks has something else than white space at both ends."""
    return bool(piece) and piece[0] not in SPACES and piece[-1] not in SPACES


CODED = "doc_id long, n_ids long, width int, ids binary, tokens array<long>, counts array<long>"


def _coded(path: str, end_id: int):
    """Every row's ids; and a last row without ids for how often the task saw each."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        end, total = np.array([end_id], encoder.type).tobytes(), np.zeros(max(len(encoder.blank), end_id + 1), np.int64)
        names, lists = [x.split()[0] for x in CODED.split(", ")], pa.list_(pa.int64())
        for batch in batches:
            for at, to in some_rows(batch.column(1), TOGETHER):
                ids, n = encoder(batch.column(1)[at:to].cast(pa.string()), end)
                total += np.bincount(np.frombuffer(ids.buffers()[2], encoder.type, int(n.sum())), minlength=len(total))
                yield pa.RecordBatch.from_arrays([batch.column(0)[at:to], pa.array(n), pa.array([encoder.width] * len(n), pa.int32()), ids, pa.nulls(len(n), lists), pa.nulls(len(n), lists)], names=names)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([0], pa.int64()), pa.array([encoder.width], pa.int32()), pa.nulls(1, pa.binary()), pa.array([some], lists), pa.array([total[some]], lists)], names=names)

    return code


BLOCKS = "part int, block int, first long, n_ids int, before long, after long, doc_ids array<long>, sizes array<int>, payload binary"


def _blocks(shares, size: int):
    """The ids of one task's documents, in order, as blocks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part = rans.Table(shares.value), TaskContext.get().partitionId()
        block, first, before = 0, 0, 0
        parts, docs, sizes, held = [], [], [], 0

        def out(after: int) -> pa.RecordBatch:
            ids = np.concatenate(parts)
            row = [part, block, first, len(ids), before, after, docs, sizes, rans.encode(ids, table)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=[x.split()[0] for x in BLOCKS.split(", ")])

        for batch in batches:
            for doc, width, ids in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                ids, at = np.frombuffer(ids, f"<u{width}").astype(np.uint32), 0
                while at < len(ids):
                    parts.append(ids[at : at + size - held])
                    docs.append(doc)
                    sizes.append(len(parts[-1]))
                    held, at = held + sizes[-1], at + sizes[-1]
                    if held == size:
                        yield out(len(ids) - at)
                        block, first, before = block + 1, first + held, at if at < len(ids) else 0
                        parts, docs, sizes, held = [], [], [], 0
        if held:
            yield out(0)

    return cut


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, block: int = BLOCK, part: int = PART) -> None:
    """Encode every row of ``docs`` (doc_id, text) by the ``tokenizer`` file into folder ``path``, in ascending order of doc_id.

    Null text is empty; ``end_id`` follows every document, so none is without ids. Rows of one doc_id stand side by
    side, ordered by their ids' checksum and number; rows without a doc_id come first. Special tokens' strings in a
    text are ordinary text. An empty table gives an archive without blocks; further columns are not read. A document
    may span many blocks; ``block`` and ``part`` are numbers of ids.
    """
    spark, staged = docs.sparkSession, Staged(docs.sparkSession, "tokens")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("t")).mapInArrow(_coded(tokenizer, end_id), CODED)
    rows = staged.put(rows.withColumns({"_crc": F.crc32("ids"), "_seq": F.monotonically_increasing_id()}), "ids")
    counts = rows.filter("ids is null").select(F.inline(F.arrays_zip(F.col("tokens").alias("id"), F.col("counts").alias("n")))).groupBy("id").agg(F.sum("n").alias("n"))
    rows = rows.filter("ids is not null").drop("tokens", "counts")
    counts = {r["id"]: r["n"] for r in counts.collect()}  # as many rows as the tokenizer has ids, at most
    shares, total = rans.frequencies(counts), sum(counts.values())
    spark.createDataFrame(sorted(shares.items()), "id long, frequency long").coalesce(1).write.parquet(f"{path}/model")
    order = [F.col("doc_id").asc_nulls_first(), "_crc", "n_ids", "_seq"]  # _seq parts rows that are equal otherwise
    dealt = rows.repartitionByRange(max(1, -(-total // part)), *order).sortWithinPartitions(*order).select("doc_id", "width", "ids")
    dealt.mapInArrow(_blocks(spark.sparkContext.broadcast(shares), block), BLOCKS).write.parquet(f"{path}/blocks")
    sizes = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    so_far = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each run of blocks
    sizes.select("part", F.coalesce(F.sum("n_ids").over(so_far), F.lit(0)).alias("start"), "n_ids").write.parquet(f"{path}/parts")
    staged.drop()


def _shares(spark: SparkSession, path: str):
    return spark.sparkContext.broadcast({r["id"]: r["frequency"] for r in spark.read.schema("id long, frequency long").parquet(f"{path}/model").collect()})


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """All blocks with ``start``, the place of their first id among all."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    parts = spark.read.schema("part int, start long, n_ids long").parquet(f"{path}/parts").select(F.col("part").alias("_part"), F.col("start").alias("_start"))
    return blocks.join(parts, F.col("part") == F.col("_part")).withColumn("start", F.col("first") + F.col("_start"))


def _pieces(shares, ids: bool):
    """What a block has of each document: doc_id, the document's start, ids that stand before the piece, its size, ids that follow, its part of the document's checksum and (if asked for) the ids."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rans.Table(shares.value)
        for batch in batches:
            for start, before, after, docs, sizes, payload in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                own, n = rans.decode(payload, table), np.array(sizes, np.int64)
                ends = np.cumsum(n)
                if ends[-1] != len(own):
                    raise ValueError("a block's documents don't add up to its ids")
                ahead, behind = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
                ahead[0], behind[-1] = before, after
                each = [own[b - k : b] for b, k in zip(ends.tolist(), n.tolist(), strict=True)]
                cols = [pa.array(docs, pa.int64()), pa.array(start + ends - n - ahead), pa.array(ahead), pa.array(n), pa.array(behind), pa.array([rans.crc_before(zlib.crc32(x), 4 * k) for x, k in zip(each, behind.tolist(), strict=True)], pa.int64())]
                names = ["doc_id", "start", "ahead", "n", "behind", "crc"]
                if ids:
                    cols.append(pa.array([x.astype(np.int32) for x in each], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=[*names, *["ids"] * ids])

    return read


def read_pieces(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """A row for every piece of a document within a block: doc_id, start (of the document), ahead, n, behind, crc, ids."""
    placed = _placed(spark, path).select("start", "before", "after", "doc_ids", "sizes", "payload")
    return placed.mapInArrow(_pieces(_shares(spark, path), ids), "doc_id long, start long, ahead long, n long, behind long, crc long" + ", ids array<int>" * ids)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from decoded blocks; checksums of documents in several blocks are put together from their parts'."""
    pieces = read_pieces(spark, path, ids=False)
    return pieces.groupBy("doc_id", "start").agg(F.sum("n").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32"))


def read_range(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """Ids number ``start`` to ``stop`` of the corpus: at (place of the first) and ids, a row for each block that has some; only their segments are decoded."""
    shares = _shares(spark, path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rans.Table(shares.value)
        for batch in batches:
            at, payload = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ids = [rans.decode(p, table, max(0, start - a), stop - a) for a, p in zip(at, payload, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([max(a, start) for a in at], pa.int64()), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))], names=["at", "ids"])

    some = _placed(spark, path).filter((F.col("start") < stop) & (F.col("start") + F.col("n_ids") > start))
    return some.select("start", "payload").mapInArrow(read, "at long, ids array<int>")
