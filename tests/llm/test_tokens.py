"""Token ids: the coder's round trips, and archives against the tokenizer itself."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.llm import rans, tokens

FILE = public_tokenizers.path("byte_bpe_50k.json")
ROWS = [(9, "x" * 9), (3, None), (4, ""), (7, "word " * 9000), (5, "same text"), (5, "same text"), (5, "another text"), (None, "no id"), (1, " \n a  b  c <|endoftext|> café  x\r\n\ty"), (6, "# # ## 2"), (8, "中文" * 4000)]
SCHEMA = "doc_id long, text string, start string, n_tokens int, ids string"


def want(rows, end=2):
    out, start = [], 0
    coded = [(i, [*tokens.Encoder.of(FILE).library.encode(t or "", add_special_tokens=False).ids, end]) for i, t in rows]
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    for i, ids in sorted(coded, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32(np.array(r[1], "<u2").tobytes()), len(r[1]))):
        out.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    return out


def made(spark, rows):
    return spark.createDataFrame([(i, t, "s", 1, "z") for i, t in rows], SCHEMA)


@pytest.mark.parametrize(("block", "part"), [(tokens.BLOCK, tokens.PART), (1000, 20_000), (7, 50_000)])
def test_archive_equals_tokenizer(spark, tmp_path, block, part):
    tokens.write_tokens(made(spark, ROWS), f"{tmp_path}/a", FILE, 2, block, part)
    got = [tuple(r) for r in tokens.read_documents(spark, f"{tmp_path}/a").orderBy("start").collect()]
    assert got == want(ROWS)
    every = [x for r in tokens.read_pieces(spark, f"{tmp_path}/a").orderBy("start", "ahead").collect() for x in r["ids"]]
    some = [x for r in tokens.read_range(spark, f"{tmp_path}/a", 100, 30_000).orderBy("at").collect() for x in r["ids"]]
    assert some == every[100:30_000] and len(every) == sum(n for _, _, n, _ in got)


def test_no_rows_and_one_document_without_text(spark, tmp_path):
    tokens.write_tokens(made(spark, []), f"{tmp_path}/none", FILE)
    assert tokens.read_documents(spark, f"{tmp_path}/none").count() == 0
    tokens.write_tokens(made(spark, [(2, None)]), f"{tmp_path}/one", FILE)
    assert [tuple(r) for r in tokens.read_documents(spark, f"{tmp_path}/one").collect()] == want([(2, None)])


def test_many_rows_of_one_id_are_split(spark, tmp_path):
    docs = spark.range(4000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 7).cast("string")).alias("text"))
    tokens.write_tokens(docs, f"{tmp_path}/a", FILE, part=500)
    got = tokens.read_documents(spark, f"{tmp_path}/a").orderBy("start").collect()
    assert [tuple(r) for r in got] == want([tuple(r) for r in docs.collect()])
    assert spark.read.parquet(f"{tmp_path}/a/blocks").filter(F.array_contains("doc_ids", 5)).count() > 3


def test_damage_is_found(spark, tmp_path):
    table = rans.Table(rans.frequencies({1: 5, 2: 9}))
    block = rans.encode(np.array([1, 2, 2, 1] * 100, np.uint32), table)
    with pytest.raises(ValueError):
        rans.decode(block[:-1] + bytes([block[-1] ^ 1]), table)
    with pytest.raises(ValueError):
        rans.decode(block, rans.Table(rans.frequencies({1: 9, 2: 5})))


@pytest.mark.parametrize(("n", "kinds"), [(1, 1), (2047, 3), (2048, 1), (70_000, 50_000), (rans.SEGMENT * 2, 40), (rans.SEGMENT * 3 + 77, 900)])
def test_coder_round_trip(n, kinds):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(3 / (kinds + 2), n), kinds).astype(np.uint32) * 3
    counts = dict(zip(*(x.tolist() for x in np.unique(ids, return_counts=True)), strict=True))
    shares = rans.frequencies(counts)
    assert sum(shares.values()) == 1 << rans.SCALE and min(shares.values()) > 0
    table = rans.Table(shares)
    block = rans.encode(ids, table)
    assert np.array_equal(rans.decode(block, table), ids)
    for a, b in ((0, 1), (n // 3, n // 2), (n - 1, n), (n // 2, n // 2)):
        assert np.array_equal(rans.decode(block, table, a, b), ids[a:b])
    if n >= rans.SEGMENT:
        p = np.array(list(counts.values())) / n
        bits = -(p * np.log2(p)).sum() * n
        assert len(block) * 8 < bits * 1.02 + 64 * rans.LANES * (n // rans.SEGMENT + 1) + 500


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("aaZ9  \n\t.,'sé  中　#<|>​\x1c"), max_size=60))
def test_pieces_have_the_ids_of_whole_texts(text):
    encoder = tokens.Encoder.of(FILE)
    texts = [text, "", "a", text + " b"]
    assert encoder(pa.array(texts))[0].to_pylist() == encoder.whole(texts)


class Asked:
    """A tokenizer that notes the texts it is given."""

    def __init__(self, library):
        self.library, self.texts, self.noted = library, [], lambda texts: None

    def encode_batch_fast(self, texts, **how):
        self.texts += texts
        self.noted(texts)
        return self.library.encode_batch_fast(texts, **how)


@pytest.mark.parametrize("held", [tokens.HELD_WORDS, 50])
def test_library_gets_each_word_once(monkeypatch, held):
    monkeypatch.setattr(tokens, "HELD_WORDS", held)
    encoder = tokens.Encoder(FILE)
    # every word in its letters' only place of a batch, with another rest the second time
    batches = [[f"It's no{rest}\nnext wörd{chr(97 + k // 26)}{chr(97 + k % 26)}{rest} it's{rest}" for k in range(300)] for rest in (".", "\n\n7x'll", "\n\n7x'll", "'s\t!")]
    right = [encoder.whole(texts) for texts in batches]
    encoder.library = asked = Asked(encoder.library)
    for k, texts in enumerate(batches):
        asked.texts.clear()
        assert encoder(pa.array(texts))[0].to_pylist() == right[k]
        if held > 50:
            assert ("wörd" in " ".join(asked.texts)) == (k == 0)
            assert len(asked.texts) <= 10 and (k != 2 or not asked.texts)


def test_library_gets_long_pieces_a_few_at_a_time():
    encoder = tokens.Encoder(FILE)
    texts = [f"{k} a,{k}{'中' * 3000} b{k}{'é' * 3000} {'x.' * 3000}{k}" for k in range(40)] + ["", "z" * 9000, ""]
    right, sizes = encoder.whole(texts), []
    encoder.library = asked = Asked(encoder.library)
    asked.noted = lambda some: sizes.append(sum(map(len, some)))
    assert encoder(pa.array(texts))[0].to_pylist() == right
    assert max(sizes) <= 2 * tokens.AT_ONCE + 9000


def test_checksums_of_parts():
    data = random.Random(3).randbytes(5000)
    for cut in (0, 1, 17, 4999):
        assert rans.crc_before(zlib.crc32(data[:cut]), len(data) - cut) ^ zlib.crc32(data[cut:]) == zlib.crc32(data)
