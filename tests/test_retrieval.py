"""Sinks, retrieval with a judge of its own, and the drop folder."""

import pytest
from pyspark.sql import functions as F

from quillspark.operators import chunks, retrieval
from quillspark.rules import engine
from quillspark.sources import packages, store
from quillspark.streaming.drop_folder import judge_folder
from tests.test_rules import HISTORY, good, package


@pytest.fixture(scope="module")
def extracted(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("in")
    for name in ("one", "two"):
        (folder / f"{name}.docx").write_bytes(package(good()))
    files = packages.scan(spark, str(folder)).cache()
    out = str(tmp_path_factory.mktemp("out"))
    store.write_raw(files, f"{out}/raw")
    assert {bytes(r.content) for r in spark.read.parquet(f"{out}/raw").collect()} == {(folder / "one.docx").read_bytes(), (folder / "two.docx").read_bytes()}
    rows = store.extraction(packages.package_model(packages.parse(files)))
    store.write_extractions(rows, f"{out}/json")
    store.write_extractions(rows.filter("doc_id = 'one'"), f"{out}/json")
    return store.read_extractions(spark, f"{out}/json").cache()


def test_records(extracted):
    assert extracted.count() == 2
    rows = store.records(extracted).filter("doc_id = 'two'").orderBy("ord").collect()
    assert [r.ord for r in rows] == sorted(r.ord for r in rows)
    table = next(r for r in rows if r.kind == "table")
    assert table.text.splitlines()[0] == "Version | Date | Author | Description" and table.table_index == 0
    assert [r.text for r in rows if r.level] == ["Cleaning Procedure", "Revision History", "Purpose", "Scope"]


def test_judge(extracted):
    rows = chunks.chunk_records(store.records(extracted)).withColumn("source", F.col("doc_id"))
    reply = lambda x: F.when(x.contains("Revision History"), F.lit('```json\n{"passed": true, "evidence": "seen", "locations": ["Table 1"]}\n```')).otherwise(F.lit("no"))
    got = retrieval.judge_rules(rows, reply).collect()
    assert len(got) == 26 and all(r.passed and r.locations == ["Table 1"] for r in got)


def test_replies(spark):
    cases = {'{"passed": true, "evidence": "x"}': True, '{"passed": "true", "evidence": "x"}': None, '{"passed": false, "evidence": " "}': None, '{"passed": false, "evidence": "y", "locations": [1]}': None, '{"passed": false, "evidence": "y", "locations": ["a", "b"]}': False, "": None, '{"a": {"passed": true, "evidence": "x"}}': None, '{"passed": true, "evidence": "a \\"passed\\": false"}': True, '{"passed": true, "passed": false, "evidence": "x"}': None, '[{"passed": true, "evidence": "x"}]': None,
             '{"passed": true, "evidence": "x", "locations": null}': None, '{"passed": true, "evidence": "x", "locations": []}': True, '{"passed": 1, "evidence": "x"}': None, '{"passed": true, "evidence": 5}': None, '{"passed": true, "evidence": "x", "locations": ["a", null]}': None, "{": None, '```json\n{"passed": false, "evidence": "é"}\n```': False}
    rows = spark.createDataFrame([(k,) for k in cases], "r string").select("r", retrieval.parse_reply(F.col("r")).alias("a")).collect()
    assert {r.r: r.a and r.a.passed for r in rows} == cases


def test_vectors(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0, [1.0, 0.0])], "id string, ins_ord long, embedding array<double>")
    store.write_vectors(rows, str(tmp_path / "v"), 2)
    assert store.read_vectors(spark, str(tmp_path / "v")).first().dimension == 2
    assert not store.quietly(store.write_vectors, rows, str(tmp_path / "w"), 3)


def test_drop_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.docx").write_bytes(package(good(HISTORY)))
    (tmp_path / "in/b.txt").write_text("x")
    for _ in range(2):
        judge_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out/findings"))
    assert found.count() == 13 and found.filter("rule_id = 5").first().passed
    assert [r.code for r in spark.read.parquet(str(tmp_path / "out/rejected")).collect()] == [415]
    assert engine.answers(found).filter("passed is null").count() == 0


def test_filters_modes_and_codes(spark, extracted):
    rows = chunks.chunk_records(store.records(extracted)).withColumn("source", F.col("doc_id")).withColumn("embedding", retrieval.hashed_embedding(F.col("text")))
    asked = spark.createDataFrame([(1, "purpose of the procedure"), (2, "revision history")], "rule_id int, question string").withColumn("embedding", retrieval.hashed_embedding(F.col("question")))
    got = retrieval.retrieve(rows, asked, 2, retrieval.same_source("two") & retrieval.same_section(["Purpose"])).collect()
    assert {r.doc_id for r in got} == {"two"} and {tuple(r.section_path) for r in got} == {("Purpose",)} and {r.rule_id for r in got} == {1, 2}
    every = retrieval.retrieve(rows, asked, 100).collect()
    plain = {(r.id, q.rule_id): sum(a * b for a, b in zip(r.embedding, q.embedding)) for r in rows.collect() if r.embedding for q in asked.collect()}
    assert {(r.id, r.rule_id): round(r.score, 9) for r in every} == {k: round(v, 9) for k, v in plain.items()}
    with pytest.raises(ValueError):
        retrieval.retrieve(rows, spark.createDataFrame([(1, " ")], "rule_id int, question string").withColumn("embedding", retrieval.hashed_embedding(F.col("question"))))
    bad = retrieval.judge_rules(rows.drop("embedding"), lambda x: F.lit("no idea"))
    assert {(r.passed, r.code) for r in bad.collect()} == {(None, 503)}
    assert [r[:2] for r in retrieval.unreadable(spark.createDataFrame([("one",), ("blank",)], "doc_id string"), rows).collect()] == [("blank", 422)]
    with pytest.raises(ValueError):
        retrieval.evaluate("retrieval", None)


def test_no_prompt_is_asked_twice(spark, tmp_path):
    asked = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def judge(x):
        asked.add(1)
        return f"re: {x}"

    rows = spark.createDataFrame([(i, f"p{i % 3}") for i in range(9)], "id long, prompt string")
    for more, want in ((rows.limit(0), 0), (rows, 3), (rows, 3), (rows.unionByName(spark.createDataFrame([(9, "new")], rows.schema)), 4)):
        got = retrieval.ask(more, judge, str(tmp_path / "cache"))
        assert {(r.prompt, r.reply) for r in got.collect()} == {(r.prompt, f"re: {r.prompt}") for r in more.collect()} and asked.value == want


def test_embeddings_of_batches(spark):
    import zlib

    import numpy as np

    texts = ["one two two", None, "", "...", "Three, éa ONE"] * 3
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(retrieval.hashed_embedding(F.col("t"), 7)).collect()]
    for text, vector in zip(texts, got, strict=True):
        v = np.zeros(7)
        for w in "".join(c if c.isalnum() else " " for c in (text or "").lower()).split():
            v[(zlib.crc32(w.encode()) >> 1) % 7] += 1 if zlib.crc32(w.encode()) & 1 else -1
        assert vector is None if not v.any() else np.allclose(vector, v / np.linalg.norm(v))


def test_views_order_and_dates(spark, extracted, tmp_path):
    from quillspark.operators import structure

    rows = [("d", 0, "1. Purpose", 1), ("d", 1, "why", None), ("d", 2, "Detail", 2), ("d", 3, "more", None), ("d", 4, "Scope", 1), ("d", 5, "where", None), ("e", 0, "why", None)]
    blocks = spark.createDataFrame([(*r, False) for r in rows], "doc_id string, block_index int, text string, level int, in_table boolean")
    assert [r.block_index for r in structure.section_view(blocks, "purpose").orderBy("block_index").collect()] == [0, 1, 2, 3]
    assert [r.text for r in structure.summary_view(blocks).orderBy("block_index").collect()] == ["1. Purpose", "Detail", "Scope"]
    assert [r.filename for r in store.in_name_order(extracted).orderBy("ins_ord").collect()] == ["one.docx", "two.docx"]
    store.write_extractions(extracted.drop("created").withColumn("created", F.lit("2024-01-02 03:04:05").cast("timestamp")), str(tmp_path / "x"))
    assert {r.created.year for r in store.read_extractions(spark, str(tmp_path / "x")).collect()} == {2024} and store.read_extractions(spark, str(tmp_path / "x"), "none*").count() == 0
