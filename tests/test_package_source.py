"""The package source: names, pushed filters, partitions, files that can't be read, and the stream over restarts."""

import os
import time

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.rules import engine
from quillspark.rules.model import Config
from quillspark.sources import package_source, packages
from quillspark.sources.staging import scratch_dir
from quillspark.streaming.drop_folder import current, judge_folder
from tests.test_rules import CASES, NOW, good, package


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("source")
    for name, (content, _) in list(CASES.items())[:4]:
        (path / name).write_bytes(content)
    (path / "deep").mkdir()
    (path / "deep" / "torn.docx").write_bytes(b"PK\x03\x04 torn")
    (path / "bad.docx").write_bytes(b"nothing")
    (path / "note.txt").write_text("x")
    (path / "large.docx").write_bytes(b"PK\x03\x04" + b"0" * 40_000)
    (path / "_hidden.docx").write_bytes(b"")
    return path


def test_relation_and_codes(spark, folder):
    rows = package_source.read(spark, str(folder), mostBytes=30_000)
    got = {r.filename: (r.doc_id, r.code, r.error is None, len(r.paragraphs) > 0) for r in rows.collect()}
    names = list(CASES)[:4]
    assert {n: got.pop(n)[1:] for n in names} == {n: (None, True, True) for n in names}
    assert got == {"torn.docx": ("torn", 422, False, False), "bad.docx": ("bad", 422, False, False), "note.txt": ("note.txt", 415, False, False), "large.docx": ("large", 413, False, False)}
    assert {(r.doc_id, r.code) for r in package_source.refused(rows).collect()} == {("torn", 422), ("bad", 422), ("note.txt", 415), ("large", 413)}
    assert package_source.read(spark, str(folder), recursive="false").filter("doc_id = 'torn'").count() == 0
    assert package_source.read(spark, str(folder / "none")).count() == 0
    judged = {(r.doc_id, r.rule_id): r.passed for r in engine.evaluate(packages.package_model(rows.filter("error is null")), NOW, [1, 2, 3]).collect()}
    whole = engine.evaluate(packages.package_model(packages.parse(packages.scan(spark, str(folder)))), NOW, [1, 2, 3])
    assert judged == {(r.doc_id, r.rule_id): r.passed for r in whole.filter("doc_id <> 'large'").collect()}


def test_pushed_filters_open_no_other_file(spark, folder):
    rows = package_source.read(spark, f"file://{folder}", partitionBytes=1)
    assert rows.rdd.getNumPartitions() == 8
    for kept, n in (("doc_id = 'torn'", 1), ("doc_id in ('torn', 'bad')", 2), ("path like '%.txt'", 1), ("length > 30000", 1), ("filename like 'n%' and code = 415", 1), ("doc_id is not null", 8)):
        some = rows.filter(kept)
        assert some.rdd.getNumPartitions() == n, kept
        assert some.count() == len([r for r in rows.collect() if r in some.collect()])
    assert rows.filter("code = 422").count() == 3
    assert package_source.read(spark, str(folder)).rdd.getNumPartitions() == 1


def test_stems_are_those_of_the_built_in_function(spark):
    names = ["a b.docx", "..x..docx", "é?.DOCX", "", ".docx", "x" * 150 + ".docx", "a/b\\c d.docx", "v1.2_final.docx"]
    got = spark.createDataFrame([(n,) for n in names], "x string").select(X.safe_stem(F.col("x"))).collect()
    assert [r[0] for r in got] == [package_source.stem_of(n) for n in names]


def test_newest_of_a_doc_id_before_opening(spark, tmp_path):
    for k, (name, title) in enumerate((("a b.docx", "old"), ("a_b.docx", "new"))):
        (tmp_path / name).write_bytes(package(good(), title=title))
        os.utime(tmp_path / name, (1_700_000_000 + k, 1_700_000_000 + k))
    assert [r.title for r in package_source.read(spark, str(tmp_path), newest="true").collect()] == ["new"]
    assert package_source.read(spark, str(tmp_path)).count() == 2


def test_stream_takes_each_file_once_over_restarts_and_leaves_nothing(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    before = set(os.listdir(scratch_dir(spark)))
    drops = [("one.docx", package(good())), ("two.docx", package(good(), author="admin")), ("one.docx", package(good(), title="Other")), ("torn.docx", b"PK\x03\x04 torn")]
    for k, (name, content) in enumerate(drops):
        (source / name).write_bytes(content)
        os.utime(source / name, (1_700_000_000 + k, 1_700_000_000 + k))
        judge_folder(spark, str(source), out, str(tmp_path / "state"), Config(now=NOW.now)).awaitTermination()
        if k < 3:  # nothing new: no batch
            judge_folder(spark, str(source), out, str(tmp_path / "state"), Config(now=NOW.now)).awaitTermination()
    rows = spark.read.parquet(f"{out}/findings")
    assert sorted((r["doc_id"], r["count"]) for r in rows.groupBy("doc_id").count().collect()) == [("one", 26), ("two", 13)]
    last = current(spark, out)
    assert last.count() == 26 and "title: Other" in last.filter("doc_id = 'one' and rule_id = 1").first().evidence
    assert [(r.doc_id, r.code) for r in spark.read.parquet(f"{out}/rejected").collect()] == [("torn", 422)]
    time.sleep(0.1)
    assert set(os.listdir(scratch_dir(spark))) == before
