"""Queries over packages: each package is made once and read once, spread over tasks, with the results of the general path."""

import io
import os
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.plans import specimens
from quillspark.plans.queries import QUERIES
from quillspark.sources import packages, store
from tests.test_rules import CASES, NS, p, package, tbl

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_paragraphs_make_and_read_each_package_once(spark):
    df = QUERIES["package_paragraphs"](spark, SF)
    shown = plan(df)
    assert (shown.count("MapInArrow"), shown.count("Join"), shown.count("Window ")) == (2, 0, 1)
    # of the files of one doc_id every task sends one
    assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString()


def test_packages_are_made_by_many_tasks(spark, monkeypatch):
    rows = spark.read.parquet(f"{SF}/part.parquet").count()
    monkeypatch.setattr(specimens, "PACKED_BY_TASK", 10)
    assert specimens.files(spark, SF).rdd.getNumPartitions() == -(-rows // 10)


def test_rows_of_several_packages_in_a_batch():
    schema = pa.schema([("doc_id", pa.string()), ("filename", pa.string()), ("error", pa.string()), ("paragraphs", pa.list_(pa.struct([("text", pa.string())])))])
    given = pa.RecordBatch.from_pylist([{"doc_id": str(i), "filename": f"{i}.docx", "content": package(p(f"text {i}") * 5) if i % 7 else b"torn"} for i in range(1000)])
    got = list(packages._parse(schema)(iter([given])))
    assert [r["doc_id"] for b in got for r in b.to_pylist()] == [str(i) for i in range(1000)]
    assert all(r["paragraphs"] == ([{"text": f"text {r['doc_id']}"}] * 5 if int(r["doc_id"]) % 7 else []) and (r["error"] is None) == (int(r["doc_id"]) % 7 > 0) for b in got for r in b.to_pylist())
    assert 2 <= len(got) <= 20


def test_packages_of_one_task_keep_to_their_own_parts():
    style = lambda size, more="": f'<w:styles {NS}><w:style w:type="paragraph" w:default="1" w:styleId="N"><w:name w:val="Normal"/><w:rPr><w:sz w:val="{size}"/></w:rPr></w:style>{more}</w:styles>'

    def made(styles, footer, target="footer1.xml"):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("word/document.xml", f'<w:document {NS}><w:body>{p("a", bold=True)}{p("b")}<w:p><w:pPr><w:pStyle w:val="gone"/><w:jc w:val="both"/></w:pPr><w:r><w:rPr><w:rStyle w:val="C"/></w:rPr><w:t>c</w:t></w:r></w:p><w:sectPr><w:footerReference r:id="r1"/></w:sectPr></w:body></w:document>')
            z.writestr("word/styles.xml", styles)
            z.writestr("word/_rels/document.xml.rels", f'<Relationships><Relationship Id="r1" Target="{target}"/></Relationships>')
            z.writestr(f"word/{target}", f"<w:ftr {NS}>{p(footer)}</w:ftr>")
        return out.getvalue()

    char = '<w:style w:type="character" w:styleId="C"><w:rPr><w:i/><w:sz w:val="60"/></w:rPr></w:style>'
    cases = [made(style(20), "x"), made(style(40), "x"), made(style(40, char), "y"), made("<torn", "x"), made(style(20), "z", "other.xml"), made(style(20), "<torn"), made(style(20), "x")]
    seen = packages.Seen()
    got = [packages.parse_package(x, True, seen) for x in cases]
    assert got == [packages.parse_package(x) for x in cases]
    sizes = lambda r: [(f["size"], f["bold"], f["italic"]) for x in r["paragraphs"] for f in x["formats"]]
    assert sizes(got[0]) == sizes(got[6]) == [(10.0, True, None), (10.0, None, None), (None, None, None)]
    assert sizes(got[2]) == [(20.0, True, None), (20.0, None, None), (30.0, None, True)]
    assert [next((x["text"] for x in r["parts"] if not x["linked"]), None) for r in got] == ["x", "x", "y", None, "z", None, "x"]
    assert [r["error"] is None for r in got] == [True, True, True, False, True, False, True]
    for x in cases:  # without details: the same but for paragraphs
        whole, light = (packages.parse_package(x, y) for y in (True, False))
        assert {k: v for k, v in whole.items() if k != "paragraphs"} == {k: v for k, v in light.items() if k != "paragraphs"}


def test_newest_of_a_doc_id(spark, tmp_path):
    for k, (name, title) in enumerate((("b a.docx", "newest"), ("b_a.docx", "old"), ("c.docx", "one"))):
        (tmp_path / name).write_bytes(package(p("x"), title=title))
        os.utime(tmp_path / name, (1_700_000_000 - k, 1_700_000_000 - k))
    (tmp_path / "b  a.docx").write_bytes(b"no package, though it is the last")
    rows = packages.parse(packages.scan(spark, str(tmp_path)), "title string, error string").collect()
    assert {(r.doc_id, r.filename, r.title) for r in rows} == {("b_a", "b a.docx", "newest"), ("c", "c.docx", "one")}


def test_cores_make_and_read_each_package_once(spark):
    shown = plan(QUERIES["package_cores"](spark, SF))
    assert (shown.count("MapInArrow"), shown.count("Join"), shown.count("Window ")) == (2, 0, 1)


@pytest.fixture(scope="module")
def scanned(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    for name, (content, _) in CASES.items():
        (folder / name).write_bytes(content)
    blank = tbl(("", " "), ("a", " b "), ("", ""))
    (folder / "nested.docx").write_bytes(package(p("x") + tbl((p("in") + tbl(("a", "b"), ("c",)), "x"), ("y",)) + blank + tbl((" ",)) + "<w:tbl><w:tr/></w:tbl>" + tbl(("last", ""))))
    return packages.scan(spark, str(folder)).cache()


def test_tables_of_the_parser_are_those_of_extractions(scanned):
    want = store.records(store.extraction(packages.package_model(packages.parse(scanned)))).filter("kind = 'table'")
    tables = packages.parse(scanned, f"error string, {packages.TABLES}").filter("error is null").select("doc_id", F.explode("tables").alias("t")).select("doc_id", "t.*")
    got = tables.withColumn("text", store.table_text(F.col("rows"))).filter("text <> ''")
    columns = ["doc_id", "table_index", "block_index", "text"]
    assert sorted(got.select(columns).collect()) == sorted(want.select(columns).collect())
    assert {r.text for r in got.filter("doc_id = 'nested'").collect()} == {"a | b\nc", "in | x\ny", "a | b", "last | "}
