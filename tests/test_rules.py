"""Packages written here are read by the package source and judged by all rules."""

import io
import zipfile
from datetime import datetime

import pytest

from quillspark.rules import engine
from quillspark.rules.model import Config
from quillspark.sources import packages

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
PROSE = "This procedure tells each person on the team how to keep the records of a test. " * 5
NOW = Config(now=datetime(2026, 12, 1))


def p(text, style=None, size=None, bold=False, more=""):
    mark = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    look = (f'<w:sz w:val="{size}"/>' if size else "") + ("<w:b/>" if bold else "")
    return f'<w:p>{mark}<w:r><w:rPr>{look}</w:rPr><w:t xml:space="preserve">{text}</w:t></w:r>{more}</w:p>'


def tbl(*rows):
    return "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{x if x.startswith('<') else p(x)}</w:tc>" for x in row) + "</w:tr>" for row in rows) + "</w:tbl>"


PAGE = '<w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText> PAGE </w:instrText></w:r><w:r><w:fldChar w:fldCharType="separate"/></w:r><w:r><w:t>1</w:t></w:r><w:r><w:fldChar w:fldCharType="end"/></w:r>'
STYLES = f'<w:styles {NS}><w:docDefaults><w:rPrDefault><w:rPr><w:rFonts w:ascii="Serif"/><w:sz w:val="22"/></w:rPr></w:rPrDefault></w:docDefaults><w:style w:type="paragraph" w:default="1" w:styleId="N"><w:name w:val="Normal"/></w:style><w:style w:type="paragraph" w:styleId="H1"><w:name w:val="heading 1"/><w:basedOn w:val="N"/><w:rPr><w:sz w:val="32"/></w:rPr></w:style></w:styles>'


def package(body, footer=p("QA-SOP-014 Confidential ", more=PAGE), title="Cleaning Procedure", author="Robin Field"):
    out = io.BytesIO()
    core = f'<cp:p xmlns:cp="urn:c" xmlns:dc="urn:d"><dc:title>{title}</dc:title><dc:creator>{author}</dc:creator></cp:p>'
    section = '<w:sectPr><w:footerReference w:type="default" r:id="r1"/></w:sectPr>' if footer else ""
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{body}{section}</w:body></w:document>")
        z.writestr("word/styles.xml", STYLES)
        z.writestr("docProps/core.xml", core)
        z.writestr("word/_rels/document.xml.rels", '<Relationships><Relationship Id="r1" Target="footer1.xml"/></Relationships>')
        z.writestr("word/footer1.xml", f"<w:ftr {NS}>{footer or ''}</w:ftr>")
    return out.getvalue()


HISTORY = tbl(("Version", "Date", "Author", "Description"), ("1.0", "01/02/2024", "Robin Field", "first"), ("2.1", "05/03/2025", "Robin Field", "second"))
SIGNED = p("Prepared by: Robin Field 03/04/2025") + p("Approved by: Sam Lake 04/04/2025")


def good(history=HISTORY, signed=SIGNED, extra="", heads=True):
    head = lambda t: p(t, "H1") if heads else p(t)
    return head("Cleaning Procedure") + p("Version 2.1 of this document is in force.") + signed + head("Revision History") + history + head("Purpose") + p(PROSE) + p(PROSE) + extra + head("Scope") + p(PROSE)


CASES = {
    "Cleaning Procedure v2.1.docx": (package(good()), {9}),
    "Other Thing.docx": (package(good()), {1, 9}),
    "noauthor.docx": (package(good(HISTORY.replace("Robin Field", "user"), p("Signature: Sam 03/04/2025")), author="admin"), {1, 2, 9}),
    "future.docx": (package(good(HISTORY.replace("05/03/2025", "05/03/2030"))), {1, 3, 9}),
    "order.docx": (package(good(HISTORY.replace("05/03/2025", "05/03/2020"))), {1, 3, 9}),
    "Cleaning Procedure v7.docx": (package(good()), {4, 9}),
    "empty history.docx": (package(good(tbl(("Version", "Date", "Author")))), {1, 3, 5, 9}),
    "unsigned.docx": (package(good(signed=p("Nothing here to see at all today."))), {1, 6, 7, 9}),
    "undated.docx": (package(good(signed="").replace("</w:body>", "") + p("Approved by: Sam Lake")), {1, 7, 9}),
    "odd size.docx": (package(good(extra=p(PROSE, size=40))), {1, 8, 9}),
    "no footer.docx": (package(good(), footer=None), {1, 9, 11, 13}),
    "typed page.docx": (package(good(), footer=p("Page 3")), {1, 9, 11}),
    "short.docx": (package(p("A", "H1") + p("b")), {1, 3, 4, 5, 6, 7, 8, 9, 12}),
}


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("packages")
    for name, (content, _) in CASES.items():
        (folder / name).write_bytes(content)
    (folder / "note.txt").write_text("x")
    (folder / "bad.docx").write_bytes(b"nothing")
    (folder / "torn.docx").write_bytes(b"PK\x03\x04 torn")
    return packages.scan(spark, str(folder)).cache()


@pytest.fixture(scope="module")
def parsed(files):
    return packages.parse(files).cache()


def test_rejected(files, parsed):
    got = {(r.doc_id, r.code) for r in packages.rejected(files, parsed).collect()}
    assert got == {("note.txt", 415), ("bad", 422), ("torn", 422)}


def test_all_rules(parsed):
    rows = engine.evaluate(packages.package_model(parsed), NOW).collect()
    names = {r.doc_id: r.filename for r in parsed.collect() if r.error is None}
    assert len(rows) == 13 * len(CASES)
    failed = {name: {r.rule_id for r in rows if names[r.doc_id] == name and not r.passed} for name in names.values()}
    assert failed == {name: want for name, (_, want) in CASES.items()}
    assert all(r.passed is None and r.severity == "info" for r in rows if r.rule_id == 9)
    counts = {r.doc_id: r for r in engine.summary(engine.evaluate(packages.package_model(parsed), NOW, [1, 9, 12])).collect()}
    assert (counts["short"].total, counts["short"].failed, counts["short"].not_evaluated) == (3, 2, 1)


def test_options(parsed):
    m = packages.package_model(parsed)
    one = lambda config, k: {r.doc_id: r.passed for r in engine.evaluate(m, config, [k]).collect()}
    assert one(Config(required_sections=("Purpose", "revision")), 10)["future"] is True
    assert one(Config(required_sections=("Nowhere",)), 10)["future"] is False
    assert one(Config(footer_require_all=True), 13)["typed_page"] is False
    assert Config.from_dict({"fog_max": 3, "no": 1, "required_sections": ["A"], "checker": 1}) == Config(fog_max=3, required_sections=("A",))
    with pytest.raises(KeyError):
        engine.evaluate(m, None, [99])


def test_structure(spark, tmp_path):
    nested = tbl((p("in") + tbl(("a", "b")), "x"))
    simple = '<w:p><w:r><w:t>one</w:t></w:r><w:del><w:r><w:t>gone</w:t></w:r></w:del><w:fldSimple w:instr=" NUMPAGES "><w:r><w:t>7</w:t></w:r></w:fldSimple></w:p>'
    (tmp_path / "t.docx").write_bytes(package(p("first") + nested + simple))
    row = packages.parse(packages.scan(spark, str(tmp_path))).first()
    assert [(x.block_index, x.text, x.t) for x in row.paragraphs] == [(0, "first", None), (2, "in", 0), (4, "a", 1), (5, "b", 1), (6, "x", 0), (7, "one7", None)]
    assert [(c.table_index, c.row, c.col, c.text) for c in row.cells] == [(1, 0, 0, "a"), (1, 0, 1, "b"), (0, 0, 0, "in"), (0, 0, 1, "x")]


def test_inferred_and_inherited(spark, tmp_path):
    body = p("Cleaning", size=36, bold=True) + "".join(p(PROSE) for _ in range(4)) + p("Purpose", size=28) + p(PROSE)
    (tmp_path / "plain.docx").write_bytes(package(body))
    m = packages.package_model(packages.parse(packages.scan(spark, str(tmp_path))))
    assert [(r.text, r.level) for r in m.headings().orderBy("block_index").collect()] == [("Cleaning", 1), ("Purpose", 2)]
    parts = spark.createDataFrame([("d", s, "footer", w, t is None, t or "", []) for s, w, t in [(0, "default", "A"), (0, "first", None), (1, "default", None), (1, "first", None), (2, "default", "B"), (2, "first", "C")]], "doc_id string, " + packages.PARTS)
    got = [(r.ord, r.text) for r in packages.inherit_parts(parts).orderBy("ord").collect()]
    assert got == [(0, "A"), (3, "A"), (4, "A"), (5, "A"), (6, "B"), (7, "C"), (8, "A")]
    # what a linked part shows is the previous section's, not the last default one
    parts = spark.createDataFrame([("d", s, "footer", w, t is None, t or "", []) for s, w, t in [(0, "default", "A"), (0, "first", None), (1, "default", "B"), (1, "first", None), (2, "default", None), (2, "first", None)]], "doc_id string, " + packages.PARTS)
    assert [(r.ord, r.text) for r in packages.inherit_parts(parts).filter("which = 'first'").orderBy("ord").collect()] == [(4, "A"), (7, "A")]


def test_formats_fields_styles_and_dates(spark, tmp_path):
    run = lambda text, props="": f'<w:r><w:rPr>{props}</w:rPr><w:t xml:space="preserve">{text}</w:t></w:r>'
    body = '<w:p><w:pPr><w:ind w:left="720" w:hanging="360"/></w:pPr>' + run("one ", "<w:i/>") + run("two", "<w:i/>") + run("") + run("red", '<w:color w:val="ff0000"/><w:u w:val="single"/>') + PAGE + '<w:fldSimple w:instr=" NUMPAGES \\* MERGEFORMAT">' + run("9") + "</w:fldSimple></w:p>"
    (tmp_path / "f.docx").write_bytes(package(body))
    parsed = packages.parse(packages.scan(spark, str(tmp_path))).cache()
    row = parsed.first().paragraphs[0]
    assert [(f.text, f.italic, f.color, f.underline) for f in row.formats] == [("one two", True, None, None), ("red", None, "FF0000", "single"), ("19", None, None, None)]
    assert [(f.kind, f.instruction, f.result, f.simple) for f in row.field_details] == [("PAGE", "PAGE", "1", False), ("NUMPAGES", "NUMPAGES \\* MERGEFORMAT", "9", True)]
    assert (row.left_indent, row.first_line, row.right_indent) == (36.0, -18.0, None)
    assert {(s.style_id, s.name, s.based_on, s.is_default) for s in packages.package_styles(parsed).collect()} == {("N", "Normal", None, True), ("H1", "heading 1", "N", False)}
    assert packages.core_dates(parsed).first()[:] == ("f", None, None)


def test_a_rule_that_fails_leaves_the_others_alone(parsed, monkeypatch):
    from pyspark.sql import functions as F

    from quillspark.rules import checks

    name, severity, apply, parts = checks.RULES[8]
    monkeypatch.setitem(checks.RULES, 8, (name, severity, lambda d, c: (lambda d, v: (d, v._replace(message=F.raise_error(F.lit("broken row")).cast("string"))))(*apply(d, c)), parts))
    monkeypatch.setitem(checks.RULES, 10, (name, severity, lambda d, c: 1 / 0, parts))
    rows = engine.evaluate(packages.package_model(parsed), NOW, [5, 8, 10]).collect()
    assert {(r.rule_id, r.passed is None, r.severity) for r in rows if r.rule_id != 5} == {(8, True, "info"), (10, True, "info")}
    assert any(r.passed for r in rows if r.rule_id == 5) and len(rows) == 3 * len(CASES)
    assert engine.with_status(engine.evaluate(packages.package_model(parsed), NOW, [5]), "failed").count() == sum(5 in want for _, want in CASES.values())


def test_checker_and_form(spark, parsed):
    from quillspark.rules.checker import word_checker

    check = word_checker({"teh": ["the"], "recrod": ["record", "records"]})
    rows = spark.createDataFrame([("a Teh é recrod.",), (None,)], "x string")
    from pyspark.sql import functions as F

    got = [[(i.offset, i.length, i.matched, i.replacements) for i in r[0]] for r in rows.select(check(F.col("x"))).collect()]
    assert got == [[(2, 3, "Teh", ["the"]), (8, 6, "recrod", ["record", "records"])], []]
    config = Config.from_form({"required_sections": "Purpose, Scope ,", "fog_max": " 12 ", "footer_require_all": "on", "doc_id_pattern": "", "other": "x"})
    assert (config.required_sections, config.fog_max, config.footer_require_all, config.doc_id_pattern) == (("Purpose", "Scope"), 12.0, True, Config().doc_id_pattern)
    found = {r.doc_id: r for r in engine.evaluate(packages.package_model(parsed), Config(checker=word_checker({"procedure": ["process"]})), [9]).collect()}
    assert found["future"].passed is False and found["future"].evidence[0].endswith("Possible misspelling: procedure (process)") and found["future"].severity == "warning"
