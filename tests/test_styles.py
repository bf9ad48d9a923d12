"""Inheritance along chains of styles, as the recursive query and the package reader see it."""

import random
from xml.etree import ElementTree

from quillspark.operators import styles
from quillspark.sources.packages import Styles, W
from tests.test_rules import NS


def test_nearest_ancestor_equals_the_reader(spark):
    rng, rows = random.Random(4), []
    for doc in ("a", "b"):
        names = [f"s{i}" for i in range(25)]
        rows += [(doc, n, rng.choice([None, "missing", *names]), rng.choice([None, None, 20, 24, 30])) for n in names]
    got = {(r.doc_id, r.style_id): r.sz for r in styles.inherited(spark.createDataFrame(rows, "doc_id string, style_id string, based_on string, sz int"), ["sz"]).collect()}
    for doc in ("a", "b"):
        nodes = "".join(f'<w:style w:type="paragraph" w:styleId="{s}">' + (f'<w:basedOn w:val="{up}"/>' if up else "") + (f'<w:rPr><w:sz w:val="{sz}"/></w:rPr>' if sz else "") + "</w:style>" for d, s, up, sz in rows if d == doc)
        reader = Styles(ElementTree.fromstring(f"<w:styles {NS}>{nodes}</w:styles>"), None)
        for d, s, _, _ in rows:
            if d == doc:
                found = [n.find(W + "sz") for n in reader.chain(s, "rPr") if n is not None]
                assert got[doc, s] == next((int(n.get(W + "val")) for n in found if n is not None), None)
    assert len(got) == len(rows)


def test_depth_and_empty(spark):
    long = spark.createDataFrame([("d", i, i + 1 if i < 80 else None, None if i < 80 else 5) for i in range(81)], "doc_id string, style_id int, based_on int, sz int")
    got = {r.style_id: r.sz for r in styles.inherited(long, ["sz"], 10).collect()}
    assert got == {i: 5 if i >= 70 else None for i in range(81)}
    assert styles.inherited(long.limit(0), ["sz"]).count() == 0
