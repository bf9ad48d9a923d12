import random

from pyspark.sql import functions as F

from quillspark.functions import dates, similarity
from quillspark.functions import text as X
from quillspark.operators import chunks, structure


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


def test_keys_and_noise(spark):
    assert one(spark, X.normalize_key, "  A_b-c.d/E ") == "a b c d e"
    assert one(spark, X.strip_noise, "Guide final (1)") == "Guide"
    assert one(spark, X.strip_noise, "Guide v2.1 draft") == "Guide"
    assert one(spark, X.strip_noise, "Plan (2024)") == "Plan (2024)"
    assert one(spark, X.normalize_filename, "SOP-001 Cleaning v1.2 filled.docx") == "sop 001 cleaning"
    assert one(spark, X.strip_leading_number, "3.1 Scope") == "Scope"


def test_noise_goes_however_often_it_stands(spark):
    """Every text is made of a stem and of markers that go, or that stay where they are no noise; what stays is known as it is made."""
    rng = random.Random(1)
    noise = [" v2", "-final", " (12)", "_copy", " draft 3", ".updated", " rev1.2", " Version 4.0.1", "_REVISED"]
    stems = ["Plan", "Plan 7", "Plan (2024)", "Guide to finals", "Copybook"]
    made = {stem + "".join(rng.choices(noise, k=rng.randint(0, 6))): stem for stem in stems * 60}
    got = spark.createDataFrame([(t,) for t in made], "x string").select("x", X.strip_noise(F.col("x"))).collect()
    assert {r[0]: r[1] for r in got} == made


def test_names_phrases_and_places(spark):
    names = {"SOP-001 Cleaning v1.2 filled.docx": "sop 001 cleaning", "Final.report.v2.docx": "final report", "a version 3 b.docx": "a b", "Guide_ver.4_x.pdf": "guide x", "v2.docx": "", "Site plan 2.1.docx": "site plan 2 1"}
    got = spark.createDataFrame([(t,) for t in names], "x string").select("x", X.normalize_filename(F.col("x"))).collect()
    assert {r[0]: r[1] for r in got} == names
    heads = {"3. Scope": "Scope", " 3.1) Scope x": "Scope x", "A plan": "plan", "AB plan": "AB plan", "7": "7", "": ""}
    got = spark.createDataFrame([(t,) for t in heads], "x string").select("x", X.strip_leading_number(F.col("x"))).collect()
    assert {r[0]: r[1] for r in got} == heads
    rows = spark.createDataFrame([([],), (["a"],), (["a", "b"],), (["a", "b", "c"],)], "x array<string>").select(X.phrase(F.col("x"))).collect()
    assert [r[0] for r in rows] == ["", "a", "a and b", "a, b and c"]
    row = spark.createDataFrame([("Paragraph 3", "Scope", " some\n text ", None)], "l string, s string, t string, n string")
    assert row.select(X.locator(F.col("l"), F.col("s"), F.col("t"), F.lit("odd")), X.locator(F.col("l"), F.col("n"))).first()[:] == ("Paragraph 3, under “Scope” — “some text” — odd", "Paragraph 3")


def test_versions_and_digits(spark):
    assert one(spark, X.find_versions, "Version: 1.2, rev 3 and V10.0.1") == ["1.2", "3", "10.0.1"]
    rows = spark.createDataFrame([("1.10", "1.9"), ("1.0", "1")], "a string, b string")
    assert [r[0] for r in rows.select(X.version_key(F.col("a")) > X.version_key(F.col("b"))).collect()] == [True, True]
    conflict = spark.createDataFrame([("sop-001", "SOP 1"), ("sop-002", "sop-001"), ("a", "1")], "a string, b string").select(X.digits_conflict(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in conflict] == [False, True, False]


def test_dates(spark):
    assert one(spark, X.date_strings, "on 31/01/2024, 2024-02-03 and 5 March 2023; 31/01/2024") == ["31/01/2024", "2024-02-03", "5 March 2023"]
    rows = spark.createDataFrame([("2024-01-02",), ("2023-13-01",), ("no date",), (None,)], "x string").select(dates.parse_date("x").cast("string")).collect()
    assert [r[0] and r[0][:10] for r in rows] == ["2024-02-01", "2023-01-13", None, None]


def test_stems_and_rejects(spark):
    assert one(spark, X.safe_stem, "C:\\Windows\\evil name.docx") == "evil_name"
    assert one(spark, X.safe_stem, "../..docx") == "document"
    rows = spark.createDataFrame([("a.pdf", 9, b"PK\x03\x04"), ("a.docx", 30 << 20, b"PK\x03\x04"), ("a.DOCX", 4, b"PKxx"), ("a.docx", 4, b"PK\x03\x04")], "p string, n long, c binary")
    assert [r[0] for r in rows.select(X.reject_code(F.col("p"), F.col("n"), F.col("c"))).collect()] == [415, 413, 422, None]


def test_similarity_against_plain_lcs():
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    rng = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randint(0, 20))) for _ in range(2))
        assert similarity.common_length(a, b) == lcs(a, b)
    assert similarity.similar("procedure cleaning", "cleaning procedure") == 1.0


def test_nearest_prefers_the_earlier_of_a_tie(spark):
    rows = spark.createDataFrame([(1, 0, True), (1, 1, False), (1, 2, True), (1, 9, False)], "doc_id long, block_index long, t boolean")
    got = structure.nearest_within(rows, ~F.col("t"), F.col("t"), 1).collect()
    assert {(r["block_index"], r["nearest"]) for r in got} == {(1, 0), (9, 2)}


def test_weighted_mode_counts_null_and_keeps_the_first_of_a_tie(spark):
    rows = spark.createDataFrame([(1, None, 3, 0), (1, "a", 2, 1), (2, "b", 1, 5), (2, "c", 1, 4)], "k long, v string, w long, o long")
    got = {r["k"]: r["v"] for r in structure.weighted_mode(rows, ["k"], "v", "w", "o").collect()}
    assert got == {1: None, 2: "c"}


def test_heading_inference(spark):
    body = [(1, i, f"word {i} and some more text here.", False, False, False, None) for i in range(6)]
    heads = [(1, 10, "Purpose", False, False, False, None), (1, 11, "Scope of it", False, False, False, None)]
    paragraphs = spark.createDataFrame(body + heads, "doc_id long, block_index int, text string, in_table boolean, from_textbox boolean, is_list boolean, declared int")
    runs = spark.createDataFrame([(1, i, 11.0, False, 30, 30, 0) for i in range(6)] + [(1, 10, 18.0, True, 7, 7, 0), (1, 11, 14.0, True, 11, 11, 0)], "doc_id long, block_index int, size double, bold boolean, chars int, bare int, ord int")
    got = {r["block_index"]: r["inferred"] for r in structure.infer_heading_levels(paragraphs, runs).collect()}
    assert got == {10: 1, 11: 2}


def test_heading_inference_passes_over_runs_without_size(spark):
    paragraphs = spark.createDataFrame([(1, i, f"word {i} and some more text here.", False, False, False, None) for i in range(6)] + [(1, 10, "Purpose", False, False, False, None)], "doc_id long, block_index int, text string, in_table boolean, from_textbox boolean, is_list boolean, declared int")
    runs = spark.createDataFrame([(1, i, 11.0 if i == 0 else None, False, 30, 30, 0) for i in range(6)] + [(1, 10, 18.0, False, 7, 7, 0)], "doc_id long, block_index int, size double, bold boolean, chars int, bare int, ord int")
    assert [(r["block_index"], r["inferred"]) for r in structure.infer_heading_levels(paragraphs, runs).collect()] == [(10, 1)]


def test_chunks_follow_headings(spark):
    rows = [(1, 0, "Purpose", 0, "Paragraph 0", "paragraph", 1, None), (1, 1, "alpha " * 10, 1, "", "paragraph", None, None), (1, 2, "Scope", 2, "", "paragraph", 3, None), (1, 3, "beta " * 900, 3, "", "paragraph", None, None)]
    records = spark.createDataFrame([(*r[:2], r[2].strip(), *r[3:]) for r in rows], "doc_id long, ord int, text string, block_index long, location string, kind string, level long, table_index long")
    got = sorted(chunks.chunk_records(records).collect(), key=lambda r: r["seq"])
    assert [len(r["text"].split()) for r in got] == [11, 1, 375, 375, 150]
    assert [r["section_path"] for r in got] == [["Purpose"]] + [["Purpose", "Scope"]] * 4
    assert [r["id"] for r in got] == [f"1:{i}" for i in range(5)]
