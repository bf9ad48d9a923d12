"""The thirteen rules. Each takes (documents, Config) and returns the documents, with columns of its own, and its verdict.

A document is one row of ``facts.gather``; a rule is a set of expressions over it, so all rules are judged in one pass. Built-in
expressions give null where a value can't be had, so that no row stops the others.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import readability as R
from quillspark.functions import similarity as S
from quillspark.functions import text as X

from .facts import first, section_of, under
from .model import APPROVER_HEADER, VERSION_LABEL, Config, table_name, yes

#: number: (name, severity, function, the children that it reads: p, t, f)
RULES: dict[int, tuple] = {}

# Labels and patterns of the rules.
GENERIC_HEADINGS = ("abstract", "introduction", "overview", "purpose", "scope", "background", "references", "appendix", "conclusion")
TITLE_LABEL = r"(?i)^(?:document\s+)?(?:title|name)$"
AUTHOR_LINE = r"(?i)^\s*(?:author|prepared by|owner|document owner|written by|created by)\s*[:\-]\s*(.+)$"
AUTHOR_LABEL = r"(?i)^(?:author|prepared\s+by|document\s+owner|owner|written\s+by|created\s+by)$"
APPROVER_LABEL = r"(?i)^(?:approver|approved\s+by|authori[sz]ed\s+by|prepared\s+by)$"
APPROVER_SECTION = r"(?i)^approver(?:s)?(?:\s*\(s\))?\s*$"
ROLE_LABEL = r"(?i)^(?:role|designation|position|job\s+title)$"
ROLE = r"(?i)\b(?:author|owner|manager|engineer|officer|lead|head|director|coordinator|specialist|analyst|administrator|role|designation|title)\b"
SIGNED_BY = r"(?i)^\s*(?:prepared|reviewed|approved|authori[sz]ed|checked|issued|verified|released)\s+by\s*[:\-]?"
PAGE_TEXT = r"(?i)\bpage\s+\d+\b"
BARE_NUMBER = r"(?m)^[^\S\n]*[-–]?[^\S\n]*\d{1,4}[^\S\n]*[-–]?[^\S\n]*$"
DISABLED = ("WHITESPACE_RULE", "CONSECUTIVE_SPACES", "SENTENCE_WHITESPACE", "EN_QUOTES", "UPPERCASE_SENTENCE_START")
IDENTIFIER = r"^[A-Z]{2,}(?:[-_][A-Z0-9]{1,6}){1,4}$"
IGNORED_TERMS = ("five-whys", "five whys", "5-whys", "fishbone", "ishikawa", "pareto", "kaizen", "gemba", "poka-yoke", "capa")
SPELLING_VARIANT = r"(?i)\bis (?:British|American) English\b"
ISSUES, REPLACEMENTS = 50, 5
TOLERANCES = {"size": 0.5, "line": 0.05, "before": 3.0, "after": 3.0}


ALIGNMENT = {"LEFT": "left-aligned", "RIGHT": "right-aligned", "CENTER": "centred", "JUSTIFY": "justified"}


class Verdict(NamedTuple):
    passed: Column
    message: Column
    evidence: Column | None = None
    locations: Column | None = None
    confidence: str = "heuristic"


def none() -> Column:
    return F.array().cast("array<string>")


def rule(number: int, name: str, severity: str, parts: str = "ptf"):
    """Registers a rule; further ones are added likewise."""

    def add(f):
        RULES[number] = (name, severity, f, parts)
        return f

    return add


def text_of(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def is_default(name: Column, c: Config) -> Column:
    key = X.normalize_key(name)
    return key.isin(*[" ".join(a.replace("-", " ").replace("/", " ").lower().split()) for a in c.default_authors]) | key.endswith(" user")


def labelled(pattern: str) -> Column:
    """t, row, value of rows whose first cell is a short label that matches, in order."""
    return F.flatten(F.transform("ts", lambda t: F.transform(F.filter(t["pairs"], lambda x: x["label"].rlike(pattern)), lambda x: F.struct(t["table_index"].alias("t"), x["row"].alias("row"), x["value"].alias("value")))))


def describe(p: Column, note: Column | None = None) -> Column:
    """Where a paragraph stands, what it says and what is the matter with it."""
    return F.concat_ws(" — ", p["place"], X.snippet(p["text"]), *([] if note is None else [note]))


def in_table(index: Column, block: Column) -> Column:
    """A table's name with its section."""
    return X.locator(table_name(index), section_of(F.col("heads"), block))


@rule(1, "Title / filename match", "warning", "pt")
def title(d: DataFrame, c: Config) -> tuple[DataFrame, Verdict]:
    filled = F.filter("ps", lambda p: ~p["in_table"] & p["filled"])
    d = d.withColumns({
        "r1_name": F.lit(c.filename) if c.filename else F.col("filename"), "r1_h1": first(F.filter(filled, lambda p: p["level"] == 1)), "r1_cover": first(F.filter(filled, lambda p: p["level"].isNull())),
        "r1_row": first(F.filter(labelled(TITLE_LABEL), lambda x: ~x["value"].contains("/"))),
    })
    d = d.withColumn("r1_file", X.normalize_filename(F.col("r1_name")))
    h1, cover = F.col("r1_h1"), F.col("r1_cover")
    own = F.when(~X.normalize_title(h1["text"]).isin(*GENERIC_HEADINGS), h1["text"])
    near = F.when(h1.isNull() | (cover["block_index"] < h1["block_index"]), cover["text"])
    values = {"title": F.nullif("title", F.lit("")), "heading": own, "first line": near, "title row": F.col("r1_row.value")}
    d = d.withColumns({f"r1_v{i}": v for i, v in enumerate(values.values())})
    d = d.withColumns({f"r1_k{i}": F.when(F.col(f"r1_v{i}").isNotNull(), X.normalize_title(F.col(f"r1_v{i}"))) for i in range(4)})
    d = d.withColumns({f"r1_s{i}": F.when(F.col(f"r1_k{i}").isNotNull(), F.when(X.digits_conflict(F.col(f"r1_k{i}"), F.col("r1_file")), 0.0).otherwise(S.similarity(f"r1_k{i}", "r1_file"))) for i in range(4)})
    scored = F.array(*[F.when(F.col(f"r1_s{i}").isNotNull(), F.struct(F.col(f"r1_s{i}").alias("score"), F.lit(-i).alias("o"), F.lit(n).alias("name"))) for i, n in enumerate(values)])
    exact = F.array_compact(F.array(*[F.when(F.col(f"r1_k{i}") == F.col("r1_file"), F.lit(n)) for i, n in enumerate(values)]))
    d = d.withColumns({"r1_best": F.array_max(F.array_compact(scored)), "r1_exact": exact})
    best, name = F.col("r1_best.score"), F.col("r1_best.name")
    named = yes(F.col("r1_file") != "")
    passed = named & ((F.size("r1_exact") > 0) | yes(best >= c.title_match_threshold))
    rated = F.when((F.size("r1_exact") == 0) & best.isNotNull(), text_of("best similarity: ", F.format_number(best, 2), " (", name, F.lit(f") against {c.title_match_threshold:.2f}")))
    evidence = F.array_compact(F.array(text_of("file name: ", F.col("r1_name")), *[text_of(f"{n}: ", F.col(f"r1_v{i}")) for i, n in enumerate(values)], rated))
    message = (
        F.when(~named, "There is no file name to compare with.").when(best.isNull(), "The document gives no title.").when(F.size("r1_exact") > 0, text_of("The file name is the document's ", F.array_join("r1_exact", ", "), "."))
        .otherwise(text_of("Best similarity of title and file name: ", F.format_number(best, 2), " (", name, ")"))
    )
    return d, Verdict(passed, message, evidence, F.array_compact(F.array(h1["location"], table_name(F.col("r1_row.t")))))


@rule(2, "Author name and role", "error", "pt")
def author(d: DataFrame, c: Config) -> tuple[DataFrame, Verdict]:
    row = lambda place, value, counts: F.struct(place.alias("place"), value.alias("value"), yes(counts).alias("counts"))
    core = F.array(*[row(F.lit(n), F.coalesce(v, F.lit("")), ~is_default(F.col(v), c)) for n, v in (("author property", "author"), ("last modified by", "modified_by"))])
    top = F.filter("ps", lambda p: p["flow_pos"] < 25)
    name = lambda p: F.trim(F.regexp_extract(p["text"], AUTHOR_LINE, 1))
    lines = F.transform(top, lambda p: row(p["place"], name(p), name(p) != ""))
    label = F.transform(labelled(AUTHOR_LABEL), lambda x: row(table_name(x["t"]), x["value"], ~is_default(x["value"], c)))
    good = lambda v: (X.person_name(v) != "") & ~is_default(X.person_name(v), c)
    approver = F.transform(labelled(APPROVER_LABEL), lambda x: row(table_name(x["t"]), X.person_name(x["value"]), good(x["value"])))
    after = F.array_min(F.transform(F.filter("ps", lambda p: F.trim(p["text"]).rlike(APPROVER_SECTION)), lambda p: p["block_index"]))
    d = d.withColumn("r2_after", after)
    signing = F.filter("ts", lambda t: t["joined"].rlike(APPROVER_HEADER) | yes(F.col("r2_after") < t["block_index"]))
    people = lambda t: F.flatten(F.transform(F.filter(t["rows"], lambda r: r["row"] > 0), lambda r: F.transform(F.filter(r["xs"], lambda x: F.array_contains(t["person_cols"], x["col"])), lambda x: row(table_name(t["table_index"]), X.person_name(F.trim(x["text"])), good(F.trim(x["text"])) & ~X.person_name(F.trim(x["text"])).rlike(APPROVER_LABEL)))))
    beneath = F.flatten(F.transform(signing, people))
    past = F.coalesce(F.transform(under(F.col("past"), "author_col"), lambda x: row(table_name(F.col("past.table_index")), X.person_name(x["value"]), good(x["value"]))), F.array())
    every = F.filter(F.concat(core, lines, label, approver, beneath, past), lambda x: x["value"] != "")
    role = F.exists(top, lambda p: p["text"].rlike(ROLE)) | (F.size(labelled(ROLE_LABEL)) > 0) | (F.size(labelled(APPROVER_LABEL)) > 0) | F.exists(signing, lambda t: F.size(t["person_cols"]) > 0)
    d = d.withColumns({"r2_named": every, "r2_role": role})
    d = d.withColumn("r2_ok", F.exists("r2_named", lambda x: x["counts"]))
    message = F.when(~F.col("r2_ok"), "Nobody is named as author.").when(F.col("r2_role"), "An author is named.").otherwise("An author is named, without a role.")
    seen = F.array_distinct(F.transform("r2_named", lambda x: text_of(x["place"], ": ", x["value"], F.when(x["counts"], "").otherwise(" (nobody's name)"))))
    return d, Verdict(F.col("r2_ok"), message, seen, F.array_distinct(F.transform(F.filter("r2_named", lambda x: x["counts"]), lambda x: x["place"])))


@rule(3, "Revision dates", "error", "pt")
def revision_dates(d: DataFrame, c: Config) -> tuple[DataFrame, Verdict]:
    # a revision table has a column of dates by its definition
    rows = F.filter(F.arrays_zip(under(F.col("past"), "date_col").alias("x"), F.col("past.days").alias("day")), lambda z: z["x"]["value"] != "")
    d = d.withColumn("r3_rows", rows)
    d = d.withColumn("r3_days", F.array_compact(F.transform("r3_rows", lambda z: z["day"])))
    limit = (F.lit(c.now) if c.now else F.current_timestamp()).cast("timestamp") + F.make_interval(days=F.lit(c.future_grace_days))

    def step(seen: Column, z: Column) -> Column:
        value, day = z["x"]["value"], z["day"]
        problem = F.when(day.isNull(), text_of("not a date: ", value)).when(day > limit, text_of("in the future: ", value)).when(day < seen["last"], text_of("out of order: ", value))
        return F.struct(F.coalesce(day, seen["last"]).alias("last"), (seen["bad"] + problem.isNotNull().cast("int")).alias("bad"), F.concat(seen["out"], F.array(F.coalesce(problem, value))).alias("out"))

    start = F.struct(F.lit(None).cast("timestamp").alias("last"), F.lit(0).alias("bad"), none().alias("out"))
    d = d.withColumn("r3", F.when(F.size("r3_rows") > 0, F.aggregate("r3_rows", start, step)))
    bad = F.col("r3.bad")
    message = F.when(bad.isNull(), "No revision dates are recorded.").when(bad > 0, text_of(bad.cast("string"), " revision dates have problems.")).otherwise("Revision dates are in order.")
    return d, Verdict(yes(bad == 0), message, F.col("r3.out"), F.when(bad.isNotNull(), F.array(in_table(F.col("past.table_index"), F.col("past.block_index")))), "certain")


@rule(4, "Version number present", "warning")
def version(d: DataFrame, c: Config) -> tuple[DataFrame, Verdict]:
    past = F.col("past.table_index")
    row = lambda place, v, history: F.struct(place.alias("place"), v.alias("v"), history.alias("past"))
    body = F.flatten(F.transform("ps", lambda p: F.transform(X.find_versions(p["text"]), lambda v: row(p["place"], v, yes(p["t"] == past)))))
    margin = F.flatten(F.transform("fs", lambda f: F.transform(X.find_versions(f["text"]), lambda v: row(f["location"], v, F.lit(False)))))
    rows = F.transform(labelled(VERSION_LABEL), lambda x: row(table_name(x["t"]), X.version_cell(x["value"]), yes(x["t"] == past)))
    history = F.coalesce(F.transform(under(F.col("past"), "version_col"), lambda x: row(table_name(past), X.version_cell(x["value"]), F.lit(True))), F.array())
    meta = F.transform(F.concat(X.find_versions(F.col("subject")), X.find_versions(F.col("keywords"))), lambda v: row(F.lit("properties"), v, F.lit(False)))
    d = d.withColumn("r4_all", F.filter(F.concat(body, margin, rows, history, meta), lambda x: x["v"].isNotNull()))
    d = d.withColumns({
        "r4_seen": F.concat(F.filter("r4_all", lambda x: ~x["past"]), F.filter("r4_all", lambda x: x["past"])), "r4_file": X.find_versions(F.coalesce(F.lit(c.filename), F.col("filename"))),
        "r4_stated": F.array_distinct(F.transform(F.filter("r4_all", lambda x: ~x["past"]), lambda x: x["v"])),
        "r4_last": F.array_max(F.transform(F.filter("r4_all", lambda x: x["past"]), lambda x: F.struct(X.version_key(x["v"]).alias("k"), x["v"].alias("v"))))["v"],
    })
    absent = (F.size("r4_file") > 0) & ~yes(F.arrays_overlap("r4_file", "r4_stated"))
    listed = F.transform(F.array_sort(F.transform("r4_stated", lambda v: F.struct(X.version_key(v).alias("k"), v.alias("v")))), lambda s: s["v"])
    message = F.when(absent, text_of("The document doesn't state the file name's version ", first(F.col("r4_file")))).when(F.size("r4_seen") == 0, "No version is stated.").when(F.size("r4_stated") > 0, text_of("Stated: ", F.array_join(listed, ", "))).otherwise(text_of("Only the history has a version: ", F.col("r4_last")))
    seen = F.array_distinct(F.transform("r4_seen", lambda x: text_of("Version ", x["v"], " — ", x["place"], F.when(x["past"], " (history)").otherwise(""))))
    return d, Verdict(~absent & (F.size("r4_seen") > 0), message, seen, F.array_distinct(F.transform("r4_seen", lambda x: x["place"])))


@rule(5, "Revision history section", "error", "pt")
def revision_section(d: DataFrame, c: Config) -> tuple[DataFrame, Verdict]:
    at = F.col("history.at")
    d = d.withColumn("r5_until", F.array_min(F.transform(F.filter("heads", lambda h: (h["block_index"] > at) & (h["level"] <= F.col("history.level"))), lambda h: h["block_index"])))
    beneath = F.filter("ts", lambda t: (t["block_index"] > at) & (F.col("r5_until").isNull() | (t["block_index"] < F.col("r5_until"))) & t["populated"])
    d = d.withColumns({"r5_in": F.array_min(F.transform(beneath, lambda t: t["table_index"])), "r5_other": F.when(F.col("past.populated"), F.col("past.table_index"))})
    passed = F.when(at.isNotNull(), F.col("r5_in").isNotNull()).otherwise(F.col("r5_other").isNotNull())
    message = F.when(passed, "The revision history has entries.").when(at.isNotNull(), "The revision heading has no filled table beneath it.").otherwise("There is no revision history.")
    return d, Verdict(passed, message, None, F.array_compact(F.array(table_name(F.coalesce("r5_in", "r5_other")))))


def signed(text: Column, dates: Column) -> Column:
    """A text says more than a label and its ``dates``."""
    bare = F.regexp_replace(F.regexp_replace(text, SIGNED_BY, ""), r"(?i)^\s*signature\s*[:\-]?", "")
    bare = F.aggregate(F.coalesce(dates, none()), bare, lambda s, x: F.replace(s, x, F.lit("")))
    return F.regexp_replace(bare, r"[\s:;,.\-_]+", "") != ""


def signature_rows() -> Column:
    """t, row, value of filled name cells of signature tables, in order."""
    cells = lambda t: F.arrays_zip(under(t, "name_col").alias("x"), t["name_dates"].alias("dates"))
    full = lambda t: F.filter(cells(t), lambda z: signed(z["x"]["value"], z["dates"]))
    return F.flatten(F.transform(F.filter("ts", lambda t: t["signing"]), lambda t: F.transform(full(t), lambda z: F.struct(t["table_index"].alias("t"), z["x"]["row"].alias("row"), z["x"]["value"].alias("value")))))


def row_name(t: Column, r: Column) -> Column:
    return text_of(table_name(t), ", row ", (r + 1).cast("string"))


@rule(6, "Signature blocks", "error", "pt")
def signatures(d: DataFrame, c: Config) -> tuple[DataFrame, Verdict]:
    lines = F.transform(F.filter("ps", lambda p: p["signature"] & signed(p["text"], p["dates"])), lambda p: F.struct(p["location"].alias("at"), describe(p).alias("s")))
    rows = F.transform(signature_rows(), lambda x: F.struct(row_name(x["t"], x["row"]).alias("at"), text_of(row_name(x["t"], x["row"]), ": ", x["value"]).alias("s")))
    d = d.withColumn("r6", F.concat(lines, rows))
    n = F.size("r6")
    message = F.when(n > 0, text_of("Signature blocks: ", n.cast("string"))).otherwise("There is no signature block.")
    return d, Verdict(n > 0, message, F.transform("r6", lambda x: x["s"]), F.transform("r6", lambda x: x["at"]))


@rule(7, "Signature dates", "warning", "pt")
def signature_dates(d: DataFrame, c: Config) -> tuple[DataFrame, Verdict]:
    past = F.col("past.table_index")
    d = d.withColumns({"r7_rows": F.transform(signature_rows(), lambda x: F.struct(x["t"].alias("t"), x["row"].alias("r"))), "r7_signing": F.transform(F.filter("ts", lambda t: t["signing"]), lambda t: t["table_index"])})
    d = d.withColumn("r7_days", F.flatten(F.transform("ts", lambda t: F.filter(F.transform(F.arrays_zip(t["rows"].alias("row"), t["row_dates"].alias("dates")), lambda z: F.struct(t["table_index"].alias("t"), z["row"]["row"].alias("r"), first(z["dates"]).alias("day"))), lambda x: x["day"].isNotNull()))))
    beside = lambda p: first(F.filter("r7_days", lambda x: (x["t"] == p["t"]) & (x["r"] == p["r"])))["day"]

    def near(p: Column) -> Column:
        others = F.filter(p["near"], lambda x: (x["pos"] != p["flow_pos"]) & ~yes(x["t"] == past))
        return F.array_min(F.transform(others, lambda x: F.struct(F.abs(x["pos"] - p["flow_pos"]).alias("far"), x["pos"].alias("pos"), x["day"].alias("day"))))["day"]

    block = lambda p, at, text: F.struct(p["block_index"].alias("b"), at.alias("at"), text.alias("text"), F.coalesce(first(p["dates"]), F.when(p["t"].isNotNull(), beside(p)), near(p)).alias("day"))
    lines = F.transform(F.filter("ps", lambda p: p["signature"] & ~yes(F.array_contains("r7_signing", p["t"]))), lambda p: block(p, p["location"], F.concat_ws(" — ", p["place"], X.snippet(p["text"]))))
    anchors = F.filter("ps", lambda p: yes(p["c"] == 0) & F.exists("r7_rows", lambda x: (x["t"] == p["t"]) & (x["r"] == p["r"])))
    # of a cell's paragraphs the first
    once = F.aggregate(anchors, F.array().cast(anchors_type(d)), lambda out, p: F.when(yes((F.try_element_at(out, F.lit(-1))["t"] == p["t"]) & (F.try_element_at(out, F.lit(-1))["r"] == p["r"])), out).otherwise(F.concat(out, F.array(p))))
    rows = F.transform(once, lambda p: block(p, row_name(p["t"], p["r"]), row_name(p["t"], p["r"])))
    d = d.withColumn("r7", F.array_sort(F.concat(lines, rows)))
    d = d.withColumns({"r7_n": F.size("r7"), "r7_dated": F.size(F.filter("r7", lambda x: x["day"].isNotNull()))})
    n, dated = F.col("r7_n"), F.col("r7_dated")
    message = F.when(n == 0, "There is no signature block to be dated.").otherwise(text_of(dated.cast("string"), " of ", n.cast("string"), " signature blocks have a date near them."))
    seen = F.transform("r7", lambda x: text_of(x["text"], " — ", F.coalesce(text_of("date ", x["day"]), F.lit("no date"))))
    at = F.transform(F.when(n == dated, F.col("r7")).otherwise(F.filter("r7", lambda x: x["day"].isNull())), lambda x: x["at"])
    return d, Verdict((n > 0) & (n == dated), message, seen, at)


def anchors_type(d: DataFrame):
    return d.schema["ps"].dataType


def mode(items: Column) -> Column:
    """Of structs (v, w, o) the v with the largest sum of w, of equal ones the first by o; null is a value."""
    sums = F.transform(F.array_distinct(F.transform(items, lambda x: x["v"])), lambda v: F.struct(
        F.aggregate(F.filter(items, lambda x: x["v"].eqNullSafe(v)), F.lit(0).cast("long"), lambda s, x: s + x["w"]).alias("w"), (-F.array_min(F.transform(F.filter(items, lambda x: x["v"].eqNullSafe(v)), lambda x: x["o"]))).alias("o"), v.alias("v")))
    return F.array_max(sums)["v"]


def bare_number(x: Column) -> Column:
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def points(x: Column) -> Column:
    return F.coalesce(text_of(bare_number(x), "pt"), F.lit("inherited"))


def aligned(x: Column) -> Column:
    return F.coalesce(*[F.when(x == k, F.lit(v)) for k, v in ALIGNMENT.items()], F.lower(x))


@rule(8, "Formatting consistency", "warning", "p")
def formatting(d: DataFrame, c: Config) -> tuple[DataFrame, Verdict]:
    start = first(F.col("heads"))["block_index"]
    plain = lambda p: ~p["in_table"] & ~p["from_textbox"] & p["level"].isNull() & ~p["is_list"] & ~yes(F.lower(p["style"]).contains("caption")) & (p["words"] >= 3) & (start.isNull() | (p["block_index"] >= start))
    known = lambda p, name: F.filter(F.transform(p["runs"], lambda r, k: F.struct(r[name].alias("v"), r["chars"].cast("long").alias("w"), (p["block_index"].cast("long") * 100_000 + k).alias("o"))), lambda x: x["v"].isNotNull())
    fields = lambda p: F.struct(
        p["block_index"].alias("b"), p["location"].alias("at"), describe(p).alias("s"), F.length(p["text"]).cast("long").alias("chars"), known(p, "name").alias("names"), known(p, "size").alias("sizes"),
        *[F.round(p[k], 2).alias(k) for k in ("line", "before", "after")], F.coalesce(p["align"], F.lit("LEFT")).alias("align"),
    )
    d = d.withColumn("r8_body", F.transform(F.filter("ps", plain), fields))
    of_runs = lambda k: F.flatten(F.transform("r8_body", lambda p: p[f"{k}s"]))
    of_paragraphs = lambda k: F.transform("r8_body", lambda p: F.struct(p[k].alias("v"), p["chars"].alias("w"), p["b"].cast("long").alias("o")))
    usual = {k: of_runs(k) for k in ("name", "size")} | {k: of_paragraphs(k) for k in ("line", "before", "after", "align")}
    d = d.withColumns({f"r8_i_{k}": v for k, v in usual.items()})
    d = d.withColumns({f"r8_{k}": mode(F.col(f"r8_i_{k}")) for k in usual})
    words = {"name": ("font", lambda x: x), "size": ("size", points), "line": ("line spacing", lambda x: F.coalesce(bare_number(x), F.lit("inherited"))), "before": ("space before", points), "after": ("space after", points), "align": ("alignment", aligned)}

    def odd(p: Column) -> Column:
        out = []
        for k, (word, show) in words.items():
            a, b = mode(p[f"{k}s"]) if k in ("name", "size") else p[k], F.col(f"r8_{k}")
            far = (F.abs(a - b) > TOLERANCES[k]) if k in TOLERANCES else (a != b)
            differs = ~a.eqNullSafe(b) & (a.isNull() | b.isNull() | far)
            if k in ("name", "size"):
                differs = differs & a.isNotNull() & b.isNotNull()
            if k == "line":
                differs = differs & b.isNotNull()
            out.append(F.when(differs, text_of(f"{word} ", show(a), " instead of ", show(b))))
        return F.concat_ws("; ", *out)

    d = d.withColumn("r8_odd", F.filter(F.transform("r8_body", lambda p: F.struct(p["at"].alias("at"), p["s"].alias("s"), odd(p).alias("odd"))), lambda x: x["odd"] != ""))
    n, bad = F.size("r8_body"), F.size("r8_odd")
    few = n < 3
    base = F.concat_ws(", ", F.coalesce("r8_name", F.lit("unnamed font")), points(F.col("r8_size")), text_of("line spacing ", words["line"][1](F.col("r8_line"))), text_of("space before ", points(F.col("r8_before"))), text_of("space after ", points(F.col("r8_after"))), aligned(F.col("r8_align")))
    header = F.array(text_of("The usual style: ", base, "."), text_of("Compared: ", n.cast("string"), " paragraphs outside headings, lists, captions, text boxes, tables and what stands before the first heading."))
    message = F.when(few, "There is too little body text to compare.").otherwise(text_of(bad.cast("string"), " of ", n.cast("string"), " paragraphs differ from the usual style."))
    evidence = F.when(~few, F.concat(header, F.transform("r8_odd", lambda x: text_of(x["s"], " — ", x["odd"]))))
    return d, Verdict(~few & (bad == 0), message, evidence, F.when(~few, F.transform("r8_odd", lambda x: x["at"])))


@rule(9, "Language", "warning", "p")
def language(d: DataFrame, c: Config) -> tuple[DataFrame, Verdict]:
    """``checker``: Column of texts in, array<struct<message, offset, length, rule_id, matched, replacements>> out."""
    if c.checker is None:
        return d, Verdict(F.lit(None), F.lit("No language checker is set."))
    terms = [t.lower() for t in (*IGNORED_TERMS, *c.ignore_words) if t.strip()]
    fine = lambda i: ~i["rule_id"].isin(*DISABLED) & ~i["matched"].rlike(IDENTIFIER) & ~i["message"].rlike(SPELLING_VARIANT) & ~reduce(lambda a, b: a | b, [F.lower(i["matched"]).contains(t) for t in terms])
    known = F.filter("ps", lambda p: ~p["in_table"] & p["level"].isNull() & (p["words"] >= c.min_words_for_language))
    issue = lambda p, i: text_of(p["place"], ": ", i["message"], F.when(F.size(i["replacements"]) > 0, text_of(" (", F.array_join(F.slice(i["replacements"], 1, REPLACEMENTS), ", "), ")")).otherwise(""))
    lines = F.transform(known, lambda p: F.struct(p["location"].alias("at"), p["issues"].isNull().alias("broken"), F.transform(F.filter(p["issues"], lambda i: yes(fine(i))), lambda i: issue(p, i)).alias("s")))
    d = d.withColumn("r9_lines", lines)
    d = d.withColumn("r9_all", F.flatten(F.transform("r9_lines", lambda x: F.coalesce(x["s"], none()))))
    broken, short = F.exists("r9_lines", lambda x: x["broken"]), F.size("r9_lines") == 0
    message = F.when(broken, "The checker failed.").when(short, "No paragraph is long enough to check.").otherwise(text_of("Language issues: ", F.least(F.size("r9_all"), F.lit(ISSUES)).cast("string")))
    at = F.transform(F.filter("r9_lines", lambda x: F.size(x["s"]) > 0), lambda x: x["at"])
    return d, Verdict(F.when(~broken, ~short & (F.size("r9_all") == 0)), message, F.slice("r9_all", 1, ISSUES), at)


@rule(10, "Required sections", "error", "p")
def sections(d: DataFrame, c: Config) -> tuple[DataFrame, Verdict]:
    d = d.withColumn("r10", F.transform("heads", lambda h: F.struct(X.normalize_key(X.strip_leading_number(h["text"])).alias("key"), h["location"].alias("at"), h["text"].alias("text"))))
    required = [r for r in c.required_sections if r.strip()]
    seen = F.transform("r10", lambda h: h["text"])
    if not required:
        return d, Verdict(F.size("r10") > 0, text_of("Sections: ", F.size("r10").cast("string")), seen, F.transform("r10", lambda h: h["at"]))

    def place(name: str) -> Column:
        key = X.normalize_key(F.lit(name))
        return F.coalesce(F.try_element_at(F.filter("r10", lambda h: h["key"] == key), F.lit(-1)), first(F.filter("r10", lambda h: h["key"].startswith(key))))["at"]

    d = d.withColumns({f"r10_{i}": place(name) for i, name in enumerate(required)})
    places = [F.col(f"r10_{i}") for i in range(len(required))]
    missing = F.array_compact(F.array(*[F.when(p.isNull(), F.lit(n)) for n, p in zip(required, places, strict=True)]))
    message = F.when(F.size(missing) > 0, text_of("Missing sections: ", F.array_join(missing, ", "))).otherwise("All required sections are there.")
    return d, Verdict(F.size(missing) == 0, message, seen, F.array_compact(F.array(*places)))


def footers() -> Column:
    return F.filter("fs", lambda f: f["kind"] == "footer")


def page_field(f: Column) -> Column:
    return yes(F.array_contains(f["fields"], "PAGE"))


def hardcoded(f: Column) -> Column:
    return ~page_field(f) & (f["text"].rlike(PAGE_TEXT) | f["text"].rlike(BARE_NUMBER))


@rule(11, "Page numbers", "warning", "f")
def page_numbers(d: DataFrame, c: Config) -> tuple[DataFrame, Verdict]:
    d = d.withColumn("r11", footers())
    typed, page = F.exists("r11", hardcoded), F.exists("r11", page_field)
    message = F.when(F.size("r11") == 0, "There are no footers.").when(typed, "A page number is typed in.").when(page, "Footers number the pages; rendered numbers aren't checked.").otherwise("No footer has a page field.")
    place = lambda kind: F.transform(F.filter("r11", kind), lambda f: f["location"])
    seen = F.transform("r11", lambda f: text_of(f["location"], ": ", F.when(page_field(f), "page field").when(hardcoded(f), text_of("typed number in ", X.snippet(f["text"]))).otherwise("no page number")))
    return d, Verdict(yes(page) & ~yes(typed), message, seen, F.when(typed, place(hardcoded)).otherwise(place(page_field)))


@rule(12, "Readability", "warning", "p")
def readability(d: DataFrame, c: Config) -> tuple[DataFrame, Verdict]:
    body = F.filter("ps", lambda p: ~p["in_table"] & p["level"].isNull() & (p["words"] >= 3))
    d = d.withColumn("r12", F.transform(body, lambda p: F.struct(R.sentences(p["text"]).cast("long").alias("s"), F.transform(R.words(p["text"]), R.syllables).alias("w"))))
    total = lambda f: F.aggregate("r12", F.lit(0).cast("long"), lambda a, x: a + f(x).cast("long"))
    d = d.withColumns({"r12_n": total(lambda x: F.size(x["w"])), "r12_s": total(lambda x: x["s"]), "r12_y": total(lambda x: F.aggregate(x["w"], F.lit(0).cast("long"), lambda a, b: a + b)), "r12_hard": total(lambda x: F.size(F.filter(x["w"], lambda k: k >= 3)))})
    enough = F.col("r12_n") >= c.readability_min_words
    rated = {"r12_flesch": R.flesch(F.col("r12_n"), F.col("r12_s"), F.col("r12_y")), "r12_fog": R.fog(F.col("r12_n"), F.col("r12_s"), F.col("r12_hard"))}
    d = d.withColumns({k: F.when(enough, v) for k, v in rated.items()})
    message = F.when(~enough, "There is too little text to be rated.").otherwise(text_of("Flesch ", F.format_number("r12_flesch", 1), ", fog ", F.format_number("r12_fog", 1)))
    seen = F.array(text_of(F.col("r12_n").cast("string"), " words in ", F.col("r12_s").cast("string"), " sentences"))
    return d, Verdict(yes(enough & (F.round("r12_flesch", 1) >= c.flesch_min) & (F.round("r12_fog", 1) <= c.fog_max)), message, seen)


@rule(13, "Footer details", "warning", "f")
def footer_details(d: DataFrame, c: Config) -> tuple[DataFrame, Verdict]:
    number = lambda f: F.nullif(F.regexp_extract(f["text"], c.doc_id_pattern, 0), F.lit(""))
    mark = lambda f: F.coalesce(*[F.when(F.lower(f["text"]).contains(t.lower()), F.lit(t.lower())) for t in c.confidentiality_terms], F.lit(None).cast("string"))
    page = lambda f: F.when(page_field(f), F.lit("page field")).when(hardcoded(f), F.lit("typed number"))
    d = d.withColumn("r13", footers())
    parts = {"id": number, "mark": mark, "page": page}
    found = lambda v: first(F.filter(F.transform("r13", lambda f: F.struct(v(f).alias("v"), f["location"].alias("at"))), lambda x: x["v"].isNotNull()))
    d = d.withColumns({f"r13_{k}": found(v) for k, v in parts.items()})
    have = [F.col(f"r13_{k}").isNotNull() for k in parts]
    passed = reduce((lambda a, b: a & b) if c.footer_require_all else (lambda a, b: a | b), have)
    listed = F.concat_ws("; ", *[F.col(f"r13_{k}.v") for k in parts])
    at = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.col(f"r13_{k}.at") for k in parts]))))
    every = F.array_sort(F.array_distinct(F.transform("r13", lambda f: f["location"])))
    message = F.when(F.size("r13") == 0, "There are no footers.").when(listed == "", "Footers have none of the details.").otherwise(text_of("Footers have: ", listed))
    return d, Verdict(passed, message, F.transform("r13", lambda f: text_of(f["location"], ": ", F.trim(f["text"]))), F.when(F.size(at) > 0, at).otherwise(every))
