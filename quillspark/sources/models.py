"""Rule models from plain texts and from web pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.rules.model import FOOTERS, PARAGRAPHS, Model

from .corpus import TITLE, _plain

RUNS = "array<struct<name string, size double, bold boolean, chars int, bare int>>"
CELLS = "table_index int, block_index int, row int, col int, text string"


def _key(df: DataFrame, name: str) -> str:
    return f"doc_id {df.schema[name].dataType.simpleString()}"


def _paragraphs(rows: DataFrame, level: Column, is_list: Column) -> DataFrame:
    """Paragraph columns for (doc_id, block_index, text); what a source doesn't know is null."""
    known = {"location": F.format_string("Paragraph %d", "block_index"), "level": level.cast("int"), "in_table": F.lit(False), "from_textbox": F.lit(False), "is_list": is_list}
    nulls = {f.split()[0]: F.lit(None).cast(f.split(maxsplit=1)[1]) for f in ("style string", "t int", "r int", "c int", "line double", "before double", "after double", "align string", f"runs {RUNS}")}
    names = [f.strip().split()[0] for f in PARAGRAPHS.split(" runs ")[0].rstrip(",").split(",")] + ["runs"]
    return rows.withColumns(known | nulls).select("doc_id", *names)


def _empty(df: DataFrame, key: str, fields: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], f"{key}, {fields}")


def _docs(rows: DataFrame, filename: Column, title: Column) -> DataFrame:
    nulls = [F.lit(None).cast("string").alias(n) for n in ("author", "subject", "keywords", "modified_by")]
    return rows.select("doc_id", filename.alias("filename"), title.alias("title"), *nulls)


def text_model(documents: DataFrame) -> Model:
    """Documents (doc_id, text, source): a paragraph for each line, no headings, tables or footers."""
    key = _key(documents, "doc_id")
    lines = documents.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("block_index", "text"))
    docs = _docs(documents, F.col("source"), F.lit(None).cast("string"))
    return Model(docs, _paragraphs(lines, F.lit(None), F.lit(False)), _empty(documents, key, CELLS), _empty(documents, key, FOOTERS))


def page_model(pages: DataFrame) -> Model:
    """Pages (page_id, url, html): headings, paragraphs and list items in order, footer elements, the title."""
    pages = pages.withColumn("doc_id", F.col("page_id")).withColumn("html", F.coalesce("html", F.lit("")))
    key = _key(pages, "doc_id")
    tags = F.regexp_extract_all("html", F.lit(r"(?is)(<(h[1-6]|p|li)\b[^>]*>.*?)</\2>"), F.lit(1))
    rows = pages.select("doc_id", F.posexplode(tags).alias("block_index", "tag"))
    rows = rows.select("doc_id", "block_index", F.lower(F.regexp_extract("tag", r"^<(\w+)", 1)).alias("kind"), _plain(F.col("tag")).alias("text"))
    level = F.when(F.col("kind").startswith("h"), F.substring("kind", 2, 1))
    feet = pages.select("doc_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<footer\b[^>]*>(.*?)</footer>"), F.lit(1))).alias("ord", "tag"))
    feet = feet.select("doc_id", "ord", F.lit("footer").alias("kind"), F.lit("default").alias("which"), F.format_string("Footer %d", F.col("ord") + 1).alias("location"), _plain(F.col("tag")).alias("text"), F.array().cast("array<string>").alias("fields"))
    title = F.nullif(_plain(F.regexp_extract("html", TITLE, 1)), F.lit(""))
    return Model(_docs(pages, F.col("url"), title), _paragraphs(rows, level, F.col("kind") == "li"), _empty(pages, key, CELLS), feet)


def event_model(events: DataFrame) -> Model:
    """A document for every user of ``events`` (event_id, ts, user_id, event_type, value, props with a number k).

    Clicks are headings, views paragraphs, errors signature lines; purchases fill a revision table and signups a
    table of signatures, each standing where its first event does. Every seventh user's first table is another one.
    Names, properties and footers follow the user's number.
    """
    user, k, number = F.col("doc_id"), F.col("k"), F.row_number().over
    rows = events.select(F.col("user_id").alias("doc_id"), "event_id", "ts", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    rows = rows.withColumn("b", (number(Window.partitionBy("doc_id").orderBy("event_id")) * 10).cast("int")).withColumn("n", number(Window.partitionBy("doc_id", "event_type").orderBy("event_id")).cast("int"))
    day = F.date_format("ts", "dd MMM yyyy")
    is_ = lambda kind: F.col("event_type") == kind
    text = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    heading = F.when(k == 5, "Revision History").when(k == 1, "1. Purpose").otherwise(text("Section ", k))
    body = F.when(k % 10 == 0, text("This is version 2.", k, " of the record.")).when(k == 3, "Author: Kim West").when(k == 13, "The team reads teh record again each week.").otherwise(text("The team keeps the record of step ", k, " and reads it again each week."))
    signed = F.when(k % 5 == 0, "Approved by:").when(k % 2 == 0, text("Approved by: Sam Lake ", day)).otherwise("Approved by: Sam Lake")
    flow = rows.filter(~is_("purchase") & ~is_("signup")).select("doc_id", F.col("b").alias("block_index"), F.when(is_("click"), heading).when(is_("view"), body).otherwise(signed).alias("text"), F.when(is_("click"), k % 3 + 1).alias("level"), F.lit(None).cast("int").alias("t"), F.lit(None).cast("int").alias("r"), F.lit(None).cast("int").alias("c"), F.when(is_("view") & (k == 7), 14.0).otherwise(11.0).alias("size"))
    kept = F.array(text("1.", F.col("n")), F.when(F.col("value") > 95, "not yet").when(F.col("value") < 1, F.concat(F.date_format("ts", "dd MMM"), F.lit(" 2030"))).otherwise(day), F.when(k % 2 == 0, "Robin Field").otherwise("user"), text("change ", k))
    names = F.array(F.when(k % 2 == 1, "Sam Lake").otherwise(""), F.lit("Officer"), F.when(k % 3 > 0, day).otherwise(""))
    first = F.when(user % 7 == 0, F.array(*map(F.lit, ("Item", "Name", "Note", "Value")))).otherwise(F.array(*map(F.lit, ("Version", "Date", "Author", "Description"))))
    heads = F.when(is_("purchase"), first).otherwise(F.array(*map(F.lit, ("Name", "Role", "Date"))))
    filled = rows.filter(is_("purchase") | is_("signup")).withColumn("t", F.when(is_("purchase"), 0).otherwise(1))
    lines = filled.select("doc_id", "t", F.col("b").alias("at"), F.col("n").alias("r"), F.when(F.col("t") == 0, kept).otherwise(names).alias("x"))
    lines = lines.unionByName(filled.filter("n = 1").select("doc_id", "t", (F.col("b") - 5).alias("at"), F.lit(0).alias("r"), heads.alias("x")))
    spots = filled.groupBy("doc_id", "t").agg((F.min("b") - 6).alias("block"))
    cells = lines.join(spots, ["doc_id", "t"]).select("doc_id", "t", "at", "r", "block", F.posexplode("x").alias("c", "text"))
    inside = cells.select("doc_id", (F.col("at") + F.col("c")).alias("block_index"), "text", F.lit(None).cast("int").alias("level"), "t", "r", "c", F.lit(11.0).alias("size"))
    every = flow.unionByName(inside).withColumn("text", F.coalesce("text", F.lit("")))
    nulls = {f.split()[0]: F.lit(None).cast(f.split(maxsplit=1)[1]) for f in ("style string", "line double", "before double", "after double", "align string")}
    place = F.when(F.col("t").isNull(), F.format_string("Paragraph %d", "block_index")).otherwise(F.format_string("Table %d, row %d, cell %d", F.col("t") + 1, F.col("r") + 1, F.col("c") + 1))
    run = F.struct(F.lit("Serif").alias("name"), "size", F.lit(False).alias("bold"), F.length("text").alias("chars"), F.length(F.trim("text")).alias("bare"))
    known = {"location": place, "in_table": F.col("t").isNotNull(), "from_textbox": F.lit(False), "is_list": F.lit(False), "runs": F.array(run)}
    columns = [f.strip().split()[0] for f in PARAGRAPHS.split(" runs ")[0].rstrip(",").split(",")] + ["runs"]
    paragraphs = every.withColumns(known | nulls).select("doc_id", *columns)
    people = rows.select("doc_id").distinct()
    title = F.when(user % 3 == 0, text("Account ", user)).when(user % 3 == 1, text("Account ", user + 1))
    author = F.when(user % 4 == 0, "Admin").when(user % 4 == 1, "Robin Field")
    name = F.when(user % 5 == 0, text("Account ", user, " v2.10.docx")).otherwise(text("Account ", user, ".docx"))
    docs = people.select("doc_id", name.alias("filename"), title.alias("title"), author.alias("author"), *[F.lit(None).cast("string").alias(n) for n in ("subject", "keywords", "modified_by")])
    foot = F.when(user % 4 == 1, text("QA-SOP-", user, " Confidential")).when(user % 4 == 2, "Page 3").otherwise("kept by the office")
    fields = F.when(user % 4 == 1, F.array(F.lit("PAGE"))).otherwise(F.array().cast("array<string>"))
    feet = people.filter(user % 4 != 0).select("doc_id", F.lit(0).alias("ord"), F.lit("footer").alias("kind"), F.lit("default").alias("which"), F.lit("Footer, section 1").alias("location"), foot.alias("text"), fields.alias("fields"))
    return Model(docs, paragraphs, cells.select("doc_id", F.col("t").alias("table_index"), F.col("block").alias("block_index"), F.col("r").alias("row"), F.col("c").alias("col"), F.coalesce("text", F.lit("")).alias("text")), feet)
