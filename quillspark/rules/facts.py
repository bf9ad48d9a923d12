"""One row per document with all that rules ask for, its children as nested arrays in order.

Each child table is dealt by doc_id once; windows, rows of tables, tables and the document's arrays are all built where
its rows lie then. A document is as large as its package, which is read as one row as well.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import dates as D
from quillspark.functions import text as X
from quillspark.operators import structure

from .checker import ISSUE
from .model import (
    AUTHOR_HEADER, DATE_HEADER, NAME_HEADER, PERSON_HEADER, REVISION_HEADER, REVISION_HEADING, SIGNATURE_LINE, SIGNATURE_WORDS, SIGNING_HEADER, VERSION_LABEL, Config, Model, yes,
)

FIELDS = ("block_index", "flow_pos", "text", "location", "place", "level", "in_table", "from_textbox", "is_list", "style", "t", "r", "c", "line", "before", "after", "align", "runs", "words", "filled", "heading", "signature", "dates", "near", "issues")
TABLE = ("table_index", "block_index", "rows", "pairs", "joined", "populated", "revision", "signing", "date_col", "author_col", "version_col", "name_col", "person_cols", "days", "name_dates", "row_dates")


def first(items: Column) -> Column:
    return F.get(items, F.lit(0))


def at_col(row: Column, col: Column) -> Column:
    """Text of a row's cell in a column; null where it has none."""
    return first(F.filter(row["xs"], lambda x: x["col"] == col))["text"]


def under(table: Column, col: str) -> Column:
    """row and value of the cells below the header in the column that a field of ``table`` names."""
    want = table[col]
    rows = F.transform(F.filter(table["rows"], lambda r: r["row"] > 0), lambda r: F.struct(r["row"].alias("row"), F.trim(at_col(r, want)).alias("value")))
    return F.filter(rows, lambda x: x["value"].isNotNull())


def section_of(heads: Column, block: Column) -> Column:
    return F.try_element_at(F.filter(heads, lambda h: h["block_index"] <= block), F.lit(-1))["text"]


def _paragraphs(m: Model, c: Config, dated: bool, checked: bool) -> DataFrame:
    p = m.paragraphs.repartition("doc_id").withColumn("text", F.coalesce("text", F.lit("")))
    text, order = F.col("text"), structure.in_order()
    p = p.withColumns({"words": X.word_count(text), "filled": X.squeeze(text) != ""}).withColumn("heading", F.col("level").isNotNull() & ~F.col("in_table") & F.col("filled"))
    p = p.withColumn("signature", ~yes(F.col("r") == 0) & F.col("level").isNull() & F.col("words").between(1, SIGNATURE_WORDS) & F.trim(text).rlike(SIGNATURE_LINE))
    strings = F.when(text.rlike(X.ANY_DATE), X.date_strings(text))
    p = p.withColumn("dates", D.parseable(strings) if dated else F.lit(None).cast("array<string>"))
    wide = F.col("level").isNull() & ~F.col("in_table") & (F.col("words") >= c.min_words_for_language)
    p = p.withColumn("issues", F.when(wide, c.checker(text)) if checked else F.lit(None).cast(ISSUE))
    p = p.withColumn("flow_pos", F.row_number().over(order) - 1)
    section = F.last(F.when(F.col("heading"), text), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    p = p.withColumn("place", X.locator(F.coalesce("location", F.format_string("Block %d", "block_index")), section))
    reach = max(1, c.date_window)
    near = F.collect_list(F.when(F.size("dates") > 0, F.struct(F.col("flow_pos").alias("pos"), "t", first(F.col("dates")).alias("day")))).over(order.rowsBetween(-reach, reach))
    p = p.withColumn("near", F.when(F.col("signature") | yes(F.col("c") == 0), near) if dated else F.lit(None).cast("array<struct<pos:int,t:int,day:string>>"))
    return p.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*FIELDS))).alias("ps"))


def _tables(m: Model, dated: bool) -> DataFrame:
    cells = m.cells.repartition("doc_id").withColumn("text", F.coalesce("text", F.lit("")))
    rows = cells.groupBy("doc_id", "table_index", "row").agg(F.min("block_index").alias("block_index"), F.array_sort(F.collect_list(F.struct("col", "text"))).alias("xs"))
    t = rows.groupBy("doc_id", "table_index").agg(F.min("block_index").alias("block_index"), F.array_sort(F.collect_list(F.struct("row", "xs"))).alias("rows"))
    head = F.coalesce(first(F.filter("rows", lambda r: r["row"] == 0))["xs"], F.array().cast("array<struct<col:int,text:string>>"))
    t = t.withColumn("_h", F.transform(head, lambda x: F.struct(x["col"].alias("col"), X.normalize_key(x["text"]).alias("k"))))
    column = lambda p: first(F.filter("_h", lambda x: x["k"].rlike(p)))["col"]
    pairs = F.transform("rows", lambda r: F.struct(r["row"].alias("row"), X.squeeze(at_col(r, F.lit(0))).alias("label"), F.trim(at_col(r, F.lit(1))).alias("value")))
    t = t.withColumns({
        "joined": F.array_join(F.transform("_h", lambda x: x["k"]), " "), "pairs": F.filter(pairs, lambda x: X.word_count(x["label"]).between(1, 4) & (x["value"] != "")),
        "populated": F.exists("rows", lambda r: (r["row"] > 0) & F.exists(r["xs"], lambda x: F.trim(x["text"]) != "")),
        "date_col": column(DATE_HEADER), "author_col": column(AUTHOR_HEADER), "version_col": column(VERSION_LABEL), "name_col": column(NAME_HEADER),
        "person_cols": F.transform(F.filter("_h", lambda x: x["k"].rlike(PERSON_HEADER)), lambda x: x["col"]),
    })
    t = t.withColumn("revision", F.col("joined").rlike(DATE_HEADER) & F.col("joined").rlike(REVISION_HEADER))
    t = t.withColumn("signing", ~F.col("revision") & F.col("joined").rlike(NAME_HEADER) & F.col("joined").rlike(SIGNING_HEADER))
    if dated:
        this = F.struct("rows", "date_col", "name_col")
        strings = lambda x: F.when(x.rlike(X.ANY_DATE), X.date_strings(x)).otherwise(F.array().cast("array<string>"))
        t = t.withColumns({
            "days": F.when(F.col("revision"), F.transform(under(this, "date_col"), lambda x: x["value"])), "name_dates": F.when(F.col("signing"), F.transform(under(this, "name_col"), lambda x: strings(x["value"]))),
            "row_dates": F.transform("rows", lambda r: F.flatten(F.transform(r["xs"], lambda x: strings(x["text"])))),
        })
        t = t.select("doc_id", *TABLE).repartition("doc_id")  # Python functions take columns that are there already
        t = t.withColumns({"days": D.parse_dates("days"), "name_dates": D.parseable_each("name_dates"), "row_dates": D.parseable_each("row_dates")})
    else:
        t = t.withColumns({"days": F.lit(None).cast("array<timestamp>"), "name_dates": F.lit(None).cast("array<array<string>>"), "row_dates": F.lit(None).cast("array<array<string>>")})
    return t.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*TABLE))).alias("ts"))


def _footers(m: Model) -> DataFrame:
    return m.footers.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "kind", "which", "location", "text", "fields"))).alias("fs"))


def gather(m: Model, c: Config, parts: str = "ptf", dated: bool = True, checked: bool = True) -> DataFrame:
    """``docs`` with ps (paragraphs), ts (tables), fs (headers and footers), and of these heads, history (the heading that names it) and past (the revision table).

    ``parts`` says which children are wanted; those that aren't are empty. Without ``dated`` no date is looked for.
    """
    wanted = {"ps": ("p", lambda: _paragraphs(m, c, dated, checked and c.checker is not None)), "ts": ("t", lambda: _tables(m, dated)), "fs": ("f", lambda: _footers(m))}
    rows = [make() for part, make in wanted.values() if part in parts]
    d = reduce(lambda a, b: a.join(b, "doc_id", "left"), rows, m.docs)
    for name, (part, _) in wanted.items():
        d = d.withColumn(name, F.coalesce(name, F.array()) if part in parts else F.array().cast(EMPTY[name]))
    heads = F.filter("ps", lambda p: p["heading"])
    d = d.withColumn("heads", F.transform(heads, lambda p: F.struct(p["block_index"].alias("block_index"), p["level"].alias("level"), p["text"].alias("text"), p["location"].alias("location"))))
    named = F.filter("ps", lambda p: ~p["in_table"] & p["text"].rlike(REVISION_HEADING) & (p["level"].isNotNull() | (p["words"] <= 6)))
    pick = F.array_min(F.transform(named, lambda p: F.struct(p["level"].isNull().cast("int").alias("plain"), p["block_index"].alias("at"), F.coalesce(p["level"], F.lit(99)).alias("level"))))
    d = d.withColumn("history", pick)
    found = F.transform(F.filter("ts", lambda t: t["revision"]), lambda t: F.struct(F.coalesce(t["block_index"] <= F.col("history.at"), F.lit(True)).cast("int").alias("ahead"), t["block_index"].alias("b"), t["table_index"].alias("i"), t.alias("t")))
    return d.withColumn("past", F.array_min(found)["t"])


_P = "array<struct<block_index:int,flow_pos:int,text:string,location:string,place:string,level:int,in_table:boolean,from_textbox:boolean,is_list:boolean,style:string,t:int,r:int,c:int,line:double,before:double,after:double,align:string,runs:array<struct<name:string,size:double,bold:boolean,chars:int,bare:int>>,words:bigint,filled:boolean,heading:boolean,signature:boolean,dates:array<string>,near:array<struct<pos:int,t:int,day:string>>,issues:" + ISSUE + ">>"
_T = "array<struct<table_index:int,block_index:int,rows:array<struct<row:int,xs:array<struct<col:int,text:string>>>>,pairs:array<struct<row:int,label:string,value:string>>,joined:string,populated:boolean,revision:boolean,signing:boolean,date_col:int,author_col:int,version_col:int,name_col:int,person_cols:array<int>,days:array<timestamp>,name_dates:array<array<string>>,row_dates:array<array<string>>>>"
_F = "array<struct<ord:int,kind:string,which:string,location:string,text:string,fields:array<string>>>"
#: Types of what a rule can do without.
EMPTY = {"ps": _P, "ts": _T, "fs": _F}
