"""Structure of documents: sections, ranges, nearest blocks, modes, summaries. Everything is keyed by doc_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as X


def in_order():
    return Window.partitionBy("doc_id").orderBy("block_index")



def flow_positions(blocks: DataFrame) -> DataFrame:
    """With flow_pos: the place of a block in its document, from 0."""
    return blocks.withColumn("flow_pos", (F.row_number().over(in_order()) - 1).cast("long"))


def with_section(blocks: DataFrame) -> DataFrame:
    """With section: block_index of the nearest heading at or before (a backward as-of join as one window)."""
    heads = F.when(F.col("level").isNotNull(), F.col("block_index"))
    return blocks.withColumn("section", F.last(heads, ignorenulls=True).over(in_order().rowsBetween(Window.unboundedPreceding, 0)))


def heading_ranges(blocks: DataFrame, deepest: int = 9) -> DataFrame:
    """doc_id, block_index, level, until: the next heading of this or a higher level (null: the end).

    For each level a window carries the next heading of that level or above backwards; no self-join.
    """
    after = in_order().rowsBetween(1, Window.unboundedFollowing)
    heads = blocks.filter("level is not null").select("doc_id", "block_index", "level")
    nexts = [F.min(F.when(F.col("level") <= n, F.col("block_index"))).over(after) for n in range(1, deepest + 1)]
    pick = F.element_at(F.array(*nexts), F.greatest(F.least(F.col("level"), F.lit(deepest)), F.lit(1)).cast("int"))
    return heads.withColumn("until", pick)


def between(ranges: DataFrame, blocks: DataFrame) -> DataFrame:
    """Blocks strictly between a heading and its ``until``: doc_id, heading, block_index."""
    inner = blocks.select(F.col("doc_id").alias("_d"), F.col("block_index").alias("_b"))
    on = (ranges["doc_id"] == inner["_d"]) & (inner["_b"] > ranges["block_index"]) & (ranges["until"].isNull() | (inner["_b"] < ranges["until"]))
    return ranges.join(inner, on).select("doc_id", F.col("block_index").alias("heading"), F.col("_b").alias("block_index"))


def nearest_within(blocks: DataFrame, anchor: Column, target: Column, window: int = 4) -> DataFrame:
    """doc_id, block_index of every anchor, and nearest: flow position of the closest target within ``window`` positions.

    The anchor itself counts first; of two equally close ones the earlier wins. One ordered frame per
    document, no join.
    """
    placed = flow_positions(blocks).withColumns({"_anchor": anchor, "_target": target})
    near = F.collect_list(F.when(F.col("_target"), F.col("flow_pos"))).over(in_order().rowsBetween(-window, window))
    placed = placed.withColumn("_near", near).filter("_anchor")
    own = F.col("flow_pos")
    ranked = F.array_sort(F.transform("_near", lambda p: F.struct(F.abs(p - own).alias("far"), p.alias("pos"))))
    return placed.select("doc_id", "block_index", "flow_pos", F.get(ranked, F.lit(0))["pos"].alias("nearest"))


def weighted_mode(rows: DataFrame, keys: list[str], value: str, weight: str, order: str) -> DataFrame:
    """Per key the value with the largest summed weight; of equal sums the one seen first. Null is a value."""
    sums = rows.groupBy(*keys, F.col(value).alias("_v")).agg(F.sum(weight).alias("_w"), F.min(order).alias("_first"))
    best = F.max_by(F.struct("_v", "_w"), F.struct(F.col("_w"), -F.col("_first")))
    return sums.groupBy(*keys).agg(best.alias("_b")).select(*keys, F.col("_b._v").alias(value), F.col("_b._w").alias(weight))


def out_of_order(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """With ``earlier``: the value is less than the one before it; rows without a value are passed over."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.filter(F.col(value).isNotNull()).withColumn("earlier", F.coalesce(F.col(value) < F.lag(value).over(w), F.lit(False)))


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Upsert: the last row of each key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def verdict_summary(findings: DataFrame, keys: list[str]) -> DataFrame:
    """total, passed, failed, not_evaluated, errors, warnings; null is neither passed nor failed."""
    ok, severity = F.col("passed"), F.col("severity")
    count = lambda c: F.count_if(c).alias
    return findings.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), count(ok)("passed"), count(~ok)("failed"), count(ok.isNull())("not_evaluated"),
        count(~ok & (severity == "error"))("errors"), count(~ok & (severity == "warning"))("warnings"),
    )


def infer_heading_levels(paragraphs: DataFrame, runs: DataFrame) -> DataFrame:
    """doc_id, block_index, inferred: levels of unstyled documents from the sizes and weights of their lines.

    ``paragraphs``: doc_id, block_index, text, in_table, from_textbox, is_list, declared (any level);
    ``runs``: doc_id, block_index, size, bold, chars, bare (chars without white space at the ends), ord. Sizes weigh by chars, weights by bare. Documents that declare
    a level are left out; runs without a size count for no size.
    """
    bare = paragraphs.groupBy("doc_id").agg(F.count_if(F.col("declared").isNotNull()).alias("_n")).filter("_n = 0").select("doc_id")
    body = paragraphs.filter("not in_table and not from_textbox and trim(text) <> ''").join(bare, "doc_id", "left_semi")
    body = body.withColumn("_k", F.count(F.lit(1)).over(Window.partitionBy("doc_id"))).filter("_k >= 4").drop("_k")
    own = runs.join(body.select("doc_id", "block_index"), ["doc_id", "block_index"], "left_semi")
    sized = own.filter("size is not null")
    size = weighted_mode(sized.withColumn("_o", F.col("ord")), ["doc_id", "block_index"], "size", "chars", "_o").select("doc_id", "block_index", "size")
    usual = weighted_mode(sized.withColumn("_o", F.col("block_index") * 100_000 + F.col("ord")), ["doc_id"], "size", "chars", "_o").select("doc_id", F.col("size").alias("usual"))
    bold = own.groupBy("doc_id", "block_index").agg((F.sum(F.when(F.col("bold"), F.col("bare")).otherwise(0)) > F.sum(F.when(F.coalesce("bold", F.lit(False)), 0).otherwise(F.col("bare")))).alias("bold"))
    rows = body.join(size, ["doc_id", "block_index"], "left").join(bold, ["doc_id", "block_index"], "left").join(usual, "doc_id", "left").fillna(False, ["bold"])
    rows = rows.withColumn("_share", F.avg(F.col("bold").cast("int")).over(Window.partitionBy("doc_id")))
    few = F.size(F.split(F.trim("text"), r"\s+")) <= 12
    big = F.coalesce(F.col("size") > F.col("usual"), F.lit(False))
    rows = rows.filter(~F.col("is_list") & few & ~F.col("text").rlike(r"[.;,!?]\s*$") & (big | ((F.col("_share") <= 0.4) & F.col("bold"))))
    rank = F.dense_rank().over(Window.partitionBy("doc_id").orderBy(F.col("size").desc_nulls_last()))
    return rows.select("doc_id", "block_index", F.least(rank, F.lit(9)).alias("inferred"))


def digest(m) -> DataFrame:
    """Counts of what every document of a model holds: an aggregate for each child table."""
    paragraphs = m.paragraphs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_paragraphs"), F.count_if(F.trim("text") != "").alias("n_filled"), F.count_if(F.col("level").isNotNull() & ~F.col("in_table")).alias("n_headings"), F.sum(F.size("runs")).alias("n_runs"))
    shapes = table_shapes(m.cells).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_tables"), F.max("n_rows").alias("longest_table"))
    parts = m.footers.groupBy("doc_id").agg(F.count_if(F.col("kind") == "footer").alias("n_footers"), F.count_if(F.col("kind") == "header").alias("n_headers"), F.sum(F.size("fields")).alias("n_fields"))
    rows = m.docs.select("doc_id")
    for part in (paragraphs, shapes, parts):
        rows = rows.join(part, "doc_id", "left")
    return rows.fillna(0)


def table_shapes(cells: DataFrame) -> DataFrame:
    """doc_id, table_index, n_rows, n_columns and texts of the first row, joined."""
    first = F.transform(F.array_sort(F.collect_list(F.when(F.col("row") == 0, F.struct("col", F.trim("text").alias("x"))))), lambda s: s["x"])
    return cells.groupBy("doc_id", "table_index").agg((F.max("row") + 1).cast("long").alias("n_rows"), F.count_if(F.col("row") == 0).alias("n_columns"), F.array_join(first, " | ").alias("first_row"))


def first_paragraphs(flow: DataFrame, most: int = 20, width: int = 160) -> DataFrame:
    """doc_id, block_index, flow_pos, shown: a document's first paragraphs, cut to ``width`` characters."""
    cut = F.when(F.length("text") > width, F.concat(F.rtrim(F.substring("text", 1, width - 1)), F.lit("…"))).otherwise(F.col("text"))
    return flow.filter(F.col("flow_pos") < most).select("doc_id", "block_index", "flow_pos", cut.alias("shown"))


def section_view(blocks: DataFrame, section: str) -> DataFrame:
    """Blocks of the sections with this heading (as a key): from the heading to the next one of its level or above."""
    named = X.normalize_key(X.strip_leading_number(F.col("text"))) == X.normalize_key(F.lit(section))
    heads = blocks.filter("level is not null and not in_table").select("doc_id", "block_index", "level", "text")
    wanted = heading_ranges(heads).join(heads.filter(named).select("doc_id", "block_index"), ["doc_id", "block_index"], "left_semi")
    wanted = wanted.select(F.col("doc_id").alias("_d"), F.col("block_index").alias("_a"), F.col("until").alias("_u"))
    inside = (blocks["doc_id"] == F.col("_d")) & (blocks["block_index"] >= F.col("_a")) & (F.col("_u").isNull() | (blocks["block_index"] < F.col("_u")))
    return blocks.join(wanted, inside, "left_semi")


def summary_view(blocks: DataFrame) -> DataFrame:
    """Headings alone: a document's outline."""
    return blocks.filter("level is not null and not in_table").select("doc_id", "block_index", "level", "text")


def with_section_text(blocks: DataFrame) -> DataFrame:
    """With section_text: the text of the nearest heading at or before."""
    head = F.when(F.col("level").isNotNull(), F.col("text"))
    return blocks.withColumn("section_text", F.last(head, ignorenulls=True).over(in_order().rowsBetween(Window.unboundedPreceding, 0)))
