"""Corpus pipeline: toxicity, line dedup, n-gram Jaccard join, benchmark decontamination, mixing.

Every stage takes (spark, docs, sf_dir), and what it returns is written as Parquet and read again as the next
one's docs. ``docs`` are the columns of ``documents`` and any others; only the last stage adds columns. A null or empty
text has nothing that could be toxic, repeated, copied or leaked and stays; texts of any length are read whole; rows of one
doc_id and rows without one are rows of their own, but for lines, where rows of one id are one document. A column that is named
like an operator's output keeps its own values up to the last stage, whose outputs replace it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontam, jaccard, lines, mixing, toxicity
from quillspark.llm.common import join_spread, stage, table

#: Near-duplicate stage: five-word shingles, similarity of 0.8 and more.
WIDTH, PERCENT = 5, 80
#: A column for the rows' numbers, under a name that no table is likely to have.
ROW = "_row_of_near_copies"


def judged(docs: DataFrame, apply, keep: str = "true") -> DataFrame:
    """The columns of ``docs`` after an operator that reads doc_id and text, in the rows for which ``keep`` holds; others travel in one struct, so no name of theirs can clash."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    packed = docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in others]).alias("_others"))
    return apply(packed).filter(keep).select(*[c if c in ("doc_id", "text") else F.col(f"_others.`{c}`") for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.5 by a machine fitted on the labels of those outside the held-out fold."""
    known = table(spark, sf_dir, "labels").filter(~toxicity.fold())
    return judged(docs, lambda d: toxicity.score_toxicity(d, toxicity.train(docs.select("doc_id", "text"), known)), "predicted = 0")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that three and more share but the largest id; n_chars follows the text."""
    out = judged(docs, lines.dedup_lines)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest id (the first of several, one without an id only where none has one).

    Rows are told apart by numbers of their own, whatever their ids: an id whose one row is a near copy keeps its others.
    """
    rows = stage(docs.withColumn(ROW, F.monotonically_increasing_id()), "pipeline_rows")
    found = jaccard.jaccard_components(rows.select(F.col(ROW).alias("doc_id"), "text"), WIDTH, PERCENT).select(F.col("doc_id").alias("_row"), "component_id")
    found = found.join(rows.select(F.col(ROW).alias("_row"), F.col("doc_id").alias("_id")), "_row")
    stays = found.groupBy("component_id").agg(F.min(F.struct(F.col("_id").isNull().alias("last"), "_id", "_row")).alias("_min"), F.count(F.lit(1)).alias("_rows")).filter("_rows > 1")
    gone = join_spread(found, stays, "component_id").filter("_row <> _min._row").select("_row")
    return rows.join(gone, rows[ROW] == gone["_row"], "left_anti").drop(ROW)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    return judged(docs, lambda d: decontam.find_contamination(d, table(spark, sf_dir, "benchmark")), "not contaminated")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with size, source_size, target and taken."""
    return mixing.mix_sources(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("jaccard_join", drop_near_copies), ("decontamination", drop_contaminated), ("mixing", mix)]
#: The first stage's machine and its scores are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
