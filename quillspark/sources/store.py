"""Sinks and scans: extractions and findings as JSON, vectors with their dimension, raw files."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import structure
from quillspark.rules.model import Model

ITEMS = "block_index int, kind string, text string, level int, table_index int, location string"


def extraction(m: Model, dates: DataFrame | None = None) -> DataFrame:
    """doc_id, filename, blocks (paragraphs outside tables and table references, in order) and tables (rows of cell texts); with ``dates`` (``packages.core_dates``) created and modified."""
    text = m.paragraphs.filter("not in_table").select("doc_id", "block_index", F.lit("paragraph").alias("kind"), "text", "level", F.lit(None).cast("int").alias("table_index"), "location")
    rows = m.cells.groupBy("doc_id", "table_index", "row").agg(F.min("block_index").alias("block_index"), F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda s: s["text"]).alias("cells"))
    tables = rows.groupBy("doc_id", "table_index").agg(F.min("block_index").alias("block_index"), F.transform(F.array_sort(F.collect_list(F.struct("row", "cells"))), lambda s: s["cells"]).alias("rows"))
    refs = tables.select("doc_id", "block_index", F.lit("table").alias("kind"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("int").alias("level"), "table_index", F.format_string("Table %d", F.col("table_index") + 1).alias("location"))
    blocks = text.unionByName(refs).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("block_index", "kind", "text", "level", "table_index", "location"))).alias("blocks"))
    tables = tables.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("table_index", "rows"))).alias("tables"))
    out = m.docs.select("doc_id", "filename").join(blocks, "doc_id", "left").join(tables, "doc_id", "left")
    return out if dates is None else out.join(dates.select("doc_id", "created", "modified"), "doc_id", "left")


def write_extractions(rows: DataFrame, path: str) -> None:
    """JSON lines in a folder for each doc_id; those of other documents stay, a document's own are replaced."""
    rows.withColumn("stem", F.col("doc_id")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stem").json(path)


def read_extractions(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """Extractions of a folder's files whose names match ``pattern``; created and modified where they were written."""
    schema = f"doc_id string, filename string, created timestamp, modified timestamp, blocks array<struct<{ITEMS}>>, tables array<struct<table_index int, rows array<array<string>>>>"
    return spark.read.schema(schema).option("pathGlobFilter", pattern).json(path)


def in_name_order(extractions: DataFrame) -> DataFrame:
    """With ins_ord, ascending in the order of file names (then doc_id): rows are sorted by ranges, not in one task, and numbers have gaps between these."""
    return extractions.orderBy("filename", "doc_id").withColumn("ins_ord", F.monotonically_increasing_id())


def table_text(rows: Column) -> Column:
    """Rows of cell texts joined by " | ", one a line; rows of blanks are left out."""
    full = F.filter(rows, lambda r: F.exists(r, lambda x: F.trim(x) != ""))
    return F.array_join(F.transform(full, lambda r: F.array_join(F.transform(r, lambda x: F.trim(x)), " | ")), "\n")


def records(extractions: DataFrame) -> DataFrame:
    """Ordered records for chunks: paragraphs, and tables as rows of cells joined by " | "; blanks are left out."""
    blocks = extractions.select("doc_id", F.explode("blocks").alias("b")).select("doc_id", "b.*")
    tables = extractions.select("doc_id", F.explode("tables").alias("t")).select("doc_id", "t.table_index", "t.rows")
    tables = tables.select("doc_id", "table_index", table_text(F.col("rows")).alias("body"))
    out = blocks.join(tables, ["doc_id", "table_index"], "left").withColumn("text", F.coalesce("body", F.trim("text"))).filter("text <> ''")
    return out.select("doc_id", F.col("block_index").alias("ord"), "text", "block_index", "location", "kind", "level", "table_index")


def quietly(write, *args) -> bool:
    """Runs a write; a failure is logged and gives False."""
    try:
        write(*args)
        return True
    except Exception:
        logging.getLogger(__name__).exception("a write failed")
        return False


def write_raw(files: DataFrame, path: str) -> None:
    """Byte-exact copies of accepted files as Parquet, a folder for each doc_id that holds its newest version; other documents' folders stay."""
    newest = structure.latest(files.filter("code is null").select("doc_id", "path", "modificationTime"), ["doc_id"], F.col("modificationTime").desc(), F.col("path").desc())
    kept = files.join(newest.select("path"), "path", "left_semi").select(F.col("doc_id").alias("stem"), "doc_id", "filename", "modificationTime", "length", "content")
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stem").parquet(path)


def write_findings(findings: DataFrame, path: str) -> None:
    findings.drop("extraction").write.mode("overwrite").json(path)


def write_vectors(vectors: DataFrame, path: str, dimension: int) -> None:
    """id, ins_ord, embedding; a vector of another size, a zero one or one that isn't finite stops the write."""
    v = F.col("embedding")
    bad = v.isNull() | (F.size(v) != dimension) | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists(v, lambda x: x != 0)
    checked = vectors.withColumn("embedding", F.when(bad, F.raise_error(F.concat(F.lit("not a vector of the store: "), F.col("id").cast("string")))).otherwise(v))
    checked.withColumn("dimension", F.lit(dimension)).write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
