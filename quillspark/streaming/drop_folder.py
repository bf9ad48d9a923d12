"""A folder that packages are dropped into, judged as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.operators import structure
from quillspark.rules import engine
from quillspark.rules.model import Config
from quillspark.sources import package_source, packages
from quillspark.sources.staging import Staged


def judge_folder(spark: SparkSession, path: str, out: str, checkpoint: str, config: Config | None = None) -> StreamingQuery:
    """Findings and rejections of all files in ``path`` that weren't seen yet, as Parquet folders under ``out``.

    A batch is parsed once, of files with one doc_id the newest counts. Each batch writes its own folder, overwritten if it
    is run again after a failure, and leaves no other files; ``current`` gives the rows of a doc_id's last batch.
    """

    def batch(files: DataFrame, number: int) -> None:
        staged = Staged(spark, "dropped")
        try:
            rows = staged.put(files, "packages")
            newest = structure.latest(rows.filter("error is null").select("doc_id", "path", "modificationTime"), ["doc_id"], F.desc("modificationTime"), F.desc("path"))
            found = engine.evaluate(packages.package_model(rows.join(newest.select("path"), "path", "left_semi")), config)
            found.write.mode("overwrite").parquet(f"{out}/findings/batch={number}")
            Staged.release(found)
            package_source.refused(rows).write.mode("overwrite").parquet(f"{out}/rejected/batch={number}")
        finally:
            staged.drop()

    stream = package_source.read_stream(spark, path)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, out: str) -> DataFrame:
    """Of the findings of all batches those of each doc_id's last one: the last write wins."""
    rows = spark.read.parquet(f"{out}/findings")
    return rows.withColumn("_last", F.max("batch").over(Window.partitionBy("doc_id"))).filter("batch = _last").drop("_last", "batch")
