"""Fits the levels of the secret scan: how random strings of joined words look. ``python -m quillspark.llm.secret_levels SF_DIR`` prints ``secrets.LEVELS``."""

from __future__ import annotations

import math
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .secrets import LENGTHS, TAILS, battery


def null_strings(docs: DataFrame, every: int) -> DataFrame:
    """token, range and single (letters of one case, else capitals at word starts): different runs of words as texts have them, joined and cut at each length of ``LENGTHS``.

    Of all places of words about one in ``every`` begins a run, picked by a hash of what it holds.
    """
    words = F.filter(F.split(F.regexp_replace(F.col("text"), "[^A-Za-z]+", " "), " "), lambda w: w != "")
    starts = docs.select(words.alias("w")).filter(F.size("w") > 0).select("w", F.posexplode("w").alias("at", "_")).select(F.slice("w", F.col("at") + 1, 40).alias("w"))
    joined = starts.select(F.array_join("w", " ").alias("run")).filter(F.pmod(F.xxhash64("run"), F.lit(every)) == 0).distinct()
    kinds = docs.sparkSession.createDataFrame([(n, s) for n in LENGTHS for s in (True, False)], "range int, single boolean")
    cut = joined.crossJoin(F.broadcast(kinds))
    whole = F.regexp_replace(F.when(F.col("single"), F.lower("run")).otherwise(F.initcap("run")), " ", "")
    return cut.select("range", "single", F.substring(whole, F.lit(1), F.col("range")).alias("token")).filter(F.length("token") == F.col("range")).distinct()


def fit(strings: DataFrame) -> dict[int, tuple[tuple[float, ...], tuple[float, ...]]]:
    """For each length the scores that the shares ``TAILS`` of ``strings`` reach, of letters of one case and of others; rounded up."""
    found = battery(strings).groupBy("range", "single").agg(F.percentile("score", F.array(*[F.lit(1 - t) for t in TAILS])).alias("levels")).collect()
    by = {(r["range"], r["single"]): tuple(math.ceil(x * 1e5) / 1e5 for x in r["levels"]) for r in found}
    return {n: (by[n, True], by[n, False]) for n in LENGTHS}


if __name__ == "__main__":
    spark = SparkSession.builder.getOrCreate()
    strings = null_strings(table(spark, sys.argv[1], "documents"), int(sys.argv[2]) if len(sys.argv) > 2 else 64).repartition(64).cache()
    strings.groupBy("range", "single").count().orderBy("range", "single").show()
    for n, both in fit(strings).items():
        print(f"    {n}: ({both[0]}, {both[1]}),")
