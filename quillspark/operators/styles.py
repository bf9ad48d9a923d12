"""Inheritance along chains: the nearest ancestor that sets a value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Steps after which a chain is given up.
DEEPEST = 50
CHAIN = """WITH RECURSIVE chain(doc_id, style_id, at, depth, seen) AS (
  SELECT doc_id, style_id, style_id, 0, array(style_id) FROM {styles}
  UNION ALL
  SELECT c.doc_id, c.style_id, s.based_on, c.depth + 1, concat(c.seen, array(s.based_on)) FROM chain c JOIN {styles} s ON s.doc_id = c.doc_id AND s.style_id = c.at
  WHERE s.based_on IS NOT NULL AND c.depth < {deepest} AND NOT array_contains(c.seen, s.based_on))
SELECT doc_id, style_id, at, depth FROM chain"""


def chains(styles: DataFrame, deepest: int = DEEPEST) -> DataFrame:
    """doc_id, style_id, at, depth: every style with itself (depth 0) and its ancestors, by a recursive query.

    ``styles``: doc_id, style_id, based_on. A chain ends where it comes to a style that it has seen, or after ``deepest`` steps;
    the last ``at`` may be a style that doesn't exist.
    """
    spark = styles.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")  # all styles of all documents go through one recursion
    return spark.sql(CHAIN, styles=styles.select("doc_id", "style_id", "based_on"), deepest=deepest)


def inherited(styles: DataFrame, values: list[str], deepest: int = DEEPEST) -> DataFrame:
    """doc_id, style_id and, for each of ``values``, what the style or else its nearest ancestor sets; null where none does."""
    own = styles.select(F.col("doc_id").alias("_d"), F.col("style_id").alias("_s"), *values)
    rows = chains(styles, deepest).join(own, (F.col("doc_id") == F.col("_d")) & (F.col("at") == F.col("_s")))
    nearest = [F.min_by(v, F.when(F.col(v).isNotNull(), F.col("depth"))).alias(v) for v in values]
    return rows.groupBy("doc_id", "style_id").agg(*nearest)
