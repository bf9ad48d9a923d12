"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only).

Every source has a word target. A document's position is a 40-bit hash of its id, and 23 bits more that part rows with
one id; the words of a source are summed by source and hash bucket, the bucket in which the budget ends is found,
only that bucket is refined (twice), and the documents are then filtered by ``hash < threshold``. Nothing is sorted but
small histograms.
Thresholds nest: a mix with a smaller budget holds a subset of the documents of a larger one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import rest, stage

WORDS = r"[^\x20\x09-\x0D]+"
HASH_BITS, TEXT_BITS, ROW_BITS, BUCKET_BITS = 40, 12, 11, 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORDS)), F.lit(0)).cast("long")


def position(doc_id: Column, text: Column) -> Column:
    """40 bits of the id's MD5 (a document without an id is placed by its text), then bits of the text and, for rows that have both in common, of the row."""
    key = F.coalesce(doc_id.cast("string"), text.cast("string"), F.lit(""))
    place = F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("long")
    for value, bits in ((text.cast("string"), TEXT_BITS), (F.monotonically_increasing_id(), ROW_BITS)):
        place = F.shiftleft(place, bits) + F.pmod(F.xxhash64(value), F.lit(1 << bits))
    return place


def sized(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"size": word_count(F.col("text")), "_u": position(F.col("doc_id"), F.col("text"))})


def targets(sizes: DataFrame, weights: tuple[float, ...], budget: float, cap: float) -> DataFrame:
    """One row per source: source_size and target.

    ``sizes`` has source and source_size. Sources by code point, null last, take ``weights`` in turn and share
    ``budget`` x all words; none gets above ``cap`` x its size, what is cut is shared again. That is the water
    level L with sum(min(cap * size, L * weight)) = budget: the largest of the levels that follow when the
    first k sources by cap * size / weight are full.
    """
    everything = Window.partitionBy(F.lit(0))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("_rank", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumns({"_w": w, "_cap": F.col("source_size") * F.lit(float(cap))})
    by_fill = everything.orderBy(F.col("_cap") / F.col("_w"), "_rank")
    so_far = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    full, after = F.coalesce(F.sum("_cap").over(so_far), F.lit(0.0)), F.coalesce(F.sum("_w").over(so_far), F.lit(0.0))
    total, weight = F.sum("source_size").over(everything), F.sum("_w").over(everything)
    level = (total * F.lit(float(budget)) - full) / (weight - after)
    leveled = ranked.withColumn("_level", level).withColumn("_top", F.max("_level").over(everything))
    return leveled.select("source", "source_size", F.least(F.col("_cap"), F.col("_top") * F.col("_w")).alias("target"))


def _boundary(hist: DataFrame, keys: list[str], bucket: str) -> DataFrame:
    """Per source the first bucket at whose end the words exceed ``_left``; ``_left`` becomes what is left for it."""
    w = Window.partitionBy("source").orderBy(bucket)
    cum = F.sum("_words").over(w)
    found = hist.withColumn("_cum", cum).filter((F.col("_cum") > F.col("_left")) & (F.col("_cum") - F.col("_words") <= F.col("_left")))
    return found.withColumn("_left", F.col("_left") - (F.col("_cum") - F.col("_words"))).select(*keys, bucket, "_left")


def mixing_plan(narrow: DataFrame, weights: tuple[float, ...] = (3, 1, 2), budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Per source: source_size, target, _base (whole repeats) and _below (one more for hashes under it).

    ``narrow``: source, size, _u; it is read several times. The threshold lies where the source's words come
    nearest to the target. Of rows with one id and text as many are taken as that needs, in 2**11 parts of them.
    """
    low = HASH_BITS + TEXT_BITS + ROW_BITS - BUCKET_BITS
    hist = narrow.groupBy("source", F.shiftright("_u", low).alias("_b1")).agg(F.sum("size").alias("_words"))
    hist = stage(hist, "mixing_histogram")
    plan = targets(hist.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, budget, cap)
    plan = plan.withColumn("_base", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = stage(plan.withColumn("_left", F.col("target") - F.col("_base") * F.col("source_size")), "mixing_targets")

    def on(*names: str, a: DataFrame, b: DataFrame) -> Column:
        out = a["source"].eqNullSafe(b["source"])
        for n in names:
            out = out & (a[n] == b[n])
        return out

    left = plan.filter(F.col("_left") > 0).select("source", "_left")
    first = _boundary(hist.join(left, on(a=hist, b=left)).select(hist["source"], "_b1", "_words", "_left"), ["source"], "_b1")
    first = stage(first, "mixing_first")
    # only the boundary bucket of each source is looked at more closely
    near = narrow.withColumn("_b1", F.shiftright("_u", low))
    near = near.join(first, on("_b1", a=near, b=first)).select(near["source"], near["_b1"], "_u", "size", "_left")
    near = stage(near.groupBy("source", "_b1", "_left", "_u").agg(F.sum("size").alias("_words")), "mixing_near")
    finer = near.groupBy("source", "_left", F.shiftright("_u", low - BUCKET_BITS).alias("_b2")).agg(F.sum("_words").alias("_words"))
    second = _boundary(finer, ["source"], "_b2")
    last = near.withColumn("_b2", F.shiftright("_u", low - BUCKET_BITS)).drop("_left")
    last = last.join(second, on("_b2", a=last, b=second)).select(last["source"], "_u", "_words", "_left")
    third = Window.partitionBy("source").orderBy("_u")
    last = last.withColumn("_cum", F.sum("_words").over(third))
    last = last.filter((F.col("_cum") > F.col("_left")) & (F.col("_cum") - F.col("_words") <= F.col("_left")))
    over, under = F.col("_cum") - F.col("_left"), F.col("_left") - (F.col("_cum") - F.col("_words"))
    last = last.select("source", F.when(over < under, F.col("_u") + 1).otherwise(F.col("_u")).alias("_below"))
    joined = plan.join(last, on(a=plan, b=last), "left")
    out = joined.select(plan["source"], "source_size", "target", "_base", F.coalesce("_below", F.lit(0)).alias("_below"))
    return stage(out, "mixing_plan")


def apply_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (source, size, _u and any others) with source_size, target, taken. Sources are few: Spark broadcasts the plan when its size allows, else joins by shuffle."""
    rows = rows.select(rest(rows, "source_size", "target", "taken"))
    plan = plan.withColumnRenamed("source", "_source")
    out = rows.join(plan, rows["source"].eqNullSafe(plan["_source"]))
    taken = F.col("size") * (F.col("_base") + (F.col("_u") < F.col("_below")).cast("long"))
    return out.withColumn("taken", taken.cast("long")).drop("_source", "_base", "_below", "_u")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """All columns of ``docs`` with size, source_size, target and taken.

    Null or empty texts have size 0 and take 0; a null source is a source of its own, last in order; without
    words at all every target is 0; an empty table gives an empty result; columns of ``docs`` named like an
    output are replaced. A document is taken 0, 1 or 2 times as a whole. Rows of one id are documents of their own; which of
    rows equal in id and text are taken depends on where they lie.
    """
    docs = docs.select(rest(docs, "size", "_u"))
    narrow = stage(sized(docs).select("source", "size", "_u"), "mixing_sizes")
    return apply_plan(sized(docs), mixing_plan(narrow, weights, budget, cap))


def mix_ids(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document, the texts being read once."""
    narrow = stage(sized(docs).select("doc_id", "source", "size", "_u"), "mixing_sizes")
    plan = mixing_plan(narrow, weights, budget, cap)
    return apply_plan(narrow, plan).select("doc_id", "size", "source_size", "target", "taken")


SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 10))::BIGINT AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w,
             row_number() OVER (ORDER BY source NULLS LAST) AS k, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
                 - coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lv FROM r),
t AS (SELECT source, source_size, least(cap, max(lv) OVER () * w) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS base FROM t),
q AS (SELECT *, target - base * source_size AS lef FROM p),
g AS (SELECT source, u, sum(size) AS words FROM d GROUP BY source, u),
c AS (SELECT source, u, words, sum(words) OVER (PARTITION BY source ORDER BY u) AS cum FROM g),
b AS (SELECT q.source, CASE WHEN c.cum - q.lef < q.lef - (c.cum - c.words) THEN c.u + 1 ELSE c.u END AS below
      FROM q JOIN c ON q.source IS NOT DISTINCT FROM c.source
      WHERE q.lef > 0 AND c.cum > q.lef AND c.cum - c.words <= q.lef)
SELECT d.doc_id, d.size, q.source_size, q.target,
       (d.size * (q.base + CASE WHEN d.u < coalesce(b.below, 0) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source
"""
