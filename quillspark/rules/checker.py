"""A language checker that knows misspelt words: the built-in sample for ``Config.checker``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ISSUE = "array<struct<message:string,offset:int,length:int,rule_id:string,matched:string,replacements:array<string>>>"


def word_checker(known: dict[str, list[str]], rule_id: str = "KNOWN_MISSPELLING") -> Callable[[Column], Column]:
    """Reports every word that is a key of ``known`` (lower case), in order, with its place in code points and the replacements."""
    if not known:
        return lambda text: F.array().cast(ISSUE)

    def check(text: Column) -> Column:
        table = F.create_map(*[x for k, v in sorted(known.items()) for x in (F.lit(k.lower()), F.array(*map(F.lit, v)))])
        text = F.coalesce(text, F.lit(""))
        # words and what stands between them take turns, so their lengths give the offsets
        pieces = F.arrays_zip(F.split(text, r"\p{L}+", -1).alias("gap"), F.regexp_extract_all(text, F.lit(r"\p{L}+"), F.lit(0)).alias("word"))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(ISSUE).alias("out"))

        def step(seen: Column, piece: Column) -> Column:
            word, at = F.coalesce(piece["word"], F.lit("")), seen["at"] + F.length(piece["gap"])
            better = F.try_element_at(table, F.lower(word))
            issue = F.struct(F.concat(F.lit("Possible misspelling: "), word).alias("message"), at.alias("offset"), F.length(word).alias("length"), F.lit(rule_id).alias("rule_id"), word.alias("matched"), better.alias("replacements"))
            return F.struct((at + F.length(word)).alias("at"), F.when(better.isNull(), seen["out"]).otherwise(F.concat(seen["out"], F.array(issue))).alias("out"))

        return F.aggregate(pieces, start, step)["out"]

    return check
