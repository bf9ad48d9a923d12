"""Flesch reading ease and Gunning fog by the published formulas.

Own definitions: a word is a run of letters; a sentence ends at a run of . ! or ?, one at least; syllables are
vowel groups of a word, without a final e after another group, one at least; three and more make a word complex.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VOWELS = "aeiouyàáâäãåæèéêëìíîïòóôöõøùúûüýÿœ"


def words(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(r"\p{L}+"), F.lit(0))


def sentences(x: Column) -> Column:
    return F.greatest(F.regexp_count(F.coalesce(x, F.lit("")), F.lit("[.!?]+")), F.lit(1)).cast("long")


def syllables(word: Column) -> Column:
    groups = F.regexp_count(word, F.lit(f"[{VOWELS}]+"))
    silent = word.rlike(f"[^{VOWELS}]e$") & (groups > 1)
    return F.greatest(groups - silent.cast("int"), F.lit(1)).cast("long")


def flesch(n_words: Column, n_sentences: Column, n_syllables: Column) -> Column:
    return 206.835 - 1.015 * (n_words / n_sentences) - 84.6 * (n_syllables / n_words)


def fog(n_words: Column, n_sentences: Column, n_complex: Column) -> Column:
    return 0.4 * (n_words / n_sentences + 100.0 * (n_complex / n_words))
