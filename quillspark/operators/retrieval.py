"""Retrieval: embeddings of chunks, contexts for rule questions, verdicts of a judge.

Embedder and judge are functions from Column to Column, so a model runs as a pandas UDF; the default embedder
hashes words and needs no model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.rules.engine import answers, rule_table
from quillspark.rules.engine import evaluate as evaluate_rules
from quillspark.rules.model import Config, Model, yes

from . import search

DIMENSION = 384
TOP = 5
NOTHING = "No passage of the document bears on this question."
QUESTIONS = {
    1: "Which title does the document give, and does the file name agree with it?",
    2: "Who wrote the document, and in which role?",
    3: "Which dates does the revision history list, and are they in order and not in the future?",
    4: "Which version number does the document state?",
    5: "Is there a revision history with entries?",
    6: "Is there a block for the signatures of those who prepared, reviewed or approved it?",
    7: "Does each signature carry a date?",
    8: "Is the body text formatted alike throughout?",
    9: "Are spelling and grammar correct?",
    10: "Which sections does the document have?",
    11: "Do the footers number the pages by a field?",
    12: "Is the text easy enough to read?",
    13: "Do the footers show a document number, a confidentiality mark and a page number?",
}


def hashed_embedding(text: Column, dimension: int = DIMENSION) -> Column:
    """Unit vector of signed counts of hashed words; null for a text without words, or whose counts cancel out."""

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for codes in batches:
            own = [c if c is not None else () for c in codes]
            row = np.repeat(np.arange(len(own)), [len(c) for c in own])
            flat = np.concatenate([np.zeros(0, np.int64), *(np.asarray(c, np.int64) for c in own)])
            v = np.zeros((len(own), dimension))
            np.add.at(v, (row, (flat >> 1) % dimension), np.where(flat & 1, 1.0, -1.0))
            norm = np.sqrt((v * v).sum(1))
            v /= np.where(norm > 0, norm, 1.0)[:, None]
            yield pd.Series([x if n else None for x, n in zip(v, norm, strict=True)], index=codes.index, dtype=object)

    words = F.filter(F.split(F.lower(X.squeeze(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return embed(F.transform(words, lambda w: F.crc32(w.cast("binary"))))


def questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(QUESTIONS.items()), "rule_id int, question string")


def context(hits: DataFrame, keys: list[str]) -> DataFrame:
    """One text per key: numbered passages with score, source, section and places, best first."""
    section = F.coalesce(F.nullif(F.array_join("section_path", " > "), F.lit("")), F.lit("body"))
    places = F.coalesce(F.nullif(F.array_join("locations", ", "), F.lit("")), F.lit("unknown location"))
    one = F.format_string("[%d] score %.3f; source %s; section %s; %s\n%s", F.col("rank").cast("int"), "score", "source", section, places, "text")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", one.alias("x")))), lambda s: s["x"])
    return hits.groupBy(*keys).agg(F.array_join(listed, "\n\n").alias("context"))


def prompt(question: Column, text: Column) -> Column:
    rules = "Judge by the passages alone. Reply with one JSON object: passed (true or false), evidence (text), locations (list of texts)."
    return F.concat(F.lit(rules + "\n\nQuestion: "), question, F.lit("\n\n"), F.coalesce(text, F.lit(NOTHING)))


def parse_reply(reply: Column) -> Column:
    """The judge's struct; null unless the reply is one JSON object whose passed is a boolean, evidence a text that isn't blank and locations, if given, a list of texts.

    Types are those of the parsed value, so nested, quoted or escaped keys don't count; an object with a repeated key can't be read.
    """
    v = F.try_parse_json(F.regexp_replace(F.trim(reply), r"(?s)^```[^\n]*\n|\s*```$", ""))
    part = lambda name: F.try_variant_get(v, f"$.{name}", "variant")
    kind = lambda name: F.schema_of_variant(part(name))
    evidence = F.trim(F.try_variant_get(v, "$.evidence", "string"))
    listed = F.coalesce(kind("locations").isin("ARRAY<STRING>", "ARRAY<VOID>") & ~yes(F.exists(F.try_variant_get(v, "$.locations", "array<string>"), lambda x: x.isNull())), F.lit(True))
    good = (kind("passed") == "BOOLEAN") & (kind("evidence") == "STRING") & (evidence != "") & listed
    return F.when(good, F.struct(F.try_variant_get(v, "$.passed", "boolean").alias("passed"), evidence.alias("evidence"), F.coalesce(F.try_variant_get(v, "$.locations", "array<string>"), F.array().cast("array<string>")).alias("locations")))


def ask(rows: DataFrame, judge: Callable[[Column], Column], cache: str | None = None) -> DataFrame:
    """``rows`` (with prompt) and reply. With a ``cache`` folder each prompt is asked once, whoever asks it and however often: replies are kept there under the prompt's hash."""
    if cache is None:
        return rows.withColumn("reply", judge(F.col("prompt")))
    spark, rows = rows.sparkSession, rows.withColumn("_key", F.sha2("prompt", 256))
    at = spark._jvm.org.apache.hadoop.fs.Path(cache)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    known = (lambda: spark.read.schema("key string, reply string").parquet(cache)) if there else (lambda: spark.createDataFrame([], "key string, reply string"))
    fresh = rows.select("_key", "prompt").distinct().join(known().select("key"), F.col("_key") == F.col("key"), "left_anti")
    fresh.select(F.col("_key").alias("key"), judge(F.col("prompt")).alias("reply")).write.mode("append").parquet(cache)
    replies = spark.read.schema("key string, reply string").parquet(cache).groupBy("key").agg(F.min("reply").alias("reply"))  # two runs at once may have asked the same
    return rows.join(replies, F.col("_key") == F.col("key"), "left").drop("_key", "key")


def retrieve(chunks: DataFrame, asked: DataFrame, k: int = TOP, where: Column | None = None) -> DataFrame:
    """The k nearest chunks of every document to each question (chunks: doc_id, seq, embedding and what context needs).

    ``asked`` has rule_id and embedding, any number of rows; a question without a vector is an error. ``where``
    filters chunks by their metadata (``same_source``, ``same_section``). Blocks of chunks are scored against blocks of
    questions by one product; documents are the search's groups.
    """
    if not asked.filter("embedding is null").isEmpty():
        raise ValueError("a question without words has no vector")
    kept = chunks if where is None else chunks.filter(where)
    store = kept.select(F.col("seq").alias("id"), F.col("seq").alias("ins_ord"), "embedding", F.col("doc_id").alias("grp"))
    found = search.top_k_groups(store, asked.select(F.col("rule_id").alias("query_id"), F.col("embedding").alias("query")), k)
    found = found.select(F.col("grp").alias("doc_id"), F.col("id").alias("seq"), F.col("query_id").alias("rule_id"), "score", "rank")
    return kept.drop("embedding").join(found, ["doc_id", "seq"])


def same_source(source: str) -> Column:
    return F.col("source") == source


def same_section(path: list[str]) -> Column:
    """Chunks of exactly this section path."""
    return F.col("section_path") == F.array(*map(F.lit, path)).cast("array<string>")


def judge_rules(chunks: DataFrame, judge: Callable[[Column], Column], embed: Callable[[Column], Column] = hashed_embedding, k: int = TOP, where: Column | None = None, cache: str | None = None) -> DataFrame:
    """doc_id, rule_id, rule_name, severity, passed, evidence, locations, method, code: a judge's answer for each document and rule.

    A reply that can't be read leaves passed null and has code 503; code is 200 else. Documents without chunks have
    no rows here: ``unreadable`` gives them code 422. ``cache``: see ``ask``.
    """
    spark = chunks.sparkSession
    asked = questions(spark)
    hits = retrieve(chunks.withColumn("embedding", embed(F.col("text"))), asked.withColumn("embedding", embed(F.col("question"))).drop("question"), k, where)
    every = chunks.select("doc_id").distinct().join(F.broadcast(asked), F.lit(True)).join(context(hits, ["doc_id", "rule_id"]), ["doc_id", "rule_id"], "left")
    answered = ask(every.withColumn("prompt", prompt(F.col("question"), F.col("context"))), judge, cache).withColumn("a", parse_reply(F.col("reply"))).drop("prompt", "reply")
    named = answered.join(F.broadcast(rule_table(spark)), "rule_id", "left")
    code = F.when(F.col("a.passed").isNull(), 503).otherwise(200)
    return named.select("doc_id", "rule_id", "rule_name", F.coalesce("severity", F.lit("warning")).alias("severity"), "a.passed", "a.evidence", "a.locations", F.lit("retrieval").alias("method"), code.alias("code"))


def unreadable(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id, code, detail of documents that have no chunk to be judged by."""
    return docs.select("doc_id").join(chunks.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", F.lit(422).alias("code"), F.lit("the document has no text").alias("detail"))


def evaluate(mode: str, m: Model, chunks: DataFrame | None = None, judge: Callable[[Column], Column] | None = None, config: Config | None = None) -> DataFrame:
    """Answers (doc_id, rule_id, rule_name, passed, evidence, locations, method) by "rules" or by "retrieval"."""
    columns = ["doc_id", "rule_id", "rule_name", "passed", "evidence", "locations", "method"]
    if mode == "rules":
        return answers(evaluate_rules(m, config)).select(*columns)
    if mode != "retrieval" or chunks is None or judge is None:
        raise ValueError("the mode is rules, or retrieval with chunks and a judge")
    return judge_rules(chunks, judge).select(*columns)
