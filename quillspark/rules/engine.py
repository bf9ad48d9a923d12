"""Runs rules over a model: findings with rule_id, rule_name and severity, one for each document and rule."""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import structure
from quillspark.sources.staging import Staged

from .checks import RULES, Verdict, none
from .facts import gather
from .model import Config, Model

#: Rules that look at dates.
DATED = {3, 6, 7}


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, x[0], x[1]) for k, x in sorted(RULES.items())], "rule_id int, rule_name string, severity string")


def _finding(k: int, v: Verdict) -> Column:
    name, severity = RULES[k][:2]
    passed = v.passed.cast("boolean")
    lists = [(none() if x is None else F.coalesce(x.cast("array<string>"), none())).alias(n) for x, n in ((v.evidence, "evidence"), (v.locations, "locations"))]
    return F.struct(F.lit(k).alias("rule_id"), F.lit(name).alias("rule_name"), passed.alias("passed"), F.when(passed.isNull(), "info").otherwise(severity).alias("severity"), v.message.cast("string").alias("message"), *lists, F.lit(v.confidence).alias("confidence"))


def _failed(e: Exception) -> Verdict:
    return Verdict(F.lit(None), F.lit(f"The rule failed: {type(e).__name__}"))


def judge(documents: DataFrame, config: Config, rules: list[int]) -> DataFrame:
    """Findings of ``facts.gather``'s rows: all verdicts are expressions over one row, unpivoted. A rule that can't be planned gives nulls."""
    verdicts = []
    for k in rules:
        try:
            more, v = RULES[k][2](documents, config)
            finding = _finding(k, v)
            more.select(finding)  # it must resolve
            documents = more
        except Exception as e:  # a rule must not take the others down
            logging.getLogger(__name__).exception("rule %s failed", k)
            finding = _finding(k, _failed(e))
        verdicts.append(finding)
    return documents.select("doc_id", F.inline(F.array(*verdicts)))


def evaluate(m: Model, config: Config | None = None, only: list[int] | None = None) -> DataFrame:
    """Findings of all rules, or of those in ``only`` (KeyError if one is unknown), written once to the shared folder.

    Every child table of the model is read once, whatever the number of rules. Built-in rules give null for a document whose
    values can't be had, and judge its neighbours. A rule that can't be planned or run gives verdicts of null and
    leaves the others alone, be it one of many or by itself; one that nobody can judge has severity info.
    ``Staged.release`` removes the table of findings when its reader is done.
    """
    rules = sorted(RULES) if only is None else list(only)
    parts = {x for k in rules for x in RULES[k][3]}
    config, staged = config or Config(), Staged(m.docs.sparkSession, "rules")
    documents = gather(m, config, "".join(sorted(parts)), dated=bool(DATED & set(rules)), checked=9 in rules)
    try:
        return staged.put(judge(documents, config, rules), "findings")
    except Exception:
        logging.getLogger(__name__).exception("rules are run one by one")
    # some rule stops the job: gather once, judge one by one
    documents = staged.put(documents, "documents")

    def alone(k: int) -> DataFrame:
        try:
            return staged.put(judge(documents, config, [k]), f"rule_{k}")
        except Exception as e:
            return staged.put(documents.select("doc_id", F.inline(F.array(_finding(k, _failed(e))))), f"rule_{k}")

    found = [alone(k) for k in rules]
    out = Staged(m.docs.sparkSession, "rules").put(reduce(DataFrame.unionByName, found), "findings")
    staged.drop()
    return out


def with_status(findings: DataFrame, status: str = "all") -> DataFrame:
    """The findings that are shown for all, failed, passed or na (not evaluated)."""
    passed = F.col("passed")
    wanted = {"all": F.lit(True), "passed": F.coalesce(passed, F.lit(False)), "failed": F.coalesce(~passed, F.lit(False)), "na": passed.isNull()}
    return findings.filter(wanted[status])


def summary(findings: DataFrame) -> DataFrame:
    return structure.verdict_summary(findings, ["doc_id"])


def answers(findings: DataFrame) -> DataFrame:
    """Binary answers: null counts as no; evidence is the message with what was seen."""
    seen = F.filter("evidence", lambda x: F.trim(x) != "")
    return findings.select("doc_id", "rule_id", "rule_name", F.coalesce("passed", F.lit(False)).alias("passed"), F.concat_ws(" ", "message", seen).alias("evidence"), "locations", F.lit("rules").alias("method"), "confidence")
