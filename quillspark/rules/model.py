"""Configuration and the tables that rules read."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.operators import structure

# Names that are nobody's, marking terms, label and header patterns.
DEFAULT_AUTHORS = (
    "user", "windows user", "administrator", "admin", "owner", "author", "microsoft office user", "your name", "", "python-docx",
    "python docx", "docx", "microsoft word", "word", "libreoffice", "openoffice", "apache poi", "docx4j", "unknown", "n/a",
)
CONFIDENTIALITY = ("confidential", "internal use only", "proprietary", "restricted")
DOC_ID = r"\b[A-Z]{2,}[-_/][A-Z0-9]+(?:[-_/][A-Z0-9]+)*\b"
REVISION_HEADING = r"(?i)\b(?:revision|version|change|amendment|document)\s+(?:history|control|log|record)\b|\brecord of (?:changes|amendments)\b|\bchange log\b"
DATE_HEADER = r"(?i)\bdate\b"
REVISION_HEADER = r"(?i)\b(?:rev(?:ision)?|version|ver|no\.?|change|description|author|amendment|issue)\b"
AUTHOR_HEADER = r"(?i)\b(?:author|prepared|owner|name)\b"
APPROVER_HEADER = r"(?i)\b(?:approv(?:er|ed|al)|authorized|authorised)\b"
PERSON_HEADER = r"(?i)\b(?:name|author|approver|approved\s+by|person|employee)\b"
VERSION_LABEL = r"(?i)^(?:version|revision|rev)\.?(?:\s*(?:no|number|#))?\.?$"
NAME_HEADER = r"(?i)\bname\b"
SIGNATURE_LINE = r"(?i)^\s*(?:prepared|reviewed|approved|authori[sz]ed|checked|issued|verified|released)\s+by\b|^\s*signature\b|^\s*sign(?:ed)?\s*&?\s*date\b"
SIGNATURE_WORDS = 8
SIGNING_HEADER = r"(?i)\b(?:signature|designation|title|role|date)\b"

PARAGRAPHS = (
    "block_index int, text string, location string, level int, in_table boolean, from_textbox boolean, is_list boolean, style string, t int, r int, c int, "
    "line double, before double, after double, align string, runs array<struct<name string, size double, bold boolean, chars int, bare int>>"
)
FOOTERS = "ord int, kind string, which string, location string, text string, fields array<string>"


@dataclass(frozen=True)
class Config:
    """Thresholds and lists; ``now`` is the clock for future dates (null: the session's), ``filename`` the name that titles are held against (null: each document's own)."""

    default_authors: tuple[str, ...] = DEFAULT_AUTHORS
    required_sections: tuple[str, ...] = ()
    ignore_words: tuple[str, ...] = ()
    checker: Callable[[Column], Column] | None = None
    min_words_for_language: int = 4
    readability_min_words: int = 50
    flesch_min: float = 30.0
    fog_max: float = 18.0
    doc_id_pattern: str = DOC_ID
    title_match_threshold: float = 0.85
    confidentiality_terms: tuple[str, ...] = CONFIDENTIALITY
    date_window: int = 4
    future_grace_days: int = 1
    footer_require_all: bool = False
    now: datetime | None = None
    filename: str | None = None

    @classmethod
    def from_form(cls, given: dict[str, str] | None) -> Config:
        """Text fields as a form sends them: lists are comma-separated, numbers and flags written out; blank fields are passed over."""
        known, out = {f.name: getattr(cls(), f.name) for f in fields(cls) if f.name not in ("checker", "now")}, {}
        for k, v in (given or {}).items():
            if k not in known or not v.strip():
                continue
            kind = type(known[k])
            out[k] = tuple(x.strip() for x in v.split(",") if x.strip()) if kind is tuple else v.strip().lower() in ("true", "on", "1", "yes") if kind is bool else v.strip() if kind is type(None) else kind(v)
        return replace(cls(), **out)

    @classmethod
    def from_dict(cls, given: dict | None) -> Config:
        """Unknown keys and the checker are passed over; lists become tuples."""
        known = {f.name for f in fields(cls)} - {"checker"}
        return replace(cls(), **{k: tuple(v) if isinstance(v, list) else v for k, v in (given or {}).items() if k in known})


@dataclass(frozen=True)
class Model:
    """docs (doc_id, filename, title, author, subject, keywords, modified_by); paragraphs; cells (doc_id, table_index,
    block_index of the table, row, col, text); footers (headers too, by kind). All but docs may lack a document."""

    docs: DataFrame
    paragraphs: DataFrame
    cells: DataFrame
    footers: DataFrame

    def flow(self) -> DataFrame:
        """Paragraphs with flow_pos."""
        return structure.flow_positions(self.paragraphs)

    def headings(self) -> DataFrame:
        return self.paragraphs.filter("level is not null and not in_table").filter(X.squeeze(F.col("text")) != "")


def table_name(index: Column) -> Column:
    return F.concat(F.lit("Table "), (index + 1).cast("string"))


def yes(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))
