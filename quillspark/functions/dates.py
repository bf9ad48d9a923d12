"""Free-form dates, day first; parts that a text leaves out come from a fixed default, never from the clock."""

from __future__ import annotations

from datetime import datetime

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT = datetime(2024, 1, 1)


def parsed(text: str | None) -> datetime | None:
    from dateutil import parser

    try:
        found = parser.parse(text.strip(), dayfirst=True, default=DEFAULT) if text and text.strip() else None
        return found.replace(tzinfo=None) if found else None
    except (ValueError, OverflowError, TypeError):
        return None


def remembering():
    """``parsed`` for one batch, in which dates come again and again."""
    known: dict[str | None, datetime | None] = {}

    def one(text: str | None) -> datetime | None:
        if text not in known:
            known[text] = parsed(text)
        return known[text]

    return one


@F.pandas_udf(T.TimestampType())
def parse_date(text: pd.Series) -> pd.Series:
    return pd.to_datetime(text.map(remembering()), errors="coerce")


@F.pandas_udf(T.ArrayType(T.StringType()))
def parseable(found: pd.Series) -> pd.Series:
    """Of date-like strings those that can be parsed, in order."""
    parse = remembering()
    return found.map(lambda xs: [x for x in xs if parse(x)] if xs is not None else [])


@F.pandas_udf(T.ArrayType(T.TimestampType()))
def parse_dates(texts: pd.Series) -> pd.Series:
    """A date or null for each text of an array."""
    parse = remembering()
    own = lambda x: None if (d := pd.to_datetime(parse(x), errors="coerce")) is pd.NaT or d is None else d.to_pydatetime()
    return texts.map(lambda xs: [own(x) for x in xs] if xs is not None else None)


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def parseable_each(found: pd.Series) -> pd.Series:
    """``parseable`` for each array of an array."""
    parse = remembering()
    return found.map(lambda rows: [[x for x in xs if parse(x)] for xs in rows] if rows is not None else None)
