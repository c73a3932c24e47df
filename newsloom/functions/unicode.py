"""What Spark has no built-in for: compatibility normalisation, case folding, HTML entities. Arrow batches, not rows."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _mapped(values: pd.Series, change) -> pd.Series:
    return values.map(change, na_action="ignore")


@F.pandas_udf(StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return _mapped(values, lambda t: t if t.isascii() else unicodedata.normalize("NFKC", t))


@F.pandas_udf(StringType())
def _casefold(values: pd.Series) -> pd.Series:
    return _mapped(values, str.casefold)


@F.pandas_udf(StringType())
def _unescape(values: pd.Series) -> pd.Series:
    return _mapped(values, lambda t: html.unescape(t) if "&" in t else t)


def _ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def nfkc(text: Column) -> Column:
    """Texts of ASCII stay in the JVM: to the worker they go as nulls."""
    return F.coalesce(_nfkc(F.when(~_ascii(text), text)), text)


def casefold(text: Column) -> Column:
    return F.coalesce(_casefold(F.when(~_ascii(text), text)), F.lower(text))


def unescaped(text: Column) -> Column:
    """HTML entities decoded, as browsers do (known names count without their semicolon too); only texts with an & go to the worker."""
    return F.coalesce(_unescape(F.when(F.contains(text, F.lit("&")), text)), text)
