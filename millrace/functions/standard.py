"""Standardisation of dates and country names, as column expressions."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The accepted date formats, in order of preference.
DATE_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy")
# Country names in upper case and their two-letter codes.
COUNTRY_CODES = {
    "USA": "US", "UNITED STATES": "US", "U.S.": "US",
    "UK": "GB", "UNITED KINGDOM": "GB", "BRITAIN": "GB",
    "GER": "DE", "GERMANY": "DE",
    "FRA": "FR", "FRANCE": "FR",
    "JPN": "JP", "JAPAN": "JP",
    "KOR": "KR", "KOREA": "KR",
    "IND": "IN", "INDIA": "IN",
}


def _shape(fmt: str) -> str:
    """A pattern of the texts a format can fit, letter for letter: digits and signs."""
    return "^" + "".join("[0-9]" if ch.isalpha() else re.escape(ch) for ch in fmt) + "$"


def parsed_date(c: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """The first format that a text fits; null if none does.

    A text is parsed only under formats of its own shape: a failed parse costs an
    exception, tens of times the price of the test.
    """
    return F.coalesce(*[F.when(c.rlike(_shape(f)), F.try_to_timestamp(c, F.lit(f))) for f in formats])


def standardize_dates(df: DataFrame, cols: Sequence[str], formats: Sequence[str] = DATE_FORMATS) -> DataFrame:
    """``df`` with ``cols`` as timestamps; columns that do not exist are ignored, those that are no text are cast."""
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return df.withColumns({c: parsed_date(F.col(c), formats) if c in text else F.col(c).cast("timestamp") for c in cols if c in df.columns})


def country_code(c: Column, codes: Mapping[str, str] = COUNTRY_CODES) -> Column:
    """Upper case, known names as their code, others as they are; null stays null."""
    up = F.upper(c)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in codes.items() for x in kv]), up), up)


def standardize_country_codes(df: DataFrame, col: str, codes: Mapping[str, str] = COUNTRY_CODES) -> DataFrame:
    return df.withColumn(col, country_code(F.col(col), codes)) if col in df.columns else df
