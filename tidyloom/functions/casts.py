"""Casts that yield null instead of failing, under ANSI rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidyloom.functions.text import strip_currency

# Fixed value: texts that count as a number once separators and currency signs are gone.
NUMBER_GRAMMAR = r"^([+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?|(?i:[+-]?(inf|infinity|nan)))$"
DIGITS_ONLY = r"^\s*[+-]?[0-9]+\s*$"
_NUMBER_OPENINGS = "+-.0123456789iInN,₹$€£ "


def number_candidate(c: Column) -> Column:
    """The text without separators and currency signs if it opens like a number, else null.

    Looking at one character spares plain words both regexes.
    """
    return F.when(F.contains(F.lit(_NUMBER_OPENINGS), F.substring(c, 1, 1)), strip_currency(c))


def is_number_text(candidate: Column) -> Column:
    return F.coalesce(F.trim(candidate).rlike(NUMBER_GRAMMAR), F.lit(False))


def is_integral(x: Column) -> Column:
    """Whole and finite: the remainder of an infinity or NaN is NaN, which equals nothing here."""
    return F.coalesce(x % 1 == 0, F.lit(False))


def to_long(c: Column, data_type: T.DataType = T.StringType()) -> Column:
    """Whole number of a text such as ``$1,234.0``; exact up to the whole bigint range."""
    if isinstance(data_type, T.NumericType):
        return c.try_cast("bigint")
    text = strip_currency(c.cast("string"))
    # A failing cast to bigint throws inside and costs far more than this test.
    return F.when(text.rlike(DIGITS_ONLY), text.try_cast("bigint")).otherwise(
        text.try_cast("double").try_cast("bigint")
    )


def to_double(c: Column, data_type: T.DataType = T.StringType()) -> Column:
    """Number of a text such as ``€1,234.50``."""
    if isinstance(data_type, T.NumericType):
        return c.cast("double")
    return strip_currency(c.cast("string")).try_cast("double")


def to_text(c: Column) -> Column:
    return c.cast("string")
