"""Text clean-up as native column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidyloom.config import NA_TOKENS

# Fixed values.
CONTROL_CHARS = r"[\x00-\x1f\x7f-\x9f]"
ENCLOSING_QUOTES = r'^"(.*)"$'
CURRENCY_CHARS = "[,₹$€£]"


def strip_control_chars(c: Column) -> Column:
    """Delete control characters; tabs and line breaks go too, without leaving a space."""
    return F.regexp_replace(c, CONTROL_CHARS, "")


def unquote(c: Column) -> Column:
    """Remove one enclosing pair of double quotes.  Only values that start with a quote pay for the regex."""
    return F.when(F.startswith(c, F.lit('"')), F.regexp_replace(c, ENCLOSING_QUOTES, "$1")).otherwise(c)


def null_tokens(c: Column, tokens: Iterable[str] = NA_TOKENS) -> Column:
    """Turn exact "no value" spellings into null."""
    return F.when(~c.isin(*tokens), c)


def collapse_whitespace(c: Column) -> Column:
    """Every run of whitespace becomes one space."""
    return F.regexp_replace(c, r"\s+", " ")


def bare_text(c: Column) -> Column:
    """First step of text cleaning: no control characters, no outer spaces."""
    return F.trim(strip_control_chars(c))


def settle_text(c: Column, tokens: Iterable[str] = NA_TOKENS) -> Column:
    """Last step: null tokens, then whitespace runs.

    Once control characters are gone the only whitespace left is the space, so only texts in which two spaces meet pay
    for the regex.
    """
    single = F.when(F.contains(c, F.lit("  ")), F.regexp_replace(c, " {2,}", " ")).otherwise(c)
    return F.when(~c.isin(*tokens), single)


def clean_text(c: Column, tokens: Iterable[str] = NA_TOKENS) -> Column:
    """Control characters, trim, quotes, null tokens and whitespace runs, in this order."""
    return settle_text(unquote(bare_text(c)), tokens)


def title_case(c: Column) -> Column:
    """Upper-case the first letter of each space-separated word, lower-case the rest."""
    return F.initcap(c)


def strip_currency(c: Column) -> Column:
    """Drop thousands separators and currency signs."""
    return F.regexp_replace(c, CURRENCY_CHARS, "")
