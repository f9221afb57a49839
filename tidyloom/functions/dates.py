"""Multi-format date parsing, ANSI-safe and free of Python UDFs.

A failed parse throws inside the JVM, and 18 of them per value and column also blow up the generated code.  So the
pattern list is turned into a regex that rewrites any accepted layout to ISO order, and a plain cast, which never
throws, does the rest.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Accepted layouts; where several fit, the first one wins.
DATE_PATTERNS = (
    "yyyy-MM-dd",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss'Z'",
    "MM/dd/yyyy HH:mm",
    "dd/MM/yyyy",
    "MM/dd/yyyy",
    "yyyy/MM/dd",
    "dd-MM-yyyy HH:mm:ss",
    "dd-MM-yyyy",
    "MM-dd-yyyy",
    "dd-MM, yyyy",
    "dd/MM, yyyy",
    "dd MMM yyyy",
    "MMM dd yyyy",
    "MMM d, yyyy hh:mm a",
    "MMMM dd, yyyy",
    "MMM d, yyyy",
    "MMMM d, yyyy",
)

MONTHS = (
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
)

_DAY = r"(0[1-9]|[12]\d|3[01])"
_SHORT_DAY = r"(0?[1-9]|[12]\d|3[01])"
_MONTH = r"(0[1-9]|1[0-2])"
_SHORT_MONTH = r"(0?[1-9]|1[0-2])"
# Both month-name forms capture the first three letters.
_ABBREVIATION = "(?i:(" + "|".join(m[:3] for m in MONTHS) + "))"
_FULL_NAME = "(?i:([a-z]{3})(?:" + "|".join(f"(?<={m[:3]}){m[3:]}" for m in MONTHS) + "))"

_STRICT_FIELDS = {
    "yyyy": r"(\d{4})", "MMMM": _FULL_NAME, "MMM": _ABBREVIATION, "MM": _MONTH, "dd": _DAY, "d": _SHORT_DAY,
    "HH": r"(?:[01]\d|2[0-3])", "hh": r"(?:0[1-9]|1[0-2])", "mm": r"[0-5]\d", "ss": r"[0-5]\d", "a": "(?i:[ap]m)",
}
_LENIENT_FIELDS = _STRICT_FIELDS | {
    "yyyy": r"([1-9]\d{3})", "MM": _SHORT_MONTH, "dd": _SHORT_DAY,
    "HH": r"\d{1,2}", "hh": r"\d{1,2}", "mm": r"\d{1,2}", "ss": r"\d{1,2}",
}
_OPENING = r"(?=\d{1,2}[-/]\d|\d{4}[-/]\d|\d{1,2} [A-Za-z]{3} |[A-Za-z]{3,9} \d)"
# Shortest and longest text of any layout; a length test is much cheaper than a regex.
_STRICT_LENGTHS = (10, 21)
_LENIENT_SHORTEST = 8
_ROLES = {"yyyy": 0, "MMMM": 1, "MMM": 1, "MM": 1, "dd": 2, "d": 2}


@cache
def _rewrite_rule(patterns: tuple[str, ...], lenient: bool) -> tuple[str, str]:
    """One regex for all patterns, earlier ones preferred, and the replacement that turns a match into y-m-d.

    Groups of alternatives that did not match are empty, so the replacement just strings all of a kind together.
    """
    fields = _LENIENT_FIELDS if lenient else _STRICT_FIELDS
    alternatives, groups, seen = [], ([], [], []), 0
    for pattern in patterns:
        regex = ""
        for token in re.findall(r"'[^']*'|[A-Za-z]+|[^A-Za-z']", pattern):
            regex += f"(?i:{token[1]})" if token.startswith("'") else fields.get(token) or re.escape(token)
            if token in _ROLES:
                seen += 1
                groups[_ROLES[token]].append(f"${seen}")
        alternatives.append(regex)
    ending = r"(?!\d).*\z" if lenient else r"\z"
    replacement = "-".join("".join(g) for g in groups)
    # The look-ahead turns away what opens like no date before any layout is tried.
    return f"{_OPENING}(?:{'|'.join(alternatives)}){ending}", replacement


_NAMED = tuple(p for p in DATE_PATTERNS if "MMM" in p)
_NUMERIC = tuple(p for p in DATE_PATTERNS if "MMM" not in p)


def parse_date(c: Column, lenient: bool = False) -> Column:
    """Date of a text in the first layout that fits it, else null.

    Slash dates are read day first without a time and month first with one.  ``lenient`` also accepts one-digit fields
    and any text after the date, but no years before 1000.
    """
    # A field out of range rules its layout out within the regex, so 01/25/2024 moves on to month first; a date that
    # no calendar has, such as 30/02/2024, cannot be right in the other order either.
    numeric, numeric_iso = _rewrite_rule(_NUMERIC, lenient)
    named, named_iso = _rewrite_rule(_NAMED, lenient)
    # The mark in front goes with a match; what keeps it is no date for the cast, so one regex run does.
    iso = F.regexp_replace(F.concat(F.lit("="), c), f"(?s)^={numeric}", numeric_iso)
    named = f"(?s)^{named}"
    numbered = F.lower(F.regexp_replace(c, named, named_iso))
    for number, month in enumerate(MONTHS, 1):
        numbered = F.replace(numbered, F.lit(month[:3]), F.lit(str(number)))
    parsed = F.coalesce(iso.try_cast("date"), F.when(c.rlike(named), numbered.try_cast("date")))
    length = F.length(c)
    return F.when(length >= _LENIENT_SHORTEST if lenient else length.between(*_STRICT_LENGTHS), parsed)


def to_date_column(c: Column, data_type: T.DataType, lenient: bool = False) -> Column:
    """Date of a column of any type: temporal types lose the time of day, everything else is parsed as text."""
    if isinstance(data_type, T.DateType):
        return c
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return c.cast("date")
    return parse_date(c if isinstance(data_type, T.StringType) else c.cast("string"), lenient)


def render_date(c: Column) -> Column:
    """ISO text of a date or timestamp."""
    return F.date_format(c, "yyyy-MM-dd")
