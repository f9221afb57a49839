import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidyloom.functions.casts import to_double, to_long
from tidyloom.functions.dates import DATE_PATTERNS, MONTHS, parse_date
from tidyloom.functions.names import (
    clean_name,
    dataset_name,
    dataset_name_col,
    file_format,
    file_format_col,
    is_id_name,
    unique_names,
)
from tidyloom.functions.text import clean_text, collapse_whitespace, strip_control_chars, title_case, unquote


@pytest.mark.parametrize("raw, clean", [
    (" Order  ID ", "order_id"), ("Amount (₹)", "amount_"), ("日本", "col"), ("a b", "a_b"), ("__A__b", "_a_b"),
    ("x-y.z", "xyz"), ("", "col"), (None, "none"),
])
def test_clean_name(raw, clean):
    assert clean_name(raw) == clean


def test_unique_names_never_collide():
    assert unique_names(["a", "a"]) == ["a", "a_1"]
    assert unique_names(["a", "a", "a_1"]) == ["a", "a_1", "a_1_1"]
    assert unique_names(["a", "a_1", "a"]) == ["a", "a_1", "a_2"]


@given(st.lists(st.sampled_from(["a", "a_1", "a_1_1", "b", "A"])))
def test_unique_names_property(names):
    found = unique_names(names)
    assert len({n.lower() for n in found}) == len(names)
    assert all(f.startswith(n) for n, f in zip(names, found))


def test_id_names_are_substring_matches():
    assert all(map(is_id_name, ["id", "notes", "width", "Invoice_no", "reference"]))
    assert not any(map(is_id_name, ["amount", "city", "price"]))


FILE_NAMES = [("a.csv", None), ("a.b.JSON", None), ("plain", "/x.y/z.CSV"), ("plain", None), (".csv", None),
              ("..a.csv", None), (" spaced .csv", None), ("dot.", "q.json"), ("plain", "/x.y/z")]


def test_file_names_agree_with_columns(spark):
    df = spark.createDataFrame(FILE_NAMES, "n string, p string")
    got = df.select(dataset_name_col(F.col("n")), file_format_col(F.col("n"), F.col("p"))).collect()
    for (name, path), row in zip(FILE_NAMES, got):
        assert row[0] == dataset_name(name), name
        assert row[1] == file_format(name, path) or name == "dot."
    assert dataset_name(None, 7) == "api_7"


def _map(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r[0] for r in df.select(expression(F.col("c")).alias("x"), "i").orderBy("i").select("x").collect()]


def test_clean_text(spark):
    given = ['"a "b" c"', "a\tb", "  x   y ", "nan", "None", "", '"nan"', None, '" a "', '"', '""', "NaN", "a  b",
             "\x07 nan \x9f"]
    want = ['a "b" c', "ab", "x y", None, None, None, None, None, " a ", '"', None, "NaN", "a  b", None]
    assert _map(spark, given, clean_text) == want


def test_clean_text_is_idempotent_without_quotes(spark):
    rng = random.Random(1)
    values = ["".join(rng.choice(" ab\t\x85né'") for _ in range(rng.randint(0, 12))) for _ in range(500)]
    once = _map(spark, values, clean_text)
    assert _map(spark, once, clean_text) == once


def test_text_parts(spark):
    assert _map(spark, ["a \t\n b"], collapse_whitespace) == ["a b"]
    assert _map(spark, ["a\x00\x1f\x7f\x9fb"], strip_control_chars) == ["ab"]
    assert _map(spark, ['"a" b"', 'a"'], unquote) == ['a" b', 'a"']
    assert _map(spark, ["o'neil mary-jane", "ÉTÉ du nord"], title_case) == ["O'neil Mary-jane", "Été Du Nord"]


def test_numbers(spark):
    assert _map(spark, ["$1,234.50", "€2", "x", None, "1_000"], to_double) == [1234.5, 2.0, None, None, None]
    assert _map(spark, ["3.0", "1.0E10", "9007199254740993", "1,234", "1e30", "nan", "3.7"], to_long) == [
        3, 10**10, 9007199254740993, 1234, None, None, 3]


STRICT = {
    "2024-01-02": "2024-01-02", "2024-01-02 10:20:30": "2024-01-02", "2024-01-02T10:20:30Z": "2024-01-02",
    "01/02/2024": "2024-02-01", "01/02/2024 10:20": "2024-01-02", "01/25/2024": "2024-01-25",
    "25/01/2024": "2024-01-25", "2024/01/02": "2024-01-02", "02-01-2024": "2024-01-02", "01-25-2024": "2024-01-25",
    "02-01, 2024": "2024-01-02", "02 Jan 2024": "2024-01-02", "Jan 02 2024": "2024-01-02",
    "Jan 2, 2024": "2024-01-02", "January 2, 2024": "2024-01-02", "Jan 2, 2024 03:04 PM": "2024-01-02",
    "March 10, 2024": "2024-03-10", "junk": None, "2024-02-30": None, "25/01/2024 10:20": None, "1/2/2024": None,
    "2024-01-02 10:20:30.5": None, "2024-1-2": None, "01-02-24": None, "01/02/24": None, "2024": None,
    "2024-01-02T10:20:30.5Z": None, "31/04/2024": None, "2024-01-02 25:00:00": None,
}
LENIENT = STRICT | {
    "25/01/2024 10:20": "2024-01-25", "1/2/2024": "2024-02-01", "2024-01-02 10:20:30.5": "2024-01-02",
    "2024-1-2": "2024-01-02", "2024-01-02T10:20:30.5Z": "2024-01-02", "2024-01-02 25:00:00": "2024-01-02",
}


@pytest.mark.parametrize("table, lenient", [(STRICT, False), (LENIENT, True)])
def test_dates(spark, table, lenient):
    got = _map(spark, list(table), lambda c: parse_date(c, lenient).cast("string"))
    assert dict(zip(table, got)) == table


def _random_date_text(rng):
    text = rng.choice(DATE_PATTERNS).replace("'", "")
    if "MMM" in text:
        names = [m.title() for m in MONTHS] + [m[:3] for m in MONTHS] + ["Sept", "Foo"]
        text = text.replace("MMMM", "@").replace("MMM", "@")
        name = rng.choice(names)
    text = text.replace("yyyy", rng.choice(["2024", "1999", "0024", "24"]))
    for field, top in (("MM", 14), ("dd", 33), ("HH", 26), ("hh", 14), ("mm", 63), ("ss", 63)):
        text = text.replace(field, f"{rng.randint(0, top):02d}")
    if text.endswith(" a"):
        text = text[:-1] + rng.choice(["AM", "pm", "x"])
    text = text.replace(" d,", f" {rng.randint(0, 33)},")
    if "@" in text:
        text = text.replace("@", name)
    return text + (rng.choice([" ", "x", " 10:20", "0"]) if rng.random() < 0.1 else "")


def test_dates_equal_the_plain_chain_of_layouts(spark):
    rng = random.Random(7)
    df = spark.createDataFrame([(_random_date_text(rng),) for _ in range(4000)], "c string")
    chain = F.coalesce(*[F.try_to_date("c", p) for p in DATE_PATTERNS])
    both = df.select("c", chain.alias("chain"), parse_date(F.col("c")).alias("ours"))
    assert both.filter("NOT chain <=> ours").collect() == []
    assert both.filter("ours IS NOT NULL").count() > 1000


@settings(max_examples=20, deadline=None)
@given(st.dates(min_value=__import__("datetime").date(1600, 1, 1)))
def test_dates_read_back_what_iso_writes(spark, date):
    row = spark.range(1).select(parse_date(F.lit(date.isoformat()))).head()
    assert row[0] == date
