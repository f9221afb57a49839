"""Names, noise columns, text, dates, numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue import load, register, titled
from catalogue.dirty import by_key
from tidyloom.functions.casts import to_double, to_long, to_text
from tidyloom.functions.dates import DATE_PATTERNS, parse_date
from tidyloom.functions.names import dataset_name_col, file_format_col
from tidyloom.functions.text import clean_text, title_case
from tidyloom.operators.columns import (
    dates_to_text,
    drop_empty_columns,
    drop_noise_named,
    drop_technical,
    name_mapping,
    normalize_columns,
    project_raw_columns,
    tag_rows,
)
from tidyloom.operators.profile import clean_text_columns, infer_types


def _headed_customer(spark, sf_dir):
    return load(spark, sf_dir, "customer").toDF(" C CustKey ", "C Name", "日本", "Acct. Bal (₹)", "c   name")


@register("names_clean", """
    SELECT c_custkey, c_name, c_nationkey AS col, c_acctbal AS acct_bal_, c_mktsegment AS c_name_1 FROM customer""")
def names_clean(spark, sf_dir):
    return normalize_columns(_headed_customer(spark, sf_dir))


@register("noise_columns", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def noise_columns(spark, sf_dir):
    df = load(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("Unnamed: 0"), "c_custkey", F.lit(1).alias("Index x"), "c_name",
        F.lit(None).cast("double").alias("void"), "c_mktsegment",
    )
    return drop_empty_columns(drop_noise_named(normalize_columns(df)))


@register("project_raw_columns", "SELECT c_name, c_custkey, c_acctbal AS acct_bal_ FROM customer")
def project_raw(spark, sf_dir):
    raw = tag_rows(_headed_customer(spark, sf_dir))
    cleaned = drop_technical(normalize_columns(raw))
    wanted = ["C Name", " C CustKey ", "Acct. Bal (₹)", "no longer there"]
    return project_raw_columns(cleaned, wanted, dict(name_mapping(raw.columns)))


@register("row_sequence", "SELECT count(*) AS rows, count(*) AS distinct_sequences, 0 AS missing FROM lineitem")
def row_sequence(spark, sf_dir):
    return tag_rows(load(spark, sf_dir, "lineitem")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("_raw_row_seq").alias("distinct_sequences"),
        F.count_if(F.col("_raw_row_seq").isNull()).cast("int").alias("missing"),
    )


@register("file_names", """
    SELECT doc_id,
           CASE doc_id % 4 WHEN 0 THEN 'Report ' || doc_id WHEN 1 THEN source || '.v2' WHEN 2 THEN source
                           ELSE 'api_' || doc_id END AS dataset,
           CASE doc_id % 4 WHEN 0 THEN 'csv' WHEN 1 THEN 'json' WHEN 2 THEN 'xlsx' ELSE '' END AS format
    FROM documents""")
def file_names(spark, sf_dir):
    doc, source = F.col("doc_id"), F.col("source")
    name = by_key(doc, [
        F.concat(F.lit(" Report "), doc.cast("string"), F.lit(".CSV")), F.concat(source, F.lit(".v2.json")), source,
        F.lit(None).cast("string"),
    ])
    path = F.when(doc % 4 == 2, F.concat(F.lit("/up.loads/"), source, F.lit(".XLSX")))
    return load(spark, sf_dir, "documents").select(
        "doc_id", dataset_name_col(name, doc).alias("dataset"),
        file_format_col(F.coalesce(name, F.lit("")), path).alias("format"),
    )


@register("text_clean", f"""
    SELECT c_custkey, CASE WHEN c_custkey % 7 > 0 THEN c_name || ' x' END AS name_code,
           {titled("c_mktsegment || ' o''neil mary-jane'")} AS segment FROM customer""")
def text_clean(spark, sf_dir):
    key, name = F.col("c_custkey"), F.col("c_name")
    spaced = F.concat(name, F.lit("  \t x"))
    dirty = by_key(key, [
        F.lit("nan"), F.concat(F.lit('"'), spaced, F.lit('"')), F.concat(F.lit("\x07  "), spaced, F.lit(" \n")), spaced,
        F.concat(F.lit('  "'), name, F.lit(' \x85 x"  ')), F.concat(name, F.lit(" x\x9f")), F.concat(name, F.lit("     x")),
    ])
    segment = F.concat(F.lower("c_mktsegment"), F.lit("   O'NEIL  Mary-Jane"))
    return clean_text_columns(load(spark, sf_dir, "customer").select(
        "c_custkey", dirty.alias("name_code"), segment.alias("segment")
    ))


@register("title_case", f"SELECT p_partkey, {titled('p_name')} AS name, {titled('p_type')} AS type FROM part")
def title(spark, sf_dir):
    return load(spark, sf_dir, "part").select(
        "p_partkey", title_case(F.upper("p_name")).alias("name"), title_case(F.lower("p_type")).alias("type")
    )


@register("text_control_chars", r"""
    SELECT doc_id, CASE WHEN t NOT IN ('nan', 'None', '') THEN regexp_replace(t, ' {2,}', ' ', 'g') END AS text
    FROM (SELECT doc_id, regexp_replace(trim(regexp_replace(text, '[\x{00}-\x{1f}\x{7f}-\x{9f}]', '', 'g'), ' '),
                                        '^"(.*)"$', '\1') AS t
          FROM documents)""")
def text_control_chars(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", clean_text(F.col("text")).alias("text"))


@register("date_normalize", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 18 NOT IN (5, 9) THEN strftime(o_orderdate, '%Y-%m-%d')
                            WHEN day(o_orderdate) > 12 THEN strftime(o_orderdate, '%Y-%m-%d')
                            ELSE strftime(o_orderdate, '%Y-%d-%m') END AS day,
           CASE WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%Y-%m-%d') END AS doubtful
    FROM orders""")
def date_normalize(spark, sf_dir):
    """Every layout; where day and month could be swapped, day first wins."""
    key, date = F.col("o_orderkey"), F.col("o_orderdate")
    shown = by_key(key, [F.date_format(date, p) for p in DATE_PATTERNS])
    doubtful = by_key(key, [F.lit("2024-02-30"), F.date_format(date, "yyyy-MM-dd"), F.date_format(date, "d.M.yy")])
    return load(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.date_format(parse_date(shown), "yyyy-MM-dd").alias("day"),
        F.date_format(parse_date(doubtful), "yyyy-MM-dd").alias("doubtful"),
    )


@register("date_ambiguity", """
    SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS slash, strftime(o_orderdate, '%Y-%m-%d') AS slash_time,
           strftime(o_orderdate, '%Y-%m-%d') AS dash, strftime(o_orderdate, '%Y-%m-%d') AS dash_time
    FROM orders""")
def date_ambiguity(spark, sf_dir):
    """Without a time slashes are day first, with one month first; dashes are always day first."""
    layouts = {"slash": "dd/MM/yyyy", "slash_time": "MM/dd/yyyy HH:mm", "dash": "dd-MM-yyyy",
               "dash_time": "dd-MM-yyyy HH:mm:ss"}
    return load(spark, sf_dir, "orders").select("o_orderkey", *[
        F.date_format(parse_date(F.date_format("o_orderdate", p)), "yyyy-MM-dd").alias(n) for n, p in layouts.items()
    ])


@register("date_lenient", """
    SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS lenient,
           CASE WHEN o_orderkey % 4 = 1 AND month(o_orderdate) > 9 AND day(o_orderdate) > 9
                THEN strftime(o_orderdate, '%Y-%m-%d') END AS strict
    FROM orders""")
def date_lenient(spark, sf_dir):
    layouts = ["yyyy-MM-dd HH:mm:ss.S", "d/M/yyyy", "yyyy/M/d 'at' h:mm a", "MMM d, yyyy G"]
    shown = by_key(F.col("o_orderkey"), [F.date_format("o_orderdate", p) for p in layouts])
    return load(spark, sf_dir, "orders").select(
        "o_orderkey", *[F.date_format(parse_date(shown, lenient), "yyyy-MM-dd").alias(n)
                        for n, lenient in (("lenient", True), ("strict", False))],
    )


@register("timestamp_to_date", """
    SELECT event_id, strftime(ts, '%Y-%m-%d') AS ts, strftime(ts, '%Y-%m-%d') AS ts_text FROM events""")
def timestamp_to_date(spark, sf_dir):
    df = load(spark, sf_dir, "events").select(
        "event_id", "ts", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts_text")
    )
    return dates_to_text(infer_types(df)[0])


@register("currency_cast", """
    SELECT o_orderkey, o_totalprice AS price, CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice END AS gaps FROM orders""")
def currency_cast(spark, sf_dir):
    key, amount = F.col("o_orderkey"), F.format_number("o_totalprice", 2)
    price = by_key(key, [F.concat(F.lit(sign), amount) for sign in "₹$€£"])
    return load(spark, sf_dir, "orders").select(
        "o_orderkey", to_double(price).alias("price"),
        to_double(F.when(key % 5 > 0, price).otherwise("on request")).alias("gaps"),
    )


@register("integer_cast", """
    SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS quantity, l_orderkey AS grouped,
           9007199254740993 + l_linenumber AS beyond_double, CAST(l_partkey AS VARCHAR) AS text
    FROM lineitem""")
def integer_cast(spark, sf_dir):
    large = (F.lit(9007199254740993) + F.col("l_linenumber")).cast("string")
    return load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", to_long(F.col("l_quantity").cast("string")).alias("quantity"),
        to_long(F.format_number("l_orderkey", 0)).alias("grouped"), to_long(large).alias("beyond_double"),
        to_text(F.col("l_partkey")).alias("text"),
    )
