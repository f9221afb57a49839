"""Deterministic dirt, by key, and the SQL of what a cleaner should make of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogue import load, titled
from tidyloom.config import ROW_SEQ

UPLOAD_DATE_FORMATS = (
    "yyyy-MM-dd", "dd/MM/yyyy", "yyyy/MM/dd", "dd-MM-yyyy", "dd MMM yyyy", "MMM d, yyyy", "MMMM dd, yyyy",
)


def by_key(key: Column, values: list[Column]) -> Column:
    """The value whose position is the key modulo their number."""
    chosen = F.when(key % len(values) == 0, values[0])
    for i, value in enumerate(values[1:], 1):
        chosen = chosen.when(key % len(values) == i, value)
    return chosen


def messy_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a careless upload: own headers, all text, mixed date layouts, gaps, noise columns, repeated rows."""
    orders = load(spark, sf_dir, "orders")
    copies = orders.filter(F.col("o_orderkey") % 4 == 0)
    source = orders.withColumn("copy", F.lit(0)).union(copies.withColumn("copy", F.lit(1)))
    key, date = F.col("o_orderkey"), F.col("o_orderdate")
    dates = [F.date_format(date, f) for f in UPLOAD_DATE_FORMATS] + [F.lit("not known yet")]
    return source.select(
        (key * 2 + F.col("copy")).alias(ROW_SEQ),
        key.alias("Unnamed: 0"),
        F.format_number(key, 0).alias(" Order  Key "),
        F.concat(F.lit('"'), F.lower("o_orderstatus"), F.lit('"\t')).alias("Order-Status"),
        F.when(key % 5 > 0, F.concat(F.lit("$"), F.format_number("o_totalprice", 2))).otherwise("nan")
        .alias("Total Price (₹)"),
        by_key(key, dates).alias("Purchase Date"),
        F.concat(F.lit("  "), F.regexp_replace(F.upper("o_orderpriority"), " ", "   "), F.lit("\r\n")).alias("priority"),
        F.when(key % 10 != 3, F.concat(F.col("o_custkey").cast("string"), F.lit(".0"))).alias("Cust. No"),
        F.when(key % 3 == 0, F.lit("SEEN twice")).otherwise("None").alias("Remark"),
        F.when(key % 4 > 0, F.concat(F.lit("segment "), (key % 7).cast("string"))).alias("remark"),
        F.lit(None).cast("string").alias("Blank"),
    )


UPLOAD_ROWS = "(SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 4 = 0)"

_UPLOAD_MEDIAN = f"(SELECT quantile_disc(o_totalprice, 0.5) FROM {UPLOAD_ROWS} WHERE o_orderkey % 5 > 0)"

# What each cleaned column of the upload holds, before and after gaps are filled.
UPLOAD_TYPED = {
    "order_key": "o_orderkey",
    "orderstatus": "upper(o_orderstatus)",
    "total_price_": "CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice END",
    "purchase_date": "CASE WHEN o_orderkey % 8 < 7 THEN CAST(o_orderdate AS DATE) END",
    "priority": titled("o_orderpriority"),
    "cust_no": "CASE WHEN o_orderkey % 10 <> 3 THEN o_custkey END",
    "remark": "CASE WHEN o_orderkey % 3 = 0 THEN 'Seen Twice' END",
    "remark_1": "CASE WHEN o_orderkey % 4 > 0 THEN 'Segment ' || CAST(o_orderkey % 7 AS VARCHAR) END",
}

UPLOAD_FILLED = UPLOAD_TYPED | {
    "total_price_": f"CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice ELSE {_UPLOAD_MEDIAN} END",
    "purchase_date": "CASE WHEN o_orderkey % 8 < 7 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'Unknown' END",
    "remark": "CASE WHEN o_orderkey % 3 = 0 THEN 'Seen Twice' ELSE 'NaN' END",
    "remark_1": "CASE WHEN o_orderkey % 4 > 0 THEN 'Segment ' || CAST(o_orderkey % 7 AS VARCHAR) ELSE 'Unknown' END",
}


def select_upload(columns: dict[str, str], source: str = "orders") -> str:
    return f"SELECT {', '.join(f'{sql} AS {name}' for name, sql in columns.items())} FROM {source}"
