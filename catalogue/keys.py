"""Keys, ids, order, cardinality and the table split."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue import load, register
from tidyloom.config import ROW_SEQ
from tidyloom.operators.columns import dates_to_text
from tidyloom.operators.keys import (
    add_surrogate_id,
    detect_key,
    detect_relaxed_id,
    rank_by_cardinality,
    sort_by_key,
)
from tidyloom.operators.split import split_tables


def _one(spark, name, value):
    return spark.createDataFrame([(value,)], f"{name} string")


_IS_KEY = "count({c}) = count(*) AND count(DISTINCT {c}) = count(*)"


@register("detect_key", f"""
    SELECT CASE WHEN {_IS_KEY.format(c='o_orderstatus')} THEN 'o_orderstatus'
                WHEN {_IS_KEY.format(c='o_orderdate')} THEN 'o_orderdate'
                WHEN {_IS_KEY.format(c='o_orderkey')} THEN 'o_orderkey' END AS key FROM orders""")
def strict_key(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select("o_orderstatus", "o_orderdate", "o_totalprice", "o_orderkey")
    return _one(spark, "key", detect_key(orders))


@register("detect_key_fallback", "SELECT '_raw_row_seq' AS key")
def key_fallback(spark, sf_dir):
    """Lineitem has no unique id column, so the row sequence is the key."""
    items = load(spark, sf_dir, "lineitem").withColumn(ROW_SEQ, F.monotonically_increasing_id())
    return _one(spark, "key", detect_key(items))


@register("detect_key_relaxed", """
    SELECT CASE WHEN count(a) >= count(*) * 0.95 AND count(DISTINCT a) >= count(*) * 0.9 THEN 'id_sparse'
                WHEN count(b) >= count(*) * 0.95 AND count(DISTINCT b) >= count(*) * 0.9 THEN 'id_most' END AS key
    FROM (SELECT CASE WHEN c_custkey % 10 > 0 THEN c_custkey END AS a,
                 CASE WHEN c_custkey % 25 > 0 THEN c_custkey END AS b FROM customer)""")
def relaxed_key(spark, sf_dir):
    key = F.col("c_custkey")
    return _one(spark, "key", detect_relaxed_id(load(spark, sf_dir, "customer").select(
        F.when(key % 10 > 0, key).alias("id_sparse"), F.when(key % 25 > 0, key).alias("id_most"), "c_name",
    )))


@register("surrogate_id", """
    SELECT o_totalprice, o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS auto_id FROM orders""")
def surrogate(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select("o_totalprice", "o_orderkey")
    return add_surrogate_id(orders, ["o_totalprice", "o_orderkey"])


@register("sort_by_key", "SELECT *, row_number() OVER (ORDER BY o_orderkey) AS position FROM orders")
def sort_orders(spark, sf_dir):
    """Orders, last key first, put in key order; ``position`` is where each row then stands."""
    orders = load(spark, sf_dir, "orders").orderBy(F.desc("o_orderkey"))
    place = F.monotonically_increasing_id().alias("place")
    ranked = add_surrogate_id(sort_by_key(orders, detect_key(orders)).select("*", place), ["place"], name="position")
    return ranked.drop("place")


_COLUMNS = ("p_name", "p_brand", "p_type", "label", "constant")
_CARDINALITY = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {i} AS position, count(DISTINCT {c}) AS n FROM p" for i, c in enumerate(_COLUMNS)
)


@register("cardinality_rank", f"""
    WITH p AS (SELECT p_name, p_brand, p_type, 'part ' || p_partkey AS label, 'x' AS constant FROM part)
    SELECT "column", n AS distinct_values, CAST(row_number() OVER (ORDER BY n, position) AS INTEGER) AS rank
    FROM ({_CARDINALITY}) QUALIFY row_number() OVER (ORDER BY n, position) <= 3""")
def cardinality(spark, sf_dir):
    part = load(spark, sf_dir, "part").select(
        "p_name", "p_brand", "p_type", F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("label"),
        F.lit("x").alias("constant"), "p_size",
    )
    ranked = rank_by_cardinality(part)
    return spark.createDataFrame(
        [(c, n, i) for i, (c, n) in enumerate(ranked, 1)], "column string, distinct_values bigint, rank int"
    )


def _orders_with_texts(spark, sf_dir):
    key = F.col("o_orderkey")
    return load(spark, sf_dir, "orders").withColumns({
        "clerk": F.concat(F.lit("clerk "), (key % 90).cast("string")),
        "comment": F.concat(F.lit("comment "), key.cast("string")),
        "ship_time": F.concat((key % 24).cast("string"), F.lit(":00")),
    })


_CLERK, _COMMENT = "'clerk ' || o_orderkey % 90 AS clerk", "'comment ' || o_orderkey AS comment"
_TIME = "o_orderkey % 24 || ':00' AS ship_time"


@register("split_entity", f"SELECT o_orderkey, o_orderstatus, o_orderpriority, {_TIME} FROM orders")
def split_entity(spark, sf_dir):
    return split_tables(_orders_with_texts(spark, sf_dir)).entity


@register("split_metrics", f"""
    SELECT o_orderkey, o_custkey, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, {_TIME}
    FROM orders""")
def split_metrics(spark, sf_dir):
    return dates_to_text(split_tables(_orders_with_texts(spark, sf_dir)).metrics)


@register("split_dimension", f"SELECT o_orderkey, {_CLERK}, {_COMMENT} FROM orders")
def split_dimension(spark, sf_dir):
    return split_tables(_orders_with_texts(spark, sf_dir)).dimension


@register("split_surrogate", """
    SELECT row_number() OVER (ORDER BY event_id) AS auto_id, event_type AS kind, props, 'src' || event_id % 3 AS origin,
           user_id AS person, value AS amount
    FROM events""")
def split_surrogate(spark, sf_dir):
    """Without any id column, the tables share one generated id, so joining them gives the table back."""
    events = load(spark, sf_dir, "events").select(
        F.col("event_id").alias(ROW_SEQ), F.col("event_type").alias("kind"), "props",
        F.concat(F.lit("src"), (F.col("event_id") % 3).cast("string")).alias("origin"),
        F.col("user_id").alias("person"), F.col("value").alias("amount"),
    )
    split = split_tables(events)
    return split.entity.join(split.metrics, split.id_column)
