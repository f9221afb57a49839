"""JSON payloads and nested columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue import load, register
from catalogue.dirty import by_key
from tidyloom.config import ROW_SEQ
from tidyloom.operators.keys import add_surrogate_id, detect_relaxed_id
from tidyloom.operators.nested import (
    array_growth, explode_arrays, flatten_json, flatten_structs, invalid_payloads, json_growth,
)

_EVENT = "event_id, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS props_k"


def _record(*fields):
    return F.to_json(F.struct(*fields))


def _event_record():
    return _record("event_id", "value", F.from_json("props", "k bigint").alias("props"))


@register("json_records", f"SELECT {_EVENT} FROM events")
def json_records(spark, sf_dir):
    """Records as a list, below one of the known keys, or alone; all in one column."""
    record = _event_record()
    envelopes = [("[", "]")] + [
        (f'{{"count": 1, "{key}": [', "]}") for key in ("data", "results", "items", "rows", "records", "response")
    ] + [("", "")]
    payload = by_key(F.col("event_id"), [F.concat(F.lit(a), record, F.lit(b)) for a, b in envelopes])
    return flatten_json(load(spark, sf_dir, "events").select(payload.alias("response")), "response")


@register("json_key_preference", f"SELECT {_EVENT} FROM events")
def json_key_preference(spark, sf_dir):
    """The first key that holds a list wins, whatever stands under the others."""
    payload = F.concat(F.lit('{"data": {"x": 1}, "rows": ['), _event_record(), F.lit('], "records": [{"z": 9}]}'))
    return flatten_json(load(spark, sf_dir, "events").select(payload.alias("response")), "response")


@register("json_flatten", """
    SELECT event_id AS id, user_id, event_type AS user_kind_type, strftime(ts, '%Y-%m-%d') AS user_kind_at_day,
           CASE WHEN event_id % 5 > 0 THEN value END AS big_value
    FROM events""")
def json_flatten(spark, sf_dir):
    kind = F.struct(F.col("event_type").alias("type"),
                    F.struct(F.date_format("ts", "yyyy-MM-dd").alias("day")).alias("at"))
    record = _record(F.col("event_id").alias("id"), F.struct(F.col("user_id").alias("id"), kind.alias("kind"))
                     .alias("user"), F.when(F.col("event_id") % 5 > 0, F.col("value")).alias("Big  Value"))
    return flatten_json(load(spark, sf_dir, "events").select(record.alias("doc")), "doc", document_order=False)


@register("json_explode", """
    WITH e AS (SELECT event_id, event_type, user_id, value FROM events),
         tags AS (SELECT event_id, unnest(CASE WHEN event_id % 3 = 0 THEN [NULL] ELSE [event_type, 'all'] END) AS tags
                  FROM e),
         lines AS (SELECT event_id, unnest([{'k': user_id, 'h': value}, {'k': user_id + 1, 'h': NULL}]) AS ln FROM e)
    SELECT e.event_id, tags.tags, lines.ln.k AS ln_k, lines.ln.h AS ln_g_h
    FROM e JOIN tags USING (event_id) JOIN lines USING (event_id)""")
def json_explode(spark, sf_dir):
    """Sibling lists give all combinations, an empty one a null; objects inside spread into columns."""
    event = F.col("event_id")
    tags = F.when(event % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("event_type", F.lit("all")))
    with_g = F.struct(F.col("user_id").alias("k"), F.struct(F.col("value").alias("h")).alias("g"))
    without = F.struct((F.col("user_id") + 1).alias("k"), F.lit(None).cast("struct<h: double>").alias("g"))
    record = _record(event, tags.alias("tags"), F.array(with_g, without).alias("ln"))
    payload = F.concat(F.lit('{"items": ['), record, F.lit("]}"))
    return flatten_json(load(spark, sf_dir, "events").select(payload.alias("doc")), "doc")


@register("json_value_wrap", """
    SELECT unnest([event_id, user_id, event_id + user_id]) AS value FROM events""")
def json_value_wrap(spark, sf_dir):
    """Scalars, in a list or alone, become the column ``value``; broken payloads and empty lists give nothing."""
    event, user = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    both = (F.col("event_id") + F.col("user_id")).cast("string")
    payloads = F.explode(F.array(
        F.concat(F.lit("["), event, F.lit(", "), user, F.lit("]")), both, F.lit("[]"), F.lit('{"items": []}'),
        F.concat(F.lit("{broken "), event), F.lit(None).cast("string"),
    ))
    return flatten_json(load(spark, sf_dir, "events").select(payloads.alias("doc")), "doc")


@register("json_rejects", """
    SELECT event_id, '{"id": ' || event_id AS response FROM events WHERE event_id % 3 = 1""")
def json_rejects(spark, sf_dir):
    event = F.col("event_id")
    text = F.concat(F.lit('{"id": '), event.cast("string"))
    payload = by_key(event, [F.concat(text, F.lit("}")), text, F.lit(None).cast("string")])
    return invalid_payloads(load(spark, sf_dir, "events").select(event, payload.alias("response")), "response")


@register("json_lenient", """
    SELECT event_id, event_id % 3 = 1 AS value_is_nan, CASE WHEN event_id % 3 <> 1 THEN value END AS value FROM events""")
def json_lenient(spark, sf_dir):
    """A repeated key, whose last value counts, and a number that is none."""
    event, value = F.col("event_id").cast("string"), F.col("value").cast("string")
    doc = by_key(F.col("event_id"), [
        F.format_string('[{"event_id": -1, "value": 0, "event_id": %s, "value": %s}]', event, value),
        F.format_string('{"event_id": %s, "value": NaN}', event),
        F.format_string('{"event_id": %s, "value": %s}', event, value),
    ])
    flat = flatten_json(load(spark, sf_dir, "events").select(doc.alias("doc")), "doc")
    return flat.select("event_id", F.isnan("value").alias("value_is_nan"),
                       F.when(~F.isnan("value"), F.col("value")).alias("value"))


@register("json_row_order", """
    SELECT (event_id - event_id % 2) AS doc, event_id, row_number() OVER (ORDER BY event_id) AS position FROM events
    WHERE event_id % 2 = 0 OR event_id - 1 IN (SELECT event_id FROM events)""")
def json_row_order(spark, sf_dir):
    """The row sequence follows the documents and the records in them."""
    events = load(spark, sf_dir, "events").select("event_id")
    first = events.filter("event_id % 2 = 0")
    second = events.filter("event_id % 2 = 1").select((F.col("event_id") - 1).alias("event_id"), F.lit(True).alias("two"))
    event, record = F.col("event_id").cast("string"), '{"event_id": %s}'
    doc = F.when(F.col("two"), F.format_string(f"[{record}, {record}]", event, (F.col("event_id") + 1).cast("string"))) \
        .otherwise(F.format_string(f"[{record}]", event))
    documents = first.join(second, "event_id", "left").orderBy("event_id").select(F.col("event_id").alias("doc"), doc.alias("t"))
    flat = flatten_json(documents, "t", keep=["doc"], tag=True)
    return add_surrogate_id(flat, [ROW_SEQ], name="position").drop(ROW_SEQ)


@register("json_key_order", """
    SELECT 'zeta_id' AS relaxed_id, [1, 8] [i] AS pieces, name, CAST(position AS INTEGER) AS position
    FROM (SELECT unnest(['zeta_id', 'mid_y', 'mid_b_q', 'mid_b_p', 'alpha_id']) AS name,
                 unnest([0, 1, 2, 3, 4]) AS position), (SELECT unnest([1, 2]) AS i)""")
def json_key_order(spark, sf_dir):
    """Columns, and with them the id, follow the documents at every level, however many pieces they come in."""
    event = F.col("event_id")
    inner = F.struct(event.alias("y"), F.struct(F.col("value").alias("q"), F.col("user_id").alias("p")).alias("b"))
    docs = load(spark, sf_dir, "events").select(
        _record(event.alias("zeta_id"), inner.alias("mid"), event.alias("alpha_id")).alias("doc"))
    found = []
    for pieces, cut in ((1, docs.coalesce(1)), (8, docs.repartition(8))):
        flat = flatten_json(cut, "doc")
        relaxed = detect_relaxed_id(flat)
        found += [(relaxed, pieces, name, i) for i, name in enumerate(flat.columns)]
    return spark.createDataFrame(found, "relaxed_id string, pieces int, name string, position int")


@register("json_mixed", """
    SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 3 THEN NULL
                                       ELSE unnest(CASE event_id % 4 WHEN 1 THEN [event_type, 'x'] ELSE [NULL] END)
                     END AS v,
           CASE event_id % 4 WHEN 2 THEN value END AS v_amount
    FROM (SELECT * FROM events WHERE event_id % 4 IN (1, 2)
          UNION ALL SELECT * FROM events WHERE event_id % 4 NOT IN (1, 2))""")
def json_mixed(spark, sf_dir):
    """One field that is a number, a list, an object or missing, depending on the record."""
    event = F.col("event_id").cast("string")
    start = F.concat(F.lit('{"event_id": '), event)
    field = F.lit(', "v": ')
    doc = by_key(F.col("event_id"), [
        F.concat(start, field, F.col("user_id").cast("string"), F.lit("}")),
        F.concat(start, field, F.to_json(F.array("event_type", F.lit("x"))), F.lit("}")),
        F.concat(start, field, _record(F.col("value").alias("amount")), F.lit("}")),
        F.concat(start, F.lit("}")),
    ])
    return flatten_json(load(spark, sf_dir, "events").select(doc.alias("doc")), "doc")


@register("json_maps", """
    SELECT o_custkey AS customer, CAST(o_orderkey AS VARCHAR) AS orders_key, o_orderstatus AS orders_value_status,
           CAST(o_totalprice AS DOUBLE) AS orders_value_price, l.l_linenumber AS orders_value_lines_key,
           l.l_partkey AS orders_value_lines_value
    FROM orders LEFT JOIN (SELECT l_orderkey, 'line ' || l_linenumber AS l_linenumber, max(l_partkey) AS l_partkey
                           FROM lineitem GROUP BY ALL) l ON l_orderkey = o_orderkey""")
def json_maps(spark, sf_dir):
    """Customers with an object of their orders by key, each with an object of its lines: keys that are data become rows."""
    line = F.concat(F.lit("line "), F.col("l_linenumber").cast("string"))
    lines = load(spark, sf_dir, "lineitem").groupBy("l_orderkey", line.alias("k")).agg(F.max("l_partkey").alias("part"))
    lines = lines.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("k", "part"))).alias("lines"))
    orders = load(spark, sf_dir, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    order = F.struct(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), "lines")
    by_key_ = F.map_from_entries(F.collect_list(F.struct(F.col("o_orderkey").cast("string"), order)))
    docs = orders.groupBy("o_custkey").agg(by_key_.alias("orders"))
    return flatten_json(docs.select(_record(F.col("o_custkey").alias("customer"), "orders").alias("doc")), "doc", map_width=6)


@register("array_explode", "SELECT vec_id, unnest(embedding) AS embedding, label FROM embeddings")
def array_explode(spark, sf_dir):
    return explode_arrays(load(spark, sf_dir, "embeddings"))


def _bulky_orders(spark, sf_dir):
    """Orders by customer with three sibling lists, one of them of objects that hold lists; one customer has long ones."""
    orders = load(spark, sf_dir, "orders")
    lists = orders.groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("keys"))
    bulky = F.when(F.col("o_custkey") == 1, F.sequence(F.lit(1), F.lit(300))).otherwise(F.slice("keys", 1, 2).cast("array<int>"))
    return lists.select("o_custkey", "keys", bulky.alias("more"), F.transform(F.slice("keys", 1, 3), lambda k: F.struct(
        k.alias("key"), F.slice("keys", 2, 2).alias("tags"))).alias("parts"))


_GROWTH = """
    SELECT o_custkey, n * CASE WHEN o_custkey = 1 THEN 300 ELSE least(n, 2) END
                      * (least(n, 3) * greatest(least(n - 1, 2), 1)) AS rows
    FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)"""


@register("array_growth", _GROWTH)
def array_growths(spark, sf_dir):
    """The row growth of sibling lists, told before they are exploded."""
    bulky = _bulky_orders(spark, sf_dir)
    return bulky.select("o_custkey", array_growth(bulky).alias("rows"))


@register("json_growth", _GROWTH)
def json_growths(spark, sf_dir):
    """The same of JSON records, some of which hold a bare value in place of a list of one."""
    bulky = _bulky_orders(spark, sf_dir)
    one = F.when(F.size("keys") == 1, F.to_json(F.struct(F.col("keys")[0].alias("keys"), "more", "parts"))).otherwise(
        F.to_json(F.struct("keys", "more", "parts")))
    return json_growth(bulky.select("o_custkey", one.alias("response")), "response", ["o_custkey"]).drop("record")


@register("array_explode_heavy", _GROWTH)
def array_explode_heavy(spark, sf_dir):
    """Records of many combinations, dealt over the cluster while they are exploded: as many rows as were told."""
    flat = explode_arrays(_bulky_orders(spark, sf_dir), heavy=100)
    return flat.groupBy("o_custkey").agg(F.count("*").alias("rows"))


@register("struct_flatten", """
    SELECT l_orderkey AS line_order, l_partkey AS line_part_key, l_quantity AS line_part_quantity, l_shipdate
    FROM lineitem""")
def struct_flatten(spark, sf_dir):
    part = F.struct(F.col("l_partkey").alias("key"), F.col("l_quantity").alias("quantity"))
    line = F.struct(F.col("l_orderkey").alias("order"), part.alias("part"))
    return flatten_structs(load(spark, sf_dir, "lineitem").select(line.alias("line"), "l_shipdate"))
