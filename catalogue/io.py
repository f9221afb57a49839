"""Sources, sinks, registry, whole runs and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalogue import load, register
from catalogue.dirty import UPLOAD_FILLED, by_key, messy_orders, select_upload
from tidyloom.operators.columns import drop_technical
from tidyloom.operators.keys import add_surrogate_id
from tidyloom.plans.clean import clean
from tidyloom.config import ROW_SEQ, CleanConfig
from tidyloom.plans.pipeline import catalog_opener, catalog_writer, csv_opener, csv_writer, run_pipeline
from tidyloom.plans.records import run_records
from tidyloom.sinks.runlog import log_runs, read_run_log
from tidyloom.sinks.tables import output_check, read_csv, sql_columns, table_name, write_catalog, write_csv
from tidyloom.sources.files import json_rejects, pending_records, scan_all_text, scan_csv, scan_file, scan_json, scan_table
from tidyloom.sources.payloads import csv_payload_rejects, scan_csv_payload, scan_payload
from tidyloom.sources.splits import scan_csv_splits
from tidyloom.storage import fresh_path
from tidyloom.streaming.ingest import (
    api_stream,
    dataset_status,
    file_stream,
    land_api_rows,
    land_csv_rows,
    land_file_rows,
    land_rows,
    landed_rows,
    rejected,
    run_datasets,
    start,
)

#: What one task writes of a landing file at most, about.
FILE_BYTES, FILE_ROWS = 64 * 1024 * 1024, 500_000
MOST_SPLITS = 512
#: Events of all types per page of an API response.
PAGE_EVENTS = 100_000
#: Rows of a landing file that passes the stream as one payload.
PAYLOAD_ROWS = 100_000


@register("csv_roundtrip", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def csv_roundtrip(spark, sf_dir):
    """Texts with quotes, commas and line breaks survive."""
    documents = load(spark, sf_dir, "documents")
    path = fresh_path(spark, "documents.csv")
    write_csv(documents, path)
    return read_csv(spark, path, documents.schema)


@register("csv_scan", "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def csv_scan(spark, sf_dir):
    path = fresh_path(spark, "part.csv")
    write_csv(load(spark, sf_dir, "part"), path)
    return drop_technical(scan_csv(spark, path)).withColumn("p_partkey", F.col("p_partkey").cast("bigint"))


@register("csv_splits", """
    SELECT CAST(doc_id AS VARCHAR) AS doc_id, nullif(text, '') AS text, lang, source, CAST(n_chars AS VARCHAR) AS n_chars,
           row_number() OVER (ORDER BY doc_id) AS place, true AS spread
    FROM documents""")
def csv_splits(spark, sf_dir):
    """One file of documents, more if they are large, with line breaks in quoted cells, each read by many tasks, every row
    in its place."""
    path, key = fresh_path(spark, "documents.csv"), "spark.sql.files.maxPartitionBytes"
    documents = load(spark, sf_dir, "documents")
    size = documents.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    files = max(1, -(-size // FILE_BYTES))
    write_csv(documents.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id"), path)
    before = spark.conf.get(key)
    # Hundreds of splits show what there is to show; more cost a task each and find no more.
    spark.conf.set(key, f"{max(64 * 1024, size // MOST_SPLITS)}b")
    try:
        found = scan_csv_splits(spark, path)
        tasks = spark.read.text(path, lineSep="\n").select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.set(key, before)
    placed = add_surrogate_id(found, [ROW_SEQ], name="place")
    return placed.select(*documents.columns, "place", F.lit(tasks > 2).alias("spread"))


@register("row_sequence_place", """
    SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_returnflag,
           row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag) - 1 AS seq FROM lineitem""")
def row_sequence_place(spark, sf_dir):
    """Lines in several files, numbered by path and place, however the files are packed into tasks."""
    path, order = fresh_path(spark, "lineitem.csv"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"]
    lines = load(spark, sf_dir, "lineitem")
    files = max(5, -(-lines.count() // FILE_ROWS))
    lines.repartitionByRange(files, *order).sortWithinPartitions(*order).write.option("header", True).csv(path)
    found = scan_csv(spark, path, infer_schema=False, multi_line=False, by_place=True)
    return found.select(*[F.col(c).cast("bigint") for c in order[:2]], "l_returnflag", F.col(ROW_SEQ).alias("seq"))


@register("csv_all_string", """
    SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, CAST(p_size AS VARCHAR) AS p_size FROM part""")
def csv_all_string(spark, sf_dir):
    path = fresh_path(spark, "part.csv")
    write_csv(load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), path)
    return drop_technical(scan_all_text(scan_file(spark, "Part.CSV", path, infer_schema=False)))


@register("csv_text_kept", """
    SELECT lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS p_partkey, printf('%.2f', p_retailprice) AS p_retailprice, p_name,
           p_brand, p_type, CAST(p_size AS VARCHAR) AS p_size FROM part""")
def csv_text_kept(spark, sf_dir):
    """Leading and trailing zeros survive an all-text scan, since no type is inferred on the way."""
    path = fresh_path(spark, "part.csv")
    write_csv(load(spark, sf_dir, "part").select(
        F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("p_partkey"),
        F.format_string("%.2f", "p_retailprice").alias("p_retailprice"), "p_name", "p_brand", "p_type", "p_size"), path)
    return drop_technical(scan_all_text(scan_file(spark, "Part.CSV", path, infer_schema=False)))


@register("csv_payload", """
    SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang, CAST(NULL AS VARCHAR) AS note FROM documents""")
def csv_payload(spark, sf_dir):
    """Documents packed as binary CSV payloads of twenty rows each, with quoted line breaks inside."""
    def cell(c):
        return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))

    line = F.concat_ws(",", F.col("doc_id").cast("string"), cell(F.col("text")), F.col("lang"), F.lit(""))
    payloads = load(spark, sf_dir, "documents").groupBy(F.floor(F.col("doc_id") / 20).alias("id")).agg(
        F.concat(F.lit("doc_id,text,lang,note\r\n"), F.array_join(F.collect_list(line), "\r\n")).cast("binary")
        .alias("file_content")
    )
    return drop_technical(scan_csv_payload(payloads))


@register("csv_payload_stray_quotes", """
    SELECT CAST(p_partkey AS VARCHAR) AS partkey, p_size || '" ' || p_name AS name, p_brand AS brand FROM part""")
def csv_payload_stray_quotes(spark, sf_dir):
    """Quotes in the middle of unquoted cells are plain characters; the file extension is unknown."""
    cell = F.concat(F.col("p_size").cast("string"), F.lit('" '), "p_name")
    # Half of the cells carry their quote doubled inside a quoted cell, as the standard wants it.
    proper = F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"'))
    content = F.concat(F.lit("partkey,name,brand\n"), F.col("p_partkey").cast("string"), F.lit(","),
                       by_key(F.col("p_partkey"), [cell, proper]), F.lit(","), F.col("p_brand"))
    return drop_technical(scan_payload(
        load(spark, sf_dir, "part").select(content.alias("file_content")), "parts.export"
    ))


def _part_payloads(spark, sf_dir):
    """Each part as a CSV payload of its own, in one of six shapes: two headers, one of them in quotes or turned around,
    a cell too many, stray quotes, and nothing but blank lines."""
    part = load(spark, sf_dir, "part")
    key, cell = F.col("p_partkey"), F.concat(F.lit('"'), F.col("p_name"), F.lit('"'))
    line = F.concat_ws(",", key.cast("string"), cell, "p_brand")
    return part.select(key, by_key(key, [
        F.concat(F.lit("key,name,brand\n"), line), F.concat(F.lit('"key",name,"brand"\r\n'), line, F.lit("\r\n")),
        F.concat(F.lit("\n \nbrand,size,key\n"), F.concat_ws(",", "p_brand", F.col("p_size").cast("string"), key.cast("string"))),
        F.concat(F.lit("key,name,brand\n"), line, F.lit("\n"), line, F.lit(",more")),
        F.concat(F.lit("key,name,brand\n"), F.concat_ws(",", key.cast("string"), F.concat(F.col("p_name"), F.lit('"')), "p_brand")),
        F.lit("\r\n \n"),
    ]).alias("file_content"))


@register("csv_payload_headers", """
    SELECT CAST(p_partkey AS VARCHAR) AS "key", CASE p_partkey % 6 WHEN 2 THEN NULL WHEN 4 THEN p_name || '"' ELSE p_name END AS name,
           p_brand AS brand, CASE WHEN p_partkey % 6 = 2 THEN CAST(p_size AS VARCHAR) END AS size
    FROM part WHERE p_partkey % 6 < 5""")
def csv_payload_headers(spark, sf_dir):
    """Payloads with different headers share a table; each cell is in the column its own header names."""
    return drop_technical(scan_csv_payload(_part_payloads(spark, sf_dir), broken="skip"))


@register("csv_payload_rejects", """
    SELECT p_partkey, CASE WHEN p_partkey % 6 = 3 THEN 2 END AS record,
           CASE WHEN p_partkey % 6 = 3 THEN 'more cells than the header' ELSE 'no record' END AS reason,
           CASE WHEN p_partkey % 6 = 3 THEN p_partkey || ',"' || p_name || '",' || p_brand || ',more' END AS line
    FROM part WHERE p_partkey % 6 IN (3, 5)""")
def payload_rejects(spark, sf_dir):
    return csv_payload_rejects(_part_payloads(spark, sf_dir), keep=["p_partkey"])


@register("json_scan", """
    SELECT event_id, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS props_k
    FROM events""")
def json_scan(spark, sf_dir):
    path = fresh_path(spark, "events.json")
    load(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", "value", F.from_json("props", "k bigint").alias("props")
    ).write.json(path)
    return drop_technical(scan_json(spark, path, lines=True))


@register("json_documents", """
    SELECT event_id, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS props_k, ts
    FROM events""")
def json_documents(spark, sf_dir):
    """Files that are one document each."""
    path = fresh_path(spark, "event_documents")
    event = F.struct("event_id", "user_id", "event_type", "value", F.from_json("props", "k bigint").alias("props"),
                     F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))
    load(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / 1000).alias("document")).agg(
        F.to_json(F.struct(F.collect_list(event).alias("records"))).alias("value")
    ).write.partitionBy("document").text(path)
    return drop_technical(scan_json(spark, path)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@register("json_scan_rejects", """
    SELECT event_id, CASE WHEN event_id % 4 = 1 THEN 'rejected' ELSE 'read' END AS outcome FROM events""")
def json_scan_rejects(spark, sf_dir):
    """Each broken line of a JSON-lines file is a reject, each other line is read; blank lines are neither."""
    path = fresh_path(spark, "broken_lines")
    whole = F.format_string('{"event_id": %d, "value": 1}', "event_id")
    line = by_key(F.col("event_id"), [whole, F.format_string('{"event_id": %d, "val', "event_id"), whole,
                                      F.concat(whole, F.lit("\n "))])
    load(spark, sf_dir, "events").select(line.alias("value")).write.text(path)
    found = scan_json(spark, path, lines=True, broken="skip").select("event_id", F.lit("read").alias("outcome"))
    rejects = json_rejects(spark, path, lines=True).select(
        F.regexp_extract("document", r"\d+", 0).cast("bigint").alias("event_id"), F.lit("rejected").alias("outcome"))
    return found.union(rejects)


@register("table_roundtrip", "SELECT * FROM orders")
def table_roundtrip(spark, sf_dir):
    """Write a table twice and scan it: the second write replaces the first."""
    orders, name = load(spark, sf_dir, "orders"), f"orders_{uuid.uuid4().hex}"
    path = fresh_path(spark, "orders_table")
    write_catalog(orders.filter("o_orderkey % 2 = 0"), name, path)
    write_catalog(orders, name, path)
    return drop_technical(scan_table(spark, name))


def _registry(spark, sf_dir):
    doc = F.col("doc_id")
    return load(spark, sf_dir, "documents").select(
        doc.alias("id"), F.concat("source", F.lit(".csv")).alias("file_name"), F.col("lang").alias("company_name"),
        F.concat(F.lit("user"), (doc % 9).cast("string")).alias("uploaded_by"),
        by_key(doc, [F.lit("NEW"), F.lit("DONE"), F.lit("ERROR")]).alias("status"),
    )


@register("pending_records", """
    SELECT doc_id AS id, source || '.csv' AS file_name, lang AS company_name, 'user' || doc_id % 9 AS uploaded_by,
           'NEW' AS status FROM documents WHERE doc_id % 3 = 0""")
def pending(spark, sf_dir):
    return pending_records(_registry(spark, sf_dir))


@register("pending_next", "SELECT min(doc_id) AS id, 'NEW' AS status FROM documents WHERE doc_id % 3 = 0")
def pending_next(spark, sf_dir):
    return pending_records(_registry(spark, sf_dir), limit=1).select("id", "status")


@register("run_stats", """
    SELECT source || '.csv' AS file_name, arg_max(lang, doc_id) AS company_name,
           'user' || max(doc_id) % 9 AS uploaded_by, TIMESTAMP '2024-05-01 15:30:00' AS processed_at,
           count(*) AS rows_count, 'DONE' AS status
    FROM documents GROUP BY source""")
def run_log(spark, sf_dir):
    registry = _registry(spark, sf_dir)
    runs = registry.groupBy("file_name").agg(F.count(F.lit(1)).alias("rows_count")).select(
        "file_name", F.lit("2024-05-01 15:30:00").cast("timestamp_ntz").alias("processed_at"), "rows_count",
        F.lit("DONE").alias("status"),
    )
    unknown = runs.withColumn("file_name", F.concat(F.lit("unknown "), "file_name"))
    path = fresh_path(spark, "file_run_stats")
    log_runs(registry, runs.filter("file_name < 'src5'"), path, 0)
    for _ in range(2):  # a batch that is tried again is logged once
        log_runs(registry, runs.filter("file_name >= 'src5'").union(unknown), path, 1)
    return read_run_log(spark, path)


@register("registry_runs", """
    SELECT 'orders' AS dataset, 'DONE' AS status, count(*) AS rows_count, count(*) AS written FROM orders
    UNION ALL SELECT 'parts', 'DONE', count(*), count(*) FROM part
    UNION ALL SELECT 'lost', 'ERROR', NULL, NULL""")
def registry_runs(spark, sf_dir):
    """A file, a table and a lost file from the registry, each run as its own dataset; then what was written."""
    csv, table, out = fresh_path(spark, "orders.csv"), f"parts_{uuid.uuid4().hex}", fresh_path(spark, "runs")
    write_csv(load(spark, sf_dir, "orders"), csv)
    write_catalog(load(spark, sf_dir, "part"), table, fresh_path(spark, "parts"))
    registry = spark.createDataFrame(
        [(1, "orders.csv", csv, None), (2, "x", "MULTI_UPLOAD", table), (3, "lost.csv", f"{csv}.lost", None)],
        "id int, file_name string, file_path string, table_name string",
    )
    status = run_records(registry, out).withColumn(
        "dataset", F.when(F.col("dataset") == table, "parts").otherwise(F.col("dataset"))
    )
    full = {"orders": f"{out}/orders/orders_fulltable.csv", "parts": f"{out}/{table}/{table}_fulltable.csv"}
    written = None
    for name, path in full.items():
        one = read_csv(spark, path).agg(F.count(F.lit(1)).alias("written")).withColumn("dataset", F.lit(name))
        written = one if written is None else written.union(one)
    return status.join(written, "dataset", "left").select("dataset", "status", "rows_count", "written")


@register("full_run", select_upload(UPLOAD_FILLED))
def full_run(spark, sf_dir):
    """The whole plan on the messy upload, read back from the CSV it wrote."""
    folder = fresh_path(spark, "runs")
    result = run_pipeline(messy_orders(spark, sf_dir), [csv_writer(folder, "orders")])
    return read_csv(spark, f"{folder}/orders/orders_fulltable.csv", result.full.schema)


@register("full_run_split", select_upload({
    name: UPLOAD_FILLED[name]
    for name in ("order_key", "orderstatus", "remark", "priority", "total_price_", "purchase_date", "cust_no")
} | {"remark_1": UPLOAD_FILLED["remark_1"]}))
def full_run_split(spark, sf_dir):
    """The three tables of a run join back to the full table."""
    tables = run_pipeline(messy_orders(spark, sf_dir)).tables
    return tables["entity"].join(tables["metrics"], "order_key").join(tables["dimension"], "order_key")


@register("output_check", """
    SELECT unnest(['fulltable', 'entity', 'metrics', 'dimension']) AS kind, unnest([true, true, true, false]) AS present,
           unnest([n, n, n, NULL]) AS rows
    FROM (SELECT count(*) AS n FROM orders)""")
def check_outputs(spark, sf_dir):
    """A run with one output missing."""
    folder = fresh_path(spark, "runs")
    tables = run_pipeline(messy_orders(spark, sf_dir)).tables
    for kind in ("fulltable", "entity", "metrics"):
        csv_writer(folder, "orders")(tables[kind], kind)
    return output_check(spark, csv_opener(folder, "orders"))


@register("catalog_run", select_upload(UPLOAD_FILLED))
def catalog_run(spark, sf_dir):
    """A whole run into catalog tables, of which the full one is read back."""
    base = f"run_{uuid.uuid4().hex}"
    run_pipeline(messy_orders(spark, sf_dir), [catalog_writer(base)])
    return spark.table(table_name(base, "fulltable"))


@register("catalog_check", """
    SELECT unnest(['fulltable', 'entity', 'metrics', 'dimension']) AS kind, unnest([true, true, false, true]) AS present,
           unnest([n, n, NULL, n]) AS rows
    FROM (SELECT count(*) AS n FROM orders)""")
def catalog_check(spark, sf_dir):
    """Catalog tables of a run with one of them missing."""
    base = f"run_{uuid.uuid4().hex}"
    tables = run_pipeline(messy_orders(spark, sf_dir)).tables
    for kind in ("fulltable", "entity", "dimension"):
        catalog_writer(base)(tables[kind], kind)
    return output_check(spark, catalog_opener(base))


@register("sql_types", """
    SELECT unnest(['order_key', 'orderstatus', 'total_price_', 'purchase_date', 'priority', 'cust_no', 'remark',
                   'remark_1']) AS name,
           unnest(['BIGINT', 'TEXT', 'DOUBLE', 'DATE', 'TEXT', 'BIGINT', 'TEXT', 'TEXT']) AS sql_type""")
def sql_types(spark, sf_dir):
    """Database types of the full table of a run, as it was written."""
    base = f"run_{uuid.uuid4().hex}"
    run_pipeline(messy_orders(spark, sf_dir), [catalog_writer(base)], CleanConfig(date_missing="null"))
    written = spark.table(table_name(base, "fulltable"))
    return spark.createDataFrame(sql_columns(written.schema), "name string, sql_type string")


@register("raw_columns_run", select_upload({n: UPLOAD_FILLED[n] for n in ("order_key", "remark", "remark_1")}))
def raw_columns_run(spark, sf_dir):
    raw = ["Remark", " Order  Key ", "Blank", "remark"]
    return run_pipeline(messy_orders(spark, sf_dir), raw_columns=raw).full


def _api_landing(spark, sf_dir):
    """Events as API records of a hundred events each, on disk as JSON lines."""
    path = fresh_path(spark, "api_landing")
    event = F.struct("event_id", "user_id", "event_type", "value", F.from_json("props", "k bigint").alias("props"))
    group = F.floor(F.col("event_id") / 100).cast("bigint")
    load(spark, sf_dir, "events").groupBy(group.alias("id")).agg(
        F.to_json(F.struct(F.collect_list(event).alias("data"))).alias("response")
    ).select(
        "id", "response", F.concat(F.lit("events "), F.col("id").cast("string"), F.lit(".json")).alias("file_name"),
        F.lit("NEW").alias("status"),
    ).write.json(path)
    return path


_FLAT_EVENTS = """
    SELECT event_id, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS props_k
    FROM events"""


@register("stream_ingest", _FLAT_EVENTS)
def stream_ingest(spark, sf_dir):
    """API records streamed into one flat table, two landing files per batch, restarted once in between."""
    landing, out, checkpoint = _api_landing(spark, sf_dir), fresh_path(spark, "rows"), fresh_path(spark, "checkpoint")
    for _ in range(2):
        stream = api_stream(spark, landing, max_files=2)
        start(stream, land_rows(land_api_rows, out), checkpoint, available_now=True).awaitTermination()
    return drop_technical(clean(landed_rows(spark, out)).df).selectExpr(
        "event_id", "cast(user_id as bigint) user_id", "lower(event_type) event_type", "value",
        "cast(props_k as bigint) props_k",
    )


@register("stream_batch", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders")
def stream_batch(spark, sf_dir):
    """CSV files as binary payloads, everything that is there in one batch."""
    landing, out = fresh_path(spark, "file_landing"), fresh_path(spark, "rows")
    write_csv(load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"),
              landing)
    stream = file_stream(spark, landing, "*.csv")
    start(stream, land_rows(land_csv_rows, out), fresh_path(spark, "checkpoint"), available_now=True) \
        .awaitTermination()
    return landed_rows(spark, out).selectExpr(
        "cast(o_orderkey as bigint) o_orderkey", "cast(o_custkey as bigint) o_custkey",
        "cast(o_totalprice as double) o_totalprice", "o_orderpriority",
    )


@register("stream_mixed_files", """
    SELECT 'row' AS kind, o_orderkey, o_custkey, o_totalprice, o_orderpriority, CAST(NULL AS VARCHAR) AS reason FROM orders
    UNION ALL SELECT 'reject', NULL, NULL, NULL, NULL, unnest(['no record', 'more cells than the header', 'no JSON'])""")
def stream_mixed_files(spark, sf_dir):
    """One batch of good files of three headers, a JSON document, more of each if they are large, an empty file, a wide
    record and a broken document; what is good lands, the rest are rejects, and a restart reads nothing twice."""
    landing, out, checkpoint = fresh_path(spark, "landing"), fresh_path(spark, "rows"), fresh_path(spark, "checkpoint")
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    share = [orders.where(F.col("o_orderkey") % 4 == i) for i in range(4)]
    write_csv(share[0], f"{landing}/plain", PAYLOAD_ROWS)
    share[1].write.option("maxRecordsPerFile", PAYLOAD_ROWS).csv(f"{landing}/quoted", header=True, quoteAll=True)
    write_csv(share[2].select("o_orderpriority", "o_custkey", "o_orderkey", "o_totalprice"), f"{landing}/turned", PAYLOAD_ROWS)
    document = F.to_json(F.struct(F.collect_list(F.struct(*orders.columns)).alias("rows"))).alias("value")
    files = max(1, -(-share[3].count() // PAYLOAD_ROWS))
    dealt = share[3].withColumn("file", F.monotonically_increasing_id() % files)
    # Ranges, since a first partition without rows would be written as an empty file.
    grouped = dealt.repartitionByRange(files, "file").groupBy("file") if files > 1 else dealt.groupBy()
    grouped.agg(document).select("value").write.option("maxRecordsPerFile", 1).text(f"{landing}/document")
    for name, text in (("empty", "\n"), ("wide", "o_orderkey,o_custkey\n1,2,3"), ("broken", "{oops")):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{landing}/{name}")
    for _ in range(2):
        stream = file_stream(spark, f"{landing}/*", "part-*").withColumn("file_name", F.when(
            F.col("file_path").rlike("/(document|broken)/"), F.regexp_replace("file_name", "[.]txt$", ".JSON")).otherwise(F.col("file_name")))
        start(stream, land_rows(land_file_rows, out), checkpoint, available_now=True).awaitTermination()
    rows = landed_rows(spark, out).select(F.lit("row").alias("kind"), *[
        F.col(c).cast(t).alias(c) for c, t in orders.dtypes], F.lit(None).cast("string").alias("reason"))
    return rows.unionByName(rejected(spark, out).select(F.lit("reject").alias("kind"), "reason"), allowMissingColumns=True)


@register("dataset_runs", """
    SELECT event_type AS dataset, 'DONE' AS status, count(*) OVER (PARTITION BY event_type) AS rows_count, event_id, value,
           CAST(json_extract_string(props, '$.k') AS BIGINT) AS props_k FROM events
    UNION ALL SELECT unnest(['broken', 'missing', 'none']), 'ERROR', NULL, NULL, NULL, NULL""")
def dataset_runs(spark, sf_dir):
    """API records, each a dataset with a run and a status of its own: one for each type of event, in pages, a broken
    response, a missing one and one without records.  What was written is read back."""
    landing, out = fresh_path(spark, "api_landing"), fresh_path(spark, "runs")
    event = F.struct("event_id", "value", F.from_json("props", "k bigint").alias("props"))
    events = load(spark, sf_dir, "events")
    page = F.coalesce(F.floor(F.col("event_id") / PAGE_EVENTS), F.lit(-1)).alias("page")
    good = events.groupBy("event_type", page).agg(F.to_json(F.struct(F.collect_list(event).alias("data"))).alias("response"))
    good = good.select(F.xxhash64("event_type").alias("id"), "response", F.concat("event_type", F.lit(".json")).alias("file_name"), "page")
    odd = spark.createDataFrame([(1, "{oops", "broken.json"), (2, None, "missing.json"), (3, '{"data": []}', "none.json")],
                                good.drop("page").schema)
    good.unionByName(odd, allowMissingColumns=True).withColumn("status", F.lit("NEW")).write.json(landing)
    start(api_stream(spark, landing), run_datasets(out), fresh_path(spark, "checkpoint"), available_now=True).awaitTermination()
    status = dataset_status(spark, out).select("dataset", "status", "rows_count")
    names = [r["dataset"] for r in status.where("rows_count > 0").collect()]
    written = None
    for name in names:
        one = read_csv(spark, f"{out}/{name}/{name}_fulltable.csv").select(
            F.lit(name).alias("dataset"), F.col("event_id").cast("bigint"), F.col("value").cast("double"),
            F.col("props_k").cast("double").cast("bigint").alias("props_k"))
        written = one if written is None else written.union(one)
    return status.join(written, "dataset", "left")
