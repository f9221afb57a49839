import json
import os
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalogue import io
from tidyloom.config import ROW_SEQ
from tidyloom.sinks.runlog import run_stats
from tidyloom.sinks.tables import csv_path, jdbc_options, output_check, read_csv, sql_columns, write_all, write_catalog, write_csv
from tidyloom.sources import files, payloads
from tidyloom.sources.payloads import csv_payload_rejects, scan_api_responses, scan_csv_payload, scan_payload
import tidyloom.storage as storage
from tidyloom.storage import discarding, estimated_bytes, fresh_path, materialize, shared_root, sized_shuffles, stage
from tidyloom.streaming import ingest
from tidyloom.streaming.ingest import land_api_rows, land_file_rows, land_rows, landed_rows, rejected


def payload_frame(spark, *texts):
    return spark.createDataFrame([(t.encode(),) for t in texts], "file_content binary")


def test_csv_payload_quoting(spark, rows):
    text = '﻿a,"b c",,a\r\n1,"x\r\ny",,p\r\n\r\n2,"q ""z"", w",,\r\n3,"",n\n"""a""",b\n'
    df = scan_csv_payload(payload_frame(spark, text))
    assert df.columns == ["a", "b c", "Unnamed: 2", "a_1", ROW_SEQ]
    assert rows(df.drop(ROW_SEQ)) == sorted([
        ("1", "x\r\ny", None, "p"), ("2", 'q "z", w', None, None), ("3", None, "n", None), ('"a"', "b", None, None),
    ], key=repr)


@pytest.mark.parametrize("text", [
    'a,b\n5" pipe,x\n"q",y\n', 'a,b\n5" pipe,x\n"q",y', '"a",b\r\n5" pipe,x\r\nq,y\r\n',
])
def test_csv_payload_with_stray_quotes(spark, rows, text):
    df = scan_csv_payload(payload_frame(spark, text, 'a,b\n1,"2\n3"\n'))
    assert rows(df.drop(ROW_SEQ)) == [("1", "2\n3"), ('5" pipe', "x"), ("q", "y")]


def test_csv_payloads_match_a_csv_reader(spark):
    """Random cells, written by the standard library, read back through both ways of parsing."""
    import csv
    import io

    rng = random.Random(5)
    cells = ["x", 'say "hi"', "a,b", "two\nlines", "", " pad ", "é₹", '"', "1.5"]
    payloads, wanted = [], []
    for _ in range(30):
        out = io.StringIO(newline="")
        writer = csv.writer(out)
        writer.writerow(["c1", "c2", "c3"])
        for _ in range(20):
            row = [rng.choice(cells), rng.choice(cells), "end"]
            writer.writerow(row)
            wanted.append(tuple(c or None for c in row))
        payloads.append(out.getvalue())
    got = [tuple(r) for r in scan_csv_payload(payload_frame(spark, *payloads)).drop(ROW_SEQ).collect()]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)


def test_csv_payloads_of_several_headers(spark):
    df = payload_frame(spark, "a,b\n1,2\n", 'b,"c d"\n3" ,4\n', '"a",b\n5,6', "a,a\n7,8", " \n")
    found = scan_csv_payload(df.coalesce(1), broken="skip")
    assert found.columns == ["a", "b", "c d", "a_1", ROW_SEQ]
    assert [tuple(r)[:4] for r in found.orderBy(ROW_SEQ).collect()] == [
        ("1", "2", None, None), (None, '3" ', "4", None), ("5", "6", None, None), ("7", None, None, "8")]
    assert [tuple(r) for r in csv_payload_rejects(df).collect()] == [(None, "no record", None)]
    with pytest.raises(ValueError, match="no payload"):
        scan_csv_payload(payload_frame(spark, " ", ""))
    assert scan_csv_payload(payload_frame(spark, " ", ""), broken="skip").collect() == []


def test_csv_payloads_of_too_many_headers_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(payloads, "MOST_HEADERS", 2)
    with pytest.raises(ValueError, match="more than 2 different headers"):
        scan_csv_payload(payload_frame(spark, "a\n1", "b\n1", "c\n1"))


def test_random_csv_text_is_read_as_by_a_csv_reader(spark):
    import csv
    import io

    rng = random.Random(7)
    signs = ['"', '"', ",", "\n", "\r\n", "\r", "a", "b c", "é", "\t"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += ["a," + '"' + '""' * 50_000 + 'z"\n"' + "y," * 50_000, '"', '""', '"""', 'a"b\n""c,d']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(8)
    got = df.select("i", F.transform(payloads.csv_records(F.col("t")), payloads.csv_cells).alias("c")).collect()
    for row in got:
        wanted = [r for r in csv.reader(io.StringIO(texts[row.i], newline="")) if len(r) > 1 or r and r[0].strip()]
        assert [c for c in row.c or [] if len(c) > 1 or c[0].strip()] == wanted, texts[row.i]


def test_irregular_payloads_keep_their_place(spark, monkeypatch):
    """The row sequence is the same whether an input is staged or not, and whichever payloads hold stray quotes."""
    long = "y" * 3000
    texts = [f'a,b\n{i}{chr(34) * (i % 2)},{long}\n{i}{chr(34) * (i % 2)},2' for i in range(8)]
    df = spark.createDataFrame([(t,) for t in texts], "file_content string").coalesce(1)
    plain = [(r.a, r.b) for r in scan_csv_payload(df).orderBy(ROW_SEQ).collect()]
    assert [a.strip('"') for a, _ in plain] == [str(i // 2) for i in range(16)]
    monkeypatch.setattr(storage, "BYTES_PER_PIECE", 100)
    assert [(r.a, r.b) for r in scan_csv_payload(df).orderBy(ROW_SEQ).collect()] == plain


def test_csv_payloads_need_no_python(spark):
    plan = scan_csv_payload(payload_frame(spark, 'a,b\n1" ,2\n'))._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and "Python" not in plan


def test_landing_of_mixed_files(spark, tmp_path):
    rows = [("a.csv", "p", b"x,y\n1,2\n"), ("b.csv", "p", b""), ("c.csv", "p", b'"x",z\n3,4,5\n6,7'),
            ("d.JSON", "p", b'[{"x": 8}]'), ("e.json", "p", b"{"), ("f.csv", "p", b"file_name\nme"), ("g", "p", None)]
    handle = land_rows(land_file_rows, str(tmp_path))
    for _ in range(2):
        handle(spark.createDataFrame(rows, "file_name string, file_path string, file_content binary"), 0)
    found = [(r.x, r.y, r.z, r.file_name) for r in landed_rows(spark, str(tmp_path)).collect()]
    assert sorted(found, key=repr) == sorted([("1", "2", None, None), ("6", None, "7", None), ("8", None, None, None),
                                              (None, None, None, "me")], key=repr)
    assert sorted((r.file_name, r.record, r.reason) for r in rejected(spark, str(tmp_path)).select(
        "file_name", F.coalesce("record", F.lit(0)).alias("record"), "reason").collect()) == [
        ("b.csv", 0, "no record"), ("c.csv", 1, "more cells than the header"), ("e.json", 0, "no JSON"), ("g", 0, "no record")]


def test_landed_files_are_held_a_few_at_a_time(spark, monkeypatch):
    written = []

    def noted(df, label, **options):
        written.append(materialize(df, label, **options))
        return written[-1]

    monkeypatch.setattr(ingest, "materialize", noted)
    noise = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4096)), lambda i: F.sha2((F.col("id") * 5000 + i).cast("string"), 256)), "\n")
    files = spark.range(40, numPartitions=1).select(
        F.lit("a.csv").alias("file_name"), F.lit("p").alias("file_path"), F.concat(F.lit("a\n"), noise).cast("binary").alias("file_content"))
    assert land_file_rows(files).rows.count() == 40 * 4096
    groups = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in written[0].inputFiles()]
    sizes = [(m.row_group(i).num_rows, m.row_group(i).total_byte_size) for m in groups for i in range(m.num_row_groups)]
    assert sum(n for n, _ in sizes) == 40 and max(b for _, b in sizes) < 6 * 1024 * 1024


def test_mixed_files_grow_in_number_not_in_size(spark, tmp_path, monkeypatch):
    rows = [(i // 2, i % 7, i / 4, None if i % 5 == 0 else f"{i % 3}-X, y") for i in range(2000)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string").coalesce(1) \
        .write.parquet(str(tmp_path / "orders.parquet"))
    monkeypatch.setattr(io, "PAYLOAD_ROWS", 90, raising=False)
    monkeypatch.setattr(io, "fresh_path", lambda spark, label: f"{tmp_path}/{label}")
    found = io.stream_mixed_files(spark, str(tmp_path)).collect()
    assert sorted(((*r[1:5],) for r in found if r.kind == "row"), key=repr) == sorted(rows, key=repr)
    assert sorted(r.reason for r in found if r.kind == "reject") == ["more cells than the header", "no JSON", "no record"]
    documents = [json.loads(f.read_text())["rows"] for f in tmp_path.glob("landing/document/part-*")]
    assert sum(map(len, documents)) == 500 and max(map(len, documents)) <= 90
    for kind in ("plain", "quoted", "turned"):
        lines = [len(f.read_text().splitlines()) - 1 for f in tmp_path.glob(f"landing/{kind}/part-*")]
        assert sum(lines) == 500 and max(lines) <= 90


def test_intermediate_tables_go_with_their_block(spark):
    def left():
        return sum(len(files) for _, _, files in os.walk(shared_root(spark)))

    materialize(spark.range(1), "stays")
    before = left()
    with discarding(spark):
        kept = materialize(spark.range(3), "goes").count()
        with discarding(spark):
            materialize(spark.range(3), "goes")
        assert left() > before
    assert kept == 3 and left() == before


def test_a_column_called_exchange_is_no_shuffle(spark):
    def shuffles(df):
        return storage._has_shuffle(df._jdf.queryExecution().sparkPlan())

    df = spark.range(10).withColumnRenamed("id", "Exchange Rate")
    assert not shuffles(df) and not shuffles(df.join(F.broadcast(df), "Exchange Rate"))
    assert shuffles(df.repartition(3)) and shuffles(df.groupBy("Exchange Rate").count()) and shuffles(df.orderBy("Exchange Rate"))


def test_broken_utf8_is_replaced(spark):
    df = spark.createDataFrame([(b"a,b\n\xff,2\n",)], "file_content binary")
    assert scan_csv_payload(df).head()[:2] == ("�", "2")


def test_payload_formats(spark, rows):
    doc = payload_frame(spark, json.dumps({"rows": [{"a": 1}, {"a": 2}]}))
    assert rows(scan_payload(doc, "x.JSON").drop(ROW_SEQ)) == [(1,), (2,)]
    assert rows(scan_payload(payload_frame(spark, "a\n1\n"), "x.weird").drop(ROW_SEQ)) == [("1",)]


def test_api_responses_carry_no_sequence(spark, rows):
    df = spark.createDataFrame([('{"data": [{"a": 1}]}',), (None,), ("oops",)], "response string")
    assert scan_api_responses(df).columns == ["a"]
    assert rows(scan_api_responses(df)) == [(1,)]


def test_file_scans(spark, tmp_path, rows):
    (tmp_path / "t.csv").write_text('n,"long text"\n1,"a\nb ""c"""\n2,\n')
    df = files.scan_file(spark, "T.csv", str(tmp_path / "t.csv"))
    assert df.dtypes == [("n", "int"), ("long text", "string"), (ROW_SEQ, "bigint")]
    assert rows(df.drop(ROW_SEQ)) == [(1, 'a\nb "c"'), (2, None)]
    (tmp_path / "d.json").write_text('{"items": [\n{"a": 1},\n{"a": [2, 3]}\n]}')
    assert rows(files.scan_file(spark, "d", str(tmp_path / "d.json")).drop(ROW_SEQ)) == [(1,), (2,), (3,)]
    with pytest.raises(ValueError, match="unsupported"):
        files.scan_file(spark, "d.xlsx", "d.xlsx")


def test_all_text_scan(spark):
    df = files.scan_all_text(spark.range(1).withColumn("t", F.lit(True)))
    assert df.dtypes == [("id", "string"), ("t", "string"), (ROW_SEQ, "bigint")]


def test_empty_table_is_skipped(spark):
    write_catalog(spark.range(0), "empty_table", fresh_path(spark, "empty"))
    write_catalog(spark.range(3), "full_table", fresh_path(spark, "full"))
    assert files.scan_table(spark, "empty_table") is None
    assert files.scan_table(spark, "full_table").columns == ["id", ROW_SEQ]


def test_pending_records(spark):
    df = spark.createDataFrame([(3, "NEW"), (1, "DONE"), (2, "NEW")], "id int, status string")
    assert [r["id"] for r in files.pending_records(df).collect()] == [2, 3]
    assert [r["id"] for r in files.pending_records(df, 1).collect()] == [2]
    plan = files.pending_records(df, 1)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_sql_types():
    schema = T.StructType([T.StructField(n, t) for n, t in [
        ("i", T.IntegerType()), ("l", T.LongType()), ("d", T.DoubleType()), ("f", T.FloatType()),
        ("t", T.TimestampType()), ("x", T.DateType()), ("s", T.StringType()), ("b", T.BooleanType())]])
    assert [kind for _, kind in sql_columns(schema)] == [
        "BIGINT", "BIGINT", "DOUBLE", "DOUBLE", "DATETIME", "DATE", "TEXT", "TEXT"]


def test_jdbc_options():
    schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("s", T.StringType())])
    assert jdbc_options(schema) == {"batchsize": "1000", "createTableColumnTypes": "`i` BIGINT"}
    assert jdbc_options(T.StructType([T.StructField("s", T.StringType())])) == {"batchsize": "1000"}


def test_csv_sink_overwrites_and_checks(spark, rows):
    folder = fresh_path(spark, "out")

    def write(df, kind):
        write_csv(df, csv_path(folder, "base", kind))

    df = spark.createDataFrame([(1, 'a "b", \n c'), (2, None)], "n int, t string")
    tables = {k: df for k in ("fulltable", "entity", "metrics", "dimension")}
    assert write_all(tables, 2, write) == ["fulltable", "entity", "metrics", "dimension"]
    assert write_all(tables, 2, write) == ["fulltable", "entity", "metrics", "dimension"]
    assert rows(read_csv(spark, csv_path(folder, "base", "entity"), df.schema)) == rows(df)

    empty = fresh_path(spark, "out")
    written = write_all({k: v.filter("false") for k, v in tables.items()}, 0,
                        lambda d, k: write_csv(d, csv_path(empty, "base", k)))
    assert written == ["fulltable", "entity"]
    check = output_check(spark, lambda s, k: read_csv(s, csv_path(empty, "base", k), df.schema)).collect()
    assert [(r["kind"], r["present"], r["rows"]) for r in check] == [
        ("fulltable", True, 0), ("entity", True, 0), ("metrics", False, None), ("dimension", False, None)]


def test_run_stats_use_the_latest_record(spark, rows):
    registry = spark.createDataFrame(
        [(1, "f", "old", "u1"), (9, "f", "new", "u9"), (5, "g", "g", "u")],
        "id int, file_name string, company_name string, uploaded_by string")
    runs = spark.createDataFrame([("f", 10), ("unknown", 1)], "file_name string, rows_count bigint") \
        .withColumn("processed_at", F.lit("2024-01-01").cast("timestamp")).withColumn("status", F.lit("DONE"))
    out = run_stats(registry, runs)
    assert out.columns == ["file_name", "company_name", "uploaded_by", "processed_at", "rows_count", "status"]
    assert rows(out.select("file_name", "company_name", "uploaded_by", "rows_count")) == [("f", "new", "u9", 10)]


def test_intermediate_tables_live_in_the_shared_folder(spark, rows):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert shared_root(spark).startswith(configured.rstrip("/"))
    df = materialize(spark.range(3), "numbers")
    assert rows(df) == [(0,), (1,), (2,)]
    assert df.inputFiles()[0].split("file://")[-1].startswith(shared_root(spark))
    assert materialize(spark.range(3).filter("false"), "none").count() == 0
    assert fresh_path(spark, "a") != fresh_path(spark, "a")
    assert os.path.isdir(shared_root(spark))


def test_shuffles_grow_with_the_input(spark, monkeypatch):
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    df = spark.range(1000)
    with sized_shuffles(df):
        assert spark.conf.get(key) == before
    monkeypatch.setattr(storage, "SHUFFLE_BYTES", 100)
    with pytest.raises(ZeroDivisionError), sized_shuffles(df):
        assert spark.conf.get(key) == "80"
        1 / 0
    assert spark.conf.get(key) == before


def test_staging_spreads_inputs_in_few_pieces_only(spark, monkeypatch, rows):
    few, many = spark.range(0, 1000, 1, 1), spark.range(0, 1000, 1, 16)
    assert stage(few) is few
    monkeypatch.setattr(storage, "BYTES_PER_PIECE", 1000)
    assert stage(few).rdd.getNumPartitions() > 1 and rows(stage(few)) == rows(few)
    assert stage(many) is many
    assert stage(many, always=True) is not many
    void = few.withColumn("v", F.lit(None))
    assert stage(void, always=True) is void


def test_payload_rows_do_not_depend_on_stray_quotes(spark):
    """Rows of empty cells and long cells survive on either way of reading; extra cells are an error on both."""
    long = "y" * 140_000
    for first in ("5", '5"'):
        payload = spark.createDataFrame([(f"a,b\n{first},1\n,\n\n2,{long}\n",)], "file_content string")
        found = [(r.a, r.b) for r in scan_csv_payload(payload).collect()]
        assert sorted(found, key=repr) == sorted([(first, "1"), (None, None), ("2", long)], key=repr)
        wide = spark.createDataFrame([(f"a,b\n{first},2,3\n",)], "file_content string")
        with pytest.raises(Exception, match="more cells than the header"):
            scan_csv_payload(wide).collect()


def test_landing_survives_bad_batches(spark, tmp_path):
    handle = land_rows(land_api_rows, str(tmp_path))
    schema = "id bigint, response string"
    handle(spark.createDataFrame([(1, "oops")], schema), 0)
    handle(spark.createDataFrame([(2, '{"items":[]}'), (3, None)], schema), 1)
    handle(spark.createDataFrame([(4, '[{"batch_id":77,"x":1}]'), (5, "{")], schema), 2)
    assert [(r.batch_id, r.x) for r in landed_rows(spark, str(tmp_path)).collect()] == [("77", "1")]
    assert sorted(r.id for r in rejected(spark, str(tmp_path)).collect()) == [1, 5]


def test_estimates_add_up_over_joins(spark):
    a = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    assert estimated_bytes(a.join(a.withColumnRenamed("o_orderkey", "k"), F.col("o_orderkey") == F.col("k"))) <= (
        2 * estimated_bytes(a))
