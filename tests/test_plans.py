from pyspark.sql import functions as F

from tidyloom import CleanConfig, clean, run_pipeline
from tidyloom.config import ROW_SEQ
from tidyloom.operators.columns import tag_rows
from tidyloom.operators.dedup import dedup_full
from tidyloom.plans.pipeline import csv_opener, csv_writer
from tidyloom.plans.records import finished_runs, run_records
from tidyloom.sinks.runlog import log_runs, read_run_log
from tidyloom.sinks.tables import csv_path, output_check, read_csv, write_catalog
from tidyloom.storage import fresh_path
from tidyloom.streaming.ingest import (
    api_stream,
    dataset_status,
    file_stream,
    land_api_rows,
    land_rows,
    landed_rows,
    run_datasets,
    start,
)

UPLOAD = [
    ("1", " ann ", "01/02/2024", "$10", None, "k"),
    ("2", '"bob"', "2024-03-04", "20.5", "", "k"),
    ("2", "bob", "2024-03-04", "20.5", None, "k"),
    ("3", "None", "soon", None, None, "k"),
    ("4", "cy", "05/06/2024", "1,000", None, None),
]
SCHEMA = "`Order ID` string, `Name` string, `Due Date` string, Amount string, blank string, Kind string"


def upload(spark):
    return tag_rows(spark.createDataFrame(UPLOAD, SCHEMA).coalesce(1))


def test_clean(spark, rows):
    result = clean(upload(spark))
    assert rows(result.df.drop(ROW_SEQ)) == [
        (1, "Ann", "2024-02-01", 10.0, "NaN", "K"), (2, "Bob", "2024-03-04", 20.5, "NaN", "K"),
        (3, "Unknown", "Unknown", 20.5, "NaN", "K"), (4, "Cy", "2024-06-05", 1000.0, "NaN", "Unknown")]
    report = result.report
    assert (report.rows_in, report.rows_out, report.full_duplicates, report.subset_duplicates) == (5, 4, 1, 0)
    assert report.inferred == {"order_id": "int", "name": "string", "due_date": "date", "amount": "float",
                               "blank": "string", "kind": "string"}
    assert report.final_types["due_date"] == "string" and report.final_types["amount"] == "double"


def test_empty_columns_go_only_if_asked(spark):
    df = upload(spark).withColumn("Void", F.lit(None).cast("string"))
    assert "void" not in clean(df).df.columns and clean(df).report.dropped_columns == ["void"]
    assert "void" in clean(df, CleanConfig(drop_empty_columns=False)).df.columns


def test_row_sequence_is_left_alone(spark):
    df = clean(upload(spark)).df
    assert dict(df.dtypes)[ROW_SEQ] == "bigint"
    assert sorted(r[0] for r in df.select(ROW_SEQ).collect()) == [0, 1, 3, 4]


def test_subset_and_outliers(spark):
    result = clean(upload(spark), dedupe_subset=["kind", "gone"], remove_outliers=True)
    assert result.report.subset_duplicates == 2 and result.report.rows_out == 2
    assert dict(result.df.dtypes)["order_id"] == "double"


def test_cleaning_twice_changes_nothing(spark, rows):
    once = clean(upload(spark).drop("blank")).df
    assert rows(clean(once).df) == rows(once)


def test_partitioning_does_not_matter(spark, rows):
    df = upload(spark)
    assert rows(clean(df.repartition(4, "Name")).df) == rows(clean(df).df)


def test_empty_upload(spark):
    result = run_pipeline(upload(spark).filter("false"))
    assert result.report.rows_out == 0 and result.id_column == "id" and result.key is None
    assert result.full.count() == 0


def test_one_row_of_nulls(spark):
    df = spark.createDataFrame([(None, None)], "a string, b int")
    result = clean(df)
    assert result.df.columns == [] and result.report.rows_out == 1
    assert [tuple(r) for r in clean(df, CleanConfig(drop_empty_columns=False)).df.collect()] == [("NaN", "NaN")]


def test_run(spark, rows):
    folder = fresh_path(spark, "runs")
    result = run_pipeline(upload(spark), [csv_writer(folder, "orders")])
    assert (result.id_column, result.key) == ("order_id", "order_id")
    assert result.written == ["fulltable", "entity", "metrics", "dimension"]
    assert result.tables["metrics"].columns == ["order_id", "due_date", "amount"]
    assert result.tables["entity"].columns == ["order_id", "blank", "kind", "name"]
    assert result.tables["dimension"].columns == ["order_id"]
    check = output_check(spark, csv_opener(folder, "orders")).collect()
    assert [(r["present"], r["rows"]) for r in check] == [(True, 4)] * 4
    lines = spark.read.text(csv_path(folder, "orders", "metrics")).collect()
    assert [r[0] for r in lines] == ["order_id,due_date,amount", "1,2024-02-01,10.0", "2,2024-03-04,20.5",
                                     "3,Unknown,20.5", "4,2024-06-05,1000.0"]


def test_run_without_an_id(spark, rows):
    df = tag_rows(spark.range(60).select((F.col("id") % 50).alias("amount"), (F.col("id") % 50).cast("string")
                                         .alias("label")).repartition(5))
    result = run_pipeline(df)
    assert (result.id_column, result.key) == ("auto_id", ROW_SEQ)
    assert result.full.columns == ["amount", "label"]
    joined = result.tables["entity"].join(result.tables["metrics"], "auto_id").collect()
    assert sorted(r["auto_id"] for r in joined) == list(range(1, 51))
    assert len(joined) == 50


def test_api_datasets_have_no_sequence_and_no_key(spark):
    df = spark.createDataFrame([(1.5, "a"), (2.5, "b")], "amount double, label string")
    result = run_pipeline(df)
    assert (result.id_column, result.key) == ("auto_id", None)
    assert result.full.columns == ["amount", "label"]


def test_run_over_nothing_but_nulls(spark):
    df = spark.createDataFrame([(None,), (None,)], "a string")
    result = run_pipeline(tag_rows(df))
    assert result.key == ROW_SEQ and result.id_column == "auto_id"
    assert [r[0] for r in result.tables["metrics"].collect()] == [1]
    assert result.report.full_duplicates == 1
    assert dedup_full(tag_rows(df).select(ROW_SEQ).filter("false")).count() == 0


def test_a_hot_row_and_a_hot_key(spark, rows):
    """Half of the rows are copies of one, and one key holds most of the rest."""
    df = tag_rows(spark.range(6000).select(
        F.when(F.col("id") < 3000, F.lit("same")).otherwise(F.concat(F.lit("row "), F.col("id").cast("string")))
        .alias("label"),
        F.when(F.col("id") < 5900, F.lit(1)).otherwise(F.col("id")).cast("string").alias("customer no"),
    ))
    report = clean(df, dedupe_subset=["customer_no"]).report
    assert (report.rows_in, report.full_duplicates, report.subset_duplicates, report.rows_out) == (6000, 2999, 2900, 101)


def test_dates_of_id_columns_become_text_in_split_tables_only(spark):
    df = spark.createDataFrame([(str(i), f"2024-01-0{i}") for i in range(1, 6)], "id string, `Order Date` string")
    result = run_pipeline(df)
    assert dict(result.full.dtypes)["order_date"] == "date"
    assert dict(result.tables["metrics"].dtypes)["order_date"] == "string"


def test_split_tables_read_only_their_columns(spark):
    result = run_pipeline(upload(spark))
    plan = result.tables["metrics"]._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<order_id:bigint,due_date:string,amount:double>" in plan


def test_registry_records(spark, tmp_path, rows):
    (tmp_path / "on disk.csv").write_text("Order ID,Name\n5,eve\n")
    write_catalog(spark.createDataFrame([(1, "ann"), (2, "bob")], "`Order ID` int, `Full Name` string"), "uploaded",
                  fresh_path(spark, "uploaded"))
    write_catalog(spark.range(0), "no_rows", fresh_path(spark, "no_rows"))
    registry = spark.createDataFrame([
        (1, "people.csv", None, None, b"Order ID,Name\n1,ann\n1,ann\n2,bob\n", "acme", "me"),
        (2, "disk.csv", str(tmp_path / "on disk.csv"), None, None, "acme", "me"),
        (3, "shown.csv", "MULTI_UPLOAD", "uploaded", None, "acme", "me"),
        (4, "x.csv", "MULTI_UPLOAD", None, None, "acme", "me"),
        (5, "y.csv", "MULTI_UPLOAD", "no_rows", None, "acme", "me"),
        (6, "gone.csv", str(tmp_path / "gone.csv"), None, None, "acme", "me"),
        (7, None, str(tmp_path / "on disk.csv"), None, None, "acme", "me"),
        (8, "nothing.csv", None, None, None, "acme", "me"),
        (9, "book.xlsx", "book.xlsx", None, None, "acme", "me"),
    ], "id int, file_name string, file_path string, table_name string, file_content binary, company_name string, "
       "uploaded_by string")
    out = fresh_path(spark, "datasets")
    status = run_records(registry, out)
    found = {int(r["record"]): (r["dataset"], r["status"], r["rows_count"]) for r in status.collect()}
    assert found[1] == ("people", "DONE", 3) and found[2] == ("disk", "DONE", 1) and found[3] == ("uploaded", "DONE", 2)
    assert {found[i][1] for i in range(4, 10)} == {"ERROR"}
    assert rows(read_csv(spark, csv_path(out, "people", "fulltable"))) == [("1", "Ann"), ("2", "Bob")]
    assert read_csv(spark, csv_path(out, "uploaded", "fulltable")).columns == ["order_id", "full_name"]
    log = fresh_path(spark, "log")
    for _ in range(2):
        log_runs(registry, finished_runs(status, registry), log, 7)
    assert rows(read_run_log(spark, log).select("file_name", "company_name", "rows_count", "status")) == [
        ("disk.csv", "acme", 1, "DONE"), ("people.csv", "acme", 3, "DONE")]


def api_landing(spark, records):
    path = fresh_path(spark, "landing")
    df = spark.createDataFrame(records, "id bigint, file_name string, response string, status string")
    df.coalesce(1).write.json(path)
    return path


def test_stream_lands_each_record_once(spark, rows):
    path = api_landing(spark, [(1, "a", '[{"x": 1}]', "NEW"), (2, "b", '[{"x": "t", "y": 2}]', "NEW"),
                               (3, "c", '[{"x": 9}]', "DONE"), (4, "d", None, "NEW"), (5, "e", "oops", "NEW")])
    out, checkpoint = fresh_path(spark, "rows"), fresh_path(spark, "checkpoint")

    def ingest():
        start(api_stream(spark, path), land_rows(land_api_rows, out), checkpoint, available_now=True).awaitTermination()

    ingest()
    ingest()
    assert rows(landed_rows(spark, out).select("x", "y")) == [("1", None), ("t", "2")]
    more = spark.createDataFrame([(6, "f", '[{"x": 5, "z": true}]', "NEW")],
                                 "id bigint, file_name string, response string, status string")
    more.coalesce(1).write.mode("append").json(path)
    ingest()
    assert rows(landed_rows(spark, out).select("x", "y", "z")) == sorted(
        [("1", None, None), ("t", "2", None), ("5", None, "true")], key=repr)


def test_one_bad_dataset_does_not_stop_the_others(spark, rows):
    path = api_landing(spark, [
        (1, "a.json", '[{"id": 1, "v": "x"}, {"id": 2, "v": "y"}]', "NEW"), (2, "bad.json", "{oops", "NEW"),
        (3, None, '{"data": [{"v": 1}]}', "NEW"), (4, "a.json", '[{"id": 7, "v": "z"}]', "NEW"),
        (5, "none.json", None, "NEW")])
    out = fresh_path(spark, "datasets")
    start(api_stream(spark, path), run_datasets(out), fresh_path(spark, "checkpoint"), available_now=True) \
        .awaitTermination()
    status = {r["record"]: (r["dataset"], r["status"], r["rows_count"]) for r in dataset_status(spark, out).collect()}
    assert status == {"1": ("a", "DONE", 2), "2": ("bad", "ERROR", None), "3": ("api_3", "DONE", 1),
                      "4": ("a", "DONE", 1), "5": ("none", "ERROR", None)}
    assert rows(read_csv(spark, csv_path(out, "a", "fulltable"))) == [("7", "Z")]


def test_file_batch(spark, tmp_path, rows):
    (tmp_path / "orders.csv").write_text("Order ID,Name\n1,ann\n2,bob\n2,bob\n")
    (tmp_path / "doc.json").write_text('{"items": [{"a": 1}, {"a": 2}]}')
    out = fresh_path(spark, "datasets")
    start(file_stream(spark, str(tmp_path)), run_datasets(out), fresh_path(spark, "checkpoint"), available_now=True) \
        .awaitTermination()
    assert {(r["dataset"], r["status"], r["rows_count"]) for r in dataset_status(spark, out).collect()} == {
        ("orders", "DONE", 3), ("doc", "DONE", 2)}
    assert rows(read_csv(spark, csv_path(out, "orders", "fulltable"))) == [("1", "Ann"), ("2", "Bob")]


def test_responses_of_any_length_pass_the_stream(spark, rows):
    path = fresh_path(spark, "landing")
    long = F.concat(F.lit('[{"x": "'), F.repeat(F.lit("y"), 21_000_000), F.lit('"}]'))
    spark.range(1).select("id", long.alias("response"), F.lit("NEW").alias("status")).write.json(path)
    out = fresh_path(spark, "lengths")
    start(api_stream(spark, path), lambda batch, _: batch.select(F.length("response").alias("n")).write.parquet(out),
          fresh_path(spark, "checkpoint"), available_now=True).awaitTermination()
    assert rows(spark.read.parquet(out)) == [(21_000_011,)]


def test_pages_of_a_response_are_one_record(spark, rows):
    registry = spark.createDataFrame([
        (1, "a.json", '[{"x": 1}, {"x": 2}]', 0), (1, "a.json", '[{"x": 3}]', 1), (1, "a.json", '[{"x": 9, "y": 4}]', 2),
        (2, "b.json", '[{"x": 1}]', 0), (2, "b.json", "oops", 1), (3, "c.json", '[{"x": 1}]', 0), (3, "c.json", None, 1),
        (4, "d.json", '[{"x": 1}]', None), (4, "d.json", '[{"x": 5}]', None),
    ], "id long, file_name string, response string, page long").repartition(3)
    out = fresh_path(spark, "paged")
    status = run_records(registry, out)
    assert rows(status.select("record", "status", "rows_count")) == [
        ("1", "DONE", 4), ("2", "ERROR", None), ("3", "ERROR", None), ("4", "DONE", 1), ("4", "DONE", 1)]
    assert rows(read_csv(spark, csv_path(out, "a", "fulltable")).selectExpr("cast(x as double)")) == [(1.0,), (2.0,), (3.0,), (9.0,)]
    found = finished_runs(status, registry.withColumn("file_path", F.lit(None).cast("string"))).where("file_name = 'a.json'")
    assert found.count() == 1
