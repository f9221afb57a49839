import csv
import random

import pytest
from pyspark.sql import functions as F

from catalogue import io
from tidyloom.config import ROW_SEQ
from tidyloom.sources.files import scan_csv, tag_by_place
from tidyloom.sources.splits import scan_csv_splits


@pytest.fixture
def splits_of(spark):
    keys = {"spark.sql.files.maxPartitionBytes": None, "spark.sql.files.openCostInBytes": "0",
            "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in keys}

    def use(size):
        for k, v in keys.items():
            spark.conf.set(k, v or size)

    yield use
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def found(spark, path):
    df = scan_csv_splits(spark, str(path))
    return [tuple(r) for r in df.orderBy(ROW_SEQ).drop(ROW_SEQ).collect()], df.columns[:-1]


def test_rows_and_order_do_not_depend_on_splits(spark, tmp_path, splits_of):
    rng = random.Random(3)
    cells = ["x", 'say "hi"', "a,b", "two\nlines", "cr\r\nlf", "", "é₹", '"', "more\n\n" * 9, "\n" * 30, ",\n" * 200]
    rows = [(rng.choice(cells), rng.choice(cells), str(i)) for i in range(1500)]
    for name, part in (("b", rows[:1000]), ("a", rows[1000:])):
        with open(tmp_path / f"{name}.csv", "w", newline="", encoding="utf-8") as f:
            f.write("\ufeff" if name == "a" else "\r\n")
            csv.writer(f).writerows([("c 1", "c2", "end"), *part])
    wanted = [tuple(c or None for c in r) for r in rows[1000:] + rows[:1000]]
    for size in ("128m", "20k", "3001"):
        splits_of(size)
        assert found(spark, tmp_path) == (wanted, ["c 1", "c2", "end"])
    tasks = spark.read.text(str(tmp_path), lineSep="\n").rdd.getNumPartitions()
    assert tasks > 20


def test_a_cell_over_several_splits(spark, tmp_path, splits_of):
    long = "line\n" * 2000
    (tmp_path / "t.csv").write_text(f'a,b\n1,"{long}"\n2,"never closed\n{long}end')
    splits_of("1000")
    assert found(spark, tmp_path) == ([("1", long), ("2", f"never closed\n{long}end")], ["a", "b"])


def test_files_of_several_headers(spark, tmp_path):
    (tmp_path / "1.csv").write_text("\n \nx,y\n1,2\n")
    (tmp_path / "2.csv").write_text('"y",z\n3,\n')
    (tmp_path / "3.csv").write_text("")
    assert found(spark, tmp_path) == ([("1", "2", None), (None, "3", None)], ["x", "y", "z"])


def test_stray_quotes_are_noticed(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n5" pipe,1\n6,2\n7" pipe,3\n')
    with pytest.raises(Exception, match="without splits"):
        scan_csv_splits(spark, str(tmp_path)).collect()
    (tmp_path / "t.csv").write_text('a,b\n5" x 6" pipe,1\n')
    assert found(spark, tmp_path)[0] == [('5" x 6" pipe', "1")]
    (tmp_path / "t.csv").write_text(" \n")
    with pytest.raises(ValueError, match="any content"):
        scan_csv_splits(spark, str(tmp_path))


def test_wide_records(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,2,3\n4,5,\n")
    with pytest.raises(Exception, match="more cells"):
        scan_csv_splits(spark, str(tmp_path)).collect()
    kept = scan_csv_splits(spark, str(tmp_path), broken="skip").select(F.col("a"))
    assert [r.a for r in kept.collect()] == ["4"]


def test_sequence_by_place_is_that_of_paths_and_lines(spark, tmp_path, splits_of):
    """Files of different size, empty ones too, packed into one task or cut into many."""
    sizes = {"a": 40, "b": 3000, "c": 0, "d": 900, "e": 1}
    wanted = []
    for name, n in sizes.items():
        lines = [f"{name}{i},{'x' * (i % 50)}" for i in range(n)]
        (tmp_path / f"{name}.csv").write_text("\n".join(["id,t", *lines]) + "\n")
        wanted += [line.split(",")[0] for line in lines]
    for size in ("128m", "20k", "3001"):
        splits_of(size)
        for multi_line in (False, True):
            df = scan_csv(spark, str(tmp_path), infer_schema=False, multi_line=multi_line, by_place=True)
            assert df.columns == ["id", "t", ROW_SEQ]
            assert sorted((r[1], r[0]) for r in df.select("id", ROW_SEQ).collect()) == list(enumerate(wanted))
            assert df.where(F.col("id") == "d899").head()[ROW_SEQ] == 40 + 3000 + 899
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "x.csv").write_text("id,t\n")
    assert scan_csv(spark, str(tmp_path / "none"), by_place=True).count() == 0


def test_rows_by_place_are_not_shuffled(spark):
    df = tag_by_place(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert df.agg(F.min(ROW_SEQ), F.max(ROW_SEQ) + 1, F.countDistinct(ROW_SEQ)).head() == (0, df.count(), df.count())


def test_landing_files_grow_in_number_not_in_size(spark, tmp_path, monkeypatch):
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string"
    rows = [(i // 4, i % 7, i % 3, i % 4, "R" if i % 2 else None) for i in range(900)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(io, "FILE_ROWS", 100)
    found = io.row_sequence_place(spark, str(tmp_path))
    assert len([f for f in found.inputFiles() if f.endswith(".csv")]) == 9
    assert [tuple(r) for r in found.orderBy("seq").collect()] == [
        (a, d, e, i) for i, (a, _, _, d, e) in enumerate(sorted(rows, key=lambda r: (r[0], r[3])))]


def test_places_of_documents_are_found_without_one_task_for_all(spark, tmp_path, monkeypatch):
    rows = [(i, f'a "{i}"\nb,' + "x" * (i % 90), "en", "s", i) for i in range(3000)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(io, "FILE_BYTES", 40_000)
    found = io.csv_splits(spark, str(tmp_path))
    assert "row_number" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((int(r.doc_id), r.text, r.place, r.spread) for r in found.collect()) == [
        (i, t, i + 1, True) for i, t, *_ in rows]
