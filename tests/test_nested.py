import json
import random

import pytest
from pyspark.sql import functions as F

from tidyloom import storage
from tidyloom.config import ROW_SEQ
from tidyloom.operators import nested
from tidyloom.operators.nested import (
    _distinct_names, explode_arrays, flatten_json, flatten_records, flatten_structs, invalid_payloads, json_growth,
    record_items, variant_type, wide_objects,
)
from tidyloom.sources.files import json_rejects, scan_json
from tidyloom.sources.payloads import scan_csv_payload


def flat(spark, *payloads, **options):
    df = spark.createDataFrame([(p,) for p in payloads], "doc string")
    return flatten_json(df, "doc", **options)


def test_document(spark, rows):
    doc = {"meta": 1, "items": [
        {"id": 1, "a": {"b": 2}, "tags": ["x", "y"], "ln": [{"k": 1, "g": {"h": 5}}, {"k": 2}]},
        {"id": 2, "tags": [], "ln": None}]}
    df = flat(spark, json.dumps(doc))
    assert df.columns == ["id", "a_b", "tags", "ln_k", "ln_g_h"]
    assert rows(df.select("id", "a_b", "tags", "ln_k", "ln_g_h")) == [
        (1, 2, "x", 1, 5), (1, 2, "x", 2, None), (1, 2, "y", 1, 5), (1, 2, "y", 2, None), (2, None, None, None, None)]


def test_scalars_and_empty_lists(spark, rows):
    assert rows(flat(spark, "[1, 2]")) == [(1,), (2,)]
    assert rows(flat(spark, "3")) == [(3,)]
    assert rows(flat(spark, "null")) == [(None,)]
    assert flat(spark, '{"items": []}').count() == 0
    assert flat(spark, None, "{broken").count() == 0


def test_an_object_under_a_record_key_is_no_record_list(spark, rows):
    df = flat(spark, '{"data": {"x": 1}, "y": 2}')
    assert df.columns == ["data_x", "y"] and rows(df) == [(1, 2)]


def test_columns_follow_the_document(spark):
    df = flat(spark, '[{"z": 1, "a": 2}]', '[{"m": 3, "z": 4}]')
    assert df.columns == ["z", "a", "m"]
    assert flat(spark, '{"z": 1, "b": {"y": 1, "c": 2}, "a": 2}').columns == ["z", "b_y", "b_c", "a"]
    assert flat(spark, '{"items": [{"l": [{"y": [{"q": 1, "p": NaN}], "x": 1}]}]}').columns == ["l_x", "l_y_q", "l_y_p"]
    assert flat(spark, '{"z": 1, "a": 2}', document_order=False).columns == ["a", "z"]


def test_keys_with_odd_characters(spark, rows):
    df = flat(spark, json.dumps({'we"ird k`ey': 1, "it's": 2, "dotted.name": {"x y": 3}, "A": 4, "a": 5}))
    assert df.columns == ["weird_key", "its", "dottedname_x_y", "a", "a_1"]
    assert rows(df) == [(1, 2, 3, 4, 5)]


def test_records_that_disagree(spark, rows):
    df = flat(spark, '[{"m": 1}, {"m": [1, {"p": 2}]}, {"m": {"p": 3, "q": [7, 8]}}, {"m": [[4], 5]}, {}]')
    assert df.columns == ["m", "m_p", "m_q"]
    assert rows(df) == sorted([("1", None, None), ("1", None, None), (None, 2, None), (None, 3, 7), (None, 3, 8),
                               ("4", None, None), ("5", None, None), (None, None, None)], key=repr)


def test_numbers_keep_their_kind(spark):
    df = flat(spark, '[{"i": 1, "f": 1.5, "m": 1, "b": true, "big": 1e3}, {"i": 2, "f": 2, "m": 2.5}]')
    assert dict(df.dtypes) == {"i": "bigint", "f": "double", "m": "double", "b": "boolean", "big": "double"}


def test_name_clashes_after_flattening(spark):
    df = flat(spark, '{"a_b": 1, "a": {"b": 2}}')
    assert sorted(df.columns) == ["a_b", "a_b_1"] and sorted(df.head()) == [1, 2]


def test_kept_columns_travel_along(spark, rows):
    df = spark.createDataFrame([(7, "[1, 2]"), (8, "bad")], "id int, doc string")
    assert rows(flatten_json(df, "doc", keep=["id"])) == [(7, 1), (7, 2)]
    assert rows(invalid_payloads(df, "doc")) == [(8, "bad")]


def test_typed_columns(spark, rows):
    df = spark.createDataFrame(
        [(1, (2, [(1, [3, 4]), (2, [])]), ["x"])],
        "id int, a struct<b: int, c: array<struct<d: int, e: array<int>>>>, t array<string>")
    assert flatten_structs(df).columns == ["id", "a_b", "a_c", "t"]
    out = explode_arrays(df)
    assert out.columns == ["id", "a_b", "t", "a_c_d", "a_c_e"]
    assert rows(out) == [(1, 2, "x", 1, 3), (1, 2, "x", 1, 4), (1, 2, "x", 2, None)]


def test_flattening_many_records_is_one_scan_per_pass(spark):
    payload = F.to_json(F.struct(F.col("id"), F.array("id", F.col("id") + 1).alias("l")))
    df = spark.range(1000).select(payload.alias("doc"))
    assert flatten_json(df, "doc").agg(F.sum("id"), F.sum("l")).head() == (999000, 1000000)


def test_lenient_documents(spark, rows):
    payloads = ['[{"a": 1, "a": 2}, {"a": 3}]', '{"a": 5, "b": NaN}', "{broken", "", None, "{'a': 1}"]
    df = spark.createDataFrame([(p,) for p in payloads], "doc string")
    assert rows(flatten_json(df, "doc").select("a")) == [(2,), (3,), (5,)]
    assert rows(invalid_payloads(df, "doc")) == [("{'a': 1}",), ("",), ("{broken",)]
    with pytest.raises(Exception, match="no valid JSON"):
        flatten_json(df, "doc", document_order=False, broken="error").collect()


def test_a_document_above_the_limit_of_one_variant_loses_no_record(spark, tmp_path):
    (tmp_path / "large.json").write_text(
        '{"records": [' + ",".join('{"i": %d, "t": "%s"}' % (i, "x" * 20_000) for i in range(7_000)) + "]}")
    df = scan_json(spark, str(tmp_path / "large.json"))
    assert df.select(F.count("*"), F.sum("i"), F.min(F.length("t"))).head() == (7000, 6999 * 3500, 20_000)
    assert json_rejects(spark, str(tmp_path / "large.json")).count() == 0


@pytest.mark.parametrize("piece", [storage.BYTES_PER_PIECE, 1 << 60])
def test_order_is_the_same_staged_or_not(spark, tmp_path, monkeypatch, piece):
    monkeypatch.setattr(storage, "BYTES_PER_PIECE", piece)
    lines = [json.dumps({"zeta": i, "order_a": i, "sub": {"y": i, "b": "x" * 300}, "l": [2 * i, 2 * i + 1], "id_b": i})
             for i in range(3000)]
    lines[1500] = '{"last": 1, "zeta": 1500, "order_a": 1500, "l": [3000, 3001], "id_b": 1500}'
    (tmp_path / "doc.json").write_text("\n".join(lines))
    df = scan_json(spark, str(tmp_path / "doc.json"), lines=True)
    assert df.columns == ["zeta", "order_a", "sub_y", "sub_b", "l", "id_b", "last", ROW_SEQ]
    assert [r["l"] for r in df.orderBy(ROW_SEQ).select("l").collect()] == list(range(6000))


@pytest.mark.parametrize("piece", [storage.BYTES_PER_PIECE, 1 << 60])
def test_csv_payload_rows_keep_their_order(spark, monkeypatch, piece):
    monkeypatch.setattr(storage, "BYTES_PER_PIECE", piece)
    payloads = [("a,b\n" + "\n".join(f"{k * 500 + i},{'y' * 40}" for i in range(500)),) for k in range(60)]
    df = scan_csv_payload(spark.createDataFrame(payloads, "file_content string").coalesce(1))
    assert [int(r["a"]) for r in df.orderBy(ROW_SEQ).select("a").collect()] == list(range(30_000))


def test_growth_is_the_number_of_rows(spark):
    docs = ['{"a": [1, 2, 3], "b": [{"c": [1, 2]}, {"c": []}, {}], "d": 1}', '{"a": [], "b": null}', '{"a": 5}', "7", '[{"a": [[1, 2], 3]}, {}]']
    df = spark.createDataFrame(list(enumerate(docs)), "i int, t string")
    for some in (docs, docs[:2], docs[:3]):
        part = df.where(F.col("i") < len(some))
        told = {(r.i, r.record): r["rows"] for r in json_growth(part, "t", ["i"]).collect()}
        records = record_items(part, "t", ["i"])
        made = flatten_records(records, keep=["i", "__record_pos"]).groupBy("i", "__record_pos").count().collect()
        assert told == {(r.i, r["__record_pos"]): r["count"] for r in made}


def test_a_heavy_record_is_dealt_over_tasks(spark, rows):
    one = spark.range(2).select("id", F.when(F.col("id") == 0, F.sequence(F.lit(1), F.lit(200))).otherwise(F.array(F.lit(1))).alias("a"),
                                F.sequence(F.lit(1), F.lit(300)).alias("b"), F.array(F.struct(F.lit(1).alias("x"))).alias("c")).coalesce(1)
    flat = explode_arrays(one, heavy=1000)
    assert flat.columns == explode_arrays(one).columns and rows(flat) == rows(explode_arrays(one))
    tasks = flat.where("id = 0").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(tasks) > 3 and max(r["count"] for r in tasks) < 200 * 300 / 2


def test_a_million_keys_become_rows(spark, monkeypatch):
    keys = F.transform(F.sequence(F.lit(0), F.lit(99)), lambda j: F.concat(F.lit("k"), F.col("id") * 100 + j))
    users = F.map_from_arrays(keys, F.transform(F.sequence(F.lit(0), F.lit(99)), lambda j: F.col("id") + j))
    docs = spark.range(0, 10_000, 1, 8).select(F.to_json(F.struct("id", users.alias("users"))).alias("doc"))
    seen = []
    monkeypatch.setattr("tidyloom.operators.nested.variant_type", lambda df, c: seen.append(variant_type(df, c)) or seen[-1])
    df = flatten_json(docs, "doc")
    assert df.columns == ["id", "users_key", "users_value"]
    assert df.agg(F.count("*"), F.countDistinct("users_key"), F.sum("users_value")).head() == (
        1_000_000, 1_000_000, 100 * (9_999 * 5_000) + 10_000 * 4_950)
    assert max(len(t.simpleString()) for t in seen) < 100, "no type with a field per key came to the driver"


def test_maps_of_odd_values(spark, rows):
    docs = ['{"id": 1, "m": {"a": 1, "b": 2, "c": 3, "d": 4}}', '{"id": 2, "m": {}}', '{"id": 3}', '{"id": 4, "m": null}',
            '{"id": 5, "m": 7}', '{"id": 6, "m": {"e": null, "f\\"g": 5}}']
    expected = [(1, "a", 1), (1, "b", 2), (1, "c", 3), (1, "d", 4), (2, None, None), (3, None, None), (4, None, None),
                (5, None, 7), (6, "e", None), (6, 'f"g', 5)]
    df = flat(spark, *docs, map_width=3)
    assert df.columns == ["id", "m_key", "m_value"] and sorted(rows(df), key=str) == sorted(expected, key=str)
    listed = flat(spark, *docs, '{"id": 7, "m": [{"x": 1}, 2, {}]}', map_width=3)
    more = [(7, "x", 1), (7, None, 2), (7, None, None)]
    assert listed.columns == df.columns and sorted(rows(listed), key=str) == sorted(expected + more, key=str)
    assert flat(spark, *docs, map_width=None).columns == ["id", "m", "m_a", "m_b", "m_c", "m_d", "m_e", "m_fg"]
    assert flat(spark, "[]", map_width=0).count() == 0


def test_map_rows_keep_the_order_of_payloads(spark):
    docs = spark.range(0, 600, 1, 6).select(F.to_json(F.create_map(
        F.concat(F.lit("a"), "id"), "id", F.concat(F.lit("b"), "id"), "id")).alias("doc"))
    df = flatten_json(docs, "doc", tag=True, map_width=50)
    assert [r["value"] for r in df.orderBy(ROW_SEQ).collect()] == [i // 2 for i in range(1200)]


def test_records_that_are_maps(spark, rows):
    docs = ['{"u1": {"n": 1}, "u2": {"n": 2}, "u3": {"n": 3, "t": [1, 2]}, "u4": 5}', "7", '["x"]']
    df = flat(spark, *docs, map_width=3)
    assert df.columns == ["key", "value", "value_n", "value_t"]
    assert sorted(rows(df), key=str) == sorted([
        ("u1", None, 1, None), ("u2", None, 2, None), ("u3", None, 3, 1), ("u3", None, 3, 2), ("u4", "5", None, None),
        ("value", "7", None, None), ("value", "x", None, None)], key=str)


def test_maps_in_lists_and_in_maps(spark, rows):
    """Random records against plain loops; keys hold whatever JSON allows."""
    rng = random.Random(4)

    def name():
        return "".join(rng.choice('ab/:"\\ é*\n') for _ in range(rng.randint(1, 6)))

    docs = [{"id": i, "inner": {"list": [{"m": {name(): {"n": {name(): rng.randint(0, 9) for _ in range(3)}, "s": name()}
                                                for _ in range(3)}} for _ in range(2)], "x": name()}} for i in range(30)]
    expected = [(d["id"], d["inner"]["x"], k, v["s"], j, w) for d in docs for item in d["inner"]["list"]
                for k, v in item["m"].items() for j, w in v["n"].items()]
    df = flat(spark, *map(json.dumps, docs), map_width=20)
    part = df.select("id", "inner_x", "inner_list_m_key", "inner_list_m_value_s", "inner_list_m_value_n_key",
                     "inner_list_m_value_n_value")
    assert len(df.columns) == 6 and sorted(map(tuple, part.collect())) == sorted(expected)
    records = record_items(spark.createDataFrame([(json.dumps(d),) for d in docs], "doc string"), "doc")
    assert len(wide_objects(records, F.col("__record"), 20)) == 2
    assert len(wide_objects(records, F.col("__record"), 100_000)) == 0
    names = {k for d in docs for item in d["inner"]["list"] for k, v in item["m"].items() for k in (k, *v["n"])}
    assert _distinct_names(records, F.col("__record")) > 0.85 * len(names)


def test_payloads_are_parsed_once(spark):
    flat = flatten_json(spark.range(9).select(F.concat(F.lit("["), F.col("id").cast("string"), F.lit("]")).alias("t")), "t")
    assert flat.inputFiles() and "Range" not in flat._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.value for r in flat.collect()) == list(range(9))


def test_lists_are_looked_for_in_texts_that_may_have_one(spark):
    texts = ['{"data": [1, 2], oops', '{"data": "\\u005b3]", oops', "{oops 5", None, "[4, oops", '{"items": 7} x']
    found = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.coalesce(F.from_json("t", nested._LIST, nested._STRICT), *[
        F.from_json(F.get_json_object("t", f"$.{key}"), nested._LIST, nested._STRICT) for key in nested.RECORD_KEYS])
    assert found.where(~F.to_json(nested._listed(F.col("t"))).eqNullSafe(F.to_json(plain))).isEmpty()
    assert "Contains" in found.select(nested._listed(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
