import math
import random

import pytest
from pyspark.sql import functions as F

import catalogue.cleaning  # noqa: F401  importing fills the registry
from catalogue import REGISTRY

from tidyloom.config import ROW_SEQ, CleanConfig
from tidyloom.operators.columns import (
    drop_empty_columns,
    empty_columns,
    name_mapping,
    normalize_columns,
    project_raw_columns,
)
from tidyloom.operators.dedup import dedup_full, dedup_subset
from tidyloom.operators.impute import impute
from tidyloom.operators.keys import (
    ColumnStats,
    add_surrogate_id,
    detect_key,
    detect_relaxed_id,
    distinct_counts,
    rank_by_cardinality,
    sort_by_key,
)
from tidyloom.operators.outliers import clamp_outliers
from tidyloom.operators.profile import infer_types, profile
from tidyloom.operators import quantiles
from tidyloom.operators.quantiles import approx_quantiles, exact_quantiles
from tidyloom.operators.split import split_tables


def test_names_differing_in_case_stay_apart(spark):
    df = spark.range(1).select(F.lit(1).alias("A"), F.lit(2).alias("a"))
    out = normalize_columns(df)
    assert out.columns == ["a", "a_1"]
    assert tuple(out.head()) == (1, 2)


def test_technical_columns_keep_their_name(spark):
    assert name_mapping(["X y", ROW_SEQ, "x_y"]) == [("X y", "x_y"), (ROW_SEQ, ROW_SEQ), ("x_y", "x_y_1")]


def test_empty_string_is_data_and_no_rows_drop_nothing(spark):
    df = spark.createDataFrame([("", None)], "a string, b string")
    assert empty_columns(df) == ["b"]
    assert drop_empty_columns(df.filter("false")).columns == ["a", "b"]


def test_projection_uses_clean_names(spark):
    df = spark.createDataFrame([(1, 2)], "`Order ID` int, `Other` int")
    names = dict(name_mapping(df.columns))
    assert project_raw_columns(normalize_columns(df), ["Order ID", "gone"], names).columns == ["order_id"]


def _types(spark, values, name="c", kind="string", **config):
    df = spark.createDataFrame([(v,) for v in values], f"`{name}` {kind}")
    typed, inferred = infer_types(df, CleanConfig(**config))
    return inferred[name], [r[0] for r in typed.collect()]


@pytest.mark.parametrize("values, inferred, typed", [
    (["1", "2,000", "x", "4", "5"], "int", [1, 2000, None, 4, 5]),
    (["1", "x", "y"], "string", ["1", "X", "Y"]),
    (["1.5", "₹2"], "float", [1.5, 2.0]),
    (["inf", "1"], "float", [math.inf, 1.0]),
    (["1.0E10", "2"], "int", [10**10, 2]),
    (["1_000", "a"], "string", ["1_000", "A"]),
    ([None, "nan", ""], "string", [None, None, None]),
    (["9" * 40, "1"], "int", [None, 1]),
])
def test_type_inference(spark, values, inferred, typed):
    assert _types(spark, values) == (inferred, typed)


def test_date_inference(spark):
    kind, typed = _types(spark, ["2024-01-02", "02/01/2024", "soon"])
    assert kind == "date" and [str(v) for v in typed] == ["2024-01-02", "2024-01-02", "None"]
    assert _types(spark, ["2024-01-02", "soon", "later"], name="updated_by")[0] == "string"


def test_text_in_a_date_named_column_survives_unless_forced(spark):
    values = ["ann", "bob", "2024-01-02"]
    assert _types(spark, values, name="updated_by") == ("string", ["Ann", "Bob", "2024-01-02"])
    kind, typed = _types(spark, values, name="updated_by", force_date_names=True)
    assert kind == "date" and [v is None for v in typed] == [True, True, False]
    assert _types(spark, ["ann", "bob"], name="updated_by", force_date_names=True) == ("string", [None, None])


def test_typed_sources(spark):
    assert _types(spark, [1, 2], kind="int") == ("int", [1, 2])
    assert _types(spark, [1.0, None], kind="double") == ("int", [1, None])
    assert _types(spark, [1.5, float("nan")], kind="double") == ("float", [1.5, None])
    assert _types(spark, [True, False], kind="boolean") == ("string", ["true", "false"])
    assert _types(spark, [["a"], None], kind="array<string>") == ("string", ["[a]", None])


def test_sample_query_loses_no_late_value(spark, monkeypatch):
    df = spark.range(2000, numPartitions=1).selectExpr("if(id < 1500, cast(id as string), concat(id, '.5')) AS c")
    monkeypatch.setattr("catalogue.cleaning._tidy_upload", lambda *_: df)
    got = REGISTRY["infer_types_sample"].query(spark, "").agg(F.count("c"), F.max("c")).first()
    assert tuple(got) == (2000, 1999.5)


def test_profile_of_wide_tables_takes_several_passes(spark):
    df = spark.range(5).select(*[F.col("id").cast("string").alias(f"c{i}") for i in range(7)])
    found = profile(df, CleanConfig(columns_per_job=3))
    assert [(p.column, p.rows, p.inferred) for p in found] == [(f"c{i}", 5, "int") for i in range(7)]


def test_empty_frame_keeps_types(spark):
    df = spark.createDataFrame([], "a int, b string")
    typed, inferred = infer_types(df)
    assert typed.schema == df.schema and inferred == {"a": "string", "b": "string"}


def _rank(values, p):
    ordered = sorted(values)
    return ordered[max(1, math.ceil(p * len(ordered))) - 1] if ordered else None


@pytest.mark.parametrize("make", [
    lambda rng: [rng.random() for _ in range(3000)],
    lambda rng: [5.0] * 1500 + [rng.random() * 10 for _ in range(1500)],
    lambda rng: sorted(rng.randint(0, 50) for _ in range(3000)),
    lambda rng: [float(i) for i in range(3000)],
    lambda rng: [rng.choice([-1e300, 1e-300, 0.0, 1e300, math.inf]) for _ in range(500)],
    lambda rng: [1.0],
    lambda rng: [],
])
@pytest.mark.parametrize("exact_rows", [1, 10, 10**6])
def test_exact_quantiles(spark, make, exact_rows):
    values = make(random.Random(3))
    wanted = [0.01, 0.25, 0.5, 0.75, 1.0]
    df = spark.createDataFrame([(float(v), i) for i, v in enumerate(values)] + [(None, -1)], "v double, i int")
    got = exact_quantiles(df.repartition(5), {"v": wanted, "i": [0.5]}, exact_rows)
    assert got["v"] == [_rank(values, p) for p in wanted]
    assert got["i"] == [_rank([-1, *range(len(values))], 0.5)]


def test_exact_quantiles_of_clustered_partitions(spark):
    """Each partition holds its own range of values, so brackets over partitions are as wide as they get."""
    df = spark.range(0, 20000, 1, 16).select((F.col("id") * F.col("id")).alias("v"))
    assert exact_quantiles(df, {"v": [0.25, 0.5]}, exact_rows=5) == {"v": [4999.0**2, 9999.0**2]}


@pytest.mark.parametrize("partitions", [16, 64, 1000])
def test_exact_quantiles_take_four_passes_at_most(spark, monkeypatch, partitions):
    """On values in order, each partition a narrow range of them, as on any other."""
    passes = []
    run = quantiles._pass
    monkeypatch.setattr(quantiles, "_pass", lambda df, searches: (passes.append(1), run(df, searches)))
    df = spark.range(0, 40_000, 1, partitions).select(
        (F.col("id") * 1.0).alias("v"), (2000 + F.col("id") / 1e6).alias("near"), F.col("id").alias("i"))
    got = exact_quantiles(df, {"v": [0.25, 0.5], "near": [0.5], "i": [1.0]}, exact_rows=20)
    assert got == {"v": [9999.0, 19999.0], "near": [2000 + 19999 / 1e6], "i": [39999.0]}
    assert len(passes) <= 3


def test_exact_quantiles_of_extreme_values(spark, monkeypatch):
    passes = []
    run = quantiles._pass
    monkeypatch.setattr(quantiles, "_pass", lambda df, searches: (passes.append(1), run(df, searches)))
    odd = [float("-inf"), -1.7e308, -1e-320, -5e-324, 0.0, -0.0, 5e-324, 1e-300, 1.0, math.nextafter(1.0, 2), 1.7e308,
           float("inf")]
    values = sorted([*odd, *[1.0 + i * 2.0**-52 for i in range(200)], *[-1e300 * (1 + i * 2.0**-52) for i in range(50)]])
    df = spark.createDataFrame([(v,) for v in values] + [(float("nan"),), (None,)], "v double").repartition(7)
    shares = [0.0, 0.001, 0.1, 0.3, 0.5, 0.77, 0.999, 1.0]
    got = exact_quantiles(df, {"v": shares}, exact_rows=0)["v"]
    assert got == [values[max(1, math.ceil(p * len(values))) - 1] for p in shares]
    assert len(passes) <= 4


def test_approximate_quantiles_stay_within_their_rank_error(spark):
    df = spark.range(100000).select(((F.col("id") * 7919) % 100000).alias("v"))
    q = approx_quantiles(df, {"v": [0.25, 0.5]}, 0.01)["v"]
    assert all(abs(value - p * 100000) <= 1000 for value, p in zip(q, (0.25, 0.5)))


def test_impute(spark):
    df = spark.createDataFrame(
        [(1, "a", None, None), (2, "b", "x", None), (3, "c", None, "k"), (4, None, None, None), (None,) * 4],
        "amount bigint, town string, rare string, ref string")
    out = impute(df)
    assert [r["amount"] for r in out.collect()] == [1.0, 2.0, 3.0, 4.0, 2.0]
    assert [r["town"] for r in out.collect()] == ["a", "b", "c", "Unknown", "Unknown"]
    assert [r["rare"] for r in out.collect()] == ["NaN", "x", "NaN", "NaN", "NaN"]
    assert [r["ref"] for r in out.collect()] == [None, None, "k", None, None]


def test_half_present_counts_as_sparse(spark):
    df = spark.createDataFrame([("a",), (None,)], "town string")
    assert [r[0] for r in impute(df).collect()] == ["a", "NaN"]


def test_impute_options(spark):
    df = spark.createDataFrame([(1,), (2,), (6,), (None,)], "amount bigint")
    assert [r[0] for r in impute(df, CleanConfig(numeric_impute="mean")).collect()] == [1.0, 2.0, 6.0, 3.0]
    assert [r[0] for r in impute(df, CleanConfig(numeric_impute="none")).collect()] == [1, 2, 6, None]
    assert [r[0] for r in impute(df.filter("amount IS NULL")).collect()] == [None]
    with pytest.raises(ValueError):
        CleanConfig(numeric_impute="mode")


def test_outliers(spark):
    df = spark.createDataFrame([(i,) for i in [*range(1, 11), 100, None]], "amount bigint")
    assert [r[0] for r in clamp_outliers(df).collect()] == [*map(float, range(1, 11)), 18.0, None]
    assert clamp_outliers(df, columns=[]).schema == df.schema
    assert [r[0] for r in clamp_outliers(df.filter("amount IS NULL")).collect()] == [None]


def test_lowest_sequence_survives(spark, rows):
    df = spark.createDataFrame([("a", 1, 5), ("a", 1, 3), ("b", 1, 9), ("a", 2, 1)], f"x string, y int, {ROW_SEQ} bigint")
    assert rows(dedup_full(df)) == [("a", 1, 3), ("a", 2, 1), ("b", 1, 9)]
    assert rows(dedup_subset(df, ["x"])) == [("a", 2, 1), ("b", 1, 9)]
    assert rows(dedup_subset(df, ["gone", ROW_SEQ])) == rows(df)
    assert rows(dedup_subset(df.select("x", "y"), ["y"])) == [("a", 1), ("a", 2)]


def test_dedup_is_the_same_for_any_partitioning(spark, rows):
    df = spark.range(500).select((F.col("id") % 7).alias("a"), (F.col("id") % 3).alias("b"), F.col("id").alias(ROW_SEQ))
    assert rows(dedup_subset(df.repartition(1), ["a"])) == rows(dedup_subset(df.repartition(9), ["a"]))
    assert dedup_full(df).count() == 21


def test_duplicates_that_hold_a_third_of_the_rows_shrink_before_the_shuffle(spark):
    plan = dedup_full(spark.range(10).withColumn(ROW_SEQ, F.col("id")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2 and "partial_min" in plan


def test_keys(spark):
    df = spark.createDataFrame([(1, 10, "a"), (1, 11, "b"), (2, None, "c")], "order_a int, id_b int, ref string")
    assert detect_key(df) == "ref"
    assert detect_key(df.select("order_a", "id_b")) is None
    assert detect_key(df.select("order_a").withColumn(ROW_SEQ, F.lit(1))) == ROW_SEQ
    assert detect_key(df.filter("false")) is None
    assert detect_key(df.select(F.col("ref").alias("name"))) is None


def test_relaxed_id_thresholds(spark):
    df = spark.range(100).select(
        F.when(F.col("id") >= 6, F.col("id")).alias("id_94"), F.when(F.col("id") >= 5, F.col("id")).alias("id_95"))
    assert detect_relaxed_id(df) == "id_95"
    close = spark.range(1000).select((F.col("id") % 899).alias("id_a"), (F.col("id") % 900).alias("id_b"))
    assert detect_relaxed_id(close) == "id_b"


def test_statistics_are_counted_exactly_only_on_demand(spark):
    stats = ColumnStats(spark.range(5000).select("id", (F.col("id") % 4).alias("few")), ["id", "few"])
    assert stats.first_key(["few", "id"], 1.0, 1.0) == "id"
    assert list(stats._exact) == ["id"]


def test_surrogate_ids_are_contiguous_and_follow_the_order(spark):
    df = spark.range(1000).select(F.xxhash64("id").alias("v")).repartition(13)
    out = add_surrogate_id(df, ["v"]).orderBy("v").collect()
    assert [r["auto_id"] for r in out] == list(range(1, 1001))


def test_sort_puts_nulls_first(spark):
    df = spark.createDataFrame([(2,), (None,), (1,)], "k int")
    assert [r[0] for r in sort_by_key(df, "k").collect()] == [None, 1, 2]
    assert sort_by_key(df, None) is df and sort_by_key(df, "gone") is df


def test_cardinality_ties_keep_column_order(spark):
    df = spark.range(40).select(*[
        (F.col("id") % n).cast("string").alias(c) for c, n in (("p", 4), ("q", 2), ("r", 4), ("s", 4), ("t", 30))])
    assert rank_by_cardinality(df) == [("q", 2), ("p", 4), ("r", 4)]


def test_split(spark):
    df = spark.createDataFrame(
        [(i, f"t{i % 2}", f"c{i}", f"d{i}", f"e{i % 3}", 1.5 * i, "10:00") for i in range(20)],
        "order_no int, kind string, c string, d string, e string, amount double, start_time string")
    split = split_tables(df)
    assert split.id_column == "order_no"
    assert split.metrics.columns == ["order_no", "amount", "start_time"]
    assert split.entity.columns == ["order_no", "start_time", "kind", "e"]
    assert split.dimension.columns == ["order_no", "c", "d"]
    empty = split_tables(df.filter("false"))
    assert empty.id_column == "id" and empty.entity.columns == df.columns


def test_split_tables_share_surrogate_ids(spark):
    df = spark.range(200).select(
        F.concat(F.lit("v"), F.col("id").cast("string")).alias("label"), (F.col("id") * 2.0).alias("amount"),
        F.col("id").alias(ROW_SEQ)).repartition(7)
    split = split_tables(df)
    joined = split.entity.join(split.metrics, "auto_id")
    assert joined.filter("label = concat('v', cast(cast(amount / 2 as int) as string))").count() == 200
    assert joined.filter("auto_id = amount / 2 + 1").count() == 200


def test_values_lost_in_the_cast_do_not_shift_the_median(spark):
    df = spark.createDataFrame([(v,) for v in ["1", "2", "3", "9" * 40, "8" * 40, "NaN"]], "amount string")
    typed, inferred = infer_types(df)
    assert inferred == {"amount": "float"}
    df = df.filter("amount != 'NaN'")
    typed, inferred = infer_types(df)
    assert inferred == {"amount": "int"}
    assert sorted(r[0] for r in impute(typed, rows=5, non_null={}).collect()) == [1.0, 2.0, 2.0, 2.0, 3.0]


def test_nan_is_no_value(spark):
    df = spark.createDataFrame([(v,) for v in [1.0, 2.0, 3.0, math.nan, math.nan]], "v double")
    for exact_rows in (1, 100):
        assert exact_quantiles(df, {"v": [0.5, 1.0]}, exact_rows) == {"v": [2.0, 3.0]}
    assert approx_quantiles(df, {"v": [0.5]}, 0.01) == {"v": [2.0]}


def test_distinct_counts_expand_no_rows(spark):
    df = spark.range(1000).select(*[(F.col("id") % (i + 2)).alias(f"c{i}") for i in range(10)], F.lit(None).cast("int").alias("void"))
    found = distinct_counts(df, df.columns)
    assert "Expand" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r["column"]: r["n"] for r in found.collect()} == {f"c{i}": i + 2 for i in range(10)} | {"void": 0}


def test_subset_dedup_sorts_no_rows(spark, rows):
    """Late materialization: numbers are aggregated by hash, and a key of a third of all rows joins nothing."""
    df = spark.range(9000).select((F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string"))).alias("k"),
                                  F.repeat(F.lit("wide "), 50).alias("text"), (9000 - F.col("id")).alias(ROW_SEQ))
    kept = dedup_subset(df, ["k"])
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
    assert kept.count() == 6001 and kept.where("k = 'hot'").select(ROW_SEQ).collect()[0][0] == 3
