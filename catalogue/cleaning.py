"""Profile, types, gaps, outliers, duplicates, and the whole cleaning plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue import load, register
from catalogue.dirty import UPLOAD_FILLED, UPLOAD_ROWS, UPLOAD_TYPED, messy_orders, select_upload
from tidyloom.config import ROW_SEQ, CleanConfig
from tidyloom.operators.columns import drop_empty_columns, drop_noise_named, drop_technical, normalize_columns
from tidyloom.operators.dedup import dedup_full, dedup_report, dedup_subset
from tidyloom.operators.impute import impute
from tidyloom.operators.outliers import clamp_outliers
from tidyloom.operators.profile import infer_types, profile_frame
from tidyloom.operators.quantiles import exact_quantiles
from tidyloom.plans.clean import clean
from tidyloom.storage import stage


def _tidy_upload(spark, sf_dir):
    return drop_empty_columns(stage(drop_noise_named(normalize_columns(messy_orders(spark, sf_dir)))))


_PROFILE = """
    SELECT '{name}' AS "column", count(*) AS rows, count(*) FILTER ({present}) AS present,
           count(*) FILTER ({non_null}) AS non_null, count(*) FILTER ({numbers}) AS numbers,
           CAST({all_int} AS BOOLEAN) AS all_int, count(*) FILTER ({dates}) AS dates, '{inferred}' AS inferred
    FROM """ + UPLOAD_ROWS


def _profile_sql(name, non_null, inferred, present="true", numbers="false", all_int="false", dates="false"):
    return _PROFILE.format(**locals())


@register("profile_columns", " UNION ALL ".join([
    _profile_sql("order_key", "true", "int", numbers="true", all_int="true"),
    _profile_sql("orderstatus", "true", "string"),
    _profile_sql("total_price_", "o_orderkey % 5 > 0", "float", numbers="o_orderkey % 5 > 0"),
    _profile_sql("purchase_date", "true", "date", dates="o_orderkey % 8 < 7"),
    _profile_sql("priority", "true", "string"),
    _profile_sql("cust_no", "o_orderkey % 10 <> 3", "int", present="o_orderkey % 10 <> 3",
                 numbers="o_orderkey % 10 <> 3", all_int="true"),
    _profile_sql("remark", "o_orderkey % 3 = 0", "string"),
    _profile_sql("remark_1", "o_orderkey % 4 > 0", "string", present="o_orderkey % 4 > 0"),
]))
def profile_columns(spark, sf_dir):
    return profile_frame(_tidy_upload(spark, sf_dir))


@register("infer_types", select_upload(UPLOAD_TYPED, UPLOAD_ROWS))
def infer(spark, sf_dir):
    return infer_types(_tidy_upload(spark, sf_dir))[0].drop(ROW_SEQ)


@register("infer_types_sample", select_upload(UPLOAD_TYPED, UPLOAD_ROWS))
def infer_sample(spark, sf_dir):
    """What the reference types from a sample, typed from all rows, so that no value is lost."""
    return infer_types(_tidy_upload(spark, sf_dir))[0].drop(ROW_SEQ)


@register("force_date_names", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderdate AS DATE) END AS ship_date,
           CASE WHEN o_orderkey % 5 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'Later' END AS ship_text
    FROM orders""")
def forced_dates(spark, sf_dir):
    """Too few dates for a date column, but one of the columns says by its name that it is one."""
    mostly_text = F.when(F.col("o_orderkey") % 5 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("later")
    orders = load(spark, sf_dir, "orders").select(
        "o_orderkey", mostly_text.alias("ship_date"), mostly_text.alias("ship_text"))
    return infer_types(orders, CleanConfig(force_date_names=True))[0]


@register("impute_median", """
    SELECT l_orderkey, l_linenumber * 1.0::DOUBLE AS l_linenumber,
           CASE WHEN l_linenumber = 2 THEN (SELECT quantile_disc(l_extendedprice, 0.5) FROM lineitem
                                            WHERE l_linenumber <> 2) ELSE l_extendedprice END AS l_extendedprice,
           CASE WHEN l_linenumber <> 3 THEN (SELECT quantile_disc(l_discount, 0.5) FROM lineitem
                                             WHERE l_linenumber = 3) ELSE l_discount END AS l_discount
    FROM lineitem""")
def impute_median(spark, sf_dir):
    return impute(load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_linenumber") != 2, F.col("l_extendedprice")).alias("l_extendedprice"),
        F.when(F.col("l_linenumber") == 3, F.col("l_discount")).alias("l_discount"),
    ), CleanConfig(exact_rows=2000))


@register("quantiles_ordered", """
    SELECT unnest(['l_orderkey', 'l_extendedprice', 'l_quantity', 'l_shipdate']) AS name,
           unnest([quantile_disc(l_orderkey, 0.25)::DOUBLE, quantile_disc(l_extendedprice, 0.25), quantile_disc(l_quantity, 0.25),
                   quantile_disc(epoch(l_shipdate), 0.25)]) AS q1,
           unnest([quantile_disc(l_orderkey, 0.5)::DOUBLE, quantile_disc(l_extendedprice, 0.5), quantile_disc(l_quantity, 0.5),
                   quantile_disc(epoch(l_shipdate), 0.5)]) AS median,
           unnest([quantile_disc(l_orderkey, 0.99)::DOUBLE, quantile_disc(l_extendedprice, 0.99), quantile_disc(l_quantity, 0.99),
                   quantile_disc(epoch(l_shipdate), 0.99)]) AS q99
    FROM lineitem""")
def quantiles_ordered(spark, sf_dir):
    """Exact quantiles of a table in order, every partition a narrow range of values, with few rows per task allowed."""
    ordered = load(spark, sf_dir, "lineitem").withColumn("l_shipdate", F.unix_timestamp("l_shipdate").cast("double"))
    names = ["l_orderkey", "l_extendedprice", "l_quantity", "l_shipdate"]
    found = exact_quantiles(ordered.repartitionByRange(64, "l_extendedprice").sortWithinPartitions("l_extendedprice"),
                            {n: [0.25, 0.5, 0.99] for n in names}, exact_rows=500)
    return spark.createDataFrame([(n, *found[n]) for n in names], "name string, q1 double, median double, q99 double")


@register("impute_sentinel", """
    SELECT c_custkey,
           CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment ELSE 'Unknown' END AS segment,
           CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE 'NaN' END AS label,
           CASE WHEN c_custkey % 4 > 0 THEN c_name END AS ref_name,
           CASE WHEN c_custkey % 5 > 0 THEN 'true' ELSE 'Unknown' END AS flag
    FROM customer""")
def impute_sentinel(spark, sf_dir):
    key = F.col("c_custkey")
    return impute(load(spark, sf_dir, "customer").select(
        key,
        F.when(key % 3 > 0, F.col("c_mktsegment")).alias("segment"),
        F.when(key % 3 == 0, F.col("c_name")).alias("label"),
        F.when(key % 4 > 0, F.col("c_name")).alias("ref_name"),
        F.when(key % 5 > 0, F.lit(True)).alias("flag"),
    ).withColumnRenamed("c_custkey", "custid"), CleanConfig()).withColumnRenamed("custid", "c_custkey")


def _clamped(column):
    q1, q3 = (f"(SELECT quantile_disc({column}, {p}) FROM lineitem)" for p in (0.25, 0.75))
    return (f"greatest(least({column}::DOUBLE, {q3}::DOUBLE + 1.5 * ({q3}::DOUBLE - {q1}::DOUBLE)), "
            f"{q1}::DOUBLE - 1.5 * ({q3}::DOUBLE - {q1}::DOUBLE)) AS {column}")


@register("outliers_iqr", f"""
    WITH lineitem AS (
        SELECT l_orderkey, l_linenumber, l_returnflag,
               CASE WHEN l_linenumber = 7 THEN l_extendedprice * 100 ELSE l_extendedprice END AS l_extendedprice,
               CASE WHEN l_linenumber = 1 THEN -l_quantity * 40 ELSE l_quantity END AS l_quantity
        FROM lineitem)
    SELECT {_clamped('l_orderkey')}, {_clamped('l_linenumber')}, l_returnflag, {_clamped('l_extendedprice')},
           {_clamped('l_quantity')} FROM lineitem""")
def outliers_iqr(spark, sf_dir):
    line = F.col("l_linenumber")
    return clamp_outliers(load(spark, sf_dir, "lineitem").select(
        "l_orderkey", line, "l_returnflag",
        F.when(line == 7, F.col("l_extendedprice") * 100).otherwise(F.col("l_extendedprice")).alias("l_extendedprice"),
        F.when(line == 1, -F.col("l_quantity") * 40).otherwise(F.col("l_quantity")).alias("l_quantity"),
    ))


def _repeated_lineitem(spark, sf_dir):
    """Lineitem with a hot row: a third of all rows are copies, most of them of a few."""
    items = load(spark, sf_dir, "lineitem")
    return items.union(items.filter("l_orderkey % 4 = 0")).union(items.filter("l_linenumber = 1"))


@register("dedup_full", "SELECT DISTINCT * FROM lineitem")
def dedup_all(spark, sf_dir):
    return drop_technical(dedup_full(_repeated_lineitem(spark, sf_dir).withColumn(
        ROW_SEQ, F.monotonically_increasing_id()
    )))


@register("dedup_subset", """
    SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) = 1""")
def dedup_some(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").withColumn(ROW_SEQ, F.col("o_orderkey"))
    return drop_technical(dedup_subset(orders, ["o_custkey", "o_orderstatus"]))


@register("dedup_report", """
    SELECT count(*) + count(*) FILTER (l_orderkey % 4 = 0) + count(*) FILTER (l_linenumber = 1) AS rows_in,
           count(*) FILTER (l_orderkey % 4 = 0) + count(*) FILTER (l_linenumber = 1) AS duplicates_removed,
           count(*) AS rows_out
    FROM lineitem""")
def dedup_counts(spark, sf_dir):
    return dedup_report(_repeated_lineitem(spark, sf_dir))


@register("clean", select_upload(UPLOAD_FILLED))
def clean_upload(spark, sf_dir):
    return drop_technical(clean(messy_orders(spark, sf_dir)).df)


@register("clean_dates_kept", select_upload(UPLOAD_FILLED | {"purchase_date": UPLOAD_TYPED["purchase_date"]}))
def clean_dates_kept(spark, sf_dir):
    return drop_technical(clean(messy_orders(spark, sf_dir), CleanConfig(date_missing="null")).df)


@register("clean_subset_outliers", f"""
    WITH cleaned AS ({select_upload(UPLOAD_FILLED)}
                     QUALIFY row_number() OVER (PARTITION BY orderstatus, cust_no ORDER BY order_key) = 1),
         fences AS (SELECT quantile_disc(order_key, 0.25)::DOUBLE AS k1, quantile_disc(order_key, 0.75)::DOUBLE AS k3,
                           quantile_disc(total_price_, 0.25) AS p1, quantile_disc(total_price_, 0.75) AS p3,
                           quantile_disc(cust_no, 0.25)::DOUBLE AS c1, quantile_disc(cust_no, 0.75)::DOUBLE AS c3
                    FROM cleaned)
    SELECT least(greatest(order_key::DOUBLE, k1 - 1.5 * (k3 - k1)), k3 + 1.5 * (k3 - k1)) AS order_key, orderstatus,
           least(greatest(total_price_, p1 - 1.5 * (p3 - p1)), p3 + 1.5 * (p3 - p1)) AS total_price_,
           purchase_date, priority,
           CASE WHEN cust_no IS NOT NULL
                THEN least(greatest(cust_no::DOUBLE, c1 - 1.5 * (c3 - c1)), c3 + 1.5 * (c3 - c1)) END AS cust_no,
           remark, remark_1
    FROM cleaned, fences""")
def clean_subset_outliers(spark, sf_dir):
    result = clean(messy_orders(spark, sf_dir), dedupe_subset=["orderstatus", "cust_no"], remove_outliers=True)
    return drop_technical(result.df)


@register("clean_report", """
    SELECT count(*) + count(*) FILTER (o_orderkey % 4 = 0) AS rows_in,
           count(*) FILTER (o_orderkey % 4 = 0) AS full_duplicates,
           count(*) - count(DISTINCT o_custkey) AS subset_duplicates, count(DISTINCT o_custkey) AS rows_out
    FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 3 THEN o_custkey ELSE -1 END AS o_custkey FROM orders)""")
def clean_report(spark, sf_dir):
    return clean(messy_orders(spark, sf_dir), dedupe_subset=["cust_no"]).report.frame(spark)
