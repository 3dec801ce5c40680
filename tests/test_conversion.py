import datetime as dt

import pytest
from pyspark.sql import functions as F

from helpers import SF_MID, rows
from swatch.operators import conversion as cv
from swatch.plans.common import P1, P2, load, round_doubles
from swatch.schemas import OrderCols, STATUS_CONVERTED, STATUS_NOT_CONVERTED

COLS = OrderCols()  # order_id, customer_id, order_type, process_time, amount
D = dt.datetime


def orders(spark, data):
    return spark.createDataFrame(
        data, "order_id string, customer_id string, order_type string, process_time timestamp_ntz, amount double")


@pytest.fixture
def small(spark):
    return orders(spark, [
        # a: sample then bulk 8 days + 1 hour later (8 whole days), amount 1000.01
        ("o1", "a", "打样单", D(2025, 2, 1, 10), 10.0),
        ("o2", "a", "新订单", D(2025, 2, 9, 11), 1000.01),
        # b: bulk before the sample does not convert; a null-type order after it does (bulk = non-sample)
        ("o3", "b", "新订单", D(2025, 1, 1), 50.0),
        ("o4", "b", "纯衣看样", D(2025, 2, 1), 5.0),
        ("o5", "b", None, D(2025, 2, 8), 1000.0),
        # c: bulk at the same instant as the sample does not convert
        ("o6", "c", "打样单", D(2025, 3, 1), 1.0),
        ("o7", "c", "续订单", D(2025, 3, 1), 99.0),
        # d: conversion after 23 hours = 0 days; amount 0
        ("o8", "d", "打样单", D(2025, 3, 1, 1), 1.0),
        ("o9", "d", "新订单", D(2025, 3, 2, 0), 0.0),
        # e: sample with a null date: never converts
        ("o10", "e", "打样单", None, 1.0),
        ("o11", "e", "新订单", D(2030, 1, 1), 1.0),
        # null customer: no group, but counted in the monthly trend
        ("o12", None, "打样单", D(2025, 2, 2), 1.0),
        # f: bulk only: not a sample customer
        ("o13", "f", "新订单", D(2025, 2, 2), 1.0),
        # null date bulk order: not counted as conversion, not in monthly trend
        ("o14", "a", "新订单", None, 7.0),
    ])


def test_a4_sample_analysis(small):
    got = {r.customer_id: r for r in cv.customer_sample_analysis(small, COLS).collect()}
    assert set(got) == {"a", "b", "c", "d", "e"}
    assert got["a"].sample_count == 1 and got["a"].total_orders == 3
    assert got["a"].sample_ratio == "33.33%"
    assert got["c"].sample_ratio == "50.00%"
    assert got["e"].first_sample_date is None


def test_a5_semantics(small):
    got = {r.customer_id: r for r in cv.customer_conversion_analysis(small, COLS).collect()}
    a, b, c, d, e = (got[k] for k in "abcde")
    assert (a.bulk_count, a.bulk_amount, a.days_to_first_bulk, a.conversion_status) == (1, 1000.01, 8, STATUS_CONVERTED)
    assert (b.bulk_count, b.bulk_amount, b.days_to_first_bulk) == (1, 1000.0, 7)
    assert (c.bulk_count, c.conversion_status, c.days_to_first_bulk) == (0, STATUS_NOT_CONVERTED, None)
    assert (d.bulk_count, d.days_to_first_bulk, d.bulk_amount) == (1, 0, 0.0)
    assert (e.bulk_count, e.conversion_status) == (0, STATUS_NOT_CONVERTED)
    assert c.bulk_amount == 0.0


def test_a6_a7(small):
    a5 = cv.customer_conversion_analysis(small, COLS)
    r = cv.conversion_rate(a5).first()
    assert (r.converted_customers, r.sample_customers) == (3, 5) and r.conversion_rate == pytest.approx(0.6)
    assert cv.average_days_to_convert(a5).first().avg_days_to_convert == pytest.approx(5.0)


def test_histograms_open_left(small):
    a5 = cv.customer_conversion_analysis(small, COLS)
    days = [r.customers for r in cv.days_histogram(a5).orderBy("bin_order").collect()]
    assert days == [1, 1, 0, 0, 0, 0]          # 7 in (0,7], 8 in (7,14], 0 days in no bin
    amounts = [r.customers for r in cv.amount_histogram(a5).orderBy("bin_order").collect()]
    assert amounts == [1, 1, 0, 0, 0]          # 1000 in (0,1000], 1000.01 in (1000,5000], 0 in none


def test_empty_results_keep_schema(spark, small):
    a5 = cv.customer_conversion_analysis(small, COLS, marker="no-such-marker")
    assert a5.count() == 0 and "conversion_status" in a5.columns
    r = cv.conversion_rate(a5).first()
    assert (r.converted_customers, r.sample_customers, r.conversion_rate) == (0, 0, None)
    assert [x.customers for x in cv.days_histogram(a5).collect()] == [0] * 6


def test_no_amount_column(spark, small):
    cols = OrderCols(amount=None)
    a5 = cv.customer_conversion_analysis(small.drop("amount"), cols)
    assert {r.bulk_amount for r in a5.collect()} == {0.0}


def test_monthly_trend(small):
    got = {r.month: (r.sample_orders, r.bulk_orders) for r in cv.monthly_trend(small, COLS).collect()}
    assert got == {"2025-01": (0, 1), "2025-02": (3, 3), "2025-03": (2, 2), "2030-01": (0, 1)}


def test_a1_f4_t1(small):
    counts = cv.order_type_counts(small, COLS).collect()
    assert counts[0].order_type == "新订单" and counts[0].order_count == 6
    assert None not in [r.order_type for r in counts]
    assert {r.order_type for r in cv.sample_types(small, COLS).collect()} == {"打样单", "纯衣看样"}
    ids = [r.order_id for r in cv.sorted_sample_orders(small, COLS).collect()]
    assert ids[-1] == "o10" and ids[:2] == ["o4", "o1"]


def test_string_dates_are_parsed(spark):
    df = spark.createDataFrame([("1", "c", "打样单", "2025/02/04 10:06", "5"), ("2", "c", "新订单", "2025-02-06 13:17:00", "n/a"),
                                ("3", "c", "新订单", "bad", "7")],
                               "order_id string, customer_id string, order_type string, process_time string, amount string")
    r = cv.customer_conversion_analysis(df, COLS).first()
    assert (r.bulk_count, r.days_to_first_bulk, r.bulk_amount) == (1, 2, 0.0)


def test_multi_partition_invariance(spark):
    o = load(spark, SF_MID, "orders")
    base = rows(round_doubles(cv.customer_conversion_analysis(o, P1.cols, P1.marker)))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        one = rows(round_doubles(cv.customer_conversion_analysis(o.repartition(7), P1.cols, P1.marker)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert base == one


def test_survey_figures_sf001(spark):
    """Expected figures stated in the blueprint for the driver tables at sf0.01."""
    a5 = cv.customer_conversion_analysis(load(spark, SF_MID, "orders"), P1.cols, P1.marker)
    agg = a5.agg(F.count(F.lit(1)), F.sum("sample_count"), F.sum("total_orders")).first()
    assert tuple(agg) == (1297, 2978, 13387)
    assert cv.conversion_rate(a5).first().converted_customers == 1230
    assert cv.average_days_to_convert(a5).first().avg_days_to_convert == pytest.approx(290.913, abs=1e-3)
    assert [r.customers for r in cv.days_histogram(a5).orderBy("bin_order").collect()] == [36, 29, 54, 97, 96, 918]
    assert [r.customers for r in cv.amount_histogram(a5).orderBy("bin_order").collect()] == [0, 2, 1, 11, 1216]
    assert cv.monthly_trend(load(spark, SF_MID, "orders"), P1.cols, P1.marker).count() == 80
    e5 = cv.customer_conversion_analysis(load(spark, SF_MID, "events"), P2.cols, P2.marker)
    r = cv.conversion_rate(e5).first()
    assert (r.sample_customers, r.converted_customers) == (150, 150)
    assert cv.average_days_to_convert(e5).first().avg_days_to_convert == pytest.approx(0.2267, abs=1e-4)
    assert [x.customers for x in cv.days_histogram(e5).orderBy("bin_order").collect()] == [31, 0, 0, 0, 0, 0]


def test_hot_customer_is_salted_and_result_unchanged(spark):
    """One customer with a third of all orders: splitting it must not change the answer."""
    import datetime as dt2
    n = 30000
    df = spark.range(n).select(
        F.col("id").cast("string").alias("order_id"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 97).cast("string")).alias("customer_id"),
        F.when(F.col("id") % 10 == 1, F.lit("打样单")).otherwise(F.lit("新订单")).alias("order_type"),
        (F.lit(dt2.datetime(2025, 1, 1)) + F.make_interval(mins=F.col("id").cast("int"))).alias("process_time"),
        (F.col("id") % 7).cast("double").alias("amount"))
    plain = cv.customer_conversion_analysis(df, COLS)
    split = cv.customer_conversion_analysis(df, COLS, hot_rows=500)
    assert "_salt" in split._jdf.queryExecution().optimizedPlan().toString()
    assert rows(round_doubles(plain)) == rows(round_doubles(split))
    hot = [r for r in split.collect() if r.customer_id == "hot"][0]
    assert hot.total_orders == 10000 and hot.bulk_count > 0
