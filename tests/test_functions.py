import datetime as dt

from pyspark.sql import functions as F

from swatch.functions import percent_text, to_double, to_int_or_zero, to_timestamp_ntz, whole_days


def test_percent_text_half_even(spark):
    df = spark.createDataFrame([(1, 32), (1, 3), (1, 2), (2, 2)], "a long, b long")
    got = [r.p for r in df.select(percent_text(F.col("a") / F.col("b")).alias("p")).collect()]
    assert got == ["3.12%", "33.33%", "50.00%", "100.00%"]


def test_whole_days_not_calendar_days(spark):
    df = spark.createDataFrame([(dt.datetime(2025, 2, 6, 13, 17), dt.datetime(2025, 2, 8, 10, 0))],
                               "a timestamp_ntz, b timestamp_ntz")
    assert df.select(whole_days("a", "b").alias("d")).first().d == 1


def test_number_guard(spark):
    vals = ["1", " 2.5 ", "-3.7", "1e3", ".5", "1,000", "1.0d", "n/a", "", None, "nan", "inf"]
    df = spark.createDataFrame([(v,) for v in vals], "t string")
    got = [(r.d, r.i) for r in df.select(to_double("t").alias("d"), to_int_or_zero("t").alias("i")).collect()]
    assert got[:5] == [(1.0, 1), (2.5, 2), (-3.7, -3), (1000.0, 1000), (0.5, 0)]
    assert all(d is None and i == 0 for d, i in got[5:11])
    assert got[11] == (float("inf"), 0)


def test_date_text_forms(spark):
    vals = ["2025-02-04 10:06:07", "2025/2/4 10:06", "2025.02.04", "20250204", "2025-02-30", "not a date",
            " 2025-02-04T10:06 "]
    df = spark.createDataFrame([(v,) for v in vals], "t string")
    got = [r.d for r in df.select(to_timestamp_ntz("t").alias("d")).collect()]
    assert got == [dt.datetime(2025, 2, 4, 10, 6, 7), dt.datetime(2025, 2, 4, 10, 6), dt.datetime(2025, 2, 4),
                   dt.datetime(2025, 2, 4), None, None, dt.datetime(2025, 2, 4, 10, 6)]
