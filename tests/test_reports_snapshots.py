import datetime as dt

from helpers import rows
from swatch.operators import reports as rp
from swatch.operators.ids import assign_ids
from swatch.sources import snapshots as snap
from swatch.sources.tables import empty_table

D = dt.datetime


def _customers(spark):
    data = [(1, "a", True, D(2025, 1, 1), "h1"), (2, "b", False, None, "h1"), (3, "c", False, D(2025, 3, 1), None),
            (4, "d", None, D(2025, 4, 1), "h2"), (5, "e", False, D(2025, 2, 1), "")]
    df = spark.createDataFrame(data, "id long, customer_name string, converted_to_bulk boolean, "
                                     "last_sample_date timestamp_ntz, handler string")
    return empty_table(spark, "sample_customers").unionByName(df, allowMissingColumns=True)


def test_t2_nulls_first_and_null_flag_excluded(spark):
    got = [r.id for r in rp.unconverted(_customers(spark), 10).collect()]
    assert got == [2, 3, 5]


def test_t3_nested_latest_five(spark):
    links = spark.createDataFrame(
        [(i, 3, f"o{i}", D(2025, 1, i) if i != 4 else None, float(i), D(2026, 1, 1)) for i in range(1, 9)],
        "id long, sample_customer_id long, order_id string, order_date timestamp_ntz, amount double, "
        "created_at timestamp_ntz")
    rep = rp.unconverted_report(_customers(spark), links, n=2).collect()
    assert [r.id for r in rep] == [2, 3]
    assert rep[0].sample_orders == []
    assert [o.order_id for o in rep[1].sample_orders] == ["o4", "o8", "o7", "o6", "o5"]


def test_a11_f5_t4(spark):
    c = _customers(spark)
    bulk = empty_table(spark, "bulk_customers").unionByName(
        spark.createDataFrame([(1, "a")], "id long, customer_name string"), allowMissingColumns=True)
    s = rp.customer_summary(c, bulk).first()
    assert tuple(s) == (6, 5, 1, 1, 20.0)
    s0 = rp.customer_summary(empty_table(spark, "sample_customers"), bulk).first()
    assert (s0.conversion_rate, s0.total_customers) == (0.0, 1)
    assert rows(rp.customers_by_handler(c, "h1"), "id") == [(1,), (2,)]
    assert rp.customers_by_handler(c, "").count() == 5
    assert [r.id for r in rp.page(c, 1, 2).collect()] == [2, 3]


def test_assign_ids_dense_across_partitions(spark):
    df = spark.range(0, 1000).selectExpr("(id * 7919) % 1000 AS k").repartition(5)
    out = assign_ids(df, ["k"], start=10, num_partitions=4)
    assert sorted((r.k, r.id) for r in out.collect()) == [(k, k + 10) for k in range(1000)]


def test_publish_and_append(spark, tmp_path):
    base = str(tmp_path / "tables")
    assert snap.current_version(spark, base) is None
    t = spark.createDataFrame([(1, "a")], "id long, order_id string")
    snap.publish(spark, base, "1", {"t": t})
    assert snap.current_version(spark, base) == "1"
    cur = snap.read_current(spark, base, "t")
    ok = snap.append_load(cur, spark.createDataFrame([("b",), ("c",)], "order_id string"))
    assert (ok.stats.first().inserted, ok.stats.first().errors) == (2, 0)
    assert rows(ok.table, "id", "order_id") == [(1, "a"), (2, "b"), (3, "c")]
    bad = snap.append_load(cur, spark.createDataFrame([("a",), ("d",)], "order_id string"))
    assert (bad.stats.first().inserted, bad.stats.first().errors) == (0, 2)
    snap.publish(spark, base, "2", {"t": ok.table})
    assert snap.read_current(spark, base, "t").count() == 3
    snap.write_csv(ok.table.drop("_action"), str(tmp_path / "csv"), sort_by=["id"])
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3


def test_publish_keeps_other_tables_and_refuses_old_versions(spark, tmp_path):
    import pytest

    base = str(tmp_path / "tables")
    one = spark.createDataFrame([(1,)], "id long")
    snap.publish(spark, base, "1", {"a": one})
    snap.publish(spark, base, "2", {"b": one})
    assert snap.read_current(spark, base, "a").count() == 1 and snap.current_version(spark, base) == "2"
    for used in ("1", "2"):
        with pytest.raises(ValueError):
            snap.publish(spark, base, used, {"a": snap.read_current(spark, base, "a")})
    snap.ensure_tables(spark, base, "3", ["original_orders"])
    assert snap.read_current(spark, base, "original_orders").count() == 0
    assert snap.read_current(spark, base, "b").count() == 1


def test_scale_conf_bounds():
    from swatch.session import scale_conf
    big = scale_conf(100 * 2**40, 8000)
    assert big["spark.sql.shuffle.partitions"] == "65536"
    assert big["spark.sql.files.maxPartitionBytes"] == str(256 << 20)
    assert scale_conf(1 << 20, 8)["spark.sql.shuffle.partitions"] == "16"
