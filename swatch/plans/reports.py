"""Registered report and edit queries (A11, T2-T4, F5, F10) over mapping P6 (customers named by
``c_name``, so some sample customers never convert), and the quality checks (Q2, Q3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from swatch.operators import ingest as ing
from swatch.operators import merge as mg
from swatch.operators import quality as qa
from swatch.operators import reports as rp
from swatch.plans.common import Query, load
from swatch.plans.customers import BULK_OUT, SAMPLE_OUT, _customers_sql, _with, first_build
from swatch.plans.ingest import TEXT_SQL, p5_text
from swatch.plans.orders_model import P6_SQL
from swatch.schemas import BULK_CUSTOMER_EDIT_FIELDS, SAMPLE_CUSTOMER_EDIT_FIELDS

N_TOP = 50
SKIP, LIMIT = 10, 20
DEEP = 90
HANDLER = "F"


def _build(spark, sf_dir):
    return first_build(spark, sf_dir, "customer")


def _sample_out(df):
    return df.select(*SAMPLE_OUT).withColumn("total_sample_amount", F.round("total_sample_amount", 4))


SC = f"({_customers_sql('sample', P6_SQL)})"
BC = f"({_customers_sql('bulk', P6_SQL)})"
LINKS = f"({_with(P6_SQL)} SELECT * FROM sample_links)"
T2_SQL = (f"SELECT * FROM {SC} sc WHERE converted_to_bulk = false "
          f"ORDER BY last_sample_date DESC NULLS FIRST, id LIMIT {N_TOP}")


def _summary(spark, sf_dir):
    b = _build(spark, sf_dir)
    return rp.customer_summary(b.sample_customers, b.bulk_customers)


SUMMARY_SQL = f"""
SELECT s.n + b.n AS total_customers, s.n AS sample_customers, b.n AS bulk_customers, s.conv AS converted_customers,
       CASE WHEN s.n > 0 THEN round_even(s.conv / s.n * 100.0, 2) ELSE 0.0 END AS conversion_rate
FROM (SELECT count(*) AS n, count(*) FILTER (WHERE converted_to_bulk) AS conv FROM {SC} x) s,
     (SELECT count(*) AS n FROM {BC} y) b"""


def _report(spark, sf_dir):
    b = _build(spark, sf_dir)
    return rp.explode_report(rp.unconverted_report(b.sample_customers, b.sample_links, N_TOP))


REPORT_SQL = f"""
WITH top AS ({T2_SQL}),
l AS (SELECT *, row_number() OVER (PARTITION BY sample_customer_id ORDER BY order_date DESC NULLS FIRST, order_id) AS rn
      FROM {LINKS} lk WHERE sample_customer_id IN (SELECT id FROM top))
SELECT t.id, t.customer_name AS name, t.shop, t.handler, t.first_sample_date, t.last_sample_date,
       CAST(t.sample_orders_count AS BIGINT) AS sample_orders_count, CAST(l.rn - 1 AS INTEGER) AS pos,
       l.order_id, l.order_date, l.amount
FROM top t LEFT JOIN l ON l.sample_customer_id = t.id AND l.rn <= 5"""


def _changes(spark, sf_dir):
    cust = load(spark, sf_dir, "customer")
    m = F.create_map(F.lit("notes"), F.lit("negative balance"), F.lit("handler"), F.lit(None).cast("string"),
                     F.lit("wechat"), F.col("c_name"), F.lit("phone"), F.lit("123"),
                     F.lit("next_contact_date"), F.lit("2026-02-01 00:00:00"),
                     F.lit("tags"), F.lit('["debt", "call"]'))
    return cust.where(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("id"), m.alias("changes"))


EDIT_OUT = ("id", "customer_name", "shop", "handler", "notes", "wechat", "next_contact_date", "tags", "updated_at",
            "_action")


def _edit(missing: bool):
    def build(spark, sf_dir):
        b = _build(spark, sf_dir)
        table, miss = mg.edit_customers(b.sample_customers, _changes(spark, sf_dir), SAMPLE_CUSTOMER_EDIT_FIELDS)
        return miss.select("id") if missing else table.select(*EDIT_OUT)
    return build


CHANGES_SQL = "SELECT c_custkey AS id, c_name FROM customer WHERE c_acctbal < 0"
EDIT_SQL = f"""
WITH ch AS ({CHANGES_SQL})
SELECT s.id, s.customer_name, s.shop, CASE WHEN ch.id IS NOT NULL THEN NULL ELSE s.handler END AS handler,
       CASE WHEN ch.id IS NOT NULL THEN 'negative balance' END AS notes,
       CASE WHEN ch.id IS NOT NULL THEN ch.c_name END AS wechat,
       CASE WHEN ch.id IS NOT NULL THEN TIMESTAMP '2026-02-01 00:00:00' END AS next_contact_date,
       CASE WHEN ch.id IS NOT NULL THEN ['debt', 'call'] END AS tags, s.updated_at,
       CASE WHEN ch.id IS NOT NULL THEN 'updated' ELSE 'unchanged' END AS _action
FROM {SC} s LEFT JOIN ch ON ch.id = s.id"""


def _orphan_orders(spark, sf_dir):
    """Q3 with orphans: orders whose customer is not among those with a balance; customers of many orders are split."""
    parents = load(spark, sf_dir, "customer").where(F.col("c_acctbal") >= 0)
    return qa.orphans(load(spark, sf_dir, "orders"), parents, "o_custkey", "c_custkey", hot_rows=5)


def _orphan_links(spark, sf_dir):
    """Q3: the links of a build held against the customers of the same build."""
    b = _build(spark, sf_dir)
    return qa.orphans(b.sample_links, b.sample_customers, "sample_customer_id", "id")


def _bulk_out(df):
    return df.select(*BULK_OUT).withColumn("total_bulk_amount", F.round("total_bulk_amount", 4))


BULK_EDIT_OUT = ("id", "customer_name", "shop", "handler", "notes", "customer_type", "phone", "tags", "updated_at", "_action")


def _edit_bulk(spark, sf_dir):
    m = F.create_map(F.lit("notes"), F.col("c_name"), F.lit("customer_type"), F.lit(None).cast("string"),
                     F.lit("phone"), F.lit("123"), F.lit("handler"), F.lit("new"), F.lit("tags"), F.lit('["debt"]'))
    changes = load(spark, sf_dir, "customer").where(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("id"), m.alias("changes"))
    table, _ = mg.edit_customers(_build(spark, sf_dir).bulk_customers, changes, BULK_CUSTOMER_EDIT_FIELDS)
    return table.select(*BULK_EDIT_OUT)


def _edited(field: str, new: str, old: str) -> str:
    """A field outside the whitelist keeps its value."""
    return f"CASE WHEN ch.id IS NOT NULL THEN {new} ELSE {old} END AS {field}" if field in BULK_CUSTOMER_EDIT_FIELDS else f"{old} AS {field}"


EDIT_BULK_SQL = f"""
WITH ch AS ({CHANGES_SQL})
SELECT s.id, s.customer_name, s.shop, {_edited("handler", "'new'", "s.handler")}, {_edited("notes", "ch.c_name", "NULL")},
       {_edited("customer_type", "NULL", "NULL")}, {_edited("phone", "'123'", "NULL")}, {_edited("tags", "['debt']", "NULL")},
       s.updated_at, CASE WHEN ch.id IS NOT NULL THEN 'updated' ELSE 'unchanged' END AS _action
FROM {BC} s LEFT JOIN ch ON ch.id = s.id"""


def _found_columns(spark, sf_dir):
    """Q1: the date and the amount column of a table, found by their names."""
    orders = load(spark, sf_dir, "orders")
    found = qa.find_columns(orders, order_id="o_orderkey", customer_id="o_custkey", order_type="o_orderpriority")
    return orders.select(F.col(found.customer_id).alias("customer_id"), F.col(found.date).alias("found_date"),
                         F.col(found.amount).alias("found_amount"))


def queries() -> list[Query]:
    return [
        Query("q3_orphan_orders", _orphan_orders,
              "SELECT * FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)"),
        Query("a11_customer_summary_p6", _summary, SUMMARY_SQL),
        Query("t2_unconverted_p6", lambda s, d: _sample_out(rp.unconverted(_build(s, d).sample_customers, N_TOP)),
              T2_SQL),
        Query("t3_unconverted_report_p6", _report, REPORT_SQL),
        Query("t4_page_sample_customers_p6",
              lambda s, d: _sample_out(rp.page(_build(s, d).sample_customers, SKIP, LIMIT)),
              f"SELECT * FROM {SC} sc ORDER BY id LIMIT {LIMIT} OFFSET {SKIP}"),
        Query("t4_deep_page_sample_customers_p6",
              lambda s, d: _sample_out(rp.Pages.of(_build(s, d).sample_customers, files=12).page(DEEP, LIMIT)),
              f"SELECT * FROM {SC} sc ORDER BY id LIMIT {LIMIT} OFFSET {DEEP}"),
        Query("t4_deep_page_bulk_customers_p6",
              lambda s, d: rp.Pages.of(_build(s, d).bulk_customers, files=12).page(DEEP, LIMIT).select(*BULK_OUT).withColumn(
                  "total_bulk_amount", F.round("total_bulk_amount", 4)),
              f"SELECT * FROM {BC} bc ORDER BY id LIMIT {LIMIT} OFFSET {DEEP}"),
        Query("t4_deep_page_orders",
              lambda s, d: rp.Pages.of(load(s, d, "orders"), ["o_orderdate", "o_orderkey"], files=12).page(10 * DEEP, LIMIT),
              f"SELECT * FROM orders ORDER BY o_orderdate, o_orderkey LIMIT {LIMIT} OFFSET {10 * DEEP}"),
        Query("f5_customers_by_handler_p6",
              lambda s, d: _sample_out(rp.customers_by_handler(_build(s, d).sample_customers, HANDLER)),
              f"SELECT * FROM {SC} sc WHERE handler = '{HANDLER}'"),
        Query("f5_bulk_customers_by_handler_p6",
              lambda s, d: _bulk_out(rp.customers_by_handler(_build(s, d).bulk_customers, HANDLER)),
              f"SELECT * FROM {BC} bc WHERE handler = '{HANDLER}'"),
        Query("f5_blank_handler_p6", lambda s, d: _bulk_out(rp.customers_by_handler(_build(s, d).bulk_customers, "")),
              f"SELECT * FROM {BC} bc"),
        Query("f10_edit_bulk_customers_p6", _edit_bulk, EDIT_BULK_SQL),
        Query("q1_found_columns", _found_columns,
              "SELECT o_custkey AS customer_id, o_orderdate AS found_date, o_totalprice AS found_amount FROM orders"),
        Query("f10_edit_sample_customers_p6", _edit(False), EDIT_SQL),
        Query("f10_edit_missing_p6", _edit(True),
              f"WITH ch AS ({CHANGES_SQL}) SELECT id FROM ch WHERE id NOT IN (SELECT id FROM {SC} sc)"),
        Query("q2_duplicate_keys_p5",
              lambda s, d: qa.duplicate_keys(ing.fill_strings(ing.map_headers(p5_text(s, d)), ["order_id"]),
                                             ["_file", "order_id"]),
              f"SELECT _file, coalesce(order_id, '') AS order_id, count(*) AS rows FROM ({TEXT_SQL}) t "
              f"GROUP BY 1, 2 HAVING count(*) > 1"),
        Query("q3_orphan_links_p6", _orphan_links,
              f"SELECT * FROM {LINKS} l WHERE sample_customer_id NOT IN (SELECT id FROM {SC} sc)"),
    ]
