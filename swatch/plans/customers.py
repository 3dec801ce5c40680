"""Registered customer-derivation queries (C1-C8) over mapping P3: as a first build (no existing customers), and as a second
load: the orders before ``FIRST_LOAD_BEFORE`` are built, then the later ones arrive and only the customers that they
touch are maintained.  The SQL of the second load rebuilds everything from all orders and the existing state.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from swatch.operators import customers as cu
from swatch.operators.merge import route
from swatch.plans.common import Query
from swatch.plans.orders_model import AS_OF, AS_OF_SQL, BULK_TYPES_P3, P3_SQL, P6_SQL, SAMPLE_TYPES_P3, p3_orders
from swatch.schemas import BULK_SIDE, SAMPLE_SIDE
from swatch.session import materialize
from swatch.sources.tables import empty_table

EXISTING = ("sample_customers", "bulk_customers", "sample_order_customers", "bulk_order_customers",
            "customer_conversions")


def first_build(spark, sf_dir, names: str = "nation") -> cu.CustomerBuild:
    src = p3_orders(spark, sf_dir, names)
    existing = {n: empty_table(spark, n) for n in EXISTING}
    return cu.build_customers(route(src, SAMPLE_TYPES_P3), route(src, BULK_TYPES_P3), existing, AS_OF)


SAMPLE_OUT = ("id", "customer_name", "shop", "handler", "first_sample_date", "last_sample_date",
              "total_sample_amount", "sample_orders_count", "converted_to_bulk", "conversion_date",
              "bulk_customer_id", "created_at", "updated_at")
BULK_OUT = ("id", "customer_name", "shop", "handler", "first_bulk_date", "last_bulk_date", "total_bulk_amount",
            "bulk_orders_count", "converted_from_sample", "sample_customer_id", "created_at", "updated_at")


def _customers(side: str, names: str = "nation"):
    def build(spark, sf_dir):
        b = first_build(spark, sf_dir, names)
        if side == "sample":
            return b.sample_customers.select(*SAMPLE_OUT).withColumn(
                "total_sample_amount", F.round("total_sample_amount", 4))
        return b.bulk_customers.select(*BULK_OUT).withColumn("total_bulk_amount", F.round("total_bulk_amount", 4))
    return build


def _links(side: str):
    def build(spark, sf_dir):
        b = first_build(spark, sf_dir)
        return b.sample_links if side == "sample" else b.bulk_links
    return build


def _triples(spark, sf_dir):
    return cu.customer_triples(route(p3_orders(spark, sf_dir), SAMPLE_TYPES_P3))


def _resolution(spark, sf_dir):
    spark_existing = empty_table(spark, "sample_customers")
    res = cu.resolve_customers(spark_existing, _triples(spark, sf_dir), AS_OF)
    return res.triple_map


# ------------------------------------------------------------------------------------------------
# Oracle SQL
# ------------------------------------------------------------------------------------------------


def _types(types) -> str:
    return ", ".join(f"'{t}'" for t in types)


def _side_ctes(s: str, types) -> str:
    return f"""
{s}_o AS (SELECT * FROM p3 WHERE order_type IN ({_types(types)})
          AND customer_name IS NOT NULL AND order_id IS NOT NULL),
{s}_tr AS (SELECT customer_name, shop, handler, min(id) AS first_seen, (shop IS NULL OR shop = '') AS blank
           FROM {s}_o GROUP BY customer_name, shop, handler),
{s}_created0 AS (
  SELECT customer_name, shop, arg_min_null(handler, first_seen) AS handler, min(first_seen) AS seen
  FROM {s}_tr WHERE NOT blank GROUP BY customer_name, shop
  UNION ALL
  SELECT customer_name, shop, handler, seen FROM (
    SELECT customer_name, arg_min_null(shop, first_seen) AS shop, arg_min_null(handler, first_seen) AS handler,
           arg_min(blank, first_seen) AS blank, min(first_seen) AS seen
    FROM {s}_tr GROUP BY customer_name) WHERE blank),
{s}_created AS (SELECT row_number() OVER (ORDER BY seen) AS id, * FROM {s}_created0),
{s}_map AS (
  SELECT t.customer_name, t.shop, t.handler, t.first_seen,
         CASE WHEN t.blank THEN a.anchor ELSE p.id END AS customer_id
  FROM {s}_tr t
  LEFT JOIN (SELECT customer_name, min(id) AS anchor FROM {s}_created GROUP BY customer_name) a
    ON a.customer_name = t.customer_name
  LEFT JOIN {s}_created p
    ON p.customer_name = t.customer_name AND p.shop = t.shop AND NOT t.blank AND p.shop <> ''),
{s}_fh AS (SELECT customer_id, arg_min(handler, first_seen) AS fh FROM {s}_map
           WHERE handler IS NOT NULL AND handler <> '' GROUP BY customer_id),
{s}_links AS (
  SELECT row_number() OVER (ORDER BY m.customer_id, o.id) AS id, m.customer_id AS {s}_customer_id, o.order_id,
         o.created_at AS order_date, nullif(o.amount, 0) AS amount, {AS_OF_SQL} AS created_at
  FROM {s}_o o JOIN (SELECT DISTINCT customer_name, customer_id FROM {s}_map) m
    ON m.customer_name = o.customer_name),
{s}_stats AS (SELECT {s}_customer_id AS cid, count(*) AS n, coalesce(sum(amount), 0.0) AS total,
                     min(order_date) AS first_d, max(order_date) AS last_d
              FROM {s}_links GROUP BY 1)"""


def _with(src_sql: str = P3_SQL) -> str:
    return f"""WITH p3 AS ({src_sql}),
{_side_ctes('sample', SAMPLE_TYPES_P3)},
{_side_ctes('bulk', BULK_TYPES_P3)},
conv AS (
  SELECT row_number() OVER (ORDER BY s.id, b.id) AS id, s.id AS sample_customer_id, b.id AS bulk_customer_id,
         {AS_OF_SQL} AS conversion_date, CAST(NULL AS VARCHAR) AS sample_order_id,
         CAST(NULL AS VARCHAR) AS bulk_order_id, CAST(NULL AS INTEGER) AS conversion_days,
         CAST(NULL AS VARCHAR) AS conversion_notes, {AS_OF_SQL} AS created_at
  FROM sample_created s JOIN bulk_created b ON s.customer_name = b.customer_name)
"""


def _customers_sql(s: str, src_sql: str = P3_SQL) -> str:
    other, flag, fk = (("bulk", "converted_to_bulk", "bulk_customer_id") if s == "sample"
                       else ("sample", "converted_from_sample", "sample_customer_id"))
    date_col = "CASE WHEN cv.p IS NOT NULL THEN " + AS_OF_SQL + " END AS conversion_date, " if s == "sample" else ""
    return _with(src_sql) + f"""
SELECT c.id, c.customer_name, c.shop, coalesce(fh.fh, c.handler) AS handler,
       st.first_d AS first_{s}_date, st.last_d AS last_{s}_date,
       round(coalesce(st.total, 0.0), 4) AS total_{s}_amount, CAST(coalesce(st.n, 0) AS INTEGER) AS {s}_orders_count,
       (cv.p IS NOT NULL) AS {flag}, {date_col}cv.p AS {fk}, {AS_OF_SQL} AS created_at, {AS_OF_SQL} AS updated_at
FROM {s}_created c
LEFT JOIN {s}_fh fh ON fh.customer_id = c.id
LEFT JOIN {s}_stats st ON st.cid = c.id
LEFT JOIN (SELECT {s}_customer_id, max({other}_customer_id) AS p FROM conv GROUP BY 1) cv ON cv.{s}_customer_id = c.id"""


def _counters_sql() -> str:
    return _with() + """
SELECT (SELECT count(*) FROM sample_created) AS new_sample,
       (SELECT count(*) FROM sample_tr) - (SELECT count(*) FROM sample_created) AS updated_sample,
       (SELECT count(*) FROM bulk_created) AS new_bulk,
       (SELECT count(*) FROM bulk_tr) - (SELECT count(*) FROM bulk_created) AS updated_bulk,
       (SELECT count(*) FROM sample_links) AS sample_relations,
       (SELECT count(*) FROM bulk_links) AS bulk_relations,
       (SELECT count(*) FROM conv) AS conversions,
       CAST(0 AS BIGINT) AS errors"""


# ------------------------------------------------------------------------------------------------
# Second load
# ------------------------------------------------------------------------------------------------

FIRST_LOAD_BEFORE = "1995-01-20"
AS_OF_2 = dt.datetime(2026, 2, 1)
AS_OF_2_SQL = "TIMESTAMP '2026-02-01 00:00:00'"


def second_load(spark, sf_dir, update=cu.update_customers) -> cu.CustomerBuild:
    src = materialize(p3_orders(spark, sf_dir), "orders")
    first = src.where(F.col("order_created_date") < F.lit(FIRST_LOAD_BEFORE))
    later = src.where(F.col("order_created_date") >= F.lit(FIRST_LOAD_BEFORE))
    sides = {"sample": SAMPLE_TYPES_P3, "bulk": BULK_TYPES_P3}
    b = cu.build_customers(route(first, SAMPLE_TYPES_P3), route(first, BULK_TYPES_P3),
                           {n: empty_table(spark, n) for n in EXISTING}, AS_OF)
    tables = zip(EXISTING, (b.sample_customers, b.bulk_customers, b.sample_links, b.bulk_links, b.conversions))
    existing = {n: materialize(df, "first-load") for n, df in tables}
    return update({s: route(src, t) for s, t in sides.items()}, {s: route(later, t) for s, t in sides.items()}, existing, AS_OF_2)


def _second(table: str):
    def build(spark, sf_dir):
        out = getattr(second_load(spark, sf_dir), table)
        if table == "sample_customers":
            return out.select(*SAMPLE_OUT).withColumn("total_sample_amount", F.round("total_sample_amount", 4))
        if table == "bulk_customers":
            return out.select(*BULK_OUT).withColumn("total_bulk_amount", F.round("total_bulk_amount", 4))
        return out
    return build


P3_FIRST_SQL = f"SELECT * FROM ({P3_SQL}) p WHERE order_created_date < TIMESTAMP '{FIRST_LOAD_BEFORE}'"


def _second_side(s: str, types) -> str:
    return f"""
{s}_ex AS (SELECT * FROM ({_customers_sql(s, P3_FIRST_SQL)}) q),
{s}_exl AS (SELECT * FROM ({_with(P3_FIRST_SQL)} SELECT * FROM {s}_links) q),
{s}_o AS (SELECT * FROM p3 WHERE order_type IN ({_types(types)}) AND customer_name IS NOT NULL AND order_id IS NOT NULL),
{s}_tr AS (SELECT customer_name, shop, handler, min(id) AS first_seen, coalesce(shop, '') = '' AS blank
           FROM {s}_o GROUP BY customer_name, shop, handler),
{s}_pair AS (SELECT customer_name, shop, min(id) AS id FROM {s}_ex WHERE coalesce(shop, '') <> '' GROUP BY 1, 2),
{s}_name AS (SELECT customer_name, min(id) AS id FROM {s}_ex GROUP BY 1),
{s}_created0 AS (
  SELECT customer_name, shop, arg_min_null(handler, first_seen) AS handler, min(first_seen) AS seen
  FROM {s}_tr t WHERE NOT blank
    AND NOT EXISTS (SELECT 1 FROM {s}_pair p WHERE p.customer_name = t.customer_name AND p.shop = t.shop)
  GROUP BY customer_name, shop
  UNION ALL
  SELECT customer_name, shop, handler, first_seen FROM {s}_tr t
  WHERE blank AND customer_name NOT IN (SELECT customer_name FROM {s}_name)
    AND first_seen = (SELECT min(first_seen) FROM {s}_tr u WHERE u.customer_name = t.customer_name)),
{s}_created AS (SELECT (SELECT coalesce(max(id), 0) FROM {s}_ex) + row_number() OVER (ORDER BY seen) AS id, * FROM {s}_created0),
{s}_map AS (
  SELECT t.customer_name, t.handler, t.first_seen,
         CASE WHEN blank THEN coalesce(n.id, a.id) ELSE coalesce(p.id, c.id) END AS customer_id
  FROM {s}_tr t LEFT JOIN {s}_name n ON n.customer_name = t.customer_name
  LEFT JOIN (SELECT customer_name, min(id) AS id FROM {s}_created GROUP BY 1) a ON a.customer_name = t.customer_name
  LEFT JOIN {s}_pair p ON p.customer_name = t.customer_name AND p.shop = t.shop
  LEFT JOIN {s}_created c ON c.customer_name = t.customer_name AND c.shop = t.shop AND NOT blank),
{s}_fh AS (SELECT customer_id, arg_min(handler, first_seen) AS fh FROM {s}_map WHERE coalesce(handler, '') <> '' GROUP BY 1),
{s}_all AS (
  SELECT id, customer_name, shop, CASE WHEN coalesce(handler, '') = '' THEN coalesce(fh, handler) ELSE handler END AS handler,
         created_at FROM {s}_ex LEFT JOIN {s}_fh ON customer_id = id
  UNION ALL
  SELECT id, customer_name, shop, coalesce(fh, handler), {AS_OF_2_SQL} FROM {s}_created LEFT JOIN {s}_fh ON customer_id = id),
{s}_links AS (
  SELECT * FROM {s}_exl
  UNION ALL
  SELECT (SELECT coalesce(max(id), 0) FROM {s}_exl) + row_number() OVER (ORDER BY m.customer_id, o.id), m.customer_id, o.order_id,
         o.created_at, nullif(o.amount, 0), {AS_OF_2_SQL}
  FROM {s}_o o JOIN (SELECT DISTINCT customer_name, customer_id FROM {s}_map) m ON m.customer_name = o.customer_name
  WHERE NOT EXISTS (SELECT 1 FROM {s}_exl x WHERE x.{s}_customer_id = m.customer_id AND x.order_id = o.order_id)),
{s}_stats AS (SELECT {s}_customer_id AS cid, count(*) AS n, coalesce(sum(amount), 0.0) AS total, min(order_date) AS first_d,
                     max(order_date) AS last_d FROM {s}_links GROUP BY 1)"""


def _second_with() -> str:
    return f"""WITH p3 AS ({P3_SQL}), exconv AS (SELECT * FROM ({_with(P3_FIRST_SQL)} SELECT * FROM conv) q),
{_second_side('sample', SAMPLE_TYPES_P3)},
{_second_side('bulk', BULK_TYPES_P3)},
newconv AS (
  SELECT (SELECT coalesce(max(id), 0) FROM exconv) + row_number() OVER (ORDER BY s.id, b.id) AS id, s.id AS sample_customer_id,
         b.id AS bulk_customer_id, {AS_OF_2_SQL} AS conversion_date, NULL AS sample_order_id, NULL AS bulk_order_id,
         NULL AS conversion_days, NULL AS conversion_notes, {AS_OF_2_SQL} AS created_at
  FROM sample_all s JOIN bulk_all b ON s.customer_name = b.customer_name
  WHERE NOT EXISTS (SELECT 1 FROM exconv x WHERE x.sample_customer_id = s.id AND x.bulk_customer_id = b.id))
"""


def _second_customers_sql(s: str) -> str:
    other, flag, fk = (("bulk", "converted_to_bulk", "bulk_customer_id") if s == "sample"
                       else ("sample", "converted_from_sample", "sample_customer_id"))
    date = f"CASE WHEN cv.p IS NOT NULL THEN {AS_OF_2_SQL} ELSE e.conversion_date END AS conversion_date, " if s == "sample" else ""
    return _second_with() + f"""
SELECT c.id, c.customer_name, c.shop, c.handler, st.first_d AS first_{s}_date, st.last_d AS last_{s}_date,
       round(coalesce(st.total, 0.0), 4) AS total_{s}_amount, CAST(coalesce(st.n, 0) AS INTEGER) AS {s}_orders_count,
       cv.p IS NOT NULL OR coalesce(e.{flag}, false) AS {flag}, {date}coalesce(cv.p, e.{fk}) AS {fk}, c.created_at,
       c.created_at AS updated_at
FROM {s}_all c LEFT JOIN {s}_ex e ON e.id = c.id LEFT JOIN {s}_stats st ON st.cid = c.id
LEFT JOIN (SELECT {s}_customer_id, max({other}_customer_id) AS p FROM newconv GROUP BY 1) cv ON cv.{s}_customer_id = c.id"""


def _grid_links(spark, sf_dir):
    """C3 with bounds that every name exceeds, in orders and in customers."""
    orders = materialize(route(p3_orders(spark, sf_dir), SAMPLE_TYPES_P3), "orders")
    res = cu.resolve_customers(empty_table(spark, "sample_customers"), cu.customer_triples(orders), AS_OF)
    return cu.link_orders(orders, res.triple_map, empty_table(spark, "sample_order_customers"), AS_OF, hot_rows=50, cell=2)


def _grid_conversions(spark, sf_dir):
    sides = []
    for side, types in ((SAMPLE_SIDE, SAMPLE_TYPES_P3), (BULK_SIDE, BULK_TYPES_P3)):
        triples = cu.customer_triples(route(p3_orders(spark, sf_dir), types))
        sides.append(cu.resolve_customers(empty_table(spark, f"{side.name}_customers"), triples, AS_OF, side).customers)
    return cu.detect_conversions(*sides, empty_table(spark, "customer_conversions"), AS_OF, cell=2)


def queries() -> list[Query]:
    return [
        Query("c3_sample_links_grid_p3", _grid_links, _with() + "SELECT * FROM sample_links"),
        Query("c4_conversions_grid_p3", _grid_conversions, _with() + "SELECT * FROM conv"),
        Query("c1_sample_triples_p3", _triples,
              f"WITH p3 AS ({P3_SQL}) SELECT customer_name, shop, handler, min(id) AS first_seen FROM p3 "
              f"WHERE order_type IN ({_types(SAMPLE_TYPES_P3)}) AND customer_name IS NOT NULL "
              f"AND order_id IS NOT NULL GROUP BY customer_name, shop, handler"),
        Query("c2_sample_resolution_p3", _resolution,
              _with() + "SELECT customer_name, shop, handler, first_seen, customer_id FROM sample_map"),
        Query("c7_sample_customers_p3", _customers("sample"), _customers_sql("sample")),
        Query("c7_bulk_customers_p3", _customers("bulk"), _customers_sql("bulk")),
        Query("c3_sample_links_p3", _links("sample"), _with() + "SELECT * FROM sample_links"),
        Query("c3_bulk_links_p3", _links("bulk"), _with() + "SELECT * FROM bulk_links"),
        Query("c4_conversions_p3", lambda s, d: first_build(s, d).conversions, _with() + "SELECT * FROM conv"),
        Query("c8_counters_p3", lambda s, d: first_build(s, d).counters, _counters_sql()),
        Query("c7_sample_customers_second_load_p3", _second("sample_customers"), _second_customers_sql("sample")),
        Query("c7_bulk_customers_second_load_p3", _second("bulk_customers"), _second_customers_sql("bulk")),
        Query("c3_sample_links_second_load_p3", _second("sample_links"), _second_with() + "SELECT * FROM sample_links"),
        Query("c4_conversions_second_load_p3", _second("conversions"),
              _second_with() + "SELECT * FROM exconv UNION ALL SELECT * FROM newconv"),
        Query("c7_sample_customers_p6", _customers("sample", "customer"), _customers_sql("sample", P6_SQL)),
        Query("c7_bulk_customers_p6", _customers("bulk", "customer"), _customers_sql("bulk", P6_SQL)),
    ]
