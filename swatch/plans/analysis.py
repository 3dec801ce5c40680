"""Registered conversion-analysis queries over the driver tables (mappings P1 and P2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from swatch.operators import conversion as conv
from swatch.plans.common import P1, P2, OrderMapping, Query, load, round_doubles
from swatch.schemas import (
    AMOUNT_BIN_EDGES,
    AMOUNT_BIN_LABELS,
    DAYS_BIN_EDGES,
    DAYS_BIN_LABELS,
    STATUS_CONVERTED,
    STATUS_NOT_CONVERTED,
)

# ------------------------------------------------------------------------------------------------
# Oracle SQL text (DuckDB), written independently of the Spark plans.
# ------------------------------------------------------------------------------------------------


def _sql_base(m: OrderMapping, keep_null_customer: bool = False) -> str:
    c = m.cols
    where = "" if keep_null_customer else f"WHERE {c.customer_id} IS NOT NULL"
    return (f"SELECT {c.customer_id} AS customer_id, CAST({c.date} AS TIMESTAMP) AS d, "
            f"CAST({c.amount} AS DOUBLE) AS amt, "
            f"coalesce(contains(CAST({c.order_type} AS VARCHAR), '{m.marker}'), false) AS s "
            f"FROM {m.table} {where}")


def _sql_facts() -> str:
    return ("SELECT customer_id, min(CASE WHEN s THEN d END) AS first_sample_date, "
            "count(*) FILTER (WHERE s) AS sample_count, count(*) AS total_orders "
            "FROM base GROUP BY customer_id HAVING count(*) FILTER (WHERE s) > 0")


def _sql_a4(m: OrderMapping) -> str:
    return f"""
WITH base AS ({_sql_base(m)}), facts AS ({_sql_facts()})
SELECT customer_id, first_sample_date, sample_count, total_orders,
       printf('%.2f%%', round_even(sample_count / total_orders * 100.0, 2)) AS sample_ratio,
       sample_count / total_orders AS sample_ratio_value
FROM facts"""


def _sql_a5(m: OrderMapping, round_amount: bool = True) -> str:
    amount = "round(coalesce(c.bulk_amount, 0.0), 4)" if round_amount else "coalesce(c.bulk_amount, 0.0)"
    return f"""
WITH base AS ({_sql_base(m)}),
facts AS ({_sql_facts()}),
conv AS (
  SELECT f.customer_id, count(*) AS bulk_count, sum(b.amt) AS bulk_amount, min(b.d) AS first_bulk
  FROM facts f JOIN base b
    ON b.customer_id = f.customer_id AND NOT b.s AND b.d > f.first_sample_date
  GROUP BY f.customer_id)
SELECT f.customer_id, f.first_sample_date, f.sample_count, f.total_orders,
       printf('%.2f%%', round_even(f.sample_count / f.total_orders * 100.0, 2)) AS sample_ratio,
       f.sample_count / f.total_orders AS sample_ratio_value,
       coalesce(c.bulk_count, 0) AS bulk_count,
       {amount} AS bulk_amount,
       date_sub('day', f.first_sample_date, c.first_bulk) AS days_to_first_bulk,
       CASE WHEN coalesce(c.bulk_count, 0) > 0 THEN '{STATUS_CONVERTED}' ELSE '{STATUS_NOT_CONVERTED}' END
         AS conversion_status
FROM facts f LEFT JOIN conv c ON c.customer_id = f.customer_id"""


def _sql_bins(edges, labels, label_col: str) -> str:
    rows = []
    for i, lab in enumerate(labels):
        hi = "'infinity'::DOUBLE" if edges[i + 1] == float("inf") else f"{float(edges[i + 1])}"
        rows.append(f"({i}, '{lab}', {float(edges[i])}, {hi})")
    return f"bins(bin_order, {label_col}, lo, hi) AS (VALUES {', '.join(rows)})"


def _sql_hist(m: OrderMapping, value: str, edges, labels, label_col: str) -> str:
    return f"""
WITH a AS ({_sql_a5(m, round_amount=False)}), {_sql_bins(edges, labels, label_col)}
SELECT CAST(bin_order AS INTEGER) AS bin_order, {label_col}, count(a.customer_id) AS customers
FROM bins LEFT JOIN a
  ON a.conversion_status = '{STATUS_CONVERTED}' AND a.{value} > bins.lo AND a.{value} <= bins.hi
GROUP BY bin_order, {label_col}"""


def _sql_rate(m: OrderMapping) -> str:
    return f"""
WITH a AS ({_sql_a5(m)})
SELECT count(*) FILTER (WHERE conversion_status = '{STATUS_CONVERTED}') AS converted_customers,
       count(*) AS sample_customers,
       round(CASE WHEN count(*) = 0 THEN NULL
             ELSE (count(*) FILTER (WHERE conversion_status = '{STATUS_CONVERTED}')) / count(*) END, 4)
         AS conversion_rate
FROM a"""


def _sql_avg_days(m: OrderMapping) -> str:
    return f"""
WITH a AS ({_sql_a5(m)})
SELECT count(*) AS converted_customers, round(avg(days_to_first_bulk), 4) AS avg_days_to_convert
FROM a WHERE conversion_status = '{STATUS_CONVERTED}'"""


def _sql_monthly(m: OrderMapping) -> str:
    return f"""
WITH base AS ({_sql_base(m, keep_null_customer=True)})
SELECT strftime(d, '%Y-%m') AS month, count(*) FILTER (WHERE s) AS sample_orders,
       count(*) FILTER (WHERE NOT s) AS bulk_orders
FROM base WHERE d IS NOT NULL GROUP BY 1"""


def _sql_first_dates(m: OrderMapping) -> str:
    return f"""
WITH base AS ({_sql_base(m)})
SELECT customer_id, min(d) AS first_sample_date FROM base WHERE s GROUP BY customer_id"""


def _sql_counts(m: OrderMapping) -> str:
    return f"""
WITH base AS ({_sql_base(m)})
SELECT customer_id, count(*) FILTER (WHERE s) AS sample_count, count(*) AS total_orders
FROM base GROUP BY customer_id HAVING count(*) FILTER (WHERE s) > 0"""


def _sql_type_counts(m: OrderMapping) -> str:
    t = m.cols.order_type
    return f"SELECT {t} AS order_type, count(*) AS order_count FROM {m.table} WHERE {t} IS NOT NULL GROUP BY {t}"


def _sql_sample_types(m: OrderMapping) -> str:
    t = m.cols.order_type
    return (f"SELECT DISTINCT CAST({t} AS VARCHAR) AS order_type FROM {m.table} "
            f"WHERE coalesce(contains(CAST({t} AS VARCHAR), '{m.marker}'), false)")


# ------------------------------------------------------------------------------------------------
# Spark plans
# ------------------------------------------------------------------------------------------------


def _orders(spark, sf_dir, m: OrderMapping):
    return load(spark, sf_dir, m.table)


def _a5(spark, sf_dir, m):
    return conv.customer_conversion_analysis(_orders(spark, sf_dir, m), m.cols, m.marker)


def analysis_queries(tag: str, m: OrderMapping) -> list[Query]:
    c = m.cols
    return [
        Query(f"a1_order_type_counts_{tag}",
              lambda s, d: conv.order_type_counts(_orders(s, d, m), c), _sql_type_counts(m)),
        Query(f"f4_sample_types_{tag}",
              lambda s, d: conv.sample_types(_orders(s, d, m), c, m.marker), _sql_sample_types(m)),
        Query(f"a2_first_sample_dates_{tag}",
              lambda s, d: conv.first_sample_dates(_orders(s, d, m), c, m.marker), _sql_first_dates(m)),
        Query(f"a3_sample_counts_{tag}",
              lambda s, d: conv.sample_counts(_orders(s, d, m), c, m.marker), _sql_counts(m)),
        Query(f"a4_customer_sample_analysis_{tag}",
              lambda s, d: conv.customer_sample_analysis(_orders(s, d, m), c, m.marker), _sql_a4(m)),
        Query(f"a5_customer_conversion_{tag}",
              lambda s, d: _a5(s, d, m).withColumn("bulk_amount", F.round("bulk_amount", 4)), _sql_a5(m)),
        # Customers of more than three orders are split in the join.
        Query(f"a5_customer_conversion_split_{tag}",
              lambda s, d: conv.customer_conversion_analysis(_orders(s, d, m), c, m.marker, hot_rows=3).withColumn(
                  "bulk_amount", F.round("bulk_amount", 4)), _sql_a5(m)),
        Query(f"a6_conversion_rate_{tag}",
              lambda s, d: round_doubles(conv.conversion_rate(_a5(s, d, m))), _sql_rate(m)),
        Query(f"a7_avg_days_to_convert_{tag}",
              lambda s, d: round_doubles(conv.average_days_to_convert(_a5(s, d, m))), _sql_avg_days(m)),
        Query(f"a8_days_histogram_{tag}",
              lambda s, d: conv.days_histogram(_a5(s, d, m)),
              _sql_hist(m, "days_to_first_bulk", DAYS_BIN_EDGES, DAYS_BIN_LABELS, "days_bin")),
        Query(f"a9_amount_histogram_{tag}",
              lambda s, d: conv.amount_histogram(_a5(s, d, m)),
              _sql_hist(m, "bulk_amount", AMOUNT_BIN_EDGES, AMOUNT_BIN_LABELS, "amount_bin")),
        Query(f"a10_monthly_trend_{tag}",
              lambda s, d: conv.monthly_trend(_orders(s, d, m), c, m.marker), _sql_monthly(m)),
    ]


def listing_queries(tag: str, m: OrderMapping) -> list[Query]:
    """T1 and T5 over a mapping (row order is part of the operator, not of the comparison)."""
    c = m.cols
    t = c.order_type
    return [
        Query(f"t1_sorted_sample_orders_{tag}",
              lambda s, d: conv.sorted_sample_orders(_orders(s, d, m), c, m.marker),
              f"SELECT * FROM {m.table} WHERE coalesce(contains(CAST({t} AS VARCHAR), '{m.marker}'), false)"),
        Query(f"t5_preview_{tag}",
              lambda s, d: conv.preview(_orders(s, d, m), [c.order_id], 5),
              f"SELECT * FROM {m.table} ORDER BY {c.order_id} LIMIT 5"),
    ]


def queries() -> list[Query]:
    return (analysis_queries("p1", P1) + listing_queries("p1", P1)
            + analysis_queries("p2", P2) + listing_queries("p2", P2))
