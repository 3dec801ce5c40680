"""Sample-to-bulk conversion analysis over an order table.

Plan shape of the main operator (``customer_conversion_analysis``):

  orders ──partial agg──▶ shuffle(customer) ──final agg──▶ per-customer sample facts (A4)
  orders ──filter bulk, 3 columns──▶ shuffle(customer) ─┐
                                                        ├─ join on customer, date > first sample
  per-customer first sample date (one row per key) ─────┘      ──▶ agg (already partitioned) ──▶ left join

Per-customer facts come from map-side-combined aggregates, so a customer holding a third of all
orders costs one row per map task before the shuffle.  The only join keeps one row per customer on
its small side; a customer with more orders than one task should take is salted over several tasks
(``operators.skew``), and AQE turns the join into a broadcast when the measured small side is small.
No window over a customer's orders is used, so no task ever holds a whole customer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swatch.functions import as_double, as_timestamp_ntz, bin_index, is_sample, percent_text, whole_days
from swatch.schemas import (
    AMOUNT_BIN_EDGES,
    AMOUNT_BIN_LABELS,
    DAYS_BIN_EDGES,
    DAYS_BIN_LABELS,
    SAMPLE_MARKER,
    STATUS_CONVERTED,
    STATUS_NOT_CONVERTED,
    OrderCols,
)
from swatch.operators.quality import require_columns
from swatch.operators.skew import HOT_KEY_ROWS, hot_keys, salted_join


def _typed(orders: DataFrame, cols: OrderCols) -> tuple[Column, Column]:
    """Date and amount columns, coerced the way the analysis reads them (bad text → null)."""
    types = {f.name: f.dataType for f in orders.schema.fields}
    date = as_timestamp_ntz(cols.date, types[cols.date])
    if cols.amount is None:
        amount = F.lit(None).cast("double")
    else:
        amount = as_double(cols.amount, types[cols.amount])
    return date, amount


def _base(orders: DataFrame, cols: OrderCols, marker: str, keep_null_customer: bool = False) -> DataFrame:
    """(customer_id, _date, _amount, _is_sample) with only the columns the analysis needs."""
    require_columns(orders, [cols.order_id, cols.customer_id, cols.order_type])
    date, amount = _typed(orders, cols)
    out = orders
    if not keep_null_customer:
        # Null customers never form a group in the per-customer results.
        out = out.where(F.col(cols.customer_id).isNotNull())
    return out.select(
        F.col(cols.customer_id).alias("customer_id"),
        F.col(cols.order_id).alias("_order_id"),
        date.alias("_date"),
        amount.alias("_amount"),
        is_sample(cols.order_type, marker).alias("_is_sample"),
    )


# ------------------------------------------------------------------------------------------------
# F4, A1
# ------------------------------------------------------------------------------------------------

def sample_types(orders: DataFrame, cols: OrderCols, marker: str = SAMPLE_MARKER) -> DataFrame:
    """the distinct order types that contain the marker."""
    t = F.col(cols.order_type)
    return (orders.select(t.cast("string").alias("order_type"))
            .where(is_sample("order_type", marker))
            .distinct())


def order_type_counts(orders: DataFrame, cols: OrderCols) -> DataFrame:
    """A1: rows per order type, null type excluded, most frequent first (ties by type)."""
    return (orders.where(F.col(cols.order_type).isNotNull())
            .groupBy(F.col(cols.order_type).alias("order_type"))
            .agg(F.count(F.lit(1)).alias("order_count"))
            .orderBy(F.desc("order_count"), F.asc("order_type")))


# ------------------------------------------------------------------------------------------------
# A2-A5
# ------------------------------------------------------------------------------------------------

def first_sample_dates(orders: DataFrame, cols: OrderCols, marker: str = SAMPLE_MARKER) -> DataFrame:
    """A2: earliest sample date per customer that has a sample order (null when all dates are)."""
    b = _base(orders, cols, marker).where("_is_sample")
    return b.groupBy("customer_id").agg(F.min("_date").alias("first_sample_date"))


def sample_counts(orders: DataFrame, cols: OrderCols, marker: str = SAMPLE_MARKER) -> DataFrame:
    """A3: sample orders and all orders per customer, for customers with a sample order."""
    b = _base(orders, cols, marker)
    return (b.groupBy("customer_id")
            .agg(F.count_if("_is_sample").alias("sample_count"), F.count(F.lit(1)).alias("total_orders"))
            .where(F.col("sample_count") > 0))


def _sample_facts(base: DataFrame) -> DataFrame:
    s = F.col("_is_sample")
    return (base.groupBy("customer_id")
            .agg(F.min(F.when(s, F.col("_date"))).alias("first_sample_date"),
                 F.count_if(s).alias("sample_count"),
                 F.count(F.lit(1)).alias("total_orders"))
            .where(F.col("sample_count") > 0))


def _with_ratio(df: DataFrame) -> DataFrame:
    ratio = F.col("sample_count") / F.col("total_orders")
    return df.withColumns({"sample_ratio": percent_text(ratio), "sample_ratio_value": ratio})


def customer_sample_analysis(orders: DataFrame, cols: OrderCols, marker: str = SAMPLE_MARKER) -> DataFrame:
    """A4: (customer_id, first_sample_date, sample_count, total_orders, sample_ratio, sample_ratio_value).

    One aggregation with conditional aggregates replaces the two per-customer results and their
    inner join (J1).
    """
    return _with_ratio(_sample_facts(_base(orders, cols, marker)))


def customer_conversion_analysis(orders: DataFrame, cols: OrderCols, marker: str = SAMPLE_MARKER,
                                 hot_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """A5: A4 plus (bulk_count, bulk_amount, days_to_first_bulk, conversion_status).

    A bulk order is any non-sample order (null type included) of the same customer dated strictly
    after the customer's first sample date (J2).  Days are whole 24-hour periods.  Customers with
    more than ``hot_rows`` orders are split over several tasks in the join (``operators.skew``).
    """
    base = _base(orders, cols, marker)
    facts = _sample_facts(base)
    fact_cols = ["customer_id", "first_sample_date", "sample_count", "total_orders"]
    bulk = (base.where(~F.col("_is_sample") & F.col("_date").isNotNull())
            .select("customer_id", "_order_id", "_date", "_amount"))
    # Grouping by every fact column keeps the uses of ``facts`` identical, so the per-customer
    # aggregate is computed once and its shuffle reused.  A customer with more bulk rows than one task
    # should take is salted over several tasks; the rest join as usual.
    hot = hot_keys(facts, "customer_id", "total_orders", hot_rows)
    joined = salted_join(bulk, facts.where(F.col("first_sample_date").isNotNull()), "customer_id", hot)
    converted = (joined.where(F.col("_date") > F.col("first_sample_date"))
                 .groupBy(*fact_cols)
                 .agg(F.count(F.lit(1)).alias("bulk_count"),
                      F.sum("_amount").alias("_bulk_amount"),
                      F.min("_date").alias("_first_bulk_date"))
                 .drop(*fact_cols[1:]))
    out = facts.join(converted, "customer_id", "left")
    bulk_count = F.coalesce(F.col("bulk_count"), F.lit(0).cast("long"))
    return _with_ratio(out).select(
        "customer_id", "first_sample_date", "sample_count", "total_orders", "sample_ratio",
        "sample_ratio_value",
        bulk_count.alias("bulk_count"),
        F.coalesce(F.col("_bulk_amount"), F.lit(0.0)).alias("bulk_amount"),
        whole_days("first_sample_date", "_first_bulk_date").alias("days_to_first_bulk"),
        F.when(bulk_count > 0, F.lit(STATUS_CONVERTED)).otherwise(F.lit(STATUS_NOT_CONVERTED))
        .alias("conversion_status"),
    )


# ------------------------------------------------------------------------------------------------
# A6-A9 (read the A5 result)
# ------------------------------------------------------------------------------------------------

def _converted(analysis: DataFrame) -> Column:
    return F.col("conversion_status") == F.lit(STATUS_CONVERTED)


def conversion_rate(analysis: DataFrame) -> DataFrame:
    """One row (converted_customers, sample_customers, conversion_rate); null rate when empty."""
    return analysis.agg(
        F.count_if(_converted(analysis)).alias("converted_customers"),
        F.count(F.lit(1)).alias("sample_customers"),
    ).withColumn("conversion_rate", F.try_divide(F.col("converted_customers").cast("double"),
                                                 F.col("sample_customers")))


def average_days_to_convert(analysis: DataFrame) -> DataFrame:
    """Mean days to the first bulk order over converted customers (null when none)."""
    return (analysis.where(_converted(analysis))
            .agg(F.count(F.lit(1)).alias("converted_customers"),
                 F.avg("days_to_first_bulk").alias("avg_days_to_convert")))


def _histogram(values: DataFrame, value_col: str, edges, labels, label_col: str) -> DataFrame:
    """Counts per (lo, hi] bin with empty bins kept, as one global aggregate unpivoted to rows.

    One partial aggregate per task and a single final row: no shuffle by bin, no join.
    """
    idx = bin_index(value_col, edges)
    counts = values.agg(*[F.count_if(idx == F.lit(i)).alias(f"_b{i}") for i in range(len(labels))])
    rows = F.array(*[F.struct(F.lit(i).alias("bin_order"), F.lit(lab).alias(label_col),
                              F.col(f"_b{i}").alias("customers"))
                     for i, lab in enumerate(labels)])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def days_histogram(analysis: DataFrame) -> DataFrame:
    """Converted customers per days bin (0,7], (7,14], ... (90,inf); 0 days falls in no bin."""
    conv = analysis.where(_converted(analysis))
    return _histogram(conv, "days_to_first_bulk", DAYS_BIN_EDGES, DAYS_BIN_LABELS, "days_bin")


def amount_histogram(analysis: DataFrame) -> DataFrame:
    """Converted customers per bulk-amount bin (0,1000], ... (50000,inf); amount 0 in no bin."""
    conv = analysis.where(_converted(analysis))
    return _histogram(conv, "bulk_amount", AMOUNT_BIN_EDGES, AMOUNT_BIN_LABELS, "amount_bin")


# ------------------------------------------------------------------------------------------------
# A10, T1, T5
# ------------------------------------------------------------------------------------------------

def monthly_trend(orders: DataFrame, cols: OrderCols, marker: str = SAMPLE_MARKER) -> DataFrame:
    """A10: sample and bulk (= every non-sample) order counts per ``yyyy-MM``; null dates dropped.

    Rows of every customer count, a null customer included.  One aggregation: the two monthly series
    need no outer join (J8).
    """
    b = _base(orders, cols, marker, keep_null_customer=True).where(F.col("_date").isNotNull())
    return (b.groupBy(F.date_format("_date", "yyyy-MM").alias("month"))
            .agg(F.count_if("_is_sample").alias("sample_orders"),
                 F.count_if(~F.col("_is_sample")).alias("bulk_orders")))


def sorted_sample_orders(orders: DataFrame, cols: OrderCols, marker: str = SAMPLE_MARKER) -> DataFrame:
    """The sample orders, all columns, by date ascending with nulls last (ties by order id)."""
    return (orders.where(is_sample(cols.order_type, marker))
            .orderBy(F.asc_nulls_last(cols.date), F.asc(cols.order_id)))


def preview(df: DataFrame, order_by: list[str], n: int = 5) -> DataFrame:
    """T5: the first ``n`` rows in table order (a top-n, planned as TakeOrderedAndProject)."""
    return df.orderBy(*order_by).limit(n)
