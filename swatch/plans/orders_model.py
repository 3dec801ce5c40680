"""Mapping P3/P4: the driver tables seen as the shop's order tables.

P3: ``orders ⋈ customer ⋈ nation`` gives orders with a customer name (the nation name, so names fan
out to many orders), a shop (market segment, FURNITURE as a blank shop), a handler (order status, P
as a blank handler) and an order type (priority: URGENT and HIGH are sample types, MEDIUM and NOT
SPECIFIED bulk types, LOW unknown).  ``o_orderkey`` is the load ordinal and the id.

P4: a previous state of the routed tables: the orders dated before the cut-off, with half the
amount, ``updated_at`` moved by the order status (F one day back, O same, P one day ahead) and null
for blank shops, and a target-only status column filled.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swatch.plans.common import load

SAMPLE_TYPES_P3 = ("1-URGENT", "2-HIGH")
BULK_TYPES_P3 = ("3-MEDIUM", "4-NOT SPECIFIED")
CUTOFF = "1999-01-01"
AS_OF = dt.datetime(2026, 1, 1, 0, 0, 0)
AS_OF_SQL = "TIMESTAMP '2026-01-01 00:00:00'"

ORDER_COLUMNS = ("id", "order_id", "customer_name", "shop", "handler", "amount", "order_type",
                 "order_status", "order_created_date", "created_at", "updated_at")


def p3_orders(spark: SparkSession, sf_dir: str, names: str = "nation") -> DataFrame:
    """P3 (``names="nation"``) or P6 (``names="customer"``: the customer's own name)."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                            "o_orderdate", "o_orderpriority")
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    n = load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    # Customers meet the nations first, so that orders are never shuffled by the few nation keys.
    joined = o.join(c.join(n, c.c_nationkey == n.n_nationkey), o.o_custkey == c.c_custkey)
    return joined.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderkey").cast("string").alias("order_id"),
        F.col("n_name" if names == "nation" else "c_name").alias("customer_name"),
        F.nullif(F.col("c_mktsegment"), F.lit("FURNITURE")).alias("shop"),
        F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("handler"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderpriority").alias("order_type"),
        F.col("o_orderstatus").alias("order_status"),
        F.col("o_orderdate").alias("order_created_date"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderdate").alias("updated_at"),
    )


P3_SQL = """SELECT o.o_orderkey AS id, CAST(o.o_orderkey AS VARCHAR) AS order_id, n.n_name AS customer_name,
  nullif(c.c_mktsegment, 'FURNITURE') AS shop, nullif(o.o_orderstatus, 'P') AS handler,
  o.o_totalprice AS amount, o.o_orderpriority AS order_type, o.o_orderstatus AS order_status,
  o.o_orderdate AS order_created_date, o.o_orderdate AS created_at, o.o_orderdate AS updated_at
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey"""

# As P3 with the customer's own name, so names split between converted and unconverted.
P6_SQL = P3_SQL.replace("n.n_name AS customer_name", "c.c_name AS customer_name")


def p4_target(src: DataFrame, types, extra_col: str) -> DataFrame:
    """The previous state of one routed table (see module doc)."""
    upd = F.col("updated_at")
    shifted = (F.when(F.col("shop").isNull(), F.lit(None).cast("timestamp_ntz"))
               .when(F.col("order_status") == "F", upd - F.expr("INTERVAL 1 DAY"))
               .when(F.col("order_status") == "P", upd + F.expr("INTERVAL 1 DAY"))
               .otherwise(upd))
    return (src.where(F.col("order_type").isin(list(types)) & (F.col("order_created_date") < F.lit(CUTOFF)))
            .withColumns({"amount": F.col("amount") / 2, "updated_at": shifted,
                          extra_col: F.concat(F.lit("s-"), F.col("order_status"))}))


def p4_target_sql(types, extra_col: str) -> str:
    tl = ", ".join(f"'{t}'" for t in types)
    cols = [c for c in ORDER_COLUMNS if c not in ("amount", "updated_at")]
    return f"""SELECT {', '.join(cols)}, amount / 2 AS amount,
  CASE WHEN shop IS NULL THEN NULL WHEN order_status = 'F' THEN updated_at - INTERVAL 1 DAY
       WHEN order_status = 'P' THEN updated_at + INTERVAL 1 DAY ELSE updated_at END AS updated_at,
  's-' || order_status AS {extra_col}
FROM p3 WHERE order_type IN ({tl}) AND order_created_date < TIMESTAMP '{CUTOFF}'"""


def original_target(src: DataFrame) -> DataFrame:
    """``original_orders`` before the cut-off (all types) with half amounts: the upsert target."""
    return (src.where(F.col("order_created_date") < F.lit(CUTOFF))
            .withColumn("amount", F.col("amount") / 2))


ORIGINAL_TARGET_SQL = (f"SELECT * REPLACE (amount / 2 AS amount) FROM p3 "
                       f"WHERE order_created_date < TIMESTAMP '{CUTOFF}'")


def every_order(src: DataFrame) -> DataFrame:
    """``original_orders`` with all orders at half amounts: the table that changes are applied to."""
    return src.withColumn("amount", F.col("amount") / 2)


EVERY_ORDER_SQL = "SELECT * REPLACE (amount / 2 AS amount) FROM p3"
