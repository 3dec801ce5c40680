"""Shared pieces of the registered queries: table loading, mappings onto the driver tables, rounding."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swatch.schemas import OrderCols
from swatch.sources.tables import read_table


@dataclass(frozen=True)
class Query:
    """A registered query: the Spark plan and, when SQL can state it, the equivalent DuckDB text."""

    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


@dataclass(frozen=True)
class OrderMapping:
    """How a driver table plays the role of the analysis ``orders`` table."""

    table: str
    cols: OrderCols
    marker: str


# TPC-H orders; the sample marker picks the urgent priority.
P1 = OrderMapping("orders", OrderCols(order_id="o_orderkey", customer_id="o_custkey",
                                      order_type="o_orderpriority", date="o_orderdate",
                                      amount="o_totalprice"), "URGENT")
# The event stream; sign-ups are the samples, time-of-day matters for whole days.
P2 = OrderMapping("events", OrderCols(order_id="event_id", customer_id="user_id", order_type="event_type",
                                      date="ts", amount="value"), "sign")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, name, sf_dir)


def round_doubles(df: DataFrame, places: int = 4) -> DataFrame:
    """Round every double column for cross-engine comparison (sums differ in the last bits)."""
    return df.select(*[F.round(F.col(f.name), places).alias(f.name) if isinstance(f.dataType, T.DoubleType)
                       else F.col(f.name) for f in df.schema.fields])
