"""Customer reports."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swatch.session import materialize


def customers_by_handler(customers: DataFrame, handler: str | None = None) -> DataFrame:
    """customers of one handler; a blank or null argument returns every customer."""
    if handler:
        return customers.where(F.col("handler") == F.lit(handler))
    return customers


def customer_summary(sample_customers: DataFrame, bulk_customers: DataFrame) -> DataFrame:
    """One row (total_customers, sample_customers, bulk_customers, converted_customers,
    conversion_rate); the rate is converted / sample × 100 rounded half-even to 2 places, 0 when
    there is no sample customer; the total is the plain sum of both sides.

    One aggregate over a tagged union of the two tables: no join between one-row results.
    """
    tagged = (sample_customers.select(F.lit("s").alias("_side"), F.col("converted_to_bulk").alias("_conv"))
              .unionByName(bulk_customers.select(F.lit("b").alias("_side"), F.lit(False).alias("_conv"))))
    agg = tagged.agg(F.count_if(F.col("_side") == "s").alias("sample_customers"),
                     F.count_if(F.col("_side") == "b").alias("bulk_customers"),
                     F.count_if((F.col("_side") == "s") & F.coalesce(F.col("_conv"), F.lit(False)))
                     .alias("converted_customers"))
    rate = F.when(F.col("sample_customers") > 0,
                  F.bround(F.col("converted_customers") / F.col("sample_customers") * F.lit(100.0), 2)
                  ).otherwise(F.lit(0.0))
    return agg.select((F.col("sample_customers") + F.col("bulk_customers")).alias("total_customers"),
                      "sample_customers", "bulk_customers", "converted_customers", rate.alias("conversion_rate"))


def unconverted(customers: DataFrame, n: int = 50) -> DataFrame:
    """Up to ``n`` sample customers with ``converted_to_bulk = false`` (a null flag is excluded),
    latest ``last_sample_date`` first with nulls first, ties by id.  Planned as a top-n."""
    return (customers.where(F.col("converted_to_bulk") == F.lit(False))
            .orderBy(F.desc_nulls_first("last_sample_date"), F.asc("id"))
            .limit(n))


def unconverted_report(customers: DataFrame, links: DataFrame, n: int = 50, recent: int = 5) -> DataFrame:
    """The T2 customers with their ``recent`` latest sample orders nested as
    ``sample_orders array<struct<order_id, date, amount>>`` (date descending, nulls first).

    The top-n side has ``n`` rows, which adaptive execution broadcasts if their size allows; the latest-k per customer is a ``row_number``
    filter that Spark plans as a partial ``WindowGroupLimit`` before the shuffle, so a customer with
    a million links sends at most ``recent`` rows per task.
    """
    top = unconverted(customers, n).select(
        "id", F.col("customer_name").alias("name"), "shop", "handler", "first_sample_date", "last_sample_date",
        "sample_orders_count")
    ids = top.select(F.col("id").alias("sample_customer_id"))
    w = Window.partitionBy("sample_customer_id").orderBy(F.desc_nulls_first("order_date"), F.asc("order_id"))
    latest = (links.join(ids, "sample_customer_id", "left_semi")
              .withColumn("_rn", F.row_number().over(w))
              .where(F.col("_rn") <= recent)
              .groupBy("sample_customer_id")
              .agg(F.sort_array(F.collect_list(F.struct("_rn", "order_id", F.col("order_date").alias("date"),
                                                        "amount"))).alias("_orders")))
    out = top.join(latest, top["id"] == latest["sample_customer_id"], "left")
    orders = F.transform(F.coalesce(F.col("_orders"), F.array().cast(latest.schema["_orders"].dataType)),
                         lambda x: F.struct(x["order_id"].alias("order_id"), x["date"].alias("date"),
                                            x["amount"].alias("amount")))
    return (out.select("id", "name", "shop", "handler", "first_sample_date", "last_sample_date",
                       F.col("sample_orders_count").cast("long").alias("sample_orders_count"),
                       orders.alias("sample_orders"))
            .orderBy(F.desc_nulls_first("last_sample_date"), F.asc("id")))


def explode_report(report: DataFrame) -> DataFrame:
    """T3 flattened: one row per nested order (customers without orders keep one row of nulls)."""
    return (report.select("*", F.posexplode_outer("sample_orders").alias("pos", "o"))
            .select("id", "name", "shop", "handler", "first_sample_date", "last_sample_date", "sample_orders_count",
                    "pos", F.col("o.order_id").alias("order_id"), F.col("o.date").alias("order_date"),
                    F.col("o.amount").alias("amount")))


def page(df: DataFrame, skip: int = 0, limit: int = 100, order=("id",)) -> DataFrame:
    """T4: rows ``skip`` .. ``skip + limit`` in ``order``, of a table read as it is: fit for the first pages, as a task gathers
    ``skip + limit`` rows.  ``Pages`` serves deep ones."""
    return df.orderBy(*order).offset(skip).limit(limit)


@dataclass
class Pages:
    """A table laid out for paging: range-partitioned and sorted files, and how many rows come before each.

    The layout is one shuffle and is written once; a page then reads only the files that its rows lie in, however deep it
    is.  The counts are one number per file."""

    spark: SparkSession
    schema: T.StructType
    order: tuple[str, ...]
    files: list[str]
    before: list[int]   # rows in earlier files, and at the end the rows of all

    @classmethod
    def of(cls, df: DataFrame, order: Sequence[str] = ("id",), files: int | None = None) -> Pages:
        """``order`` must tell rows apart, or rows that it does not may change places between two pages."""
        ranged = df.repartitionByRange(files, *order) if files else df.repartitionByRange(*order)
        table = materialize(ranged.sortWithinPartitions(*order), "pages")
        counts = table.groupBy(F.col("_metadata.file_path").alias("path")).count().collect()  # a row per file
        # Writers number files as the range partitions are numbered, and a partition may be cut into several files.
        place = lambda r: [int(x) for x in re.findall(r"part-(\d+)|c(\d+)", r["path"].rsplit("/", 1)[1]) for x in x if x]
        counts.sort(key=place)
        return cls(df.sparkSession, df.schema, tuple(order), [r["path"] for r in counts],
                   [0, *accumulate(r["count"] for r in counts)])

    def page(self, skip: int = 0, limit: int = 100) -> DataFrame:
        """Rows ``skip`` .. ``skip + limit``; none beyond the end."""
        first = max(0, bisect_right(self.before, skip) - 1)
        last = bisect_left(self.before, skip + limit)
        some = self.files[first:last]
        if not some:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*some)
        return rows.orderBy(*self.order).offset(skip - self.before[first]).limit(limit)
