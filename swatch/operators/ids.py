"""Dense surrogate ids in a given order (M5).

Every input, small or large, takes two passes over a materialised, range-partitioned copy, so no
task ever holds more than one range partition:
  1. ``repartitionByRange`` + ``sortWithinPartitions`` puts the rows in global order across
     partitions; ``monotonically_increasing_id`` then encodes (partition, position) and the copy is
     written once to the shared checkpoint directory (``session.materialize``), so both later
     reads see the same values.
  2. Row counts per partition (one row per partition) become running offsets, broadcast back (the
     offsets table is bounded by the partition count), and ``start + offset + position`` is the id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swatch.session import materialize


def next_id(df: DataFrame, id_col: str = "id") -> Column:
    """1 + the largest id in ``df`` (1 when empty), as a scalar subquery: lazy, planned with the
    query that uses it, no separate driver round trip."""
    return F.coalesce(df.agg(F.max(id_col)).scalar(), F.lit(0)).cast("long") + F.lit(1)


def assign_ids(df: DataFrame, order: Sequence[str | Column], start: int | Column = 1, id_col: str = "id",
               num_partitions: int | None = None) -> DataFrame:
    """Add ``id_col`` = start, start+1, ... following ``order`` (which must be unique per row)."""
    order = list(order)
    first = start if isinstance(start, Column) else F.lit(start)
    # Without a number adaptive execution joins small neighbouring ranges, which keeps their order.
    ranged = ((df.repartitionByRange(num_partitions, *order) if num_partitions else df.repartitionByRange(*order))
              .sortWithinPartitions(*order)
              .withColumn("_mid", F.monotonically_increasing_id()))
    ranged = materialize(ranged)
    pos = ranged.withColumn("_pid", F.shiftright("_mid", 33)).withColumn(
        "_pos", F.col("_mid") - F.shiftleft(F.col("_pid"), 33))
    counts = pos.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition: a window without partitioning is bounded by the partition count.
    offsets = counts.select(
        "_pid",
        F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off"))
    out = pos.join(F.broadcast(offsets), "_pid")
    return out.withColumn(id_col, (first + F.col("_off") + F.col("_pos")).cast("long")).drop(
        "_mid", "_pid", "_pos", "_off")
