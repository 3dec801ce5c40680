"""Quality checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swatch.operators.skew import HOT_KEY_ROWS, salted_exists
from swatch.schemas import AMOUNT_NAME_HINTS, DATE_NAME_HINTS, OrderCols


class MissingColumnsError(ValueError):
    pass


def require_columns(df: DataFrame, cols: Sequence[str]) -> None:
    """Fail fast when a required column is absent (metadata only, no data read)."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise MissingColumnsError(f"missing required columns: {', '.join(missing)}")


def find_columns(df: DataFrame, order_id: str = "order_id", customer_id: str = "customer_id",
                 order_type: str = "order_type") -> OrderCols:
    """Q1: pick the date column (first name containing date/time) and the amount column (first name
    containing amount/price/value), in column order, case-insensitively.  No date column is an
    error; no amount column gives ``amount=None``.
    """
    names = df.columns
    dates = [n for n in names if any(h in n.lower() for h in DATE_NAME_HINTS)]
    if not dates:
        raise MissingColumnsError("no date column found")
    amounts = [n for n in names if any(h in n.lower() for h in AMOUNT_NAME_HINTS)]
    return OrderCols(order_id=order_id, customer_id=customer_id, order_type=order_type, date=dates[0],
                     amount=amounts[0] if amounts else None)


def duplicate_keys(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Q2 (batch side): keys that occur more than once, with their row counts."""
    keys = [key] if isinstance(key, str) else list(key)
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
            .where(F.col("rows") > 1))


def key_clashes(batch: DataFrame, target: DataFrame, key: str, hot_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """Q2 (target side): batch rows whose key already exists in the target.  A key that many batch rows share is
    split over several tasks."""
    return salted_exists(batch, target.select(key), key, True, hot_rows)


def duplicate_key_count(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """One row (rows, distinct_keys, duplicate_rows) where duplicate_rows = sum(n - 1)."""
    keys = [key] if isinstance(key, str) else list(key)
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
                       F.count(F.lit(1)).alias("distinct_keys"),
                       F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, hot_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """Q3: child rows whose non-null key has no parent row (foreign-key check).  A parent with very many children
    is split over several tasks."""
    known = parent.select(F.col(parent_key).cast(child.schema[child_key].dataType).alias(child_key))
    return salted_exists(child.where(F.col(child_key).isNotNull()), known, child_key, False, hot_rows)
