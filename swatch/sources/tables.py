"""Table reads and table definitions."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from swatch.schemas import TABLE_SCHEMAS


def table_path(base: str, name: str) -> str:
    """A table is ``<base>/<name>.parquet`` (a file or a directory of part files)."""
    return os.path.join(base, f"{name}.parquet") if "://" not in base else f"{base.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, name: str, base: str, columns: Sequence[str] | None = None,
               fmt: str = "parquet", options: dict | None = None) -> DataFrame:
    """Read a table; with ``columns`` only those are selected, so Parquet prunes the rest.

    ``fmt="jdbc"`` passes ``options`` through to Spark's JDBC source (``base`` is then unused).
    """
    if fmt == "jdbc":
        df = spark.read.format("jdbc").options(**(options or {}), dbtable=name).load()
    else:
        reader = spark.read.options(**(options or {}))
        df = reader.format(fmt).load(table_path(base, name))
    return df.select(*columns) if columns else df


def empty_table(spark: SparkSession, name_or_schema: str | T.StructType) -> DataFrame:
    """An empty DataFrame with a table's schema (create-if-missing starts from this)."""
    schema = TABLE_SCHEMAS[name_or_schema] if isinstance(name_or_schema, str) else name_or_schema
    return spark.createDataFrame([], schema)
