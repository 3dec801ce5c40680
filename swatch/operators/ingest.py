"""Order-file cleaning (I1-I12), in the fixed step order of the source:
I1 headers, missing-value texts, I2 required columns, I3 dates, I6 whole-column rule, I4 ints, I5 floats, I7 strings,
I8 keep-first; then I12 NaN cleaning, I11 rejects, I9 load stamps, I10 schema alignment.

Input is text (every column ``string``), one row per file row, with a ``_file`` column naming the
file and an ordinal column giving the row's position in it (``sources.files`` provides both).
Everything is a column expression except I8 (one aggregate per (file, key)) and I6.  The text is read once: the
aggregate of I8 also tells whether any row of the key was dirty, its result is written, and I6's verdict of a
file comes from that.  The aggregate is map-side combined, so a key or file with a third of the rows is
reduced to one row per task before any shuffle.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swatch.functions import missing_to_null, to_double, to_int_or_zero, to_timestamp_ntz
from swatch.operators.quality import require_columns
from swatch.schemas import (
    COUNT_DEFAULT_COLUMNS,
    DATE_COLUMNS,
    FLOAT_COLUMNS,
    HEADER_MAP,
    INT_COLUMNS,
    MONEY_DEFAULT_COLUMNS,
    STRING_COLUMNS,
    WHOLE_COLUMN_RULE_COLUMN,
)
from swatch.session import materialize

FILE_COL = "_file"
ORDINAL_COL = "_ordinal"


PRESENCE_PREFIX = "_has_"


def map_headers(df: DataFrame, mapping: Mapping[str, str] = HEADER_MAP) -> DataFrame:
    """Rename the headers present in ``mapping``; absent ones are ignored.  Presence flags
    (``_has_<header>``, see ``sources.files.union_with_presence``) are renamed with their column."""
    names = dict(mapping)
    names.update({PRESENCE_PREFIX + k: PRESENCE_PREFIX + v for k, v in mapping.items()})
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def present_columns(df: DataFrame) -> dict[str, str]:
    """The ``present`` map for ``merge.upsert``: column -> its presence flag, from the flags in ``df``."""
    return {c[len(PRESENCE_PREFIX):]: c for c in df.columns
            if c.startswith(PRESENCE_PREFIX) and c[len(PRESENCE_PREFIX):] in df.columns}


def coerce_dates(df: DataFrame, cols: Sequence[str] = DATE_COLUMNS) -> DataFrame:
    """Date text to ``timestamp_ntz``; text no layout understands becomes null."""
    return df.withColumns({c: to_timestamp_ntz(c) for c in cols if c in df.columns})


def null_missing(df: DataFrame, skip: Sequence[str] = (FILE_COL, ORDINAL_COL)) -> DataFrame:
    """Cell texts that stand for a missing value (``n/a``, ``NULL``, ...) become null, in every text column."""
    return df.withColumns({f.name: missing_to_null(f.name) for f in df.schema.fields
                           if isinstance(f.dataType, T.StringType) and f.name not in skip})


DIRTY = "_dirty"
BROADCAST_FILES = 200_000


def mark_dirty(df: DataFrame, col: str = WHOLE_COLUMN_RULE_COLUMN) -> DataFrame:
    """I6, first half: ``col`` parsed as a number with nulls kept (no null → 0 here), and whether its text
    was none."""
    if col not in df.columns:
        return df
    bad = F.col(col).isNotNull() & to_double(col).isNull() & ~F.lower(F.trim(F.col(col))).isin("nan", "+nan", "-nan")
    return df.withColumn(DIRTY, bad).withColumn(col, to_double(col))


def zero_if_dirty(df: DataFrame, col: str = WHOLE_COLUMN_RULE_COLUMN, by: str = FILE_COL) -> DataFrame:
    """I6, second half: if any row of a file is dirty, the whole column of that file becomes 0.0.

    The per-file verdict is one row per dirty file, written and broadcast below a checked count: a join on the file's name would
    deal all rows to as many tasks as there are files.  ``df`` should be a written table, as it is read twice.
    """
    if DIRTY not in df.columns:
        return df
    verdict = materialize(df.where(DIRTY).select(by).distinct().withColumn("_zero", F.lit(True)), "dirty-files")
    if verdict.limit(BROADCAST_FILES + 1).count() <= BROADCAST_FILES:
        verdict = F.broadcast(verdict)
    return (df.drop(DIRTY).join(verdict, by, "left")
            .withColumn(col, F.when(F.col("_zero"), F.lit(0.0)).otherwise(F.col(col))).drop("_zero"))


def coerce_ints(df: DataFrame, cols: Sequence[str] = INT_COLUMNS) -> DataFrame:
    """I4: number text to int (toward zero); null or bad to 0."""
    return df.withColumns({c: to_int_or_zero(c) for c in cols if c in df.columns})


def coerce_floats(df: DataFrame, cols: Sequence[str] = FLOAT_COLUMNS) -> DataFrame:
    """Number text to double; null or bad to 0.0."""
    return df.withColumns({c: F.coalesce(to_double(c), F.lit(0.0)) for c in cols if c in df.columns})


def fill_strings(df: DataFrame, cols: Sequence[str] = STRING_COLUMNS) -> DataFrame:
    """Text columns with null as ""."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols if c in df.columns})


def keep_first(df: DataFrame, key: str = "order_id", by: str = FILE_COL, ordinal: str = ORDINAL_COL) -> DataFrame:
    """I8: the first row (lowest ordinal) per (file, key).

    An aggregate (``min_by`` of the whole row) instead of a window: a key repeated a billion times
    is reduced map-side and never lands whole in one task.
    """
    others = [c for c in df.columns if c not in (by, key, DIRTY)]
    dirty = [F.bool_or(DIRTY).alias(DIRTY)] if DIRTY in df.columns else []  # of any row, not of the first one
    row = F.struct(*others)
    # The key leads: the sort under the aggregate compares the first bytes of the leading column, which in files are all alike.
    return (df.groupBy(key, by).agg(F.min_by(row, F.col(ordinal)).alias("_r"), *dirty)
            .select(by, key, *[F.col(f"_r.{c}").alias(c) for c in others], *[DIRTY for _ in dirty])
            .select(*df.columns))


def null_nans(df: DataFrame) -> DataFrame:
    """NaN doubles become null."""
    return df.withColumns({f.name: F.nanvl(F.col(f.name), F.lit(None).cast("double"))
                           for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)})


def split_rejects(df: DataFrame, key: str = "order_id") -> tuple[DataFrame, DataFrame]:
    """(rows with a key, rows with a blank key)."""
    blank = F.col(key).isNull() | (F.col(key) == F.lit(""))
    return df.where(~blank), df.where(blank)


def stamp(df: DataFrame, as_of) -> DataFrame:
    """``created_at = updated_at = as_of``."""
    if isinstance(as_of, str):
        as_of = _dt.datetime.fromisoformat(as_of)
    ts = F.lit(as_of).cast("timestamp_ntz")
    return df.withColumns({"created_at": ts, "updated_at": ts})


def align_schema(df: DataFrame, schema: T.StructType, keep: Sequence[str] = ()) -> DataFrame:
    """The target's columns in its order: missing money columns 0.0, missing counts 0, other
    missing columns null; unknown columns dropped (except ``keep``)."""
    cols = []
    for f in schema.fields:
        if f.name in df.columns:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        elif f.name in MONEY_DEFAULT_COLUMNS:
            cols.append(F.lit(0.0).cast(f.dataType).alias(f.name))
        elif f.name in COUNT_DEFAULT_COLUMNS:
            cols.append(F.lit(0).cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*cols, *[c for c in keep if c in df.columns])


def carried(df: DataFrame, schema: T.StructType, keep: Sequence[str] = ()) -> DataFrame:
    """The target's columns that the files carry, typed; unknown columns dropped (except ``keep``).  What an upsert
    takes: a column that no file carries must not reach it."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields if f.name in df.columns],
                     *[c for c in keep if c in df.columns])


def preprocess(df: DataFrame, key: str = "order_id", by: str = FILE_COL, ordinal: str = ORDINAL_COL) -> DataFrame:
    """I1, I2, I3, I6, I4, I5, I7, I8 in the source's order; the cleaned rows are written once (I6 reads them twice)."""
    out = map_headers(df)
    require_columns(out, [key])
    out = null_missing(out, (by, ordinal))
    out = coerce_dates(out)
    out = mark_dirty(out)
    out = coerce_ints(out)
    out = coerce_floats(out)
    out = fill_strings(out)
    out = keep_first(out, key, by, ordinal)
    return zero_if_dirty(materialize(out, "clean-orders"), by=by) if DIRTY in out.columns else out


def prepare_batch(df: DataFrame, schema: T.StructType, as_of, key: str = "order_id",
                  keep: Sequence[str] = (FILE_COL, ORDINAL_COL), align: bool = True) -> tuple[DataFrame, DataFrame]:
    """I12, I11, I9, I10 after ``preprocess``: (load-ready rows, rejected rows).  An append (S8) takes all columns of the
    target (``align``); an upsert only those that the files carry.  Presence flags are kept, so that it can leave
    columns untouched that the row's own file lacked."""
    good, rejects = split_rejects(null_nans(df), key)
    target = T.StructType([f for f in schema.fields if f.name != "id"])
    keep = list(keep) + [c for c in df.columns if c.startswith(PRESENCE_PREFIX)]
    return (align_schema if align else carried)(stamp(good, as_of), target, keep), rejects
