"""Hot-key splitting for equi-joins.

``salted_join`` and ``salted_exists`` are for joins whose small side has few rows per key, ``grid_join`` for those where a key may
be hot on both sides.

A key may hold a third of all rows.  AQE's skew join cannot split it when the small side of the
join is an aggregate (its rule needs plain shuffle reads on both sides), and a sort-merge join would
then stream the whole hot key through one task.  ``salted_join`` splits such keys itself:

* hot keys are those with more than ``rows_per_task`` rows (from counts the caller has, or can get
  with one partial aggregate); there are at most ``total rows / rows_per_task`` of them, a proven
  bound, so the hot-key table is broadcast;
* a hot key's large-side rows get a salt in ``[0, salts)`` from a hash of the row (deterministic,
  so a recomputed task gets the same salts), all other rows salt 0;
* the small side's rows of a hot key are repeated once per salt, all others once;
* the join is on (key, salt).  Only hot keys are replicated, and only their few small-side rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows one task should handle for a single key before the key is split.
HOT_KEY_ROWS = 4_000_000


def hot_keys(counts: DataFrame, key: str, count_col: str, rows_per_task: int = HOT_KEY_ROWS) -> DataFrame:
    """(key, _salts) for keys with more than ``rows_per_task`` rows; at most total/rows_per_task rows."""
    n = F.col(count_col)
    return (counts.where(n > F.lit(rows_per_task))
            .select(key, F.ceil(n / F.lit(rows_per_task)).cast("int").alias("_salts")))


def salted_join(large: DataFrame, small: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Inner equi-join of ``large`` and ``small`` on ``key`` with the ``hot`` keys split (see module doc)."""
    hot_b = F.broadcast(hot)  # bounded: at most total rows / rows_per_task keys
    row_hash = F.xxhash64(*[F.col(c) for c in large.columns])
    big = (large.join(hot_b, key, "left")
           .withColumn("_salt", F.when(F.col("_salts").isNull(), F.lit(0))
                       .otherwise(F.pmod(row_hash, F.col("_salts")).cast("int")))
           .drop("_salts"))
    few = (small.join(hot_b, key, "left")
           .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)))
           .drop("_salts"))
    return big.join(few, [key, "_salt"]).drop("_salt")


def _salted(large: DataFrame, key: str, hot: DataFrame, name: str = "_salt", salts: str = "_salts") -> DataFrame:
    """Adds a salt in ``[0, salts)`` from a hash of the row, 0 where the key is not hot."""
    row_hash = F.xxhash64(*[F.col(c) for c in large.columns])
    salt = F.when(F.col(salts).isNull(), F.lit(0)).otherwise(F.pmod(row_hash, F.col(salts)).cast("int"))
    return large.join(F.broadcast(hot), key, "left").withColumn(name, salt).drop(salts)


def salted_exists(large: DataFrame, keys: DataFrame, key: str, exists: bool = True,
                  rows_per_task: int = HOT_KEY_ROWS) -> DataFrame:
    """Semi join (``exists``) or anti join of ``large`` with the values of ``keys`` (one column, named ``key``), hot keys split.

    Hot keys are found with one partial aggregate over ``large``; there are at most its rows / ``rows_per_task`` of
    them.  A key of ``keys`` is repeated once per salt, however often it stands there.  As in any such join, rows with a null key have no
    match."""
    counts = large.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col(key).isNotNull())
    hot = hot_keys(counts, key, "_n", rows_per_task)
    known = keys.select(key).distinct().join(F.broadcast(hot), key, "left")
    known = known.select(key, F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)).alias("_salt"))
    out = _salted(large, key, hot).join(known, [key, "_salt"], "left_semi" if exists else "left_anti")
    return out.select(*large.columns)


def grid_of(left: DataFrame, right: DataFrame, key: str, left_rows: int, right_rows: int) -> DataFrame:
    """(key, _a, _b): keys that need a grid of ``_a`` x ``_b`` cells, so that a cell meets about ``left_rows`` rows of
    one side with ``right_rows`` of the other.  At most left / left_rows + right / right_rows keys do."""
    count = lambda df, n: df.groupBy(key).agg(F.count(F.lit(1)).alias(n))
    both = count(left, "_l").join(count(right, "_r"), key)
    size = lambda n, rows: F.ceil(F.col(n) / F.lit(rows)).cast("int")
    return both.select(key, size("_l", left_rows).alias("_a"), size("_r", right_rows).alias("_b")).where("_a > 1 OR _b > 1")


def grid_join(left: DataFrame, right: DataFrame, key: str, grid: DataFrame) -> DataFrame:
    """Inner equi-join whose hot keys (``grid_of``) are dealt over a grid: a row of the left side belongs to one row of
    cells and is repeated in each of its columns, a row of the right side the other way round, so each pair meets in one
    cell.  The work of a key is its left times its right rows, which is what the result holds; no task gets more than a cell of it."""
    def dealt(df: DataFrame, own: str, own_size: str, other: str, other_size: str) -> DataFrame:
        row_hash = F.xxhash64(*[F.col(c) for c in df.columns])
        sized = df.join(F.broadcast(grid), key, "left")
        return sized.withColumn(own, F.pmod(row_hash, F.coalesce(F.col(own_size), F.lit(1))).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other_size), F.lit(1)) - 1))).drop("_a", "_b")

    one, two = dealt(left, "_i", "_a", "_j", "_b"), dealt(right, "_j", "_b", "_i", "_a")
    return one.join(two, [key, "_i", "_j"]).drop("_i", "_j")
