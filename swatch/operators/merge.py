"""Merges of order tables and change-set operators.

Every operator returns the new version of the target as a DataFrame (a snapshot to publish), with an
``_action`` column saying what happened to each row: ``inserted``, ``updated`` or ``unchanged``.
``merge_counts`` turns that column into the statistics of the operation.

Joins are on the business key only, hash-partitioned on it.  A key is unique on each side (batches
are reduced per key first), so a hot key cannot occur in these joins.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swatch.functions import in_types
from swatch.operators.ids import assign_ids, next_id
from swatch.session import materialize

ACTION = "_action"
INSERTED, UPDATED, UNCHANGED, DELETED = "inserted", "updated", "unchanged", "deleted"
META_COLUMNS = ("id", "created_at", "updated_at")


@dataclass
class MergeResult:
    table: DataFrame   # the new target, with ``_action``
    stats: DataFrame   # one row of counters


def _ts(as_of) -> Column:
    if isinstance(as_of, Column):
        return as_of.cast("timestamp_ntz")
    if isinstance(as_of, str):
        as_of = _dt.datetime.fromisoformat(as_of)
    return F.lit(as_of).cast("timestamp_ntz")


def _null(dtype: T.DataType) -> Column:
    return F.lit(None).cast(dtype)


def route(df: DataFrame, types: Sequence[str], type_col: str = "order_type") -> DataFrame:
    """rows whose type is in ``types``; a null or unknown type goes to no route."""
    return df.where(in_types(type_col, types))


def merge_counts(table: DataFrame, actions: Sequence[str] = (INSERTED, UPDATED)) -> DataFrame:
    """M6: one row with a counter per action (``inserted``, ``updated`` by default)."""
    return table.agg(*[F.count_if(F.col(ACTION) == F.lit(a)).alias(a) for a in actions])


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])


# ------------------------------------------------------------------------------------------------
# M3 + M4 + M7: route sync
# ------------------------------------------------------------------------------------------------

def sync_changes(target: DataFrame, source: DataFrame, types: Sequence[str], key: str = "order_id",
                 type_col: str = "order_type") -> DataFrame:
    """Source rows of the route that ``sync_route`` would update or insert; of the target only the key and
    ``updated_at`` are read."""
    known = target.select(F.col(key).alias("_k"), F.col("updated_at").alias("_u"), F.lit(True).alias("_in_t"))
    src = route(source, types, type_col)
    both = src.join(known, src[key] == F.col("_k"), "left")
    due = F.col("_in_t").isNull() | F.col("_u").isNull() | F.coalesce(src["updated_at"] > F.col("_u"), F.lit(False))
    return both.where(due).select(*[src[c] for c in src.columns])


def sync_route(target: DataFrame, source: DataFrame, types: Sequence[str], as_of, key: str = "order_id",
               insert_order: Sequence[str] = ("id",), type_col: str = "order_type", first_id=None) -> DataFrame:
    """M3 (newer-wins update) and M4 (insert missing) for one route.  ``first_id`` is the first new id, where ``target`` is
    a part of the table.

    * matched rows take the source value columns and ``updated_at = as_of`` when the source row is
      newer or the target's ``updated_at`` is null; ``id``, ``created_at`` and target-only columns stay;
    * source rows of the route with no key in the target are inserted with the source's
      ``created_at``/``updated_at``, target-only columns null, and new ids after the target's largest,
      in ``insert_order`` of the source;
    * nothing is deleted: a row whose type left the route stays.
    Running it twice with the same source changes nothing the second time.
    """
    src = route(source, types, type_col)
    values = [c for c in source.columns if c in target.columns and c != key and c not in META_COLUMNS]
    # Two joins on the unique key: the target takes the source's values, and the source meets the target's keys alone.
    joined = target.join(_prefixed(src, "_s_"), F.col(key) == F.col(f"_s_{key}"), "left")
    matched = F.col(f"_s_{key}").isNotNull()
    newer = matched & F.coalesce(
        (F.col("_s_updated_at") > F.col("updated_at")) | F.col("updated_at").isNull(), F.lit(False))
    cols = []
    for f in target.schema.fields:
        if f.name in values:
            cols.append(F.when(newer, F.col(f"_s_{f.name}")).otherwise(F.col(f.name)).alias(f.name))
        elif f.name == "updated_at":
            cols.append(F.when(newer, _ts(as_of)).otherwise(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    kept = joined.select(
        *cols, F.when(newer, F.lit(UPDATED)).otherwise(F.lit(UNCHANGED)).alias(ACTION))

    new_rows = src.join(target.select(F.col(key).alias("_k")), F.col(key) == F.col("_k"), "left_anti")
    new_cols = []
    for f in target.schema.fields:
        if f.name == "id":
            continue
        if f.name in src.columns and (f.name in values or f.name in (key, "created_at", "updated_at")):
            new_cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        else:
            new_cols.append(_null(f.dataType).alias(f.name))
    order = [F.col(c) for c in insert_order if c in src.columns] + [F.col(key)]
    inserted = new_rows.select(*new_cols, *[o.alias(f"_o{i}") for i, o in enumerate(order)])
    if "id" in target.columns:
        inserted = assign_ids(inserted, [f"_o{i}" for i in range(len(order))],
                              start=next_id(target) if first_id is None else first_id)
    inserted = inserted.drop(*[f"_o{i}" for i in range(len(order))]).withColumn(ACTION, F.lit(INSERTED))
    return kept.unionByName(inserted.select(*kept.columns))


def sync_orders(source: DataFrame, targets: dict[str, tuple[DataFrame, Sequence[str]]], as_of,
                key: str = "order_id") -> tuple[dict[str, DataFrame], DataFrame]:
    """M7: ``sync_route`` for every route; returns the new tables and (route, inserted, updated, errors).

    Each route reads the source with its own pushed-down ``IN`` filter instead of caching it.
    """
    tables, stats = {}, None
    for name, (target, types) in targets.items():
        tables[name] = sync_route(target, source, types, as_of, key)
        row = merge_counts(tables[name]).select(F.lit(name).alias("route"), INSERTED, UPDATED,
                                                F.lit(0).cast("long").alias("errors"))
        stats = row if stats is None else stats.unionByName(row)
    return tables, stats


# ------------------------------------------------------------------------------------------------
# M1 / M2: batch upsert
# ------------------------------------------------------------------------------------------------

def reduce_batch(batch: DataFrame, key: str, order: str | None = None,
                 present: dict[str, str] | None = None) -> DataFrame:
    """Collapse several batch rows of one key into the row a sequential upsert would leave.

    For each column the value of the latest row (by ``order``) that carries the column wins;
    ``present`` maps a column to a boolean column telling whether the row's file had it (reduced to
    "any row of the key had it").  ``_rows``
    keeps the number of rows folded into the key (needed for the counters).  An aggregation, so a
    key repeated a billion times still costs one row per map task before the shuffle.
    """
    present = present or {}
    values = [c for c in batch.columns if c != key and c != order and c not in present.values()]
    if order is None:
        # Rows of a key have no order: the greatest by value stands for it, so keys stay unique.
        flags = list(present.values())
        one = batch.groupBy(key).agg(F.max(F.struct(*values, *flags)).alias("_r"), F.count(F.lit(1)).alias("_rows"))
        return one.select(key, *[F.col(f"_r.{c}").alias(c) for c in [*values, *flags]], "_rows")
    # Columns under one flag (or none) have the same rank, so they are one struct: one comparison a row, not one a column.
    by_flag: dict[str | None, list[str]] = {}
    for c in values:
        by_flag.setdefault(present.get(c), []).append(c)
    aggs, out = [], {}
    for i, (flag, cols) in enumerate(by_flag.items()):
        rank = F.when(F.col(flag), F.col(order)) if flag else F.col(order)
        aggs.append(F.max_by(F.struct(*cols), rank).alias(f"_v{i}"))
        out.update({c: F.col(f"_v{i}")[c].alias(c) for c in cols})
    # Whether any row of the key carried the column: if none did, the target keeps its value.
    flags = list(dict.fromkeys(present.values()))
    aggs += [F.bool_or(F.col(flag)).alias(flag) for flag in flags]
    return (batch.groupBy(key).agg(*aggs, F.count(F.lit(1)).alias("_rows"), F.min(order).alias("_first"))
            .select(key, *[out[c] for c in values], *flags, "_rows", "_first"))


def upsert(target: DataFrame, batch: DataFrame, as_of, key: str = "order_id", preserve_created: bool = True,
           order: str | None = None, present: dict[str, str] | None = None, first_id=None) -> MergeResult:
    """M1 (``preserve_created=True``) and M2 (``False``): insert new keys, update existing ones.

    Only the columns present in the batch are written; target columns absent from the batch keep
    their values.  Updated rows get ``updated_at = as_of``; with ``preserve_created=False`` they also
    get ``created_at = as_of``, as the batch stamps both.  Inserted rows get both stamps, null for
    absent columns, and new ids after the target's largest, in batch order.
    Counters: ``inserted`` = new keys, ``updated`` = all other batch rows (a key repeated in the batch
    is inserted once and then updated).  Rows with a null key match nothing and are left out (I11 rejects them
    before).  ``first_id`` is the first new id, where ``target`` is a part of the table.
    """
    present = present or {}
    # Written once: the update, the insert and the ranges of its ids all read it.
    b = materialize(reduce_batch(batch.where(F.col(key).isNotNull()), key, order, present), "batch")
    values = [c for c in b.columns if c in target.columns and c != key and c not in META_COLUMNS]
    now = _ts(as_of)
    joined = target.join(_prefixed(b, "_s_"), F.col(key) == F.col(f"_s_{key}"), "left")
    hit = F.col(f"_s_{key}").isNotNull()
    cols = []
    for f in target.schema.fields:
        if f.name in values:
            # A column no file of the key carried keeps the target's value.
            carried = hit & F.col(f"_s_{present[f.name]}") if f.name in present else hit
            cols.append(F.when(carried, F.col(f"_s_{f.name}").cast(f.dataType)).otherwise(F.col(f.name))
                        .alias(f.name))
        elif f.name == "updated_at" or (f.name == "created_at" and not preserve_created):
            cols.append(F.when(hit, now).otherwise(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    kept = joined.select(
        *cols, F.when(hit, F.lit(UPDATED)).otherwise(F.lit(UNCHANGED)).alias(ACTION),
        F.coalesce(F.col("_s__rows"), F.lit(0)).alias("_rows"))

    new_rows = b.join(target.select(F.col(key).alias("_k")), F.col(key) == F.col("_k"), "left_anti")
    new_cols = []
    for f in target.schema.fields:
        if f.name == "id":
            continue
        if f.name in ("created_at", "updated_at"):
            new_cols.append(now.alias(f.name))
        elif f.name in present and f.name in values:
            new_cols.append(F.when(F.col(present[f.name]), F.col(f.name).cast(f.dataType)).alias(f.name))
        elif f.name in values or f.name == key:
            new_cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        else:
            new_cols.append(_null(f.dataType).alias(f.name))
    order_cols = (["_first"] if order else []) + [key]
    inserted = new_rows.select(*new_cols, "_rows", *order_cols[:-1])
    if "id" in target.columns:
        inserted = assign_ids(inserted, order_cols, start=next_id(target) if first_id is None else first_id)
    inserted = inserted.withColumn(ACTION, F.lit(INSERTED))
    table = kept.unionByName(inserted.select(*kept.columns))
    stats = table.agg(
        F.count_if(F.col(ACTION) == INSERTED).alias(INSERTED),
        F.coalesce(F.sum(F.when(F.col(ACTION) == INSERTED, F.col("_rows") - 1).otherwise(F.col("_rows"))),
                   F.lit(0)).cast("long").alias(UPDATED))
    return MergeResult(table.drop("_rows"), stats)


# ------------------------------------------------------------------------------------------------
# Change sets
# ------------------------------------------------------------------------------------------------

def lookup(target: DataFrame, keys: DataFrame, key: str = "order_id") -> tuple[DataFrame, DataFrame]:
    """(rows found for the requested keys, requested keys not found)."""
    k = keys.select(key).distinct()
    return target.join(k, key, "left_semi"), k.join(target.select(key), key, "left_anti")


def _one_per_key(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(the smallest row of each key, by value; the other rows).  Rows with a null key all stay in the first.

    Equal rows are counted and each key's smallest is an aggregate, so no task holds all rows of a key."""
    others = [c for c in rows.columns if c != key]
    counted = rows.where(F.col(key).isNotNull()).groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_m"))
    least = counted.groupBy(F.col(key).alias("_k")).agg(F.min(F.struct(F.lit(0).alias("_"), *others)).alias("_r"))
    first = least.select(F.col("_k").alias(key), *[F.col("_r")[c].alias(c) for c in others]).select(*rows.columns)
    mine = F.struct(F.lit(0).alias("_"), *others).eqNullSafe(F.col("_r")).cast("int")
    again = (counted.join(least, counted[key] == F.col("_k")).withColumn("_m", (F.col("_m") - mine).cast("int"))
             .where("_m > 0").select(*rows.columns, F.explode(F.sequence(F.lit(1), F.col("_m"))).alias("_copy")))
    return first.unionByName(rows.where(F.col(key).isNull())), again.select(*rows.columns)


def resolve_renames(keys: DataFrame, renames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Which of several simultaneous renames ``(old, new)`` can stand, so that keys stay unique: (accepted, rejected).

    ``keys`` has the present keys (column ``key``), all of ``old`` among them, each with one rename at most.  Of renames to
    one new key that of the smallest old key wins.  Winning renames form chains and rings: A to B and B to C.  A ring
    stands; a chain stands if its last new key is no present key, and else none of it does, because the row in
    the way stays and with it every row behind.  The ends of chains are found by doubling: each round a chain's
    pieces reach twice as far, so there are about log2(longest chain) rounds."""
    won = renames.groupBy("new").agg(F.min("old").alias("old"))
    step = materialize(won.select("old", "new", F.col("new").alias("end")), "renames")
    for _ in range(max(1, int(step.count()).bit_length() + 1)):
        ahead = step.select(F.col("old").alias("_at"), F.col("end").alias("_further"))
        far = step.join(ahead, step["end"] == F.col("_at"), "left")
        if not far.where("_at IS NOT NULL").limit(1).count():
            break
        step = materialize(far.select("old", "new", F.coalesce("_further", "end").alias("end")), "renames")
    # What ends at a key that is itself renamed is a ring.
    inner = step.select(F.col("old").alias("_o"))
    blocked = (step.join(inner, step["end"] == F.col("_o"), "left_anti")
               .join(keys.select(F.col("key").alias("_k")), F.col("end") == F.col("_k"), "left_semi"))
    accepted = step.join(blocked.select("old"), "old", "left_anti").select("old", "new")
    return accepted, renames.join(accepted.select("old"), "old", "left_anti").select("old", "new")


def insert_new(target: DataFrame, rows: DataFrame, as_of, key: str = "order_id") -> tuple[DataFrame, DataFrame]:
    """insert rows whose key is absent; rows with an existing key are returned as rejects.

    New rows get ``created_at = updated_at = as_of`` and ids after the target's largest.  Of rows that
    repeat a new key the smallest by value is inserted, the others are rejects too.
    """
    rejects = rows.join(target.select(key), key, "left_semi")
    fresh, again = _one_per_key(rows.join(target.select(key), key, "left_anti"), key)
    rejects = rejects.unionByName(again.select(*rejects.columns))
    cols = []
    for f in target.schema.fields:
        if f.name == "id":
            continue
        if f.name in ("created_at", "updated_at"):
            cols.append(_ts(as_of).alias(f.name))
        elif f.name in rows.columns:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        else:
            cols.append(_null(f.dataType).alias(f.name))
    fresh = fresh.select(*cols)
    if "id" in target.columns:
        fresh = assign_ids(fresh, [key], start=next_id(target))
    table = (target.withColumn(ACTION, F.lit(UNCHANGED))
             .unionByName(fresh.withColumn(ACTION, F.lit(INSERTED)).select(*target.columns, ACTION)))
    return table, rejects


def patch(target: DataFrame, changes: DataFrame, as_of, key: str = "order_id",
          lookup_col: str = "lookup_key") -> tuple[DataFrame, DataFrame]:
    """F8: partial update; only non-null change fields are set and ``updated_at = as_of``.

    ``changes`` has ``lookup_col`` (the key to find) and any subset of target columns; a ``key``
    column in it renames the row's key.  All changes happen at once, so keys may be exchanged or passed on; a rename that
    would give two rows one key is not applied, nor is the rest of its change (``resolve_renames``).  Returns (new table,
    change rows that were not applied: the key was not found, the rename cannot stand, or another change, smaller by value, has
    the same key).
    """
    every, (changes, again) = changes, _one_per_key(changes, lookup_col)
    present = target.select(F.col(key).alias("key"))
    found = changes.join(present.withColumnRenamed("key", lookup_col), lookup_col, "left_semi").select(*every.columns)
    missing = changes.join(present.withColumnRenamed("key", lookup_col), lookup_col, "left_anti").select(*every.columns)
    refused = again
    if key in every.columns and key != lookup_col:
        found = materialize(found, "found-changes")
        renames = found.where(F.col(key).isNotNull() & (F.col(key) != F.col(lookup_col))).select(
            F.col(lookup_col).alias("old"), F.col(key).cast(target.schema[key].dataType).alias("new"))
        _, rejected = resolve_renames(present, renames)
        rejected = materialize(rejected.select(F.col("old").alias(lookup_col)), "rejected-renames")
        refused = refused.unionByName(found.join(rejected, lookup_col, "left_semi").select(*every.columns))
        found = found.join(rejected, lookup_col, "left_anti")
    fields = [c for c in changes.columns if c in target.columns and c not in ("id", "created_at", "updated_at")]
    ch = found.select(F.col(lookup_col).alias("_lk"), *[F.col(c).alias(f"_c_{c}") for c in fields])
    joined = target.join(ch, target[key] == F.col("_lk"), "left")
    hit = F.col("_lk").isNotNull()
    cols = []
    for f in target.schema.fields:
        if f.name in fields:
            cols.append(F.coalesce(F.col(f"_c_{f.name}").cast(f.dataType), F.col(f.name)).alias(f.name))
        elif f.name == "updated_at":
            cols.append(F.when(hit, _ts(as_of)).otherwise(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    table = joined.select(*cols, F.when(hit, F.lit(UPDATED)).otherwise(F.lit(UNCHANGED)).alias(ACTION))
    return table, missing.unionByName(refused)


def delete_keys(target: DataFrame, keys: DataFrame, key: str = "order_id") -> tuple[DataFrame, DataFrame]:
    """(target without the given keys, requested keys that were not found)."""
    k = keys.select(key).distinct()
    return target.join(k, key, "left_anti"), k.join(target.select(key), key, "left_anti")


def edit_customers(customers: DataFrame, changes: DataFrame, fields: Sequence[str], key: str = "id",
                   change_col: str = "changes") -> tuple[DataFrame, DataFrame]:
    """whitelisted edit.  ``changes`` holds (key, map<string,string>); a field present in the map
    is set, even to null; fields outside ``fields`` are ignored; ``updated_at`` is not touched.

    Map values are text: timestamps are parsed, ``tags`` is a JSON array.  Of several changes of a key the
    greatest by its JSON text is applied.  Returns (new table, change rows whose key was not found).
    """
    ch = (changes.groupBy(F.col(key).alias("_ck"))
          .agg(F.max_by(F.col(change_col), F.to_json(change_col)).alias("_m")))
    joined = customers.join(ch, customers[key] == F.col("_ck"), "left")
    cols = []
    for f in customers.schema.fields:
        if f.name in fields:
            raw = F.element_at(F.col("_m"), F.lit(f.name))
            if isinstance(f.dataType, T.ArrayType):
                val = F.from_json(raw, f.dataType)
            elif isinstance(f.dataType, T.StringType):
                val = raw
            else:
                val = raw.try_cast(f.dataType)
            present = F.coalesce(F.map_contains_key(F.col("_m"), F.lit(f.name)), F.lit(False))
            cols.append(F.when(present, val).otherwise(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    table = joined.select(*cols, F.when(F.col("_ck").isNotNull(), F.lit(UPDATED)).otherwise(F.lit(UNCHANGED))
                          .alias(ACTION))
    # Distinct keys: of a customer table that is a chain of outer joins, none is worked out for them.
    missing = changes.join(customers.select(key).distinct(), key, "left_anti")
    return table, missing
