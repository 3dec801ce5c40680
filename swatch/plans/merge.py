"""Registered merge queries (S8, F2, M1-M7, F6-F9) over mapping P3/P4."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from swatch.operators import merge as mg
from swatch.operators.quality import key_clashes
from swatch.plans.common import Query
from swatch.plans.orders_model import (
    AS_OF,
    AS_OF_SQL,
    BULK_TYPES_P3,
    CUTOFF,
    EVERY_ORDER_SQL,
    ORDER_COLUMNS,
    ORIGINAL_TARGET_SQL,
    P3_SQL,
    SAMPLE_TYPES_P3,
    every_order,
    original_target,
    p3_orders,
    p4_target,
    p4_target_sql,
)
from swatch.session import ensure_checkpoint_dir
from swatch.sources import snapshots as snap

VALUE_COLUMNS = [c for c in ORDER_COLUMNS if c not in ("id", "order_id", "created_at", "updated_at")]
ROUTES = {"sample_orders": (SAMPLE_TYPES_P3, "sample_status"), "bulk_orders": (BULK_TYPES_P3, "production_status")}


def _types_sql(types) -> str:
    return ", ".join(f"'{t}'" for t in types)


# ------------------------------------------------------------------------------------------------
# Sync (M3, M4, M6, M7)
# ------------------------------------------------------------------------------------------------


def _sync_spark(route: str):
    def build(spark, sf_dir):
        src = p3_orders(spark, sf_dir)
        targets = {r: (p4_target(src, t, extra), t) for r, (t, extra) in ROUTES.items()}
        tables, _ = mg.sync_orders(src, {route: targets[route]}, AS_OF)
        return tables[route]
    return build


def _sync_sql(route: str) -> str:
    types, extra = ROUTES[route]
    picks = ",\n  ".join(f"CASE WHEN newer THEN s_{c} ELSE {c} END AS {c}" for c in VALUE_COLUMNS)
    s_cols = ", ".join(f"r.{c} AS s_{c}" for c in VALUE_COLUMNS)
    plain = ", ".join(VALUE_COLUMNS)
    return f"""
WITH p3 AS ({P3_SQL}),
tgt AS ({p4_target_sql(types, extra)}),
r AS (SELECT * FROM p3 WHERE order_type IN ({_types_sql(types)})),
j AS (SELECT t.*, {s_cols},
        (r.order_id IS NOT NULL AND coalesce(r.updated_at > t.updated_at OR t.updated_at IS NULL, false)) AS newer
      FROM tgt t LEFT JOIN r ON r.order_id = t.order_id)
SELECT id, order_id, {picks},
  created_at, CASE WHEN newer THEN {AS_OF_SQL} ELSE updated_at END AS updated_at, {extra},
  CASE WHEN newer THEN 'updated' ELSE 'unchanged' END AS _action
FROM j
UNION ALL
SELECT (SELECT coalesce(max(id), 0) FROM tgt) + row_number() OVER (ORDER BY id, order_id) AS id, order_id,
  {plain}, created_at, updated_at, NULL AS {extra}, 'inserted' AS _action
FROM r WHERE order_id NOT IN (SELECT order_id FROM tgt)"""


def _sync_counts_spark(spark, sf_dir):
    src = p3_orders(spark, sf_dir)
    targets = {r: (p4_target(src, t, extra), t) for r, (t, extra) in ROUTES.items()}
    _, stats = mg.sync_orders(src, targets, AS_OF)
    return stats


def _sync_counts_sql() -> str:
    parts = []
    for route in ROUTES:
        parts.append(f"SELECT '{route}' AS route, count(*) FILTER (WHERE _action = 'inserted') AS inserted, "
                     f"count(*) FILTER (WHERE _action = 'updated') AS updated, CAST(0 AS BIGINT) AS errors "
                     f"FROM ({_sync_sql(route)}) x")
    return "\nUNION ALL\n".join(parts)


# ------------------------------------------------------------------------------------------------
# Upsert (M1, M2)
# ------------------------------------------------------------------------------------------------

BATCH_COLUMNS = ("order_id", "amount", "order_type", "customer_name", "handler")
BATCH_FROM = "1998-01-01"


def _batch(src):
    return (src.where(F.col("order_created_date") >= F.lit(BATCH_FROM))
            .select("order_id", (F.col("amount") + 1).alias("amount"), "order_type", "customer_name", "handler"))


BATCH_SQL = (f"SELECT order_id, amount + 1 AS amount, order_type, customer_name, handler FROM p3 "
             f"WHERE order_created_date >= TIMESTAMP '{BATCH_FROM}'")


def _upsert_spark(preserve_created: bool, counts: bool = False):
    def build(spark, sf_dir):
        src = p3_orders(spark, sf_dir)
        res = mg.upsert(original_target(src), _batch(src), AS_OF, preserve_created=preserve_created)
        return res.stats if counts else res.table
    return build


def _upsert_sql(preserve_created: bool) -> str:
    in_batch = [c for c in BATCH_COLUMNS if c != "order_id"]
    cols = []
    for c in ORDER_COLUMNS:
        if c in in_batch:
            cols.append(f"CASE WHEN b.order_id IS NOT NULL THEN b.{c} ELSE t.{c} END AS {c}")
        elif c == "updated_at" or (c == "created_at" and not preserve_created):
            cols.append(f"CASE WHEN b.order_id IS NOT NULL THEN {AS_OF_SQL} ELSE t.{c} END AS {c}")
        else:
            cols.append(f"t.{c}")
    ins = []
    for c in ORDER_COLUMNS:
        if c == "id":
            ins.append("(SELECT coalesce(max(id), 0) FROM tgt) + row_number() OVER (ORDER BY b.order_id) AS id")
        elif c in ("created_at", "updated_at"):
            ins.append(f"{AS_OF_SQL} AS {c}")
        elif c in BATCH_COLUMNS:
            ins.append(f"b.{c}")
        else:
            ins.append(f"NULL AS {c}")
    return f"""
WITH p3 AS ({P3_SQL}), tgt AS ({ORIGINAL_TARGET_SQL}), b AS ({BATCH_SQL})
SELECT {', '.join(cols)}, CASE WHEN b.order_id IS NOT NULL THEN 'updated' ELSE 'unchanged' END AS _action
FROM tgt t LEFT JOIN b ON b.order_id = t.order_id
UNION ALL
SELECT {', '.join(ins)}, 'inserted' AS _action
FROM b WHERE b.order_id NOT IN (SELECT order_id FROM tgt)"""


def _upsert_counts_sql() -> str:
    return f"""
WITH p3 AS ({P3_SQL}), tgt AS ({ORIGINAL_TARGET_SQL}), b AS ({BATCH_SQL})
SELECT count(*) FILTER (WHERE order_id NOT IN (SELECT order_id FROM tgt)) AS inserted,
       count(*) FILTER (WHERE order_id IN (SELECT order_id FROM tgt)) AS updated
FROM b"""


# ------------------------------------------------------------------------------------------------
# Change sets
# ------------------------------------------------------------------------------------------------


def _keys(spark, sf_dir, flag: str):
    """Order ids of line items; those of seventh lines are of no order."""
    from swatch.plans.common import load
    li = load(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == flag)
    key = F.col("l_orderkey").cast("string")
    return li.select(F.when(F.col("l_linenumber") == 7, F.concat(key, F.lit("-x"))).otherwise(key).alias("order_id"))


def _keys_sql(flag: str) -> str:
    return (f"SELECT DISTINCT CAST(l_orderkey AS VARCHAR) || CASE WHEN l_linenumber = 7 THEN '-x' ELSE '' END AS order_id "
            f"FROM lineitem WHERE l_returnflag = '{flag}'")


def _lookup(found: bool):
    def build(spark, sf_dir):
        hit, miss = mg.lookup(every_order(p3_orders(spark, sf_dir)), _keys(spark, sf_dir, "A"))
        return hit if found else miss
    return build


def _lookup_sql(found: bool) -> str:
    head = f"WITH p3 AS ({P3_SQL}), tgt AS ({EVERY_ORDER_SQL}), k AS ({_keys_sql('A')}) "
    if found:
        return head + "SELECT * FROM tgt WHERE order_id IN (SELECT order_id FROM k)"
    return head + "SELECT order_id FROM k WHERE order_id NOT IN (SELECT order_id FROM tgt)"


NEW_FROM = "1998-07-01"
NEW_COLUMNS = ("order_id", "customer_name", "amount", "order_type")


def _insert_new(rejects: bool):
    def build(spark, sf_dir):
        src = p3_orders(spark, sf_dir)
        rows = src.where(F.col("order_created_date") >= F.lit(NEW_FROM)).select(*NEW_COLUMNS)
        table, rej = mg.insert_new(original_target(src), rows, AS_OF)
        return rej if rejects else table
    return build


def _insert_new_sql(rejects: bool) -> str:
    rows = (f"SELECT {', '.join(NEW_COLUMNS)} FROM p3 WHERE order_created_date >= TIMESTAMP '{NEW_FROM}'")
    head = f"WITH p3 AS ({P3_SQL}), tgt AS ({ORIGINAL_TARGET_SQL}), rows AS ({rows}) "
    if rejects:
        return head + "SELECT * FROM rows WHERE order_id IN (SELECT order_id FROM tgt)"
    ins = []
    for c in ORDER_COLUMNS:
        if c == "id":
            ins.append("(SELECT coalesce(max(id), 0) FROM tgt) + row_number() OVER (ORDER BY order_id) AS id")
        elif c in ("created_at", "updated_at"):
            ins.append(f"{AS_OF_SQL} AS {c}")
        elif c in NEW_COLUMNS:
            ins.append(c)
        else:
            ins.append(f"NULL AS {c}")
    return head + (f"SELECT *, 'unchanged' AS _action FROM tgt UNION ALL "
                   f"SELECT {', '.join(ins)}, 'inserted' AS _action FROM rows "
                   f"WHERE order_id NOT IN (SELECT order_id FROM tgt)")


def _changes(src):
    """Changes of open orders; those of medium priority ask for orders that are not there."""
    key = F.when(F.col("order_type") == "3-MEDIUM", F.concat("order_id", F.lit("-x"))).otherwise(F.col("order_id"))
    return (src.where(F.col("order_status") == "P")
            .select(key.alias("lookup_key"),
                    F.when(F.col("order_type") == "5-LOW", F.concat("order_id", F.lit("-r"))).alias("order_id"),
                    F.lit("closed").alias("handler"),
                    F.lit(None).cast("double").alias("amount")))


CHANGES_SQL = ("SELECT order_id || CASE WHEN order_type = '3-MEDIUM' THEN '-x' ELSE '' END AS lookup_key, "
               "CASE WHEN order_type = '5-LOW' THEN order_id || '-r' END AS order_id, "
               "'closed' AS handler, CAST(NULL AS DOUBLE) AS amount FROM p3 WHERE order_status = 'P'")


def _renames(src):
    """Open orders take a number further on, which may be taken, given up by its order, or wanted by another one."""
    step = F.when(F.col("order_type") == "1-URGENT", 1).when(F.col("order_type") == "2-HIGH", 2).otherwise(7)
    return src.where(F.col("order_status") != "O").select(
        F.col("order_id").alias("lookup_key"), (F.col("id") + step).cast("string").alias("order_id"),
        F.lit("moved").alias("handler"), F.lit(None).cast("double").alias("amount"))


RENAMES_SQL = ("SELECT order_id AS lookup_key, CAST(id + CASE order_type WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 7 END "
               "AS VARCHAR) AS order_id, 'moved' AS handler, CAST(NULL AS DOUBLE) AS amount FROM p3 WHERE order_status <> 'O'")
# Renames that can stand: the winners of their new keys, on chains that do not end at a key that stays.  Keys only grow, so
# there are no rings.
STANDING_SQL = """
won AS (SELECT order_id AS new, min(lookup_key) AS old FROM ch WHERE lookup_key IN (SELECT order_id FROM tgt) GROUP BY 1),
walk AS (SELECT old, new AS stop FROM won UNION ALL SELECT w.old, n.new FROM walk w JOIN won n ON n.old = w.stop),
standing AS (SELECT old FROM walk WHERE stop NOT IN (SELECT old FROM won) AND stop NOT IN (SELECT order_id FROM tgt))"""


def _patch(missing: bool, changes=_changes):
    def build(spark, sf_dir):
        src = p3_orders(spark, sf_dir)
        table, miss = mg.patch(every_order(src), changes(src), AS_OF)
        return miss if missing else table
    return build


def _patch_sql(missing: bool, renames: bool = False) -> str:
    head = f"WITH RECURSIVE p3 AS ({P3_SQL}), tgt AS ({EVERY_ORDER_SQL}), ch AS ({RENAMES_SQL if renames else CHANGES_SQL})"
    if renames:
        head += "," + STANDING_SQL
    applied = "lookup_key IN (SELECT old FROM standing)" if renames else "lookup_key IN (SELECT order_id FROM tgt)"
    if missing:
        return head + f" SELECT * FROM ch WHERE NOT ({applied})"
    cols = []
    for c in ORDER_COLUMNS:
        if c in ("order_id", "handler", "amount"):
            cols.append(f"coalesce(c.{c}, t.{c}) AS {c}")
        elif c == "updated_at":
            cols.append(f"CASE WHEN c.lookup_key IS NOT NULL THEN {AS_OF_SQL} ELSE t.updated_at END AS updated_at")
        else:
            cols.append(f"t.{c}")
    return head + (f" SELECT {', '.join(cols)}, CASE WHEN c.lookup_key IS NOT NULL THEN 'updated' "
                   f"ELSE 'unchanged' END AS _action FROM tgt t LEFT JOIN (SELECT * FROM ch WHERE {applied}) c "
                   f"ON c.lookup_key = t.order_id")


def _delete(missing: bool):
    def build(spark, sf_dir):
        kept, miss = mg.delete_keys(every_order(p3_orders(spark, sf_dir)), _keys(spark, sf_dir, "R"))
        return miss if missing else kept
    return build


def _delete_sql(missing: bool) -> str:
    head = f"WITH p3 AS ({P3_SQL}), tgt AS ({EVERY_ORDER_SQL}), k AS ({_keys_sql('R')}) "
    if missing:
        return head + "SELECT order_id FROM k WHERE order_id NOT IN (SELECT order_id FROM tgt)"
    return head + "SELECT * FROM tgt WHERE order_id NOT IN (SELECT order_id FROM k)"


# ------------------------------------------------------------------------------------------------
# Append load
# ------------------------------------------------------------------------------------------------

def _append(clash: bool, counts: bool):
    def build(spark, sf_dir):
        from swatch.sources.snapshots import append_load
        src = p3_orders(spark, sf_dir)
        since = NEW_FROM if clash else CUTOFF
        batch = src.where(F.col("order_created_date") >= F.lit(since)).select(*NEW_COLUMNS)
        res = append_load(original_target(src), batch)
        return res.stats if counts else res.table
    return build


def _append_sql(clash: bool, counts: bool) -> str:
    since = NEW_FROM if clash else CUTOFF
    rows = f"SELECT {', '.join(NEW_COLUMNS)} FROM p3 WHERE order_created_date >= TIMESTAMP '{since}'"
    head = f"WITH p3 AS ({P3_SQL}), tgt AS ({ORIGINAL_TARGET_SQL}), rows AS ({rows}) "
    if counts:
        if clash:
            return head + "SELECT CAST(0 AS BIGINT) AS inserted, count(*) AS errors FROM rows"
        return head + "SELECT count(*) AS inserted, CAST(0 AS BIGINT) AS errors FROM rows"
    ins = []
    for c in ORDER_COLUMNS:
        if c == "id":
            ins.append("(SELECT coalesce(max(id), 0) FROM tgt) + row_number() OVER (ORDER BY order_id) AS id")
        elif c in NEW_COLUMNS:
            ins.append(c)
        else:
            ins.append(f"NULL AS {c}")
    return head + (f"SELECT *, 'unchanged' AS _action FROM tgt UNION ALL "
                   f"SELECT {', '.join(ins)}, 'inserted' AS _action FROM rows")


# ------------------------------------------------------------------------------------------------
# Snapshots: published and read back, whole and in buckets
# ------------------------------------------------------------------------------------------------

BUCKETS = 64


def _base(spark) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables-{uuid.uuid4().hex}"


def _publish_read_back(spark, sf_dir):
    base, target = _base(spark), original_target(p3_orders(spark, sf_dir))
    snap.ensure_tables(spark, base, "0", ["customer_conversions"])
    snap.publish(spark, base, "1", {"original_orders": target, "other": target.select("id")})
    snap.publish(spark, base, "2", {"other": target.select("order_id")})
    return snap.read_current(spark, base, "original_orders")


def _csv_read_back(spark, sf_dir):
    """A globally sorted CSV, read again as typed text."""
    path, target = _base(spark), original_target(p3_orders(spark, sf_dir)).select("id", "order_id", "amount", "created_at")
    snap.write_csv(target, path, sort_by=["amount", "id"])
    return spark.read.schema(target.schema).option("header", "true").csv(path)


def _bucketed_sync(route: str):
    def build(spark, sf_dir):
        base, src = _base(spark), p3_orders(spark, sf_dir)
        snap.publish(spark, base, "1", {r: p4_target(src, t, extra) for r, (t, extra) in ROUTES.items()},
                     buckets={r: ("order_id", BUCKETS) for r in ROUTES})
        snap.sync_snapshot(spark, base, "2", src, {r: t for r, (t, _) in ROUTES.items()}, AS_OF)
        return snap.read_current(spark, base, route)
    return build


def _bucketed_upsert(spark, sf_dir):
    base, src = _base(spark), p3_orders(spark, sf_dir)
    snap.publish(spark, base, "1", {"t": original_target(src)}, buckets={"t": ("order_id", BUCKETS)})
    snap.upsert_snapshot(spark, base, "2", "t", _batch(src), AS_OF)
    return snap.read_current(spark, base, "t")


def _clashes(spark, sf_dir):
    """Q2: line items whose order is in the table before the cut-off; orders of many lines are split."""
    from swatch.plans.common import load
    li = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("order_id"), "l_linenumber", "l_partkey")
    return key_clashes(li, original_target(p3_orders(spark, sf_dir)), "order_id", hot_rows=3)


def queries() -> list[Query]:
    return [
        Query("s7_publish_read_back_p3", _publish_read_back, f"WITH p3 AS ({P3_SQL}) {ORIGINAL_TARGET_SQL}"),
        Query("s5_csv_read_back_p3", _csv_read_back,
              f"WITH p3 AS ({P3_SQL}) SELECT id, order_id, amount, created_at FROM ({ORIGINAL_TARGET_SQL}) t"),
        *[Query(f"m7_bucketed_sync_{r}_p4", _bucketed_sync(r), f"SELECT * EXCLUDE (_action) FROM ({_sync_sql(r)}) s")
          for r in ROUTES],
        Query("m1_bucketed_upsert_p3", _bucketed_upsert, f"SELECT * EXCLUDE (_action) FROM ({_upsert_sql(True)}) u"),
        Query("q2_key_clashes_p3", _clashes, f"""WITH p3 AS ({P3_SQL})
              SELECT CAST(l_orderkey AS VARCHAR) AS order_id, l_linenumber, l_partkey FROM lineitem
              WHERE CAST(l_orderkey AS VARCHAR) IN (SELECT order_id FROM ({ORIGINAL_TARGET_SQL}) t)"""),
        Query("f8_rename_chains_p3", _patch(False, _renames), _patch_sql(False, True)),
        Query("f8_rename_rejected_p3", _patch(True, _renames), _patch_sql(True, True)),
        Query("s8_append_load_p3", _append(False, False), _append_sql(False, False)),
        Query("s8_append_counts_p3", _append(False, True), _append_sql(False, True)),
        Query("s8_append_rejected_counts_p3", _append(True, True), _append_sql(True, True)),
        Query("f2_route_sample_p3", lambda s, d: mg.route(p3_orders(s, d), SAMPLE_TYPES_P3),
              f"WITH p3 AS ({P3_SQL}) SELECT * FROM p3 WHERE order_type IN ({_types_sql(SAMPLE_TYPES_P3)})"),
        Query("m7_sync_sample_orders_p4", _sync_spark("sample_orders"), _sync_sql("sample_orders")),
        Query("m7_sync_bulk_orders_p4", _sync_spark("bulk_orders"), _sync_sql("bulk_orders")),
        Query("m6_sync_counts_p4", _sync_counts_spark, _sync_counts_sql()),
        Query("m1_upsert_p3", _upsert_spark(True), _upsert_sql(True)),
        Query("m2_upsert_overwrite_created_p3", _upsert_spark(False), _upsert_sql(False)),
        Query("m6_upsert_counts_p3", _upsert_spark(True, counts=True), _upsert_counts_sql()),
        Query("f6_lookup_found_p3", _lookup(True), _lookup_sql(True)),
        Query("f6_lookup_missing_p3", _lookup(False), _lookup_sql(False)),
        Query("f7_insert_new_p3", _insert_new(False), _insert_new_sql(False)),
        Query("f7_insert_rejects_p3", _insert_new(True), _insert_new_sql(True)),
        Query("f8_patch_p3", _patch(False), _patch_sql(False)),
        Query("f8_patch_missing_p3", _patch(True), _patch_sql(True)),
        Query("f9_delete_p3", _delete(False), _delete_sql(False)),
        Query("f9_delete_missing_p3", _delete(True), _delete_sql(True)),
    ]
