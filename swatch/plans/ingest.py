"""Registered ingest queries (I1-I12, A12, M1 over files) on mapping P5: ``lineitem`` rendered as the
text of order files, one file per ship year, with the order-file headers.

The text carries the dirty forms the cleaning must handle: ``n/a`` amounts (returned items), ``1,000``
counts (no discount), ``2.5d`` prices (no tax), ``2.9``-style counts (open items), infinite prices, slash dates
(finished items), month-first, named-month, half-day and zoned dates (by line number), unparsable dates (accepted
returns), missing-value texts in number and text columns, a text-polluted ``cloth_pack_cost`` in some
files only, null customer names, blank order ids (line 7), duplicate order ids per file (the other
lines of an order) and an unmapped column.

``m1_upsert_files_existing_p5`` writes the same rows as real CSV files, one per ship month, of which those from 1998 on lack three
headers, and upserts them into existing orders: a column that a row's file lacks comes from an older file of the order, else
from the existing order.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from swatch.functions.expr import MISSING_TOKENS, NUMBER_PATTERN
from swatch.operators import ingest as ing
from swatch.operators import merge as mg
from swatch.operators.quality import duplicate_key_count
from swatch.plans.common import Query, load
from swatch.plans.orders_model import AS_OF, AS_OF_SQL
from swatch.schemas import ORIGINAL_ORDERS
from swatch.session import ensure_checkpoint_dir
from swatch.sources.files import read_mixed_order_files
from swatch.sources.tables import empty_table

ORDINAL_COLUMNS = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")


def p5_text(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    c = F.col
    return li.select(
        F.year("l_shipdate").cast("string").alias("_file"),
        F.struct(*ORDINAL_COLUMNS).alias("_ordinal"),
        F.when(c("l_linenumber") == 7, F.lit(None)).otherwise(c("l_orderkey").cast("string")).alias("订单ID"),
        F.when(c("l_returnflag") == "R", F.lit("n/a")).otherwise(c("l_extendedprice").cast("string")).alias("金额"),
        c("l_quantity").cast("string").alias("衣服总数"),
        F.when(c("l_linestatus") == "O", F.concat(c("l_linenumber").cast("string"), F.lit(".9")))
        .otherwise(c("l_linenumber").cast("string")).alias("高清图数"),
        F.when(c("l_discount") == 0.0, F.lit("1,000")).otherwise(c("l_suppkey").cast("string")).alias("颜色总数"),
        F.when(c("l_tax") == 0.0, F.lit("2.5d")).when(c("l_quantity") == 2, F.lit("Infinity"))
        .otherwise(c("l_tax").cast("string")).alias("衣服售价总额"),
        F.when(c("l_linenumber") == 2, F.date_format("l_shipdate", "M/d/yyyy HH:mm"))
        .when(c("l_linenumber") == 3, F.date_format("l_shipdate", "MMM d, yyyy"))
        .when(c("l_linenumber") == 4, F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'+08:00'"))
        .when(c("l_linenumber") == 5, F.date_format("l_shipdate", "d MMMM yyyy hh:mm 'PM'"))
        .when(c("l_linestatus") == "F", F.date_format("l_shipdate", "yyyy/MM/dd HH:mm"))
        .when(c("l_returnflag") == "A", F.lit("not a date"))
        .otherwise(F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")).alias("下单时间"),
        F.when((c("l_quantity") >= 50) & (c("l_discount") == 0.1) & (F.year("l_shipdate") % 2 == 0), F.lit("cheap"))
        .when(c("l_quantity") == 3, F.lit("#N/A")).when(c("l_quantity") == 4, F.lit("NULL"))
        .otherwise(c("l_discount").cast("string")).alias("叠衣服成本"),
        F.when(c("l_returnflag") == "N", F.lit(None)).when(c("l_quantity") == 5, F.lit("None"))
        .otherwise(F.concat(F.lit("c"), c("l_suppkey").cast("string"))).alias("客户"),
        F.when(c("l_quantity") == 6, F.lit("<NA>")).otherwise(c("l_returnflag")).alias("渠道"),
        c("l_linestatus").alias("处理人"),
        F.concat(c("l_returnflag"), c("l_linestatus")).alias("订单分类"),
        F.lit(None).cast("string").alias("备注"),
        c("l_partkey").cast("string").alias("unmapped_column"),
    )


def _clean(spark, sf_dir):
    return ing.preprocess(p5_text(spark, sf_dir))


def _batch(spark, sf_dir):
    return ing.prepare_batch(_clean(spark, sf_dir), ORIGINAL_ORDERS, AS_OF)


def _upsert_files(counts: bool):
    def build(spark, sf_dir):
        good, _ = ing.prepare_batch(_clean(spark, sf_dir), ORIGINAL_ORDERS, AS_OF, align=False)
        res = mg.upsert(empty_table(spark, "original_orders"), good.drop("_ordinal"), AS_OF, order="_file")
        return res.stats if counts else res.table
    return build


# ------------------------------------------------------------------------------------------------
# Oracle SQL
# ------------------------------------------------------------------------------------------------

def _num(x: str) -> str:
    """The number in a text that is one; missing-value texts are none and are null before (``TEXT_SQL``'s readers)."""
    return f"(CASE WHEN regexp_matches({x}, '{NUMBER_PATTERN}') THEN TRY_CAST({x} AS DOUBLE) END)"


TEXT_SQL = """SELECT CAST(year(l_shipdate) AS VARCHAR) AS _file, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  l_shipdate,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_orderkey AS VARCHAR) END AS order_id,
  CASE WHEN l_returnflag = 'R' THEN 'n/a' ELSE CAST(l_extendedprice AS VARCHAR) END AS amount,
  CAST(l_quantity AS VARCHAR) AS quantity,
  CASE WHEN l_linestatus = 'O' THEN CAST(l_linenumber AS VARCHAR) || '.9' ELSE CAST(l_linenumber AS VARCHAR) END
    AS picture_amount,
  CASE WHEN l_discount = 0.0 THEN '1,000' ELSE CAST(l_suppkey AS VARCHAR) END AS color_amount,
  CASE WHEN l_tax = 0.0 THEN '2.5d' WHEN l_quantity = 2 THEN 'Infinity' ELSE CAST(l_tax AS VARCHAR) END AS cloth_price,
  CASE WHEN l_linenumber = 2 THEN strftime(l_shipdate, '%-m/%-d/%Y %H:%M')
       WHEN l_linenumber = 3 THEN strftime(l_shipdate, '%b %-d, %Y')
       WHEN l_linenumber = 4 THEN strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') || '+08:00'
       WHEN l_linenumber = 5 THEN strftime(l_shipdate, '%-d %B %Y %I:%M') || ' PM'
       WHEN l_linestatus = 'F' THEN strftime(l_shipdate, '%Y/%m/%d %H:%M')
       WHEN l_returnflag = 'A' THEN 'not a date' ELSE strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') END
    AS order_created_date,
  CASE WHEN l_quantity >= 50 AND l_discount = 0.1 AND year(l_shipdate) % 2 = 0 THEN 'cheap' WHEN l_quantity = 3 THEN '#N/A'
       WHEN l_quantity = 4 THEN 'NULL' ELSE CAST(l_discount AS VARCHAR) END AS cloth_pack_cost,
  CASE WHEN l_returnflag = 'N' THEN NULL WHEN l_quantity = 5 THEN 'None' ELSE 'c' || CAST(l_suppkey AS VARCHAR) END
    AS customer_name,
  CASE WHEN l_quantity = 6 THEN '<NA>' ELSE l_returnflag END AS shop, l_linestatus AS handler, l_returnflag || l_linestatus AS order_type,
  CAST(NULL AS VARCHAR) AS notes, CAST(l_partkey AS VARCHAR) AS unmapped_column
FROM lineitem"""


_MISSING_SQL = ", ".join("'" + t + "'" for t in MISSING_TOKENS)
_TEXT_COLUMNS = ("order_id", "amount", "quantity", "picture_amount", "color_amount", "cloth_price", "order_created_date",
                 "cloth_pack_cost", "customer_name", "shop", "handler", "order_type", "notes", "unmapped_column")
READ_SQL = (f"SELECT * REPLACE ({', '.join(f'CASE WHEN {c} NOT IN ({_MISSING_SQL}) THEN {c} END AS {c}' for c in _TEXT_COLUMNS)}) "
            f"FROM ({TEXT_SQL}) raw")
_DATE_SQL = """coalesce(
      CASE WHEN order_created_date LIKE '%+08:00' THEN TRY_CAST(order_created_date AS TIMESTAMPTZ) AT TIME ZONE 'UTC'
           ELSE TRY_CAST(order_created_date AS TIMESTAMP) END,
      TRY_STRPTIME(order_created_date, ['%Y/%m/%d %H:%M', '%m/%d/%Y %H:%M', '%b %d, %Y', '%d %B %Y %I:%M %p']))"""


def _clean_sql(file: str = "_file") -> str:
    return f"""
WITH t AS (SELECT * REPLACE ({file} AS _file) FROM ({READ_SQL}) r),
d AS (SELECT _file, bool_or(cloth_pack_cost IS NOT NULL AND {_num('cloth_pack_cost')} IS NULL) AS dirty
      FROM t GROUP BY _file),
c AS (
  SELECT t._file, coalesce(order_id, '') AS order_id,
    coalesce({_num('amount')}, 0.0) AS amount,
    coalesce(TRY_CAST(trunc({_num('quantity')}) AS INTEGER), 0) AS quantity,
    coalesce(TRY_CAST(trunc({_num('picture_amount')}) AS INTEGER), 0) AS picture_amount,
    coalesce(TRY_CAST(trunc({_num('color_amount')}) AS INTEGER), 0) AS color_amount,
    coalesce({_num('cloth_price')}, 0.0) AS cloth_price,
    {_DATE_SQL} AS order_created_date,
    CASE WHEN d.dirty THEN 0.0 ELSE {_num('cloth_pack_cost')} END AS cloth_pack_cost,
    coalesce(customer_name, '') AS customer_name, coalesce(shop, '') AS shop, coalesce(handler, '') AS handler,
    coalesce(order_type, '') AS order_type, coalesce(notes, '') AS notes, unmapped_column,
    row_number() OVER (PARTITION BY t._file, coalesce(order_id, '')
                       ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS rn
  FROM t JOIN d ON d._file = t._file)"""


CLEAN_COLUMNS = ("_file", "order_id", "amount", "quantity", "picture_amount", "color_amount", "cloth_price",
                 "order_created_date", "cloth_pack_cost", "customer_name", "shop", "handler", "order_type", "notes",
                 "unmapped_column")


def _batch_sql() -> str:
    cols = []
    for f in ORIGINAL_ORDERS.fields:
        if f.name == "id":
            continue
        if f.name in ("created_at", "updated_at"):
            cols.append(f"{AS_OF_SQL} AS {f.name}")
        elif f.name in CLEAN_COLUMNS:
            cols.append(f.name)
        elif f.name in ("cloth_pack_cost", "work_cost", "picture_cost", "color_cost", "cloth_cost", "picture_price",
                        "amount", "cloth_price"):
            cols.append(f"CAST(0.0 AS DOUBLE) AS {f.name}")
        elif f.name in ("picture_amount", "quantity", "color_amount"):
            cols.append(f"CAST(0 AS INTEGER) AS {f.name}")
        else:
            sql_type = {"StringType()": "VARCHAR", "TimestampNTZType()": "TIMESTAMP"}.get(str(f.dataType), "VARCHAR")
            cols.append(f"CAST(NULL AS {sql_type}) AS {f.name}")
    return f"{_clean_sql()} SELECT {', '.join(cols)}, _file FROM c WHERE rn = 1 AND order_id <> ''"


def _carried_sql(file: str = "_file") -> str:
    """The batch of an upsert: the columns that the files carry."""
    cols = [c for c in CLEAN_COLUMNS if c not in ("unmapped_column", "_file")]
    return f"{_clean_sql(file)} SELECT {', '.join(cols)}, _file FROM c WHERE rn = 1 AND order_id <> ''"


def _upsert_files_sql() -> str:
    cols = []
    for f in ORIGINAL_ORDERS.fields:
        if f.name in ("created_at", "updated_at"):
            cols.append(f"{AS_OF_SQL} AS {f.name}")
        elif f.name in CLEAN_COLUMNS:
            cols.append(f"l.{f.name}")
        elif f.name != "id":
            cols.append(f"NULL AS {f.name}")
    return f"""
WITH b AS ({_carried_sql()}),
last AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY _file DESC) = 1),
firsts AS (SELECT order_id, min(_file) AS first_file FROM b GROUP BY order_id)
SELECT row_number() OVER (ORDER BY f.first_file, l.order_id) AS id, {', '.join(cols)},
       'inserted' AS _action
FROM last l JOIN firsts f ON f.order_id = l.order_id"""


# ------------------------------------------------------------------------------------------------
# Files of two header groups into existing orders
# ------------------------------------------------------------------------------------------------

NARROW_FROM = "1998-01"
NARROW_LACKS = {"金额": "amount", "处理人": "handler", "叠衣服成本": "cloth_pack_cost"}
EXISTING_BEFORE = "1999-06-01"


def p5_files(spark, sf_dir) -> str:
    """The P5 text as CSV files, one per ship month, in two groups of headers; returns their folder."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/order-files-{uuid.uuid4().hex}"
    text = p5_text(spark, sf_dir).drop("_file").withColumn("month", F.date_format("_ordinal.l_shipdate", "yyyy-MM"))
    for group, rows in (("wide", text.where(F.col("month") < NARROW_FROM)),
                        ("narrow", text.where(F.col("month") >= NARROW_FROM).drop(*NARROW_LACKS))):
        (rows.repartition("month").sortWithinPartitions("month", "_ordinal").drop("_ordinal")
         .write.partitionBy("month").option("header", "true").csv(f"{base}/{group}"))
    return base


def _existing_orders(spark, sf_dir):
    """Orders that are in the table before the files are loaded."""
    o = load(spark, sf_dir, "orders").where(F.col("o_orderdate") < F.lit(EXISTING_BEFORE))
    some = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").cast("string").alias("order_id"),
                    F.col("o_orderstatus").alias("handler"), F.col("o_totalprice").alias("amount"),
                    F.lit(0.25).alias("cloth_pack_cost"), F.lit(7.5).alias("work_cost"),
                    F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("phone"), F.lit("kept").alias("notes"),
                    F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"))
    return empty_table(spark, "original_orders").unionByName(some, allowMissingColumns=True)


def _upsert_mixed(spark, sf_dir):
    raw, _ = read_mixed_order_files(spark, p5_files(spark, sf_dir), recursive=True)
    # The month in the path names a file, as the group's folder and the writer's part name do not order files.
    raw = raw.withColumn("_file", F.regexp_extract("_file", r"month=(\d{4}-\d{2})/", 1))
    good, _ = ing.prepare_batch(ing.preprocess(raw), ORIGINAL_ORDERS, AS_OF, align=False)
    return mg.upsert(_existing_orders(spark, sf_dir), good.drop("_ordinal"), AS_OF, order="_file",
                     present=ing.present_columns(good)).table


def _upsert_mixed_sql() -> str:
    lacks = set(NARROW_LACKS.values())
    known = {"handler": "o_orderstatus", "amount": "o_totalprice", "cloth_pack_cost": "CAST(0.25 AS DOUBLE)", "work_cost": "CAST(7.5 AS DOUBLE)",
             "phone": "'p' || CAST(o_custkey AS VARCHAR)", "notes": "'kept'"}
    cols = []
    for f in ORIGINAL_ORDERS.fields:
        if f.name in ("id", "order_id"):
            continue
        old = known.get(f.name, "NULL")
        if f.name == "updated_at":
            cols.append(f"CASE WHEN b.order_id IS NULL THEN o.o_orderdate ELSE {AS_OF_SQL} END AS updated_at")
        elif f.name == "created_at":
            cols.append(f"CASE WHEN o.o_orderkey IS NULL THEN {AS_OF_SQL} ELSE o.o_orderdate END AS created_at")
        elif f.name in lacks:
            cols.append(f"CASE WHEN b.wide THEN b.{f.name} WHEN o.o_orderkey IS NOT NULL THEN {old} END AS {f.name}")
        elif f.name in CLEAN_COLUMNS:
            cols.append(f"CASE WHEN b.order_id IS NOT NULL THEN b.{f.name} ELSE {old} END AS {f.name}")
        else:
            cols.append(f"CASE WHEN o.o_orderkey IS NOT NULL THEN {old} END AS {f.name}")
    last = ", ".join(f"arg_max_null({c}, _file){f' FILTER (WHERE _file < {chr(39)}{NARROW_FROM}{chr(39)})' if c in lacks else ''} AS {c}"
                     for c in CLEAN_COLUMNS if c not in ("_file", "order_id", "unmapped_column"))
    return f"""
WITH f AS ({_carried_sql("strftime(l_shipdate, '%Y-%m')")}),
b AS (SELECT order_id, {last}, min(_file) AS first_file, min(_file) < '{NARROW_FROM}' AS wide FROM f GROUP BY order_id),
o AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '{EXISTING_BEFORE}'),
n AS (SELECT order_id, (SELECT coalesce(max(o_orderkey), 0) FROM o) + row_number() OVER (ORDER BY first_file, order_id) AS id
      FROM b WHERE order_id NOT IN (SELECT CAST(o_orderkey AS VARCHAR) FROM o))
SELECT coalesce(o.o_orderkey, n.id) AS id, coalesce(b.order_id, CAST(o.o_orderkey AS VARCHAR)) AS order_id, {', '.join(cols)},
       CASE WHEN o.o_orderkey IS NULL THEN 'inserted' WHEN b.order_id IS NULL THEN 'unchanged' ELSE 'updated' END AS _action
FROM b FULL OUTER JOIN o ON b.order_id = CAST(o.o_orderkey AS VARCHAR) LEFT JOIN n ON n.order_id = b.order_id"""


def _scan_files(spark, sf_dir):
    """Rows and filled cells of every file, as read."""
    raw, present = read_mixed_order_files(spark, p5_files(spark, sf_dir), recursive=True)
    month = F.regexp_extract("_file", r"month=(\d{4}-\d{2})/", 1).alias("month")
    return raw.groupBy(month).agg(F.count(F.lit(1)).alias("n"), F.count("订单ID").alias("ids"), F.count("金额").alias("amounts"),
                                  F.bool_and(present["金额"]).alias("has_amount"))


def _nan_events(spark, sf_dir):
    """Events whose value is not a number for errors."""
    events = load(spark, sf_dir, "events")
    value = F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("value"))
    return ing.null_nans(events.select("event_id", value.alias("value")))


def queries() -> list[Query]:
    return [
        Query("i8_clean_orders_p5", lambda s, d: _clean(s, d).drop("_ordinal"),
              _clean_sql() + f" SELECT {', '.join(CLEAN_COLUMNS)} FROM c WHERE rn = 1"),
        Query("i10_load_batch_p5", lambda s, d: _batch(s, d)[0].drop("_ordinal"), _batch_sql()),
        Query("i11_rejects_p5", lambda s, d: _batch(s, d)[1].drop("_ordinal"),
              _clean_sql() + f" SELECT {', '.join(CLEAN_COLUMNS)} FROM c WHERE rn = 1 AND order_id = ''"),
        Query("a12_duplicate_keys_p5",
              lambda s, d: duplicate_key_count(ing.fill_strings(ing.null_missing(ing.map_headers(p5_text(s, d))), ["order_id"]),
                                               ["_file", "order_id"]),
              f"""WITH t AS ({TEXT_SQL}), k AS (SELECT _file, coalesce(order_id, '') AS k, count(*) AS n
              FROM t GROUP BY 1, 2)
              SELECT sum(n) AS rows, count(*) AS distinct_keys, sum(n - 1) AS duplicate_rows FROM k"""),
        Query("m1_upsert_files_p5", _upsert_files(False), _upsert_files_sql()),
        Query("i12_null_nans_p2", _nan_events,
              "SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS value FROM events"),
        Query("m1_upsert_files_existing_p5", _upsert_mixed, _upsert_mixed_sql()),
        Query("s4_scan_mixed_files_p5", _scan_files, f"""
              SELECT strftime(l_shipdate, '%Y-%m') AS month, count(*) AS n, count(order_id) AS ids,
                     CASE WHEN month < '{NARROW_FROM}' THEN count(amount) ELSE 0 END AS amounts,
                     month < '{NARROW_FROM}' AS has_amount FROM ({TEXT_SQL}) t GROUP BY 1"""),
        Query("m6_upsert_files_counts_p5", _upsert_files(True),
              f"WITH b AS ({_batch_sql()}) SELECT count(DISTINCT order_id) AS inserted, "
              f"count(*) - count(DISTINCT order_id) AS updated FROM b"),
    ]
