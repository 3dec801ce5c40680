"""Table schemas, domain constants and the column mapping used by the analysis operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# ---------------------------------------------------------------------------------------------
# Fixed values.  These must equal the values of the system we reproduce, so they are stated
# plainly, in their natural order.
# ---------------------------------------------------------------------------------------------

# Order types routed to the sample table and to the bulk table.
SAMPLE_ORDER_TYPES = ("纯衣看样", "打样单")
BULK_ORDER_TYPES = ("新订单", "续订单", "纯衣单", "改版续订")

# Substring that marks a sample order type in the conversion analysis.
SAMPLE_MARKER = "样"

# Conversion status labels: converted, not converted.
STATUS_CONVERTED = "已转化"
STATUS_NOT_CONVERTED = "未转化"

# Order-file headers and the column each maps to.
HEADER_MAP = {
    "订单ID": "order_id",
    "角色": "role",
    "处理人": "handler",
    "工艺": "process",
    "金额": "amount",
    "高清图数": "picture_amount",
    "印制报价": "picture_price",
    "高清图尺寸成本": "picture_cost",
    "高清图颜色成本": "color_cost",
    "高清图工费成本": "work_cost",
    "衣服售价总额": "cloth_price",
    "衣服总数": "quantity",
    "衣服成本": "cloth_cost",
    "叠衣服成本": "cloth_pack_cost",
    "衣服款式": "cloth_code",
    "颜色总数": "color_amount",
    "客户": "customer_name",
    "电话": "phone",
    "渠道": "shop",
    "快递": "express",
    "订单状态": "order_status",
    "下单时间": "order_created_date",
    "处理时间": "order_processed_date",
    "完成时间": "completion_date",
    "订单分类": "order_type",
    "备注": "notes",
}

# Cleaning groups of the order-file ingest.
DATE_COLUMNS = ("order_created_date", "order_processed_date", "completion_date")
INT_COLUMNS = ("color_amount", "picture_amount", "quantity")
FLOAT_COLUMNS = ("amount", "picture_price", "picture_cost", "color_cost", "work_cost", "cloth_price",
                 "cloth_cost")
WHOLE_COLUMN_RULE_COLUMN = "cloth_pack_cost"
STRING_COLUMNS = ("order_id", "role", "handler", "process", "cloth_code", "customer_name", "phone", "shop",
                  "express", "order_status", "order_type", "notes")

# Defaults for target columns missing from a batch: money 0.0, counts 0, others null.
MONEY_DEFAULT_COLUMNS = ("cloth_pack_cost", "work_cost", "picture_cost", "color_cost", "cloth_cost",
                         "picture_price", "amount", "cloth_price")
COUNT_DEFAULT_COLUMNS = ("picture_amount", "quantity", "color_amount")

# Histogram edges (open left, closed right) and labels.
DAYS_BIN_EDGES = (0, 7, 14, 30, 60, 90, float("inf"))
DAYS_BIN_LABELS = ("0-7天", "8-14天", "15-30天", "31-60天", "61-90天", "90天以上")
AMOUNT_BIN_EDGES = (0, 1000, 5000, 10000, 50000, float("inf"))
AMOUNT_BIN_LABELS = ("<1000", "1000-5000", "5000-10000", "10000-50000", ">50000")

# Fields a customer edit may set (sample side, bulk side).
SAMPLE_CUSTOMER_EDIT_FIELDS = ("customer_name", "shop", "handler", "region", "notes", "wechat",
                               "next_contact_date", "lost_reason", "tags")
BULK_CUSTOMER_EDIT_FIELDS = ("customer_name", "shop", "handler", "region", "notes", "tags")

# Name fragments of the column finder.
DATE_NAME_HINTS = ("date", "time")
AMOUNT_NAME_HINTS = ("amount", "price", "value")

# ---------------------------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------------------------

_S, _D, _I, _L, _TS, _B = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.TimestampNTZType(), T.BooleanType()


def _struct(fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# The 25 business columns every order table carries (all but id, order_id, created_at, updated_at).
ORDER_VALUE_FIELDS = [
    ("role", _S), ("handler", _S), ("process", _S), ("amount", _D), ("picture_amount", _I),
    ("picture_price", _D), ("picture_cost", _D), ("color_cost", _D), ("work_cost", _D),
    ("cloth_price", _D), ("quantity", _I), ("cloth_cost", _D), ("cloth_pack_cost", _D),
    ("cloth_code", _S), ("color_amount", _I), ("customer_name", _S), ("phone", _S), ("shop", _S),
    ("express", _S), ("order_status", _S), ("order_created_date", _TS), ("order_processed_date", _TS),
    ("completion_date", _TS), ("order_type", _S), ("notes", _S),
]
ORDER_VALUE_COLUMNS = tuple(n for n, _ in ORDER_VALUE_FIELDS)

ORIGINAL_ORDERS = _struct([("id", _L), ("order_id", _S)] + ORDER_VALUE_FIELDS
                          + [("created_at", _TS), ("updated_at", _TS)])
SAMPLE_ORDERS = _struct([(f.name, f.dataType) for f in ORIGINAL_ORDERS.fields]
                        + [("sample_status", _S), ("feedback", _S), ("follow_up_date", _TS),
                           ("conversion_potential", _I)])
BULK_ORDERS = _struct([(f.name, f.dataType) for f in ORIGINAL_ORDERS.fields]
                      + [("production_status", _S), ("delivery_date", _TS), ("payment_status", _S),
                         ("shipping_details", _S)])

SAMPLE_CUSTOMERS = _struct([
    ("id", _L), ("customer_name", _S), ("shop", _S), ("region", _S), ("handler", _S),
    ("first_sample_date", _TS), ("last_sample_date", _TS), ("total_sample_amount", _D),
    ("sample_orders_count", _I), ("converted_to_bulk", _B), ("conversion_date", _TS),
    ("bulk_customer_id", _L), ("notes", _S), ("tags", T.ArrayType(_S)), ("wechat", _S),
    ("next_contact_date", _TS), ("next_contact_week", _TS), ("next_contact_month", _TS),
    ("lost_reason", _S), ("created_at", _TS), ("updated_at", _TS),
])
BULK_CUSTOMERS = _struct([
    ("id", _L), ("customer_name", _S), ("phone", _S), ("email", _S), ("shop", _S),
    ("customer_type", _S), ("region", _S), ("handler", _S), ("first_bulk_date", _TS),
    ("last_bulk_date", _TS), ("total_bulk_amount", _D), ("bulk_orders_count", _I),
    ("converted_from_sample", _B), ("sample_customer_id", _L), ("notes", _S),
    ("tags", T.ArrayType(_S)), ("created_at", _TS), ("updated_at", _TS),
])
SAMPLE_ORDER_CUSTOMERS = _struct([("id", _L), ("sample_customer_id", _L), ("order_id", _S),
                                  ("order_date", _TS), ("amount", _D), ("created_at", _TS)])
BULK_ORDER_CUSTOMERS = _struct([("id", _L), ("bulk_customer_id", _L), ("order_id", _S),
                                ("order_date", _TS), ("amount", _D), ("created_at", _TS)])
CUSTOMER_CONVERSIONS = _struct([
    ("id", _L), ("sample_customer_id", _L), ("bulk_customer_id", _L), ("conversion_date", _TS),
    ("sample_order_id", _S), ("bulk_order_id", _S), ("conversion_days", _I),
    ("conversion_notes", _S), ("created_at", _TS),
])

TABLE_SCHEMAS = {
    "original_orders": ORIGINAL_ORDERS,
    "sample_orders": SAMPLE_ORDERS,
    "bulk_orders": BULK_ORDERS,
    "sample_customers": SAMPLE_CUSTOMERS,
    "bulk_customers": BULK_CUSTOMERS,
    "sample_order_customers": SAMPLE_ORDER_CUSTOMERS,
    "bulk_order_customers": BULK_ORDER_CUSTOMERS,
    "customer_conversions": CUSTOMER_CONVERSIONS,
}


@dataclass(frozen=True)
class OrderCols:
    """Column names of an order table as seen by the conversion analysis.

    ``amount`` may be None (no amount column: amounts stay 0 and the amount histogram is empty).
    """

    order_id: str = "order_id"
    customer_id: str = "customer_id"
    order_type: str = "order_type"
    date: str = "process_time"
    amount: str | None = "amount"


@dataclass(frozen=True)
class CustomerSide:
    """Names that differ between the sample side and the bulk side of the customer tables."""

    name: str                # "sample" | "bulk"
    customers_schema: T.StructType
    links_schema: T.StructType
    link_customer_col: str   # sample_customer_id | bulk_customer_id
    first_date: str
    last_date: str
    total_amount: str
    orders_count: str
    converted_flag: str      # converted_to_bulk | converted_from_sample
    partner_col: str         # bulk_customer_id | sample_customer_id
    edit_fields: tuple


SAMPLE_SIDE = CustomerSide("sample", SAMPLE_CUSTOMERS, SAMPLE_ORDER_CUSTOMERS, "sample_customer_id",
                           "first_sample_date", "last_sample_date", "total_sample_amount",
                           "sample_orders_count", "converted_to_bulk", "bulk_customer_id",
                           SAMPLE_CUSTOMER_EDIT_FIELDS)
BULK_SIDE = CustomerSide("bulk", BULK_CUSTOMERS, BULK_ORDER_CUSTOMERS, "bulk_customer_id",
                         "first_bulk_date", "last_bulk_date", "total_bulk_amount", "bulk_orders_count",
                         "converted_from_sample", "sample_customer_id", BULK_CUSTOMER_EDIT_FIELDS)
