"""Customer derivation from routed orders.

The source resolves customers one triple at a time ("find or create").  Here the same outcome is
computed set-based, from aggregates per name and per (name, shop):

1. ``anchor(name)`` is the lowest-id existing customer of the name, else the customer created by the
   name's first triple.
2. A triple with a shop resolves to the lowest-id existing customer with that (name, shop), else to
   the one created at the pair's first appearance.
3. A triple with a blank shop resolves to ``anchor(name)``; a blank-shop customer is created only
   when the name has no existing customer and its first triple is blank.
4. A customer's handler is its existing handler when non-blank, else the first non-blank handler of
   the triples resolved to it.
5. ``new`` counts created customers, ``updated`` every other triple.

Everything is an aggregate over triples (distinct (name, shop, handler), so a name with a third of
all orders still has few rows) joined back on name or (name, shop) with one row per key.  Orders
only meet the customers in the link step, an equi-join on name whose small side has one row per
(name, customer); a name with more orders than one task should take is salted over several tasks
(``operators.skew``).

New ids follow creation order (first appearance), so "lowest id" keeps its meaning.
"""

from __future__ import annotations

import datetime as _dt
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swatch.functions import is_blank
from swatch.operators.ids import assign_ids, next_id
from swatch.operators.skew import HOT_KEY_ROWS, grid_join, grid_of
from swatch.session import materialize
from swatch.schemas import BULK_SIDE, SAMPLE_SIDE, CustomerSide


# Customers of one name that a task should meet with its share of the name's orders, or of the other side's customers.
CELL_CUSTOMERS = 2_000


def _ts(as_of) -> Column:
    if isinstance(as_of, str):
        as_of = _dt.datetime.fromisoformat(as_of)
    return F.lit(as_of).cast("timestamp_ntz")


def drop_missing(df: DataFrame, cols=("customer_name", "order_id")) -> DataFrame:
    """drop rows where any of ``cols`` is null (blank text is kept)."""
    return df.dropna(subset=list(cols))


def customer_triples(orders: DataFrame, ordinal: str = "id") -> DataFrame:
    """Distinct (customer_name, shop, handler) with ``first_seen`` = the ordinal of first appearance."""
    return (drop_missing(orders)
            .groupBy("customer_name", "shop", "handler")
            .agg(F.min(ordinal).alias("first_seen")))


@dataclass
class Resolution:
    customers: DataFrame   # existing (handler filled) + created customers, full table schema
    triple_map: DataFrame  # (customer_name, shop, handler, first_seen, customer_id)
    counters: DataFrame    # one row (new, updated)
    triples: DataFrame
    created: DataFrame


def _count_tags(frames: dict[str, DataFrame]) -> DataFrame:
    """Row counts of several frames as one row, from a single aggregate over a tagged union (no join)."""
    tagged = None
    for tag, df in frames.items():
        part = df.select(F.lit(tag).alias("_tag"))
        tagged = part if tagged is None else tagged.unionByName(part)
    return tagged.agg(*[F.count_if(F.col("_tag") == F.lit(tag)).alias(tag) for tag in frames])


def resolve_customers(existing: DataFrame, triples: DataFrame, as_of, side: CustomerSide = SAMPLE_SIDE,
                      first_id=None) -> Resolution:
    """Find-or-create customers for the triples (rules in the module doc).  ``first_id`` is the first new id, where
    ``existing`` is a part of the table.

    The triples (distinct (name, shop, handler), far fewer than orders) are written once to the
    checkpoint directory: every rule reads them, and without the cut each read would rescan the
    orders.
    """
    t = materialize(triples.withColumn("_blank", is_blank("shop")), "triples")
    ex = existing.select("id", "customer_name", "shop")
    ex_pair = (ex.where(~is_blank("shop")).groupBy("customer_name", "shop").agg(F.min("id").alias("_ex_pair")))
    ex_name = ex.groupBy("customer_name").agg(F.min("id").alias("_ex_name"))

    # Customers to create: one per (name, shop) pair with no existing match, at its first appearance...
    pair_first = (t.where(~F.col("_blank")).groupBy("customer_name", "shop")
                  .agg(F.min("first_seen").alias("_created_at_seen"),
                       F.min_by("handler", "first_seen").alias("handler")))
    new_pairs = pair_first.join(ex_pair, ["customer_name", "shop"], "left_anti")
    # ...and one blank-shop customer for a name with no existing customer whose first triple is blank.
    name_first = (t.groupBy("customer_name")
                  .agg(F.min_by(F.struct("shop", "handler", "_blank"), "first_seen").alias("_f"),
                       F.min("first_seen").alias("_created_at_seen")))
    new_blank = (name_first.where(F.col("_f._blank"))
                 .join(ex_name, "customer_name", "left_anti")
                 .select("customer_name", F.col("_f.shop").alias("shop"), F.col("_f.handler").alias("handler"),
                         "_created_at_seen"))
    created = new_pairs.select("customer_name", "shop", "handler", "_created_at_seen").unionByName(new_blank)
    created = assign_ids(created, ["_created_at_seen"], start=next_id(existing) if first_id is None else first_id)

    # Resolve every triple.
    new_pair_ids = created.where(~is_blank("shop")).select("customer_name", "shop", F.col("id").alias("_new_pair"))
    new_anchor = created.groupBy("customer_name").agg(F.min("id").alias("_new_anchor"))
    resolved = (t.join(ex_pair, ["customer_name", "shop"], "left")
                .join(new_pair_ids, ["customer_name", "shop"], "left")
                .join(ex_name, "customer_name", "left")
                .join(new_anchor, "customer_name", "left")
                .withColumn("customer_id", F.when(F.col("_blank"), F.coalesce("_ex_name", "_new_anchor"))
                            .otherwise(F.coalesce("_ex_pair", "_new_pair")))
                .select("customer_name", "shop", "handler", "first_seen", "customer_id"))
    resolved = materialize(resolved, "triple-map")

    # Handler fill: first non-blank handler among the triples resolved to each customer.
    first_handler = (resolved.where(~is_blank("handler")).groupBy("customer_id")
                     .agg(F.min_by("handler", "first_seen").alias("_first_handler")))
    now = _ts(as_of)
    old = (existing.join(first_handler, existing["id"] == first_handler["customer_id"], "left")
           .withColumn("handler", F.when(is_blank("handler") & F.col("_first_handler").isNotNull(),
                                         F.col("_first_handler")).otherwise(F.col("handler")))
           .select(*existing.columns))
    fresh_cols = []
    for f in side.customers_schema.fields:
        if f.name in ("id", "customer_name", "shop"):
            fresh_cols.append(F.col(f.name).cast(f.dataType))
        elif f.name == "handler":
            fresh_cols.append(F.coalesce("_first_handler", "handler").alias("handler"))
        elif f.name in (side.total_amount,):
            fresh_cols.append(F.lit(0.0).alias(f.name))
        elif f.name in (side.orders_count,):
            fresh_cols.append(F.lit(0).alias(f.name))
        elif f.name == side.converted_flag:
            fresh_cols.append(F.lit(False).alias(f.name))
        elif f.name in ("created_at", "updated_at"):
            fresh_cols.append(now.alias(f.name))
        else:
            fresh_cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    fresh = (created.join(first_handler, created["id"] == first_handler["customer_id"], "left")
             .select(*fresh_cols))
    # Customers are few next to orders; writing them once keeps every later plan (links,
    # conversions, statistics, both sides) from re-deriving them.
    customers = materialize(old.unionByName(fresh.select(*existing.columns)), "customers")
    counters = _count_tags({"triples": t, "new": created}).select(
        "new", (F.col("triples") - F.col("new")).alias("updated"))
    return Resolution(customers, resolved, counters, t, created)


def merge_stats(customers: DataFrame, new_links: DataFrame, linked: DataFrame, side: CustomerSide = SAMPLE_SIDE) -> DataFrame:
    """C6 by deltas: the stored statistics of customers that get new links are merged with those of the new links
    alone (counts and sums add up, first and last dates extend).

    ``linked`` holds the ids (link customer column) of customers that had links before: of the others the stored values are
    not statistics of links, so theirs are those of the new links.  Customers without new links keep their row."""
    cid = side.link_customer_col
    had = linked.select(F.col(cid).alias("_had")).distinct()
    st = new_links.groupBy(cid).agg(F.count(F.lit(1)).cast("int").alias("_n"), F.coalesce(F.sum("amount"), F.lit(0.0)).alias("_sum"),
                                    F.min("order_date").alias("_first"), F.max("order_date").alias("_last"))
    st = st.join(had, st[cid] == F.col("_had"), "left")
    j = customers.join(st, customers["id"] == st[cid], "left")
    has, before = F.col(cid).isNotNull(), F.col("_had").isNotNull()
    old = lambda name: F.when(before, F.col(name))
    return j.withColumns({
        side.orders_count: F.when(has, F.coalesce(old(side.orders_count), F.lit(0)) + F.col("_n")).otherwise(F.col(side.orders_count)),
        side.total_amount: F.when(has, F.coalesce(old(side.total_amount), F.lit(0.0)) + F.col("_sum"))
        .otherwise(F.col(side.total_amount)),
        side.first_date: F.when(has, F.least(old(side.first_date), F.col("_first"))).otherwise(F.col(side.first_date)),
        side.last_date: F.when(has, F.greatest(old(side.last_date), F.col("_last"))).otherwise(F.col(side.last_date)),
    }).select(*customers.columns)


def link_orders(orders: DataFrame, triple_map: DataFrame, existing_links: DataFrame, as_of,
                side: CustomerSide = SAMPLE_SIDE, ordinal: str = "id", hot_rows: int = HOT_KEY_ROWS,
                first_id=None, cell: int | None = None) -> DataFrame:
    """New (customer, order) links.  An order links to every customer resolved from a triple of
    its name, whatever the shop; ``order_date`` is the order's ``created_at``; an amount of 0 or NaN
    is stored as null; pairs already linked are skipped.  Returns the new link rows with ids after
    the existing ones, in (customer, order) order.
    """
    cust_col = side.link_customer_col
    per_name = triple_map.select("customer_name", F.col("customer_id").alias(cust_col)).distinct()
    o = drop_missing(orders).select("customer_name", "order_id", F.col(ordinal).alias("_ord"),
                                    F.col("created_at").alias("order_date"),
                                    F.nullif(F.nanvl(F.col("amount").cast("double"), F.lit(None).cast("double")),
                                             F.lit(0.0)).alias("amount"))
    # A name may have more orders than one task should take, and more customers too (the blank name, with many
    # shops): its orders x customers are dealt over a grid.
    grid = grid_of(o, per_name, "customer_name", hot_rows, CELL_CUSTOMERS if cell is None else cell)
    links = (grid_join(o, per_name, "customer_name", grid)
             .join(existing_links.select(cust_col, "order_id"), [cust_col, "order_id"], "left_anti"))
    links = assign_ids(links.select(cust_col, "order_id", "_ord", "order_date", "amount"), [cust_col, "_ord"],
                       start=next_id(existing_links) if first_id is None else first_id)
    return links.select("id", cust_col, "order_id", "order_date", "amount", _ts(as_of).alias("created_at"))


def detect_conversions(sample_customers: DataFrame, bulk_customers: DataFrame, existing: DataFrame,
                       as_of, cell: int | None = None) -> DataFrame:
    """C4: one conversion per (sample, bulk) customer pair of the same name not yet recorded.

    The pairs are the result; a name's are bounded by its shops on either side, as resolution makes at most one customer
    per (name, shop) and one blank-shop customer per name.  A name with many is dealt over a grid.
    """
    s = sample_customers.select(F.col("id").alias("sample_customer_id"), "customer_name")
    b = bulk_customers.select(F.col("id").alias("bulk_customer_id"), "customer_name")
    rows = CELL_CUSTOMERS if cell is None else cell
    pairs = (grid_join(s, b, "customer_name", grid_of(s, b, "customer_name", rows, rows))
             .join(existing.select("sample_customer_id", "bulk_customer_id"),
                   ["sample_customer_id", "bulk_customer_id"], "left_anti")
             .select("sample_customer_id", "bulk_customer_id"))
    pairs = assign_ids(pairs, ["sample_customer_id", "bulk_customer_id"], start=next_id(existing))
    now = _ts(as_of)
    return pairs.select("id", "sample_customer_id", "bulk_customer_id", now.alias("conversion_date"),
                        F.lit(None).cast("string").alias("sample_order_id"),
                        F.lit(None).cast("string").alias("bulk_order_id"),
                        F.lit(None).cast("int").alias("conversion_days"),
                        F.lit(None).cast("string").alias("conversion_notes"), now.alias("created_at"))


def apply_conversions(sample_customers: DataFrame, bulk_customers: DataFrame,
                      new_conversions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Flags on both sides for the new pairs; the last pair wins (highest partner id)."""
    s_last = new_conversions.groupBy("sample_customer_id").agg(
        F.max("bulk_customer_id").alias("_partner"), F.max("conversion_date").alias("_date"))
    b_last = new_conversions.groupBy("bulk_customer_id").agg(F.max("sample_customer_id").alias("_partner"))
    s = (sample_customers.join(s_last, sample_customers["id"] == s_last["sample_customer_id"], "left")
         .withColumns({"converted_to_bulk": F.when(F.col("_partner").isNotNull(), F.lit(True))
                       .otherwise(F.col("converted_to_bulk")),
                       "conversion_date": F.coalesce("_date", "conversion_date"),
                       "bulk_customer_id": F.coalesce("_partner", "bulk_customer_id")})
         .select(*sample_customers.columns))
    b = (bulk_customers.join(b_last, bulk_customers["id"] == b_last["bulk_customer_id"], "left")
         .withColumns({"converted_from_sample": F.when(F.col("_partner").isNotNull(), F.lit(True))
                       .otherwise(F.col("converted_from_sample")),
                       "sample_customer_id": F.coalesce("_partner", "sample_customer_id")})
         .select(*bulk_customers.columns))
    return s, b


def customer_stats(customers: DataFrame, links: DataFrame, side: CustomerSide = SAMPLE_SIDE) -> DataFrame:
    """Per customer with links: link count (null amount or date included), amount sum (0 when
    all null), first and last order date.  Customers without links keep their values (J9)."""
    cid = side.link_customer_col
    st = links.groupBy(cid).agg(F.count(F.lit(1)).cast("int").alias("_n"),
                                F.coalesce(F.sum("amount"), F.lit(0.0)).alias("_sum"),
                                F.min("order_date").alias("_first"), F.max("order_date").alias("_last"))
    j = customers.join(st, customers["id"] == st[cid], "left")
    has = F.col(cid).isNotNull()
    return j.withColumns({
        side.orders_count: F.when(has, F.col("_n")).otherwise(F.col(side.orders_count)),
        side.total_amount: F.when(has, F.col("_sum")).otherwise(F.col(side.total_amount)),
        side.first_date: F.when(has, F.col("_first")).otherwise(F.col(side.first_date)),
        side.last_date: F.when(has, F.col("_last")).otherwise(F.col(side.last_date)),
    }).select(*customers.columns)


@dataclass
class CustomerBuild:
    sample_customers: DataFrame
    bulk_customers: DataFrame
    sample_links: DataFrame       # all links (existing + new)
    bulk_links: DataFrame
    conversions: DataFrame        # all conversions (existing + new)
    counters: DataFrame           # C8, one row


def _routed(orders: DataFrame, ordinal: str) -> DataFrame:
    """The columns of routed orders that C1 and C3 read, written once: the triples, the rows per name and the links all
    read them, and the source behind them may be a join."""
    return materialize(drop_missing(orders).select(
        F.col(ordinal).alias(ordinal), "order_id", "customer_name", "shop", "handler", "amount", "created_at"), "routed-orders")


def _counters(parts: dict[str, DataFrame]) -> DataFrame:
    """One row."""
    return _count_tags(parts).select(
        "new_sample", (F.col("_triples_sample") - F.col("new_sample")).alias("updated_sample"),
        "new_bulk", (F.col("_triples_bulk") - F.col("new_bulk")).alias("updated_bulk"),
        "sample_relations", "bulk_relations", "conversions", F.lit(0).cast("long").alias("errors"))


def _both_sides(one, sample, bulk) -> dict[CustomerSide, tuple]:
    """``one(side, its argument)`` for both sides at once: they share no table until conversions, and the jobs of one fill
    the cores that the small jobs of the other leave idle."""
    run = inheritable_thread_target(sample.sparkSession)(one)
    with ThreadPoolExecutor(2) as pool:
        first, second = (pool.submit(run, side, arg)
                         for side, arg in ((SAMPLE_SIDE, sample), (BULK_SIDE, bulk)))
        return {SAMPLE_SIDE: first.result(), BULK_SIDE: second.result()}


def build_customers(sample_orders: DataFrame, bulk_orders: DataFrame, existing: dict[str, DataFrame], as_of,
                    ordinal: str = "id", hot_rows: int = HOT_KEY_ROWS) -> CustomerBuild:
    """C1-C3 for the sample side, C1-C3 for the bulk side, C4, C5, C6 for both sides.

    ``existing`` holds the current ``sample_customers``, ``bulk_customers``, ``sample_order_customers``,
    ``bulk_order_customers`` and ``customer_conversions`` tables (empty ones for a first build).
    Publish all five outputs together (``sources.snapshots.publish``).
    """
    out = {}
    parts = {}

    def one(side: CustomerSide, orders: DataFrame) -> tuple[Resolution, DataFrame, DataFrame]:
        ex_l = existing[f"{side.name}_order_customers"]
        orders = _routed(orders, ordinal)
        res = resolve_customers(existing[f"{side.name}_customers"], customer_triples(orders, ordinal), as_of, side)
        return res, ex_l, materialize(link_orders(orders, res.triple_map, ex_l, as_of, side, ordinal, hot_rows), "new-links")

    for side, (res, ex_l, new_links) in _both_sides(one, sample_orders, bulk_orders).items():
        out[side.name] = (res.customers, ex_l.unionByName(new_links))
        parts.update({f"_triples_{side.name}": res.triples, f"new_{side.name}": res.created,
                      f"{side.name}_relations": new_links})
    conv_new = detect_conversions(out["sample"][0], out["bulk"][0], existing["customer_conversions"], as_of)
    s_c, b_c = apply_conversions(out["sample"][0], out["bulk"][0], conv_new)
    s_c = customer_stats(s_c, out["sample"][1], SAMPLE_SIDE)
    b_c = customer_stats(b_c, out["bulk"][1], BULK_SIDE)
    parts["conversions"] = conv_new
    return CustomerBuild(s_c, b_c, out["sample"][1], out["bulk"][1],
                         existing["customer_conversions"].unionByName(conv_new), _counters(parts))


def update_customers(orders: dict[str, DataFrame], new_orders: dict[str, DataFrame], existing: dict[str, DataFrame], as_of,
                     ordinal: str = "id", hot_rows: int = HOT_KEY_ROWS) -> CustomerBuild:
    """C7 after a load: what ``build_customers`` over all ``orders`` gives, from the customers that the ``new_orders`` touch.

    ``orders`` and ``new_orders`` map a side to its orders: all of them (with the new ones), and those that were loaded since
    ``existing`` was built.  Whatever a new order changes has its name: only orders, customers and links of the names of
    new orders are read beyond their key columns and take part in C1 to C3 (an old order of such a name gets links to its
    new customers).  Statistics are merged from the new links alone, and conversions come from pairs with a
    customer that is new on either side.  All other rows pass unchanged.  The counters count what the touched names did."""
    out, parts, born = {}, {}, {}
    for side in (SAMPLE_SIDE, BULK_SIDE):
        ex_c, ex_l = existing[f"{side.name}_customers"], existing[f"{side.name}_order_customers"]
        cid = side.link_customer_col
        names = materialize(drop_missing(new_orders[side.name]).select("customer_name").distinct(), "touched-names")
        touched = _routed(orders[side.name].join(names, "customer_name", "left_semi"), ordinal)
        mine = ex_c.join(names, "customer_name", "left_semi").select(*ex_c.columns)
        rest = ex_c.join(names, "customer_name", "left_anti").select(*ex_c.columns)
        # New ids go on after those of the whole table, the touched part of which may lack the largest.
        res = resolve_customers(mine, customer_triples(touched, ordinal), as_of, side, first_id=next_id(ex_c))
        old_links = ex_l.join(mine.select(F.col("id").alias(cid)), cid, "left_semi").select(cid, "order_id")
        new_links = materialize(link_orders(touched, res.triple_map, old_links, as_of, side, ordinal, hot_rows,
                                            first_id=next_id(ex_l)), "new-links")
        now = merge_stats(res.customers, new_links, old_links, side)
        out[side.name] = (materialize(rest.unionByName(now.select(*rest.columns)), "customers-now"), ex_l.unionByName(new_links))
        born[side.name] = res.created.select("id", "customer_name")
        parts.update({f"_triples_{side.name}": res.triples, f"new_{side.name}": res.created,
                      f"{side.name}_relations": new_links})
    # A pair is new if one of its customers is, or if it was never recorded for customers that both were there.
    (s_c, s_l), (b_c, b_l) = out["sample"], out["bulk"]
    seen = born["sample"].unionByName(born["bulk"]).select("customer_name").distinct()
    conv_new = detect_conversions(s_c.join(seen, "customer_name", "left_semi"), b_c.join(seen, "customer_name", "left_semi"),
                                  existing["customer_conversions"], as_of)
    conv_new = materialize(conv_new, "new-conversions")
    s_c, b_c = apply_conversions(s_c, b_c, conv_new)
    parts["conversions"] = conv_new
    return CustomerBuild(s_c, b_c, s_l, b_l, existing["customer_conversions"].unionByName(conv_new), _counters(parts))
