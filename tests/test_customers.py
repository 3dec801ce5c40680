import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from helpers import rows
from swatch.operators import customers as cu
from swatch.schemas import BULK_SIDE, SAMPLE_SIDE
from swatch.sources.tables import empty_table

AS_OF = dt.datetime(2026, 1, 1)
ORDER_SCHEMA = "id long, order_id string, customer_name string, shop string, handler string, amount double, created_at timestamp_ntz"


def rule_model(existing, triples):
    """C2 by its rules, each as a definition over the whole list of triples: (customers, triple -> id, new, updated)."""
    old = sorted(existing, key=lambda c: -c["id"])  # in a dict of these the lowest id remains
    old_pair = {(c["name"], c["shop"]): c["id"] for c in old if c["shop"]}
    old_name = {c["name"]: c["id"] for c in old}
    first = {}  # pair or name -> the place of its first triple
    for at, (name, shop, _) in enumerate(triples):
        first.setdefault(name, at)
        if shop:
            first.setdefault((name, shop), at)
    births = [at for x, at in first.items() if isinstance(x, tuple) and x not in old_pair]
    births += [at for x, at in first.items() if not isinstance(x, tuple) and x not in old_name and not triples[at][1]]
    top = max([c["id"] for c in existing], default=0)
    born = {at: top + n for n, at in enumerate(sorted(births), 1)}
    new_pair = {triples[at][:2]: i for at, i in born.items() if triples[at][1]}
    new_name = {triples[at][0]: i for at, i in sorted(born.items(), reverse=True)}

    def owner(name, shop):
        if shop:
            return old_pair.get((name, shop)) or new_pair[name, shop]
        return old_name.get(name) or new_name[name]

    mapping = {t: owner(*t[:2]) for t in triples}
    filled = {}
    for t in reversed(triples):
        filled.update({mapping[t]: t[2]} if t[2] else {})
    customers = [{**c, "handler": c["handler"] or filled.get(c["id"], c["handler"])} for c in existing]
    customers += [{"id": i, "name": triples[at][0], "shop": triples[at][1], "handler": filled.get(i, triples[at][2])}
                  for at, i in born.items()]
    return customers, mapping, len(born), len(triples) - len(born)


def _existing_df(spark, existing):
    base = empty_table(spark, "sample_customers")
    if not existing:
        return base
    df = spark.createDataFrame([(c["id"], c["name"], c["shop"], c["handler"]) for c in existing],
                               "id long, customer_name string, shop string, handler string")
    return base.unionByName(df, allowMissingColumns=True)


def _check_case(spark, existing, orders):
    """orders: list of (name, shop, handler) in load order."""
    seen, triples = set(), []
    for t in orders:
        if t not in seen:
            seen.add(t)
            triples.append(t)
    want_c, want_map, want_new, want_upd = rule_model(existing, triples)
    odf = spark.createDataFrame([(i + 1, f"o{i + 1}", n, s, h, 1.0, AS_OF) for i, (n, s, h) in enumerate(orders)],
                                ORDER_SCHEMA)
    res = cu.resolve_customers(_existing_df(spark, existing), cu.customer_triples(odf), AS_OF)
    got_c = sorted((r.id, r.customer_name, r.shop, r.handler) for r in res.customers.collect())
    assert got_c == sorted((c["id"], c["name"], c["shop"], c["handler"]) for c in want_c)
    got_map = {(r.customer_name, r.shop, r.handler): r.customer_id for r in res.triple_map.collect()}
    assert got_map == want_map
    cnt = res.counters.first()
    assert (cnt.new, cnt.updated) == (want_new, want_upd)


def test_c2_fixture(spark):
    existing = [{"id": 1, "name": "x", "shop": "s1", "handler": ""},
                {"id": 2, "name": "x", "shop": None, "handler": "hx"}]
    orders = [
        ("a", None, None), ("a", "s1", "h1"), ("a", "", "h2"),        # blank shop first
        ("b", "s1", None), ("b", "s2", "h3"), ("b", None, "h4"),      # blank shop last, two shops
        ("c", "s1", ""), ("c", "s1", "h5"),                            # blank handler then handler
        ("x", "s1", "hx1"), ("x", None, "h6"), ("x", "s9", None),      # existing with / without shop
        ("", None, None), ("", "s1", None),                            # name ""
    ]
    _check_case(spark, existing, orders)


def test_c2_random_against_the_rules(spark):
    rnd = random.Random(7)
    names, shops, handlers = ["a", "b", ""], [None, "", "s1", "s2"], [None, "", "h1", "h2"]
    for _ in range(6):
        existing, nid = [], 1
        for _ in range(rnd.randint(0, 4)):
            existing.append({"id": nid, "name": rnd.choice(names), "shop": rnd.choice(shops),
                             "handler": rnd.choice(handlers)})
            nid += 1
        orders = [(rnd.choice(names), rnd.choice(shops), rnd.choice(handlers)) for _ in range(rnd.randint(1, 14))]
        _check_case(spark, existing, orders)


def test_links_conversions_stats(spark, tmp_path):
    o = spark.createDataFrame([
        (1, "o1", "ann", "s1", "h", 0.0, dt.datetime(2025, 1, 1)),     # amount 0 -> null
        (2, "o2", "ann", "s2", "h", None, None),                        # null amount, null date
        (3, "o3", "ann", "s1", "h", 5.0, dt.datetime(2025, 1, 3)),
        (4, "o4", "bob", None, None, 2.0, dt.datetime(2025, 1, 4)),
        (5, "o5", None, "s1", "h", 9.0, dt.datetime(2025, 1, 5)),       # null name: dropped
    ], ORDER_SCHEMA)
    bulk = spark.createDataFrame([
        (10, "b1", "ann", "s1", "h", 100.0, dt.datetime(2025, 2, 1)),
        (11, "b2", "ann", "s3", "h", 50.0, dt.datetime(2025, 2, 2)),
        (12, "b3", "zed", None, None, 1.0, dt.datetime(2025, 2, 3)),
    ], ORDER_SCHEMA)
    names = ("sample_customers", "bulk_customers", "sample_order_customers", "bulk_order_customers",
             "customer_conversions")
    existing = {n: empty_table(spark, n) for n in names}
    b = cu.build_customers(o, bulk, existing, AS_OF)
    sc = {r.id: r for r in b.sample_customers.collect()}
    assert [(r.customer_name, r.shop) for r in sorted(sc.values(), key=lambda r: r.id)] == \
        [("ann", "s1"), ("ann", "s2"), ("bob", None)]
    # every ann order links to both ann customers (name-only link); amount 0 stored as null
    links = rows(b.sample_links, "sample_customer_id", "order_id", "amount")
    assert links == [(1, "o1", None), (1, "o2", None), (1, "o3", 5.0), (2, "o1", None), (2, "o2", None),
                     (2, "o3", 5.0), (3, "o4", 2.0)]
    ann1 = sc[1]
    assert (ann1.sample_orders_count, ann1.total_sample_amount) == (3, 5.0)
    assert (ann1.first_sample_date, ann1.last_sample_date) == (dt.datetime(2025, 1, 1), dt.datetime(2025, 1, 3))
    # conversions: 2 sample x 2 bulk customers named ann; last pair wins (highest partner id)
    conv = rows(b.conversions, "sample_customer_id", "bulk_customer_id")
    assert conv == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert (sc[1].converted_to_bulk, sc[1].bulk_customer_id, sc[1].conversion_date) == (True, 2, AS_OF)
    assert sc[3].converted_to_bulk is False
    bc = {r.id: r for r in b.bulk_customers.collect()}
    assert (bc[1].converted_from_sample, bc[1].sample_customer_id) == (True, 2)
    assert bc[3].converted_from_sample is False
    c = b.counters.first()
    assert (c.new_sample, c.updated_sample, c.new_bulk, c.updated_bulk) == (3, 0, 3, 0)
    assert (c.sample_relations, c.bulk_relations, c.conversions, c.errors) == (7, 5, 4, 0)

    # Publish, read back, and build again over the same orders: nothing is added, no flag changes.
    from swatch.sources import snapshots as snap
    base = str(tmp_path / "customers")
    snap.publish(spark, base, "1", {"sample_customers": b.sample_customers, "bulk_customers": b.bulk_customers,
                                    "sample_order_customers": b.sample_links, "bulk_order_customers": b.bulk_links,
                                    "customer_conversions": b.conversions})
    again = cu.build_customers(o, bulk, {n: snap.read_current(spark, base, n) for n in names}, AS_OF)
    c2 = again.counters.first()
    assert (c2.new_sample, c2.new_bulk, c2.sample_relations, c2.bulk_relations, c2.conversions) == (0, 0, 0, 0, 0)
    assert rows(again.sample_customers) == rows(b.sample_customers)


def test_customer_without_links_keeps_values(spark):
    cust = empty_table(spark, "sample_customers").unionByName(
        spark.createDataFrame([(1, "q", 7, 70.0)], "id long, customer_name string, sample_orders_count int, "
                                                   "total_sample_amount double"), allowMissingColumns=True)
    links = empty_table(spark, "sample_order_customers")
    out = cu.customer_stats(cust, links, SAMPLE_SIDE).first()
    assert (out.sample_orders_count, out.total_sample_amount) == (7, 70.0)
    assert BULK_SIDE.orders_count == "bulk_orders_count"


def test_hot_name_links_unchanged_when_salted(spark):
    from swatch.operators.customers import link_orders
    orders = spark.range(3000).selectExpr(
        "id", "CAST(id AS STRING) AS order_id",
        "CASE WHEN id % 3 = 0 THEN '' ELSE CAST(id % 11 AS STRING) END AS customer_name",
        "CAST(NULL AS STRING) AS shop", "CAST(NULL AS STRING) AS handler", "CAST(id % 5 AS DOUBLE) AS amount",
        "TIMESTAMP_NTZ '2025-01-01 00:00:00' AS created_at")
    res = cu.resolve_customers(empty_table(spark, "sample_customers"), cu.customer_triples(orders), AS_OF)
    links = empty_table(spark, "sample_order_customers")
    plain = link_orders(orders, res.triple_map, links, AS_OF)
    split = link_orders(orders, res.triple_map, links, AS_OF, hot_rows=50)
    assert rows(plain) == rows(split) and plain.count() == 3000


def test_c2_same_result_with_one_shuffle_partition(spark):
    existing = [{"id": 1, "name": "x", "shop": "s1", "handler": ""}]
    orders = [("a", None, None), ("a", "s1", "h1"), ("x", None, "h"), ("x", "s2", None), ("", "", "h2")]
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        _check_case(spark, existing, orders)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


TABLES = ("sample_customers", "bulk_customers", "sample_order_customers", "bulk_order_customers", "customer_conversions")


def _state(spark, build):
    """The tables of a build, read back from a copy."""
    from swatch.session import materialize
    frames = (build.sample_customers, build.bulk_customers, build.sample_links, build.bulk_links, build.conversions)
    return {n: materialize(df, "state") for n, df in zip(TABLES, frames)}


def _random_orders(spark, rng, start, n):
    data = [(start + i, f"o{start + i}", rng.choice(["a", "b", "c", "d", "", None]), rng.choice(["s1", "s2", "", None]),
             rng.choice(["h1", "", None]), rng.choice([0.0, None, float(rng.randrange(9))]),
             rng.choice([None, dt.datetime(2025, 1, 1 + rng.randrange(28))])) for i in range(n)]
    return spark.createDataFrame(data, ORDER_SCHEMA)


@pytest.mark.parametrize("seed", [1])
def test_second_load_equals_a_full_rebuild(spark, seed):
    """Old customers get new shops, old orders get links to them, untouched names (one with edited statistics) stay."""
    rng = random.Random(seed)
    first = {s: _random_orders(spark, rng, at, 6).where("customer_name IS NULL OR customer_name <> 'd'")
             for s, at in (("sample", 1), ("bulk", 100))}
    later = {s: _random_orders(spark, rng, at, 5) for s, at in (("sample", 50), ("bulk", 150))}
    state = _state(spark, cu.build_customers(first["sample"], first["bulk"], {n: empty_table(spark, n) for n in TABLES}, AS_OF))
    # A customer without links whose stored values are not statistics of links.
    state["sample_customers"] = state["sample_customers"].unionByName(spark.createDataFrame(
        [(90, "d", "s1", 7, 70.0)], "id long, customer_name string, shop string, sample_orders_count int, "
        "total_sample_amount double"), allowMissingColumns=True)
    every = {s: first[s].unionByName(later[s]) for s in first}
    then = AS_OF + dt.timedelta(days=1)
    want = _state(spark, cu.build_customers(every["sample"], every["bulk"], state, then))
    got = _state(spark, cu.update_customers(every, later, state, then))
    for name in TABLES:
        assert rows(got[name]) == rows(want[name]), name


def test_second_load_of_nothing_changes_nothing(spark):
    first = _random_orders(spark, random.Random(5), 1, 6)
    state = _state(spark, cu.build_customers(first, first.limit(0), {n: empty_table(spark, n) for n in TABLES}, AS_OF))
    both = {"sample": first, "bulk": first.limit(0)}
    got = cu.update_customers(both, {s: df.limit(0) for s, df in both.items()}, state, AS_OF)
    assert [rows(x) for x in (got.sample_customers, got.sample_links)] == \
        [rows(state[n]) for n in ("sample_customers", "sample_order_customers")]
    assert sum(got.counters.first()) == 0
