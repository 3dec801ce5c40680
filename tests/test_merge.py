import datetime as dt

from helpers import rows
from swatch.operators import merge as mg

D = dt.datetime
AS_OF = D(2026, 1, 1)
SRC = "id long, order_id string, amount double, order_type string, created_at timestamp_ntz, updated_at timestamp_ntz"
TGT = SRC + ", sample_status string"


def test_sync_route_branches_and_idempotence(spark):
    src = spark.createDataFrame([
        (1, "older", 10.0, "打样单", D(2025, 1, 1), D(2025, 1, 5)),   # source newer -> update
        (2, "equal", 20.0, "打样单", D(2025, 1, 1), D(2025, 1, 5)),   # same stamp -> unchanged
        (3, "newer", 30.0, "打样单", D(2025, 1, 1), D(2025, 1, 5)),   # target newer -> unchanged
        (4, "nullts", 40.0, "打样单", D(2025, 1, 1), D(2025, 1, 5)),  # target stamp null -> update
        (5, "fresh", 50.0, "纯衣看样", D(2025, 1, 2), D(2025, 1, 6)), # missing key -> insert
        (6, "moved", 60.0, "新订单", D(2025, 1, 1), D(2025, 1, 9)),   # type left the route -> untouched
        (7, "unknown", 70.0, "其他", D(2025, 1, 1), D(2025, 1, 9)),   # unknown type -> nowhere
        (8, "nulltype", 80.0, None, D(2025, 1, 1), D(2025, 1, 9)),
    ], SRC)
    tgt = spark.createDataFrame([
        (11, "older", 1.0, "打样单", D(2024, 1, 1), D(2025, 1, 4), "kept"),
        (12, "equal", 2.0, "打样单", D(2024, 1, 1), D(2025, 1, 5), "kept"),
        (13, "newer", 3.0, "打样单", D(2024, 1, 1), D(2025, 1, 6), "kept"),
        (14, "nullts", 4.0, "打样单", D(2024, 1, 1), None, "kept"),
        (16, "moved", 6.0, "打样单", D(2024, 1, 1), D(2025, 1, 1), "kept"),
    ], TGT)
    out = mg.sync_route(tgt, src, ("纯衣看样", "打样单"), AS_OF)
    got = {r.order_id: r for r in out.collect()}
    assert set(got) == {"older", "equal", "newer", "nullts", "moved", "fresh"}
    o = got["older"]
    assert (o.id, o.amount, o.created_at, o.updated_at, o.sample_status, o._action) == \
        (11, 10.0, D(2024, 1, 1), AS_OF, "kept", "updated")
    assert (got["equal"].amount, got["equal"]._action) == (2.0, "unchanged")
    assert (got["newer"].amount, got["newer"]._action) == (3.0, "unchanged")
    assert (got["nullts"].amount, got["nullts"].updated_at) == (40.0, AS_OF)
    f = got["fresh"]
    assert (f.id, f.created_at, f.updated_at, f.sample_status, f._action) == (17, D(2025, 1, 2), D(2025, 1, 6),
                                                                            None, "inserted")
    assert (got["moved"].amount, got["moved"]._action) == (6.0, "unchanged")
    counts = mg.merge_counts(out).first()
    assert (counts.inserted, counts.updated) == (1, 2)
    again = mg.sync_route(out.drop("_action"), src, ("纯衣看样", "打样单"), AS_OF)
    c2 = mg.merge_counts(again).first()
    assert (c2.inserted, c2.updated) == (0, 0)


def test_upsert_twice_equals_once(spark):
    tgt = spark.createDataFrame([(1, "a", 1.0, "打样单", D(2024, 1, 1), D(2024, 1, 1))], SRC)
    batch = spark.createDataFrame([("a", 5.0), ("b", 6.0)], "order_id string, amount double")
    r1 = mg.upsert(tgt, batch, AS_OF)
    t1 = r1.table.drop("_action")
    s1 = r1.stats.first()
    assert (s1.inserted, s1.updated) == (1, 1)
    got = {r.order_id: r for r in t1.collect()}
    # absent batch columns keep their values; created_at kept by default
    assert (got["a"].amount, got["a"].order_type, got["a"].created_at, got["a"].updated_at) == \
        (5.0, "打样单", D(2024, 1, 1), AS_OF)
    assert (got["b"].id, got["b"].created_at, got["b"].order_type) == (2, AS_OF, None)
    r2 = mg.upsert(t1, batch, AS_OF)
    assert rows(r2.table.drop("_action")) == rows(t1)
    s2 = r2.stats.first()
    assert (s2.inserted, s2.updated) == (0, 2)
    m2 = mg.upsert(tgt, batch, AS_OF, preserve_created=False).table
    assert {r.order_id: r.created_at for r in m2.collect()}["a"] == AS_OF


def test_upsert_later_file_wins_by_column_presence(spark):
    tgt = spark.createDataFrame([(1, "a", 1.0, "打样单", D(2024, 1, 1), D(2024, 1, 1))], SRC)
    # file 1 has amount and type; file 2 has only the type: amount must come from file 1
    batch = spark.createDataFrame([
        ("a", 5.0, "新订单", "f1", True), ("a", None, "续订单", "f2", False), ("c", 9.0, "x", "f1", True),
        ("c", 8.0, "y", "f2", True)],
        "order_id string, amount double, order_type string, _file string, _has_amount boolean")
    res = mg.upsert(tgt, batch, AS_OF, order="_file", present={"amount": "_has_amount"})
    got = {r.order_id: r for r in res.table.collect()}
    assert (got["a"].amount, got["a"].order_type) == (5.0, "续订单")
    assert (got["c"].amount, got["c"].order_type) == (8.0, "y")
    s = res.stats.first()
    assert (s.inserted, s.updated) == (1, 3)


def test_change_sets(spark):
    tgt = spark.createDataFrame([(1, "a", 1.0, "t", D(2024, 1, 1), D(2024, 1, 1)),
                                 (2, "b", 2.0, "t", D(2024, 1, 1), D(2024, 1, 1))], SRC)
    keys = spark.createDataFrame([("a",), ("zz",)], "order_id string")
    hit, miss = mg.lookup(tgt, keys)
    assert rows(hit, "order_id") == [("a",)] and rows(miss) == [("zz",)]
    table, rej = mg.insert_new(tgt, spark.createDataFrame([("a", 9.0), ("c", 3.0)], "order_id string, amount double"),
                               AS_OF)
    assert rows(rej, "order_id") == [("a",)]
    assert rows(table.where("_action = 'inserted'"), "id", "order_id", "created_at") == [(3, "c", AS_OF)]
    changes = spark.createDataFrame([("a", "a2", None), ("b", None, 7.0), ("nope", None, 1.0)],
                                    "lookup_key string, order_id string, amount double")
    patched, missing = mg.patch(tgt, changes, AS_OF)
    assert rows(patched, "order_id", "amount", "updated_at") == [("a2", 1.0, AS_OF), ("b", 7.0, AS_OF)]
    assert rows(missing, "lookup_key") == [("nope",)]
    kept, gone = mg.delete_keys(tgt, keys)
    assert rows(kept, "order_id") == [("b",)] and rows(gone) == [("zz",)]


def test_edit_customers_whitelist_and_null(spark):
    from swatch.schemas import SAMPLE_CUSTOMER_EDIT_FIELDS
    from swatch.sources.tables import empty_table
    cust = empty_table(spark, "sample_customers").unionByName(spark.createDataFrame(
        [(1, "n", "s", "h", D(2024, 1, 1))], "id long, customer_name string, shop string, handler string, "
                                              "updated_at timestamp_ntz"), allowMissingColumns=True)
    ch = spark.createDataFrame([(1, {"handler": None, "notes": "x", "phone": "1", "tags": '["a"]'}), (9, {"notes": "y"})],
                               "id long, changes map<string,string>")
    table, missing = mg.edit_customers(cust, ch, SAMPLE_CUSTOMER_EDIT_FIELDS)
    r = table.first()
    assert (r.handler, r.notes, r.shop, r.tags, r.updated_at) == (None, "x", "s", ["a"], D(2024, 1, 1))
    assert "phone" not in table.columns
    assert rows(missing, "id") == [(9,)]


def test_upsert_counters_cover_every_batch_row(spark):
    import random
    rnd = random.Random(3)
    tgt = spark.createDataFrame([(i, f"k{i}", float(i), "t", D(2024, 1, 1), D(2024, 1, 1)) for i in range(1, 30)], SRC)
    data = [(f"k{rnd.randint(1, 60)}", float(rnd.randint(1, 9)), f"f{rnd.randint(1, 4)}", i) for i in range(80)]
    batch = spark.createDataFrame(data, "order_id string, amount double, _file string, _n int").selectExpr(
        "order_id", "amount", "concat(_file, lpad(CAST(_n AS STRING), 3, '0')) AS _ord")
    res = mg.upsert(tgt, batch, AS_OF, order="_ord")
    s = res.stats.first()
    assert s.inserted + s.updated == 80
    new_keys = {k for k, *_ in data} - {f"k{i}" for i in range(1, 30)}
    assert s.inserted == len(new_keys)
    last = {}
    for k, amount, f, n in sorted(data, key=lambda r: r[2] + f"{r[3]:03d}"):
        last[k] = amount
    got = {r.order_id: r.amount for r in res.table.collect()}
    assert all(got[k] == v for k, v in last.items())


def test_keys_stay_unique_without_an_order(spark):
    import datetime as dt

    from swatch.operators import merge as m
    t = spark.createDataFrame([(1, "A", 5.0)], "id long, order_id string, amount double")
    stamp = dt.datetime(2026, 1, 1)
    b = spark.createDataFrame([("A", 1.0), ("A", 2.0), ("N", 3.0), ("N", 4.0)], "order_id string, amount double")
    got = sorted((r.order_id, r.amount) for r in m.upsert(t, b, stamp).table.collect())
    assert got == [("A", 2.0), ("N", 4.0)]
    table, rejects = m.insert_new(t, b, stamp)
    assert sorted((r.order_id, r.amount) for r in table.collect()) == [("A", 5.0), ("N", 3.0)]
    assert sorted((r.order_id, r.amount) for r in rejects.collect()) == [("A", 1.0), ("A", 2.0), ("N", 4.0)]
    ch = spark.createDataFrame([("A", 7.0), ("A", 8.0), ("Z", 9.0)], "lookup_key string, amount double")
    table, missing = m.patch(t, ch, stamp)
    assert [(r.order_id, r.amount) for r in table.collect()] == [("A", 7.0)]
    assert sorted((r.lookup_key, r.amount) for r in missing.collect()) == [("A", 8.0), ("Z", 9.0)]


def _patched(spark, keys, renames):
    t = spark.createDataFrame([(i, k, k, AS_OF) for i, k in enumerate(keys)], "id long, order_id string, v string, updated_at timestamp_ntz")
    ch = spark.createDataFrame([(a, b, f"{a}>{b}") for a, b in renames], "lookup_key string, order_id string, v string")
    table, left = mg.patch(t, ch, AS_OF)
    got = {r.order_id: r.v for r in table.collect()}
    assert len(got) == len(keys) == table.count()  # keys stay unique, no row is lost
    return got, sorted((r.lookup_key, r.order_id) for r in left.collect())


def test_renames_chains_rings_and_collisions(spark):
    # A chain that ends at a free key, a ring, a chain into a key that stays, two renames to one key, an unknown key.
    got, left = _patched(spark, "ABCPQXYZMN", [("A", "B"), ("B", "C"), ("C", "free"), ("P", "Q"), ("Q", "P"), ("X", "Y"), ("Y", "Z"),
                                               ("M", "new"), ("N", "new"), ("none", "K")])
    assert got == {"B": "A>B", "C": "B>C", "free": "C>free", "Q": "P>Q", "P": "Q>P", "X": "X", "Y": "Y", "Z": "Z", "new": "M>new", "N": "N"}
    assert left == [("N", "new"), ("X", "Y"), ("Y", "Z"), ("none", "K")]
    # A loser stays in the way of the chain behind it; a rename to the own key is none.
    got, left = _patched(spark, "ABCD", [("A", "E"), ("B", "E"), ("C", "B"), ("D", "D")])
    assert got == {"E": "A>E", "B": "B", "C": "C", "D": "D>D"} and left == [("B", "E"), ("C", "B")]


def test_long_chain_of_renames(spark):
    keys = [f"{i:03d}" for i in range(70)]
    got, left = _patched(spark, keys, [(f"{i:03d}", f"{i + 1:03d}") for i in range(70)])
    assert not left and set(got) == {f"{i:03d}" for i in range(1, 71)}
    got, left = _patched(spark, keys, [(f"{i:03d}", f"{i + 1:03d}") for i in range(69)])
    assert len(left) == 69 and set(got) == set(keys)


def test_one_per_key_returns_every_other_row(spark):
    df = spark.createDataFrame([("a", 2, None), ("a", 1, "x"), ("a", 1, "x"), ("a", None, "y"), ("b", 1, "z"), (None, 1, "n"), (None, 1, "n")],
                               "k string, n int, t string")
    first, again = mg._one_per_key(df, "k")
    assert rows(first) == rows(spark.createDataFrame([("a", None, "y"), ("b", 1, "z"), (None, 1, "n"), (None, 1, "n")], df.schema))
    assert rows(again) == rows(spark.createDataFrame([("a", 2, None), ("a", 1, "x"), ("a", 1, "x")], df.schema))


def test_null_keys_are_never_inserted_twice(spark):
    t = spark.createDataFrame([(1, None, 1.0), (2, "a", 1.0)], "id long, order_id string, amount double")
    res = mg.upsert(t, spark.createDataFrame([(None, 9.0), ("a", 5.0)], "order_id string, amount double"), AS_OF)
    assert rows(res.table, "order_id", "amount") == [("a", 5.0), (None, 1.0)]
