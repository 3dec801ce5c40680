import datetime as dt

from helpers import rows
from swatch.operators import ingest as ing
from swatch.operators.quality import duplicate_key_count, find_columns
from swatch.schemas import ORIGINAL_ORDERS
from swatch.sources.files import read_order_files

HEAD = "订单ID,金额,衣服总数,高清图数,叠衣服成本,下单时间,客户,渠道,备注,未知列\n"


def _write(path, text):
    path.write_text(text, encoding="utf-8")


def test_files_and_cleaning(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    _write(d / "a.csv", HEAD + "A1,\"1,000\",2.9,n/a,0.5,2025/02/04 10:06,c1,s,,u\n"
                               "A1,5,3,1,0.7,2025-02-05 10:00:00,c1,s,,u\n"
                               ",7,1,1,0.1,bad,c2,,,u\n"
                               "A2,1.0d,1e1,-3.7,,2025-02-06,,s,,u\n")
    _write(d / "b.csv", HEAD + "B1,12.5,4,2,cheap,2025-03-01 08:00:00,c3,s,,u\n")
    _write(d / "~$a.csv", HEAD + "X,1,1,1,1,2025-01-01,c,s,,u\n")
    _write(d / "c.txt", HEAD + "Y,1,1,1,1,2025-01-01,c,s,,u\n")
    raw = read_order_files(spark, str(d), (".csv",))
    assert {r._file.rpartition("/in/")[2] for r in raw.collect()} == {"a.csv", "b.csv"}
    dup = duplicate_key_count(ing.fill_strings(ing.map_headers(raw), ["order_id"]), ["_file", "order_id"]).first()
    assert (dup.rows, dup.distinct_keys, dup.duplicate_rows) == (5, 4, 1)
    clean = ing.preprocess(raw)
    got = {(r._file.rpartition("/in/")[2], r.order_id): r for r in clean.collect()}
    a1 = got[("a.csv", "A1")]                       # first row of the file wins
    assert (a1.amount, a1.quantity, a1.picture_amount) == (0.0, 2, 0)
    assert a1.order_created_date == dt.datetime(2025, 2, 4, 10, 6)
    assert a1.cloth_pack_cost == 0.5                 # file a has only numbers (and a null)
    a2 = got[("a.csv", "A2")]
    assert (a2.amount, a2.quantity, a2.picture_amount, a2.cloth_pack_cost) == (0.0, 10, -3, None)
    assert (a2.customer_name, a2.notes) == ("", "")
    assert got[("a.csv", "")].order_created_date is None
    assert got[("b.csv", "B1")].cloth_pack_cost == 0.0   # text in file b zeroes its whole column
    good, rejects = ing.prepare_batch(clean, ORIGINAL_ORDERS, dt.datetime(2026, 1, 1))
    assert [(f.rpartition("/in/")[2], k) for f, k in rows(rejects, "_file", "order_id")] == [("a.csv", "")]
    assert "未知列" not in good.columns and "role" in good.columns
    g = {r.order_id: r for r in good.collect()}
    assert (g["A1"].picture_price, g["A1"].color_amount, g["A1"].role) == (0.0, 0, None)
    assert g["A1"].created_at == dt.datetime(2026, 1, 1)


def test_missing_key_column_fails(spark):
    import pytest
    from pyspark.sql import functions as F
    from swatch.operators.quality import MissingColumnsError
    df = spark.createDataFrame([("x",)], "`金额` string").withColumns({"_file": F.lit("f"), "_ordinal": F.lit(1)})
    with pytest.raises(MissingColumnsError):
        ing.preprocess(df)


def test_find_columns(spark):
    df = spark.createDataFrame([], "order_id string, customer_id string, order_type string, process_type string, "
                                   "amount double, process_time timestamp_ntz, completion_time timestamp_ntz")
    c = find_columns(df)
    assert (c.date, c.amount) == ("process_time", "amount")
    c2 = find_columns(df.drop("amount"))
    assert c2.amount is None


def test_json_order_files(spark, tmp_path):
    d = tmp_path / "json"
    d.mkdir()
    (d / "a.json").write_text('{"订单ID": "J1", "金额": 12.5, "下单时间": "2025/03/01 08:00"}\n'
                              '{"订单ID": "J1", "金额": 99, "下单时间": "2025-03-02"}\n', encoding="utf-8")
    raw = read_order_files(spark, str(d), (".json",), fmt="json")
    clean = ing.preprocess(raw).collect()
    assert len(clean) == 1
    assert (clean[0].order_id, clean[0].amount, clean[0].order_created_date) == \
        ("J1", 12.5, dt.datetime(2025, 3, 1, 8, 0))


def test_files_with_different_headers_upsert_by_presence(spark, tmp_path):
    from swatch.operators import merge as mg
    from swatch.schemas import HEADER_MAP
    from swatch.sources.files import union_with_presence
    from swatch.sources.tables import empty_table
    inv = {v: k for k, v in HEADER_MAP.items()}
    d1, d2 = tmp_path / "g1", tmp_path / "g2"
    d1.mkdir(); d2.mkdir()
    (d1 / "2025-01.csv").write_text(f"{inv['order_id']},{inv['amount']},{inv['quantity']}\nK1,10,3\nK2,20,4\n",
                                    encoding="utf-8")
    (d2 / "2025-02.csv").write_text(f"{inv['order_id']},{inv['amount']}\nK1,11\n", encoding="utf-8")
    raw, _ = union_with_presence([read_order_files(spark, str(d1)), read_order_files(spark, str(d2))])
    clean = ing.preprocess(raw)
    present = ing.present_columns(clean)
    assert present["quantity"] == "_has_quantity"
    target = empty_table(spark, "original_orders").unionByName(spark.createDataFrame(
        [(1, "K1", 1.0, 9)], "id long, order_id string, amount double, quantity int"), allowMissingColumns=True)
    res = mg.upsert(target, clean.drop("_ordinal"), dt.datetime(2026, 1, 1), order="_file", present=present)
    got = {r.order_id: r for r in res.table.collect()}
    assert (got["K1"].amount, got["K1"].quantity) == (11.0, 3)   # quantity from the older file
    assert (got["K2"].amount, got["K2"].quantity) == (20.0, 4)


def test_files_of_one_name_in_two_folders_stay_apart(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        _write(tmp_path / folder / "o.csv", HEAD + f"K1,1,1,1,1,2025-01-01,{folder},s,,u\n")
    both = read_order_files(spark, str(tmp_path), (".csv",), recursive=True)
    assert len({r._file for r in both.collect()}) == 2
    assert read_order_files(spark, str(tmp_path / "a"), (".csv",)).count() == 1


def test_date_layouts(spark):
    from swatch.functions import to_timestamp_ntz
    want = {
        "2025-02-04": dt.datetime(2025, 2, 4), "2025/2/4 10:06": dt.datetime(2025, 2, 4, 10, 6), "20250204": dt.datetime(2025, 2, 4),
        "2025.02.04 10:06:07.5": dt.datetime(2025, 2, 4, 10, 6, 7, 500000),
        "02/04/2025 10:06": dt.datetime(2025, 2, 4, 10, 6), "2/4/2025": dt.datetime(2025, 2, 4), "13/02/2025": dt.datetime(2025, 2, 13),
        "4 Feb 2025": dt.datetime(2025, 2, 4), "Feb 4, 2025 10:06": dt.datetime(2025, 2, 4, 10, 6), "february 4 2025": dt.datetime(2025, 2, 4),
        "04-Feb-2025": dt.datetime(2025, 2, 4), "Sept. 4, 2025": dt.datetime(2025, 9, 4), "31 December 2025 12:01 AM": dt.datetime(2025, 12, 31, 0, 1),
        "02/04/2025 3:06 PM": dt.datetime(2025, 2, 4, 15, 6), "2025-02-04 12:30pm": dt.datetime(2025, 2, 4, 12, 30),
        "2025-02-04T10:06:00Z": dt.datetime(2025, 2, 4, 10, 6), "2025-02-04 10:06:00+08:00": dt.datetime(2025, 2, 4, 2, 6),
        "2025-02-04 10:06 -0530": dt.datetime(2025, 2, 4, 15, 36), "2025-02-04 10:06 UTC": dt.datetime(2025, 2, 4, 10, 6),
        "2025-02-30": None, "13/13/2025": None, "Foo 4, 2025": None, "4 Febby 2025": None, "not a date": None, "": None, None: None,
        "2025-02-04 25:00": None, "02/04/2025 13:06 PM": None, "2025-02-04x": None, "1/2/20255": None, "10:06": None,
    }
    df = spark.createDataFrame([(k,) for k in want], "d string")
    got = {r[0]: r[1] for r in df.select("d", to_timestamp_ntz("d")).collect()}
    assert got == want


def test_missing_texts_and_infinity(spark):
    from pyspark.sql import functions as F
    head = "`订单ID` string, `金额` string, `叠衣服成本` string, `客户` string, `衣服总数` string, _file string, _ordinal int"
    data = [("A", "inf", "0.5", "n/a", "NULL", "a", 1), ("B", "Infinity", "#N/A", "NA", "inf", "a", 2), ("NULL", "1", "nan", "x", "1", "a", 3),
            ("C", "-INF", "cheap", " n/a", "2", "b", 1), ("C", "5", "0.5", "kept", "3", "b", 2), ("D", "", "0.5", "None", "4", "b", 3)]
    out = ing.preprocess(spark.createDataFrame(data, head))
    got = {(r._file, r.order_id): (r.amount, r.cloth_pack_cost, r.customer_name, r.quantity) for r in out.collect()}
    inf = float("inf")
    assert got == {("a", "A"): (inf, 0.5, "", 0), ("a", "B"): (inf, None, "", 0), ("a", ""): (1.0, None, "x", 1),
                   ("b", "C"): (-inf, 0.0, " n/a", 2), ("b", "D"): (0.0, 0.0, "", 4)}
    # The verdict counts rows that keep-first drops, and every text is read once.
    scans = out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD")
    assert scans == 0
    later = ing.preprocess(spark.createDataFrame([("E", "1", "0.5", "x", "1", "c", 1), ("E", "1", "text", "x", "1", "c", 2)], head))
    assert later.first().cloth_pack_cost == 0.0


def test_upsert_of_narrow_files_keeps_the_rest(spark, tmp_path):
    from swatch.operators import merge as mg
    from swatch.sources.files import order_file_headers, read_mixed_order_files
    from swatch.sources.tables import empty_table
    _write(tmp_path / "1.csv", "订单ID,客户,金额\nA1,new,5\nA3,c3,7\n")
    _write(tmp_path / "2.csv", "金额,订单ID\n9,A1\n8,A4\n")
    _write(tmp_path / "3.csv", "\ufeff订单ID,\"未知,列\"\nA2,u\n")
    _write(tmp_path / "4.csv", "")
    _write(tmp_path / "~$1.csv", "订单ID\nX\n")
    groups = order_file_headers(spark, str(tmp_path))
    assert list(groups) == [("订单ID", "客户", "金额"), ("金额", "订单ID"), ("订单ID", "未知,列")]
    raw, present = read_mixed_order_files(spark, str(tmp_path))
    good, _ = ing.prepare_batch(ing.preprocess(raw), ORIGINAL_ORDERS, "2026-01-01", align=False)
    target = empty_table(spark, "original_orders").unionByName(spark.createDataFrame(
        [(i, f"A{i}", "p", "note", 7.5, "old", 1.0) for i in (1, 2)],
        "id long, order_id string, phone string, notes string, work_cost double, customer_name string, amount double"),
        allowMissingColumns=True)
    res = mg.upsert(target, good.drop("_ordinal"), "2026-01-01", order="_file", present=ing.present_columns(good))
    got = {r.order_id: (r.id, r.phone, r.notes, r.work_cost, r.customer_name, r.amount) for r in res.table.collect()}
    assert got == {"A1": (1, "p", "note", 7.5, "new", 9.0), "A2": (2, "p", "note", 7.5, "old", 1.0),
                   "A3": (3, None, None, None, "c3", 7.0), "A4": (4, None, None, None, None, 8.0)}
    assert tuple(res.stats.first()) == (2, 3)
