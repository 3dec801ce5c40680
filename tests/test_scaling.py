"""Plans and steps that the findings on time asked for."""

import datetime as dt
from types import SimpleNamespace

from pyspark.sql import functions as F

from swatch.operators import ingest as ing
from swatch.operators import merge as mg
from swatch.plans import reports


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_orphan_links_build_once(spark, monkeypatch):
    built = []

    def build(s, d):
        built.append(d)
        return SimpleNamespace(sample_links=spark.createDataFrame([(1, 7), (2, 8), (3, None)], "id long, sample_customer_id long"),
                               sample_customers=spark.createDataFrame([(7,)], "id long"))

    monkeypatch.setattr(reports, "_build", build)
    query = next(q for q in reports.queries() if q.name == "q3_orphan_links_p6")
    assert [r["id"] for r in query.build(spark, "x").collect()] == [2]
    assert built == ["x"]


def test_missing_edits_read_keys_alone(spark):
    stats = spark.createDataFrame([(1, 5.0), (1, 6.0)], "cid long, amount double").groupBy("cid").agg(F.sum("amount").alias("total"))
    customers = spark.createDataFrame([(1, "a"), (2, "b")], "id long, handler string")
    customers = customers.join(stats, F.col("id") == F.col("cid"), "left").select("id", "handler", "total")
    changes = spark.createDataFrame([(2, {"handler": "x"}), (3, {"handler": "y"}), (3, {"handler": "z"})],
                                    "id long, changes map<string,string>")
    _, missing = mg.edit_customers(customers, changes, ["handler"])
    assert "LeftOuter" not in _plan(missing)
    assert sorted((r["id"], r["changes"]["handler"]) for r in missing.collect()) == [(3, "y"), (3, "z")]


def test_batch_of_one_flag_is_one_comparison(spark):
    rows = [("k", "1", "a", 1, "x", True), ("k", "2", None, 2, "y", False), ("l", "1", "c", 3, None, False)]
    batch = spark.createDataFrame(rows, "order_id string, _file string, a string, b int, c string, _has_c boolean")
    got = mg.reduce_batch(batch, "order_id", "_file", {"c": "_has_c"})
    assert got.columns == ["order_id", "a", "b", "c", "_has_c", "_rows", "_first"]
    assert sorted(map(tuple, got.collect())) == [("k", None, 2, "x", True, 2, "1"), ("l", "c", 3, None, False, 1, "1")]
    assert _plan(got).count("max_by(") == 2  # the columns without a flag, and those with it


def test_batch_is_written_once(spark, monkeypatch):
    written = []
    whole = mg.materialize
    monkeypatch.setattr(mg, "materialize", lambda df, name="stage": written.append(name) or whole(df, name))
    target = spark.createDataFrame([], "id long, order_id string, a string, created_at timestamp_ntz, updated_at timestamp_ntz")
    batch = spark.createDataFrame([("k", "a", "1"), ("k", "b", "2")], "order_id string, a string, _file string")
    res = mg.upsert(target, batch, dt.datetime(2026, 1, 1), order="_file")
    assert written == ["batch"]
    assert [(r["id"], r["order_id"], r["a"]) for r in res.table.collect()] == [(1, "k", "b")]
    assert tuple(res.stats.first()) == (1, 1)


def test_verdict_of_files_is_broadcast(spark, monkeypatch):
    rows = [("f", "1", 1.0, False), ("f", "2", None, True), ("g", "1", 2.0, False), (None, "1", 3.0, True)]
    df = spark.createDataFrame(rows, "_file string, order_id string, cloth_pack_cost double, _dirty boolean")
    wanted = [(0.0, "1"), (0.0, "2"), (2.0, "1"), (3.0, "1")]
    for limit, broadcast in ((ing.BROADCAST_FILES, True), (0, False)):
        monkeypatch.setattr(ing, "BROADCAST_FILES", limit)
        got = ing.zero_if_dirty(df)
        assert sorted((r["cloth_pack_cost"], r["order_id"]) for r in got.collect()) == wanted
        assert ("strategy=broadcast" in _plan(got)) == broadcast
