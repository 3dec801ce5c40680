"""Publishing: killed attempts, retries, concurrent writers; buckets rewritten only where keys changed."""

import datetime as dt
import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from helpers import rows
from swatch.operators import merge as mg
from swatch.sources import snapshots as snap

AS_OF = dt.datetime(2026, 1, 1)
D = dt.datetime(2025, 1, 1)


def one(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id long")


@pytest.fixture(params=["file", "viewfs"])
def base(request, spark, tmp_path):
    """A folder by its plain path, and by a file system without local paths."""
    if request.param == "file":
        return str(tmp_path / "tables")
    name = tmp_path.name.replace("_", "-")
    spark.sparkContext._jsc.hadoopConfiguration().set(f"fs.viewfs.mounttable.{name}.link./d", f"file://{tmp_path}")
    return f"viewfs://{name}/d/tables"


def test_killed_attempt_and_retry(spark, base, monkeypatch):
    snap.publish(spark, base, "1", {"a": one(spark, 1), "b": one(spark, 1)})
    real = snap.put_if_absent

    def killed(*args):
        raise KeyboardInterrupt

    monkeypatch.setattr(snap, "put_if_absent", killed)
    with pytest.raises(KeyboardInterrupt):  # after the tables, before the entry
        snap.publish(spark, base, "2", {"a": one(spark, 2)})
    assert rows(snap.read_current(spark, base, "a")) == [(1,)] and not snap.is_published(spark, base, "2")
    monkeypatch.setattr(snap, "put_if_absent", real)
    snap.publish(spark, base, "2", {"a": one(spark, 22)})
    assert rows(snap.read_current(spark, base, "a")) == [(22,)] and rows(snap.read_current(spark, base, "b")) == [(1,)]
    with pytest.raises(ValueError):  # after the entry: published once
        snap.publish(spark, base, "2", {"a": one(spark, 3)})
    assert rows(snap.read_current(spark, base, "a")) == [(22,)]


def test_put_if_absent_has_one_winner(spark, base):
    won = []
    threads = [threading.Thread(target=lambda i=i: won.append(snap.put_if_absent(spark, f"{base}/x/1.json", f"{i}")))
               for i in range(6 if not base.startswith("viewfs") else 1)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert won.count(True) == 1 and not snap.put_if_absent(spark, f"{base}/x/1.json", "late")
    assert snap._names(spark, f"{base}/x") == ["1.json"]


def test_two_writers(spark, base):
    snap.publish(spark, base, "0", {"a": one(spark, 0), "b": one(spark, 0), "c": one(spark, 0)})
    first, second = snap.current(spark, base), snap.current(spark, base)
    snap.publish(spark, base, "A", {"a": one(spark, 1)}, based_on=first)
    snap.publish(spark, base, "B", {"b": one(spark, 2)}, based_on=second)  # another table: both stand
    assert [rows(snap.read_current(spark, base, t)) for t in "abc"] == [[(1,)], [(2,)], [(0,)]]
    with pytest.raises(snap.PublishConflict):  # the same table: the second starts again from the new state
        snap.publish(spark, base, "C", {"a": one(spark, 3)}, based_on=second)
    with pytest.raises(snap.PublishConflict):  # derived from a table that has changed
        snap.publish(spark, base, "D", {"c": one(spark, 4)}, based_on=second, depends=["a"])
    assert [rows(snap.read_current(spark, base, t)) for t in "abc"] == [[(1,)], [(2,)], [(0,)]]
    snap.publish(spark, base, "C", {"a": one(spark, 3)})
    assert rows(snap.read_current(spark, base, "a")) == [(3,)] and snap.current(spark, base)["seq"] == 4


ORDERS = "id long, order_id string, order_type string, amount double, created_at timestamp_ntz, updated_at timestamp_ntz"


def source(spark, n, day=0):
    return spark.createDataFrame([(i, f"k{i}", "s" if i % 3 else "b", float(i + day), D, D + dt.timedelta(days=day))
                                  for i in range(n)], ORDERS)


def test_sync_rewrites_only_buckets_with_changes(spark, base):
    routes = {"sample": ["s"], "bulk": ["b"]}
    old = source(spark, 60)
    tables = {name: mg.route(old, types).withColumn("status", F.lit("x")) for name, types in routes.items()}
    snap.publish(spark, base, "1", tables, buckets={name: ("order_id", 16) for name in routes})
    before = snap.current(spark, base)["tables"]
    # Nothing has changed: nothing is written.
    assert snap.sync_snapshot(spark, base, "2", old, routes, AS_OF) == {"sample": [], "bulk": []}
    assert snap.current(spark, base)["tables"] == before
    # One row is newer, two are new.
    new = old.where("order_id <> 'k7'").unionByName(
        source(spark, 8, day=1).where("order_id = 'k7'")).unionByName(source(spark, 62).where("id >= 60"))
    want = {name: rows(mg.sync_route(tables[name], new, types, AS_OF).drop("_action")) for name, types in routes.items()}
    touched = snap.sync_snapshot(spark, base, "3", new, routes, AS_OF)
    after = snap.current(spark, base)["tables"]
    for name in routes:
        assert rows(snap.read_current(spark, base, name)) == want[name]
        changed = [b for b, (x, y) in enumerate(zip(before[name]["paths"], after[name]["paths"])) if x != y]
        assert changed == touched[name] and 0 < len(changed) <= 2
        some = snap.read_entry(spark, base, snap.current(spark, base), name, touched[name])
        assert 0 < some.count() < len(want[name])


def test_bucketed_upsert_equals_the_plain_one(spark, base):
    old = source(spark, 40)
    snap.publish(spark, base, "1", {"t": old}, buckets={"t": ("order_id", 8)})
    batch = spark.createDataFrame([("k3", 99.0), ("n1", 1.0), ("n2", 2.0), (None, 5.0)], "order_id string, amount double")
    want = mg.upsert(old, batch, AS_OF)
    assert want.stats.first().inserted == 2
    touched = snap.upsert_snapshot(spark, base, "2", "t", batch, AS_OF)
    assert rows(snap.read_current(spark, base, "t")) == rows(want.table.drop("_action")) and len(touched) <= 3
    with pytest.raises(ValueError):  # a merge must not move rows to buckets that it does not rewrite
        snap.rewrite_buckets(spark, base, "3", "t", batch.select("order_id").limit(1),
                             lambda part: part.withColumn("order_id", F.concat("order_id", F.lit("x"))))


def test_entries_are_plain_json(spark, tmp_path):
    snap.publish(spark, str(tmp_path), "1", {"a": one(spark, 1)})
    names = os.listdir(tmp_path / snap.PUBLISHED)
    entry = json.loads((tmp_path / snap.PUBLISHED / names[0]).read_text())
    assert names == ["000000000001.json"] and (entry["seq"], entry["version"], list(entry["tables"])) == (1, "1", ["a"])
