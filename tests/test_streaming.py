import datetime as dt

from swatch.sources import snapshots as snap
from swatch.streaming import order_file_stream, upsert_batches

HEADERS = ("订单ID", "金额", "客户", "订单分类", "下单时间")
HEAD = ",".join(HEADERS) + "\n"


def test_file_stream_upserts_and_publishes(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.csv").write_text(HEAD + "A1,10,c1,打样单,2025-02-01 10:00:00\nA2,n/a,c2,新订单,2025/02/02 11:00\n",
                               encoding="utf-8")
    base = str(tmp_path / "tables")
    stamp = dt.datetime(2026, 1, 1)
    q = (order_file_stream(spark, str(src), HEADERS).writeStream
         .foreachBatch(upsert_batches(base, as_of=stamp))
         .option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    t = {r.order_id: r for r in snap.read_current(spark, base, "original_orders").collect()}
    assert set(t) == {"A1", "A2"} and t["A2"].amount == 0.0 and t["A1"].id == 1
    (src / "b.csv").write_text(HEAD + "A1,99,c1,打样单,2025-02-01 10:00:00\n", encoding="utf-8")
    q = (order_file_stream(spark, str(src), HEADERS).writeStream
         .foreachBatch(upsert_batches(base, as_of=stamp))
         .option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    t = {r.order_id: r for r in snap.read_current(spark, base, "original_orders").collect()}
    assert (t["A1"].amount, t["A1"].id, len(t)) == (99.0, 1, 2)


def _run(spark, src, base, ckpt, **options):
    q = (order_file_stream(spark, str(src), HEADERS).writeStream.foreachBatch(upsert_batches(base, **options))
         .option("checkpointLocation", str(ckpt)).trigger(availableNow=True).start())
    q.awaitTermination(300)


def test_a_new_stream_into_the_same_tables(spark, tmp_path):
    base, stamp = str(tmp_path / "tables"), dt.datetime(2026, 1, 1)
    for k, folder in enumerate(("in1", "in2")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "a.csv").write_text(HEAD + f"K{k},1{k},c1,打样单,2025-02-01 10:00:00\n", encoding="utf-8")
    _run(spark, tmp_path / "in1", base, tmp_path / "c1", as_of=stamp)
    # Its first batch has number 0 as well, and must not be taken for the other stream's.
    _run(spark, tmp_path / "in2", base, tmp_path / "c2", as_of=stamp)
    assert {r.order_id: r.id for r in snap.read_current(spark, base, "original_orders").collect()} == {"K0": 1, "K1": 2}


def test_a_batch_that_died_before_its_entry_is_run_again(spark, tmp_path, monkeypatch):
    base, src = str(tmp_path / "tables"), tmp_path / "in"
    src.mkdir()
    (src / "a.csv").write_text(HEAD + "A1,10,c1,打样单,2025-02-01 10:00:00\n", encoding="utf-8")
    batch = spark.read.option("header", True).csv(str(src)).selectExpr("*", "'a.csv' AS _file", "0L AS _block")
    run = upsert_batches(base, as_of=dt.datetime(2026, 1, 1), stream="s")
    with monkeypatch.context() as m:
        m.setattr(snap, "put_if_absent", lambda *a: (_ for _ in ()).throw(OSError("killed")))
        try:
            run(batch, 0)
        except OSError:
            pass
    assert snap.current_version(spark, base) is None
    run(batch, 0)
    run(batch, 0)  # and once more after it was published
    assert snap.read_current(spark, base, "original_orders").count() == 1
