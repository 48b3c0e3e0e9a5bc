"""Event-time timers against their batch twins, and sinks whose batches run again."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemill.streaming import events, sinks, timers

BEGIN = pd.Timestamp("2024-01-01 08:00:00")


def at(minutes):
    return (BEGIN + pd.Timedelta(minutes=minutes)).to_pydatetime()


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    timers.use_rocksdb(spark)
    yield spark
    spark.conf.set(key, old)


def stream(spark, df, rows, folder):
    """The rows as files of a few rows each, one file a batch, in the order given."""
    for i in range(0, len(rows), 25):
        spark.createDataFrame(rows[i : i + 25], df.schema).coalesce(1).write.parquet(f"{folder}/f{i:05d}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def test_orders_run_out_of_time(rocks, tmp_path):
    spark, rng = rocks, random.Random(2)
    rows = []
    for i in range(60):
        start = rng.uniform(0, 300)
        rows.append((f"o{i}", 3 * i, at(start), "placed", f"s{i % 4}", i))
        if i % 3 == 0:
            rows.append((f"o{i}", 3 * i + 1, at(start + 20), "paid", None, None))  # in time
        if i % 3 == 1:
            rows.append((f"o{i}", 3 * i + 1, at(start + 45), "paid", None, None))  # late
        if i % 5 == 0:
            rows.append((f"o{i}", 3 * i + 2, at(start + 10), "cancelled", None, None))
    rows += [("ghost", 900, at(50), "paid", None, None), ("o1", 901, at(290), "placed", "s9", 9), (None, 902, at(1), "placed", "s", 1)]
    # up to five minutes out of order
    rows.sort(key=lambda r: (r[2] + pd.Timedelta(minutes=rng.uniform(0, 5)), r[1]))
    rows += [("end", 950, at(1000), "placed", "s", 1), ("end", 951, at(1001), "paid", None, None)]
    df = spark.createDataFrame(rows, "order_id string, event_id long, at timestamp, kind string, sku string, qty long")
    got = events.collect_available(timers.order_timers(stream(spark, df, rows, tmp_path / "in")), "orders_out", str(tmp_path / "c"))
    want = timers.order_outcomes(df.where("order_id <> 'end'"), until=F.lit(at(990)))
    found = sorted(map(tuple, got.collect()), key=repr)
    assert found == sorted(map(tuple, want.select(*got.columns).collect()), key=repr) and len(found) == 61
    assert {r[3] for r in found} == {"paid", "cancelled", "expired", "unknown_order"}


def test_needs_add_up_until_silence(rocks, tmp_path):
    spark, rng = rocks, random.Random(3)
    rows = []
    for i in range(200):
        rows.append((f"c{i % 7}", i, at(rng.uniform(0, 900)), rng.choice(["size", "colour", None]), rng.choice(["a", "b", "c", None])))
    rows.sort(key=lambda r: (r[2] + pd.Timedelta(minutes=rng.uniform(0, 5)), r[1]))
    last = [("z", 999, at(2000), None, None), ("z", 1000, at(2001), None, None)]
    df = spark.createDataFrame(rows + last, "session string, event_id long, at timestamp, field string, value string")
    got = events.collect_available(timers.need_sessions(stream(spark, df, rows + last, tmp_path / "in"), 1800), "needs_out", str(tmp_path / "c"))
    want = timers.needs_by_session(df.where("session <> 'z'"), 1800)
    plain = lambda x: sorted((r.session, r.start, r["last"], sorted(r.needs.items()), r.events) for r in x.collect())
    assert plain(got) == plain(want) and len(plain(got)) > 15


def counted(rows):
    return rows.select("id", F.when(F.col("id") % 3 == 0, "failed").otherwise("done").alias("outcome"), F.lit("e").alias("error"), F.when(F.col("id") % 4 == 1, F.lit("next")).alias("follow_up"))


def test_batches_run_again_add_nothing(spark, tmp_path):
    root = str(tmp_path / "sink")
    batch = spark.range(20).select("id", F.lit("p").alias("payload"), (F.col("id") % 5).cast("int").alias("retry_count"))
    asked = []

    def once(rows):
        asked.append(1)
        return counted(rows)

    each = sinks.task_sink(root, once)
    log, sinks.log_batch = sinks.log_batch, lambda *a: (_ for _ in ()).throw(RuntimeError("stopped after the write"))
    try:
        with pytest.raises(RuntimeError, match="stopped"):
            each(batch, 0)
    finally:
        sinks.log_batch = log
    state = lambda: {n: sorted(map(tuple, sinks.read_sink(spark, f"{root}/{n}").collect())) for n in ("done", "again", "dead", "follow_ups")}
    before = state()
    each(batch, 0)  # all of it anew
    assert state() == before and len(asked) == 2
    each(batch, 0)  # logged: left alone
    assert state() == before and len(asked) == 2
    each(batch.limit(3), 1)
    assert sinks.batches_logged(spark, f"{root}/log") == {0, 1}
    assert {r[0] for r in before["done"]} == {i for i in range(20) if i % 3}
    assert {(r[0], r[2]) for r in before["again"]} == {(i, i % 5 + 1) for i in range(0, 20, 3) if i % 5 < 3}
    assert {(r[0], r[2]) for r in before["dead"]} == {(i, i % 5 + 1) for i in range(0, 20, 3) if i % 5 >= 3}
    assert sorted(r[3] for r in before["follow_ups"]) == sorted(str(i) for i in range(20) if i % 3 and i % 4 == 1)


def test_worker_over_a_stream(spark, tmp_path):
    tasks = spark.range(30).select("id", F.lit("p").alias("payload"), F.lit(0).alias("retry_count"))
    tasks.repartition(3).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(tasks.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    root = str(tmp_path / "sink")
    sinks.start_worker(s, root, str(tmp_path / "c"), counted)
    assert sinks.read_sink(spark, f"{root}/done").count() == 20 and sinks.read_sink(spark, f"{root}/again").count() == 10
    assert len(sinks.batches_logged(spark, f"{root}/log")) == 3


def test_append_new_skips_what_is_there(spark, tmp_path):
    path = str(tmp_path / "feedback")
    a = spark.createDataFrame([(1, "x"), (1, "w"), (2, "y")], "k long, v string")
    sinks.append_new(a, path, 0, ["k"])
    sinks.append_new(a, path, 0, ["k"])
    sinks.append_new(spark.createDataFrame([(2, "z"), (3, "z")], a.schema), path, 1, ["k"])
    assert sorted((r.k, r.v, r.batch_id) for r in sinks.read_sink(spark, path).collect()) == [(1, "w", 0), (2, "y", 0), (3, "z", 1)]
