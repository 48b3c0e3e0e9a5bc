import pandas as pd
from pyspark.sql import functions as F

from tidemill.operators import commerce, knowledge, retrieval
from tidemill.sources import dialogues, tables
from tidemill.streaming import events


def test_tsv_runs(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("s1\t1\t0\t有货吗\t2024-01-01 10:00:00\ns1\t2\t1\t有的\t1704103200\nbad\trow\ns2\t1\tx\t \t\ns2\t2\t9\t你好\t1704103200000\ns1\t3\t0\t好\n")
    got = {(r.session_no, r.run): r.turns for r in dialogues.read_tsv(spark, str(tmp_path / "a.tsv")).collect()}
    assert {k: [(t["role"], t["content"]) for t in v] for k, v in got.items()} == {("s1", 1): [("user", "有货吗"), ("agent", "有的")], ("s2", 2): [("user", "你好")], ("s1", 3): [("user", "好")]}
    assert got["s1", 1][1]["said_at"] == got["s2", 2][0]["said_at"]


def test_jsonl_adapts_names(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"session_id":"a","turns":[{"role":"0","content":"hi"},{"role":"1","text":""},{"role":"1","images":["x"]}]}\nnot json\n{"id":"b","dialogue":[{"role":"agent","text":"yo"}]}\n{"id":"c","turns":[]}\n')
    got = {r.session_no: [(t["turn_index"], t["role"], t["content"]) for t in r.turns] for r in dialogues.read_dialogues(spark, str(tmp_path / "a.jsonl")).collect()}
    assert got == {"a": [(0, "user", "hi"), (2, "agent", "")], "b": [(0, "agent", "yo")]}


def test_upserts_and_keys(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    b = spark.createDataFrame([(2, "z"), (3, " ")], "k long, v string")
    assert sorted(map(tuple, tables.latest(a, b, ["k"]).collect())) == [(1, "x"), (2, "z"), (3, " ")]
    assert [r.k for r in tables.without(a, b, ["k"]).collect()] == [1]
    assert sorted(map(tuple, tables.coalesce_updates(a, spark.createDataFrame([(1, " "), (2, "q")], "k long, v string"), "k", ["v"]).collect())) == [(1, "x"), (2, "q")]
    one = spark.createDataFrame([(1, "p"), (2, "p")], "k long, provider string")
    assert tables.one_provider(one).count() == 2
    try:
        tables.one_provider(one.unionAll(spark.createDataFrame([(3, "q")], one.schema))).collect()
        raise AssertionError("mixed providers went through")
    except Exception as e:
        assert "several providers" in str(e)


def test_snapshot_and_mart(spark, tmp_path):
    rows = spark.sql("select 1 as id, cast(null as string) t, timestamp '2024-01-05 00:00:00' at union all select 2, 'ü', timestamp '2024-02-05 00:00:00'")
    tables.write_snapshot(rows.select("id", "t"), str(tmp_path / "v1"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "v1")).collect()) == ['{"id":1}', '{"id":2,"t":"ü"}']
    tables.write_mart(rows, str(tmp_path / "m"), F.col("at"), ["id"])
    assert sorted(r.ym for r in spark.read.parquet(str(tmp_path / "m")).select(F.col("ym").cast("string")).collect()) == ["202401", "202402"]


def test_merge_keeps_order_and_caps(spark):
    kind = "id long, title string, content string, tags array<string>, category_id long, confidence double, quality_score double"
    items = spark.createDataFrame([(1, "t", "a", ["x"], None, 0.5, 0.5), (2, "t", "ab", ["y", "x"], 7, 0.5, 0.5), (3, "u", "c", [], None, 0.99, 0.1)], kind)
    got = {r.id: (r.tags, r.category_id, round(r.confidence, 6), r.merged) for r in knowledge.merge_duplicates(items, F.col("title")).collect()}
    assert got == {2: (["y", "x"], 7, 0.53, 2), 3: ([], None, 0.99, 1)}


def test_order_states_refuse_wrong_moves(spark):
    e = spark.createDataFrame([(1, 1, "pay"), (1, 2, "cancel"), (1, 3, "ship"), (2, 1, "cancel"), (2, 2, "pay")], "o long, at long, e string")
    got = {r.o: (r.state, r.refused) for r in commerce.fold_states(e, "o", ["at"], "e").collect()}
    assert got == {1: ("shipped", 1), 2: ("cancelled", 1)}
    s = spark.createDataFrame([("s", i, -2) for i in range(4)] + [("s", 9, 1)], "sku string, at long, d long")
    assert tuple(commerce.fold_stock(s, "sku", ["at"], "d", F.lit(5)).first()) == ("s", 2, 4, 2)


def test_dense_in_blocks(spark):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(10)], "doc long, vec array<float>")
    q = v.toDF("query", "qvec")
    whole = sorted(map(tuple, retrieval.dense(q, v).collect()))
    assert whole == sorted(map(tuple, retrieval.dense(q, v, 3).collect())) and len(whole) == 100


def test_streams_agree_with_batch(spark, tmp_path):
    schema = "id long, user long, ts timestamp, kind string, v double"
    rows = [(i, i % 3, (pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=7 * i)).to_pydatetime(), "bad" if i % 2 else "ok", float(i)) for i in range(60)]
    df = spark.createDataFrame(rows + rows[:5], schema)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = lambda: events.read_events(spark, str(tmp_path / "in"), df.schema)
    once = events.collect_available(events.deduplicated(s(), "id", "ts"), "once", str(tmp_path / "c1"))
    assert once.count() == 60
    w = events.collect_available(events.windowed(s(), "ts", by="kind", value="v"), "wins", str(tmp_path / "c2"), "complete")
    batch = df.groupBy(F.window("ts", "30 minutes").alias("w"), "kind").agg(F.count("*").alias("n"), F.sum("v").alias("t")).select("w.start", "kind", "n", "t")
    assert sorted(map(tuple, w.collect())) == sorted(map(tuple, batch.collect()))
    bad = df.dropDuplicates(["id"]).where("user = 1").orderBy("ts")
    runs, run = [], 0
    for r in bad.collect():
        run = run + 1 if r.kind == "bad" else 0
        runs += [(r.user, r.ts, run)] if run == 1 else []
    got = events.collect_available(events.negative_streaks(events.deduplicated(s().where("user = 1"), "id", "ts"), "user", "ts", "kind", "bad", 1), "streak", str(tmp_path / "c3"))
    assert sorted(map(tuple, got.collect())) == sorted(runs)


def test_tsv_runs_go_on_over_splits(spark, tmp_path):
    lines = [f"s{i // 7 % 3}\t{i}\t{i % 2}\ttext {i}\t2024-01-01 10:00:00" for i in range(200)]
    (tmp_path / "long.tsv").write_text("\n".join(lines) + "\n")

    def read():
        return sorted((r.run, r.session_no, tuple(t["content"] for t in r.turns)) for r in dialogues.read_tsv(spark, str(tmp_path / "long.tsv")).collect())

    whole = read()
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
        assert read() == whole
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert len(whole) == 29 and [r[0] for r in whole] == list(range(1, 30)) and whole[1][2] == tuple(f"text {i}" for i in range(7, 14))
