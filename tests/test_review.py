import random

import pytest
from pyspark.sql import functions as F

from tidemill.operators import greedy, rag_text, review


def test_keep_first_is_greedy(spark):
    rng = random.Random(2)
    pairs = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(45)} | {(50, 51), (51, 52), (52, 53)}
    ids = [*range(40), 50, 51, 52, 53, 60]
    kept = set()
    for i in ids:
        if not any((a, i) in pairs for a in kept):
            kept.add(i)
    got = greedy.keep_first(spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(sorted(pairs), "a long, b long"))
    assert sorted(r.id for r in got.collect()) == sorted(kept)


def test_similar_pairs_lose_none(spark):
    rng = random.Random(4)
    rows = [(i, [str(rng.randrange(12)) for _ in range(rng.randint(0, 8))]) for i in range(60)]
    want = {}
    for i, a in rows:
        for j, b in rows:
            x, y = set(a), set(b)
            if i < j and x and y and len(x & y) / len(x | y) >= 0.6:
                want[i, j] = round(len(x & y) / len(x | y), 6)
    got = greedy.similar_pairs(spark.createDataFrame(rows, "id long, t array<string>"), "id", F.col("t"), 0.6).collect()
    assert {(r.a, r.b): round(r.score, 6) for r in got} == want


def test_chunks_by_kind(spark):
    long = "".join(f"第{i}句话说明面料和洗护的方法。" for i in range(60))
    rows = [(1, "qa", "问", "答" * 900), (2, "script", "t", long), (3, "policy", "t", "# 退货\n七天无理由。请保持吊牌。\n## 换货\n" + long), (4, "policy", "t", ""), (5, "qa", None, None)]
    got = {}
    for r in rag_text.chunks(spark.createDataFrame(rows, "id long, biz_type string, title string, content string")).orderBy("id", "seq").collect():
        got.setdefault(r.id, []).append((r.heading_path, r.text))
    assert got[1] == [("", "问\n" + "答" * 900)] and 4 not in got and 5 not in got
    assert len(got[2]) > 1 and all(len(t) <= 400 for _, t in got[2])
    assert all(b[1].startswith(a[1][-50:]) for a, b in zip(got[2], got[2][1:]))
    assert got[3][0] == ("退货", "七天无理由。请保持吊牌。") and {h for h, _ in got[3][1:]} == {"换货"} and all(len(t) <= 500 for _, t in got[3])


def test_marks_and_json(spark):
    row = spark.createDataFrame([("看 [#7] 和 [#3]，还有 [#9] [#7]", "```json\n{\"a\": 1}\n```", "好的 {\"a\": 2} 完", "nothing", "订单 12345678901 与 123")], "t string, j string, k string, l string, o string")
    got = row.select(
        rag_text.picked(F.col("t"), F.array(F.lit(3).cast("long"), F.lit(7).cast("long"))).alias("p"),
        *[rag_text.lenient_json(F.col(c), "a int").alias(c) for c in "jkl"], rag_text.order_number(F.col("o")).alias("o"),
        F.size(rag_text.replies(F.lit("一句话。" * 120))).alias("n"),
    ).first()
    assert got.p == [7, 3] and got.j.a == 1 and got.k.a == 2 and got.l is None and got.o == "12345678901" and got.n == 3


def test_model_outcomes(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "no"), (3, "b")], "id long, text string").coalesce(1)
    got = {r.id: (r.answer, r.status) for r in rag_text.ask_model(rows, lambda ts: [None if t == "no" else t.upper() for t in ts], "text").collect()}
    assert got == {1: ("A", "ok"), 2: (None, "drop"), 3: ("B", "ok")}

    def down(_):
        raise ConnectionError("down")

    assert {r.status for r in rag_text.ask_model(rows, down, "text").collect()} == {"infra"}

    def wrong(_):
        raise ValueError("no such model")

    with pytest.raises(Exception, match="no such model"):
        rag_text.ask_model(rows, wrong, "text").collect()


def test_overlaps_and_alignment(spark):
    s = spark.createDataFrame([("l", 0, 1000, "ab"), ("l", 300, 1000, "abcd"), ("l", 950, 2000, "x"), ("m", 0, 10, "y")], "live string, begin_ms long, end_ms long, script string")
    assert sorted(map(tuple, review.drop_overlaps(s, "live").collect())) == [("l", 300, 1000, "abcd"), ("l", 950, 2000, "x"), ("m", 0, 10, "y")]
    n = spark.createDataFrame([(1, "毛衣", 0), (2, "羊毛衫", 1), (3, "羊毛", 2)], "product_id long, name string, pos int")
    g = spark.createDataFrame([(1, "这件羊毛衫"), (2, "那件"), (3, "羊毛")], "segment_id long, t string")
    assert {r.segment_id: r.product_id for r in review.align(g, n, "t").collect()} == {1: 2, 2: None, 3: 3}


def test_whole_texts_count(spark):
    from tidemill.operators import evaluation

    item = " ".join(f"word{i}" for i in range(20))
    docs = [(1, "before it " + item.replace(" ", "\n") + " after"), (2, item[:70] + " but then another end"), (3, item), (4, None), (5, "x" + item), (6, "short one")]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    kept = lambda items: sorted(r.doc_id for r in evaluation.isolated(docs, spark.createDataFrame(items, "text string")).collect())
    assert kept([(item,), (None,), (" ",)]) == [2, 4, 5, 6] and kept([("short one",)]) == [1, 2, 3, 4, 5] and kept([(None,)]) == [1, 2, 3, 4, 5, 6]


def test_equal_terms_join_as_one(spark):
    from tidemill.operators import greedy

    texts = ["a b c d", "d c b a", "a b c e", "x y", "", "a b c d"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    terms = F.filter(F.split("t", " "), lambda x: x != "")
    got = {(r.a, r.b): round(r.score, 6) for r in greedy.similar_pairs(rows, "id", terms, 0.5).collect()}
    assert got == {(0, 1): 1, (0, 5): 1, (1, 5): 1, (0, 2): 0.6, (1, 2): 0.6, (2, 5): 0.6}
    assert sorted(r.id for r in greedy.without_similar(rows, "id", terms, 0.5).collect()) == [0, 3, 4]


def test_frequent_terms_bring_no_pairs_that_cannot_be_alike(spark, monkeypatch):
    """Sets of many common terms: what meets is what is alike, widths and places of maps notwithstanding."""
    import random

    rng = random.Random(3)
    rows = []
    for i in range(500):
        n = rng.choice([3, 20, 60, 300, 700])
        rows.append((i, sorted({str(int(2500 * rng.random() ** 2)) for _ in range(n)})))
    for i in range(500, 560):
        old = rows[rng.randrange(500)][1]
        rows.append((i, sorted({t for t in old if rng.random() > 0.25} | {str(rng.randrange(2500)) for _ in range(len(old) // 10)}) or ["x"]))
    sets = {i: set(t) for i, t in rows}
    met = []
    cut = greedy.cut
    monkeypatch.setattr(greedy, "cut", lambda r: met.append(cut(r)) or met[-1])
    got = {(r.a, r.b): r.score for r in greedy.similar_pairs(spark.createDataFrame(rows, "id long, t array<string>"), "id", F.col("t"), 0.5).collect()}
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}
    assert got == want and len(want) > 40
    candidates = [m for m in met if m.columns == ["a", "b"]]
    assert len(candidates) == 1 and candidates[0].count() <= 2 * len(want)


def test_near_sessions_are_scored_on_few_pairs(spark, tmp_path, monkeypatch):
    """Long sessions of one vocabulary: only those that can reach 0.85 are scored, and one that rounds to it counts."""
    import random

    from tidemill.plans import dialogue

    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(150)) for _ in range(60)]
    texts += [texts[0], texts[1] + " " + texts[1][:40], texts[2][30:]]
    spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    met = []
    cut = greedy.cut
    monkeypatch.setattr(greedy, "cut", lambda r: met.append(cut(r)) or met[-1])
    got = {(r.a, r.b): r.score for r in dialogue.near_session_pairs(spark, str(tmp_path)).collect()}
    bare = [t.replace(" ", "") for t in texts]
    sets = [frozenset(t[i : i + 4] for i in range(len(t) - 3)) for t in bare]
    reps = [i for i, s in enumerate(sets) if s not in sets[:i]]
    want = {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6) for a in reps for b in reps if a < b}
    want = {k: v for k, v in want.items() if v >= 0.85} | {(0, 60): 1.0}
    assert got == want and len(want) >= 3
    assert sum(m.count() for m in met if m.columns == ["a", "b"]) <= 2 * len(want)


def _plan(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_isolated_runs_carry_no_text(spark):
    """Runs of words are hashed in place and go without their text; items of every length are found."""
    from tidemill.operators import evaluation

    docs = spark.createDataFrame([(0, "a b c d e f g"), (1, "b c d e f"), (2, "x a"), (3, None), (4, "b c  d e\nf h"), (5, "xa b")], "doc_id long, text string")
    kept = evaluation.isolated(docs, spark.createDataFrame([("b c d e f g",), ("x",), ("b c d e f h",), (None,), (" ",)], "text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 5]
    assert "slice(" not in _plan(kept)


def test_answers_meet_only_the_least_assets(spark):
    """Assets are cut to the limit by item and product before answers meet them; repeats between both cost none."""
    from tidemill.operators import tasks

    answers = spark.createDataFrame([(1, [7, 8], 5), (2, [9], 5), (3, [], 6)], "answer long, item_ids array<long>, product_id long")
    items = spark.createDataFrame([(7, a) for a in (1, 2)] + [(8, 2)] + [(9, a) for a in range(50)], "item_id long, asset_id long")
    products = spark.createDataFrame([(5, a) for a in (2, 1, 1, 4, 9, 8)] + [(6, None), (6, 3)], "product_id long, asset_id long").where("asset_id is not null")
    got = tasks.answer_assets(answers, items, products, 3)
    assert sorted((r.answer, r.rank, r.asset_id, r.source) for r in got.collect()) == [(1, 1, 1, 0), (1, 2, 2, 0), (1, 3, 4, 1), (2, 1, 0, 0), (2, 2, 1, 0), (2, 3, 2, 0), (3, 1, 3, 1)]
    assert _plan(got).count("row_number()") > 2


def test_brand_recommendations_meet_only_the_cheapest(spark, tmp_path):
    """Each asking product meets a few rows of its brand, not all; repeated keys and prices that are null count as in the SQL."""
    import duckdb

    from tidemill.plans import commerce

    rows = [(i, f"b{i % 3}", None if i % 7 == 0 else float(i * 37 % 50)) for i in range(400)] + [(100, "b1", 1.0), (100, "b1", 2.0), (200, "b2", 0.5), (7, None, 1.0), (300, None, 1.0)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    got = commerce.recommend_same_brand(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(commerce.ORACLES["recommend_same_brand"]).fetchall())
    assert "p_brand" in _plan(got) and _plan(got).count("row_number()") > 2


def test_contradictions_count_edits_in_bytes(spark, tmp_path):
    """Two characters of two bytes each are four edits, as in the SQL."""
    import duckdb

    from tidemill.plans import items

    rows = [(0, "Èè 1 x"), (5, "In 2 x"), (10, "Èê 3 x"), (15, "Èé 4"), (20, "I 5"), (25, "É 6"), (30, None), (35, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = items.contradictions(spark, str(tmp_path)).select("product_id", "a", "b").collect()
    want = con.execute(f"select product_id, a, b from ({items.ORACLES['contradictions']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and (0, 0, 5) not in want and len(want) > 3


def test_route_gate_multiplies_blocks(spark, tmp_path):
    """By matrices; vectors that are null, and a query alone, are routed as in the SQL."""
    import duckdb
    import random

    from tidemill.plans import retrieval

    rng = random.Random(2)
    vec = lambda: [rng.gauss(0, 1) / 1.8 for _ in range(4)]
    for n, rows in enumerate([[(i, vec(), 0) for i in range(300)] + [(310, None, 0)], [(10, [1.0], 0)]]):
        spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/{n}/embeddings.parquet")
        con = duckdb.connect()
        con.execute(f"create view embeddings as select * from '{tmp_path}/{n}/embeddings.parquet/*.parquet'")
        got = retrieval.route_gate(spark, f"{tmp_path}/{n}")
        assert sorted(map(tuple, got.collect())) == sorted(con.execute(retrieval.ORACLES["route_gate"]).fetchall())
        assert "zip_with" not in _plan(got)


def test_category_losses_read_all_that_sold_since(spark, tmp_path):
    """Lost is what never sold since 1996, whenever that was."""
    import datetime

    from tidemill.plans import items

    day = lambda y: datetime.datetime(y, 5, 1)
    spark.createDataFrame([(1, "A", 1), (2, "B", 2), (3, "C", 3)], "p_partkey long, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1, day(1994)), (1, day(1997)), (2, day(1995)), (3, day(1999))], "l_partkey long, l_shipdate timestamp_ntz").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [r.category_id for r in items.category_losses(spark, str(tmp_path)).collect()] == ["B:2"]


def test_shingles_of_long_texts(spark):
    """A text is stripped once, not at every place of it (F1, F9, F11); runs over the ends of pieces are found."""
    from tidemill.functions.textops import shingles

    long = " ".join(str(i * i) + "é" for i in range(20000))
    rows = [(0, long), (1, None), (2, ""), (3, "a b"), (4, "ab cd"), (5, "x" * 600)]
    got = {r.id: r.s for r in spark.createDataFrame(rows, "id long, t string").select("id", shingles(F.col("t")).alias("s")).collect()}
    bare = long.replace(" ", "")
    assert sorted(got[0]) == sorted({bare[i : i + 4] for i in range(len(bare) - 3)})
    assert [got[i] for i in range(1, 6)] == [[], [], ["ab"], ["abcd"], ["xxxx"]]


def _near_copies():
    """Sixty near copies and four short rows, and all pairs of 0.5 or more."""
    rng = random.Random(8)
    rows = [(i, [f"w{k}" for k in range(40) if rng.random() > 0.1] + [f"own{i}"]) for i in range(60)] + [(70, ["a", "b", "c"]), (71, ["a", "b", "c", "d"]), (72, ["a", "b", "c"]), (73, [])]
    sets = {i: set(t) for i, t in rows}
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and sets[a] and 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}
    return rows, want


@pytest.mark.parametrize("block", [None, 400])
def test_pairs_of_near_copies_are_made_where_they_are_scored(spark, monkeypatch, block):
    """A group of near copies meets by a few links, its sets go to one task, or to blocks, and no pair takes terms along (F1, F2)."""
    rows, want = _near_copies()
    if block:
        monkeypatch.setattr(greedy, "BLOCK", block)
    met = []
    cut = greedy.cut
    monkeypatch.setattr(greedy, "cut", lambda r: met.append(cut(r)) or met[-1])
    found = greedy.similar_pairs(spark.createDataFrame(rows, "id long, t array<string>"), "id", F.col("t"), 0.5)
    got = [(r.a, r.b, r.score) for r in found.collect()]
    assert sorted(got) == sorted((a, b, s) for (a, b), s in want.items()) and len(got) > 1500
    assert sum(m.count() for m in met if m.columns == ["a", "b"]) <= 4 * len(rows)
    assert "array_intersect" not in _plan(found)


@pytest.mark.parametrize("block", [None, 400])
def test_groups_are_decided_without_their_pairs(spark, monkeypatch, block):
    """What stays, and what leads, is found in the task that holds a group; only a group in blocks hands on pairs."""
    rows, pairs = _near_copies()
    lead = {}
    for i, _ in rows:
        lead[i] = min((a for a in lead if lead[a] == a and (a, i) in pairs), default=i)
    if block:
        monkeypatch.setattr(greedy, "BLOCK", block)
    met = []
    cut = greedy.cut
    monkeypatch.setattr(greedy, "cut", lambda r: met.append(cut(r)) or met[-1])
    asked = spark.createDataFrame(rows, "id long, t array<string>")
    assert {r.id: r.lead for r in greedy.clusters(asked, "id", F.col("t"), 0.5).collect()} == lead
    assert sorted(r.id for r in greedy.without_similar(asked, "id", F.col("t"), 0.5).collect()) == sorted(i for i in lead if lead[i] == i)
    if not block:
        assert sum(m.count() for m in met if m.columns[:2] == ["a", "b"]) <= 8 * len(rows)
