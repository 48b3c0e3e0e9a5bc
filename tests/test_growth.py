"""Steps whose work must grow no faster than their input: same rows as the plain way, few rows on the way."""

import random

from pyspark.sql import functions as F

from tidemill.functions.textops import char_grams, text_pieces
from tidemill.operators import commerce, items, lineage, nearness, retrieval, sketches
from tidemill.plans import texts
from tidemill.streaming import sinks


def test_ladder_counts_as_rows_found(spark):
    rows = spark.range(300).select(F.col("id").alias("key"), F.when(F.col("id") % 11 > 0, F.col("id") % 3).alias("brand"), (F.col("id") % 4).alias("size"), F.when(F.col("id") % 7 > 0, F.col("id")).alias("price"))
    needs = spark.range(40).union(spark.range(3)).select(F.col("id").alias("need_id"), (F.col("id") % 5).alias("b"), (F.col("id") % 6).alias("z"))
    brand, size = {"brand": "b"}, {"size": "z"}
    got = commerce.relaxed_counts(rows, needs, [(F.col("price") < 20, brand | size), (None, brand | size), (None, size)], "key")
    same, fits = F.col("brand") == F.col("b"), F.col("size") == F.col("z")
    plain = commerce.relaxed(rows, needs, [same & fits & (F.col("price") < 20), same & fits, fits], fits).groupBy("need_id", "level").agg(F.count("*").alias("n"), F.min("key").alias("k"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


def test_ladder_does_not_pair_all_needs_with_all_rows(spark):
    rows = spark.range(200_000).select(F.col("id").alias("key"), F.lit(1).alias("size"))
    needs = spark.range(200_000).select(F.col("id").alias("need_id"), F.lit(1).alias("z"))  # 4e10 pairs
    got = commerce.relaxed_counts(rows, needs, [(None, {"size": "z"})], "key").agg(F.count("*"), F.min("products"), F.max("products")).first()
    assert tuple(got) == (200_000, 200_000, 200_000)


def test_best_by_words_as_by_all_pairs(spark):
    texts = ["a b b c", "a a", None, "c d e", "", "b c zz", "a b c d e", "b b b a"] * 5
    rows = [(i % 37 if i != 9 else None, t) for i, t in enumerate(texts)]  # some ids twice, with texts of equal and other lengths, one null
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1), (2, "nowhere", 1), (3, "e", 3), (4, "nothing", 1)], "query long, term string, qtf long")
    posts = retrieval.postings(docs, "doc_id", F.col("text"))
    plain = retrieval.top_k(retrieval.bm25(asked, posts, retrieval.term_stats(posts), retrieval.stats_of(posts, docs)), 4, 6)
    packed = retrieval.Packed.of(docs, "doc_id", F.col("text"), asked)
    df = packed.term_stats()
    for block in (1, 4096):
        got = retrieval.bm25_top(asked, packed, df, 4, 6, block=block)
        assert sorted(map(repr, got.select("query", "doc", "score", "rank").collect())) == sorted(map(repr, plain.select("query", "doc", "score", "rank").collect()))
    hits = plain.select("query", "doc").where("doc is not null")
    whole = retrieval.lexical_coverage(asked, hits, posts, retrieval.term_stats(posts), retrieval.stats_of(posts, docs))
    part = retrieval.lexical_coverage(asked, hits, packed.posts(hits), df, packed.corpus)
    near = lambda x: sorted((r.query, r.doc, round(r.coverage, 9)) for r in x.collect())
    assert near(part) == near(whole)


def test_best_by_words_hands_on_k_rows_a_task(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("the same words").alias("text"))
    asked = spark.range(50).select(F.col("id").alias("query"), F.lit("the").alias("term"), F.lit(1).cast("long").alias("qtf"))
    packed = retrieval.Packed.of(docs, "doc_id", F.col("text"), asked)
    state = []
    top = retrieval.top_k
    retrieval.top_k = lambda scored, k, digits=9: state.append(scored) or top(scored, k, digits)
    try:
        got = retrieval.bm25_top(asked, packed, packed.term_stats(), 5)
    finally:
        retrieval.top_k = top
    assert state[0].count() <= 50 * 5 * packed.rows.rdd.getNumPartitions()  # not a row for each query and doc
    assert {(r.doc, r["rank"]) for r in got.collect()} == {(i, i + 1) for i in range(5)}


def test_signatures_of_texts_as_of_their_grams(spark):
    texts = ["abcdefgh", "abc", "", None, "aaaaaaaaaaaa", "".join(chr(0x4E00 + i * 7 % 3000) for i in range(4000)), "x😀yz" * 50, "abcdef", "hello there" * 200]
    rows = [(i % 8 if i != 1 else None, t) for i, t in enumerate(texts)] + [(20, "ab")]
    docs = spark.createDataFrame(rows, "id long, text string")
    pieces = docs.select("id", F.explode(text_pieces(F.coalesce("text", F.lit("")), 6, 100)).alias("piece"))
    plain = sketches.signatures(pieces.select("id", F.explode(char_grams(F.col("piece"), 6)).alias("gram")))
    got = sketches.text_signatures(pieces, 6)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


def test_products_of_one_name_go_on_as_two(spark):
    p = spark.range(1000).select(F.lit(1).alias("live"), (1000 - F.col("id")).alias("product_id"), F.lit("soft thing").alias("mention"))
    assert sorted(r.product_id for r in nearness._least_two(p).collect()) == [1, 2]


def test_a_round_of_tasks_meets_outcomes_in_bounded_parts(spark):
    tasks = spark.range(450_000).select("id", F.lit("same").alias("payload"), F.lit(0).alias("retry_count"))
    done, again, dead, follow = sinks.handled(tasks, lambda x: x.where("id % 2 = 0").select("id", F.lit("done").alias("outcome"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("follow_up")))
    assert done.rdd.getNumPartitions() >= 5 and again.rdd.getNumPartitions() >= 5  # small in bytes, many in rows
    assert (done.count(), again.count(), dead.count(), follow.count()) == (225_000, 225_000, 0, 0)


def test_tops_as_by_walking_and_in_few_rounds(spark, monkeypatch):
    rnd = random.Random(4)
    ids = rnd.sample(range(10_000), 360)
    up = {i: rnd.choice([None, *ids[:200], -1]) for i in ids[:200]}  # trees, circles and what hangs on them
    up |= {a: b for a, b in zip(ids[200:280], [*ids[201:280], None])}  # a chain of 80
    up |= {a: b for a, b in zip(ids[280:], [*ids[281:], ids[280]])}  # a circle of 80

    def walk(i):
        path = [i]
        while up[path[-1]] in up and up[path[-1]] != path[-1]:
            path.append(up[path[-1]])
            if path[-1] in path[:-1]:
                return i, None, None, min(path[path.index(path[-1]) :])
        return i, path[-1], len(path) - 1, path[-1]

    written = []
    keep = lineage.cut
    monkeypatch.setattr(lineage, "cut", lambda rows: written.append(keep(rows)) or written[-1])
    got = lineage.tops(spark.createDataFrame(list(up.items()), "id long, parent long"))
    assert sorted(map(tuple, got.select("id", "top", "depth", "least").collect())) == sorted(map(walk, ids))
    assert len(written) <= 10  # rounds of log2(80), not of all that is left in circles


def test_words_are_not_sorted_to_find_their_first_places(spark, capsys):
    big = 2**63 - 1
    rows = [(5, "ab cd ab", ["zz"]), (-3, "cd xy", None), (5, "zz ab", None), (None, "null xy", None), (big, "far xyz", None), (-big - 1, "low", ["low"]), (big, "xyz", None), (-7, "q low2", ["xyz2"])]
    p = spark.createDataFrame(rows, "product_id long, name string, aliases array<string>").withColumn("attrs", F.create_map(F.lit("k"), F.concat("name", F.lit("、end"))))
    got = items.hotwords(p, " ")
    plain = items.hotwords(p.withColumn("product_id", F.col("product_id").cast("decimal(20,0)")), " ")
    assert got.schema["product_id"].dataType.simpleString() == "bigint" and got.schema["pos"].dataType.simpleString() == "int"
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((r.word, None if r.product_id is None else int(r.product_id), r.pos)) for r in plain.collect())
    got.explain()
    assert "SortAggregate" not in capsys.readouterr().out


def test_numbers_are_read_once_and_texts_do_not_meet(spark, tmp_path, capsys):
    rows = [(1, "10 and 9.5, 9, 007, 0.5, 三天 第三天 十二件 000 99999999999999999999 9.50"), (2, "9 三 12天"), (3, None), (4, "no number"), (5, "7 7"), (8, "8")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = texts.unsourced_numbers(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [(1, ".5,0,3,7,9.5,9.50,10,99999999999999999999"), (2, "9,12")]
    got.explain()
    assert "regexp_extract_all" not in capsys.readouterr().out  # a number is found before rows meet, not once a side
