import json

import pytest
from pyspark.sql import functions as F

from tidemill.functions import claims
from tidemill.operators import funnel, recipes


def client():
    """Made here, so that the workers get it by value."""

    def answer(texts):
        out = []
        for t in texts:
            if "面料" not in t:
                out.append(None)
                continue
            hedge = "可能" if "大概" in t else ""
            items = [{"question": "什么面料", "answer": hedge + "纯棉面料", "confidence": 0.95}, {"question": "", "answer": "x", "confidence": 1}]
            found = {"has_knowledge": True, "generalizable": 0.9, "outdated": False, "quality": 0.2 if "差" in t else 0.9, "confidence": 0.95, "items": items}
            out.append("说明 " + json.dumps(found, ensure_ascii=False))
        return out

    return answer


def test_every_session_has_one_outcome(spark):
    q, a = "这件衣服是什么面料做的呢", "这是纯棉面料的，请放心购买吧"
    rows = [(1, 0, "user", q), (1, 1, "assistant", a), (2, 0, "user", q), (3, 0, "user", "这个多少钱一件能便宜吗"), (3, 1, "assistant", "不好意思我们不讲价的呢亲爱的")]
    rows += [(4, 0, "user", q), (4, 1, "user", "有没有人回答我的问题呢"), (5, 0, "user", q + "差"), (5, 1, "assistant", a), (6, 0, "user", q + "大概"), (6, 1, "assistant", a)]
    items, outcomes = funnel.run(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), client())
    got = {r.conv_id: (r.gate, r.reason) for r in outcomes.collect()}
    assert outcomes.count() == 6
    assert got == {1: ("gate3", "extracted"), 2: ("gate1", "too_few_turns"), 3: ("gate3", "no_knowledge"), 4: ("gate2", "no_pair"), 5: ("gate3", "low_quality"), 6: ("gate3", "extracted")}
    (item,) = items.collect()
    assert item.title == "什么面料" and item.merged == 2 and item.content == "纯棉面料" and item.review_status in ("approved", "pending")


def test_near_sessions_conflicts_and_demand(spark):
    q, a = "这件衣服是什么面料做的呢", "这是纯棉面料的，请放心购买吧，洗了以后不会缩水也不会掉色，可以机洗"
    rows = [(i, t, r, x) for i, end in ((1, ""), (2, ""), (3, "哦")) for t, r, x in ((0, "user", q), (1, "assistant", a + end))]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    products = spark.createDataFrame([(1, [7])], "conv_id long, product_ids array<long>")
    attrs = spark.createDataFrame([(7, 0, "面料", "羊毛")], "product_id long, pos long, key string, value string")
    demand = spark.createDataFrame([("什么面料", 30), ("什么面料 ", 30)], "title string, asked long")
    for extra, want in (({"products": products, "attrs": attrs, "demand": demand}, ("P1", "conflict")), ({"demand": demand}, ("P1", "hot"))):
        items, outcomes = funnel.run(turns, client(), **extra)
        assert {r.conv_id: (r.gate, r.reason) for r in outcomes.collect()} == {1: ("gate3", "extracted"), 2: ("gate1", "near_duplicate"), 3: ("gate1", "near_duplicate")}
        (item,) = items.collect()
        assert (item.priority, item.reason, item.review_status) == (*want, "pending")


def test_a_failing_model_stops_the_run(spark):
    def down(_):
        raise ConnectionError

    q = "这件衣服是什么面料做的呢"
    rows = spark.createDataFrame([(1, 0, "user", q), (1, 1, "assistant", q)], "conv_id long, turn long, role string, text string")
    with pytest.raises(RuntimeError, match="1 of 1"):
        funnel.run(rows, down)


def test_claims(spark):
    def one(text, column):
        return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]

    assert one("最近上新，很多人最担心起球，全网最好", claims.suspects) == ["最担"]
    assert one("十二天内发货，重2.5kg，两件八折，二十元，第三天，一次性", claims.numbers) == ["2.5", "12", "2", "8", "20"]
    assert one("想要一件，十一件，一般", lambda c: claims.numbers(c, True)) == ["11"] and one("一件007", claims.numbers) == ["7", "1"]
    ground = lambda c: claims.grounded(c, F.lit("三天到货"), F.lit("身高160"))
    assert one("3天到，160穿M", ground)["ok"] and one("保证3天到", ground)["flags"] == ["rewritten"] and one("七天无理由", ground)["unsourced"] == ["7"] and one(" ", ground)["flags"] == ["empty"]
    got = one("顶级面料，3天到货，治疗失眠", lambda c: claims.check_copy(c, F.lit("三天到货")))
    assert got.blocked == ["顶级", "治疗"] and got.unsourced == [] and not got.passed
    assert one("精选羊毛与棉", lambda c: claims.attribute_conflicts(c, F.create_map(F.lit("材质"), F.lit("棉 95%")), ["羊毛", "棉"])) == ["羊毛"]


def test_recipes(spark):
    rows = spark.createDataFrame([("see https://x.y now please",), ("short",), ("!!!???***&&&%%%",), ("call 13812345678 today",), ("call 13812345678 today",)], "text string")
    recipe = [{"text_length": {"least": 8}}, {"special_ratio": {"most": 0.4}}, {"remove_links": {"by": "<URL>"}}, {"mask_pii": None}, {"exact_dedup": {}}]
    assert sorted(r.text for r in recipes.apply(rows, recipe).collect()) == ["call <PHONE> today", "see <URL> now please"]
    assert recipes.problems([{"text_lenght": {}}, {"text_length": {"min": 1}}, {"flagged_ratio": {}}]) == ["step 0: no text_lenght, did you mean text_length?", "step 1: text_length has no min", "step 2: flagged_ratio needs words"]
    with pytest.raises(ValueError):
        recipes.apply(rows, [{"nothing": {}}])


def test_two_models_in_a_cascade(spark):
    """The dear model sees what the cheap one lets through; failures are no outcomes, and ten in a row end the asking."""

    def triage(text):
        n = int(text.split("#")[1])
        if n % 10 == 3:
            raise TimeoutError
        if n % 10 == 4:
            return None
        return json.dumps({"has_knowledge": n % 10 != 5, "generalizable": 0.9, "outdated": n % 10 == 6, "quality": 0.8, "confidence": 0.9})

    def extract(text):
        n = int(text.split("#")[1])
        if n % 10 in (4, 5, 6):
            raise ValueError("asked for what was dropped")
        if n % 10 == 7:
            raise ConnectionError
        items = [] if n % 10 == 8 else [{"question": f"q{n}", "answer": "a", "confidence": 0.9}]
        return "```json\n" + json.dumps({"items": items}) + "\n```"

    asked = spark.createDataFrame([(i, f"text #{i}") for i in range(40)], "conv_id long, transcript string")
    got = {r.conv_id: (r.status, r.stage, r.failure, r.reason, len(r["items"])) for r in funnel.cascade(asked, triage, extract).collect()}
    want = {3: ("infra", "triage", "TimeoutError", None, 0), 4: ("drop", "triage", None, "no_knowledge", 0), 5: ("ok", "triage", None, "no_knowledge", 0), 6: ("ok", "triage", None, "outdated", 0), 7: ("infra", "extract", "ConnectionError", None, 0), 8: ("ok", "extract", None, "nothing_extracted", 0)}
    assert got == {i: want.get(i % 10, ("ok", "extract", None, None, 1)) for i in range(40)}

    def gone(text):
        if text.endswith("0"):
            return None
        raise ConnectionError

    one = asked.coalesce(1).sortWithinPartitions("conv_id")
    seen = [(r.conv_id, r.failure) for r in funnel.ask_each(one, gone, "transcript", 12).orderBy("conv_id").collect()]
    assert [f for i, f in seen if i % 10 == 0] == [None] * 4 and all(f == "ConnectionError" for i, f in seen if i % 10)
    seen = [r.failure for r in funnel.ask_each(one, gone, "transcript", 5).orderBy("conv_id").collect()]
    assert seen == [None] + ["ConnectionError"] * 5 + ["not_asked"] * 34


def test_a_run_with_two_models(spark):
    q, a = "这件衣服是什么面料做的呢", "这是纯棉面料的，请放心购买吧"
    rows = [(i, t, r, x) for i in range(6) for t, r, x in ((0, "user", q + "零一二三四五六七八九"[i] * 9), (1, "assistant", a + "甲乙丙丁戊己庚辛"[i] * 9))]

    def triage(text):
        if "二" in text:
            raise TimeoutError
        return json.dumps({"has_knowledge": "一" not in text, "generalizable": 0.9, "outdated": False, "quality": 0.9, "confidence": 0.95})

    def extract(text):
        return json.dumps({"items": [{"question": "什么面料" + ("吗" if "三" in text else ""), "answer": "纯棉面料", "confidence": 0.95}]})

    items, outcomes = funnel.run(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), triage, extract=extract)
    assert {r.conv_id: (r.gate, r.reason) for r in outcomes.collect()} == {0: ("gate3", "extracted"), 1: ("gate3", "no_knowledge"), 3: ("gate3", "extracted"), 4: ("gate3", "extracted"), 5: ("gate3", "extracted")}
    assert sorted((r.title, r.merged) for r in items.collect()) == [("什么面料", 3), ("什么面料吗", 1)]
