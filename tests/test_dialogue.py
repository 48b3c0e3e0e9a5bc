from pyspark.sql import functions as F

from tidemill.functions import rules, textops
from tidemill.operators import dialogue as ops


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def test_masks_in_order(spark):
    text = "证件11010119900307123X，卡6222021234567890123，手机13812345678，邮箱 a.b@c.com，座机010-12345678，北京市朝阳区建国路88号"
    got = one(spark, text, rules.masked)
    assert got["text"] == "证件<ID_CARD>，卡<BANK_CARD>，手机<PHONE>，邮箱 <EMAIL>，座机<TELEPHONE>，<ADDRESS>"
    assert {h["rule"]: h["n"] for h in got["hits"]} == {"id_card": 1, "bank_card": 1, "phone": 1, "email": 1, "telephone": 1, "address": 1}
    assert one(spark, "手机13812345678", rules.contains_pii) and not one(spark, "你好", rules.contains_pii)


def test_parameters_spare_durations(spark):
    got = one(spark, "48小时内发货，￥99，3月1日，14:30，单号123456789，SF1234567890123", rules.parameterized)
    assert got["text"] == "48小时内发货，<AMOUNT>，<DATE>，<TIME>，单号<ORDER_NO>，<TRACKING_NO>"
    assert got["hits"] == {"amount": 1, "date": 1, "time": 1, "order_no": 1, "tracking_no": 1}


def test_pleasantries_and_system_phrases(spark):
    for t in ("在的亲～", "好的谢谢", "嗯嗯好的", "OK"):
        assert one(spark, t, rules.is_pleasantry), t
    assert not one(spark, "好的，这件多少钱", rules.is_pleasantry)
    assert one(spark, "正在为您转接人工客服", rules.is_system_phrase)


def sessions(spark, rows):
    return ops.sessions(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))


def test_gate1_first_rule_wins(spark):
    chat = "这件衣服是什么面料做的呢"
    rows = [(1, 0, "user", chat), (1, 1, "assistant", "纯棉的，请放心购买")]
    rows += [(2, 0, "user", chat)]
    rows += [(3, 0, "user", "在"), (3, 1, "assistant", "在")]
    rows += [(4, 0, "user", "what is this made of"), (4, 1, "assistant", "cotton, I believe")]
    rows += [(5, 0, "user", chat), (5, 1, "assistant", "加微信详细聊一聊吧亲爱的")]
    rows += [(6, 0, "user", chat), (6, 1, "assistant", "比淘宝便宜很多很多的呢")]
    got = {r.conv_id: r.drop_reason for r in ops.gate1(sessions(spark, rows)).collect()}
    assert got == {1: None, 2: "too_few_turns", 3: "too_short", 4: "wrong_language", 5: "contact", 6: "flagged_word"}


def test_gate2_rebuilds_sessions(spark):
    rows = [(1, 0, "system", "x"), (1, 1, "user", "多少钱"), (1, 2, "assistant", "好的"), (1, 3, "assistant", "99元")]
    rows += [(2, 0, "user", "多少钱"), (2, 1, "user", "人呢在哪里")]
    got = ops.gate2(sessions(spark, rows)).collect()
    assert [(r.conv_id, [(t["turn_index"], t["role"], t["content"]) for t in r.turns]) for r in got] == [(1, [(0, "user", "多少钱"), (1, "agent", "<AMOUNT>")])]


def test_fix_roles_sees_fixed_roles(spark):
    s = sessions(spark, [(1, 0, "user", "有货吗"), (1, 1, "user", "亲，有的"), (1, 2, "user", "亲，还有红色"), (1, 3, "user", "好")])
    got = s.select(ops.fix_roles(F.col("turns")).alias("t")).first()["t"]
    assert [t["role"] for t in got] == ["user", "agent", "user", "user"]


def test_append_new_keeps_one_of_each(spark):
    s = sessions(spark, [(i, j, "user", f"t{i % 2}{j}") for i in range(4) for j in range(2)])
    stored = s.where("conv_id = 1").select(textops.content_hash(F.col("turns")).alias("payload_hash"))
    assert [r.conv_id for r in ops.append_new(s, stored).collect()] == [0]
    assert ops.append_new(s.limit(0), stored).count() == 0


def test_shingles_and_tokens(spark):
    assert one(spark, "ab cd　e", textops.shingles) == ["abcd", "bcde"]
    assert one(spark, "ab", textops.shingles) == ["ab"] and one(spark, "", textops.shingles) == []
    assert one(spark, "Size XL <AMOUNT_X> 纯棉面料", lambda c: textops.tokenize(c, "ref")) == ["sizexl", "<amount_x>", "纯棉", "棉面", "面料"]


def test_guards(spark):
    assert one(spark, "", rules.guard_input) == "empty" and one(spark, "我想自杀", rules.guard_input) == "self_harm"
    assert one(spark, "转人工", rules.guard_input) == "handover" and one(spark, "多少钱", rules.guard_input) is None
    out = one(spark, "保证明天到 https://evil.example/x", rules.guard_output)
    assert out["text"].startswith("通常明天到") and "evil" not in out["text"] and out["rewritten"] and not out["blocked"]
    assert one(spark, "全网第一", rules.guard_output)["blocked"]
