"""Text rules as Column expressions: masking, parameters, phrases, guards.

The word lists and patterns below are fixed values; patterns are Java regexes.
Each list is a default that callers may replace, so that other languages can
bring their own profile.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Personal data, in order of precedence; a rule sees the text its predecessors rewrote.
PII_RULES = [
    ("id_card", r"(?<!\d)\d{17}[\dXx](?!\d)", "<ID_CARD>"),
    ("bank_card", r"(?<!\d)\d{16,19}(?!\d)", "<BANK_CARD>"),
    ("phone", r"(?<!\d)1[3-9]\d{9}(?!\d)", "<PHONE>"),
    ("telephone", r"(?<!\d)0\d{2,3}-?\d{7,8}(?!\d)", "<TELEPHONE>"),
    ("email", r"(?U)[\w.+-]+@[\w-]+\.[\w.-]+", "<EMAIL>"),
    ("address", r"(?:[一-龥]{2,8}(?:省|自治区))?[一-龥]{2,10}(?:市|自治州)[一-龥]{2,10}(?:区|县|市|旗)[一-龥\d]{0,30}?(?:路|街|道|号|栋|室|区|巷|弄)[\d\-号栋室]*", "<ADDRESS>"),
    ("order_no", r"(?<!\d)\d{12,24}(?!\d)", "<ORDER_NO>"),
]
# Concrete amounts, dates and numbers, and durations, which stay.
PARAM_RULES = [
    ("amount", r"(?:￥|¥|\$)\s?\d+(?:\.\d{1,2})?|\d+(?:\.\d{1,2})?\s?(?:元|块钱|块)", "<AMOUNT>"),
    ("date", r"\d{4}[-/年]\d{1,2}[-/月]\d{1,2}日?|\d{1,2}月\d{1,2}[日号]", "<DATE>"),
    ("time", r"\d{1,2}[:：]\d{2}", "<TIME>"),
    ("order_no", r"(?<![\d<])\d{6,11}(?![\d>])", "<ORDER_NO>"),
    ("tracking_no", r"\b[A-Z]{2}\d{10,15}\b", "<TRACKING_NO>"),
]
DURATION = r"\d+\s?(?:小时|天|个工作日|分钟|周|个月)"
# Phrases of the service system.
SYSTEM_PHRASES = [
    r"正在(为您)?转接(人工)?(客服)?",
    r"客服(小妹|小哥|专员)?正在忙",
    r"^(您好|你好)[,，]?(很高兴为您服务|请问有什么(可以)?帮(您|你))",
    r"感谢您的(咨询|耐心等待)[,，]?(祝您|欢迎)",
    r"本次服务已结束",
    r"^亲[,，]?还在吗",
    r"请对本次服务(进行)?评价",
]
# A turn made only of these words and fillers says nothing.
PLEASANTRY_WORDS = r"在吗|在不在|在的|在|你好|您好|哈喽|hi|hello|嗯+|哦+|噢+|好的|好|行|OK|ok|谢谢|感谢|多谢|辛苦了?|麻烦了?|收到|明白|知道了|亲|亲亲|稍等|等等"
PLEASANTRY_FILLERS = r"\s~～。.!！?？,，、:：呢吧啊呀哦嗯的了啦哈"
# Links and private contacts, control characters, rivals and forbidden goods.
CONTACT = r"(https?://|www\.|微信号?[:：]?\s*[\w-]{6,}|加\s*(微信|VX|vx|威信))"
GARBLED = "[�\\x00-\\x08\\x0b-\\x0c\\x0e-\\x1f]{2,}"
FLAGGED_WORDS = ["淘宝", "拼多多", "京东自营", "闲鱼", "代购", "高仿", "A货", "原单"]
# Input guard, in order of precedence.
SELF_HARM = r"自杀|自残|轻生|不想活|活不下去|结束生命|了结自己|活着好累"
HANDOVER_REQUEST = r"(?:转|找|要|叫|接)?\s*(?:人工|真人|客服小姐姐|客服mm)|人呢|有人吗(?:\?|？)?$|不要机器人|别机器人"
INJECTION = r"(?i)(?:忽略|无视|forget|ignore)\s*(?:上面|之前|previous|above|all)?\s*(?:的)?\s*(?:所有)?\s*(?:指令|规则|设定|instruction|prompt|rule)|你现在是|扮演一个|重复(?:你的)?(?:系统)?(?:提示|prompt)|system\s*prompt|jailbreak|开发者模式|developer\s*mode"
OFF_LIMITS = r"政治|颠覆|反动|涉黄|赌博|毒品|枪支|炸药"
# Words an answer may not use, and milder forms of promises.
ABSOLUTE_WORDS = ["最好", "最佳", "最优", "最强", "最便宜", "最低价", "第一品牌", "全网第一", "顶级", "极致", "唯一", "独家首创", "百分百", "100%满意", "绝对", "永久", "万能", "国家级", "世界级"]
MEDICAL_WORDS = ["治疗", "根治", "疗效", "药用", "抗癌", "杀菌率"]
# Complaints.
NEGATIVE = r"(?:什么破|垃圾|骗人|太差|气死|无语|答非所问|你听不懂|说了多少遍|再说一遍)|(?:没|不)(?:用|行|对)(?:啊|吧|呀)?$|投诉你"
# Answers that defer.
DEFERRALS = ["不太确定", "不确定", "无法确认", "没法确认", "不清楚", "建议您咨询", "建议你咨询", "建议您联系", "建议你联系", "咨询人工", "联系人工", "转接人工", "转人工", "帮不了", "无法回答", "回答不了", "我不知道"]
# Hosts whose links may stay; a shop adds its own.
HOSTS = ["taobao.com", "tmall.com"]
# Promises and their milder forms.
PROMISE_REWRITES = [("保证", "通常"), ("一定能", "一般能"), ("肯定能", "一般能"), ("必然", "通常"), ("绝不会", "一般不会")]
# Words of doubt.
UNCERTAIN_WORDS = ["可能", "大概", "应该是", "估计", "不太清楚", "我确认一下"]


def _step(name: str, pattern: str, placeholder: str):
    def step(s):
        n = F.regexp_count(s["text"], F.lit(pattern)).cast("long")
        return F.struct(F.regexp_replace(s["text"], pattern, placeholder).alias("text"), F.concat(s["hits"], F.array(F.struct(F.lit(name).alias("rule"), n.alias("n")))).alias("hits"))

    return step


def masked(text: Column, rules=None) -> Column:
    """struct(text, hits): the text with every rule applied in turn, and hits by rule above 0; a null text stays null.

    Each rule is a step over an array of one, so that no rule's text is computed
    anew for the rules after it.
    """
    state = F.array(F.struct(text.alias("text"), F.array().cast("array<struct<rule string, n bigint>>").alias("hits")))
    for rule in rules or PII_RULES:
        state = F.transform(state, _step(*rule))
    done = F.transform(state, lambda s: F.struct(s["text"].alias("text"), F.filter(s["hits"], lambda x: x["n"] > 0).alias("hits")))
    return done[0]


def contains_pii(text: Column, rules=None) -> Column:
    """Does any rule match?"""
    found = F.lit(False)
    for _, pattern, _ in rules or PII_RULES:
        found = found | text.rlike(pattern)
    return found


def parameterized(text: Column, rules=None, duration: str = DURATION) -> Column:
    """struct(text, hits): parameters replaced, apart from durations."""
    between = F.split(text, duration, -1)
    kept = F.regexp_extract_all(text, F.lit(f"({duration})"), F.lit(1))
    done = F.transform(between, lambda part: masked(part, rules or PARAM_RULES))
    hits = F.aggregate(done, F.expr("map_from_arrays(cast(array() as array<string>), cast(array() as array<bigint>))"), lambda acc, x: F.map_zip_with(acc, F.map_from_entries(x["hits"]), lambda k, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))))
    joined = F.array_join(F.flatten(F.zip_with(F.transform(done, lambda x: x["text"]), kept, lambda a, b: F.array(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))), "")
    return F.struct(joined.alias("text"), hits.alias("hits"))


def is_system_phrase(text: Column, patterns=None) -> Column:
    """A phrase of the service system, not of its staff."""
    found = F.lit(False)
    for p in patterns or SYSTEM_PHRASES:
        found = found | text.rlike(p)
    return found


def is_pleasantry(text: Column, words: str = PLEASANTRY_WORDS, fillers: str = PLEASANTRY_FILLERS) -> Column:
    """Nothing but pleasantries and fillers."""
    return F.trim(text).rlike(rf"(?i)^[{fillers}]*(?:(?:{words})[{fillers}]*)+$")


def has_any(text: Column, words: list[str]) -> Column:
    """Does the text hold one of the words?"""
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def found_words(text: Column, words: list[str]) -> Column:
    """The words that the text holds, in the list's order."""
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def stripped(text: Column) -> Column:
    """The text without white space of any kind at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def guard_input(text: Column, longest: int = 1000) -> Column:
    """The first rule that stops a question, or null; white space around it is no part of it, a null one is empty."""
    text = stripped(F.coalesce(text, F.lit("")))
    return (
        F.when(F.length(text) == 0, "empty")
        .when(F.length(text) > longest, "too_long")
        .when(text.rlike(SELF_HARM), "self_harm")
        .when(text.rlike(HANDOVER_REQUEST), "handover")
        .when(text.rlike(INJECTION), "injection")
        .when(text.rlike(OFF_LIMITS), "off_limits")
    )


def is_negative(text: Column, pattern: str = NEGATIVE) -> Column:
    """A question that passes the guard and complains; runs of these lead to a handover."""
    return guard_input(text).isNull() & stripped(text).rlike(pattern)


def guard_output(text: Column, longest: int = 200, allowed_hosts=tuple(HOSTS)) -> Column:
    """struct(text, blocked, rewritten, too_long, deferred, medical, absolute, uncited) of an answer.

    Medical and absolute words stop it, as does an empty one; promises are made
    milder and links of other hosts lose them; deferred: the answer says that it
    cannot answer; uncited: digits without a reference mark.
    """
    old = F.coalesce(text, F.lit(""))
    new = old
    for word, mild in PROMISE_REWRITES:
        new = F.replace(new, F.lit(word), F.lit(mild))
    hosts = "|".join(h.replace(".", r"\.") for h in allowed_hosts) or "(?!)"
    new = F.regexp_replace(new, rf"https?://(?![^\s/]*(?:{hosts})(?:[\s/]|$))[^\s/]+", "")
    medical, absolute = found_words(old, MEDICAL_WORDS), found_words(old, ABSOLUTE_WORDS)
    return F.struct(
        new.alias("text"), ((F.size(medical) > 0) | (F.size(absolute) > 0) | (old == "")).alias("blocked"), (new != old).alias("rewritten"), (F.length(new) > longest).alias("too_long"), has_any(old, DEFERRALS).alias("deferred"),
        medical.alias("medical"), absolute.alias("absolute"), (new.rlike(r"\d") & ~new.rlike(r"\[#\d+\]")).alias("uncited"),
    )
