"""Claims in copy: superlatives, efficacy, promises, and numbers without a source."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import found_words, guard_output

# Words that advertising may not use.
SUPERLATIVES = [
    "国家级", "世界级", "最高级", "最佳", "最好", "最优", "最强", "最先进", "最低价", "最便宜", "最流行", "最受欢迎", "第一品牌", "全网第一",
    "销量第一", "行业第一", "全国第一", "顶级", "极致", "极品", "唯一", "独家首创", "首选", "王牌", "冠军", "领导品牌", "领先品牌",
    "史无前例", "前所未有", "绝无仅有", "百分百", "百分之百", "绝对", "永久", "万能", "无敌", "完美", "顶尖", "至尊", "巅峰",
]
EFFICACY = ["治疗", "根治", "疗效", "药用", "抗癌", "杀菌率", "消炎", "止痛", "促进血液循环", "排毒", "养生", "增高", "减肥"]
PROMISES = ["假一赔十", "假一赔百", "无效退款", "终身保修", "永久包换", "保证正品", "绝对正品"]
# What may follow 最 without praise.
HARMLESS_AFTER_MOST = "近后初终多少大小早晚新"
# Chinese numerals below a hundred.
CN_DIGITS = {"零": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}

# Units that make a Chinese numeral a number, sayings that hold none, and 一 as an article.
UNITS = ["天", "日", "年", "月", "周", "小时", "分钟", "度", "元", "块", "件", "次", "码", "厘米", "cm", "米", "斤", "克", "kg", "g", "%", "折", "倍", "岁", "人"]
IDIOMS = ["一次性", "一度", "一时", "一天到晚", "万一", "二次销售"]
ARTICLE = "(?<![零一二两三四五六七八九十百])一(?=[件次])"


def suspects(text: Column) -> Column:
    """最 with what follows, where neither harmless nor part of a listed word found."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(f"(最[一-鿿&&[^{HARMLESS_AFTER_MOST}]])"), F.lit(1)))
    blocked = found_words(text, SUPERLATIVES)
    return F.filter(found, lambda w: ~F.exists(blocked, lambda b: F.contains(b, w)))


def cn_number(word: Column) -> Column:
    """A Chinese numeral below a hundred as an integer, or null."""
    digit = F.create_map(*[F.lit(x) for kv in CN_DIGITS.items() for x in kv])
    ten = F.regexp_extract(word, "^([一二两三四五六七八九]?)十([一二三四五六七八九]?)$", 0) != ""
    head, tail = F.substring_index(word, "十", 1), F.substring_index(word, "十", -1)
    value = lambda c, empty: F.when(c == "", F.lit(empty)).otherwise(F.try_element_at(digit, c))
    return F.when(ten, value(head, 1) * 10 + value(tail, 0)).when(F.length(word) == 1, F.try_element_at(digit, word))


def numbers(text: Column, article: bool = False) -> Column:
    """Numbers of a text, each once: digits as they are without leading zeros, Chinese numerals below a hundred where a unit follows.

    Fixed sayings hold none; with `article`, 一 before 件 or 次 is an article.
    Ordinals and what follows 再, 又 or 每 are no claims.  A null text has none.
    """
    bare = F.coalesce(text, F.lit(""))
    for saying in IDIOMS:
        bare = F.replace(bare, F.lit(saying), F.lit(""))
    if article:
        bare = F.regexp_replace(bare, ARTICLE, "")
    digits = F.transform(F.regexp_extract_all(bare, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1)), lambda x: F.ltrim(x, F.lit("0")))
    digits = F.transform(digits, lambda x: F.when(x == "", "0").otherwise(x))
    units = "|".join(sorted(UNITS, key=len, reverse=True))
    words = F.regexp_extract_all(bare, F.lit(rf"(?=[零一二两三四五六七八九十百])(?<![第再又每])([零一二两三四五六七八九十百]+)\s*(?:{units})"), F.lit(1))
    return F.array_compact(F.array_distinct(F.concat(digits, F.transform(words, lambda x: cn_number(x).cast("string")))))


def missing(found: Column, known: Column) -> Column:
    """Numbers found that are not known, the least first, those of one whole part by their text."""
    ranked = F.transform(F.array_except(found, known), lambda x: F.struct(F.floor(x.cast("double")).alias("value"), x.alias("x")))
    return F.transform(F.array_sort(ranked), lambda x: x["x"])


def unsourced(draft: Column, evidence: Column, question: Column | None = None, article: bool = False) -> Column:
    """Numbers of the draft that neither the evidence (a text) nor the question has, the least first."""
    known = numbers(evidence, article)
    if question is not None:
        known = F.concat(known, numbers(question, article))
    return missing(numbers(draft, article), known)


def grounded(draft: Column, evidence: Column, question: Column) -> Column:
    """struct(ok, text, unsourced, flags) of a draft: empty, without evidence, with numbers from nowhere, or with words an answer may not use.

    Promises are made milder and flagged, which does not stop a draft.
    """
    text = F.trim(F.coalesce(draft, F.lit("")))
    absent = unsourced(text, evidence, question)
    post = guard_output(text, 10_000)
    none = F.array().cast("array<string>")
    flag = lambda cond, name: F.when(cond, F.array(F.lit(name))).otherwise(none)
    no_text, no_evidence = text == "", F.trim(F.coalesce(evidence, F.lit(""))) == ""
    flags = F.concat(flag(no_text, "empty"), flag(~no_text & no_evidence, "no_evidence"), flag(~no_text & ~no_evidence & (F.size(absent) > 0), "unsourced"), flag(~no_text & ~no_evidence & post["blocked"], "blocked"), flag(~no_text & ~no_evidence & ~post["blocked"] & post["rewritten"], "rewritten"))
    ok = ~no_text & ~no_evidence & (F.size(absent) == 0) & ~post["blocked"]
    return F.struct(ok.alias("ok"), F.when(post["blocked"], text).otherwise(post["text"]).alias("text"), F.when(no_text | no_evidence, none).otherwise(absent).alias("unsourced"), flags.alias("flags"))


def attribute_conflicts(text: Column, attributes: Column, materials: list[str], name: Column | None = None) -> Column:
    """Materials that the text names and neither an attribute (a map's keys and values) nor the product's name does."""
    known = F.concat_ws(" ", F.coalesce(F.array_join(F.transform(F.map_entries(attributes), lambda e: F.concat(e["key"], F.coalesce(e["value"], F.lit("")))), " "), F.lit("")), *([] if name is None else [F.coalesce(name, F.lit(""))]))
    return F.filter(found_words(text, materials), lambda m: ~F.contains(known, m))


def check_copy(text: Column, evidence: Column) -> Column:
    """struct(blocked, suspects, unsourced, passed) of a piece of copy."""
    blocked = F.concat(found_words(text, SUPERLATIVES), found_words(text, EFFICACY), found_words(text, PROMISES))
    absent = unsourced(text, evidence, article=True)
    return F.struct(blocked.alias("blocked"), suspects(text).alias("suspects"), absent.alias("unsourced"), ((F.size(blocked) == 0) & (F.size(absent) == 0)).alias("passed"))
