"""Knowledge items from tickets, segments and pictures; claims about pictures; names, needs and matches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.window import Window as W

# Intents that name a knowledge type, then words that do, in order of priority.
INTENT_TYPES = {"product_knowledge": "spec", "sizing": "sizing", "aftersale": "aftersale", "order_logistics": "logistics"}
TYPE_HINTS = [
    (["尺码", "码数", "什么码", "几码", "大码", "小码", "身高", "体重", "多大", "偏大", "偏小"], "sizing"),
    (["退货", "退换", "换货", "售后", "退款", "保修", "七天", "能退", "可以退", "能换", "可以换"], "aftersale"),
    (["活动", "优惠", "满减", "领券", "优惠券", "折扣", "促销"], "promotion"),
    (["洗", "保养", "养护", "熨", "晾", "起球", "褪色", "缩水"], "usage"),
    (["物流", "快递", "发货", "到货", "几天", "多久到", "运费", "包邮"], "logistics"),
    (["材质", "面料", "克重", "成分", "工艺", "填充", "含量"], "spec"),
]
#: A place among a product's words is below this.
PLACES = 1 << 31
# Shades by base colour, words that are patterns and no colours, parts of names that no one mishears.
COLOUR_BASES = {
    "蓝": ["藏青", "深蓝", "宝蓝", "天蓝", "海军蓝", "牛仔蓝", "湖蓝"],
    "白": ["米白", "象牙白", "奶白", "米色", "本白", "乳白"],
    "红": ["酒红", "正红", "大红", "砖红", "枣红", "玫红"],
    "绿": ["墨绿", "军绿", "草绿", "橄榄绿", "青绿"],
    "灰": ["浅灰", "深灰", "银灰", "烟灰"],
    "棕": ["咖啡", "焦糖", "驼色", "卡其", "棕色"],
    "粉": ["藕粉", "浅粉", "豆沙粉"],
    "黑": ["炭黑", "墨黑"],
}
PATTERN_WORDS = ["波点", "撞色", "碎花", "条纹", "格纹", "印花", "拼色", "花色", "图案", "迷彩", "豹纹"]
PLAIN_PARTS = "新款|新品|经典|复古|基础款|百搭|韩版|日系|法式|高腰|宽松|修身|加厚|轻薄|重磅|手工|头层|正品|包邮|限时|特价"
# A picture shows no measures.
MEASURE = r"(?i)\d+\s*(?:g|克|cm|厘米|mm)"


def _any(text: Column, words: list[str]) -> Column:
    return reduce(Column.__or__, [F.contains(text, F.lit(w)) for w in words])


def knowledge_type(question: Column, intent: Column, intents=None, hints=None) -> Column:
    """By intent where it tells, else by the first list with a word that the question holds, else `other`."""
    q = F.coalesce(question, F.lit(""))
    by_intent = [F.when(intent == i, F.lit(t)) for i, t in (INTENT_TYPES if intents is None else intents).items()]
    return F.coalesce(*by_intent, *[F.when(_any(q, words), F.lit(t)) for words, t in hints or TYPE_HINTS], F.lit("other"))


def _item(ref: Column, **columns) -> list[Column]:
    base = {
        "biz_type": F.lit("qa"), "title": F.lit(""), "content": F.lit(""), "product_ids": F.array().cast("array<bigint>"), "category_id": F.lit(None).cast("long"), "tags": F.array().cast("array<string>"), "source": F.lit(""),
        "quality_score": F.lit(0.7), "confidence": F.lit(0.7), "knowledge_type": F.lit("other"), "review_status": F.lit("pending"),
    }
    return [ref.alias("source_ref"), *[c.alias(name) for name, c in (base | columns).items()]]


def from_tickets(tickets: DataFrame, categories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Answered tickets (id, question, answer, intent, product_id) as pending items, and those refused with why.

    categories: (product_id, category_id), once a product.  A blank answer or
    question is refused; a ticket without a product has none and no category.
    """
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    t = tickets.withColumn("why", F.when(blank("answer"), "no_answer").when(blank("question"), "no_question"))
    ok = t.where("why is null").join(categories.select("product_id", F.col("category_id").alias("_c")), "product_id", "left")
    title = F.trim("question")
    items = ok.select(
        *_item(
            F.concat(F.lit("ticket:"), F.col("id")), title=title, content=F.trim("answer"), product_ids=F.when(F.col("product_id").isNotNull(), F.array(F.col("product_id").cast("long"))).otherwise(F.array().cast("array<bigint>")),
            category_id=F.col("_c").cast("long"), source=F.lit("handover"), quality_score=F.lit(0.9), confidence=F.lit(0.85), knowledge_type=knowledge_type(title, F.col("intent")),
        )
    )
    return items, t.where("why is not null").select("id", "why")


def bind_segments(segments: DataFrame, names: DataFrame, products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments (segment_id, text, product_id as a model gave it) bound to products -> trusted ones, and those to review.

    spoken: the text holds a name (the longest counts); model: only the model
    says so; none.  A model's product that does not exist counts as none.
    """
    from .review import align

    spoken = align(segments, names, "text").select("segment_id", F.col("product_id").alias("_p"), "matched")
    s = segments.join(spoken, "segment_id", "left").join(products.select(F.col("product_id").alias("_known")).distinct(), F.col("product_id") == F.col("_known"), "left")
    binding = F.when(F.col("_p").isNotNull(), "spoken").when(F.col("_known").isNotNull(), "model").otherwise("none")
    alias = F.when(F.col("_p").isNotNull() & ~F.col("_p").eqNullSafe(F.col("_known")), F.col("matched"))
    s = s.select("segment_id", "text", F.coalesce("_p", "_known").alias("product_id"), binding.alias("binding"), alias.alias("matched_alias"))
    return s.where("binding = 'spoken'"), s.where("binding <> 'spoken'")


def from_segments(segments: DataFrame, categories: DataFrame, ref: str) -> DataFrame:
    """Useful segments (segment_id, kind, topic, script, product_id, binding, begin_ms, end_ms) as pending scripts; only spoken products stay."""
    spoken = (F.col("binding") == "spoken") & F.col("product_id").isNotNull()
    s = segments.where(F.trim(F.coalesce("script", F.lit(""))) != "").join(categories.select("product_id", F.col("category_id").alias("_c")), "product_id", "left")
    return s.select(
        *_item(
            F.concat(F.lit(f"{ref}#"), F.col("begin_ms"), F.lit("-"), F.col("end_ms")), biz_type=F.lit("script"), title=F.coalesce(F.when(F.trim("topic") != "", F.col("topic")), F.concat(F.lit("segment "), F.col("segment_id"))), content=F.col("script"),
            product_ids=F.when(spoken, F.array(F.col("product_id").cast("long"))).otherwise(F.array().cast("array<bigint>")), category_id=F.when(spoken, F.col("_c").cast("long")),
            tags=F.when(F.col("kind") == "qa", F.array(F.lit("live"), F.lit("script"), F.lit("qa"))).otherwise(F.array(F.lit("live"), F.lit("script"))), source=F.lit("live_clip"), knowledge_type=F.when(F.col("kind") == "feature", "spec").otherwise("other"),
        )
    )


def from_pictures(described: DataFrame) -> DataFrame:
    """(asset_id, product_id, category_id, name, description, confidence, flags) as items; approved only without flags."""
    clean = F.size(F.coalesce("flags", F.array().cast("array<string>"))) == 0
    d = described.where(F.trim(F.coalesce("description", F.lit(""))) != "")
    return d.select(
        *_item(
            F.concat(F.lit("asset:"), F.col("asset_id")), biz_type=F.lit("asset"), title=F.col("name"), content=F.col("description"), product_ids=F.array(F.col("product_id").cast("long")), category_id=F.col("category_id").cast("long"), source=F.lit("vision"),
            confidence=F.coalesce("confidence", F.lit(0.0)), knowledge_type=F.lit("spec"), review_status=F.when(clean, "approved").otherwise("pending"),
        )
    )


def base_colour(colour: Column) -> Column:
    """A shade's base colour, or the word itself, without a last 色."""
    bare = lambda x: x[: len(x.rstrip("色"))]
    c = F.regexp_replace(F.trim(colour), "色+$", "")
    return F.coalesce(*[F.when(c.isin(base, *map(bare, shades)), F.lit(base)) for base, shades in COLOUR_BASES.items()], c)


def colour_conflicts(seen: Column, listed: Column) -> Column:
    """Colours seen that no listed one has the base of; nothing if only patterns are listed."""
    real = F.filter(listed, lambda c: ~F.exists(F.array(*map(F.lit, PATTERN_WORDS)), lambda p: F.contains(c, p)))
    bases = F.transform(real, base_colour)
    bad = F.filter(F.transform(seen, F.trim), lambda c: (c != "") & ~F.array_contains(bases, base_colour(c)))
    return F.when(F.size(real) > 0, bad).otherwise(F.array().cast("array<string>"))


def unseen_claims(text: Column, name: Column, forbidden: list[str], measure: str = MEASURE) -> Column:
    """What a picture cannot show: forbidden words that the product's name does not hold, and `measure` for numbers with units."""
    words = F.filter(F.array(*map(F.lit, forbidden)).cast("array<string>"), lambda w: F.contains(text, w) & ~F.contains(F.coalesce(name, F.lit("")), w))
    return F.concat(words, F.when(text.rlike(measure), F.array(F.lit("measure"))).otherwise(F.array().cast("array<string>")))


def clean_description(text: Column, name: Column, forbidden: list[str], ends: str = "。；;") -> Column:
    """The text without sentences that claim what a picture cannot show."""
    parts = F.split(F.coalesce(text, F.lit("")), f"(?<=[{ends}])")
    return F.array_join(F.filter(parts, lambda s: (F.trim(s) != "") & (F.size(unseen_claims(s, name, forbidden)) == 0)), "")


def hotwords(products: DataFrame, plain: str = PLAIN_PARTS, least: int = 2) -> DataFrame:
    """(product_id, name, aliases, attrs) -> words for a recogniser: names, their parts, aliases, parts of values; each once, at its first place.

    Whole product_ids and places are one number while the least is looked for:
    tasks then add words up as they come, and hold each once, not sorted rows.
    """
    none = F.array().cast("array<string>")
    name = F.coalesce("name", F.lit(""))
    parts = F.flatten(F.transform(F.coalesce(F.map_values("attrs"), none), lambda v: F.split(v, r"[\d%／/、，,\s]+")))
    words = F.concat(F.array(name), F.split(name, plain), F.coalesce("aliases", none), parts)
    w = products.select("product_id", F.posexplode(words).alias("pos", "word")).withColumn("word", F.trim("word")).where(F.length("word") >= least)
    kind = products.schema["product_id"].dataType
    if not isinstance(kind, IntegralType):
        return w.groupBy("word").agg(F.min(F.struct("product_id", "pos")).alias("first")).select("word", F.col("first.product_id").alias("product_id"), F.col("first.pos").alias("pos"))
    place = (F.col("product_id").cast("decimal(19,0)") * F.lit(PLACES).cast("decimal(11,0)") + F.col("pos")).cast("decimal(31,0)")
    # a null id comes first, as in a struct: its places alone are kept apart
    m = w.groupBy("word").agg(F.min(place).alias("_at"), F.min(F.when(F.col("product_id").isNull(), F.col("pos"))).alias("_null"))
    pos = F.pmod("_at", F.lit(PLACES).cast("decimal(11,0)"))
    found = F.col("_null").isNull()
    return m.select("word", F.when(found, ((F.col("_at") - pos) / PLACES).cast(kind)).alias("product_id"), F.coalesce("_null", pos.cast("int")).alias("pos"))


def merge_needs(turns: DataFrame, singles: list[str], lists: list[str]) -> DataFrame:
    """(session, turn, ...) -> what a session asked for: of single values the last given, of lists all, in the order given."""
    last = [F.max_by(c, F.when(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != ""), F.col("turn"))).alias(c) for c in singles]
    every = [F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.coalesce(c, F.array().cast("array<string>")).alias("v")))), lambda x: x["v"]))).alias(c) for c in lists]
    return turns.groupBy("session").agg(*last, *every)


def category_losses(now: DataFrame, before: DataFrame) -> DataFrame:
    """Categories of the release before that this one lacks."""
    return before.select("category_id").distinct().join(now.select("category_id").distinct(), "category_id", "left_anti")


def product_cards(skus: DataFrame) -> DataFrame:
    """(product_id, sku_no, price, origin_price, stock) -> least price, first original price there is, and whether anything is in stock."""
    real = F.col("origin_price").isNotNull() & (F.col("origin_price") != 0)
    return skus.groupBy("product_id").agg(F.min("price").alias("price"), F.min_by("origin_price", F.when(real, F.col("sku_no"))).alias("origin_price"), F.coalesce(F.bool_or(F.col("stock") > 0), F.lit(False)).alias("in_stock"))


def label_tasks(items: DataFrame) -> DataFrame:
    """(id, payload): items as JSON for an annotation tool, with what was predicted."""
    data = F.struct(F.col("id").alias("item_id"), "title", "content", "priority", "reason")
    return items.select("id", F.to_json(F.struct(data.alias("data"), F.struct(F.col("confidence").alias("score")).alias("meta"))).alias("payload"))


def append_track(track: Column, entry: Column) -> Column:
    """A JSON array of {desc} with one more entry; anything that is no such array starts anew."""
    old = F.from_json(F.coalesce(track, F.lit("[]")), "array<struct<desc string>>")
    old = F.filter(F.coalesce(old, F.array().cast("array<struct<desc string>>")), lambda x: x.isNotNull() & x["desc"].isNotNull())
    return F.to_json(F.concat(old, F.array(F.struct(entry.alias("desc")))))


# What an exact name, an alias, and a near name are worth; least score and lead for a binding of its own.
MATCH_WEIGHTS = (1.0, 0.9, 0.8)
LEAST_MATCH, LEAST_LEAD = 0.85, 0.15


def catalogue_faults(products: DataFrame, attrs: DataFrame, skus: DataFrame, forbidden: DataFrame) -> DataFrame:
    """(product_id, fault): values that a category forbids (category_id, key, value: a literal), no attribute, no SKU, a name used twice.

    Rules meet attributes by category and key.
    """
    a = attrs.join(products.select("product_id", "category_id"), "product_id")
    wrong = a.join(forbidden.withColumnRenamed("value", "_bad"), ["category_id", "key"]).where(F.contains("value", F.col("_bad"))).select("product_id", F.concat(F.lit("forbidden:"), F.col("key")).alias("fault"))
    bare = products.join(attrs.select("product_id").distinct(), "product_id", "left_anti").select("product_id", F.lit("no_attribute").alias("fault"))
    unsold = products.join(skus.select("product_id").distinct(), "product_id", "left_anti").select("product_id", F.lit("no_sku").alias("fault"))
    twice = products.groupBy("name").agg(F.count("*").alias("_n")).where("_n > 1 and name is not null").select("name")
    same = products.join(twice, "name").select("product_id", F.lit("same_name").alias("fault"))
    return wrong.unionAll(bare).unionAll(unsold).unionAll(same).distinct()


def min_hash_jaccard(a: Column, b: Column) -> Column:
    """The share of places where two signatures of one length agree."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.size(a)


def normalised(vec: Column) -> Column:
    """A vector of length 1; a zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(vec, lambda x: x.cast("double") / norm)).otherwise(F.transform(vec, lambda x: x.cast("double")))


def promotion_ends(kind: Column, valid_to: Column, as_of: Column, days: int = 7) -> Column:
    """When an item is over: a promotion without an end lasts `days` from as_of."""
    return F.when((kind == "promotion") & valid_to.isNull(), as_of + F.make_dt_interval(F.lit(days))).otherwise(valid_to)


def item_rows(items: DataFrame, as_of: Column) -> DataFrame:
    """Items as their table holds them: vectors to come, valid from now unless told, arrays as JSON."""
    lists = [c for c, kind in items.dtypes if kind.startswith("array")]
    return items.withColumns({"embedding_status": F.lit("pending"), "valid_from": F.coalesce("valid_from", as_of), **{c: F.to_json(F.coalesce(c, F.array().cast(items.schema[c].dataType))) for c in lists}})


def embedded(rows: DataFrame, embed, dim: int, most: int = 16) -> DataFrame:
    """(id, text) -> (id, vec) by a caller's function of up to `most` texts at a time; vectors of another length fail the job."""

    def run(frames):
        for f in frames:
            for a in range(0, len(f), most):
                part = f.iloc[a : a + most]
                vecs = embed(part["text"].fillna("").tolist())
                if len(vecs) != len(part) or any(len(v) != dim for v in vecs):
                    raise ValueError("the provider gave vectors of another length or number")
                yield part[["id"]].assign(vec=[list(map(float, v)) for v in vecs])

    return rows.select(F.col("id").cast("long").alias("id"), "text").mapInPandas(run, "id long, vec array<double>")


def clip_run(segments: DataFrame, names: DataFrame, products: DataFrame, categories: DataFrame, stored_aliases: DataFrame, ref: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Segments of a live session -> its items, alias proposals with what is stored, and segments to review."""
    from .tasks import propose_aliases

    trusted, review = bind_segments(segments, names, products)
    bound = trusted.unionByName(review).join(segments.drop("text", "product_id"), "segment_id")
    aliases = propose_aliases(stored_aliases, trusted.select("product_id", F.col("matched_alias").alias("alias")))
    return from_segments(bound, categories, ref), aliases, review


# When a blind spot is covered after all, and when a draft is one that exists.
COVERED_DENSE, COVERED_OVERLAP, SAME_DRAFT = 0.72, 0.30, 0.50


def knowledge_batch(spots: DataFrame, leads: DataFrame, hits: DataFrame, drafts: DataFrame, nearest: DataFrame, limit: int = 20) -> DataFrame:
    """(id, question, times) -> an outcome for each cluster's lead: covered, no_evidence, no_draft, ungrounded, duplicate or staged.

    leads: (id, lead); hits: (id, dense, overlap) of the best hit; drafts: (id,
    draft, evidence) by a model; nearest: (id, score) to what exists.  Clusters
    are ranked and cut after the clustering.
    """
    from ..functions.claims import grounded
    from .greedy import ranked_clusters

    todo = ranked_clusters(spots, leads, "id", "times", limit).select(F.col("lead").alias("id"), "members", "times")
    j = todo.join(spots.select("id", "question"), "id").join(hits, "id", "left").join(drafts, "id", "left").join(nearest.withColumnRenamed("score", "_same"), "id", "left")
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    outcome = (
        F.when((F.col("dense") >= COVERED_DENSE) & (F.col("overlap") >= COVERED_OVERLAP), "covered").when(blank("evidence"), "no_evidence").when(blank("draft"), "no_draft")
        .when(~grounded(F.col("draft"), F.col("evidence"), F.col("question"))["ok"], "ungrounded").when(F.coalesce("_same", F.lit(0.0)) >= SAME_DRAFT, "duplicate").otherwise("staged")
    )
    return j.select("id", "members", "times", outcome.alias("outcome"))
