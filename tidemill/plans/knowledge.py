"""Queries on knowledge items; documents and their labels stand for them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.textops import dedup_key
from ..operators import knowledge as ops


def _items(spark, d):
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    text = F.coalesce("text", F.lit(""))
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"), F.lit("qa").alias("biz_type"), F.substring_index(text, "\n", 1).alias("title"), text.alias("content"), "lang", "source",
        (F.col("doc_id") % 7).alias("category_id"), F.col("lang").alias("knowledge_type"), F.array("lang", "source").alias("tags"),
        ((F.col("doc_id") * 37 % 101) / 100).alias("confidence"), F.col("quality").cast("double").alias("quality_score"),
        F.when(F.col("quality").isNull(), "pending").when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "approved").otherwise("revised").alias("review_status"),
        F.when(F.col("doc_id") % 5 == 0, F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(cast(doc_id % 60 as int))")).alias("valid_to"),
        (F.length(text) > 2000).alias("has_assets"), F.array((F.col("doc_id") % 3)).alias("product_ids"),
    )


def _keyed(spark, d):
    i = _items(spark, d)
    return i.withColumn("dedup_key", dedup_key(F.col("biz_type"), F.col("title"), F.col("product_ids")))


def knowledge_merge(spark, d):
    """Items with one dedup key merged into the best."""
    m = ops.merge_duplicates(_items(spark, d), dedup_key(F.col("biz_type"), F.col("title"), F.col("product_ids")))
    return m.select("id", F.round("confidence", 6).alias("confidence"), "merged", F.array_join("tags", ",").alias("tags"), "category_id")


def duplicate_ratio(spark, d):
    """The part of items that a merge would take away."""
    return ops.duplicate_ratio(_keyed(spark, d), F.col("dedup_key")).select(F.round("duplicate_ratio", 6).alias("duplicate_ratio"))


def publishable_items(spark, d):
    """Reviewed items that hold on 20 January 2024."""
    return ops.publishable(_items(spark, d), F.expr("timestamp_ntz '2024-01-20 00:00:00'")).select("id", "review_status")


def publish_marginals(spark, d):
    """Items by source, language and status alone."""
    return ops.marginals(_items(spark, d), ["source", "knowledge_type", "review_status"])


def publish_stats(spark, d):
    """The release's statistics."""
    return ops.statistics(_keyed(spark, d))


def _measures(spark, d):
    i = _keyed(spark, d)
    top = i.groupBy("source").count().agg(F.max("count").alias("top"))
    pii = F.col("content").rlike(r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]+")
    m = i.agg(
        F.count("*").alias("n"), F.avg(F.col("review_status").isin("approved", "revised").cast("double")).alias("approved_ratio"), F.avg("quality_score").alias("avg_quality"),
        F.avg((F.col("source") == "src0").cast("double")).alias("synthetic_ratio"), (1 - F.coalesce(F.try_divide(F.countDistinct("dedup_key"), F.count("*")), F.lit(1.0))).alias("duplicate_ratio"), F.count_if(pii).alias("pii_items"),
    )
    return m.crossJoin(F.broadcast(top)).withColumn("top_source_ratio", F.try_divide("top", "n"))  # one row by one row


def publish_gates(spark, d):
    """Each gate's value, bound and outcome."""
    return ops.check_gates(_measures(spark, d)).select("gate", F.round("value", 6).alias("value"), "bound", "passed", "blocking")


def publish_decision(spark, d):
    """May this release go out?"""
    return ops.decide(ops.check_gates(_measures(spark, d)))


def _cells(spark, d):
    i = _items(spark, d)
    return ops.coverage(i.where("category_id <> 3 and not (category_id = 2 and lang <> 'en')"), i.select("category_id").distinct(), i.select("knowledge_type").distinct(), sparse=25, hot=60)


def coverage_matrix(spark, d):
    """Items and level of every category and type."""
    return _cells(spark, d)


def coverage_ratio(spark, d):
    """The part of a category's cells that hold anything."""
    return _cells(spark, d).groupBy("category_id").agg(F.round(F.avg((F.col("level") != "empty").cast("double")), 6).alias("covered"))


def write_tasks(spark, d):
    """Thin cells by demand and gap."""
    events = spark.read.parquet(f"{d}/events.parquet")
    kinds = F.when(F.col("event_type") == "view", "en").when(F.col("event_type") == "click", "fr").when(F.col("event_type") == "error", "de").otherwise("es")
    demand = events.groupBy((F.col("user_id") % 7).alias("category_id"), kinds.alias("knowledge_type")).agg(F.count("*").alias("demand"))
    return ops.write_tasks(_cells(spark, d), demand, target=25, steps=(600, 300, 100))


def triage_counts(spark, d):
    """Items by review priority and reason."""
    i = _items(spark, d)
    sampled = F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 4), 16, 10).cast("int") % 20 == 0
    t = ops.triage(i, F.col("content").contains("tion of the"), F.col("content").contains("the") & (F.col("lang") == "de"), (F.col("id") % 60).cast("int"), sampled)
    return t.groupBy("priority", "reason").agg(F.count("*").alias("items"))


QUERIES = {f.__name__: f for f in (knowledge_merge, duplicate_ratio, publishable_items, publish_marginals, publish_stats, publish_gates, publish_decision, coverage_matrix, coverage_ratio, write_tasks, triage_counts)}

_I = """i as (select d.doc_id id, split_part(coalesce(text, ''), chr(10), 1) title, coalesce(text, '') as content, lang, source, d.doc_id % 7 category_id, lang knowledge_type, (d.doc_id * 37 % 101) / 100.0::double confidence, quality::double quality_score,
    case when quality is null then 'pending' when toxic = 1 then 'rejected' when quality = 1 then 'approved' else 'revised' end review_status,
    case when d.doc_id % 5 = 0 then timestamp '2024-01-01' + to_days((d.doc_id % 60)::int) end valid_to, length(coalesce(text, '')) > 2000 has_assets,
    substr(sha256('qa|' || trim(split_part(coalesce(text, ''), chr(10), 1), ' ') || '|[' || (d.doc_id % 3)::varchar || ']'), 1, 16) k from documents d left join labels l on d.doc_id = l.doc_id)"""
_G = f"""{_I}, m as (select avg((review_status in ('approved', 'revised'))::int) approved_ratio, avg(quality_score) avg_quality, avg((source = 'src0')::int) synthetic_ratio,
    (select max(c) from (select count(*) c from i group by source)) / count(*) top_source_ratio, 1 - count(distinct k) / count(*) duplicate_ratio, count(*) filter (regexp_matches(content, '[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\\.[A-Za-z0-9_.-]+')) pii_items from i),
    g as (select 'approved_ratio' gate, approved_ratio v, 0.95::double b, approved_ratio >= 0.95 p, true s from m union all select 'avg_quality', avg_quality, 0.7, avg_quality >= 0.7, true from m
    union all select 'synthetic_ratio', synthetic_ratio, 0.5, synthetic_ratio <= 0.5, true from m union all select 'top_source_ratio', top_source_ratio, 0.8, top_source_ratio <= 0.8, false from m
    union all select 'duplicate_ratio', duplicate_ratio, 0.02, duplicate_ratio <= 0.02, true from m union all select 'pii_items', pii_items, 0, pii_items <= 0, true from m)"""
_C = f"""{_I}, n as (select category_id, knowledge_type, count(*) n from i where category_id <> 3 and not (category_id = 2 and lang <> 'en') group by all),
    c as (select a.category_id, b.knowledge_type, coalesce(n, 0) items, case when coalesce(n, 0) = 0 then 'empty' when n < 25 then 'sparse' when n > 60 then 'hot' else 'ok' end as level
    from (select distinct category_id from i) a cross join (select distinct knowledge_type from i) b left join n on a.category_id = n.category_id and b.knowledge_type = n.knowledge_type)"""
ORACLES = {
    "knowledge_merge": f"""with {_I}, r as (select *, row_number() over (partition by k order by confidence desc, quality_score desc nulls last, length(content) desc, id) r from i),
        t as (select k, string_agg(tag, ',' order by p) tags from (select k, tag, min(p) p from (select k, lang tag, r * 2 p from r union all select k, source, r * 2 + 1 from r) group by all) group by k)
        select r.id, round(greatest(confidence, least(0.98, confidence + least(0.10, 0.03 * (merged - 1)))), 6) confidence, merged, t.tags, category_id from r join (select k, count(*) merged from r group by k) using (k) join t using (k) where r = 1""",
    "duplicate_ratio": f"with {_I} select round(1 - count(distinct k) / count(*), 6) duplicate_ratio from i",
    "publishable_items": f"with {_I} select id, review_status from i where review_status in ('approved', 'revised') and (valid_to is null or valid_to > timestamp '2024-01-20')",
    "publish_marginals": f"with {_I} select 'source' dimension, source as value, count(*) items from i group by source union all select 'knowledge_type', lang, count(*) from i group by lang union all select 'review_status', review_status, count(*) from i group by review_status",
    "publish_stats": f"""with {_I} select count(*) items, round(avg((review_status in ('approved', 'revised'))::int), 6) approved_ratio, round(avg(quality_score), 6) avg_quality, count(*) - count(distinct k) duplicates,
        count(distinct nullif(category_id, 0)) categories, count(*) filter (has_assets) with_assets, count(valid_to) with_expiry from i""",
    "publish_gates": f"with {_G} select gate, round(v, 6) as value, b as bound, p as passed, s as blocking from g",
    "publish_decision": f"with {_G} select bool_and(p or not s) publish, count(*) filter (not p) failed from g",
    "coverage_matrix": f"with {_C} select * from c",
    "coverage_ratio": f"with {_C} select category_id, round(avg((level <> 'empty')::int), 6) covered from c group by 1",
    "write_tasks": f"""with {_C}, e as (select user_id % 7 category_id, case event_type when 'view' then 'en' when 'click' then 'fr' when 'error' then 'de' else 'es' end knowledge_type, count(*) n from events group by all)
        select c.category_id, c.knowledge_type, items, case when coalesce(n, 0) >= 600 then 0 when n >= 300 then 1 when n >= 100 then 2 else 3 end priority, greatest(0, 25 - items) gap
        from c left join e using (category_id, knowledge_type) where level in ('empty', 'sparse') order by priority, gap desc, category_id, knowledge_type limit 50""",
    "triage_counts": f"""with {_I}, t as (select case when confidence < 0.6 then 'P0:low_confidence' when contains(content, 'tion of the') then 'P0:uncertain' when contains(content, 'the') and lang = 'de' then 'P1:conflict' when id % 60 >= 50 then 'P1:hot'
        when confidence >= 0.9 and ('0x' || substr(md5(id::varchar), 1, 4))::int % 20 = 0 then 'P2:sampled' when confidence >= 0.9 then 'auto:approved' else 'P2:middle' end x from i)
        select split_part(x, ':', 1) priority, split_part(x, ':', 2) reason, count(*) items from t group by all""",
}
