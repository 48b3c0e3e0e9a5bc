"""Queries on review, media, keys and greedy choices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.textops import tokenize
from ..operators import greedy, rag_text, review as ops


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def order_numbers(spark, d):
    """The first long number of each document."""
    return _t(spark, d, "documents").select("doc_id", rag_text.order_number(F.col("text")).alias("number")).where("number is not null")


def task_keys(spark, d):
    """Conversation openings that share a task key."""
    c = _t(spark, d, "conversations").where("turn = 0")
    return c.groupBy(rag_text.task_key(F.lit("ask"), F.lit(None).cast("long"), F.col("text")).alias("key")).agg(F.count("*").alias("n"), F.min("conv_id").alias("first"))


def text_conflicts(spark, d):
    """Documents that hold a nation's region's second word but not its first one."""
    n = _t(spark, d, "nation").select((F.col("n_nationkey") % 5).cast("long").alias("product_id"), F.col("n_nationkey").alias("pos"), F.substring(F.lower("n_name"), 1, 2).alias("key"), F.substring(F.lower("n_name"), 1, 3).alias("value"))
    i = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.array(F.col("doc_id") % 5, (F.col("doc_id") + 1) % 5).alias("product_ids"))
    return ops.attribute_conflicts(i, n)


def attribute_conflicts(spark, d):
    """The rows of text_conflicts, under its earlier name."""
    return text_conflicts(spark, d)


def annotations(spark, d):
    """Items by status once every third was approved, every fifth rejected, every seventh changed."""
    i = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.lit("pending").alias("review_status"), F.lit(0.5).alias("confidence"))
    verdict = F.when(F.col("id") % 5 == 0, "reject").when(F.col("id") % 7 == 0, "revise").when(F.col("id") % 3 == 0, "approve")
    m = i.select("id", verdict.alias("verdict"), F.when(F.col("id") % 7 == 0, F.concat("content", F.lit("!"))).alias("text")).where("verdict is not null")
    return ops.apply_annotations(i, m).groupBy("review_status", "confidence").agg(F.count("*").alias("items"), F.sum(F.length("content")).alias("chars"))


def transcript_windows(spark, d):
    """Windows of three turns that share one, over every session."""
    return ops.windows(_t(spark, d, "conversations"), "conv_id", "turn", 3, 1).select("conv_id", F.col("window").cast("long").alias("window"), "first", "last")


def segment_alignment(spark, d):
    """Documents with the longest of the names they hold."""
    names = _t(spark, d, "benchmark").select(F.col("item_id").alias("product_id"), F.substring_index("text", " ", 3).alias("name"), F.col("item_id").alias("pos"))
    return ops.align(_t(spark, d, "documents").select(F.col("doc_id").alias("segment_id"), "text"), names, "text").where("product_id is not null")


def rating_agreement(spark, d):
    """Agreement of two ratings that events give."""
    e = _t(spark, d, "events").select((F.floor(F.col("value") / 20) + 1).alias("a"), (F.floor((F.col("value") + F.col("event_id") % 25) / 20) + 1).alias("b"))
    return ops.calibration(e, "a", "b")


def message_style(spark, d):
    """Mean length and share of short messages by role."""
    c = _t(spark, d, "conversations")
    return c.groupBy("role").agg(F.round(F.avg(F.length("text")), 6).alias("mean_chars"), F.round(F.avg((F.length("text") < 60).cast("double")), 6).alias("short"), F.countDistinct(F.substring("text", 1, 12)).alias("openings"))


def brand_options(spark, d):
    """Each brand's eight first types, and its price range."""
    p = _t(spark, d, "part")
    return p.groupBy("p_brand").agg(F.array_join(F.slice(F.array_sort(F.collect_set("p_type")), 1, 8), "|").alias("types"), F.min("p_retailprice").alias("low"), F.max("p_retailprice").alias("high"))


def retention(spark, d):
    """Orders and line items left when what is older than 1997 goes, lines by their orders."""
    o = _t(spark, d, "orders")
    gone = o.where("o_orderdate < timestamp_ntz '1997-01-01 00:00:00'").select(F.col("o_orderkey").alias("l_orderkey"))
    return _t(spark, d, "lineitem").join(gone, "l_orderkey", "left_anti").agg(F.count("*").alias("lines"), F.countDistinct("l_orderkey").alias("orders"))


def similar_openings(spark, d):
    """The rows of similar_texts, under its earlier name."""
    return similar_texts(spark, d)


def greedy_openings(spark, d):
    """The rows of greedy_texts, under its earlier name."""
    return greedy_texts(spark, d)


def similar_texts(spark, d):
    """Pairs of documents with a Jaccard of 0.5 or more over words."""
    return greedy.similar_pairs(_t(spark, d, "documents"), "doc_id", tokenize(F.col("text")), 0.5).select("a", "b", F.round("score", 6).alias("score"))


def greedy_texts(spark, d):
    """Documents left when, in order, each goes that is like one kept before it."""
    return greedy.without_similar(_t(spark, d, "documents"), "doc_id", tokenize(F.col("text")), 0.5)


def text_clusters(spark, d):
    """The twenty most asked clusters of like documents, a document being asked for one to five times."""
    rows = _t(spark, d, "documents").select("doc_id", "text", (F.col("doc_id") % 5 + 1).alias("times"))
    return greedy.ranked_clusters(rows, greedy.clusters(rows, "doc_id", tokenize(F.col("text")), 0.5), "doc_id", "times", 20)


QUERIES = {f.__name__: f for f in (order_numbers, task_keys, attribute_conflicts, text_conflicts, annotations, transcript_windows, segment_alignment, rating_agreement, message_style, brand_options, retention, similar_openings, greedy_openings, similar_texts, greedy_texts, text_clusters)}

_S = """t as (select doc_id id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) t from documents), x as (select id, len(t) n, unnest(t) w from t),
    p as (select a.id a, b.id b, count(*) i, any_value(a.n) na, any_value(b.n) nb from x a join x b on a.w = b.w and a.id < b.id group by a.id, b.id), q as (select a, b, i / (na + nb - i) score from p where i / (na + nb - i) >= 0.5)"""
ORACLES = {
    "order_numbers": "with a as (select doc_id, list_filter(regexp_extract_all(text, '[0-9]+'), lambda x: length(x) between 10 and 24) n from documents) select doc_id, n[1] as number from a where len(n) > 0",
    "task_keys": r"select 'ask:-:' || substr(sha1(lower(regexp_replace(text, '[^\pL\pN\pM]+', '', 'g'))), 1, 16) as key, count(*) n, min(conv_id) as first from conversations where turn = 0 group by 1",
    "attribute_conflicts": """with n as (select n_nationkey % 5 product_id, n_nationkey pos, substr(lower(n_name), 1, 2) k, substr(lower(n_name), 1, 3) v from nation), i as (select doc_id id, text c, unnest([doc_id % 5, (doc_id + 1) % 5]) product_id, unnest([0, 1]) p from documents),
        j as (select *, row_number() over (partition by id order by p, pos) r from i join n using (product_id) where contains(c, k) and not contains(c, v)) select id, product_id, k as key, v as value from j where r = 1""",
    "annotations": """with a as (select doc_id id, length(text) n, case when doc_id % 5 = 0 then 'rejected' when doc_id % 7 = 0 then 'revised' when doc_id % 3 = 0 then 'approved' else 'pending' end s from documents)
        select s review_status, case when s in ('approved', 'revised') then 1.0::double else 0.5 end confidence, count(*) items, sum(n + (s = 'revised')::int)::bigint chars from a group by all""",
    "transcript_windows": """with n as (select conv_id, count(*) n, list(turn order by turn) o from conversations group by 1), w as (select *, unnest(range(0, greatest(ceil((n - 1) / 2)::int, 1))) as win from n)
        select conv_id, win as window, o[win * 2 + 1] as first, o[least(win * 2 + 3, n)] as last from w""",
    "segment_alignment": """with n as (select item_id, array_to_string(string_split(text, ' ')[1:3], ' ') name from benchmark), j as (select doc_id, item_id, name, row_number() over (partition by doc_id order by length(name) desc, item_id) r from documents join n on contains(text, name))
        select doc_id segment_id, item_id product_id, name matched from j where r = 1""",
    "rating_agreement": """with e as (select floor(value / 20) + 1 a, floor((value + event_id % 25) / 20) + 1 b from events), r as (select a, b, rank() over (order by a) + (count(*) over (partition by a) - 1) / 2 ra, rank() over (order by b) + (count(*) over (partition by b) - 1) / 2 rb from e)
        select round(corr(ra, rb), 6) rho, round(avg(abs(a - b)), 6) mean_error, round(avg((abs(a - b) >= 2)::int), 6) far from r""",
    "message_style": "select role, round(avg(length(text)), 6) mean_chars, round(avg((length(text) < 60)::int), 6) short, count(distinct substr(text, 1, 12)) openings from conversations group by 1",
    "brand_options": "select p_brand, array_to_string(list_sort(list(distinct p_type))[1:8], '|') types, min(p_retailprice) low, max(p_retailprice) high from part group by 1",
    "retention": "select count(*) as lines, count(distinct l_orderkey) orders from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderdate < timestamp '1997-01-01')",
    "similar_openings": f"with {_S} select a, b, round(score, 6) score from q",
    "greedy_openings": f"""with recursive {_S}, o as materialized (select id, row_number() over (order by id) i from t), nb as materialized (select b, list(a) s from q group by b),
        k as (select 0::bigint i, []::bigint[] kept union all select k.i + 1, case when list_has_any(kept, coalesce(s, [])) then kept else list_append(kept, o.id) end from k join o on o.i = k.i + 1 left join nb on nb.b = o.id)
        select unnest(kept) id from (select kept from k order by i desc limit 1)""",
}
ORACLES["text_conflicts"] = ORACLES["attribute_conflicts"]
ORACLES["similar_texts"] = ORACLES["similar_openings"]
ORACLES["greedy_texts"] = ORACLES["greedy_openings"]
ORACLES["text_clusters"] = ORACLES["greedy_texts"].replace("select unnest(kept) id from (select kept from k order by i desc limit 1)", """kp as (select unnest(kept) id from (select kept from k order by i desc limit 1)), u as (select a, b from q union all select b, a from q),
    l as (select t.id, case when t.id in (select id from kp) then t.id else coalesce(min(u.a), t.id) end lead from t left join u on u.b = t.id and u.a in (select id from kp) group by t.id)
    select lead, count(*) members, sum(id % 5 + 1)::bigint times from l group by 1 order by times desc, lead limit 20""").replace("else list_append(kept, o.id) end from k join o on o.i = k.i + 1 left join nb on nb.b = o.id)", "else list_append(kept, o.id) end from k join o on o.i = k.i + 1 left join nb on nb.b = o.id),")
