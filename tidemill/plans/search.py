"""Queries on hybrid search: benchmark texts and their vectors ask; documents with their vectors answer, two a knowledge item."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.textops import tokenize
from ..operators import evaluation, retrieval, search as ops
from ..sources.tables import cut


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _allowed(spark, d):
    """What a search may find is reviewed and holds on 20 January 2024 (hard_filter)."""
    docs, labels = _t(spark, d, "documents"), _t(spark, d, "labels")
    rows = docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("doc"), F.floor(F.col("doc_id") / 2).alias("item"), F.when(F.col("toxic") == 1, "rejected").when(F.col("doc_id") % 11 == 0, "pending").otherwise("approved").alias("review_status"),
        F.when(F.col("doc_id") % 5 == 0, F.lit(1704067200) + F.col("doc_id") % 60 * 86400).otherwise(0).alias("valid_to_ts"),
    )
    return cut(retrieval.hard_filter(rows, F.lit(1705708800)).select("doc", "item"))


def _items(spark, d):
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vec"))


def _index(spark, d):
    """Of all documents; lengths and number are those of all, a search finds what is allowed."""
    allowed = _allowed(spark, d)
    posts = retrieval.Packed.of(_t(spark, d, "documents"), "doc_id", F.col("text"), _terms(spark, d))
    return ops.Index(posts, _items(spark, d), allowed).only(allowed)


def _terms(spark, d):
    q = _t(spark, d, "benchmark")
    return q.select(F.col("item_id").alias("query"), F.explode(tokenize(F.col("text"))).alias("term")).groupBy("query", "term").agg(F.count("*").alias("qtf"))


def _vectors(spark, d):
    return _t(spark, d, "embeddings").join(_t(spark, d, "benchmark"), F.col("vec_id") == F.col("item_id"), "left_semi").select(F.col("vec_id").alias("query"), F.col("embedding").alias("qvec"))


def hybrid_search(spark, d):
    """The five best items of each benchmark text by both channels."""
    hits = ops.hybrid_search(_terms(spark, d), _vectors(spark, d), _index(spark, d), sparse_weight=0.1)
    return hits.select("query", "rank", "doc", "item", "score", F.round("dense_score", 6).alias("dense_score"), F.round("bm25_score", 6).alias("bm25_score"), F.round("overlap", 6).alias("overlap"))


def _gold(spark, d):
    """Items whose vector has the label of the query's."""
    e = _t(spark, d, "embeddings")
    asked = e.join(_t(spark, d, "benchmark"), F.col("vec_id") == F.col("item_id"), "left_semi").select(F.col("vec_id").alias("query"), "label")
    return asked.join(e.select(F.floor(F.col("vec_id") / 2).alias("item"), "label").distinct(), "label").select("query", "item").distinct()


def weight_sweep(spark, d):
    """Recall and MRR by channel and by the weight of words, on one recall."""
    return ops.weight_sweep(_terms(spark, d), _vectors(spark, d), _index(spark, d), _gold(spark, d), weights=(0.1, 1.0), recall_k=20)


def gate_report(spark, d):
    """Handover, leak and direct answer rates; texts of up to 200 characters count as unanswerable."""
    hits = ops.hybrid_search(_terms(spark, d), _vectors(spark, d), _index(spark, d), sparse_weight=0.1)
    best = hits.groupBy("query").agg(F.round(F.max("dense_score"), 6).alias("best"), F.round(F.max("overlap"), 6).alias("overlap"))
    asked = _t(spark, d, "benchmark").select(F.col("item_id").alias("query"), (F.length("text") > 200).alias("answerable"))
    routed = asked.join(best, "query", "left").select("answerable", retrieval.route(F.col("best"), F.coalesce("overlap", F.lit(0.0)), 0.35, 0.5, 0.6).alias("route"))
    return ops.gate_report(routed)


def threshold_routes(spark, d):
    """Queries and kept hits by outcome, where a text of few words is vague."""
    hits = cut(ops.dense_top(_vectors(spark, d), _items(spark, d).join(_allowed(spark, d).select("doc").distinct(), "doc", "left_semi"), 3))
    vague = _t(spark, d, "benchmark").select(F.col("item_id").alias("query"), (F.length("text") < 220).alias("vague"))
    routed, kept = ops.apply_threshold(hits, vague, 0.5, 0.4)
    n = kept.groupBy("query").agg(F.count("*").alias("n"))
    return routed.join(n, "query", "left").groupBy("outcome").agg(F.count("*").alias("queries"), F.sum(F.coalesce("n", F.lit(0))).alias("hits"))


def rewrite_needs(spark, d):
    """Turns by role that would be rewritten before a search: shorter than sixty characters."""
    return _t(spark, d, "conversations").groupBy("role").agg(F.count_if(ops.needs_rewrite(F.col("text"), 60)).alias("rewritten"), F.count("*").alias("turns"))


def preview_hits(spark, d):
    """Hits that a preview would show, by query."""
    hits = ops.hybrid_search(_terms(spark, d), _vectors(spark, d), _index(spark, d), sparse_weight=0.1)
    return ops.previewable(hits.withColumn("dense_score", F.round("dense_score", 6)), 0.4).groupBy("query").agg(F.count("*").alias("hits"))


def dangling_gold(spark, d):
    """Gold items that no document stands for."""
    gold = _t(spark, d, "benchmark").select((F.col("item_id") * 17).alias("item"))
    return ops.dangling(gold, _t(spark, d, "documents").select(F.floor(F.col("doc_id") / 2).alias("item")))


def _judged(spark, d):
    docs, labels = _t(spark, d, "documents"), _t(spark, d, "labels")
    pred = F.when(F.coalesce("text", F.lit("")).rlike(r"[#*$%&|]{2,}|!!"), "bad").when(F.length("text") < 80, "short").otherwise("good")
    return docs.join(labels, "doc_id").select(F.when(F.col("quality") == 1, "good").otherwise("bad").alias("truth"), pred.alias("pred"), F.when(F.col("toxic") == 1, "stop").otherwise("pass").alias("expected"), F.when(F.coalesce("text", F.lit("")).contains("idiot"), "stop").otherwise("pass").alias("actual"))


def top_confusions(spark, d):
    """The two most frequent mistakes of the rule on markup and length."""
    return evaluation.top_confusions(_judged(spark, d), 2)


def eval_gates(spark, d):
    """Accuracy, macro F1 and worst F1 against their bounds."""
    return evaluation.eval_gates(evaluation.summary(_judged(spark, d)))


def leak_gate(spark, d):
    """Toxic documents that a one-word rule lets pass."""
    return evaluation.leak_gate(_judged(spark, d))


def baseline_write(spark, d):
    """The baseline after a full run: mean order values of the second half of the year, where all are up to 1 % below the first half's."""
    o = _t(spark, d, "orders").withColumn("late", F.month("o_orderdate") >= 7)
    part = lambda late: o.where(F.col("late") == late).groupBy(F.lit("orders").alias("suite"), F.col("o_orderstatus").alias("metric")).agg(F.round(F.avg("o_totalprice") / 100000, 6).alias("value"))
    now, base = cut(part(True)), cut(part(False))
    checks = evaluation.regressions(now, base, 0.01).select(F.col("ok").alias("passed"))
    return evaluation.new_baseline(now, base, checks, True)


QUERIES = {f.__name__: f for f in (hybrid_search, weight_sweep, gate_report, threshold_routes, rewrite_needs, preview_hits, dangling_gold, top_confusions, eval_gates, leak_gate, baseline_write)}

_S = """qt as (select item_id query, term, count(*) qtf from (select item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) term from benchmark) group by all),
    tk as (select doc_id doc, regexp_extract_all(lower(text), '[a-z0-9]+') terms from documents), co as (select count(*) n, sum(coalesce(len(terms), 0)) / count(*) al from tk),
    ok as (select doc_id doc, doc_id // 2 item from documents left join labels using (doc_id) where coalesce(toxic, 0) <> 1 and doc_id % 11 <> 0 and (doc_id % 5 <> 0 or 1704067200 + doc_id % 60 * 86400 > 1705708800)),
    posts as (select doc, len(terms) as len, term, count(*) tf from (select doc, terms, unnest(terms) term from tk semi join ok using (doc)) group by doc, len(terms), term),
    df as (select term, count(*) df from posts group by term),
    sp as (select query, doc, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * posts.len / al)) * qtf), 6) score from qt join df using (term) join posts using (term), co group by query, doc),
    st as (select * from (select *, row_number() over (partition by query order by score desc, doc) as rank from sp) where rank <= {k}),
    ds as (select a.vec_id query, b.vec_id doc, round(list_dot_product(a.embedding::double[], b.embedding::double[]), 6) score from embeddings a, embeddings b where a.vec_id in (select item_id from benchmark) and b.vec_id in (select doc from ok)),
    dt as (select * from (select *, row_number() over (partition by query order by score desc, doc) as rank from ds) where rank <= {k})"""
_F = """f{n} as (select query, doc, item, sum(p) score from (select query, doc, 1::double / (60 + rank) p from dt union all select query, doc, {w}::double / (60 + rank) from st) join ok using (doc) group by all),
    i{n} as (select query, doc, item, round(score, 9) score from (select *, row_number() over (partition by query, item order by score desc, doc) r from f{n}) where r = 1),
    t{n} as (select *, row_number() over (partition by query order by score desc, doc) as rank from i{n})"""
_H = f"""{_S.format(k=50)}, {_F.format(n=0, w=0.1)}, w as (select query, term, ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) * qtf w from qt left join df using (term), co), tw as (select query, sum(w) total from w group by query),
    ov as (select query, doc, sum(w) found from (select query, doc from t0 where rank <= 5) join w using (query) join (select doc, term from posts) using (doc, term) group by all),
    h as (select t0.query, t0.rank, t0.doc, t0.item, t0.score, coalesce(dt.score, 0) dense_score, coalesce(st.score, 0) bm25_score, round(coalesce(found / total, 0), 6) overlap from t0 left join dt using (query, doc) left join st using (query, doc) left join tw using (query) left join ov using (query, doc) where t0.rank <= 5)"""
_R = "count(*) queries, round(avg(coalesce((rank <= 1)::int, 0)), 6) recall_1, round(avg(coalesce((rank <= 3)::int, 0)), 6) recall_3, round(avg(coalesce((rank <= 5)::int, 0)), 6) recall_5, round(avg(coalesce((rank <= 10)::int, 0)), 6) recall_10, round(avg(case when rank <= 10 then 1.0::double / rank else 0 end), 6) mrr_10"
_C = """c{n} as (select query, doc, item, score, row_number() over (partition by query order by score desc, doc) as rank from (select *, row_number() over (partition by query, item order by score desc, doc) r from {t} join ok using (doc)) where r = 1)"""
_J = """p as (select case when quality = 1 then 'good' else 'bad' end truth, case when regexp_matches(coalesce(text, ''), '[#*$%&|]{2,}|!!') then 'bad' when length(text) < 80 then 'short' else 'good' end pred, toxic, contains(coalesce(text, ''), 'idiot') hit from documents join labels using (doc_id)),
    l as (select distinct truth label from p union select pred from p), m as (select label, (select count(*) from p where truth = label) support, (select count(*) from p where pred = label) predicted, (select count(*) from p where pred = label and truth = label) tp from l),
    f as (select *, coalesce(2.0::double * tp / nullif(predicted + support, 0), 0) f1 from m), s as (select (select round(avg((truth = pred)::int), 6) from p) accuracy, round(avg(f1), 6) macro_f1, round(min(f1), 6) worst_f1 from f where support > 0)"""
ORACLES = {
    "hybrid_search": f"with {_H} select * from h",
    "weight_sweep": f"""with {_S.format(k=20)}, {_C.format(n=0, t="dt")}, {_C.format(n=1, t="st")}, {_F.format(n=2, w=0.1)}, {_F.format(n=3, w=1.0)},
        g as (select distinct a.vec_id query, b.vec_id // 2 item from embeddings a join embeddings b using (label) where a.vec_id in (select item_id from benchmark)), q as (select distinct query from g),
        """
    + ", ".join(f"r{i} as (select query, min(rank) as rank from q left join (select query, rank from {t} join g using (query, item)) using (query) group by query)" for i, t in enumerate(("c0", "c1", "t2", "t3")))
    + " ".join(f"{'union all' if i else ''} select '{c}' channel, {w}::double weight, {_R} from r{i}" for i, (c, w) in enumerate((("dense", "null"), ("bm25", "null"), ("fused", "0.1"), ("fused", "1.0")))),
    "gate_report": f"""with {_H}, b as (select query, max(dense_score) best, max(overlap) ov from h group by query),
        r as (select length(text) > 200 a, case when best is null or best < 0.35 then 'handover' when best >= 0.5 then 'answer' when ov >= 0.6 then 'clarify' else 'handover' end r from benchmark left join b on query = item_id)
        select count(*) filter (a) positives, count(*) filter (not a) negatives, round(count(*) filter (r = 'handover') / count(*), 6) handover_rate, round(coalesce(count(*) filter (not a and r = 'answer') / nullif(count(*) filter (not a), 0), 0), 6) leak_rate,
        round(coalesce(count(*) filter (a and r = 'handover') / nullif(count(*) filter (a), 0), 0), 6) false_handover_rate, round(coalesce(count(*) filter (a and r = 'answer') / nullif(count(*) filter (a), 0), 0), 6) direct_answer_rate from r""",
    "threshold_routes": f"""with {_S.format(k=3)}, b as (select query, max(score) s, count(*) n from dt group by query),
        r as (select case when s is null or s < 0.4 then 'handover' when s >= 0.5 then 'answer' when length(text) < 220 then 'clarify' else 'hedge' end outcome, coalesce(n, 0) n from benchmark left join b on query = item_id)
        select outcome, count(*) queries, sum(case when outcome = 'handover' then 0 else n end)::bigint hits from r group by 1""",
    "rewrite_needs": "select role, count(*) filter (length(trim(text, ' ')) < 60) rewritten, count(*) turns from conversations group by 1",
    "preview_hits": f"with {_H} select query, count(*) hits from h where dense_score >= 0.4 or bm25_score > 0 group by 1",
    "dangling_gold": "select distinct item_id * 17 item from benchmark where item_id * 17 not in (select doc_id // 2 from documents)",
    "top_confusions": f"with {_J} select truth, pred, count(*) n from p where truth <> pred group by all order by n desc, truth, pred limit 2",
    "eval_gates": f"with {_J} select 'accuracy' metric, accuracy as value, 0.85::double as bound, accuracy >= 0.85 passed from s union all select 'macro_f1', macro_f1, 0.8, macro_f1 >= 0.8 from s union all select 'worst_f1', worst_f1, 0.6, worst_f1 >= 0.6 from s",
    "leak_gate": f"with {_J} select count(*) filter (toxic = 1 and not hit) leaks, count(*) filter (toxic = 1 and not hit) = 0 passed from p",
    "baseline_write": """with o as (select o_orderstatus metric, month(o_orderdate) >= 7 late, round(avg(o_totalprice) / 100000, 6) v from orders group by all), g as (select bool_and(round(a.v - b.v, 6) >= -0.01) good from o a join o b on a.metric = b.metric and a.late and not b.late)
        select 'orders' suite, metric, v as value from o, g where late = good""",
}
