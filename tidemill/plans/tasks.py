"""Queries on tickets, tasks, assets and marks; events, orders and documents stand for them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tasks as ops
from ..sources.tables import cut


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _now():
    return F.expr("timestamp_ntz '2024-02-01 00:00:00'")


def dispatch_decisions(spark, d):
    """Handovers by whether they become a task, and its priority."""
    reason = F.when(F.col("event_type") == "error", "no_knowledge").when(F.col("event_type") == "click", "low_confidence").when(F.col("event_type") == "view", "self_harm").when(F.col("event_id") % 2 == 0, "other")
    j = _t(spark, d, "events").select(ops.judge_handover(reason, F.col("props"), F.col("user_id") % 15).alias("j")).select("j.*")
    return j.groupBy("why", "priority").agg(F.count("*").alias("n"))


def _tasks(spark, d):
    e = _t(spark, d, "events").where("event_type in ('click', 'error')")
    status = F.element_at(F.array(*map(F.lit, ("pending", "running", "failed", "succeeded"))), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select(
        F.col("event_id").alias("id"), "user_id", F.floor(F.col("value") / 10).alias("priority"), status.alias("status"), (F.col("event_id") % 3).cast("int").alias("attempts"), F.lit(3).alias("max_attempts"),
        F.lit(None).cast("string").alias("worker"), F.lit(None).cast("timestamp_ntz").alias("claimed_at"), F.lit(None).cast("timestamp_ntz").alias("finished_at"), F.lit("").alias("error"), (F.col("event_id") % 50).alias("root_id"),
    )


def worker_round(spark, d):
    """Tasks after a worker ran fifty, of which every other id failed."""
    run = lambda mine: mine.select("id", F.when(F.col("id") % 8 == 0, "failed").otherwise("succeeded").alias("outcome"), F.lit("no answer").alias("error"))
    t = ops.run_pending(_tasks(spark, d), run, F.lit("w1"), 50, _now())
    return t.groupBy("status", "attempts", F.coalesce("worker", F.lit("-")).alias("worker"), F.col("finished_at").isNotNull().alias("done")).agg(F.count("*").alias("n"), F.count_if(F.col("error") != "").alias("errors"))


def task_chain(spark, d):
    """The tasks that followed from task 7."""
    return ops.chain(_tasks(spark, d), 7).select("id", "status")


def run_report(spark, d):
    """Events by type and whether their value is high."""
    e = _t(spark, d, "events").select(F.col("event_type").alias("kind"), F.when(F.col("value") > 50, "written").otherwise("skipped").alias("outcome"))
    return ops.run_report(e)


def poll_outcomes(spark, d):
    """Pending jobs after a poll; queries of every fifth fail, others are answered for even ids."""
    p = _t(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"), F.lit("pending").alias("status"))
    state = F.when(F.col("id") % 3 == 0, "succeeded").when(F.col("id") % 3 == 1, "failed").otherwise("running")
    a = p.where("id % 2 = 0").select("id", state.alias("state"), (F.col("id") % 5 == 0).alias("failed_query"))
    return ops.poll(p, a).groupBy("status", "poll").agg(F.count("*").alias("n"))


def _items(spark, d):
    n = F.col("doc_id")
    status = F.when(n % 3 == 0, "approved").when(n % 3 == 1, "pending").otherwise("revised")
    return _t(spark, d, "documents").select(
        n.alias("id"), F.col("text").alias("content"), status.alias("review_status"), F.when(n % 4 == 0, "done").when(n % 4 == 1, "stale").otherwise("pending").alias("embedding_status"), (n % 10 == 0).alias("deleted"),
        F.concat(F.lit("live:"), (n % 40).cast("string"), F.lit("#"), n.cast("string")).alias("source_ref"), F.lit(None).cast("timestamp_ntz").alias("deleted_at"),
    )


def approvals(spark, d):
    """Items by status once every second pending one was approved, and every fifth rejected too."""
    i = _items(spark, d)
    v = i.where("id % 2 = 0").select("id", F.lit(True).alias("approve")).unionAll(i.where("id % 5 = 0").select("id", F.lit(False).alias("approve")))
    return ops.approve(i, v).groupBy("review_status").agg(F.count("*").alias("items"), F.sum("id").alias("ids"))


def ticket_answers(spark, d):
    """Tickets after answers, some of them blank."""
    e = _t(spark, d, "events").where("event_type = 'error'")
    t = e.select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 7 == 0, "closed").otherwise("open").alias("status"), F.lit("").alias("answer"), F.lit(None).cast("long").alias("knowledge_item_id"))
    a = e.where("event_id % 3 = 0").select(F.col("event_id").alias("ticket_id"), F.when(F.col("event_id") % 2 == 0, "use it so").otherwise(" ").alias("answer"), (F.col("event_id") * 10).alias("knowledge_item_id"))
    a = a.unionAll(a.withColumn("knowledge_item_id", F.col("knowledge_item_id") + 1))
    return ops.answer_tickets(t, a).groupBy("status").agg(F.count("*").alias("n"), F.sum("knowledge_item_id").alias("items"))


def _aliases(spark, d):
    p = _t(spark, d, "part")
    stored = p.where("p_partkey % 3 = 0").select((F.col("p_partkey") % 25).alias("product_id"), F.col("p_name").alias("alias")).distinct().withColumn("times", F.lit(5))
    return ops.propose_aliases(stored, p.select((F.col("p_partkey") % 25).alias("product_id"), F.when(F.col("p_partkey") % 11 != 0, F.col("p_name")).alias("alias")))


def alias_counts(spark, d):
    """How often each name was used for a product."""
    return _aliases(spark, d)


def alias_lists(spark, d):
    """Products' names once those used often are approved."""
    p = _t(spark, d, "part").select((F.col("p_partkey") % 25).alias("product_id")).distinct().withColumn("aliases", F.array(F.lit("old name")))
    return ops.apply_aliases(p, _aliases(spark, d).where("times > 7")).select("product_id", F.array_join("aliases", "|").alias("aliases"))


def index_candidates(spark, d):
    """The first hundred items to index."""
    return ops.index_candidates(_items(spark, d), 100).select("id", "embedding_status")


def stale_marks(spark, d):
    """Items by state once multiples of three are stale and multiples of six done again."""
    i = _items(spark, d)
    m = ops.mark(ops.mark(i, i.where("id % 3 = 0"), "stale"), i.where("id % 6 = 0"), "done")
    return m.groupBy("embedding_status", "deleted").agg(F.count("*").alias("items"))


def index_build(spark, d):
    """An index after an incremental run, by provider and the length of its texts."""
    i = _items(spark, d)
    index = i.where("id % 4 = 0").select("id", F.lit("a").alias("provider"), F.lit("old").alias("text"))
    built = ops.build_index(i, index, lambda rows: rows, "a", limit=200)
    return built.groupBy("provider").agg(F.count("*").alias("vectors"), F.sum(F.length("text")).alias("chars"))


def index_providers(spark, d):
    """Vectors by provider."""
    return ops.providers(_t(spark, d, "embeddings").select(F.concat(F.lit("p"), F.col("label") % 3).alias("provider")))


def superseded(spark, d):
    """Items by state once those of live:7 are superseded."""
    return ops.supersede(_items(spark, d), "source_ref", "live:7", _now()).groupBy("deleted", F.col("deleted_at").isNotNull().alias("now")).agg(F.count("*").alias("items"), F.sum("id").alias("ids"))


def replaced_attributes(spark, d):
    """Line items by order where every tenth order's are replaced by one."""
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_quantity")
    new = _t(spark, d, "orders").where("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1000.0).alias("l_quantity"))
    return ops.replace_wholesale(li, new, "l_orderkey").groupBy((F.col("l_orderkey") % 10).alias("digit")).agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("quantity"))


def _orders(spark, d):
    status = F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "O", "paid").otherwise("shipped")
    return _t(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), status.alias("status"), F.lit(None).cast("string").alias("prior_status"))


def refunds(spark, d):
    """Orders once even ones ask for a refund, and multiples of four are refused."""
    o = _orders(spark, d)
    r = ops.refuse_refund(ops.refund(o, o.where("order_id % 2 = 0")), o.where("order_id % 4 = 0"))
    return r.groupBy("status", F.coalesce("prior_status", F.lit("-")).alias("prior")).agg(F.count("*").alias("orders"), F.sum("order_id").alias("ids"))


def released_orders(spark, d):
    """Orders by status once multiples of three that are pending have run out of time."""
    o = _orders(spark, d)
    return ops.release_expired(o, o.where("order_id % 3 = 0")).groupBy("status").agg(F.count("*").alias("orders"))


def _assets(spark, d):
    n = F.col("page_id")
    return _t(spark, d, "pages").select(
        n.alias("asset_id"), (n % 20).alias("product_id"), F.when(n % 4 == 0, "running").otherwise("succeeded").alias("status"), F.when(n % 5 == 0, " ").otherwise(F.col("url")).alias("path"), F.when(n % 2 == 0, "image").otherwise("video").alias("modality"),
        F.array(F.when(n % 3 == 0, "home").otherwise("work")).alias("scenes"), (n * 7 % 100).alias("created_at"),
    )


def _reviewed(spark, d):
    a = _assets(spark, d)
    n = F.col("asset_id")
    verdicts = a.select("asset_id", F.when(n % 7 == 0, "skip").when(n % 3 == 0, "reject").otherwise("approve").alias("decision"), F.when(n % 2 == 0, "blurred").alias("note")).unionAll(a.limit(1).select(F.lit(-1).cast("long"), F.lit("approve"), F.lit("")))
    return ops.review_assets(a, verdicts)


def asset_reviews(spark, d):
    """Assets by status after review, and refused decisions by why."""
    a, refused = _reviewed(spark, d)
    return a.groupBy(F.lit("asset").alias("kind"), F.col("status").alias("what")).agg(F.count("*").alias("n")).unionAll(refused.groupBy(F.lit("refused").alias("kind"), F.col("why").alias("what")).agg(F.count("*").alias("n")))


def asset_search(spark, d):
    """Twenty approved images for home."""
    return ops.find_assets(_reviewed(spark, d)[0], modality="image", scene="work", status="approved", limit=20).select("asset_id", "created_at")


def answer_assets(spark, d):
    """Up to three assets of each answer, its items' before its product's."""
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("answer"), F.array(F.col("o_orderkey") % 30, F.col("o_custkey") % 30).alias("item_ids"), (F.col("o_custkey") % 20).alias("product_id"))
    of_items = _assets(spark, d).select((F.col("asset_id") % 60).alias("item_id"), "asset_id").where("item_id % 3 = 0")
    return ops.answer_assets(o, of_items, _assets(spark, d).select("product_id", "asset_id"), 3).select("answer", "asset_id", "source", F.col("rank").cast("long").alias("rank"))


def new_files(spark, d):
    """Pages whose content no even page has, one for each content."""
    p = _t(spark, d, "pages").select("page_id", F.col("url").alias("path"), F.encode("html", "utf-8").alias("content"))
    stored = p.where("page_id % 2 = 0").select(F.sha2("content", 256).alias("file_sha256"))
    return ops.new_files(p, stored)


def trace_sink(spark, d):
    """Traces with strings cut and scores held within bounds."""
    t = _t(spark, d, "documents").select("doc_id", F.col("text").alias("rewritten_query"), F.col("text").alias("error"), (F.col("doc_id") % 40 - 20).cast("double").alias("max_score"))
    return ops.trace_rows(t).groupBy("max_score").agg(F.sum(F.length("rewritten_query")).alias("query_chars"), F.sum(F.length("error")).alias("error_chars"))


def recent_traces(spark, d):
    """The latest thirty handovers."""
    t = _t(spark, d, "events").select(F.col("event_id").alias("id"), "user_id", (F.col("event_type") == "error").alias("handover"))
    return ops.recent_traces(t, 30, True).select("id", "user_id")


def merchant_orders(spark, d):
    """The latest orders to be paid, two hundred at most whatever is asked for."""
    return ops.merchant_orders(_orders(spark, d), "pending", 1000).select("order_id", "status")


def job_stats(spark, d):
    """A run's figures as JSON."""
    return ops.job_stats("b1", _t(spark, d, "orders").agg(F.count("*").alias("orders"), F.countDistinct("o_custkey").alias("customers")))


def outcome_log(spark, d):
    """Outcomes by gate once new ones are appended; those stored stay."""
    c = _t(spark, d, "conversations").select("conv_id").distinct()
    stored = c.where("conv_id % 2 = 0").select("conv_id", F.lit("gate1").alias("gate"))
    new = c.where("conv_id % 3 = 0").select("conv_id", F.lit("gate2").alias("gate"))
    return ops.append_once(stored, new.unionAll(new), ["conv_id"]).groupBy("gate").agg(F.count("*").alias("n"), F.sum("conv_id").alias("ids"))


def layer_counts(spark, d):
    """Rows and pending rows of each layer."""
    return ops.layer_counts(ods=_t(spark, d, "conversations"), dws=_items(spark, d).withColumn("pending", F.col("review_status") == "pending"), orders=_orders(spark, d).withColumn("pending", F.col("status") == "pending"))


def funnel_survival(spark, d):
    """Sessions and items from gate to gate: what survives, and the yield where sessions become items."""
    t = _t(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"))
    n = t.agg(F.count("*").alias("a"), F.count_if(F.expr("turns >= 3")).alias("b"), F.count_if(F.expr("turns >= 3 and chars > 400")).alias("c"), F.sum(F.when(F.expr("turns >= 3 and chars > 400"), F.col("turns"))).alias("e"), F.sum(F.when(F.expr("turns >= 4 and chars > 400"), F.col("turns"))).alias("f"))
    stage = lambda pos, gate, a, u, b, v: F.struct(F.lit(pos).alias("pos"), F.lit(gate).alias("gate"), F.col(a).alias("input"), F.lit(u).alias("input_unit"), F.col(b).alias("output"), F.lit(v).alias("output_unit"))
    stages = cut(n.select(F.explode(F.array(stage(1, "gate1", "a", "session", "b", "session"), stage(2, "gate2", "b", "session", "c", "session"), stage(3, "gate3", "c", "session", "e", "item"), stage(4, "gate4", "e", "item", "f", "item"))).alias("s")).select("s.*"))
    return ops.funnel_survival(stages)


QUERIES = {
    f.__name__: f
    for f in (
        dispatch_decisions, worker_round, task_chain, run_report, poll_outcomes, approvals, ticket_answers, alias_counts, alias_lists, index_candidates, stale_marks, index_build, index_providers, superseded, replaced_attributes,
        refunds, released_orders, asset_reviews, asset_search, answer_assets, new_files, trace_sink, recent_traces, merchant_orders, job_stats, outcome_log, layer_counts, funnel_survival,
    )
}

_K = "k as (select event_id id, floor(value / 10)::bigint priority, ['pending', 'running', 'failed', 'succeeded'][event_id % 4 + 1] status, (event_id % 3)::int attempts, event_id % 50 root_id from events where event_type in ('click', 'error'))"
_I = """i as (select doc_id id, text as content, case doc_id % 3 when 0 then 'approved' when 1 then 'pending' else 'revised' end review_status, case doc_id % 4 when 0 then 'done' when 1 then 'stale' else 'pending' end embedding_status, doc_id % 10 = 0 deleted, 'live:' || (doc_id % 40) || '#' || doc_id source_ref from documents)"""
_C = f"{_I}, c as (select * from i where review_status in ('approved', 'revised') and embedding_status in ('pending', 'stale') and not deleted order by id limit {{n}})"
_A = """al as (select product_id, alias, sum(times)::bigint times from (select distinct p_partkey % 25 product_id, p_name alias, 5::bigint times from part where p_partkey % 3 = 0 union all select p_partkey % 25, p_name, 1 from part where p_partkey % 11 <> 0) group by all)"""
_O = "o as (select o_orderkey id, o_custkey, case o_orderstatus when 'P' then 'pending' when 'O' then 'paid' else 'shipped' end status from orders)"
_P = """a as (select page_id id, page_id % 20 product_id, case when page_id % 4 = 0 then 'running' else 'succeeded' end status, case when page_id % 5 = 0 then ' ' else url end path, case when page_id % 2 = 0 then 'image' else 'video' end modality, case when page_id % 3 = 0 then 'home' else 'work' end scene, page_id * 7 % 100 created_at from pages),
    v as (select id, case when id % 7 = 0 then 'skip' when id % 3 = 0 then 'reject' else 'approve' end decision, id % 2 = 0 noted from a),
    j as (select a.*, decision, case when decision = 'skip' then 'unknown_decision' when status <> 'succeeded' then 'not_succeeded' when decision = 'approve' and trim(path) = '' then 'no_file' when decision = 'reject' and not noted then 'no_note' end why from a join v using (id)),
    f as (select id, product_id, modality, scene, created_at, case when why is null then case decision when 'approve' then 'approved' else 'rejected' end else status end status from j)"""
ORACLES = {
    "dispatch_decisions": """with e as (select case event_type when 'error' then 'no_knowledge' when 'click' then 'low_confidence' when 'view' then 'self_harm' else case when event_id % 2 = 0 then 'other' end end r, length(regexp_replace(lower(props), '[^a-z0-9]+', '', 'g')) n, user_id % 15 t from events),
        w as (select case when r is null then 'no_reason' when r = 'self_harm' then 'never' when r = 'other' then 'unlisted' when n < 4 then 'too_short' else 'dispatch' end why, r, t from e)
        select why, (case when why = 'dispatch' then case r when 'no_knowledge' then 20 else 10 end + least(t, 10) else 0 end)::int priority, count(*) n from w group by all""",
    "worker_round": f"""with {_K}, t as (select id from k where status = 'pending' order by priority desc, id limit 50), c as (select k.id, t.id is not null got, case when t.id is not null then 'running' else status end status, attempts + (t.id is not null)::int attempts from k left join t on t.id = k.id)
        select case when got then case when id % 8 <> 0 then 'succeeded' when attempts < 3 then 'pending' else 'failed' end else status end status, attempts, case when got then 'w1' else '-' end worker, got and (id % 8 <> 0 or attempts >= 3) done, count(*) n, count(*) filter (got) errors from c group by all""",
    "task_chain": f"with {_K} select id, status from k where root_id = 7",
    "run_report": "select event_type kind, case when value > 50 then 'written' else 'skipped' end outcome, count(*) runs from events group by all",
    "poll_outcomes": """with p as (select o_orderkey id from orders where o_orderstatus = 'P'), a as (select id, case when id % 2 = 1 then 'not_asked' when id % 5 = 0 then 'query_failed' when id % 3 < 2 then 'settled' else 'waiting' end poll from p)
        select case when poll = 'settled' then case id % 3 when 0 then 'succeeded' else 'failed' end else 'pending' end status, poll, count(*) n from a group by all""",
    "approvals": f"with {_I} select case when review_status <> 'pending' then review_status when id % 5 = 0 then 'rejected' when id % 2 = 0 then 'approved' else 'pending' end review_status, count(*) items, sum(id)::bigint ids from i group by 1",
    "ticket_answers": "with t as (select event_id id, event_id % 7 <> 0 and event_id % 6 = 0 hit from events where event_type = 'error') select case when id % 7 = 0 then 'closed' when hit then 'answered' else 'open' end status, count(*) n, sum(case when hit then id * 10 end)::bigint items from t group by 1",
    "alias_counts": f"with {_A} select * from al",
    "alias_lists": f"with {_A} select product_id, 'old name' || coalesce('|' || string_agg(alias, '|' order by alias) filter (times > 7), '') aliases from (select distinct p_partkey % 25 product_id from part) left join al using (product_id) group by 1",
    "index_candidates": f"with {_C.format(n=100)} select id, embedding_status from c",
    "stale_marks": f"with {_I} select case when not deleted and id % 6 = 0 then 'done' when not deleted and id % 3 = 0 then 'stale' else embedding_status end embedding_status, deleted, count(*) items from i group by all",
    "index_build": f"with {_C.format(n=200)} select 'a' provider, count(*) vectors, sum(n)::bigint chars from (select length(content) n from c union all select 3 from i where id % 4 = 0 and id not in (select id from c))",
    "index_providers": "select 'p' || (label % 3) provider, count(*) vectors from embeddings group by 1",
    "superseded": f"with {_I} select deleted or id % 40 = 7 deleted, id % 40 = 7 and not deleted \"now\", count(*) items, sum(id)::bigint ids from i group by 1, 2",
    "replaced_attributes": "select k % 10 digit, count(*) as lines, sum(q) quantity from (select l_orderkey k, l_quantity q from lineitem where l_orderkey % 10 <> 0 union all select o_orderkey, 1000 from orders where o_orderkey % 10 = 0 union all select l_orderkey, l_quantity from lineitem where l_orderkey % 10 = 0 and l_orderkey not in (select o_orderkey from orders)) group by 1",
    "refunds": f"with {_O}, r as (select id, status, id % 2 = 0 and id % 4 <> 0 and status <> 'pending' hit from o) select case when hit then 'refunding' else status end status, case when hit then status else '-' end prior, count(*) orders, sum(id)::bigint ids from r group by 1, 2",
    "released_orders": f"with {_O} select case when status = 'pending' and id % 3 = 0 then 'cancelled' else status end status, count(*) orders from o group by 1",
    "asset_reviews": f"with {_P} select 'asset' kind, status what, count(*) n from f group by status union all select 'refused', why, count(*) from j where why is not null group by why union all select 'refused', 'unknown_asset', 1",
    "asset_search": f"with {_P} select id asset_id, created_at from f where status = 'approved' and modality = 'image' and scene = 'work' order by created_at desc, id limit 20",
    "answer_assets": f"""with {_P}, n as (select o_orderkey answer, unnest([o_orderkey % 30, o_custkey % 30]) item_id from orders),
        u as (select answer, id, 0 source from n join a on item_id = id % 60 and id % 60 % 3 = 0 union all select o_orderkey, id, 1 from orders join a on o_custkey % 20 = product_id),
        m as (select answer, id asset_id, min(source) source from u group by all), r as (select *, row_number() over (partition by answer order by source, asset_id) as rank from m) select * from r where rank <= 3""",
    "new_files": "with p as (select page_id, url path, sha256(html) file_sha256 from pages) select file_sha256, min(path) path from p where file_sha256 not in (select file_sha256 from p where page_id % 2 = 0) group by 1",
    "trace_sink": "select least(greatest(doc_id % 40 - 20, -9), 9)::double max_score, sum(length(substr(coalesce(text, ''), 1, 512)))::bigint query_chars, sum(length(substr(coalesce(text, ''), 1, 512)))::bigint error_chars from documents group by 1",
    "recent_traces": "select event_id id, user_id from events where event_type = 'error' order by event_id desc limit 30",
    "merchant_orders": f"with {_O} select id order_id, status from o where status = 'pending' order by id desc limit 200",
    "job_stats": "select 'b1' batch_id, '{\"orders\":' || count(*) || ',\"customers\":' || count(distinct o_custkey) || '}' stats from orders",
    "outcome_log": "with c as (select distinct conv_id from conversations) select case when conv_id % 2 = 0 then 'gate1' else 'gate2' end gate, count(*) n, sum(conv_id)::bigint ids from c where conv_id % 2 = 0 or conv_id % 3 = 0 group by 1",
    "layer_counts": f"with {_I}, {_O} select 'ods' layer, count(*) as rows, 0::bigint pending from conversations union all select 'dws', count(*), count(*) filter (review_status = 'pending') from i union all select 'orders', count(*), count(*) filter (status = 'pending') from o",
    "funnel_survival": """with t as (select conv_id, count(*) n, sum(length(text)) c from conversations group by 1), x as (select count(*) a, count(*) filter (n >= 3) b, count(*) filter (n >= 3 and c > 400) c, sum(n) filter (n >= 3 and c > 400) e, sum(n) filter (n >= 4 and c > 400) f from t)
        select 'gate1' gate, a::bigint as input, b::bigint as output, 'survival' kind, round(b * 100 / a, 6) metric from x union all select 'gate2', b, c, 'survival', round(c * 100 / a, 6) from x union all select 'gate3', c, e, 'yield', round(e / c, 6) from x union all select 'gate4', e, f, 'survival', round(f * 100 / e, 6) from x""",
}
