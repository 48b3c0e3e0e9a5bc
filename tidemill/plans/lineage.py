"""Queries on chains of tasks, deletion through all layers, agreement of raters, and timers."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import agreement, kpi, lineage
from ..streaming import timers


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def task_lineage(spark, d):
    """Chains of events of one user, twelve hours apart at most, each following from the one before; the first of every seventh chain follows from its last, so that it is a circle."""
    e = _t(spark, d, "events")
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    before = F.lag("event_id").over(w)
    far = F.coalesce(F.col("ts") > F.lag("ts").over(w) + F.expr("INTERVAL 12 HOURS"), F.lit(True))
    t = e.withColumn("_before", F.when(~far, before)).withColumn("_s", F.sum(far.cast("int")).over(w))
    last = W.partitionBy("user_id", "_s").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    t = t.withColumn("_last", F.last("event_id").over(last)).withColumn("_first", F.first("event_id").over(last))
    parent = F.when(F.col("_before").isNull() & (F.col("_first") % 7 == 0) & (F.col("_first") != F.col("_last")), F.col("_last")).otherwise(F.col("_before"))
    status = F.element_at(F.array(*map(F.lit, ("succeeded", "running", "failed", "pending"))), (F.col("event_id") % 4 + 1).cast("int"))
    return lineage.chain_outcomes(t.select(F.col("event_id").alias("id"), parent.alias("parent_id"), status.alias("status")))


def _layers(spark, d):
    s = _t(spark, d, "conversations").select(F.col("conv_id").alias("id"), F.concat(F.lit("user:"), (F.col("conv_id") % 23).cast("string")).alias("source_ref")).distinct()
    items = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("session:"), F.floor(F.col("doc_id") / 4).cast("string")).alias("source_ref"))
    vectors = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("item:"), (F.col("vec_id") * 2).cast("string")).alias("source_ref"))
    published = _t(spark, d, "labels").select(F.col("doc_id").alias("id"), F.concat(F.lit("vector:"), F.col("doc_id").cast("string")).alias("source_ref"))
    return {"session": s, "item": items, "vector": vectors, "snapshot": published}


def erasure(spark, d):
    """What goes from sessions, items, vectors and snapshots when every fifth user asks to be forgotten, and what is left."""
    layers = _layers(spark, d)
    users = layers["session"].select(F.col("source_ref").alias("ref")).distinct().where(F.substring_index("ref", ":", -1).cast("int") % 5 == 2)
    left, log = lineage.erased(layers, users)
    out = log.where("layer <> 'user'").groupBy("layer", F.lit("erased").alias("what")).agg(F.count("*").alias("n"), F.sum(F.col("id").cast("long")).alias("ids"))
    for name, rows in left.items():
        out = out.unionAll(rows.agg(F.count("*").alias("n"), F.sum("id").alias("ids")).select(F.lit(name), F.lit("left"), "n", "ids"))
    return out


def retained(spark, d):
    """Vectors and items that go with sessions of orders more than five years old."""
    old = lineage.past_retention(_t(spark, d, "orders").select(F.concat(F.lit("session:"), F.col("o_orderkey").cast("string")).alias("ref"), "o_orderdate"), "o_orderdate", F.expr("timestamp_ntz '2001-01-01 00:00:00'"), 365 * 5)
    layers = _layers(spark, d)
    log = lineage.derived({k: layers[k] for k in ("item", "vector")}, old)
    return log.where("layer <> 'session'").groupBy("layer", "depth").agg(F.count("*").alias("n"), F.sum(F.col("id").cast("long")).alias("ids"))


def _ratings(spark, d):
    far = (F.col("l_quantity") > 44).cast("int")
    noisy = F.when(F.col("l_returnflag") == "N", far).otherwise(F.when(F.col("l_discount") > 0.05, F.col("l_linenumber") % 3).otherwise(far))
    value = F.when(F.col("l_linenumber") != 3, F.col("l_orderkey") % 5 + 1 + noisy)
    return _t(spark, d, "lineitem").select(F.col("l_returnflag").alias("batch"), F.col("l_orderkey").alias("unit"), F.col("l_linenumber").alias("rater"), value.alias("value"))


def rater_alpha(spark, d):
    """Agreement of the lines of an order as raters, a third of whom say nothing."""
    a = agreement.alpha(_ratings(spark, d), "batch", "unit", "value")
    return a.select("batch", F.col("pairable").cast("long").alias("pairable"), *[F.round(s, 6).alias(s) for s in agreement.SCALES])


def judge_gate(spark, d):
    """Whether a judge may go live by batch: raters first, then rank correlation, mean error and far errors."""
    judged = _t(spark, d, "orders").select(F.col("o_orderkey").alias("unit"), (F.col("o_orderkey") % 5 + 1 + F.when(F.col("o_totalprice") > 200000, 1).otherwise(0)).cast("double").alias("score"))
    batches = _t(spark, d, "lineitem").select(F.col("l_returnflag").alias("batch"), F.col("l_orderkey").alias("unit")).distinct()
    g = agreement.judge_gate(_ratings(spark, d), batches.join(judged, "unit").select("batch", "unit", "score"))
    return g.select("batch", "sample_count", *[F.round(c, 6).alias(c) for c in ("alpha", "rho", "mae", "far_share")], "why", "passed")


def _orders(spark, d):
    kind = F.when(F.col("event_type").isin("click", "view"), "placed").when(F.col("event_type") == "purchase", "paid").when(F.col("event_type") == "error", "cancelled")
    return _t(spark, d, "events").select(F.concat_ws("-", "user_id", F.dayofmonth("ts")).alias("order_id"), "event_id", F.col("ts").alias("at"), kind.alias("kind"), F.concat(F.lit("sku"), (F.col("user_id") % 9).cast("string")).alias("sku"), F.floor("value").cast("long").alias("qty"))


def order_timeouts(spark, d):
    """Orders (a user's events of a day) by how they ended within six hours, and the stock they gave back."""
    o = timers.order_outcomes(_orders(spark, d), 6 * 3600)
    return o.groupBy("outcome").agg(F.count("*").alias("orders"), F.sum("released").alias("released"), F.date_format(F.max("at"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("latest"))


def need_spans(spark, d):
    """What each user's events add up to, when no two are over eight hours apart."""
    e = _t(spark, d, "events").select(F.col("user_id").cast("string").alias("session"), "event_id", F.col("ts").alias("at"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("field"), F.get_json_object("props", "$.k").alias("value"))
    n = timers.needs_by_session(e, 8 * 3600)
    said = F.array_join(F.transform(F.array_sort(F.map_entries("needs")), lambda x: F.concat_ws("=", x["key"], x["value"])), ",")
    return n.select("session", F.unix_micros("start").alias("start_us"), F.unix_micros("last").alias("last_us"), "events", said.alias("needs"))


def kpi_scores(spark, d):
    """Quality of each user's day: clicks and views are theirs, purchases and signups the staff's, and k of 99 a word that fails it."""
    e = _t(spark, d, "events")
    role = F.when(F.col("event_type").isin("click", "view"), "user").when(F.col("event_type").isin("purchase", "signup"), "agent").otherwise("system")
    t = e.select(F.concat_ws("-", "user_id", F.dayofmonth("ts")).alias("session"), F.col("ts").alias("at"), F.col("event_id").alias("turn"), role.alias("role"), F.get_json_object("props", "$.k").alias("text"))
    m = kpi.scores(kpi.metrics(t, _POST), _POST)
    return m.select("session", *[F.round(c, 6).alias(c) for c in ("first_s", "mean_s", "score")], "replies", "late", "silences", "followed", "vetoed", "grade")


_POST = kpi.Template(late_s=36000.0, silent_s=7200.0, prompt_s=3600.0, veto=("99",))

QUERIES = {f.__name__: f for f in (kpi_scores, task_lineage, erasure, retained, rater_alpha, judge_gate, order_timeouts, need_spans)}

_L = """s as (select distinct conv_id id, 'user:' || conv_id % 23 ref from conversations), i as (select doc_id id, 'session:' || doc_id // 4 ref from documents), v as (select vec_id id, 'item:' || vec_id * 2 ref from embeddings), p as (select doc_id id, 'vector:' || doc_id ref from labels),
    e as (select ref a, 'session:' || id b from s union select ref, 'item:' || id from i union select ref, 'vector:' || id from v union select ref, 'snapshot:' || id from p)"""
_R = """x as (select l_returnflag batch, l_orderkey unit, case when l_linenumber <> 3 then l_orderkey % 5 + 1 + case when l_returnflag = 'N' then (l_quantity > 44)::int when l_discount > 0.05 then l_linenumber % 3 else (l_quantity > 44)::int end end v, row_number() over () r from lineitem), y as (select * from x where v is not null),
    m as (select batch, unit, count(*) m from y group by all having count(*) > 1), z as (select * from y join m using (batch, unit)), t as (select batch, v, count(*) n from z group by all), k as (select *, sum(n) over (partition by batch order by v) - n / 2 mid from t),
    o as (select a.batch, sum((a.v <> b.v)::int / (a.m - 1)) nominal, sum((ka.mid - kb.mid) ** 2 / (a.m - 1)) ordinal, sum((a.v - b.v) ** 2 / (a.m - 1)) as interval from z a join z b on a.batch = b.batch and a.unit = b.unit and a.r <> b.r join k ka on ka.batch = a.batch and ka.v = a.v join k kb on kb.batch = b.batch and kb.v = b.v group by 1),
    d as (select a.batch, sum(a.n * b.n * (a.v <> b.v)::int) nominal, sum(a.n * b.n * (a.mid - b.mid) ** 2) ordinal, sum(a.n * b.n * (a.v - b.v) ** 2) as interval from k a join k b on a.batch = b.batch group by 1), n as (select batch, sum(n) n from t group by 1),
    al as (select n.batch, n.n::bigint pairable, 1 - (n.n - 1) * o.nominal / nullif(d.nominal, 0) nominal, 1 - (n.n - 1) * o.ordinal / nullif(d.ordinal, 0) ordinal, 1 - (n.n - 1) * o.interval / nullif(d.interval, 0) as interval from n join o using (batch) join d using (batch))"""
ORACLES = {
    "kpi_scores": """with e as (select user_id || '-' || day(ts) s, epoch_us(ts) t, event_id, case when event_type in ('click', 'view') then 'user' when event_type in ('purchase', 'signup') then 'agent' end r, json_extract_string(props, '$.k') k from events),
        a as (select *, (t - lag(t) over w) / 1e6 g, lag(r) over w b from e where r is not null window w as (partition by s order by t, event_id)),
        m as (select s, (min(t) filter (r = 'agent' and b = 'user') - min(t) filter (r = 'user')) / 1e6 f, avg(g) filter (r = 'agent' and b = 'user') m, count(*) filter (r = 'agent' and b = 'user') replies, count(*) filter (r = 'agent' and b = 'user' and g > 36000) late,
            count(*) filter (b = 'agent' and g > 7200) silences, count(*) filter (b = 'agent' and g > 7200 and r = 'agent') followed, coalesce(bool_or(r = 'agent' and contains(k, '99')), false) vetoed from a group by 1),
        x as (select *, case when f is not null then greatest(0, least(1, (36000 - f) / 32400)) end xf, case when m is not null then greatest(0, least(1, (36000 - m) / 32400)) end xm, case when replies > 0 then 1 / (1 + late) end xl, followed / nullif(silences, 0) xs from m),
        y as (select *, (coalesce(8 * xf, 0) + coalesce(7 * xm, 0) + coalesce(5 * xl, 0) + coalesce(5 * xs, 0)) * 100 / nullif(8 * (xf is not null)::int + 7 * (xm is not null)::int + 5 * (xl is not null)::int + 5 * (xs is not null)::int, 0) sc from x)
        select s session, round(f, 6) first_s, round(m, 6) mean_s, round(case when vetoed then 0 else sc end, 6) score, replies, late, silences, followed, vetoed, case when vetoed then 'veto' when sc is null then 'unrated' else 'rated' end grade from y""",
    "task_lineage": """with recursive a as (select *, coalesce(ts > lag(ts) over w + interval 12 hours, true) far, lag(event_id) over w before from events window w as (partition by user_id order by ts, event_id)), b as (select *, sum(far::int) over (partition by user_id order by ts, event_id) s from a),
        c as (select *, first_value(event_id) over w f, last_value(event_id) over (w rows between unbounded preceding and unbounded following) l from b window w as (partition by user_id, s order by ts, event_id)),
        t as (select event_id id, case when far then case when f % 7 = 0 and f <> l then l end else before end parent, ['succeeded', 'running', 'failed', 'pending'][event_id % 4 + 1] status from c),
        g as (select id, f, l from (select event_id id, f, l from c)), q as (select f, l, case when f % 7 = 0 and f <> l then min(id) else f end root from g group by f, l),
        r as (select root, root id, 0 depth from q union all select r.root, t.id, depth + 1 from r join t on t.parent = r.id where t.id <> r.root)
        select root, count(*) tasks, max(depth)::bigint depth, count(*) filter (status = 'failed') failed, count(*) filter (status in ('pending', 'running')) open from r join t using (id) group by 1""",
    "erasure": f"""with recursive {_L}, r as (select distinct ref x from s where split_part(ref, ':', 2)::int % 5 = 2 union select b from r join e on a = x), g as (select split_part(x, ':', 1) layer, split_part(x, ':', 2)::bigint id from r where x not like 'user:%'),
        every as (select 'session' layer, id from s union all select 'item', id from i union all select 'vector', id from v union all select 'snapshot', id from p)
        select layer, 'erased' what, count(*) n, sum(id)::bigint ids from g group by 1 union all select l, 'left', count(id), sum(id)::bigint from (select unnest(['session', 'item', 'vector', 'snapshot']) l) left join (select * from every anti join g using (layer, id)) on l = layer group by 1""",
    "retained": f"""with {_L}, o as (select 'session:' || o_orderkey x from orders where o_orderdate < timestamp '2001-01-01' - interval 1825 days), a as (select b x from e semi join o on a = x where b like 'item:%'), c as (select b x from e semi join a on e.a = a.x where b like 'vector:%')
        select split_part(x, ':', 1) layer, depth, count(*) n, sum(split_part(x, ':', 2)::bigint)::bigint ids from (select x, 1 depth from a union all select x, 2 from c) group by all""",
    "rater_alpha": f"with {_R} select batch, pairable, round(nominal, 6) nominal, round(ordinal, 6) ordinal, round(interval, 6) as interval from al",
    "judge_gate": f"""with {_R}, j as (select o_orderkey unit, o_orderkey % 5 + 1 + (o_totalprice > 200000)::int score from orders), gm as (select batch, unit, median(v) golden from y group by all), w as (select batch, golden, score from gm join j using (unit)),
        rk as (select *, rank() over (partition by batch order by golden) + (count(*) over (partition by batch, golden) - 1) / 2 ra, rank() over (partition by batch order by score) + (count(*) over (partition by batch, score) - 1) / 2 rb from w),
        f as (select batch, count(*) sample_count, avg(abs(golden - score)) mae, avg((abs(golden - score) >= 2)::int) far_share, corr(ra, rb) rho from rk group by 1),
        u as (select batch, sample_count, round(ordinal, 6) alpha, round(rho, 6) rho, round(mae, 6) mae, round(far_share, 6) far_share, case when not coalesce(ordinal >= 0.7, false) then 'raters' when not coalesce(rho >= 0.7, false) then 'rho' when mae > 0.5 then 'error' when far_share > 0.05 then 'far' end why from f left join al using (batch)) select *, why is null passed from u""",
    "order_timeouts": """with e as (select user_id || '-' || day(ts) o, event_id, ts, case when event_type in ('click', 'view') then 'placed' when event_type = 'purchase' then 'paid' when event_type = 'error' then 'cancelled' end k, floor(value)::bigint q from events),
        g as (select o, min(ts) filter (k = 'placed') p, arg_min(q, (ts, event_id)) filter (k = 'placed') q, min(ts) filter (k <> 'placed') x, arg_min(k, (ts, event_id)) filter (k <> 'placed') xk from e where k is not null group by 1),
        d as (select *, coalesce(p, x) + interval 6 hours due from g), u as (select case when p is null then 'unknown_order' when x <= due then xk else 'expired' end outcome, coalesce(q, 0) q, * exclude q from d where due <= (select max(ts) from e where k is not null))
        select outcome, count(*) orders, sum(case when outcome in ('paid', 'unknown_order') then 0 else q end)::bigint released, strftime(max(case when outcome = 'expired' then due else x end), '%Y-%m-%d %H:%M:%S.%f') latest from u group by 1""",
    "need_spans": """with a as (select *, json_extract_string(props, '$.k') v, coalesce(epoch_us(ts) - epoch_us(lag(ts) over w) > 28800000000, true) nw from events window w as (partition by user_id order by ts, event_id)), b as (select *, sum(nw::int) over (partition by user_id order by ts, event_id) s from a),
        f as (select user_id, s, event_type, arg_max(v, (ts, event_id)) v from b where event_type <> 'view' and v is not null group by all), n as (select user_id, s, string_agg(event_type || '=' || v, ',' order by event_type) needs from f group by all)
        select user_id::varchar session, epoch_us(min(ts)) start_us, epoch_us(max(ts)) last_us, count(*) events, coalesce(any_value(needs), '') needs from b left join n using (user_id, s) group by user_id, s""",
}
