"""Queries on traces, costs and service quality; events stand for traces."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import flywheel as ops


def _events(spark, d):
    return spark.read.parquet(f"{d}/events.parquet")


def blind_spots(spark, d):
    """Users by errors, the most first, with the urgency of answering them."""
    e = _events(spark, d).where("event_type = 'error'")
    t = e.select(F.col("event_id").alias("id"), F.col("user_id").alias("question"), F.when(F.col("value") > 50, "timeout").otherwise("failure").alias("reason"), F.when(F.col("event_id") % 2 == 0, "open").otherwise("answered").alias("status"))
    return ops.blind_spots(t, 40)


def product_demand(spark, d):
    """Views and purchases by hour of day."""
    e = _events(spark, d).where("event_type in ('view', 'purchase')")
    return e.groupBy(F.hour("ts").alias("hour")).agg(F.count("*").alias("asked"), F.count_if(F.col("event_type") == "purchase").alias("bought"), F.countDistinct("user_id").alias("users"))


def task_queue(spark, d):
    """Open tasks folded from click events, one for a user and type, and the next twenty to run."""
    e = _events(spark, d).where("event_type in ('click', 'error')")
    t = e.select(F.concat_ws(":", "event_type", "user_id").alias("task_key"), F.col("ts").alias("at"), F.col("event_id").alias("id"), F.floor(F.col("value") / 10).alias("priority"), (F.col("event_id") % 3 == 0).alias("running"))
    return ops.pull_tasks(ops.reduce_tasks(t), 20).select("task_key", "times", "priority", "id")


def error_streaks(spark, d):
    """Two or more errors in a row of one user."""
    return ops.streaks(_events(spark, d), "user_id", ["ts", "event_id"], F.col("event_type") == "error", 2)


def reply_latency(spark, d):
    """Seconds from a click to the purchase right after it, by user."""
    r = ops.reply_times(_events(spark, d), "user_id", "ts", "event_type", "click", "purchase")
    return r.groupBy("user_id").agg(F.count("*").alias("replies"), F.round(F.avg("seconds"), 3).alias("mean_s"), F.round(F.max("seconds"), 3).alias("worst_s"), F.count_if(F.col("seconds") > 3600).alias("slow"))


def latency_percentiles(spark, d):
    """Median, 95th and 99th percentile of values by type."""
    p = ops.percentiles(_events(spark, d), "event_type", "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return p.select("event_type", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")])


def blind_spot_ids(spark, d):
    """The thirty users with most open or answered errors, and which these are."""
    e = _events(spark, d).where("event_type = 'error'")
    return ops.blind_spot_ids(e.select(F.col("event_id").alias("id"), F.col("user_id").alias("question"), F.when(F.col("event_id") % 3 == 0, "closed").when(F.col("event_id") % 3 == 1, "open").otherwise("answered").alias("status")), 30)


def question_demand(spark, d):
    """The three most frequent event properties of each day of the week, as questions on a product."""
    e = _events(spark, d).select((F.col("user_id") % 7).alias("product_id"), F.col("props").alias("input_text"), F.col("event_type").alias("intent"), (F.col("event_type") == "error").alias("handover"))
    return ops.question_demand(e, 3).withColumn("rank", F.col("rank").cast("long"))


def cost_rollup(spark, d):
    """Values by type and week, by type, and overall."""
    e = _events(spark, d).withColumn("week", F.floor((F.dayofmonth("ts") - 1) / 7).cast("int"))
    return ops.cost_rollup(e, ["event_type", "week"], "value")


def weekly_change(spark, d):
    """Sums by week and type, and their change from the week before."""
    e = _events(spark, d).withColumn("week", F.floor((F.dayofmonth("ts") - 1) / 7).cast("int")).groupBy("event_type", "week").agg(F.sum("value").alias("v"))
    was = F.lag("v").over(W.partitionBy("event_type").orderBy("week"))
    return e.select("event_type", "week", F.round("v", 3).alias("total"), F.round((F.col("v") - was) / was, 6).alias("change"))


def kb_health(spark, d):
    """Documents that no event hits, and the share of the ten most hit."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id")
    hits = _events(spark, d).select((F.col("user_id") * F.col("user_id") % 1000).alias("doc_id"))
    top = ops.share_curve(hits, "doc_id", 10).agg(F.max("share").alias("top_share"))
    cold = docs.join(hits.distinct(), "doc_id", "left_anti").agg(F.count("*").alias("never_hit"))
    return cold.crossJoin(top)  # one row by one row


def feedback_counts(spark, d):
    """Props' k: how many are high, low and missing, by type."""
    k = F.get_json_object("props", "$.k").cast("int")
    return _events(spark, d).groupBy("event_type").agg(F.count_if(k >= 50).alias("high"), F.count_if(k < 50).alias("low"), F.count_if(k.isNull()).alias("missing"))


def owner_cap(spark, d):
    """Events left when no user may hold more than a part in two hundred."""
    e = ops.capped_share(_events(spark, d), "user_id", "event_id", 0.005)
    return e.groupBy("user_id").agg(F.count("*").alias("events"), F.sum("event_id").alias("ids"))


def ab_test(spark, d):
    """Users, events and purchases of two groups by hash."""
    e = _events(spark, d).withColumn("ab", ops.ab_group(F.col("user_id")))
    return e.groupBy("ab").agg(F.countDistinct("user_id").alias("users"), F.count("*").alias("events"), F.round(F.avg((F.col("event_type") == "purchase").cast("double")), 6).alias("rate"))


def user_sessions(spark, d):
    """Sessions of a user's events with gaps of six hours or less."""
    e = _events(spark, d)
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.coalesce((F.col("ts") > F.lag("ts").over(w) + F.expr("INTERVAL 6 HOURS")).cast("int"), F.lit(1))
    s = e.withColumn("new", new).withColumn("s", F.sum("new").over(w))
    return s.groupBy("user_id", "s").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


def half_hour_windows(spark, d):
    """Events by half-hour window."""
    return _events(spark, d).groupBy(F.window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "events", "total")


QUERIES = {f.__name__: f for f in (blind_spots, product_demand, task_queue, error_streaks, reply_latency, latency_percentiles, cost_rollup, weekly_change, kb_health, feedback_counts, owner_cap, ab_test, user_sessions, half_hour_windows, blind_spot_ids, question_demand)}

_W = "e as (select *, ((day(ts) - 1) // 7)::int as week from events)"
ORACLES = {
    "blind_spot_ids": """with e as (select event_id id, user_id question from events where event_type = 'error' and event_id % 3 <> 0), g as (select question, count(*) times, min(id) first_id from e group by 1 order by times desc, first_id limit 30),
        r as (select * from e semi join g using (question)) select question, times, first_id, string_agg(id::varchar, ',' order by id) ids from g join r using (question) group by all""",
    "question_demand": """with g as (select user_id % 7 product_id, props input_text, count(*) times, max(event_type) intent, count(*) filter (event_type = 'error') handovers from events group by 1, 2), r as (select *, row_number() over (partition by product_id order by times desc, input_text) as rank from g) select * from r where rank <= 3""",
    "blind_spots": """select user_id question, count(*) times, max(case when value > 50 then 'timeout' else 'failure' end) reason, min(event_id) first_id, min(case when event_id % 2 = 0 then 'open' else 'answered' end) status,
        case when count(*) >= 3 then 'P0' when count(*) = 2 then 'P1' else 'P2' end priority from events where event_type = 'error' group by 1 order by times desc, first_id limit 40""",
    "product_demand": "select hour(ts)::int as hour, count(*) asked, count(*) filter (event_type = 'purchase') bought, count(distinct user_id) users from events where event_type in ('view', 'purchase') group by 1",
    "task_queue": """with t as (select event_type || ':' || user_id task_key, count(*) times, max(floor(value / 10)::bigint) priority, min(event_id) id, arg_max(event_id % 3 = 0, (ts, event_id)) running from events where event_type in ('click', 'error') group by 1)
        select task_key, times, priority, id from t where not running order by priority desc, id limit 20""",
    "error_streaks": """with a as (select *, sum((event_type <> 'error')::int) over (partition by user_id order by ts, event_id) run from events), b as (select user_id, run, count(*) as length, min(ts) as start from a where event_type = 'error' group by all) select user_id, start, length from b where length >= 2""",
    "reply_latency": """with a as (select *, lag(ts) over w as t0, lag(event_type) over w as before from events window w as (partition by user_id order by ts, event_id)), b as (select user_id, epoch_us(ts - t0) / 1e6 s from a where event_type = 'purchase' and before = 'click')
        select user_id, count(*) replies, round(avg(s), 3) mean_s, round(max(s), 3) worst_s, count(*) filter (s > 3600) slow from b group by 1""",
    "latency_percentiles": "select event_type, round(quantile_cont(value, 0.5), 6) p50, round(quantile_cont(value, 0.95), 6) p95, round(quantile_cont(value, 0.99), 6) p99 from events group by 1",
    "cost_rollup": f"with {_W} select event_type, week, round(sum(value), 4) total, count(*) n, (grouping(event_type) + grouping(week))::int as level from e group by rollup (event_type, week)",
    "weekly_change": f"with {_W}, s as (select event_type, week, sum(value) v from e group by all) select event_type, week, round(v, 3) total, round((v - lag(v) over w) / lag(v) over w, 6) as change from s window w as (partition by event_type order by week)",
    "kb_health": """with h as (select user_id * user_id % 1000 doc_id from events), c as (select doc_id, count(*) n from h group by 1), t as (select n from c order by n desc, doc_id limit 10)
        select (select count(*) from documents where doc_id not in (select doc_id from h)) never_hit, round((select sum(n) from t) / (select count(*) from h), 6) top_share""",
    "feedback_counts": "with a as (select event_type, try_cast(json_extract_string(props, '$.k') as int) k from events) select event_type, count(*) filter (k >= 50) high, count(*) filter (k < 50) low, count(*) filter (k is null) missing from a group by 1",
    "owner_cap": "with a as (select *, row_number() over (partition by user_id order by md5(event_id::varchar)) r from events) select user_id, count(*) events, sum(event_id)::bigint ids from a where r <= floor((select count(*) from events) * 0.005) group by 1",
    "ab_test": "select ('0x' || substr(md5(user_id::varchar), 1, 6))::int % 2 ab, count(distinct user_id) users, count(*) events, round(avg((event_type = 'purchase')::int), 6) rate from events group by 1",
    "user_sessions": """with a as (select *, case when ts <= lag(ts) over w + interval 6 hours then 0 else 1 end as new from events window w as (partition by user_id order by ts, event_id)), b as (select user_id, sum(new) over (partition by user_id order by ts, event_id) s from a),
        c as (select user_id, s, count(*) n from b group by all) select user_id, count(*) sessions, max(n) longest from c group by 1""",
    "half_hour_windows": "select strftime(time_bucket(interval 30 minutes, ts), '%Y-%m-%d %H:%M') as start, count(*) events, round(sum(value), 4) total from events group by 1",
}
