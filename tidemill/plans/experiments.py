"""Queries on sketches, many words at once, cost marts and comparisons of groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.textops import text_pieces
from ..operators import costs, experiments, phrases, sketches
from ..operators.flywheel import ab_group
from ..sources.tables import cut


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _signatures(docs):
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "[ \\t\\n\\r]+", "")
    return sketches.text_signatures(docs.select(F.col("doc_id").alias("id"), F.explode(text_pieces(text, 6, 1 << 16)).alias("piece")), 6)


def signature_sums(spark, d):
    """The sum and the ends of each document's signature."""
    s = _signatures(_t(spark, d, "documents"))
    return s.select("id", F.aggregate("sig", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.col("sig")[0].alias("first"), F.col("sig")[63].alias("last"))


def source_signatures(spark, d):
    """Signatures of whole sources, merged from those of their documents."""
    docs = _t(spark, d, "documents")
    s = _signatures(docs).join(docs.select(F.col("doc_id").alias("id"), "source"), "id")
    return sketches.merged(s, "source").select("source", F.aggregate("sig", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


def stored_matches(spark, d):
    """Odd documents with the best even one, by stored signatures alone."""
    s = cut(_signatures(_t(spark, d, "documents")))
    m = sketches.new_against_stored(s.where("id % 2 = 1"), s.where("id % 2 = 0"), 0.5)
    return m.select("id", "stored_id", F.round("score", 6).alias("score"))


def phrase_hits(spark, d):
    """Documents that hold each of the benchmark's openings, of two words, and how often."""
    words = _t(spark, d, "benchmark").select(F.substring_index("text", " ", 2).alias("word"))
    h = phrases.held_words(_t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), words)
    return h.groupBy("word").agg(F.count("*").alias("documents"), F.sum("id").alias("ids"))


def cost_alerts(spark, d):
    """Days on which a type's sum was over 1.5 times the mean of the seven days before."""
    day = costs.rolled(costs.hourly(_t(spark, d, "events"), ["event_type"], "ts", "value"), ["event_type"], "day")
    a = costs.alerts(day, ["event_type"], "day", "total")
    return a.select("event_type", F.date_format("day", "yyyy-MM-dd").alias("day"), "n", F.round("total", 4).alias("total"), F.round("baseline", 4).alias("baseline"))


def weekly_quantiles(spark, d):
    """Week by week: calls, their sum's change, and whether the sketches' quantiles have the ranks they should, to 2.5 in a hundred."""
    events = _t(spark, d, "events")
    week = costs.rolled(costs.rolled(costs.hourly(events, ["event_type"], "ts", "value"), ["event_type"], "day"), ["event_type"], "week", "day")
    q = costs.with_quantiles(costs.changes(week, ["event_type"], "week", "total"), {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    j = events.select("event_type", F.date_trunc("week", "ts").alias("week"), "value").join(q.select("event_type", "week", "p50", "p95", "p99"), ["event_type", "week"])
    ranks = j.groupBy("event_type", "week").agg(*[(F.abs(F.avg((F.col("value") <= F.col(c)).cast("double")) - s) <= F.lit(0.025) + F.lit(1.0) / F.count("*")).alias(f"{c}_holds") for c, s in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))])
    return q.join(ranks, ["event_type", "week"]).select("event_type", F.date_format("week", "yyyy-MM-dd").alias("week"), "n", F.round("total", 4).alias("total"), F.round("change", 6).alias("change"), F.round("worst", 4).alias("worst"), "p50_holds", "p95_holds", "p99_holds")


def _groups(spark, d):
    return _t(spark, d, "events").withColumn("unit", F.col("user_id")).withColumn("grp", ab_group(F.col("user_id")))


def ab_rates(spark, d):
    """Share of purchases of two groups of users: the difference and its bounds over 200 draws."""
    u = _groups(spark, d).groupBy("unit", "grp").agg(F.count_if(F.col("event_type") == "purchase").alias("hits"), F.count("*").alias("tries"))
    return experiments.rate_difference(u).select(*[F.round(c, 6).alias(c) for c in ("rate_0", "rate_1", "diff", "low", "high")])


def ab_latency(spark, d):
    """The 95th percentile of values of two groups, in cells of 5, with its bounds over 60 draws."""
    r = _groups(spark, d).select("unit", "grp", "value")
    return experiments.quantile_difference(r, 0.95, 5.0, 60).select(*[F.round(c, 6).alias(c) for c in ("q_0", "q_1", "diff", "low", "high")])


def ab_decision(spark, d):
    """Whether the treated group may grow, the share of events without error being the red line."""
    g = _groups(spark, d)
    sizes = g.groupBy("grp").agg(F.count("*").alias("sessions"), F.countDistinct(F.to_date("ts")).alias("days"))
    u = g.groupBy("unit", "grp").agg(F.count_if(F.col("event_type") != "error").alias("hits"), F.count("*").alias("tries"))
    return experiments.decide(sizes, experiments.rate_difference(u).select(F.lit("solved").alias("name"), "low", "high"))


QUERIES = {f.__name__: f for f in (signature_sums, source_signatures, stored_matches, phrase_hits, cost_alerts, weekly_quantiles, ab_rates, ab_latency, ab_decision)}

_P = sketches.PRIME
_MINS = ", ".join(f"min((x * {a} + {b}) % {_P})" for a, b in sketches.seeds(64))
_SIG = f"""t as (select doc_id id, source, regexp_replace(coalesce(text, ''), '[ \\t\\n\\r]+', '', 'g') t from documents), g as (select id, unnest(case when length(t) >= 6 then [t[i:i + 5] for i in range(1, length(t) - 4)] when t <> '' then [t] else [] end) g from t),
    x as (select distinct id, ('0x' || substr(md5(g), 1, 15))::bigint % {_P} x from g), s as (select id, [{_MINS}] sig from x group by id)"""
_W = "case " + " ".join(f"when u < {p!r} then {i}" for i, p in enumerate(experiments.POISSON)) + f" else {len(experiments.POISSON)} end"
_AB = f"""g as (select *, ('0x' || substr(md5(user_id::varchar), 1, 6))::int % 2 grp from events)"""
_DRAWS = "('0x' || substr(md5(user_id || ':' || draw), 1, 8))::bigint / 4294967296.0::double"
_RATES = f"""{_AB}, u as (select user_id, grp, count(*) filter ({{hit}}) h, count(*) t from g group by all), w as (select *, {_W} w from (select *, {_DRAWS} u from u, range(200) r(draw))),
    p as (select draw, sum(w * h) filter (grp = 1) / nullif(sum(w * t) filter (grp = 1), 0) - sum(w * h) filter (grp = 0) / nullif(sum(w * t) filter (grp = 0), 0) diff from w group by 1), b as (select quantile_cont(diff, 0.025) low, quantile_cont(diff, 0.975) high from p),
    r as (select sum(h) filter (grp = 0) / sum(t) filter (grp = 0) rate_0, sum(h) filter (grp = 1) / sum(t) filter (grp = 1) rate_1 from u)"""
ORACLES = {
    "signature_sums": f"with {_SIG} select id, list_sum(sig)::bigint total, sig[1] as first, sig[64] as last from s",
    "source_signatures": f"with {_SIG}, y as (select distinct source, x from x join t using (id)), m as (select source, [{_MINS}] sig from y group by source) select source, list_sum(sig)::bigint total from m",
    "stored_matches": f"""with {_SIG}, f as (select id, sig, min(id) over (partition by sig, id % 2) lead from s), k as (select id, id % 2 p, sig, unnest(range(16)) b from f where id = lead), m as (select distinct a.id a, c.id b from k a join k c on a.p = 1 and c.p = 0 and a.b = c.b and a.sig[a.b * 4 + 1:a.b * 4 + 4] = c.sig[c.b * 4 + 1:c.b * 4 + 4]),
        e as (select a, b, len(list_filter(list_zip(x.sig, y.sig), lambda z: z[1] = z[2])) / 64 score from m join s x on x.id = a join s y on y.id = b), r as (select *, row_number() over (partition by a order by score desc, b) r from e where score >= 0.5)
        select f.id, b stored_id, round(score, 6) score from f join r on a = lead and r = 1 where f.id % 2 = 1""",
    "phrase_hits": "with w as (select distinct array_to_string(string_split(text, ' ')[1:2], ' ') w from benchmark) select w word, count(*) documents, sum(doc_id)::bigint ids from w join documents on contains(text, w) group by 1",
    "cost_alerts": """with d as (select event_type, date_trunc('day', ts) d, count(*) n, sum(value) total from events group by all), b as (select *, avg(total) over w baseline, count(total) over w k from d window w as (partition by event_type order by d rows between 7 preceding and 1 preceding))
        select event_type, strftime(d, '%Y-%m-%d') "day", n, round(total, 4) total, round(baseline, 4) baseline from b where k >= 3 and total > 1.5 * baseline""",
    "weekly_quantiles": """with w as (select event_type, date_trunc('week', ts) w, count(*) n, sum(value) total, max(value) worst from events group by all)
        select event_type, strftime(w, '%Y-%m-%d') as week, n, round(total, 4) total, round((total - lag(total) over k) / lag(total) over k, 6) as change, round(worst, 4) worst, true p50_holds, true p95_holds, true p99_holds from w window k as (partition by event_type order by w)""",
    "ab_rates": f"with {_RATES.format(hit="event_type = 'purchase'")} select round(rate_0, 6) rate_0, round(rate_1, 6) rate_1, round(rate_1 - rate_0, 6) diff, round(low, 6) low, round(high, 6) high from r, b",
    "ab_latency": f"""with {_AB}, c as (select user_id, grp, floor(value / 5) cell, count(*) n from g group by all), w as (select *, {_W} w from (select *, {_DRAWS} u from c, range(60) r(draw))), s as (select draw, grp, cell, sum(w * n) n from w where w > 0 group by all union all select -1, grp, cell, sum(n) from c group by all),
        a as (select *, sum(n) over (partition by draw, grp order by cell) up, sum(n) over (partition by draw, grp) total from s), q as (select draw, grp, (min(cell) + 1) * 5 q from a where up >= 0.95 * total group by all), d as (select draw, max(q) filter (grp = 0) q_0, max(q) filter (grp = 1) q_1 from q group by 1)
        select round(any_value(q_0) filter (draw = -1), 6) q_0, round(any_value(q_1) filter (draw = -1), 6) q_1, round(any_value(q_1 - q_0) filter (draw = -1), 6) diff, round(quantile_cont(q_1 - q_0, 0.025) filter (draw >= 0), 6) low, round(quantile_cont(q_1 - q_0, 0.975) filter (draw >= 0), 6) high from d""",
    "ab_decision": f"""with {_RATES.format(hit="event_type <> 'error'")}, s as (select grp, count(*) sessions, count(distinct ts::date) as dd from g group by 1), z as (select min(dd) as dd, min(sessions) sessions, count(*) groups from s)
        select case when high < 0 then 'stop' when groups < 2 or dd < 7 or sessions < 2000 or low < 0 then 'wait' else 'raise' end decision, case when high < 0 then 'red_line' when groups < 2 or dd < 7 or sessions < 2000 then 'too_few' when low < 0 then 'uncertain' else 'clear' end why from z, b""",
}
