"""Queries on conversations: the cleaning funnel and session analytics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import rules
from ..functions.textops import content_hash, shingles
from ..operators import dialogue as ops, funnel, greedy

#: Personal data as European texts write it: mail addresses, card numbers, and runs of digits.
LATIN_PII = [("email", r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]+", "<EMAIL>"), ("digits", r"[0-9]{6,}", "<DIGITS>"), ("ipv4", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "<IP>")]


def _turns(spark, d):
    return spark.read.parquet(f"{d}/conversations.parquet")


def _limits():
    return ops.latin_profile(min_turns=3, min_chars=120, max_chars=2000, min_letter_ratio=0.93, contact=r"(https?://|www\.)")


def gate1_funnel(spark, d):
    """How many sessions each rule of gate 1 but the near-duplicate rule stops."""
    return ops.funnel(ops.gate1(ops.sessions(_turns(spark, d)), _limits()))


def gate1_whole_funnel(spark, d):
    """How many sessions each rule of gate 1 stops, near duplicates of whole sessions last."""
    return ops.funnel(ops.gate1_whole(ops.sessions(_turns(spark, d)), _limits()))


def pii_hits(spark, d):
    """Masked places by rule, over conversations and documents."""
    texts = _turns(spark, d).select("text").unionAll(spark.read.parquet(f"{d}/documents.parquet").select("text"))
    hits = texts.select(F.explode(rules.masked(F.col("text"), LATIN_PII)["hits"]).alias("h"))
    return hits.groupBy(F.col("h.rule").alias("rule")).agg(F.sum("h.n").alias("hits"), F.count("*").alias("texts"))


def gate2_turns(spark, d):
    """Turns by what gate 2 makes of them."""
    t = ops.gate2_turns(ops.sessions(_turns(spark, d)), "ok|thanks|thank you|hello|hi|yes|no", ["^You are "])
    return t.groupBy("role", "kind").agg(F.count("*").alias("turns"))


def gate2_sessions(spark, d):
    """Sessions that hold a question and an answer once system turns are gone."""
    kept = ops.sessions(_turns(spark, d)).select("conv_id", F.filter("turns", lambda t: t["role"] != "system").alias("turns"))
    has = lambda role: F.exists("turns", lambda t: t["role"] == role)
    kept = kept.where((F.size("turns") >= 2) & has("user") & has("agent"))
    return kept.select("conv_id", F.size("turns").cast("long").alias("turns"), F.length(ops.content(F.col("turns"))).cast("long").alias("chars"))


def ods_append(spark, d):
    """Sessions left of a batch once repeats and those stored before (even conv_ids) are gone."""
    s = ops.sessions(_turns(spark, d))
    stored = s.where("conv_id % 2 = 0").select(content_hash(F.col("turns")).alias("payload_hash"))
    return ops.append_new(s, stored).select("conv_id", F.size("turns").cast("long").alias("turns"))


def unprocessed_sessions(spark, d):
    """The first hundred sessions without an outcome; those of multiples of three have one."""
    s = ops.sessions(_turns(spark, d)).select("conv_id")
    return ops.unprocessed(s, s.where("conv_id % 3 = 0"), 100)


def near_session_pairs(spark, d):
    """Pairs of sessions whose whole texts have a Jaccard of 0.85 or more over four-character shingles."""
    whole = ops.sessions(_turns(spark, d)).select("conv_id", ops.content(F.col("turns")).alias("text"))
    found = greedy.class_pairs(whole, "conv_id", shingles(F.col("text")), 0.85 - 5e-7)  # what rounds to 0.85 counts
    return found.withColumn("score", F.round("score", 6)).where("score >= 0.85")


def reply_runs(spark, d):
    """Runs of turns by one speaker in a session: how many, and the longest."""
    t = _turns(spark, d)
    w = W.partitionBy("conv_id").orderBy("turn")
    t = t.withColumn("new", F.coalesce((F.lag("role").over(w) != F.col("role")).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(w))
    runs = t.groupBy("conv_id", "run", "role").agg(F.count("*").alias("n"))
    return runs.groupBy("role").agg(F.count("*").alias("runs"), F.max("n").alias("longest"), F.sum("n").alias("turns"))


def last_history(spark, d):
    """The last two turns of each session, oldest first."""
    w = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    last = _turns(spark, d).withColumn("back", F.row_number().over(w)).where("back <= 2")
    return last.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ">").alias("roles"))


def sft_samples(spark, d):
    """Questions with the answer that follows at once, for fine-tuning; at most two of a session, longest answers first."""
    w = W.partitionBy("conv_id").orderBy("turn")
    t = _turns(spark, d).withColumn("before", F.lag("text").over(w)).withColumn("before_role", F.lag("role").over(w))
    t = t.where("role = 'assistant' and before_role = 'user'")
    rank = F.row_number().over(W.partitionBy("conv_id").orderBy(F.length("text").desc(), "turn"))
    return t.withColumn("rank", rank).where("rank <= 2").select("conv_id", "turn", F.col("rank").cast("long").alias("rank"), F.length("before").cast("long").alias("question_chars"), F.length("text").cast("long").alias("answer_chars"))


def _triage(text):
    """A stand-in for the cheap model: by how often the staff speak, it sees knowledge, finds it outdated, or cannot be asked."""
    import json

    n = text.count("agent: ")
    if n >= 4:
        raise TimeoutError
    return json.dumps({"has_knowledge": n > 1, "generalizable": 0.9, "outdated": text.count("user: ") > n, "quality": 0.8, "confidence": 0.9})


def _extract(text):
    """A stand-in for the dear model: one item a session."""
    import json

    return json.dumps({"items": [{"question": str(text.count("user: ")), "answer": "as said", "confidence": 0.9}]})


def cleaning_run(spark, d):
    """The whole cleaning run over all sessions, with two stand-ins for models: outcomes by gate and reason, and items by status."""
    turns = spark.read.parquet(f"{d}/conversations.parquet").where("conv_id is not null")
    items, outcomes = funnel.run(turns, _triage, _limits(), extract=_extract, most_failures=1.0)
    counted = outcomes.groupBy("gate", "reason").agg(F.count("*").alias("n"))
    return counted.unionAll(items.groupBy(F.lit("items").alias("gate"), F.lit("merged").alias("reason")).agg(F.sum("merged").alias("n")))


QUERIES = {f.__name__: f for f in (cleaning_run, gate1_funnel, gate1_whole_funnel, pii_hits, gate2_turns, gate2_sessions, ods_append, unprocessed_sessions, near_session_pairs, reply_runs, last_history, sft_samples)}

_SESSIONS = """s as (select conv_id, count(*) n, string_agg(coalesce(text, ''), chr(10) order by turn) t, list({'role': case when role = 'assistant' then 'agent' else role end, 'text': text} order by turn) turns from conversations group by conv_id)"""
ORACLES = {
    "gate1_funnel": rf"""with {_SESSIONS}, b as (select *, regexp_replace(t, '\s', '', 'g') bare from s)
        select case when n < 3 then 'too_few_turns' when length(t) < 120 then 'too_short' when length(t) > 2000 then 'too_long'
          when length(bare) = 0 or length(regexp_replace(bare, '[^A-Za-zÀ-ÿ]', '', 'g')) / length(bare) < 0.93 then 'wrong_language'
          when regexp_matches(t, '[\x00-\x08\x0b-\x0c\x0e-\x1f]{{2,}}') then 'garbled' when regexp_matches(t, '(https?://|www\.)') then 'contact'
          when contains(t, 'password') or contains(t, 'guarantee') then 'flagged_word' else 'passed' end reason, count(*) sessions from b group by 1""",
    "pii_hits": r"""with t0 as (select text from conversations union all select text from documents),
        t1 as (select regexp_extract_all(text, '[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]+') a, regexp_replace(text, '[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]+', '<EMAIL>', 'g') text from t0),
        t2 as (select a, regexp_extract_all(text, '[0-9]{6,}') b, regexp_replace(text, '[0-9]{6,}', '<DIGITS>', 'g') text from t1),
        t3 as (select len(a) a, len(b) b, len(regexp_extract_all(text, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}')) c from t2)
        select rule, sum(n)::bigint hits, count(*) texts from (select 'email' rule, a n from t3 union all select 'digits', b from t3 union all select 'ipv4', c from t3) where n > 0 group by rule""",
    "gate2_turns": r"""select case when role = 'assistant' then 'agent' else role end as role, case when role = 'system' then 'system' when regexp_matches(text, '^You are ') then 'system_phrase' when length(trim(text)) = 0 then 'empty'
        when regexp_matches(trim(text), '(?i)^[\s~～。.!！?？,，、:：呢吧啊呀哦嗯的了啦哈]*(?:(?:ok|thanks|thank you|hello|hi|yes|no)[\s~～。.!！?？,，、:：呢吧啊呀哦嗯的了啦哈]*)+$') then 'pleasantry' else 'kept' end kind, count(*) turns from conversations group by 1, 2""",
    "gate2_sessions": """select conv_id, count(*) turns, length(string_agg(coalesce(text, ''), chr(10) order by turn)) chars from conversations where role <> 'system' group by conv_id having count(*) >= 2 and bool_or(role = 'user') and bool_or(role = 'assistant')""",
    "ods_append": f"""with {_SESSIONS}, k as (select conv_id, n, turns::varchar h from s), f as (select *, row_number() over (partition by h order by conv_id) r from k)
        select conv_id, n turns from f where r = 1 and h not in (select h from k where conv_id % 2 = 0)""",
    "unprocessed_sessions": "select distinct conv_id from conversations where conv_id % 3 <> 0 order by conv_id limit 100",
    "near_session_pairs": r"""with f as (select conv_id, regexp_replace(string_agg(coalesce(text, ''), chr(10) order by turn), '\s+', '', 'g') t from conversations group by conv_id),
        g as (select conv_id, case when length(t) < 4 then [t] else list_distinct(list_transform(range(1, length(t) - 2), lambda i: substr(t, i, 4))) end s from f where length(t) > 0),
        u as (select list_sort(s) s, min(conv_id) id, list_sort(list(conv_id)) ids from g group by 1),
        p as (select a.id a, b.id b, len(list_intersect(a.s, b.s)) i, len(a.s) na, len(b.s) nb from u a join u b on a.id < b.id and least(len(a.s), len(b.s)) >= 0.84 * greatest(len(a.s), len(b.s)))
        select a, b, round(i / (na + nb - i), 6) score from p where round(i / (na + nb - i), 6) >= 0.85
        union all select id, unnest(ids[2:]), 1.0 from u where len(ids) > 1""",
    "reply_runs": """with a as (select *, case when lag(role) over (partition by conv_id order by turn) = role then 0 else 1 end as new from conversations), b as (select *, sum(new) over (partition by conv_id order by turn) run from a),
        c as (select conv_id, run, role, count(*) n from b group by all) select role, count(*) runs, max(n) longest, sum(n)::bigint turns from c group by role""",
    "last_history": """with a as (select *, row_number() over (partition by conv_id order by turn desc) back from conversations) select conv_id, string_agg(role, '>' order by turn) roles from a where back <= 2 group by conv_id""",
    "sft_samples": """with a as (select *, lag(text) over w as before, lag(role) over w as before_role from conversations window w as (partition by conv_id order by turn)),
        b as (select *, row_number() over (partition by conv_id order by length(text) desc, turn) as rank from a where role = 'assistant' and before_role = 'user')
        select conv_id, turn, rank, length(before) question_chars, length(text) answer_chars from b where rank <= 2""",
}
# The rules of gate1_funnel, then the near-duplicate rule over those that pass.
ORACLES["gate1_whole_funnel"] = ORACLES["gate1_funnel"].replace("with s as", "with recursive s as", 1).replace("from s)\n        select case when n < 3", "from s),\n        f as (select conv_id id, t, case when n < 3", 1).replace("end reason, count(*) sessions from b group by 1", "end reason from b)") + r""",
    c as (select id, regexp_replace(t, '\s+', '', 'g') t from f where reason = 'passed'),
    g as (select id, case when length(t) < 4 then [t] else list_distinct(list_transform(range(1, length(t) - 2), lambda i: substr(t, i, 4))) end s from c where length(t) > 0),
    x as (select id, len(s) n, unnest(s) w from g), p as (select a.id a, b.id b, count(*) i, any_value(a.n) na, any_value(b.n) nb from x a join x b on a.w = b.w and a.id < b.id group by a.id, b.id),
    nb as materialized (select b, list(a) s from p where i / (na + nb - i) >= 0.85 group by b), o as materialized (select id, row_number() over (order by id) i from c),
    k as (select 0::bigint i, []::bigint[] kept union all select k.i + 1, case when list_has_any(kept, coalesce(s, [])) then kept else list_append(kept, o.id) end from k join o on o.i = k.i + 1 left join nb on nb.b = o.id),
    l as (select unnest(kept) id from (select kept from k order by i desc limit 1))
    select case when reason = 'passed' and id not in (select id from l) then 'near_duplicate' else reason end reason, count(*) sessions from f group by 1"""
ORACLES["cleaning_run"] = ORACLES["gate1_whole_funnel"].replace("select case when reason = 'passed' and id not in (select id from l) then 'near_duplicate' else reason end reason, count(*) sessions from f group by 1", """, w as (select conv_id, count(*) filter (role = 'assistant') a, count(*) filter (role = 'user') u from conversations where role <> 'system' group by 1),
    z as (select case when reason <> 'passed' or id not in (select id from l) then 'gate1' when coalesce(a, 0) = 0 or u = 0 then 'gate2' when a >= 4 then 'infra' else 'gate3' end gate,
        case when reason <> 'passed' then reason when id not in (select id from l) then 'near_duplicate' when coalesce(a, 0) = 0 or u = 0 then 'no_pair' when a >= 4 then 'infra' when a < 2 then 'no_knowledge' when u > a then 'outdated' else 'extracted' end reason from f left join w on conv_id = id)
    select gate, reason, count(*) n from z where gate <> 'infra' group by all union all select 'items', 'merged', count(*) from z where reason = 'extracted' having count(*) > 0""")
