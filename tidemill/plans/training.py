"""Queries on training sets, chunks of documents, worker rounds and gate statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.chunk_table import chunked
from ..functions.rules import contains_pii
from ..operators import observed, training
from ..sources.tables import cut
from ..streaming.sinks import handled


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _turns(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("role") == "assistant", "agent").otherwise(F.col("role")).alias("role"), "text")


def sft_messages(spark, d):
    """Each answer of a session with the four merged turns before it: messages, characters and the last one's."""
    m = training.sft_messages(_turns(spark, d), "A shop's assistant.", 4)
    n = F.size("messages")
    chars = F.aggregate("messages", F.lit(0), lambda a, x: a + F.length(x["content"]))
    return m.select("conv_id", F.col("run").cast("long").alias("run"), n.cast("long").alias("messages"), chars.cast("long").alias("chars"), F.length(F.element_at("messages", -1)["content"]).cast("long").alias("answer_chars"), F.col("messages")[1]["role"].alias("first"))


def preference_pairs(spark, d):
    """Names of even parts as the better answers, of odd ones as the worse, asked by type; near-equal pairs dropped."""
    p = _t(spark, d, "part").select(F.concat(F.lit(" "), "p_type").alias("question"), F.concat_ws(" ", "p_name", "p_brand").alias("answer"), (F.col("p_size") / 50).alias("quality"), "p_partkey")
    pairs = training.preference_pairs(p.where("p_partkey % 2 = 0"), p.where("p_partkey % 2 = 1"), 0.7, 0.2)
    return pairs.select("question", "chosen", "rejected", F.round("alike", 6).alias("alike"))


def scene_quotas(spark, d):
    """How many documents of each language a set of half of them takes, shared out evenly."""
    docs = _t(spark, d, "documents")
    counts = docs.groupBy("lang").agg(F.count("*").alias("n"))
    return training.water_level(counts, "lang", 500)


def balanced_samples(spark, d):
    """Five hundred documents, languages as even as they can be."""
    return training.balanced(_t(spark, d, "documents"), "lang", "doc_id", 500).select("doc_id", "lang")


def line_chunks(spark, d):
    """Chunks of all documents, cut line by line: how many, their characters and the longest, by document."""
    c = chunked(_t(spark, d, "documents"), "doc_id", "text", 300)
    return c.groupBy("doc").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"), F.max(F.length("text")).alias("longest"), F.sum("seq").alias("seqs"))


def worker_outcomes(spark, d):
    """Events as tasks, a round of which some fail: what is done, comes again, is dead, and follows."""
    t = _t(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("payload"), (F.col("event_id") % 5).cast("int").alias("retry_count"))
    run = lambda x: x.where("id % 11 <> 0").select("id", F.when(F.col("id") % 3 == 0, "failed").otherwise("done").alias("outcome"), F.lit("no answer").alias("error"), F.when(F.col("id") % 4 == 1, F.concat(F.lit("index "), "payload")).alias("follow_up"))
    out = None
    for name, rows in zip(("done", "again", "dead", "follow_up"), handled(t, run, 3)):
        one = rows.select(F.lit(name).alias("kind"), "payload", "retry_count", F.col("id").cast("string").alias("id"))
        out = one if out is None else out.unionAll(one)
    return out.groupBy("kind", "payload").agg(F.count("*").alias("n"), F.sum("retry_count").alias("retries"), F.min("id").alias("first"))


def observed_stats(spark, d):
    """A gate over two halves of the documents: counts taken while each was written, then merged."""
    docs = _t(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    batches = []
    for b in (0, 1):
        rows = docs.where(F.col("doc_id") % 2 == b)
        reason = F.when(F.length("text") < 200, "too_short").when(F.length("text") > 5000, "too_long").when(F.col("text").contains("$"), "symbols")
        gate, seen = observed.observed_gate(rows, reason, {"pii": contains_pii(F.col("text"), [("email", r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z]+", "")]).cast("int"), "lines": F.regexp_count("text", F.lit("\n"))}, reasons=["too_short", "too_long"])
        cut(gate)
        batches.append(observed.stats_rows(spark, seen, "gate1", str(b), "document", "document", {"too_long": "overlong"}))
    return observed.merged_stats(*batches)


QUERIES = {f.__name__: f for f in (sft_messages, preference_pairs, scene_quotas, balanced_samples, line_chunks, worker_outcomes, observed_stats)}

_Q = """c as (select lang, count(*) n from documents group by 1), o as (select *, row_number() over (order by n, lang nulls first) i, count(*) over () k from c),
    f as (select 0::bigint i, 0::bigint used, null::varchar lang, 0::bigint n, 0::bigint quota union all select o.i, f.used + least(o.n, (500 - f.used) // (o.k - o.i + 1)), o.lang, o.n, least(o.n, (500 - f.used) // (o.k - o.i + 1)) from f join o on o.i = f.i + 1)"""
ORACLES = {
    "sft_messages": """with t as (select conv_id, turn, case when role = 'assistant' then 'agent' else role end as role, text from conversations where role in ('user', 'assistant') and trim(text) <> ''), a as (select *, coalesce(role <> lag(role) over (partition by conv_id order by turn), true)::int nw from t),
        b as (select *, sum(nw) over (partition by conv_id order by turn) run from a), r as (select conv_id, run, role, string_agg(text, chr(10) order by turn) text from b group by all),
        s as (select *, list({'r': role, 'n': length(text)}) over (partition by conv_id order by run rows between 4 preceding and current row) seen from r), o as (select *, case when seen[1].r = 'agent' then seen[2:] else seen end op from s where role = 'agent')
        select conv_id, run::bigint run, len(op) + 1 messages, (list_sum([x.n for x in op]) + 19)::bigint chars, op[-1].n answer_chars, op[1].r as first from o where len(op) > 1""",
    "preference_pairs": """with p as (select p_type q, p_name || ' ' || p_brand a, p_size / 50 s, p_partkey % 2 o from part), b as (select q, arg_min(a, (-s, a)) c from p where o = 0 and s >= 0.2 group by 1), x as (select distinct q, a from p where o = 1),
        y as (select b.q, c, a, 1 - levenshtein(c, a) / greatest(length(c), length(a)) alike from b join x using (q) where c <> a) select q question, c chosen, a rejected, round(alike, 6) alike from y where alike <= 0.7""",
    "scene_quotas": f"with recursive {_Q} select lang, n, quota from f where i > 0",
    "balanced_samples": f"with recursive {_Q}, r as (select doc_id, lang, row_number() over (partition by lang order by substr(md5(doc_id::varchar), 1, 8), doc_id) r from documents) select r.doc_id, r.lang from r join f on r.lang is not distinct from f.lang and i > 0 where r <= quota",
    "worker_outcomes": """with t as (select event_id id, event_type p, event_id % 5 r, event_id % 11 <> 0 ran, event_id % 3 = 0 failed from events), x as (select 'done' kind, p, r, id::varchar id from t where ran and not failed union all select 'dead', p, r + 1, id::varchar from t where ran and failed and r + 1 > 3
        union all select 'again', p, r + (ran)::int, id::varchar from t where not ran or (failed and r + 1 <= 3) union all select 'follow_up', 'index ' || p, 0, substr(sha256(id || ':index ' || p), 1, 16) from t where ran and not failed and id % 4 = 1)
        select kind, p payload, count(*) n, sum(r)::bigint retries, min(id) as first from x group by 1, 2""",
    "observed_stats": r"""with d as (select coalesce(text, '') t from documents), r as (select t, case when length(t) < 200 then 'too_short' when length(t) > 5000 then 'too_long' when contains(t, '$') then 'other' end why, regexp_matches(t, '[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z]+')::int pii, len(t) - len(replace(t, chr(10), '')) lines from d),
        x as (select 'input' kind, '' as name, 'document' unit, count(*) n from r union all select 'output', '', 'document', count(*) from r where why is null union all select 'dropped', why, case why when 'too_long' then 'overlong' else 'document' end, count(*) from r where why is not null group by all
        union all select 'modified', 'pii', 'document', sum(pii) from r where why is null union all select 'modified', 'lines', 'document', sum(lines) from r where why is null) select 'gate1' gate, kind, name, unit, n::bigint n from x where n > 0 or kind in ('input', 'output')""",
}
