"""Queries on text rules over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import claims, rules, textops
from ..sources.tables import cut, latest, without


def _docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


PARAMS = [("amount", r"[$€£][0-9]+(?:\.[0-9]{1,2})?", "<AMOUNT>"), ("date", r"[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}", "<DATE>"), ("digits", r"[0-9]{4,}", "<NUMBER>")]


def parameter_hits(spark, d):
    """Parameters by rule, durations (a number and days, hours or weeks) left alone."""
    p = rules.parameterized(F.coalesce("text", F.lit("")), PARAMS, r"[0-9]+ (?:days|hours|weeks)")
    h = _docs(spark, d).select("doc_id", F.explode(p["hits"]).alias("rule", "n"))
    return h.groupBy("rule").agg(F.sum("n").alias("hits"), F.count("*").alias("texts"))


def guard_counts(spark, d):
    """Conversation turns by the first input rule that stops them, limits set for short texts."""
    t = spark.read.parquet(f"{d}/conversations.parquet")
    return t.groupBy(F.coalesce(rules.guard_input(F.col("text"), 400), F.lit("passed")).alias("verdict")).agg(F.count("*").alias("turns"))


def page_links(spark, d):
    """Hosts that pages are from, and links by host."""
    p = spark.read.parquet(f"{d}/pages.parquet")
    host = F.regexp_extract("url", r"https?://([^/]+)", 1)
    links = F.size(F.regexp_extract_all("html", F.lit(r"(href=)"), F.lit(1)))
    return p.groupBy(host.alias("host")).agg(F.count("*").alias("pages"), F.sum(links).alias("links"))


def page_text(spark, d):
    """Pages' visible words: markup and scripts cut out."""
    p = spark.read.parquet(f"{d}/pages.parquet")
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), r"<[^>]*>", " ")
    words = F.filter(F.split(bare, r"[ \t\r\n\f]+"), lambda w: w != "")
    return p.select("page_id", F.size(words).cast("long").alias("words"))


def sentence_counts(spark, d):
    """Sentences of each document, as cut after . ! ? and at line ends."""
    s = F.filter(F.split(F.coalesce("text", F.lit("")), r"[.!?\n]+"), lambda x: F.trim(x) != "")
    return _docs(spark, d).select("doc_id", F.size(s).cast("long").alias("sentences"), F.coalesce(F.array_max(F.transform(s, F.length)), F.lit(0)).cast("long").alias("longest"))


def dedup_keys(spark, d):
    """Documents of each shared key of source and text."""
    k = textops.dedup_key(F.col("source"), F.col("text"), F.array(F.lit(2), F.lit(1)))
    return _docs(spark, d).groupBy(k.alias("key")).agg(F.count("*").alias("docs"), F.min("doc_id").alias("first")).where("docs > 1")


def term_overlap(spark, d):
    """Jaccard of the words of every document with the next one's."""
    a = _docs(spark, d).select("doc_id", F.array_distinct(textops.tokenize(F.col("text"))).alias("a"))
    b = a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b"))
    return a.join(b, "doc_id").select("doc_id", F.round(textops.jaccard(F.col("a"), F.col("b")), 6).alias("score"))


def upsert_latest(spark, d):
    """Embeddings after an upsert of every fifth with a new label and a delete of every seventh."""
    v = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "label")
    new = v.where("vec_id % 5 = 0").withColumn("label", F.lit(99))
    return without(latest(v, new, ["vec_id"]), v.where("vec_id % 7 = 0"), ["vec_id"]).groupBy("label").agg(F.count("*").alias("vectors"), F.sum("vec_id").alias("ids"))


def number_claims(spark, d):
    """Different numbers that documents state."""
    return _docs(spark, d).select("doc_id", F.size(claims.numbers(F.col("text"))).cast("long").alias("numbers")).where("numbers > 0")


def unsourced_numbers(spark, d):
    """Numbers of each document that the one after it does not have, the least first."""
    stated = cut(_docs(spark, d).select("doc_id", claims.numbers(F.col("text")).alias("n")))  # a text is read once, and does not meet the next
    after = stated.select((F.col("doc_id") - 1).alias("doc_id"), F.col("n").alias("known"))
    found = stated.join(after, "doc_id").where(F.size(F.array_except("n", "known")) > 0)
    return found.select("doc_id", F.array_join(claims.missing(F.col("n"), F.col("known")), ",").alias("numbers"))


def answer_guard(spark, d):
    """Turns by role that a guard of answers would flag."""
    g = spark.read.parquet(f"{d}/conversations.parquet").select("role", rules.guard_output(F.col("text"), 200, ("example.com",)).alias("g"))
    return g.groupBy("role").agg(F.count_if("g.too_long").alias("too_long"), F.count_if("g.uncited").alias("uncited"), F.count_if("g.rewritten").alias("rewritten"), F.count_if("g.blocked").alias("blocked"))


QUERIES = {f.__name__: f for f in (parameter_hits, guard_counts, page_links, page_text, sentence_counts, dedup_keys, term_overlap, upsert_latest, number_claims, unsourced_numbers, answer_guard)}

_N = r"n as (select doc_id, list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '[0-9]+(?:\.[0-9]+)?'), lambda x: case when ltrim(x, '0') = '' then '0' else ltrim(x, '0') end)) n from documents)"
ORACLES = {
    "number_claims": f"with {_N} select doc_id, len(n) numbers from n where len(n) > 0",
    "unsourced_numbers": f"with {_N}, u as (select a.doc_id, unnest(list_filter(a.n, lambda x: not list_contains(b.n, x))) x from n a join n b on b.doc_id = a.doc_id + 1) select doc_id, string_agg(x, ',' order by floor(x::double), x) numbers from u group by 1",
    "answer_guard": r"select role, count(*) filter (length(regexp_replace(text, 'https?://[^\s/]+', '', 'g')) > 200) too_long, count(*) filter (regexp_matches(regexp_replace(text, 'https?://[^\s/]+', '', 'g'), '[0-9]') and not regexp_matches(text, '\[#[0-9]+\]')) uncited, count(*) filter (regexp_matches(text, 'https?://[^\s/]')) rewritten, count(*) filter (coalesce(text, '') = '') blocked from conversations group by 1",
    "parameter_hits": r"""with s as (select doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '[0-9]+ (?:days|hours|weeks)')) p from documents),
        a as (select doc_id, len(regexp_extract_all(p, '[$€£][0-9]+(?:\.[0-9]{1,2})?')) n1, regexp_replace(p, '[$€£][0-9]+(?:\.[0-9]{1,2})?', '<AMOUNT>', 'g') p from s),
        b as (select doc_id, n1, len(regexp_extract_all(p, '[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}')) n2, regexp_replace(p, '[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}', '<DATE>', 'g') p from a),
        c as (select doc_id, sum(n1)::bigint n1, sum(n2)::bigint n2, sum(len(regexp_extract_all(p, '[0-9]{4,}')))::bigint n3 from b group by 1)
        select rule, sum(n)::bigint hits, count(*) texts from (select 'amount' rule, n1 n from c union all select 'date', n2 from c union all select 'digits', n3 from c) where n > 0 group by 1""",
    "guard_counts": r"""select case when length(trim(coalesce(text, ''))) = 0 then 'empty' when length(text) > 400 then 'too_long' when regexp_matches(text, '(?i)(?:forget|ignore)\s*(?:previous|above|all)?\s*(?:instruction|prompt|rule)|system\s*prompt|jailbreak|developer\s*mode') then 'injection' else 'passed' end verdict, count(*) turns from conversations group by 1""",
    "page_links": "select regexp_extract(url, 'https?://([^/]+)', 1) host, count(*) pages, sum(len(regexp_extract_all(html, 'href=')))::bigint links from pages group by 1",
    "page_text": r"""select page_id, len(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\r\n\f]+'), lambda w: w <> '')) words from pages""",
    "sentence_counts": r"with a as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[.!?\n]+'), lambda x: trim(x, ' ') <> '') s from documents) select doc_id, len(s) sentences, coalesce(list_max(list_transform(s, lambda x: length(x))), 0) longest from a",
    "dedup_keys": "with a as (select doc_id, substr(sha256(source || '|' || trim(text, ' ') || '|[1, 2]'), 1, 16) as key from documents) select key, count(*) docs, min(doc_id) as first from a group by 1 having count(*) > 1",
    "term_overlap": "with a as (select doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) s from documents), b as (select a.doc_id, len(list_intersect(a.s, b.s)) i, len(a.s) + len(b.s) n from a join a b on b.doc_id = a.doc_id + 1) select doc_id, round(coalesce(i / nullif(n - i, 0), 0), 6) score from b",
    "upsert_latest": "select case when vec_id % 5 = 0 then 99 else label end as label, count(*) vectors, sum(vec_id)::bigint ids from embeddings where vec_id % 7 <> 0 group by 1",
}
