"""The whole cleaning run: two gates, the model's verdict and extraction, merging, triage; one outcome a session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import UNCERTAIN_WORDS, has_any, masked
from ..functions.textops import dedup_key
from ..sources.tables import cut
from . import dialogue, knowledge, review
from .rag_text import ask_each, ask_model, lenient_json

ANSWER = "has_knowledge boolean, generalizable double, outdated boolean, quality double, confidence double, items array<struct<question string, answer string, confidence double>>"


def _verdict(a) -> F.Column:
    """Why a model's answer yields nothing, or null; the first reason that holds."""
    return (
        F.when(a.isNull() | ~F.coalesce(a["has_knowledge"], F.lit(False)), "no_knowledge")
        .when(F.coalesce(a["outdated"], F.lit(False)), "outdated")
        .when(F.coalesce(a["generalizable"], F.lit(0.0)) < 0.5, "not_general")
        .when(F.coalesce(a["quality"], F.lit(0.0)) < 0.5, "low_quality")
        .when(F.size(F.coalesce(a["items"], F.array().cast("array<struct<question string, answer string, confidence double>>"))) == 0, "nothing_extracted")
    )


VERDICT = "has_knowledge boolean, generalizable double, outdated boolean, quality double, confidence double"
ITEMS = "array<struct<question string, answer string, confidence double>>"


def _judge(a) -> F.Column:
    """Why a session is not worth extracting from, or null; the first reason that holds."""
    return (
        F.when(a.isNull() | ~F.coalesce(a["has_knowledge"], F.lit(False)), "no_knowledge")
        .when(F.coalesce(a["outdated"], F.lit(False)), "outdated")
        .when(F.coalesce(a["generalizable"], F.lit(0.0)) < 0.5, "not_general")
        .when(F.coalesce(a["quality"], F.lit(0.0)) < 0.5, "low_quality")
    )


def cascade(asked: DataFrame, triage, extract, in_a_row: int = 10) -> DataFrame:
    """(conv_id, transcript) -> (conv_id, status, stage, failure, reason, quality, confidence, items): two models, the dear one for what the cheap one lets through.

    triage(text) and extract(text) answer with JSON, see ask_each for what
    fails.  status is `infra` where a model could not be asked, at whichever
    stage, with the kind of failure; such a session has no reason, as nobody
    said anything about it.  Triage is written before extraction begins, so that
    no session is asked twice.
    """
    first = cut(ask_each(asked, triage, "transcript", in_a_row).withColumn("v", lenient_json(F.col("answer"), VERDICT)).withColumn("reason", F.when(F.col("status") != "infra", F.when(F.col("status") == "drop", "no_knowledge").otherwise(_judge(F.col("v"))))))
    through = first.where("status <> 'infra' and reason is null").select("conv_id", "transcript", "v")
    second = cut(ask_each(through, extract, "transcript", in_a_row).withColumn("x", lenient_json(F.col("answer"), f"items {ITEMS}")))
    items = F.coalesce("x.items", F.array().cast(ITEMS))
    empty = F.when((F.col("status") != "infra") & (F.size(items) == 0), "nothing_extracted")
    done = second.select("conv_id", "status", F.lit("extract").alias("stage"), "failure", empty.alias("reason"), F.col("v.quality").alias("quality"), F.col("v.confidence").alias("confidence"), items.alias("items"))
    held = first.where("status = 'infra' or reason is not null").select("conv_id", "status", F.lit("triage").alias("stage"), "failure", "reason", F.col("v.quality").alias("quality"), F.col("v.confidence").alias("confidence"), F.array().cast(ITEMS).alias("items"))
    return held.unionByName(done)


def run(turns: DataFrame, client, limits: dialogue.Gate1 | None = None, least_confidence: float = 0.3, most_failures: float = 0.5, products: DataFrame | None = None, attrs: DataFrame | None = None, demand: DataFrame | None = None, extract=None) -> tuple[DataFrame, DataFrame]:
    """(conv_id, turn, role, text) and a model client -> (items, outcomes).

    client answers a batch of sessions with verdict and items at once; with
    `extract`, client and extract are the two models of a cascade, asked session
    by session.  items, approved and pending, are one table with a
    review_status, so that one write has both.

    outcomes has one row for every session but those the model could not be
    asked about, which stay unprocessed; if these are more than `most_failures`
    of all asked, the run stops.  Gate outputs are written once and read by the
    next gate and the outcomes alike.  products (conv_id, product_ids) are what
    sessions are about, once each; attrs (product_id, pos, key, value) are the
    products' attributes, which an item's text may contradict; demand (title,
    asked) is how often a question was asked.  Without products and attrs no
    item is in conflict, without demand none is hot.
    """
    found = cut(dialogue.gate1_whole(dialogue.sessions(turns), limits))
    passed = found.where("drop_reason is null")
    clean = passed.withColumn("turns", F.transform("turns", lambda t: t.withField("content", masked(t["content"])["text"])))
    kept = cut(dialogue.gate2(clean))
    asked = kept.select("conv_id", F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(": "), t["content"])), "\n").alias("transcript"))
    if extract is None:
        asked = cut(ask_model(asked, client, "transcript"))
        answers = asked.where("status <> 'infra'").withColumn("a", lenient_json(F.col("answer"), ANSWER))
        judged = answers.select("conv_id", "a", F.when(F.col("status") == "drop", "no_knowledge").otherwise(_verdict(F.col("a"))).alias("reason"))
    else:
        asked = cut(cascade(asked, client, extract))
        judged = asked.where("status <> 'infra'").select("conv_id", F.struct("quality", "confidence", "items").alias("a"), "reason")
    failed, n = asked.agg(F.count_if(F.col("status") == "infra"), F.count("*")).first()
    if n and failed > most_failures * n:
        raise RuntimeError(f"the model failed for {failed} of {n} sessions")
    judged = cut(judged)
    x = judged.where("reason is null").select("conv_id", F.col("a.quality").alias("quality_score"), F.col("a.confidence").alias("conf"), F.posexplode("a.items").alias("pos", "x"))
    conf = F.coalesce("x.confidence", "conf", F.lit(0.0))
    x = x.where((F.coalesce(F.trim("x.question"), F.lit("")) != "") & (F.coalesce(F.trim("x.answer"), F.lit("")) != "") & (conf >= least_confidence))
    x = x.withColumn("product_ids", F.array().cast("array<bigint>")) if products is None else x.join(products.select("conv_id", F.col("product_ids").cast("array<bigint>").alias("product_ids")), "conv_id", "left").withColumn("product_ids", F.coalesce("product_ids", F.array().cast("array<bigint>")))
    hedged = has_any(F.col("x.answer"), UNCERTAIN_WORDS)
    items = x.select(
        (F.col("conv_id") * 1000 + F.col("pos")).alias("id"), F.concat(F.lit("session:"), F.col("conv_id")).alias("source_ref"), F.lit("qa").alias("biz_type"), F.col("x.question").alias("title"), F.col("x.answer").alias("content"),
        F.array().cast("array<string>").alias("tags"), F.lit(None).cast("long").alias("category_id"), "product_ids", F.when(hedged, F.least(conf, F.lit(0.59))).otherwise(conf).alias("confidence"), "quality_score",
    )
    merged = knowledge.merge_duplicates(items, dedup_key(F.col("biz_type"), F.col("title"), F.col("product_ids")))
    sampled = F.pmod(F.xxhash64("title", F.lit(20260401)), F.lit(10000)) < 500
    conflict, asked = F.lit(False), F.lit(0)
    if attrs is not None:
        bad = review.attribute_conflicts(merged.select("id", "content", "product_ids"), attrs).select("id", F.lit(True).alias("_conflict"))
        merged, conflict = merged.join(bad, "id", "left"), F.coalesce("_conflict", F.lit(False))
    if demand is not None:
        times = demand.groupBy(F.trim("title").alias("_title")).agg(F.sum("asked").alias("_asked"))
        merged, asked = merged.join(times, F.trim("title") == F.col("_title"), "left"), F.coalesce("_asked", F.lit(0))
    out = knowledge.triage(merged, has_any(F.col("content"), UNCERTAIN_WORDS), conflict, asked, sampled).drop("_conflict", "_title", "_asked")
    out = out.withColumn("review_status", F.when(F.col("priority") == "auto", "approved").otherwise("pending"))
    gate1 = found.where("drop_reason is not null").select("conv_id", F.lit("gate1").alias("gate"), F.col("drop_reason").alias("reason"))
    gate2 = passed.join(kept, "conv_id", "left_anti").select("conv_id", F.lit("gate2").alias("gate"), F.lit("no_pair").alias("reason"))
    gate3 = judged.select("conv_id", F.lit("gate3").alias("gate"), F.coalesce("reason", F.lit("extracted")).alias("reason"))
    return out, gate1.unionAll(gate2).unionAll(gate3)
