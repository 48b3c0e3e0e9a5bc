"""Hybrid search as one call, its evaluation on one recall, and routers over its hits."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut
from . import evaluation, retrieval

# Words that point back to something said before.
VAGUE_PRONOUNS = ["这个", "那个", "它", "上面说的", "刚才那个", "这款", "那款"]


@dataclass(frozen=True)
class Index:
    """What a search reads: packed postings of what is asked with their statistics, vectors (doc, vec), and doc -> item."""

    posts: retrieval.Packed
    vectors: DataFrame
    meta: DataFrame

    def only(self, allowed: DataFrame) -> Index:
        """The index of the docs allowed; the statistics stay those of all."""
        keep = allowed.select("doc").distinct()
        return replace(self, posts=self.posts.only(keep), vectors=self.vectors.join(keep, "doc", "left_semi"))


def _top_block(names, matrix, k: int, digits: int):
    """Batches of (doc, vec) -> the k best docs of each query in the task, with ties."""

    def run(batches):
        m = matrix.value
        rows = max(1, (1 << 18) // max(1, len(m)))
        best = retrieval.Best(len(m), k)
        for b in batches:
            b = b.filter(pa.compute.and_(b.column(0).is_valid(), b.column(1).is_valid()))
            for a in range(0, len(b), rows):
                part = b.slice(a, rows)
                vec = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(part), -1)
                best.add(part.column(0).to_numpy(), np.round(vec @ m.T, digits))
        q, d, s = best.rows()
        yield pa.record_batch([names.value.take(pa.array(q)), pa.array(d, pa.int64()), pa.array(s)], names=["query", "doc", "score"])

    return run


def dense_top(queries: DataFrame, items: DataFrame, k: int, digits: int = 6, block: int = 4096) -> DataFrame:
    """(query, qvec) by (doc, vec) -> (query, doc, score, rank): the k nearest by inner product, exact.

    The stated queries go to the tasks in blocks of `block` rows, a pass over
    the items each; a task multiplies matrices and hands on k rows a query.
    Null ids and vectors are left out; vectors are of one length; ties of
    rounded scores go to the least doc; no query or no item gives no row.
    """
    spark = queries.sparkSession
    asked = queries.where("query is not null and qvec is not null").select(F.col("query").cast("long"), F.col("qvec").cast("array<double>"))
    out, held = None, []

    def scored(rows):
        names = spark.sparkContext.broadcast(pa.array([r[0] for r in rows], pa.int64()))
        matrix = spark.sparkContext.broadcast(np.array([r[1] for r in rows]))
        d = items.select(F.col("doc").cast("long").alias("doc"), F.col("vec").cast("array<double>").alias("vec"))
        return d.mapInArrow(_top_block(names, matrix, k, digits), "query long, doc long, score double")

    for r in asked.toLocalIterator():  # one block at a time
        held.append(r)
        if len(held) == block:
            out, held = scored(held) if out is None else out.unionAll(scored(held)), []
    if held:
        out = scored(held) if out is None else out.unionAll(scored(held))
    if out is None:
        out = spark.sql("SELECT 0L AS query, 0L AS doc, 0D AS score WHERE false")
    return retrieval.top_k(out, k, digits)


def recall(terms: DataFrame, vectors: DataFrame, index: Index, df: DataFrame, k: int = 50, digits: int = 6) -> tuple[DataFrame, DataFrame]:
    """Both channels' k best of each query, written once: (query, term, qtf) by words, (query, qvec) by vectors."""
    return cut(dense_top(vectors, index.vectors, k, digits)), cut(retrieval.bm25_top(terms, index.posts, df, k, digits))


def by_item(ranked: DataFrame, meta: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """The best hit of each item, ranked anew, k of a query at most."""
    return retrieval.top_k(retrieval.best_per_item(ranked.drop("rank").join(meta.select("doc", "item"), "doc"), "item"), k, digits)


def fused(dense: DataFrame, sparse: DataFrame, meta: DataFrame, top_k: int, rrf_k: int = 60, sparse_weight: float = 1.0) -> DataFrame:
    """(query, doc, item, score, rank) by reciprocal rank fusion, one hit an item."""
    return by_item(retrieval.fuse([(dense, 1.0), (sparse, sparse_weight)], rrf_k), meta, top_k)


def hybrid_search(terms: DataFrame, vectors: DataFrame, index: Index, top_k: int = 5, recall_k: int = 50, rrf_k: int = 60, sparse_weight: float = 1.0) -> DataFrame:
    """(query, rank, doc, item, score, dense_score, bm25_score, overlap): both channels fused, one hit an item.

    The channels' own scores stay with a hit, 0 where a channel did not find it;
    overlap is the part of the query's weight that the hit's words hold.  A query
    with neither terms nor a vector gives no row.
    """
    df = cut(index.posts.term_stats())
    dense, sparse = recall(terms, vectors, index, df, recall_k)
    hits = fused(dense, sparse, index.meta, top_k, rrf_k, sparse_weight)
    hits = hits.join(dense.select("query", "doc", F.col("score").alias("dense_score")), ["query", "doc"], "left").join(sparse.select("query", "doc", F.col("score").alias("bm25_score")), ["query", "doc"], "left")
    hits = cut(hits)
    cover = retrieval.lexical_coverage(terms, hits, index.posts.posts(hits), df, index.posts.corpus)
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return hits.join(cover.withColumnRenamed("coverage", "overlap"), ["query", "doc"], "left").select("query", "rank", "doc", "item", "score", zero("dense_score"), zero("bm25_score"), zero("overlap"))


def weight_sweep(terms: DataFrame, vectors: DataFrame, index: Index, gold: DataFrame, weights=(0.0, 0.1, 0.5, 1.0), recall_k: int = 50, rrf_k: int = 60) -> DataFrame:
    """Recall and MRR of each channel and of fusions by weight, all on one recall.

    gold: (query, item).  (channel, weight, queries, recall_1, ..., mrr_10); a
    query without a hit counts as missed.
    """
    dense, sparse = recall(terms, vectors, index, cut(index.posts.term_stats()), recall_k)
    runs = [("dense", None, by_item(dense, index.meta, recall_k)), ("bm25", None, by_item(sparse, index.meta, recall_k))]
    runs += [("fused", w, fused(dense, sparse, index.meta, 2 * recall_k, rrf_k, w)) for w in weights]
    queries = gold.select("query").distinct()
    out = None
    for channel, w, ranked in runs:
        found = ranked.join(gold, ["query", "item"]).groupBy("query").agg(F.min("rank").alias("rank"))
        one = evaluation.ranking(queries.join(found, "query", "left")).select(F.lit(channel).alias("channel"), F.lit(w).cast("double").alias("weight"), "*")
        out = one if out is None else out.unionAll(one)
    return out


def gate_report(routed: DataFrame) -> DataFrame:
    """(answerable, route) of each query -> one row of rates: handover over all, leaks, false handovers, direct answers.

    A rate over nothing is 0.
    """
    n, yes = F.count("*"), F.col("answerable")
    rate = lambda part, whole: F.round(F.coalesce(F.try_divide(F.count_if(part), whole), F.lit(0.0)), 6)
    at = lambda r: F.col("route") == r
    return routed.agg(
        F.count_if(yes).alias("positives"), F.count_if(~yes).alias("negatives"), rate(at("handover"), n).alias("handover_rate"), rate(~yes & at("answer"), F.count_if(~yes)).alias("leak_rate"),
        rate(yes & at("handover"), F.count_if(yes)).alias("false_handover_rate"), rate(yes & at("answer"), F.count_if(yes)).alias("direct_answer_rate"),
    )


def threshold(best: Column, vague: Column, answer: float = 0.5, hedge: float = 0.3) -> Column:
    """answer, hedge, clarify or handover, by a query's best score; null is no hit."""
    return F.when(best.isNull() | (best < hedge), "handover").when(best >= answer, "answer").when(vague, "clarify").otherwise("hedge")


def apply_threshold(hits: DataFrame, vague: DataFrame, answer: float = 0.5, hedge: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """hits (query, doc, score) and (query, vague) of all queries -> (query, outcome, max_score), and the hits of those not handed over."""
    best = hits.groupBy("query").agg(F.max("score").alias("max_score"))
    routed = vague.join(best, "query", "left").select("query", threshold(F.col("max_score"), F.coalesce("vague", F.lit(False)), answer, hedge).alias("outcome"), F.coalesce("max_score", F.lit(0.0)).alias("max_score"))
    return routed, hits.join(routed.where("outcome <> 'handover'").select("query"), "query", "left_semi")


def needs_rewrite(query: Column, longest: int = 10) -> Column:
    """A question that is short, or points back to something said before."""
    text = F.trim(F.coalesce(query, F.lit("")))
    return (F.length(text) < longest) | F.exists(F.array(*map(F.lit, VAGUE_PRONOUNS)), lambda w: F.contains(text, w))


def previewable(hits: DataFrame, least: float) -> DataFrame:
    """Hits near enough, or found by their words."""
    return hits.where((F.col("dense_score") >= least) | (F.col("bm25_score") > 0))


def dangling(gold: DataFrame, items: DataFrame) -> DataFrame:
    """Gold items that do not exist, each once."""
    return gold.select("item").distinct().join(items.select("item"), "item", "left_anti")
