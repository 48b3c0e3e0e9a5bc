"""Best-fit packing: documents into bins of equal capacity, without conflicts.

A bin holds no two documents of one source and none of one duplicate cluster
(a component of near copies, from ngram_join).  Documents are dealt into shards of about
`shard_docs` by a hash of their id, so a hot source or cluster is spread over
all shards; a shard's rows are ids and sizes, never texts.  In a shard, pieces go
longest first.  Open bins are kept ordered by residual; the search starts at
the least residual that holds the piece and goes on to the successor until the
bin's source and cluster bitmaps are free of the piece's bits, which is the
tightest compatible bin.  A document longer than a bin is cut into full bins
and a rest.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ngram_join import ngram_join
from .text import saved

PLACED = "doc_id long, piece int, first_word long, n_words long, size long, bin long, bin_offset long"


def pack(rows: list[tuple], capacity: int) -> list[tuple]:
    """(doc_id, source, n_words, cluster) -> (doc_id, piece, first_word, n_words, size, bin, offset).

    A document takes its words and one end mark; a null source conflicts with none.
    """
    source_bit: dict = {}
    cluster_bit: dict = {}
    seen: set = set()
    for _, source, n, cluster in rows:
        if source is not None:
            source_bit.setdefault(source, 1 << len(source_bit))
        if n and cluster in seen:
            cluster_bit.setdefault(cluster, 1 << len(cluster_bit))
        seen.add(cluster)
    out, todo, bins = [], [], 0
    for doc, source, n, cluster in rows:
        piece, left = 0, n + 1
        while left > capacity:
            out.append((doc, piece, piece * capacity, capacity, capacity, bins, 0))
            bins += 1
            piece, left = piece + 1, left - capacity
        todo.append((left, doc is None, doc or 0, piece, source_bit.get(source, 0), cluster_bit.get(cluster, 0) if n else 0, doc))
    todo.sort(key=lambda x: (-x[0], *x[1:4]))
    open_: list[tuple[int, int]] = []
    sources: dict[int, int] = {}
    clusters: dict[int, int] = {}
    for size, _, _, piece, s, c, doc in todo:
        i = bisect_left(open_, (size, -1))
        while i < len(open_) and (sources[open_[i][1]] & s or clusters[open_[i][1]] & c):
            i += 1
        if i < len(open_):
            residual, at = open_.pop(i)
        else:
            residual, at = capacity, bins
            sources[at] = clusters[at] = 0
            bins += 1
        out.append((doc, piece, piece * capacity, size - 1, size, at, capacity - residual))
        sources[at] |= s
        clusters[at] |= c
        if residual > size:
            insort(open_, (residual - size, at))
    return out


def _pack(capacity: int):
    def run(_key, table):
        cols = [table.column(c).to_pylist() for c in ("doc_id", "source", "n", "cluster")]
        shard = table.column("shard")[0].as_py()
        placed = pack(list(zip(*cols)), capacity)
        kinds = (pa.int64(), pa.int32(), *[pa.int64()] * 5)
        cols = list(zip(*((*x[:5], (shard << 32) + x[5], x[6]) for x in placed)))
        return pa.table({f.split()[0]: pa.array(c, t) for f, c, t in zip(PLACED.split(", "), cols, kinds)})

    return run


def best_fit_packing(docs: DataFrame, capacity: int = 2048, shard_docs: int = 8192) -> DataFrame:
    """(doc_id, piece, first_word, n_words, size, bin, bin_offset): where each piece lies.

    Sizes count words and an end mark for each document.  Clusters are the
    components of ngram_join (five-word n-grams, Jaccard of 0.75 or more), found
    on the texts given.  Null, empty and blank texts take their end mark only
    and are in no cluster.  Repeated rows are placed each, in different bins
    (they are one cluster).  A null doc_id is placed too.  Ties go by doc_id.
    Other columns are ignored; an empty table gives an empty table.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    total, known = rows.agg(F.count("*"), F.countDistinct("doc_id")).first()
    shards = max(1, -(-total // shard_docs))
    if known == total:
        rows = rows.select(F.col("doc_id").alias("row_id"), "doc_id", "source", "text")
    else:  # rows of one doc_id may have other texts, so each needs an id that stays
        rows = saved(rows.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "source", "text"), "rows")
    # words are counted where the n-grams are, so texts are not read for them again
    clusters = ngram_join(rows, id_col="row_id", words=True).select(F.col("doc_id").alias("row_id"), F.col("component_id").alias("cluster"), F.col("n_words").alias("n"))
    sized = rows.select("row_id", "doc_id", "source").join(clusters, "row_id")
    sized = sized.select("doc_id", "source", "n", "cluster", F.pmod(F.xxhash64("row_id", "cluster"), F.lit(shards)).alias("shard"))
    return sized.groupBy("shard").applyInArrow(_pack(capacity), PLACED)
