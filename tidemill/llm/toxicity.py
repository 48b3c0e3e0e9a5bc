"""Toxicity by compression distance: two zstandard dictionaries trained on labelled text, compared window by window.

Both dictionaries begin with the same excerpts of ordinary text.  The toxic
one goes on with excerpts of toxic text: runs of one to `longest` words that
toxic documents hold in many different surroundings and ordinary ones hardly
ever, the most frequent last; the ordinary one with as many bytes of ordinary
text.  So they differ only by what is toxic, and a window of ordinary words
compresses alike under both.  Surroundings are counted, not documents, as
copies of one document repeat all of its words in the same places.

A window is `span` words, each beginning `step` words after the last, over the
whole text; by how many bytes the toxic dictionary makes it shorter is its
saving.  A document has the largest saving and the numbers of windows that save
at least 2, 3, ... 6 bytes; a logistic calibration on labelled rows that no
dictionary was trained on makes them a score.

Labels are read from a sample of at most `sample_toxic` and `sample_ordinary`
training rows, by hash of doc_id, one text for each doc_id, whole; runs are
counted by Spark, so the driver gets the dictionaries' excerpts only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import Words, grams, mix, saved, small

SPAN, STEP, LONGEST = 8, 4, 4
STEPS = (2, 3, 4, 5, 6)
#: Bytes of what both dictionaries share, of the excerpts of each, and the longest piece of a window.
SHARED, OWN, PIECE = 8192, 16384, 2048


def windows(w: Words, span: int = SPAN, step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, begin, end) in bytes of each row's windows; windows over PIECE bytes are cut up."""
    n = w.counts()
    k = np.where(n > 0, np.maximum(0, -(-(n - span) // step)) + 1, 0)
    row = np.repeat(np.arange(len(n)), k)
    at = w.first[row] + (np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)) * step
    begin, end = w.starts[at], w.ends[np.minimum(at + span, w.first[row + 1]) - 1]
    pieces = np.maximum(1, -(-(end - begin) // PIECE))
    if (pieces > 1).any():
        which = np.repeat(np.arange(len(row)), pieces)
        off = (np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * PIECE
        row, begin, end = row[which], begin[which] + off, np.minimum(begin[which] + off + PIECE, end[which])
    return row, begin, end


class Savings:
    """Compressors with the toxic and the ordinary dictionary."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        params = zstandard.ZstdCompressionParameters.from_level(12, write_content_size=False, write_dict_id=False, write_checksum=False, min_match=4, window_log=16, hash_log=13, chain_log=13)
        self.codecs = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params) for d in (toxic, ordinary)]

    def of(self, data: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Bytes that the toxic dictionary saves on each data[begin:end]."""
        if not len(begin):
            return np.zeros(0, np.int64)
        held = zstandard.BufferWithSegments(data, np.c_[begin, end - begin].astype(np.uint64).tobytes())
        own, other = (c.multi_compress_to_buffer(held, threads=1) for c in self.codecs)
        return np.fromiter((len(other[i]) - len(own[i]) for i in range(len(begin))), np.int64, len(begin))


_savings: dict[tuple, Savings] = {}


def features(col: pa.Array, dictionaries: tuple[bytes, bytes]) -> np.ndarray:
    """Of each text: the largest saving, how many windows save so much, and how many there are."""
    if dictionaries not in _savings:
        _savings.clear()
        _savings[dictionaries] = Savings(*dictionaries)
    w = Words(col, lower=True)
    row, begin, end = windows(w)
    d = _savings[dictionaries].of(w.buf.tobytes(), begin, end)
    n = len(w.first) - 1
    out = np.zeros((n, len(STEPS) + 2))
    np.maximum.at(out[:, 0], row, d)
    for i, least in enumerate(STEPS, 1):
        out[:, i] = np.log1p(np.bincount(row[d >= least], minlength=n))
    out[:, -1] = np.log1p(np.bincount(row, minlength=n))
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights, the intercept last, by Newton's method."""
    x = np.c_[x, np.ones(len(x))]
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * np.r_[b[:-1], 0]
        hess = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(np.r_[np.full(len(b) - 1, ridge), 1e-6])
        step = np.linalg.solve(hess, grad)
        b = b - step
        if np.abs(step).max() < 1e-8:
            break
    return b


def _runs(longest: int):
    """(doc_id, text, toxic) -> (run, place, toxic): hashes of runs of words, and of them with the words around."""

    def run(batches):
        for b in small(batches):
            w = Words(b.column(1), lower=True)
            h = w.hashes()
            row = np.repeat(np.arange(len(b)), w.counts())
            toxic = b.column(2).to_numpy()[row]
            before = np.r_[np.uint64(1), h[:-1]] if len(h) else h
            before[w.first[:-1][w.counts() > 0]] = 1
            for n in range(1, longest + 1):
                last = np.arange(n - 1, len(h))
                ok = row[: max(0, len(h) - n + 1)] == row[last]
                at = np.flatnonzero(ok)
                g = grams(h, n)[at]
                after = np.append(h, np.uint64(2))[at + n].copy()
                after[at + n == w.first[row[at] + 1]] = 2
                place = mix(g ^ mix(before[at] ^ mix(after)))
                _, one = np.unique(place, return_index=True)
                yield pa.record_batch([pa.array(g[one].view(np.int64)), pa.array(place[one].view(np.int64)), pa.array(toxic[at][one])], names=["run", "place", "toxic"])

    return run


def _texts(wanted, longest: int):
    """(doc_id, text) -> (run, text): each wanted run that occurs, once a slice."""

    def run(batches):
        for b in small(batches):
            w = Words(b.column(1), lower=True)
            h, row, data = w.hashes(), np.repeat(np.arange(len(b)), w.counts()), w.buf.tobytes()
            for n in range(1, longest + 1):
                at = np.flatnonzero(row[: max(0, len(h) - n + 1)] == row[n - 1 :])
                g = grams(h, n)[at]
                at, g = at[np.isin(g, wanted)], g[np.isin(g, wanted)]
                g, one = np.unique(g, return_index=True)
                words = [[data[w.starts[i + j] : w.ends[i + j]] for j in range(n)] for i in at[one].tolist()]
                yield pa.record_batch([pa.array(g.view(np.int64)), pa.array([b" ".join(x) for x in words], pa.binary())], names=["run", "text"])

    return run


def _ordinary(each: int):
    """(doc_id, text) -> (key, text): of each text the `each` windows of least hash, those over PIECE bytes aside."""

    def run(batches):
        for b in small(batches):
            w = Words(b.column(1), lower=True)
            row, begin, end = windows(w, SPAN, SPAN)
            keep = end - begin < PIECE
            row, begin, end = row[keep], begin[keep], end[keep]
            h = w.hashes()
            key = mix(h[np.searchsorted(w.starts, begin, side="right") - 1] ^ mix((end - begin).astype(np.uint64)))
            order = np.lexsort((key, row))
            rank = np.arange(len(order)) - np.searchsorted(row[order], row[order])
            order = order[rank < each]
            data = w.buf.tobytes()
            yield pa.record_batch([pa.array(key[order].view(np.int64)), pa.array([data[x:z] for x, z in zip(begin[order].tolist(), end[order].tolist())], pa.binary())], names=["key", "text"])

    return run


def train_dictionaries(rows: DataFrame, share: float = 0.02, least: int = 4, odds: float = 3.0, longest: int = LONGEST) -> tuple[bytes, bytes]:
    """(doc_id, text, toxic) -> contents of the toxic and of the ordinary dictionary; empty if nothing is toxic in particular.

    A run is taken if it stands in at least `least` different places of toxic
    texts, and in `share` as many as there are such texts, and if the odds of a
    place are e^odds times those in ordinary texts.
    """
    texts = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    places = rows.mapInArrow(_runs(longest), "run long, place long, toxic int").distinct()
    counts = places.groupBy("run").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("o"))
    found = counts.where(F.col("t") >= max(least, share * texts.get(1, 0)))
    lift = F.log((F.col("t") + 0.5) / (texts.get(1, 0) + 1)) - F.log((F.col("o") + 0.5) / (texts.get(0, 0) + 1))
    # no more runs than a dictionary has bytes for
    marked = {r["run"]: r["t"] for r in found.where(lift > odds).orderBy(F.desc("t"), "run").limit(OWN // 4).collect()}
    if not marked:
        return b"", b""
    wanted = np.sort(np.array(list(marked), np.int64).view(np.uint64))
    said = rows.where("toxic = 1").mapInArrow(_texts(wanted, longest), "run long, text binary").groupBy("run").agg(F.min("text").alias("text")).collect()
    ranked = sorted(((marked[r["run"]], bytes(r["text"])) for r in said), reverse=True)
    taken, size = [], 0
    for _, text in ranked:
        if size + len(text) + 1 <= OWN:
            taken.append(text)
            size += len(text) + 1
    own = b" ".join(reversed(taken)) + b" "
    plain = rows.where("toxic = 0").mapInArrow(_ordinary(2), "key long, text binary").distinct().orderBy("key", "text").limit(8 * (SHARED + OWN) // SPAN).collect()
    other = b" ".join(bytes(r["text"]) for r in plain)
    base = other[len(own) : len(own) + SHARED]
    return base + b" " + own, base + b" " + other[: len(own) - 1].rjust(len(own) - 1) + b" "


def _features(dictionaries):
    def run(batches):
        for b in small(batches):
            f = features(b.column(1), dictionaries.value)
            yield pa.record_batch([b.column(2), pa.array(list(f), pa.list_(pa.float64()))], names=["toxic", "f"])

    return run


def _score(dictionaries, weights):
    def run(batches):
        for b in small(batches):
            f = features(b.column(1), dictionaries.value)
            score = 1 / (1 + np.exp(-np.clip(np.c_[f, np.ones(len(f))] @ weights, -30, 30)))
            yield pa.record_batch([b.column(0), b.column(2), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, sample_toxic: int = 3000, sample_ordinary: int = 5000) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each input row.

    Learns from labelled rows that aren't held out; a doc_id labelled twice is
    toxic if any of its labels is.  Of a doc_id's texts one is learned from.  Null labels and
    doc_ids teach nothing.  Null,
    empty and blank texts are scored as texts without words.  Without a toxic
    or an ordinary row to learn from, or without runs of words that tell them
    apart, every score is the share of toxic rows.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labels.where("doc_id is not null and toxic is not null").withColumn("doc_id", F.col("doc_id").cast("long")).where(fold != 0).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    order = F.xxhash64("doc_id", F.lit(5))
    sample = known.where("toxic = 1").orderBy(order).limit(sample_toxic).unionAll(known.where("toxic = 0").orderBy(order).limit(sample_ordinary))
    sample = spark.createDataFrame(sample.collect(), known.schema)  # at most sample_toxic + sample_ordinary rows
    half = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)) == 0
    # one text for each doc_id, so that a doc_id's repeats do not pass the bound
    rows = d.where("doc_id is not null").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "toxic", half.alias("half"))
    rows = saved(rows, "labelled")
    share = totals.get(1, 0) / max(1, sum(totals.values()))
    weights = np.r_[np.zeros(len(STEPS) + 2), np.log(max(share, 1e-6) / max(1 - share, 1e-6))]
    both = train_dictionaries(rows.where("half")) if {0, 1} <= set(totals) else (b"", b"")
    dictionaries = spark.sparkContext.broadcast(both)
    found = rows.where("not half").mapInArrow(_features(dictionaries), "toxic int, f array<double>").collect() if both[0] else []
    y = np.array([r["toxic"] for r in found])
    if len(set(y.tolist())) == 2:
        part = np.array([totals[t] / max(1, (y == t).sum()) for t in y])
        weights = fit_logistic(np.array([r["f"] for r in found]), y, part * len(y) / part.sum())
    held = d.select("doc_id", "text", F.coalesce(fold == 0, F.lit(False)).alias("held_out"))
    return held.mapInArrow(_score(dictionaries, weights), "doc_id long, held_out boolean, score double, predicted int")
