"""Language ID: each document's mixture of languages by expectation-maximisation.

Byte trigrams of letters, hashed to 2^16 cells, are counted for every learned
language over all training rows: per task first, then by language and part of
the tasks, then by language, so what reaches the driver is one table of fixed
size for each language.  A word's
likelihood in a language is the product of its trigrams'.  For each document,
expectation-maximisation over its words estimates the languages' shares with
one, two, ... languages allowed, the likeliest by the full mixture first, and
the set of the best penalised likelihood is kept: each language beyond the
first costs `penalty` times half the logarithm of the words (BIC).  Sizes end
where even the likeliest mixture of all could not pay for one language more.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import LOWER, saved, small, utf8

CELLS = 1 << 16
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
UNKNOWN = "und"
TREE = 64
#: What is broadcast has 256 KB for each language.
MOST_LANGUAGES = 1000


def _trigrams(col: pa.Array):
    """Of a batch: a cell for each letter, words' first letters, and words by row."""
    buf, offs = utf8(col)
    letter = LETTER[buf]
    n = len(buf)
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    b = np.where(letter, LOWER[buf], 32).astype(np.uint32)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    left, right = np.r_[np.uint32(32), b[:-1]], np.r_[b[1:], np.uint32(32)]
    left[edge[:n]] = 32
    right[edge[1:]] = 32
    code = ((left << np.uint32(16)) | (b << np.uint32(8)) | right) * np.uint32(2654435761)
    at = np.flatnonzero(letter)
    cells = (code[at] >> np.uint32(16)).astype(np.int64)
    starts = np.flatnonzero(left[at] == 32)
    first = np.searchsorted(at[starts], offs)
    return cells, starts, first


def _count(batches):
    """(lang, text) of training rows -> one table of counts for each language of the task."""
    total: dict[str, np.ndarray] = {}
    for b in small(batches):
        langs = b.column(0).dictionary_encode()
        names, index = langs.dictionary.to_pylist(), langs.indices.to_numpy()
        cells, starts, first = _trigrams(b.column(1))
        letters = np.diff(np.r_[starts, len(cells)])
        words = np.repeat(np.repeat(index, np.diff(first)), letters)
        counts = np.bincount(words * CELLS + cells, minlength=len(names) * CELLS).reshape(len(names), CELLS)
        for name, c in zip(names, counts):
            total[name] = total[name] + c if name in total else c
    yield _tables(total)


def _tables(total: dict) -> pa.RecordBatch:
    return pa.record_batch([pa.array(list(total), pa.string()), pa.array([zlib.compress(c.astype("<i8").tobytes(), 1) for c in total.values()], pa.binary())], names=["lang", "counts"])


def _add(batches):
    total: dict[str, np.ndarray] = {}
    for b in batches:
        for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            c = np.frombuffer(zlib.decompress(data), "<i8")
            total[name] = total[name] + c if name in total else c
    yield _tables(total)


def learn(rows: DataFrame, smooth: float = 0.05) -> tuple[list[str], np.ndarray]:
    """(text, lang) rows -> languages in order, and log-probabilities by language and cell."""
    kind = "lang string, counts binary"
    counts = rows.select("lang", "text").mapInArrow(_count, kind)
    counts = counts.repartition("lang", F.pmod(F.spark_partition_id(), F.lit(TREE))).mapInArrow(_add, kind)
    counts = counts.repartition("lang").mapInArrow(_add, kind)
    counts = saved(counts, "languages")
    langs = counts.where("lang is not null").count()
    if langs > MOST_LANGUAGES:
        raise ValueError(f"{langs} languages: a table of 256 KB for each is broadcast, {MOST_LANGUAGES} at most")
    counts = counts.collect()
    counts = sorted((r["lang"], np.frombuffer(zlib.decompress(r["counts"]), "<i8")) for r in counts if r["lang"])
    if not counts:
        return [], np.zeros((0, CELLS), np.float32)
    c = np.stack([x[1] for x in counts]) + smooth
    return [x[0] for x in counts], np.log(c / c.sum(1, keepdims=True)).astype(np.float32)


def _mixtures(ll: np.ndarray, first: np.ndarray, allowed: np.ndarray, rounds: int):
    """Shares and log-likelihoods of documents, with the allowed languages of each only.

    ll: words by languages, each word's best at 0; first: first words, none empty.
    """
    n = np.diff(np.r_[first, len(ll)])
    share = allowed / allowed.sum(1, keepdims=True)
    like = np.exp(ll)
    for _ in range(rounds):
        part = like * np.repeat(share, n, axis=0)
        whole = part.sum(1, keepdims=True) + 1e-30
        share = np.add.reduceat(part / whole, first, axis=0) / n[:, None]
    whole = (like * np.repeat(share, n, axis=0)).sum(1) + 1e-30
    return share, np.add.reduceat(np.log(whole), first)


def fit(col: pa.Array, table: np.ndarray, rounds: int = 6, penalty: float = 4.0) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: shares by language (all 0: no letter), as chosen by penalised likelihood, and how far a letter is likelier than by chance, in logarithms."""
    cells, starts, first = _trigrams(col)
    rows, langs = len(first) - 1, len(table)
    share, gain = np.zeros((rows, langs)), np.zeros(rows)
    words = np.diff(first)
    has = np.flatnonzero(words)
    if not len(has) or not langs:
        return share, gain
    ll = np.add.reduceat(table[:, cells], starts, axis=1).T
    peak = ll.max(1)
    ll -= peak[:, None]
    # one strange word, or markup inside one, is not a language
    np.maximum(ll, -12, out=ll)
    at, n = first[:-1][has], words[has]
    full, like = _mixtures(ll, at, np.ones((len(has), langs)), rounds)
    order = np.argsort(-full, axis=1, kind="stable")
    # the likelihood is concave in the shares: no mixture is likelier than this one by more than its steepest slope less n
    likes = np.exp(ll)
    slope = np.add.reduceat(likes / ((likes * np.repeat(full, n, axis=0)).sum(1, keepdims=True) + 1e-30), at, axis=0).max(1)
    bound = np.minimum(like + np.maximum(slope - n, 0), 0)
    each = penalty * 0.5 * np.log(n + 1)
    best, chosen = np.full(len(has), -np.inf), np.zeros(len(has))
    for m in range(1, langs + 1):
        open_ = np.flatnonzero(bound - (m - 1) * each > best)
        if not len(open_):
            break
        k = n[open_]
        begin = np.r_[0, np.cumsum(k)[:-1]]
        part = ll if len(open_) == len(has) else ll[np.arange(k.sum()) + np.repeat(at[open_] - begin, k)]
        allowed = np.zeros((len(open_), langs))
        np.put_along_axis(allowed, order[open_, :m], 1, axis=1)
        own, like = _mixtures(part, begin, allowed, rounds if m > 1 else 1)
        paid = like - (m - 1) * each[open_]
        better = paid > best[open_]
        best[open_[better]], chosen[open_[better]] = paid[better], like[better]
        share[has[open_[better]]] = own[better]
    letters = np.add.reduceat(np.diff(np.r_[starts, len(cells)]), at)
    gain[has] = (np.add.reduceat(peak, at) + chosen) / letters + np.log(CELLS)
    return share, gain


def infer(col: pa.Array, table: np.ndarray, rounds: int = 6, penalty: float = 4.0):
    """Of each text: shares by language (all 0: no letter), as chosen by penalised likelihood."""
    return fit(col, table, rounds, penalty)[0]


def _has_letter(texts: list, share: np.ndarray) -> np.ndarray:
    """A letter in Unicode's sense: bytes from 128 on count as letters only until here."""
    return np.array([s and any(c.isalpha() for c in t) for s, t in zip(share.any(1).tolist(), texts)], bool)


def _predict(langs, model, text_at: int, keep_at: list[int], only_kept: bool):
    def run(batches):
        table = model.value
        for b in small(batches, col=text_at):
            share, gain = fit(b.column(text_at), table)
            known = _has_letter(b.column(text_at).to_pylist(), share)
            top = share.argmax(1) if len(langs) else np.zeros(len(b), np.int64)
            score = np.where(known, share[np.arange(len(b)), top] if len(langs) else 0.0, 0.0)
            if only_kept:
                yield b.filter(pa.array(known & (gain >= 0)))
                continue
            pred = [langs[i] if k else UNKNOWN for i, k in zip(top.tolist(), known.tolist())]
            sets = [[langs[j] for j in np.argsort(-s, kind="stable") if s[j] > 0] if k else [] for s, k in zip(share, known.tolist())]
            yield pa.record_batch([b.column(i) for i in keep_at] + [pa.array(pred, pa.string()), pa.array(np.minimum(score, 1.0)), pa.array(sets, pa.list_(pa.string()))], names=["doc_id", "held_out", "lang_pred", "score", "languages"])

    return run


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text, lang and the fold; a null doc_id is never held out."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.coalesce(fold == 0, F.lit(False)).alias("held_out"))


def language_id(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, languages), a row for each input row.

    Learns from rows that aren't held out and have a lang; predicts from the
    text alone.  A null, empty or letterless text, or nothing learned, gives
    `und`, score 0 and no languages.  Ties go to the language first in order.
    Repeated rows count and are predicted each; other columns are ignored.
    """
    rows = _rows(docs)
    langs, table = learn(rows.where("not held_out and lang is not null"))
    model = docs.sparkSession.sparkContext.broadcast(table)
    return rows.select("doc_id", "text", "held_out").mapInArrow(_predict(langs, model, 1, [0, 2], False), "doc_id long, held_out boolean, lang_pred string, score double, languages array<string>")


def keep_known_languages(docs: DataFrame) -> DataFrame:
    """The rows, as they are, whose letters are likelier under their mixture than by chance, however many languages it holds; `und` goes.

    Null, empty and letterless texts go, and all rows if no lang is known.
    Rows alike are judged alike; a null doc_id does not matter; all columns,
    whatever their names, stay.  An empty table gives an empty table.
    """
    langs, table = learn(_rows(docs).where("not held_out and lang is not null"))
    model = docs.sparkSession.sparkContext.broadcast(table)
    return docs.mapInArrow(_predict(langs, model, docs.columns.index("text"), [], True), T.StructType(docs.schema.fields))
