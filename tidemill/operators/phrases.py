"""Many words at once: which of a list's words a text holds, where, and the longest first.

An Aho-Corasick automaton finds all words of a list in one walk over a text,
however long the list is.  Automata are made from blocks of the list, bounded
in bytes; each is broadcast for one walk over the texts.  Lists of any size
therefore work, and a list within one block costs one walk.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import cut

#: Bytes of words in one automaton.
BLOCK = 8 << 20


def _blocks(words: DataFrame, size: int) -> list[DataFrame]:
    """(word) dealt by hash into as many parts as their bytes ask for."""
    total = words.agg(F.coalesce(F.sum(F.octet_length("word") + 16), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-total // size))
    return [words.where(F.pmod(F.xxhash64("word"), F.lit(n)) == i) for i in range(n)]


def _matcher(words):
    """The automaton of a process, made once."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for w in words:
        machine.add_word(w, w)
    machine.make_automaton()
    return machine


_made: dict[str, object] = {}


def _walk(words, key: str):
    """(id, text) -> (id, word, at) of every occurrence, overlapping ones too; at counts characters from 0."""

    def run(batches):
        if _made.get("key") != key:
            _made.update(key=key, machine=_matcher(words.value))
        machine = _made["machine"]
        for b in batches:
            ids, found, at = [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                if text and len(machine):
                    for end, word in machine.iter(text):
                        ids.append(i)
                        found.append(word)
                        at.append(end - len(word) + 1)
                if len(ids) > 200_000:
                    yield pa.record_batch([b.column(0).take(pa.array(ids, pa.int64())), pa.array(found, pa.string()), pa.array(at, pa.int64())], names=["id", "word", "at"])
                    ids, found, at = [], [], []
            yield pa.record_batch([b.column(0).take(pa.array(ids, pa.int64())), pa.array(found, pa.string()), pa.array(at, pa.int64())], names=["id", "word", "at"])

    return run


def occurrences(texts: DataFrame, words: DataFrame, size: int = BLOCK) -> DataFrame:
    """texts (id, text), words (word) -> (id, word, at): every place where a text holds a word, overlaps included.

    Null texts and null or empty words hold nothing and are held by nothing;
    repeated words count once, repeated rows of texts again.
    """
    spark = texts.sparkSession
    w = cut(words.select("word").where("length(word) > 0").distinct())
    kind = dict(texts.dtypes)["id"]
    out = None
    for part in _blocks(w, size):
        held = spark.sparkContext.broadcast([r["word"] for r in part.collect()])  # at most about `size` bytes
        found = texts.select("id", "text").mapInArrow(_walk(held, uuid.uuid4().hex), f"id {kind}, word string, at long")
        out = found if out is None else out.unionAll(found)
    return out


def held_words(texts: DataFrame, words: DataFrame, size: int = BLOCK) -> DataFrame:
    """(id, word, n): the words each id's texts hold, and how often; places that overlap count each."""
    return occurrences(texts, words, size).groupBy("id", "word").agg(F.count("*").alias("n"))


def longest_words(texts: DataFrame, words: DataFrame, size: int = BLOCK) -> DataFrame:
    """(id, word, at): from left to right the longest word at the first place where one begins, then on behind it.

    Ids must be unique among the texts.  A text's places are taken in order; of
    those that begin at one place only the longest can be taken.
    """
    every = occurrences(texts, words, size).groupBy("id", "at").agg(F.max_by("word", F.length("word")).alias("word"))
    kind = dict(texts.dtypes)["id"]
    ordered = every.repartition("id").sortWithinPartitions("id", "at")
    return ordered.select("id", "word", "at").mapInArrow(_leftmost, f"id {kind}, word string, at long")


def _leftmost(batches):
    """Sorted places -> those taken; an id may go on in the next batch."""
    last, free = None, 0
    for b in batches:
        keep = []
        for i, (key, word, at) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist())):
            if key != last:
                last, free = key, 0
            if at >= free:
                keep.append(i)
                free = at + len(word)
        yield b.take(pa.array(keep, pa.int64()))


def ranked_words(texts: DataFrame, words: DataFrame, limit: int) -> DataFrame:
    """(word, texts, times, rank): a report of the `limit` words that most texts hold, ties in order of the word."""
    h = held_words(texts, words).groupBy("word").agg(F.count("*").alias("texts"), F.sum("n").alias("times"))
    top = h.orderBy(F.desc("texts"), "word").limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("texts"), "word")))  # `limit` rows
