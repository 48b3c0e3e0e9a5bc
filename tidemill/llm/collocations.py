"""Phrase collocations: exact counts by weighted acyclic automata, shard by shard.

A phrase of `least` occurrences has only parts of as many, so runs with a rare
word, pair or triple need no counting:

1. Three passes over the texts count hashes of words, of pairs of words kept,
   and of triples of pairs kept.  A hash's count is never below that of what it
   stands for.  Hashes of `least` and more go into a sieve, a bit array of at
   most 2^28 bits: what it lets through by chance is only counted for nothing.
2. A fourth pass takes the runs of 1 to 5 words that the sieves let through.
   Each task is a shard: its sorted runs, as words, become count transducers,
   one for each range of prefixes (hashes of the first two words).
3. A range's transducers are united, their weights summed, and phrases below
   `least` left out.  From here on counts are exact and by text.
4. Each range asks for the counts of its phrases' parts: the wanted parts,
   sorted, are automata too, sent to the ranges that hold them and composed
   with their counts there.

Scores, containment and ranks are joins and windows over what is left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .automata import Automaton, union
from .kneser_ney import BLOBS, Tally, _totals, _word_bounds
from .text import LOWER, M64, STEP, buckets, grams, mix, saved, small, span_hashes, utf8

BREAKS = np.zeros(256, bool)
BREAKS[list(b".,;:!?\n\x0b\x0c\r")] = True
GAPS = BREAKS.copy()
GAPS[[32, 9]] = True
LONGEST = 5
#: Bits of a sieve for each hash it holds, and the most of all.
SPARSE, MOST_BITS = 16, 28
HELD_PHRASES = 400_000
SLICE = 1 << 22


class Runs:
    """Words of a batch (lang, text): byte starts and ends, hashes that differ by language, and the piece each lies in."""

    def __init__(self, batch: pa.RecordBatch):
        buf, offs = utf8(batch.column(1))
        buf = LOWER[buf]
        n = len(buf)
        gap = GAPS[buf]
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        begin, end = ~gap, ~gap
        if n:
            begin[1:] &= gap[:-1] | edge[1:n]
            end[:-1] &= gap[1:] | edge[1:n]
        self.buf, self.starts, self.ends = buf, np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, offs)
        langs = batch.column(0).dictionary_encode()
        self.langs = langs.dictionary.to_pylist()
        self.lang = np.repeat(langs.indices.to_numpy(zero_copy_only=False), np.diff(self.first))
        salt = np.array([_salt(x) for x in self.langs] or [0], np.uint64)
        self.keys = mix(span_hashes(buf, self.starts, self.ends) ^ salt[self.lang]) if len(self.starts) else np.zeros(0, np.uint64)
        cut = np.cumsum(BREAKS[buf] | edge[:n])
        self.piece = cut[self.starts]

    def within(self, k: int) -> np.ndarray:
        """Whether the k words from each one on lie in one piece."""
        n = len(self.starts) - k + 1
        return self.piece[: max(0, n)] == self.piece[k - 1 :][: max(0, n)]


def _salt(lang: str) -> int:
    h = 0xCBF29CE484222325
    for x in lang.encode():
        h = (h ^ x) * 0x100000001B3 & M64
    return h


class Sieve:
    """A Bloom filter of 2^bits bits, two for each hash."""

    def __init__(self, cells: np.ndarray):
        self.cells = cells
        self.shift = np.uint64(64 - (len(cells).bit_length() + 5))

    @staticmethod
    def places(keys: np.ndarray, bits: int) -> np.ndarray:
        shift = np.uint64(64 - bits)
        return np.concatenate([keys >> shift, mix(keys ^ STEP) >> shift])

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = None
        for at in (keys >> self.shift, mix(keys ^ STEP) >> self.shift):
            bit = (self.cells[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
            found = bit if found is None else found & bit
        return found


def _kept(runs: Runs, sieves: list[Sieve], longest: int) -> list[np.ndarray]:
    """For k = 1 to longest: whether the run of k words from each word on is let through by all sieves."""
    out = []
    for k in range(1, longest + 1):
        ok = runs.within(k)
        if k > 1:
            ok = ok & out[-1][: len(ok)] & out[-1][1 : len(ok) + 1]
        if k <= len(sieves) and len(ok):
            at = np.flatnonzero(ok)
            ok[at[~sieves[k - 1].has(grams(runs.keys, k)[at])]] = False
        out.append(ok)
    return out


def _tally(k: int, sieves, bounds):
    """Texts -> packed counts of the hashes of runs of k words whose parts were kept."""

    def run(batches):
        tally = Tally()
        for b in small(batches, SLICE):
            runs = Runs(b)
            ok = _kept(runs, [s.value for s in sieves], k)[-1]
            if ok.any():
                tally.add(grams(runs.keys, k)[ok])
            if tally.size > 3_000_000:
                yield tally.ranges(bounds)
        yield tally.ranges(bounds)

    return run


def _frequent(least: int):
    def run(_key, table):
        keys, counts = _totals(table.column("data").to_pylist())
        keys = keys[counts >= least]
        return pa.table([pa.array([len(keys)], pa.int64()), pa.array([keys.tobytes()], pa.binary())], names=["n", "data"])

    return run


def _cells(bits: int):
    def run(batches):
        for b in batches:
            for data in b.column(0).to_pylist():
                at = np.unique(Sieve.places(np.frombuffer(data, np.uint64), bits))
                cell, start = np.unique(at >> np.uint64(6), return_index=True)
                if len(cell):
                    word = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), start)
                    yield pa.record_batch([pa.array(cell.astype(np.int64)), pa.array(word.view(np.int64))], names=["cell", "bits"])

    return run


def sieve(docs: DataFrame, k: int, sieves: list, least: int, parts: int):
    """The sieve of runs of k words that occur `least` times or more, as a broadcast."""
    spark = docs.sparkSession
    counted = docs.mapInArrow(_tally(k, sieves, _word_bounds(parts)), BLOBS)
    kept = saved(counted.groupBy("bucket").applyInArrow(_frequent(least), "n long, data binary"), "frequent")
    n = kept.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    bits = min(MOST_BITS, max(16, (SPARSE * n).bit_length()))
    rows = kept.select("data").mapInArrow(_cells(bits), "cell long, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    cells = np.zeros(1 << bits - 6, np.uint64)
    cells[rows.column("cell").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return spark.sparkContext.broadcast(Sieve(cells))


def prefix_range(lang: str, phrase: tuple[bytes, ...], parts: int) -> int:
    """The range of a phrase's first two words."""
    h = np.uint64(_salt(lang))
    code = int.from_bytes(_digest(b" ".join(phrase[:2])), "little")
    return int(mix(np.array([code], np.uint64) ^ h)[0]) * parts >> 64


def _digest(data: bytes) -> bytes:
    import hashlib

    return hashlib.blake2b(data, digest_size=8).digest()


class Ranges:
    """prefix_range, kept for the prefixes met before (up to a bound)."""

    def __init__(self, parts: int):
        self.parts, self.known = parts, {}

    def of(self, lang: str, phrase: tuple[bytes, ...]) -> int:
        key = (lang, phrase[:2])
        at = self.known.get(key)
        if at is None:
            if len(self.known) > HELD_PHRASES:
                self.known.clear()
            at = self.known[key] = prefix_range(lang, phrase, self.parts)
        return at


#: What tasks hand on: a transducer of a language and range of prefixes, or a language's number of words.
SHARDS = "lang string, range int, words long, data binary"
SHARD = pa.schema([("lang", pa.string()), ("range", pa.int32()), ("words", pa.int64()), ("data", pa.binary())])


def _transducers(counts: dict[tuple[str, tuple], int], ranges: Ranges):
    """Batches of one automaton for each language and range; rows of a batch stay below about 8 MB."""
    parted: dict[tuple[str, int], list] = {}
    for (lang, phrase), n in counts.items():
        parted.setdefault((lang, ranges.of(lang, phrase)), []).append((phrase, n))
    rows = []
    for (lang, at), items in parted.items():
        rows.append((lang, at, None, Automaton.build(sorted(items)).pack()))
        if sum(len(r[3]) for r in rows[-1:]) > 1 << 22 or len(rows) >= 256:
            yield _batch(rows)
            rows = []
    yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(SHARD)], schema=SHARD)


def _shards(sieves, parts: int):
    """Texts -> count transducers of the runs kept, and the words of each language."""

    def run(batches):
        ranges = Ranges(parts)
        counts: dict[tuple[str, tuple], int] = {}
        words: dict[str, int] = {}
        for b in small(batches, SLICE):
            runs = Runs(b)
            for i, n in enumerate(np.bincount(runs.lang, minlength=len(runs.langs)).tolist()):
                words[runs.langs[i]] = words.get(runs.langs[i], 0) + n
            data = runs.buf.tobytes()
            starts, ends = runs.starts, runs.ends
            for k, ok in enumerate(_kept(runs, [s.value for s in sieves], LONGEST), 1):
                at = np.flatnonzero(ok)
                if not len(at):
                    break
                _, one, n = np.unique(grams(runs.keys, k)[at], return_index=True, return_counts=True)
                one = at[one]
                columns = [[data[a:z] for a, z in zip(starts[one + j].tolist(), ends[one + j].tolist())] for j in range(k)]
                for lang, phrase, c in zip(runs.lang[one].tolist(), zip(*columns), n.tolist()):
                    key = (runs.langs[lang], phrase)
                    counts[key] = counts.get(key, 0) + c
            if len(counts) > HELD_PHRASES:
                yield from _transducers(counts, ranges)
                counts = {}
        yield from _transducers(counts, ranges)
        yield _batch([(lang, None, n, None) for lang, n in words.items()])

    return run


def _unite(least: int):
    """A range's transducers -> one for each language."""

    def run(_key, table):
        rows: dict[str, list] = {}
        for lang, data in zip(table.column("lang").to_pylist(), table.column("data").to_pylist()):
            rows.setdefault(lang, []).append(data)
        at = table.column("range")[0].as_py()
        made = [(lang, at, None, union(map(Automaton.unpack, blobs), least).pack()) for lang, blobs in rows.items()]
        return pa.Table.from_batches([_batch(made)])

    return run


def _phrases(batches):
    """United transducers -> (lang, phrase, size, f)."""
    for b in batches:
        for lang, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            found = list(Automaton.unpack(data))
            for i in range(0, len(found), 50_000):
                part = found[i : i + 50_000]
                yield pa.record_batch(
                    [pa.array([lang] * len(part), pa.string()), pa.array([b" ".join(p).decode() for p, _ in part], pa.string()), pa.array([len(p) for p, _ in part], pa.int32()), pa.array([w for _, w in part], pa.int64())],
                    names=["lang", "phrase", "size", "f"],
                )


def _wanted(parts: int):
    """United transducers -> automata of the parts their phrases are cut into, for the ranges that hold them."""

    def run(batches):
        ranges = Ranges(parts)
        for b in batches:
            for lang, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                want = {(lang, part) for phrase, _ in Automaton.unpack(data) for k in range(1, len(phrase)) for part in (phrase[:k], phrase[k:])}
                yield from _transducers(dict.fromkeys(want, 1), ranges)

    return run


def _answer(counted, wanted):
    """A range's counts composed with what is wanted of it: (lang, part, f)."""
    rows = []
    held = dict(zip(counted.column("lang").to_pylist(), counted.column("data").to_pylist()))
    asked: dict[str, list] = {}
    for lang, data in zip(wanted.column("lang").to_pylist(), wanted.column("data").to_pylist()):
        asked.setdefault(lang, []).append(data)
    for lang, blobs in asked.items():
        if lang in held:
            want = union(map(Automaton.unpack, blobs))
            rows += [(lang, b" ".join(p).decode(), f) for p, f, _ in Automaton.unpack(held[lang]).compose(want)]
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "part", "f"])


def phrase_counts(docs: DataFrame, least: int = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs (lang, text) -> united transducers (lang, range, data), counts of wanted parts (lang, part, f), words (lang, n)."""
    parts = buckets(docs)
    sieves: list = []
    for k in (1, 2, 3):
        sieves.append(sieve(docs, k, sieves, least, parts))
    shards = saved(docs.mapInArrow(_shards(sieves, parts), SHARDS), "shards")
    for s in sieves:
        s.unpersist()
    words = shards.where("words is not null").groupBy("lang").agg(F.sum("words").alias("n"))
    united = shards.where("words is null").groupBy("range").applyInArrow(_unite(least), SHARDS)
    united = saved(united.select("lang", "range", "data"), "united")
    wanted = united.select("lang", "data").mapInArrow(_wanted(parts), SHARDS).select("lang", "range", "data")
    counts = united.groupBy("range").cogroup(wanted.groupBy("range")).applyInArrow(_answer, "lang string, part string, f long")
    return united, counts, words


def collocations(docs: DataFrame, least: int = 100, first: int = 2000, share: int = 100) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to 5 words.

    Texts are lower-cased (A-Z), cut into pieces at [.,;:!?] and line ends, and
    those into words at spaces and tabs; phrases do not cross pieces.  A phrase
    that occurs a >= `least` times in its language is cut after its first k
    words: l and r are the counts of both sides, n all words of the language,
    and the score floor(1000 a n / (l r)), the least over all cuts, ties to the
    smallest k.  Phrases inside a longer one with 100 f >= `share` a go.  Ranked
    by score, a (descending) and phrase (UTF-8 bytes).  Whole numbers throughout;
    a n may reach 38 digits.

    A null text is empty, a null lang `und`.  Rows are texts: repeated rows
    count again.  An empty table gives no rows; other columns are ignored.
    """
    d = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    united, counts, words = phrase_counts(d, least)
    known = saved(united.select("lang", "data").mapInArrow(_phrases, "lang string, phrase string, size int, f long").where("size > 1"), "phrases")
    counts = saved(counts, "parts")

    # whether a phrase lies in a longer one as frequent: then it lies in one that is a word longer
    word = F.split("phrase", " ")
    inner = known.where("size > 2").select("lang", F.explode(F.array(F.array_join(F.slice(word, 1, F.col("size") - 1), " "), F.array_join(F.slice(word, 2, F.col("size") - 1), " "))).alias("phrase"), "f")
    inner = inner.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    free = known.join(inner, ["lang", "phrase"], "left").where(100 * F.coalesce("longer", F.lit(0)) < share * F.col("f")).select("lang", "phrase", "size", F.col("f").alias("a"))

    cuts = free.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice(word, 1, F.col("k")), " ").alias("left"), F.array_join(F.slice(word, F.col("k") + 1, F.col("size")), " ").alias("right"))
    side = lambda name, f: counts.select("lang", F.col("part").alias(name), F.col("f").alias(f))
    cuts = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    languages = words.count()
    cuts = cuts.join(F.broadcast(words) if languages < 10_000 else words, "lang")
    score = F.expr("(cast(1000 as decimal(4, 0)) * cast(a as decimal(17, 0)) * cast(n as decimal(15, 0))) div (cast(l as decimal(18, 0)) * cast(r as decimal(18, 0)))")
    cuts = cuts.withColumn("score", score.cast("long"))
    worst = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    order = Window.partitionBy("lang").orderBy(F.desc("c.score"), F.desc("a"), "phrase")
    ranked = worst.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), "n", F.col("c.score").alias("score"))
