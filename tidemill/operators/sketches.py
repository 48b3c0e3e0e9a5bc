"""MinHash signatures as stored, mergeable sketches, and the banded index over them."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut

PRIME = (1 << 31) - 1


def seeds(n: int) -> list[tuple[int, int]]:
    """Factor and offset of each hash, by a rule: powers of two numbers modulo PRIME."""
    a, b, out = 16807, 48271, []
    x, y = a, b
    for _ in range(n):
        x, y = x * a % PRIME, y * b % PRIME
        out.append((x or 1, y))
    return out


def gram_number(gram: Column) -> Column:
    """A number below PRIME for a text, the same everywhere: the first 15 hex digits of its MD5."""
    return F.conv(F.substring(F.md5(gram), 1, 15), 16, 10).cast("long") % PRIME


def signatures(grams: DataFrame, n: int = 64) -> DataFrame:
    """(id, gram) -> (id, sig): for each of n hashes the least value over the id's grams.

    An aggregate: tasks combine first, a gram counts once however often it is
    there, and an id's grams never meet in one array.  Null ids and grams are
    left out; an id without grams has no signature.
    """
    g = grams.where("id is not null and gram is not null").select("id", gram_number(F.col("gram")).alias("x"))
    least = [F.min((F.col("x") * a + b) % PRIME).alias(f"h{i}") for i, (a, b) in enumerate(seeds(n))]
    return g.groupBy("id").agg(*least).select("id", F.array(*[f"h{i}" for i in range(n)]).alias("sig"))


def _gram_keys(c: np.ndarray, width: int) -> np.ndarray:
    """A number for the run of `width` code points at each place, equal for equal runs only."""
    letters, c = np.unique(c, return_inverse=True)
    key, span = c[: len(c) - width + 1].astype(np.int64), len(letters)
    for i in range(1, width):
        if span * len(letters) >= 1 << 62:
            some, key = np.unique(key, return_inverse=True)
            span = len(some)
        key, span = key * len(letters) + c[i : len(c) - width + 1 + i], span * len(letters)
    return key


def _sign(width: int, n: int, most: int = 1_000_000):
    """Batches of (id, piece) -> (id, sig): a row for each piece that has a gram."""
    factors = [(np.uint64(a), np.uint64(b)) for a, b in seeds(n)]
    prime = np.uint64(PRIME)

    def number(gram: str) -> int:
        return int(hashlib.md5(gram.encode()).hexdigest()[:15], 16) % PRIME

    def run(batches):
        known: dict[str, int] = {}

        def signed(ids, texts):
            size = np.array([len(t) for t in texts])
            text, first = "".join(texts), np.r_[0, np.cumsum(np.maximum(size - width + 1, 1))[:-1]]
            start = np.r_[0, np.cumsum(size)[:-1]]
            # short pieces are one gram each, longer ones have theirs by place
            long = np.flatnonzero(size >= width)
            back, of = np.zeros(int(np.maximum(size - width + 1, 1).sum()), np.int64), []
            if len(long):
                key = _gram_keys(np.frombuffer(text.encode("utf-32-le"), np.uint32), width)
                many = size[long] - width + 1
                inner = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                place = np.repeat(start[long], many) + inner
                _, at, back[np.repeat(first[long], many) + inner] = np.unique(key[place], return_index=True, return_inverse=True)
                for p in place[at].tolist():
                    g = text[p : p + width]
                    v = known.get(g)
                    if v is None:
                        v = known[g] = number(g)
                    of.append(v)
            for i in np.flatnonzero(size < width).tolist():
                back[first[i]] = len(of)
                of.append(number(texts[i]))
            if len(known) > most:
                known.clear()
            some = np.array(of, np.uint64)
            sig = np.empty((len(texts), n), np.int64)
            for i, (a, b) in enumerate(factors):
                sig[:, i] = np.minimum.reduceat(((some * a + b) % prime).astype(np.uint32)[back], first)
            flat = pa.array(sig.ravel())
            return pa.record_batch([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * n, pa.int32()), flat)], names=["id", "sig"])

        for b in batches:
            ids, texts, size = [], [], 0
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                t = t.as_py()
                if i is None or not t:
                    continue
                ids.append(i)
                texts.append(t)
                size += len(t)
                if size > 1 << 20:
                    yield signed(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield signed(ids, texts)

    return run


def text_signatures(pieces: DataFrame, width: int, n: int = 64) -> DataFrame:
    """(id, piece) -> (id, sig): `signatures` of the runs of `width` characters of each id's pieces; a shorter piece is one.

    No row is made for a run: a task numbers the runs of about a million
    characters, hashes each different one once, and hands on a signature a piece.
    """
    return merged(pieces.select(F.col("id").cast("long").alias("id"), "piece").mapInArrow(_sign(width, n), "id long, sig array<long>"), "id", n)


def merged(sketches: DataFrame, key: str, n: int = 64) -> DataFrame:
    """(key, sig) of several rows a key -> the signature of all their grams together, without the grams."""
    return sketches.groupBy(key).agg(*[F.min(F.col("sig")[i]).alias(f"h{i}") for i in range(n)]).select(key, F.array(*[f"h{i}" for i in range(n)]).alias("sig"))


def estimate(a: Column, b: Column) -> Column:
    """The share of equal places of two signatures: an estimate of the Jaccard similarity of their grams."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return same / F.size(a)


def bands(sketches: DataFrame, rows: int = 4, n: int = 64) -> DataFrame:
    """(id, sig) -> (id, band, key): a row for each run of `rows` places."""
    keys = [F.struct(F.lit(i // rows).alias("band"), F.array_join(F.slice("sig", i + 1, rows), ",").alias("key")) for i in range(0, n, rows)]
    return sketches.select("id", F.explode(F.array(*keys)).alias("b")).select("id", "b.*")


def near(new: DataFrame, stored: DataFrame, least: float = 0.5, rows: int = 4, n: int = 64) -> DataFrame:
    """(id, stored_id, score): stored signatures that meet a new one in a band and are estimated at `least` or more.

    Of equal signatures the one of the least id goes into the join, on both
    sides, and stands for the others: use `copies` for these.  So a text in a
    third of all rows is one row, and no link between different signatures is
    lost.  Pairs that meet in several bands count once.
    """
    a, b = (cut(s.groupBy("sig").agg(F.min("id").alias("id")).select("id", "sig")) for s in (new, stored))
    met = bands(a, rows, n).join(bands(b, rows, n).withColumnRenamed("id", "stored_id"), ["band", "key"]).select("id", "stored_id").distinct()
    both = met.join(a, "id").join(b.select(F.col("id").alias("stored_id"), F.col("sig").alias("_s")), "stored_id")
    return both.select("id", "stored_id", estimate(F.col("sig"), F.col("_s")).alias("score")).where(F.col("score") >= least)


def copies(sketches: DataFrame) -> DataFrame:
    """(id, lead): each id with the least one of its signature."""
    lead = sketches.groupBy("sig").agg(F.min("id").alias("lead"))
    return sketches.join(lead, "sig").select("id", "lead")


def new_against_stored(new: DataFrame, stored: DataFrame, least: float = 0.5, rows: int = 4, n: int = 64) -> DataFrame:
    """(id, stored_id, score): each new id with its best stored one (ties: the least), by signatures alone."""
    found = near(new, stored, least, rows, n)
    best = found.groupBy("id").agg(F.max_by(F.struct("stored_id", "score"), F.struct("score", -F.col("stored_id"))).alias("b"))
    return copies(new).join(best.withColumnRenamed("id", "lead"), "lead").select("id", "b.stored_id", "b.score")
