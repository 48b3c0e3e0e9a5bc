"""Substring dedup: words covered by a 35-word window that starts anywhere else go.

The reference is the corpus itself, which has no size bound, so its shards are
routed instead of sent to every task: a window's anchor is the least hash of
the 8-word runs in it, equal windows have equal anchors, and the reference
shard of an anchor is the distinct text around its places.  Consecutive windows
of one anchor form a segment.

1. Segments meet by anchor, as (anchor, segment hash, place).  Anchors seen once
   are dropped; segments seen twice are repeated as a whole; the rest go on,
   one place for each distinct segment, with its count.
2. Those segments' words are cut from the documents.  An anchor with more than
   `shard_segments` distinct segments is cut up by window, equal windows of a
   task being merged first, so no shard grows with the corpus.
3. Each shard's suffix automaton, its states weighted by the places they end
   at, is streamed with the shard's segments for matching statistics: a window
   is repeated where a match of its length ends in a state with two places.
4. Repeated windows come back to their documents; covered words are removed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import STEP, Words, buckets, grams, mix, powers, saved, small, with_ids

ANCHOR = 8


def _sliding_min(g: np.ndarray, w: int) -> np.ndarray:
    """Least of each w consecutive values."""
    size = 1
    while size * 2 <= w:
        g = np.minimum(g[:-size], g[size:])
        size *= 2
    return np.minimum(g[: len(g) - (w - size)], g[w - size :]) if w > size else g


def _segments(w: Words, window: int):
    """Of a batch: word hashes, and of each segment: anchor, first word, windows."""
    h = w.hashes()
    n = len(h) - window + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return h, none.astype(np.uint64), none, none
    g = grams(h, min(ANCHOR, window))
    least = _sliding_min(g, window - min(ANCHOR, window) + 1)
    row = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    inside = row[:n] == row[window - 1 :]
    at = np.flatnonzero(inside)
    if not len(at):
        return h, none.astype(np.uint64), none, none
    # a place of the anchor that the next window no longer holds ends a segment, so periodic texts meet themselves
    new = np.r_[True, (np.diff(at) != 1) | (g[at[:-1]] == least[at[:-1]]) | (least[at[1:]] != least[at[:-1]]) | (row[at[1:]] != row[at[:-1]])]
    start = np.flatnonzero(new)
    return h, least[at[start]], at[start], np.diff(np.r_[start, len(at)])


def _run_hashes(h: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Hashes of h[start:start + n]."""
    up, down = powers(len(h) + 1)
    total = np.r_[np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)])]
    return mix((total[start + n] - total[start]) * down[start] + n.astype(np.uint64) * STEP)


def _anchors(window: int, buckets: int):
    """(row, text) -> packed segments, one row for each bucket and batch."""

    def run(batches):
        for b in small(batches):
            w = Words(b.column(1))
            h, anchor, at, n = _segments(w, window)
            if not len(at):
                continue
            doc = np.searchsorted(w.first, at, side="right") - 1
            row = b.column(0).to_numpy()[doc]
            seg = _run_hashes(h, at, n + window - 1)
            place = (at - w.first[doc]).astype(np.int32)
            to = (anchor >> np.uint64(20)) % np.uint64(buckets)
            order = np.argsort(to, kind="stable")
            cut = np.searchsorted(to[order], np.arange(buckets + 1, dtype=np.uint64))
            cols = [c[order] for c in (anchor, seg, row, place, n.astype(np.int32))]
            full = np.flatnonzero(np.diff(cut))
            yield pa.record_batch([pa.array(full, pa.int32())] + [pa.array([c[cut[i] : cut[i + 1]].tobytes() for i in full], pa.binary()) for c in cols], names=["bucket", "anchor", "seg", "row", "place", "n"])

    return run


FOUND = "key long, row long, place int, n int, weight int, hot boolean"


def _meet(shard_segments: int):
    """A bucket's segments -> repeated ones (weight 0), and distinct ones to compare."""

    def run(_key, table):
        def col(name, kind):
            return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)

        anchor, seg, row, place, n = col("anchor", np.uint64), col("seg", np.uint64), col("row", np.int64), col("place", np.int32), col("n", np.int32)
        order = np.lexsort((seg, anchor))
        anchor, seg, row, place, n = anchor[order], seg[order], row[order], place[order], n[order]
        new_a = np.r_[True, anchor[1:] != anchor[:-1]]
        new_s = new_a | np.r_[True, seg[1:] != seg[:-1]]
        at_a, at_s = np.flatnonzero(new_a), np.flatnonzero(new_s)
        size_s = np.diff(np.r_[at_s, len(seg)])
        kinds = np.add.reduceat(new_s.astype(np.int64), at_a)
        of_a = (np.cumsum(new_a) - 1)[at_s]
        whole = np.repeat(size_s > 1, size_s)
        mixed = kinds[of_a] > 1
        m = at_s[mixed]
        take = np.r_[np.flatnonzero(whole), m]
        weight = np.r_[np.zeros(whole.sum(), np.int32), size_s[mixed].astype(np.int32)]
        hot = np.r_[np.zeros(whole.sum(), bool), kinds[of_a][mixed] > shard_segments]
        return pa.table({"key": pa.array(anchor[take].astype(np.int64)), "row": pa.array(row[take]), "place": pa.array(place[take]), "n": pa.array(n[take]), "weight": pa.array(weight), "hot": pa.array(hot)})

    return run


def _cut(window: int):
    """(row, text, wanted) -> segments with their words; equal windows of hot anchors merged."""

    def run(batches):
        for b in small(batches):
            w = Words(b.column(1))
            h = None
            out, keys, places = [], [], []
            for i, (row, wanted) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist())):
                first = int(w.first[i])
                for x in wanted:
                    s, n = first + x["place"], x["n"]
                    if x["hot"]:
                        h = w.hashes() if h is None else h
                        keys.append(_run_hashes(h[s : s + n + window - 1], np.arange(n), np.full(n, window)))
                        places += [(row, x["place"] + j, s + j, x["weight"]) for j in range(n)]
                    else:
                        out.append((x["key"], row, x["place"], n, x["weight"], w.buf[w.starts[s] : w.ends[s + n + window - 2]].tobytes()))
            if keys:
                k = np.concatenate(keys)
                _, at, inverse, count = np.unique(k, return_index=True, return_inverse=True, return_counts=True)
                for j in np.flatnonzero(count[inverse] > 1).tolist():
                    out.append((None, places[j][0], places[j][1], 1, 0, None))
                for j, c in zip(at.tolist(), count.tolist()):
                    row, place, s, weight = places[j]
                    out.append((int(k[j].astype(np.int64)), row, place, 1, max(weight, c), w.buf[w.starts[s] : w.ends[s + window - 1]].tobytes()))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["key", "row", "place", "n", "weight", "words"])

    return run


class Automaton:
    """Suffix automaton of word sequences, each with a number of places."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.places = [-1], [0], [0]

    def add(self, words: list, weight: int) -> None:
        nxt, link, length, places = self.next, self.link, self.length, self.places
        last = 0
        for c in words:
            old = nxt[last].get(c)
            if old is not None:
                if length[old] != length[last] + 1:
                    old = self._clone(last, c, old)
                last = old
                places[last] += weight
                continue
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            places.append(weight)
            link.append(0)
            p = last
            while p != -1 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][c]
                link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
            last = cur

    def _clone(self, p: int, c, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        self.places.append(0)
        link.append(link[q])
        link[q] = new
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def count(self) -> None:
        """Hands each state's places on to the shorter matches it ends with."""
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            self.places[self.link[s]] += self.places[s]

    def repeated(self, words: list, window: int) -> list[bool]:
        """For each window of words: does it have two places?"""
        nxt, link, length = self.next, self.link, self.length
        state = matched = 0
        out = []
        for i, c in enumerate(words):
            while state and c not in nxt[state]:
                state = link[state]
                matched = length[state]
            state = nxt[state].get(c, 0)
            matched = matched + 1 if state else 0
            if i + 1 >= window:
                if matched >= window:
                    while length[link[state]] >= window:
                        state = link[state]
                        matched = length[state]
                    out.append(self.places[state] > 1)
                else:
                    out.append(False)
        return out


def _match(window: int):
    """A bucket of shards -> repeated windows of the segments that had one place."""

    def run(_key, table):
        groups: dict[int, list] = {}
        for x in zip(table.column("key").to_pylist(), table.column("row").to_pylist(), table.column("place").to_pylist(), table.column("weight").to_pylist(), table.column("words").to_pylist()):
            groups.setdefault(x[0], []).append(x)
        out = []
        for shard in groups.values():
            if len(shard) < 2:
                continue
            reference = Automaton()
            split = [x[4].split() for x in shard]
            for words, x in zip(split, shard):
                reference.add(words, x[3])
            reference.count()
            for words, x in zip(split, shard):
                if x[3] == 1:
                    out += [(x[1], x[2] + j, 1) for j, hit in enumerate(reference.repeated(words, window)) if hit]
                elif len(words) == window:  # a merged window: its first place is already known
                    out.append((x[1], x[2], 1))
        cols = list(zip(*out)) or [[], [], []]
        return pa.table({"row": pa.array(cols[0], pa.int64()), "place": pa.array(cols[1], pa.int32()), "n": pa.array(cols[2], pa.int32())})

    return run


def _remove(window: int):
    """(doc_id, text, spans) -> what is left of each document."""

    def run(batches):
        for b in small(batches):
            w = Words(b.column(1))
            spans = b.column(2).to_pylist()
            edge = np.zeros(len(w.starts) + 1, np.int64)
            for first, own in zip(w.first.tolist(), spans):
                for x in own or ():
                    edge[first + x["place"]] += 1
                    edge[first + x["place"] + x["n"] + window - 1] -= 1
            gone = np.cumsum(edge[:-1]) > 0
            total = np.r_[0, np.cumsum(gone)]
            removed = total[w.first[1:]] - total[w.first[:-1]]
            sha, left, data = [], [], w.buf.tobytes()
            for i, text in enumerate(b.column(1).to_pylist()):
                lo, hi = int(w.offs[i]), int(w.offs[i + 1])
                if removed[i]:
                    f, g = int(w.first[i]), int(w.first[i + 1])
                    keep = ~gone[f:g]
                    words = data[lo:hi].split()
                    kept = [x for x, k in zip(words, keep.tolist()) if k]
                    # a kept word keeps the white space before it
                    begin = np.r_[lo, w.ends[f : g - 1]]
                    text = b"".join(data[s:e] for s, e in zip(begin[keep].tolist(), w.ends[f:g][keep].tolist())).lstrip().decode()
                    sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                else:
                    sha.append(hashlib.sha256(b" ".join(data[lo:hi].split())).hexdigest())
                left.append(text)
            yield pa.record_batch([b.column(0), pa.array(w.counts(), pa.int64()), pa.array(removed, pa.int64()), pa.array(sha), pa.array(left, pa.string()), b.column(3)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "row"])

    return run


def substring_dedup(docs: DataFrame, window: int = 35, shard_segments: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text, row), a row for each input row.

    Windows are judged on the input.  Null, empty and short texts have no
    windows and stay as they are (a null kept_text stays null; its hash is that
    of no words).  Repeated rows repeat each other's windows, so all of them
    lose them.  doc_id may be null.  row is a hash of id and text.  Other
    columns are ignored; an empty table gives an empty table.
    """
    d = with_ids(docs, id_col, text_col).withColumn("row", F.xxhash64("doc_id", "text"))
    own = _spans(d, window, shard_segments)
    return d.join(own, "row", "left").select("doc_id", "text", "spans", "row").mapInArrow(_remove(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, row long")


def without_repeats(docs: DataFrame, window: int = 35, shard_segments: int = 256) -> DataFrame:
    """The documents with what is left of their texts, n_chars set anew where there is one.

    Rows that lose all their words go; null and blank texts stay as they are.
    Repeated rows go alike; a null doc_id does not matter; other columns stay,
    whatever their names.  An empty table gives an empty table.
    """
    d = with_ids(docs).withColumn("row", F.xxhash64("doc_id", "text"))
    own = _spans(d, window, shard_segments)
    wide = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    wide = wide.withColumn("row", F.xxhash64("doc_id", "text")).join(own, "row", "left")
    changed = wide.select("doc", "text", "spans").mapInArrow(_replace(window), T.StructType([T.StructField("doc", wide.schema["doc"].dataType), T.StructField("left", T.StringType())]))
    out = []
    for c in docs.columns:
        if c == "text":
            out.append(F.col("left").alias(c))
        elif c == "n_chars":
            out.append(F.length("left").cast(docs.schema[c].dataType).alias(c))
        else:
            out.append(F.col(f"doc.`{c}`").alias(c))
    return changed.select(out)


def _replace(window: int):
    """(doc, text, spans) -> (doc, what is left), without rows that lose all their words."""
    remove = _remove(window)

    def run(batches):
        for b in small(batches):
            some = pa.nulls(len(b), pa.int64())
            for left in remove([pa.record_batch([some, b.column(1), b.column(2), some], names=["doc_id", "text", "spans", "row"])]):
                words, removed = left.column(1).to_numpy(), left.column(2).to_numpy()
                keep = pa.array((removed == 0) | (removed < words))
                yield pa.record_batch([b.column(0), left.column(4)], names=["doc", "left"]).filter(keep)

    return run


def _spans(d: DataFrame, window: int, shard_segments: int) -> DataFrame:
    """(row, text) -> the repeated windows of each row, as (first word, windows)."""
    parts = buckets(d)
    packed = d.select("row", "text").mapInArrow(_anchors(window, parts), "bucket int, anchor binary, seg binary, row binary, place binary, n binary")
    met = saved(packed.groupBy("bucket").applyInArrow(_meet(shard_segments), FOUND), "met")
    wanted = met.where("weight > 0").groupBy("row").agg(F.collect_list(F.struct("key", "place", "n", "weight", "hot")).alias("wanted"))
    # Rows alike in id and text share their segments: one of them is enough.
    cut = d.select("row", "text").join(wanted, "row").select("row", "text", "wanted").mapInArrow(_cut(window), "key long, row long, place int, n int, weight int, words binary")
    cut = saved(cut, "cut")
    shards = cut.where("key is not null").withColumn("bucket", F.pmod("key", F.lit(parts)))
    matched = shards.groupBy("bucket").applyInArrow(_match(window), "row long, place int, n int")
    kept = ["row", "place", "n"]
    spans = saved(met.where("weight = 0").select(kept).union(cut.where("key is null").select(kept)).union(matched), "spans")
    return spans.groupBy("row").agg(F.collect_set(F.struct("place", "n")).alias("spans"))
