"""Benchmark decontamination: passages within a word edit distance of an item.

An item of n words is found in a document where some run of words lies within
floor(n * (100 - pct) / 100) edits of it.  For each slice of documents:

1. An item cut into one run more than its edits has a run that any passage
   keeps whole, so places of these runs give every window that can match; no
   passage is lost here.
2. The item-sized windows around such a place and the item go through the CGK
   random walk, which turns edits into Hamming distance: each step copies the
   current word and moves on by a random bit of (step, word).  `tables` draws of
   `sampled` steps are compared; a window that agrees in one draw goes on.  More
   tables raise the recall; the tests hold it against brute force.
3. Exact edit verification, free at both ends, decides.

Benchmark items are read in blocks of `block_items`, so what is sent to the
executors is bounded; each block takes one pass over the documents.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import Words, grams, mix, small

MAP_BITS = 22
STEPS_A_WORD = 2


@dataclass
class Items:
    """A block of benchmark items, ready for lookups."""

    ids: list = field(default_factory=list)
    words: list = field(default_factory=list)
    edits: list = field(default_factory=list)
    pieces: dict = field(default_factory=dict)  # length -> sorted keys, item, offset
    maps: dict = field(default_factory=dict)


def _prepare(rows: list[tuple], pct: int) -> Items:
    out = Items()
    keys: dict[int, list] = {}
    if not rows:
        return out
    w = Words(pa.array([r[1] for r in rows], pa.string()), lower=True)
    h = w.hashes()
    for (item, _), a, b in zip(rows, w.first[:-1].tolist(), w.first[1:].tolist()):
        n = b - a
        if not n:
            continue
        d = n * (100 - pct) // 100
        at = len(out.ids)
        out.ids.append(item)
        out.words.append(h[a:b])
        out.edits.append(d)
        cut = [n * i // (d + 1) for i in range(d + 2)]
        for s, e in zip(cut[:-1], cut[1:]):
            keys.setdefault(e - s, []).append((int(grams(h[a + s : a + e], e - s)[0]), at, s))
    for q, found in keys.items():
        found.sort()
        k = np.array([x[0] for x in found], np.uint64)
        out.pieces[q] = (k, np.array([x[1] for x in found]), np.array([x[2] for x in found]))
        out.maps[q] = np.zeros(1 << MAP_BITS, bool)
        out.maps[q][(k >> np.uint64(64 - MAP_BITS)).astype(np.int64)] = True
    return out


def _draws(tables: int, sampled: int) -> np.ndarray:
    """For each table, the places of its sampled steps as parts of a walk."""
    rng = np.random.default_rng(20)
    return np.sort(rng.random((tables, sampled)), axis=1)


def _walk(h: np.ndarray, start: np.ndarray, n: np.ndarray, item_n: np.ndarray, seed: int, draw: np.ndarray) -> np.ndarray:
    """Keys of the sampled steps of the windows' embeddings, all walks at once.

    A walk has steps by its item's size; past the window's end it copies zeros.
    """
    at = np.zeros(len(start), np.int64)
    steps = item_n * STEPS_A_WORD
    wanted = (draw[None, :] * steps[:, None]).astype(np.int64)
    key = np.zeros(len(start), np.uint64)
    taken = np.zeros(len(start), np.int64)
    rows = np.arange(len(start))
    for j in range(int(steps.max(initial=0))):
        c = np.where(at < n, h[np.minimum(start + at, len(h) - 1)], np.uint64(0))
        for _ in range(draw.size):
            hit = (taken < draw.size) & (wanted[rows, np.minimum(taken, draw.size - 1)] == j)
            if not hit.any():
                break
            key[hit] = mix(key[hit] * np.uint64(31) + c[hit])
            taken[hit] += 1
        at += ((mix(c + np.uint64(seed * 65537 + j * 2 + 1)) >> np.uint64(17)) & np.uint64(1)).astype(np.int64)
    return key


def edit_distance(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int, int]:
    """Least edits from item to a run of text, and the run's start and end.

    Of equal distances, the run that ends first; (most + 1, 0, 0) if beyond.
    """
    n, m = len(item), len(text)
    ramp = np.arange(n + 1)
    cost, began = ramp.copy(), np.zeros(n + 1, np.int64)
    best = (most + 1, 0, 0)
    for j in range(1, m + 1):
        same = (item != text[j - 1]).astype(np.int64)
        new = np.empty(n + 1, np.int64)
        new[0] = 0
        via = cost[:-1] + same
        down = cost[1:] + 1
        new[1:] = np.minimum(via, down)
        src = np.empty(n + 1, np.int64)
        src[0] = j
        src[1:] = np.where(via <= down, began[:-1], began[1:])
        # deletions of item words run along the column
        run = np.minimum.accumulate(new - ramp)
        origin = np.maximum.accumulate(np.where(new - ramp == run, ramp, -1))
        cost, began = run + ramp, src[origin]
        if cost[n] < best[0]:
            best = (int(cost[n]), int(began[n]), j)
    return best


def _places(w: Words, h: np.ndarray, items: Items, most: int):
    """Where runs of items stand, as (row, item, start of the item's window), about `most` places at a time."""
    held, size = [], 0
    for q, (keys, of, off) in items.pieces.items():
        g = grams(h, q)
        at = np.flatnonzero(items.maps[q][(g >> np.uint64(64 - MAP_BITS)).astype(np.int64)])
        lo, hi = np.searchsorted(keys, g[at]), np.searchsorted(keys, g[at], side="right")
        at, lo, m = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        total = np.cumsum(m)
        a = 0
        while a < len(at):
            z = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most)))
            k = np.repeat(lo[a:z], m[a:z]) + np.arange(m[a:z].sum()) - np.repeat(np.cumsum(m[a:z]) - m[a:z], m[a:z])
            place = np.repeat(at[a:z], m[a:z])
            row = np.searchsorted(w.first, place, side="right") - 1
            inside = place + q <= w.first[row + 1]
            held.append((row[inside], of[k][inside], (place - off[k])[inside]))
            size += int(inside.sum())
            if size > most:
                yield np.unique(np.stack([np.concatenate(c) for c in zip(*held)]), axis=1)
                held, size = [], 0
            a = z
    if size:
        yield np.unique(np.stack([np.concatenate(c) for c in zip(*held)]), axis=1)


def _windows(w: Words, places: np.ndarray, edits: np.ndarray, most: int):
    """All windows whose start an edit before the run can move, and those at the document's edges, in order."""
    row, item, start = places
    reach = edits[item]
    total = np.cumsum(2 * reach + 1)
    a = 0
    while a < len(row):
        z = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most)))
        n = 2 * reach[a:z] + 1
        rep = np.repeat(np.arange(a, z), n)
        shift = np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n) - reach[rep]
        yield np.unique(np.stack([row[rep], item[rep], np.clip(start[rep] + shift, w.first[row[rep]], w.first[row[rep] + 1] - 1)]), axis=1)
        a = z


def _hits(w: Words, items: Items, draws: np.ndarray, most: int = 1 << 20) -> list[tuple]:
    """(row, item, first word, words, edits) of every item found in a row, best place only; about `most` windows at a time."""
    h = w.hashes()
    out: dict[tuple, tuple] = {}
    last: dict[tuple, tuple] = {}
    edits = np.array(items.edits)
    size = np.array([len(x) for x in items.words])
    flat = np.concatenate(items.words)
    base = np.r_[0, np.cumsum(size)[:-1]]
    for places in _places(w, h, items, most):
        for row, item, start in _windows(w, places, edits, most):
            n = np.minimum(size[item], w.first[row + 1] - start)
            passed = np.zeros(len(row), bool)
            used = np.unique(item)
            for t, draw in enumerate(draws):
                todo = np.flatnonzero(~passed)
                if not len(todo):
                    break
                own = np.zeros(len(size), np.uint64)
                own[used] = _walk(flat, base[used], size[used], size[used], t + 1, draw)
                mine = _walk(h, start[todo], n[todo], size[item[todo]], t + 1, draw)
                passed[todo] = mine == own[item[todo]]
            for r, i, s in zip(row[passed].tolist(), item[passed].tolist(), start[passed].tolist()):
                low, high = last.get((r, i), (0, -1))
                if low <= s <= high:
                    continue  # this start was inside a run that was verified
                d, n_i = items.edits[i], len(items.words[i])
                a, b = max(int(w.first[r]), s - 2 * d), min(int(w.first[r + 1]), s + 2 * d + n_i + d)
                last[(r, i)] = (s - d, s + d)
                dist, x, y = edit_distance(items.words[i], h[a:b], d)
                if dist <= d and ((r, i) not in out or dist < out[(r, i)][4]):
                    out[(r, i)] = (r, items.ids[i], a + x - int(w.first[r]), y - x, dist)
    return list(out.values())


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_items: int):
    held: list[tuple] = []
    for r in benchmark.select(F.col(item_col).cast("long"), F.col(text_col).cast("string")).toLocalIterator():
        if r[0] is not None and r[1]:
            held.append((r[0], r[1]))
        if len(held) == block_items:
            yield held
            held = []
    if held:
        yield held


def find_leaks(docs: DataFrame, benchmark: DataFrame, pct: int = 80, tables: int = 12, sampled: int = 3, block_items: int = 5000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, first_word, n_words, edits): every item a document holds, at its best place.

    Words are compared with A-Z lower-cased.  Null, empty and blank texts and
    items give nothing; a null item_id is skipped, a null doc_id kept.  Repeated
    rows each give their rows.  Other columns are ignored.  An empty benchmark
    or documents table gives an empty table.
    """
    kind = "doc_id long, item_id long, first_word long, n_words long, edits long"
    d = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    out = None
    for block in _blocks(benchmark, item_col, item_text, block_items):
        one = d.mapInArrow(_find(docs.sparkSession.sparkContext.broadcast(_prepare(block, pct)), _draws(tables, sampled)), kind)
        out = one if out is None else out.unionAll(one)
    return docs.sparkSession.createDataFrame([], kind) if out is None else out


def _find(items, draws):
    def run(batches):
        for b in small(batches):
            hits = _hits(Words(b.column(1), lower=True), items.value, draws) if items.value.ids else []
            if hits:
                cols = list(zip(*hits))
                yield pa.record_batch([b.column(0).take(pa.array(cols[0], pa.int64()))] + [pa.array(c, pa.int64()) for c in cols[1:]], names=["doc_id", "item_id", "first_word", "n_words", "edits"])

    return run


def drop_leaks(docs: DataFrame, benchmark: DataFrame, pct: int = 80, tables: int = 12, sampled: int = 3, block_items: int = 5000, text_col: str = "text") -> DataFrame:
    """The documents that hold no item, all columns as they are; edge cases as in find_leaks."""
    kind = T.StructType(docs.schema.fields)
    for block in _blocks(benchmark, "item_id", "text", block_items):
        docs = docs.mapInArrow(_drop(docs.sparkSession.sparkContext.broadcast(_prepare(block, pct)), _draws(tables, sampled), docs.columns.index(text_col)), kind)
    return docs


def _drop(items, draws, col):
    def run(batches):
        for b in small(batches, col=col):
            hits = _hits(Words(b.column(col), lower=True), items.value, draws) if items.value.ids else []
            keep = np.ones(len(b), bool)
            keep[[x[0] for x in hits]] = False
            yield b.filter(pa.array(keep))

    return run
