"""N-gram Jaccard join: documents whose sets of word n-grams are close.

A blocked sparse matrix product of the document by n-gram incidence.  The rows
that can meet are found by a lossless size-derived bound: with the n-grams of
every document in one common order (those of frequent sketch cells last, then
by hash), two documents with Jaccard >= t share one of the first
n - ceil(t * n) + 1 n-grams of each.  Documents with equal sets are one class, named
by the set's fingerprint; from the first shuffle on, a class is one row.  Every
list of an n-gram's classes names its least one as pivot, and a pivot's block
gets the whole rows of all classes of its lists, so each pair that shares such
an n-gram meets in a block.  Parity bitmaps of the rows, a 40th of their size, first give a lossless
lower bound of each pair's own n-grams; classes joined by pairs it allows form
the blocks that get whole rows, once each.  There, a breadth-first search multiplies one row at a time by the rows
not reached yet, accumulates overlap counts, and drops pairs below the bound
i >= t / (1 + t) * (a + b).  Blocks over `block_grams` are cut into parts and
every two parts of compatible sizes meet in a task of their own.

Results hold up to collisions of 64-bit hashes of n-grams and sets.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .text import M64, Words, buckets, grams, mix, saved, small, with_ids

CELL_BITS = 20
PARTS = 16


def _ranked(g: np.ndarray, size: np.ndarray) -> np.ndarray:
    return (g >> np.uint64(6)) | ((63 - np.minimum(size, 63)).astype(np.uint64) << np.uint64(58))


def _cell(g: np.ndarray) -> np.ndarray:
    return ((g >> np.uint64(32)) & np.uint64((1 << CELL_BITS) - 1)).astype(np.int64)


def _sets(col: pa.Array, k: int, w: Words | None = None) -> list[np.ndarray]:
    """Each row's sorted distinct n-gram hashes; shorter texts are one n-gram.

    The top six bits fall with the bytes in the n-gram's words, so that short,
    common words, whose n-grams meet by chance, come last in the order.
    """
    w = w or Words(col, lower=True)
    h = w.hashes()
    size = np.r_[0, np.cumsum(w.ends - w.starts)]
    g = _ranked(grams(h, k), size[k:] - size[:-k] if len(size) > k else size[:0])
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(g[a : b - k + 1]))
        elif b > a:
            out.append(_ranked(grams(h[a:b], b - a) ^ np.uint64(b - a), size[b : b + 1] - size[a]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _print_of(s: np.ndarray) -> int:
    """A set's 64-bit fingerprint; 0 for the empty set."""
    if not len(s):
        return 0
    x = (int(mix(s).sum(dtype=np.uint64)) * 3 + len(s)) & M64
    return (x - (1 << 64) if x >> 63 else x) or 1


def _bits(s: np.ndarray) -> bytes:
    """Parities of the hashes that fall in each of n to 2n bits.

    Two such maps differ in at most as many bits as the sets have n-grams of
    their own; one of twice the width folds by xor of its halves.
    """
    wide = 1 << max(6, (len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(wide - 1)).astype(np.int64), minlength=wide) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _scan(k: int):
    """documents -> (doc_id, words, n, fp, bits) rows, then the task's sketch of counts per cell."""
    names = ["doc_id", "words", "n", "fp", "bits", "part", "cells"]

    def run(batches):
        cells = np.zeros(1 << CELL_BITS, np.int64)
        for b in small(batches):
            w = Words(b.column(1), lower=True)
            sets = _sets(b.column(1), k, w)
            if sets:
                cells += np.bincount(_cell(np.concatenate(sets)), minlength=1 << CELL_BITS)
            n = len(sets)
            yield pa.record_batch([b.column(0), pa.array(w.counts(), pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([_print_of(s) for s in sets], pa.int64()), pa.array([_bits(s) for s in sets], pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        rows = [(i, zlib.compress(c.astype("<i8").tobytes(), 1)) for i, c in enumerate(np.split(cells, PARTS)) if c.any()]
        none = pa.nulls(len(rows), pa.int64())
        yield pa.record_batch([none, none, none, none, pa.nulls(len(rows), pa.binary()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=names)

    return run


def _add_cells(batches):
    """Sums of the sketches in a task, one row for each part."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for part, cells in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            c = np.frombuffer(zlib.decompress(cells), "<i8")
            total[part] = total[part] + c if part in total else c
    yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([zlib.compress(c.tobytes(), 1) for c in total.values()], pa.binary())], names=["part", "cells"])


def _heavy(scanned: DataFrame) -> np.ndarray:
    """For each cell, how many doublings its count is above four times the mean.

    2^20 counters whatever the input, so both collect and broadcast are bounded.
    Any order gives right results; this one keeps frequent n-grams out of the bounds.
    """
    kinds = "part int, cells binary"
    cells = scanned.where("part is not null").select("part", "cells")
    cells = cells.mapInArrow(_add_cells, kinds).repartition(PARTS, "part").mapInArrow(_add_cells, kinds)
    out = np.zeros((PARTS, (1 << CELL_BITS) // PARTS))
    for r in cells.collect():
        out[r["part"]] = np.frombuffer(zlib.decompress(r["cells"]), "<i8")
    out = out.ravel()
    level = np.log2(np.maximum(out, 1) / max(32.0, 4 * out.mean()))
    return np.clip(np.ceil(level), 0, 7).astype(np.uint8)


def _bound(n: int, pct: int) -> int:
    return n - -(-n * pct // 100) + 1


def _postings(k: int, pct: int, buckets: int, heavy):
    """documents -> packed (n-gram, class) lists, one row for each bucket and flush."""

    def run(batches):
        level = heavy.value
        held: list[tuple[np.ndarray, int]] = []
        seen: set[int] = set()
        size = 0

        def flush():
            g = np.concatenate([s for s, _ in held])
            d = np.repeat(np.array([i for _, i in held], np.int64), [len(s) for s, _ in held])
            order = np.argsort(g)
            g, d = g[order], d[order]
            to = mix(g) % np.uint64(buckets)
            order = np.argsort(to, kind="stable")
            g, d, to = g[order], d[order], to[order]
            cut = np.searchsorted(to, np.arange(buckets + 1, dtype=np.uint64))
            rows = [(b, g[s:e].tobytes(), d[s:e].tobytes()) for b, (s, e) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())) if e > s]
            return pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "grams", "classes"])

        for b in small(batches):
            for doc, s in zip(b.column(0).to_pylist(), _sets(b.column(1), k)):
                fp = _print_of(s)
                if doc is None or not len(s) or fp in seen:
                    continue
                seen.add(fp)
                last = level[_cell(s)]
                if last.any():
                    s = s[np.argsort(last, kind="stable")]
                held.append((s[: _bound(len(s), pct)], fp))
                size += len(held[-1][0])
            if size > 4_000_000:
                yield flush()
                held, seen, size = [], set(), 0
        if held:
            yield flush()

    return run


def _unpack(blobs, kind) -> np.ndarray:
    blobs = [x for x in blobs if x]
    return np.frombuffer(b"".join(blobs), kind) if blobs else np.zeros(0, kind)


def _pivots(buckets: int):
    """A bucket's lists -> packed distinct (class, pivot) of all lists with two classes, by bucket of class."""

    def run(_key, table):
        g, d = _unpack(table.column("grams").to_pylist(), np.uint64), _unpack(table.column("classes").to_pylist(), np.int64)
        order = np.lexsort((d, g))
        g, d = g[order], d[order]
        start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        n = np.diff(np.r_[start, len(g)])
        many = np.repeat(d[start] != d[np.r_[start[1:], len(d)] - 1], n)
        pairs = np.unique(np.stack([d[many], np.repeat(d[start], n)[many]], 1), axis=0)
        to = mix(pairs[:, 0].astype(np.uint64)) % np.uint64(buckets)
        order = np.argsort(to, kind="stable")
        pairs, cut = pairs[order], np.searchsorted(to[order], np.arange(buckets + 1, dtype=np.uint64))
        full = np.flatnonzero(np.diff(cut))
        return pa.table({"bucket": pa.array(full, pa.int32()), "pairs": pa.array([pairs[cut[i] : cut[i + 1]].tobytes() for i in full], pa.binary())})

    return run


def _distinct(_key, table):
    """Packed pairs of a bucket -> distinct rows (fp, pivot)."""
    pairs = np.unique(_unpack(table.column("pairs").to_pylist(), np.int64).reshape(-1, 2), axis=0)
    return pa.table({"fp": pa.array(pairs[:, 0]), "pivot": pa.array(pairs[:, 1])})


def _rows(k: int):
    """(doc_id, text, fp, blocks) -> one row of the incidence matrix for each block; rows whose text has another fp go."""

    def run(batches):
        done: set[int] = set()
        for b in small(batches):
            out: list[tuple] = []
            for s, fp, blocks in zip(_sets(b.column(1), k), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if fp in done or _print_of(s) != fp:
                    continue
                done.add(fp)
                data = s.tobytes()
                out += [(x["pivot"], x["i"], x["j"], fp, data) for x in blocks]
                if len(out) > 2000:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

    return run


def _batch(out):
    cols = list(zip(*out))
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
    return pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds)], names=["pivot", "i", "j", "fp", "grams"])


def _blocks(table):
    """The table's rows by block (pivot, i, j)."""
    keys = np.stack([table.column(c).to_numpy() for c in ("pivot", "i", "j")])
    order = np.lexsort(keys)
    keys = keys[:, order]
    cut = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(0)]) if len(order) else order
    return np.split(order, cut[1:]) if len(order) else []


def _screen(pct: int):
    """A bucket's blocks -> star edges (a, b) that span the pairs the parity bounds allow."""

    def run(_key, table):
        ids, sizes, bits = table.column("fp").to_numpy(), table.column("n").to_numpy(), table.column("bits")
        edges: set[tuple[int, int]] = set()
        for block in _blocks(table):
            if len(block) > 1:
                block = block[np.argsort(ids[block], kind="stable")]
                for i, j in _allowed(sizes[block].astype(np.int64), [np.frombuffer(bits[int(i)].as_py(), np.uint64) for i in block], pct):
                    edges.add((int(ids[block[j]]), int(ids[block[i]])))
        cols = list(zip(*edges)) or [[], []]
        return pa.table({"a": pa.array(cols[0], pa.int64()), "b": pa.array(cols[1], pa.int64())})

    return run


def _allowed(n: np.ndarray, maps: list[np.ndarray], pct: int) -> list[tuple[int, int]]:
    """Breadth-first over pairs whose sizes and bitmaps allow them; (first of its group, row)."""
    wide = np.array([len(m) for m in maps])
    levels = {}
    for w in np.unique(wide).tolist():
        for at in (w, w // 2):
            own = [i for i in range(len(maps)) if wide[i] in (at, 2 * at)]
            if at and at not in levels and own:
                levels[at] = (np.array(own), np.stack([maps[i] if wide[i] == at else maps[i][:at] ^ maps[i][at:] for i in own]))
    place = {w: {int(i): x for x, i in enumerate(own)} for w, (own, _) in levels.items()}
    todo = np.ones(len(maps), bool)
    out: list[tuple[int, int]] = []
    for first in range(len(maps)):
        if not todo[first]:
            continue
        todo[first] = False
        queue = [first]
        while queue:
            i = queue.pop()
            for w in (int(wide[i]), int(wide[i]) // 2):  # its own width and wider rows, then narrower rows
                if w not in levels:
                    continue
                own, m = levels[w]
                at = np.flatnonzero(todo[own] & ((wide[own] == w) | (w == wide[i])))
                most = (100 - pct) * (n[own[at]] + n[i])
                ok = (100 + pct) * np.abs(n[own[at]] - n[i]) <= most
                at, most = at[ok], most[ok]
                if len(at):
                    apart = np.bitwise_count(m[at] ^ m[place[w][i]]).sum(1, dtype=np.int64)
                    found = own[at[(100 + pct) * apart <= most]]
                    todo[found] = False
                    out += [(first, int(j)) for j in found]
                    queue += found.tolist()
    return out


def _search(pct: int):
    """A bucket's blocks -> links (a, b) between fingerprints that span their components."""

    def run(_key, table):
        links: set[tuple[int, int]] = set()
        fp, blobs = table.column("fp").to_numpy(), table.column("grams")
        for block in _blocks(table):
            fps, at = np.unique(fp[block], return_index=True)
            if len(fps) > 1:
                links.update(_reach(fps, [np.frombuffer(blobs[int(i)].as_py(), np.uint64) for i in block[at]], pct))
        cols = list(zip(*links)) or [[], []]
        return pa.table({"a": pa.array(cols[0], pa.int64()), "b": pa.array(cols[1], pa.int64())})

    return run


def _reach(fps: np.ndarray, rows: list[np.ndarray], pct: int) -> list[tuple[int, int]]:
    """Breadth-first over the product of the rows with the rows not reached yet."""
    n = np.array([len(r) for r in rows], np.int64)
    ids, where = np.unique(np.concatenate(rows), return_inverse=True)
    cut = np.r_[0, np.cumsum(n)]
    row_ids = [where[a:b] for a, b in zip(cut[:-1], cut[1:])]
    todo = np.ones(len(rows), bool)
    links: list[tuple[int, int]] = []

    def index():
        left = np.flatnonzero(todo)
        doc = np.repeat(left, n[left])
        col = np.concatenate([row_ids[i] for i in left] or [np.zeros(0, np.int64)])
        order = np.argsort(col, kind="stable")
        return doc[order], np.searchsorted(col[order], np.arange(len(ids) + 1)), len(left)

    docs, ptr, base = index()
    left = base
    for first in range(len(rows)):
        if not todo[first]:
            continue
        todo[first] = False
        left -= 1
        queue = [first]
        while queue and left:
            i = queue.pop()
            if left * 2 < base:
                docs, ptr, base = index()
            s = ptr[row_ids[i]]
            m = ptr[row_ids[i] + 1] - s
            take = np.repeat(s - np.r_[0, np.cumsum(m)[:-1]], m) + np.arange(m.sum())
            both = np.bincount(docs[take], minlength=len(rows))
            found = np.flatnonzero(todo & (both > 0) & ((100 + pct) * both >= pct * (n + n[i])))
            todo[found] = False
            left -= len(found)
            links += [(int(fps[first]), int(fps[j])) for j in found]
            queue += found.tolist()
    return links


def _parts(pairs: DataFrame, most: int) -> DataFrame:
    """(fp, pivot, n) -> (fp, pivot, i, j): a block of n-grams up to `most` is (0, 0); in a larger one each row meets every part."""
    parts = saved(pairs.groupBy("pivot").agg(F.sum("n").alias("m")).select("pivot", F.ceil(F.col("m") / most).cast("int").alias("g")), "parts")
    own = F.pmod(F.xxhash64("fp"), F.col("g")).cast("int")
    other = F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda x: F.struct(F.least(x, F.col("own")).alias("i"), F.greatest(x, F.col("own")).alias("j")))
    return pairs.join(parts, "pivot").withColumn("own", own).withColumn("at", F.explode(other)).select("fp", "pivot", "at.i", "at.j", *[c for c in pairs.columns if c not in ("fp", "pivot")])


def ngram_join(docs: DataFrame, k: int = 5, pct: int = 75, block_grams: int = 3_000_000, id_col: str = "doc_id", text_col: str = "text", words: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id): near duplicates by 100 * i >= pct * u.

    Words are lower-cased (A-Z); a document with fewer than k words has its
    whole sequence as one n-gram.  A null, empty or blank text has no n-grams
    and links with nothing; a null doc_id gives a row with a null component.
    Repeated rows link with each other and each gives a row.  Other columns,
    whatever their names, are ignored.  An empty table gives an empty table.
    With `words`, n_words follows, counted while the n-grams are.
    """
    spark = docs.sparkSession
    d = with_ids(docs, id_col, text_col)
    scanned = saved(d.mapInArrow(_scan(k), "doc_id long, words long, n long, fp long, bits binary, part int, cells binary"), "scan")
    heavy = spark.sparkContext.broadcast(_heavy(scanned))
    sets = scanned.where("part is null").select("doc_id", "words", "n", "fp", "bits")
    parts = buckets(docs)
    classes = saved(sets.where("fp <> 0 and doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("bits").alias("bits")), "classes")
    packed = d.mapInArrow(_postings(k, pct, parts, heavy), "bucket int, grams binary, classes binary")
    pairs = saved(packed.groupBy("bucket").applyInArrow(_pivots(parts), "bucket int, pairs binary").groupBy("bucket").applyInArrow(_distinct, "fp long, pivot long"), "pairs")
    bucket = F.pmod(F.xxhash64("pivot", "i", "j"), F.lit(parts)).alias("bucket")
    sized = saved(pairs.join(classes.drop("rep"), "fp"), "sized")
    allowed = _parts(sized, block_grams).select("*", bucket).groupBy("bucket").applyInArrow(_screen(pct), "a long, b long")
    # Classes joined by such pairs are one block from here, so each is sent once.
    group = saved(components(allowed).toDF("fp", "pivot").join(classes.drop("bits"), "fp"), "groups")
    blocks = _parts(group, block_grams).groupBy("fp", "rep").agg(F.collect_list(F.struct("pivot", "i", "j")).alias("blocks"))
    members = d.join(blocks, d.doc_id == blocks.rep).select("doc_id", "text", "fp", "blocks").mapInArrow(_rows(k), "pivot long, i int, j int, fp long, grams binary")
    links = members.select("*", bucket).groupBy("bucket").applyInArrow(_search(pct), "a long, b long")
    comp = components(links).toDF("fp", "component")
    rooted = classes.join(comp, "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    least = rooted.groupBy("component").agg(F.min("rep").alias("root"))
    final = saved(rooted.join(least, "component").select("fp", "root"), "final")
    return sets.join(final, "fp", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("component_id"), *([F.col("words").alias("n_words")] if words else []))


def keep_one_of_each(docs: DataFrame, k: int = 5, pct: int = 75) -> DataFrame:
    """The rows whose doc_id leads its component; of repeated rows, one.

    Rows without n-grams or without a doc_id all stay (of repeated rows of an id
    without n-grams, one).  Columns stay as they are, whatever their names.  An
    empty table gives an empty table.
    """
    comp = saved(ngram_join(docs, k, pct), "components")
    lead = comp.where("doc_id = component_id or doc_id is null").select("doc_id").distinct().toDF("lead")
    kept = docs.join(lead, docs["doc_id"].cast("long").eqNullSafe(lead["lead"]), "left_semi")
    if comp.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept
    return kept.where("doc_id is not null").dropDuplicates(["doc_id"]).unionAll(kept.where("doc_id is null"))
