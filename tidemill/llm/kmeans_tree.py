"""Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first.

1. The tree is grown by k-means, `branch` children a node, on a bounded sample
   of the vectors; what is broadcast are its centres, at most about twice the
   sample.
2. Every vector goes down to a leaf.  Vectors that are equal are one class, of
   which the k + 1 least ids are kept: no other of them can be among k nearest,
   so a vector in a third of all rows is one row of the index.
3. Calibration: for `calibrators` vectors, the true neighbours are found by
   brute force over the whole index, in one pass.  Each neighbour's leaf has a
   rank in the order in which the best-bin-first search visits leaves; visits
   are widened until the share of neighbours reached is `target`.
4. A query walks the tree with a priority queue of nodes by distance of their
   centres and names its leaves.  Leaves and their queries meet in groups of at
   most about `rows` vectors and `asked` queries: larger leaves are cut up by
   hash, and so are their queries.  A group hands on k + 1 rows a query.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text import saved


class Tree:
    """Nodes in arrays: centre, first child and children (0: a leaf, numbered by `leaf`)."""

    def __init__(self, centres: np.ndarray, first: np.ndarray, children: np.ndarray):
        self.centres, self.first, self.children = centres, first, children
        at = np.flatnonzero(children == 0)
        self.leaf = np.full(len(first), -1, np.int64)
        self.leaf[at] = np.arange(len(at))
        self.leaves = len(at)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row, always going to the nearest child (the first of equals)."""
        node = np.zeros(len(x), np.int64)
        open_ = np.flatnonzero(self.children[node])
        while len(open_):
            for p in np.unique(node[open_]):
                rows = open_[node[open_] == p]
                kids = slice(self.first[p], self.first[p] + self.children[p])
                node[rows] = self.first[p] + nearest(x[rows], self.centres[kids])
            open_ = open_[self.children[node[open_]] > 0]
        return self.leaf[node]

    def visit(self, q: np.ndarray):
        """Leaves, best bin first."""
        heap, made = [(0.0, 0, 0)], 0
        while heap:
            _, _, node = heapq.heappop(heap)
            while self.children[node]:
                a, n = int(self.first[node]), int(self.children[node])
                d = np.square(self.centres[a : a + n] - q).sum(1)
                best = int(d.argmin())
                for i, far in enumerate(d.tolist()):
                    if i != best:
                        made += 1
                        heapq.heappush(heap, (far, made, a + i))
                node = a + best
            yield int(self.leaf[node])


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row; computed row by row, so that equal rows always agree."""
    d = np.empty((len(x), len(centres)))
    for i, c in enumerate(centres):
        d[:, i] = np.square(x - c).sum(1)
    return d.argmin(1)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Centres of at most k non-empty clusters."""
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        at = nearest(x, centres)
        n = np.bincount(at, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, at, x)
        moved = total[n > 0] / n[n > 0, None]
        if moved.shape == centres.shape and np.allclose(moved, centres, rtol=1e-9, atol=0):
            break
        centres = moved
    return centres


def grow(x: np.ndarray, branch: int = 16, depth: int = 2, leaf: int = 32, seed: int = 0) -> Tree:
    """A tree over the different rows of x; nodes of at most `leaf` rows, or at `depth`, are leaves."""
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0) if len(x) else np.zeros((1, x.shape[1]))
    centres, first, children, todo = [x.mean(0)], [0], [0], [(0, 0, x)]
    while todo:
        node, level, rows = todo.pop()
        if len(rows) <= leaf or level == depth:
            continue
        c = kmeans(rows, branch, rng)
        at = nearest(rows, c)
        if len(c) < 2 or np.bincount(at).max() == len(rows):
            continue
        first[node], children[node] = len(centres), len(c)
        for i, centre in enumerate(c):
            todo.append((len(centres), level + 1, rows[at == i]))
            centres.append(centre)
            first.append(0)
            children.append(0)
    return Tree(np.array(centres), np.array(first), np.array(children))


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    """A list column without nulls as rows of doubles."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return np.asarray(col.flatten(), np.float64).reshape(-1, dim)


def _walk(tree, q: np.ndarray, sizes: np.ndarray, visits: int, least: int) -> list[int]:
    """The first `visits` leaves, and more until `least` vectors are met."""
    out, met = [], 0
    for leaf in tree.visit(q):
        out.append(leaf)
        met += int(sizes[leaf])
        if len(out) >= visits and met >= least:
            break
    return out


def _assign(tree, dim: int, k: int):
    """(vec_id, h, embedding) -> with its leaf; of equal vectors of a batch the k + 1 least ids, and repeated rows once."""

    def run(batches):
        for b in batches:
            x = _matrix(b.column(2), dim)
            ids = b.column(0).to_numpy()
            order = np.lexsort((ids, b.column(1).to_numpy()))
            x_, i_ = x[order], ids[order]
            new = np.r_[True, (x_[1:] != x_[:-1]).any(1)] if len(x) else np.zeros(0, bool)
            keep = new | np.r_[True, i_[1:] != i_[:-1]] if len(x) else new
            order, new = order[keep], None
            x_ = x[order]
            start = np.r_[True, (x_[1:] != x_[:-1]).any(1)] if len(order) else np.zeros(0, bool)
            begun = np.maximum.accumulate(np.where(start, np.arange(len(order)), 0)) if len(order) else np.zeros(0, np.int64)
            order = order[np.arange(len(order)) - begun <= k]
            yield pa.record_batch([*(c.take(pa.array(order)) for c in b.columns), pa.array(tree.value.assign(x[order]).astype(np.int32))], names=["vec_id", "h", "embedding", "leaf"])

    return run


def top(q: np.ndarray, x: np.ndarray, least_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of each query's k nearest rows, ties to the smaller id; exact in doubles."""
    out = [[], [], []]
    xx = np.square(x).sum(1)
    for a in range(0, len(q), 128):
        part = q[a : a + 128]
        qq = np.square(part).sum(1)
        near = xx[None, :] - 2 * part @ x.T + qq[:, None]
        slack = 1e-9 * (qq + xx.max())
        bound = np.partition(near, k - 1, axis=1)[:, k - 1] if len(x) > k else np.full(len(part), np.inf)
        for i in range(len(part)):
            rows = np.flatnonzero(near[i] <= bound[i] + slack[i])
            d = np.sqrt(np.square(x[rows] - part[i]).sum(1))
            order = np.lexsort((least_id[rows], d))[:k]
            for o, v in zip(out, (np.full(len(order), a + i), rows[order], d[order])):
                o.append(v)
    return tuple(np.concatenate(o) if o else np.zeros(0, np.int64) for o in out)


def _truth(asked, dim: int, k: int):
    """Index rows -> the k nearest other classes of each calibrator in this task: (q, leaf, d)."""

    def run(batches):
        best = None
        for b in batches:
            if not len(b):
                continue
            x, leaf = _matrix(b.column(1), dim), b.column(0).to_numpy()
            q, r, d = top(asked.value, x, np.arange(len(x)), k + 1)
            other = (x[r] != asked.value[q]).any(1)
            found = np.c_[q, leaf[r], d][other]
            best = found if best is None else np.concatenate([best, found])
            best = best[np.lexsort((best[:, 2], best[:, 0]))]
            begun = np.searchsorted(best[:, 0], best[:, 0])
            best = best[np.arange(len(best)) - begun < k]
        if best is not None:
            yield pa.record_batch([pa.array(best[:, 0].astype(np.int32)), pa.array(best[:, 1].astype(np.int32)), pa.array(best[:, 2])], names=["q", "leaf", "d"])

    return run


def _ask(tree, sizes, chunks, parts, visits: int, least: int, dim: int):
    """Query classes -> a row for each leaf, chunk of the leaf and the query's part."""

    def run(batches):
        for b in batches:
            x = _matrix(b.column(2), dim)
            rows, leaves, chunk, part = [], [], [], []
            h = b.column(0).to_numpy()
            for i, q in enumerate(x):
                for leaf in _walk(tree.value, q, sizes, visits, least):
                    n = int(chunks[leaf])
                    rows += [i] * n
                    leaves += [leaf] * n
                    chunk += range(n)
                    part += [int(h[i] % int(parts[leaf]))] * n
            yield pa.record_batch([*(c.take(pa.array(rows, pa.int64())) for c in b.columns), pa.array(leaves, pa.int32()), pa.array(chunk, pa.int32()), pa.array(part, pa.int32())], names=["h", "rep", "embedding", "leaf", "chunk", "part"])

    return run


def _meet(dim: int, k: int):
    """A chunk of a leaf and a part of its queries -> (h, rep, vec_id, score), at most k + 1 a query."""

    def run(left, right):
        names = ["h", "rep", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64())], names=names)
        x, q = _matrix(left.column("embedding"), dim), _matrix(right.column("embedding"), dim)
        ids = left.column("ids").combine_chunks()
        n = ids.value_lengths().to_numpy()
        flat, at = ids.flatten().to_numpy(), np.r_[0, np.cumsum(n)]
        qi, row, d = top(q, x, flat[at[:-1]], k + 1)
        each = np.repeat(np.arange(len(row)), n[row])
        inner = np.arange(len(each)) - np.repeat(np.r_[0, np.cumsum(n[row])[:-1]], n[row])
        vec, qi, d = flat[at[row][each] + inner], qi[each], d[each]
        order = np.lexsort((vec, d, qi))
        begun = np.searchsorted(qi[order], qi[order])
        order = order[np.arange(len(order)) - begun <= k]
        h, rep = (right.column(c).to_numpy()[qi[order]] for c in ("h", "rep"))
        return pa.table([pa.array(h), pa.array(rep), pa.array(vec[order]), pa.array(d[order])], names=names)

    return run


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, branch: int = 16, depth: int = 2, leaf: int = 32, sample: int = 16384, sample_mb: int = 128, calibrators: int = 256, target: float = 0.97, rows: int = 16384, asked: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest of `vectors` by Euclidean distance, the row of its own id aside.

    Both tables have vec_id and embedding.  Vectors that are null, empty, zero,
    or hold nulls or numbers that are not finite, and rows without vec_id, take
    no part; nor do vectors of another length than the commonest of `vectors`
    (the shorter of equally common ones), as no distance to them is defined.
    Rows alike in id and vector count once; an id with several vectors is
    several candidates, and several queries of that id.  Ties go to the
    smaller vec_id.  Fewer candidates than k are all returned; none, no rows.
    -0.0 is 0.0.  Other columns are ignored.

    The tree is grown on at most about `sample` vectors (and `sample_mb` MB),
    by hash of vec_id; every vector is in the index.  It has at most
    branch^depth leaves: the rows that ask are queries times leaves visited, so
    leaves in proportion to the vectors would make them grow with the square.
    """
    spark = vectors.sparkSession
    real = "float" if "array<float>" in dict(vectors.dtypes)["embedding"] else "double"
    whole = "vec_id is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(embedding, x -> x <> 0)"
    clean = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.expr(f"transform(cast(embedding as array<{real}>), x -> cast(x + 0 as {real}))").alias("embedding")).where(whole)
    lengths = clean(vectors).groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    shape = "query_id long, rank int, vec_id long, score double"
    if not lengths:
        return spark.createDataFrame([], shape)
    dim, total = lengths[0]["n"], lengths[0]["count"]
    of = lambda df: clean(df).where(F.size("embedding") == dim).select("vec_id", F.xxhash64("embedding").alias("h"), "embedding")
    every = of(vectors)

    most = max(branch, min(sample, (sample_mb << 20) // (8 * dim)))
    share = min(1 << 30, -(-(most << 30) // total))
    taken = every.where(F.pmod(F.xxhash64("vec_id", F.lit(29)), F.lit(1 << 30)) < share).limit(2 * most).select("embedding").toArrow()
    x = _matrix(taken.column(0), dim)
    grown = grow(x, branch, depth, leaf)
    tree = spark.sparkContext.broadcast(grown)

    element = f"array<{real}>"
    placed = every.mapInArrow(_assign(tree, dim, k), f"vec_id long, h long, embedding {element}, leaf int")
    same = Window.partitionBy("h", "embedding").orderBy("vec_id")
    few = placed.withColumn("r", F.dense_rank().over(same)).where(F.col("r") <= k + 1)
    index = saved(few.groupBy("h", "embedding", "leaf").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")).select("leaf", "embedding", "h", "ids"), "index")

    sizes, counts = np.zeros(grown.leaves, np.int64), np.zeros(grown.leaves, np.int64)
    for r in index.groupBy("leaf").agg(F.sum(F.size("ids")).alias("ids"), F.count("*").alias("n")).collect():  # a row a leaf
        sizes[r["leaf"]], counts[r["leaf"]] = r["ids"], r["n"]
    chunks = np.maximum(1, -(-counts // rows))

    tried = np.unique(x, axis=0)
    tried = tried[np.random.default_rng(1).permutation(len(tried))[:calibrators]]
    visits = _widened(spark, index, grown, tried, k, dim, target)

    wanted = of(queries)
    heads = wanted.groupBy("h", "embedding").agg(F.min("vec_id").alias("rep"))
    heads = saved(heads.select("h", "rep", "embedding"), "queries")
    ask = lambda parts, n: heads.mapInArrow(_ask(tree, sizes, n, parts, visits, k + 1, dim), f"h long, rep long, embedding {element}, leaf int, chunk int, part int")
    parts = np.ones(grown.leaves, np.int64)
    for r in ask(parts, parts).groupBy("leaf").count().collect():  # a row a leaf
        parts[r["leaf"]] = max(1, -(-r["count"] // asked))
    at = spark.sparkContext.broadcast((chunks, parts))
    held = index.mapInArrow(_deal(at), f"embedding {element}, ids array<long>, leaf int, chunk int, part int")
    found = held.groupBy("leaf", "chunk", "part").cogroup(ask(parts, chunks).groupBy("leaf", "chunk", "part")).applyInArrow(_meet(dim, k), "h long, rep long, vec_id long, score double")
    near = Window.partitionBy("h", "rep").orderBy("score", "vec_id")
    found = found.withColumn("r", F.row_number().over(near)).where(F.col("r") <= k + 1)  # cut in the tasks first
    best = found.groupBy("h", "rep").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("near"))

    # back from a class of equal queries to each of them, without its own row
    who = wanted.select("vec_id", "h", "embedding").distinct().join(heads, ["h", "embedding"]).select(F.col("vec_id").alias("query_id"), "h", "rep")
    near = F.slice(F.filter("near", lambda c: c["vec_id"] != F.col("query_id")), 1, k)
    each = who.join(best, ["h", "rep"]).select("query_id", F.posexplode(near).alias("at", "c"))
    return each.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("c.vec_id").alias("vec_id"), F.col("c.score").alias("score"))


def _deal(at):
    """Index rows -> once for each part of their leaf's queries, with the chunk they belong to."""

    def run(batches):
        chunks, parts = at.value
        for b in batches:
            leaf = b.column(0).to_numpy()
            h = b.column(2).to_numpy()
            n = parts[leaf]
            rows = np.repeat(np.arange(len(leaf)), n)
            part = np.arange(len(rows)) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n) if len(leaf) else rows
            take = pa.array(rows)
            yield pa.record_batch([b.column(1).take(take), b.column(3).take(take), pa.array(leaf[rows]), pa.array((h % chunks[leaf])[rows].astype(np.int32)), pa.array(part.astype(np.int32))], names=["embedding", "ids", "leaf", "chunk", "part"])

    return run


def _widened(spark, index: DataFrame, tree: Tree, tried: np.ndarray, k: int, dim: int, target: float) -> int:
    """The fewest visits that reach `target` of the calibrators' true neighbours, other classes than their own."""
    asked = spark.sparkContext.broadcast(tried)
    found = index.select("leaf", "embedding").mapInArrow(_truth(asked, dim, k), "q int, leaf int, d double")
    near = Window.partitionBy("q").orderBy("d", "leaf")
    leaves: dict[int, list[int]] = {}
    for r in found.withColumn("r", F.row_number().over(near)).where(F.col("r") <= k).select("q", "leaf").collect():  # k rows a calibrator
        leaves.setdefault(r["q"], []).append(r["leaf"])
    asked.unpersist()
    ranks = []
    for q, true in leaves.items():
        order = {leaf: i for i, leaf in enumerate(tree.visit(tried[q]))}
        ranks += [order[leaf] for leaf in true]
    ranks = np.array(ranks)
    visits = 1
    while visits < tree.leaves and len(ranks) and (ranks < visits).mean() < target:
        visits += 1
    return visits
