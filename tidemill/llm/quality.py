"""Quality rules: boosted trees over document statistics, scored as flat arrays.

Statistics of whole texts are counted in one pass.  The trees are grown on a
sample of at most `sample` labelled rows, with histograms of quantile bins and
Newton steps on the logistic loss; a feature marked falling may only lower the
score as it rises: splits that would raise it are refused, and the middle of a
split's two values bounds all values below it.  The grown trees are flattened
into node arrays (feature, threshold, left, right, value), broadcast, and walked
by all documents of a batch at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import Words, grams, small

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
PUNCT = np.zeros(256, bool)
PUNCT[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
FEATURES = ("words", "mean_word", "symbols", "dup_lines", "repeats", "upper", "digits", "punct", "distinct", "mean_line")
#: More symbols, repeated lines or repeated words never raise the score.
FALLING = (2, 3, 4)


def _repeats(w: Words, h: np.ndarray, n: int = 5) -> np.ndarray:
    """For each row, the words in n-word windows found twice or more in it."""
    rows = len(w.first) - 1
    row = np.repeat(np.arange(rows), w.counts())
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(rows, np.int64)
    g = grams(h, n)
    at = np.flatnonzero(row[:m] == row[n - 1 :])
    key = g[at] + row[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = at[count[inverse] > 1]
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + n, -1)
    hit = np.r_[0, np.cumsum(np.cumsum(edge[:-1]) > 0)]
    return hit[w.first[1:]] - hit[w.first[:-1]]


def statistics(col: pa.Array) -> dict[str, np.ndarray]:
    """Counts of each text; a null text has none."""
    w = Words(col)
    h = w.hashes()
    buf, offs = w.buf, w.offs

    def per_row(mask):
        total = np.r_[0, np.cumsum(mask)]
        return total[offs[1:]] - total[offs[:-1]]

    lead = (buf & 0xC0) != 0x80
    chars = np.r_[0, np.cumsum(lead)]
    in_words = chars[w.ends] - chars[w.starts]
    sums = np.r_[0, np.cumsum(in_words)]
    n = w.counts()
    dup, lines, distinct = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    data = buf.tobytes()
    for i, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist())):
        with_word = [x for x in data[a:b].split(b"\n") if not x.isspace() and x]
        lines[i] = len(with_word)
        dup[i] = len(with_word) - len(set(with_word))
        distinct[i] = len(np.unique(h[w.first[i] : w.first[i + 1]]))
    return {
        "n_words": n, "word_chars": sums[w.first[1:]] - sums[w.first[:-1]], "n_symbols": per_row(SYMBOLS[buf]), "n_dup_lines": dup, "n_repeat_words": _repeats(w, h),
        "upper": per_row(UPPER[buf]), "digits": per_row(DIGIT[buf]), "punct": per_row(PUNCT[buf]), "distinct": distinct, "lines": lines, "chars": per_row(lead),
    }


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """The trees' inputs, in the order of FEATURES; finite for empty texts."""
    n, chars, lines = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1), np.maximum(s["lines"], 1)
    return np.stack([np.log1p(s["n_words"]), s["word_chars"] / n, s["n_symbols"] / chars, s["n_dup_lines"] / lines, s["n_repeat_words"] / n, s["upper"] / chars, s["digits"] / chars, s["punct"] / chars, s["distinct"] / n, s["n_words"] / lines], 1)


@dataclass
class Trees:
    """All trees in one set of node arrays; a leaf's feature is -1."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities, all rows walking one tree after the other."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while True:
                f = self.feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                go_left = x[rows, np.maximum(f, 0)] <= self.threshold[at]
                at = np.where(inner, np.where(go_left, self.left[at], self.right[at]), at)
            out += self.value[at]
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, falling: tuple[int, ...] = FALLING, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: int = 20) -> Trees:
    """Boosted trees on rows x with labels y (0 or 1)."""
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    nodes: list[list] = []
    roots: list[int] = []
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T] if len(x) else []
    binned = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, x.T)], 1) if len(x) else x
    base = np.log(share / (1 - share))
    f = np.full(len(y), base)

    def leaf(g, h, low, high):
        return float(np.clip(-g / (h + ridge), low, high))

    def split(rows, grad, hess, low, high, level) -> int:
        me = len(nodes)
        g, h = grad[rows].sum(), hess[rows].sum()
        nodes.append([-1, 0.0, -1, -1, leaf(g, h, low, high) * rate])
        best = (1e-6, None)
        if level < depth and len(rows) >= 2 * least:
            for j, cut in enumerate(cuts):
                if not len(cut):
                    continue
                b = binned[rows, j]
                gs, hs, ns = (np.cumsum(np.bincount(b, w, len(cut) + 1))[:-1] for w in (grad[rows], hess[rows], np.ones(len(rows))))
                vl, vr = np.clip(-gs / (hs + ridge), low, high), np.clip(-(g - gs) / (h - hs + ridge), low, high)
                gain = gs**2 / (hs + ridge) + (g - gs) ** 2 / (h - hs + ridge) - g**2 / (h + ridge)
                ok = (ns >= least) & (len(rows) - ns >= least)
                if j in falling:
                    ok &= vl >= vr
                gain = np.where(ok, gain, -1)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (j, k, vl[k], vr[k]))
        if best[1]:
            j, k, vl, vr = best[1]
            go = binned[rows, j] <= k
            # values below a falling split stay on their sides of its middle
            mid = (vl + vr) / 2
            l_low, r_high = (max(low, mid), min(high, mid)) if j in falling else (low, high)
            left = split(rows[go], grad, hess, l_low, high, level + 1)
            right = split(rows[~go], grad, hess, low, r_high, level + 1)
            nodes[me][:4] = [j, float(cuts[j][k]), left, right]
        return me

    if 0 < y.sum() < len(y):
        for _ in range(trees):
            p = 1 / (1 + np.exp(-f))
            first = len(nodes)
            roots.append(split(np.arange(len(y)), p - y, np.maximum(p * (1 - p), 1e-6), -4.0, 4.0, 0))
            one = _flat(nodes[first:], [0], 0.0, first)
            f += _raw(one, x)
    return _flat(nodes, roots, base, 0)


def _flat(nodes, roots, base, shift) -> Trees:
    a = np.array(nodes, float).reshape(-1, 5)
    return Trees(a[:, 0].astype(np.int64), a[:, 1], a[:, 2].astype(np.int64) - shift, a[:, 3].astype(np.int64) - shift, a[:, 4], np.array(roots, np.int64), float(base))


def _raw(t: Trees, x: np.ndarray) -> np.ndarray:
    p = t.score(x)
    return np.log(p / (1 - p))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _features(batches):
    for b in small(batches):
        yield pa.record_batch([b.column(2), pa.array(list(features(statistics(b.column(1)))), pa.list_(pa.float64()))], names=["quality", "f"])


def _judge(model, least: float, min_words: int, repeat_pct: int):
    def run(batches):
        trees = model.value
        for b in small(batches):
            s = statistics(b.column(1))
            score = trees.score(features(s))
            failed = (s["n_words"] < min_words) | (100 * s["n_repeat_words"] > repeat_pct * s["n_words"])
            yield pa.record_batch([b.column(0), *(pa.array(s[c], pa.int64()) for c in COUNTS), pa.array(failed), pa.array(~failed & (score >= least)), pa.array(score)], names=["doc_id", *COUNTS, "base_failed", "kept", "score"])

    return run


def quality_rules(docs: DataFrame, labels: DataFrame, sample: int = 20_000, least: float = 0.5, min_words: int = 10, repeat_pct: int = 20) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score).

    A null, empty or blank text has counts of 0 and fails the base rules.  A
    doc_id labelled twice is bad if any of its labels is, and of its texts one
    is learned from; null labels and doc_ids teach nothing.  With one class or no labels, the score is the share
    of good rows, 0.5 if there is none.  Repeated rows each give a row; other
    columns are ignored; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id", F.lit(1))).limit(sample)
    known = spark.createDataFrame(known.collect(), known.schema)  # at most `sample` rows
    # one text for each doc_id, so that a doc_id's repeats do not pass the bound
    rows = d.where("doc_id is not null").join(F.broadcast(known), "doc_id").groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "quality").mapInArrow(_features, "quality int, f array<double>").collect()
    x = np.array([r["f"] for r in rows]).reshape(len(rows), len(FEATURES))
    model = spark.sparkContext.broadcast(grow(x, np.array([r["quality"] for r in rows], float)))
    kinds = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, score double"
    return d.mapInArrow(_judge(model, least, min_words, repeat_pct), kinds)
