"""LM scoring: an interpolated modified Kneser-Ney trigram model, counted in Spark.

Tokens are words with A-Z lower-cased and one end mark for each text.  Counting
takes packed counts, combined in the tasks first:

1. Words, by ranges of their 64-bit hashes.  A range's reducer writes the sorted
   hashes and counts; a word's number is its place over all ranges.
2. Trigrams of word numbers, dealt by a hash of the middle word, so that one
   shuffle serves two orders: the reducer has all that follows a pair, and all
   different words before a pair.  It writes the tables of trigrams and of
   pairs; a pair's count is the number of words it was seen after.  Trigrams of
   a very frequent middle word are dealt by the first word too,
3. and its pairs are summed up once more, by both words.
4. Pairs go on, counted, by ranges of the second word: in how many different
   contexts each word stands.

A table holds sorted 40-bit hashes and a byte for each, that names one of the
255 commonest values of its file; other values lie in a list of their own.
What reaches the driver are the names and sizes of the files, the most frequent
words and the counts of counts that give the discounts.  The files lie in the
folder the cluster shares; workers map them into memory and look grams up by
binary search, for a whole batch at once.

p(w | u v) = max(c(u v w) - D(c), 0) / c(u v) + g(u v) p(w | v)
p(w | v) = max(k(v w) - D(k), 0) / k(v) + g(v) p(w), with k(v w) the words seen before v w
p(w) = max(k(w) - D(k), 0) / K + g 1 / (V + 1), with k(w) the words seen before w.

With order 2, k(v w) is the pair's own count and trigrams are left out.
"""

from __future__ import annotations

import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import M64, STEP, Words, buckets, mix, saved, shared, small

END = np.uint64(0x7C3A9D51E2B60F48)
HELD = 3_000_000
HELD_GRAMS = 1_500_000
LOW = np.uint64(0xFFFFFFFF)
WIDE = np.uint64(32)


def tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of a batch, and the first token of each row and the end."""
    w = Words(col, lower=True)
    first = w.first + np.arange(len(w.first))
    out = np.insert(w.hashes(), w.first[1:], END)
    return out, first


def _store(folder: str, kind: str, part: int, arrays: list[np.ndarray]) -> str:
    """Writes arrays one after the other, each from a multiple of 8 bytes; a task that runs again writes another file."""
    fs, root = pafs.FileSystem.from_uri(folder)
    name = f"{kind}-{part:06d}-{uuid.uuid4().hex}"
    with fs.open_output_stream(f"{root}/{name}") as out:
        for a in arrays:
            data = a.tobytes()
            out.write(data + bytes(-len(data) % 8))
    return f"{folder}/{name}"


def _load(uri: str, kinds: list[tuple[str, int]]) -> list[np.ndarray]:
    """The arrays of a file, mapped into memory.

    Where the folder is not mounted, the file is first copied, piece by piece,
    to one of the worker's own that has no name and goes with the worker.
    """
    fs, path = pafs.FileSystem.from_uri(uri)
    steps = [np.dtype(k).itemsize * n for k, n in kinds]
    size = sum(s + -s % 8 for s in steps)
    if not size:
        return [np.zeros(0, k) for k, _ in kinds]
    if isinstance(fs, pafs.LocalFileSystem):
        raw = np.memmap(path, np.uint8, "r", shape=(size,))
    else:
        with tempfile.TemporaryFile() as own, fs.open_input_stream(path) as file:
            while piece := file.read(1 << 22):
                own.write(piece)
            own.flush()
            raw = np.memmap(own, np.uint8, "r", shape=(size,))
    out, at = [], 0
    for (k, _), s in zip(kinds, steps):
        out.append(raw[at : at + s].view(k))
        at += s + -s % 8
    return out


def _planes(a: np.ndarray) -> bytes:
    """The bytes of whole numbers, all first ones first."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def _whole(raw: np.ndarray, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel() if len(raw) else np.zeros(0, kind)


def _pack(keys: np.ndarray, counts: np.ndarray, last: np.ndarray | None = None) -> bytes:
    """Sorted keys as differences, 64-bit counts and what else each key has, byte planes apart, compressed."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    data = _planes(gaps) + _planes(counts.astype(np.uint64)) + (b"" if last is None else _planes(last.astype(np.uint32)))
    return np.uint64(len(keys)).tobytes() + zlib.compress(data, 1)


def _unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    """Keys, counts and, where given, what else each key has."""
    n = int(np.frombuffer(blob, np.uint64, 1)[0])
    raw = np.frombuffer(zlib.decompress(blob[8:]), np.uint8)
    out = (np.cumsum(_whole(raw[: 8 * n], np.uint64), dtype=np.uint64), _whole(raw[8 * n : 16 * n], np.uint64).astype(np.int64))
    return (*out, _whole(raw[16 * n :], np.uint32)) if len(raw) > 16 * n else out


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    return k[start], np.add.reduceat(c, start) if len(k) else c


class Tally:
    """Counts of 64-bit keys, merged as they come, and given out in packed ranges."""

    def __init__(self):
        self.keys, self.counts, self.size = [], [], 0

    def add(self, keys: np.ndarray) -> None:
        k, c = np.unique(keys, return_counts=True)
        self.keys.append(k)
        self.counts.append(c)
        self.size += len(k)
        if self.size > HELD and len(self.keys) > 1:
            k, c = _merge(self.keys, self.counts)
            self.keys, self.counts, self.size = [k], [c], len(k)

    def ranges(self, bounds: np.ndarray):
        """A batch (bucket, data); bucket i holds keys from bounds[i] up to bounds[i + 1]."""
        k, c = _merge(self.keys, self.counts) if self.keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        cut = np.r_[np.searchsorted(k, bounds), len(k)]
        self.__init__()
        return _blobs(cut, lambda s: _pack(k[s], c[s]))


BLOBS = "bucket int, data binary"


def _blobs(cut: np.ndarray, pack):
    """A batch (bucket, data) of what lies between the cuts."""
    full = np.flatnonzero(np.diff(cut))
    return pa.record_batch([pa.array(full, pa.int32()), pa.array([pack(slice(int(cut[i]), int(cut[i + 1]))) for i in full], pa.binary())], names=["bucket", "data"])


def _word_bounds(buckets: int) -> np.ndarray:
    return np.array([(i << 64) // buckets for i in range(buckets)], np.uint64)


def _count_words(bounds):
    def run(batches):
        tally = Tally()
        for b in small(batches, col=0):
            tally.add(tokens(b.column(0))[0])
            if tally.size > HELD:
                yield tally.ranges(bounds)
        yield tally.ranges(bounds)

    return run


def _totals(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All packed counts of a bucket, a few at a time."""
    keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for blob in blobs:
        k, c = _unpack(blob)
        keys.append(k)
        counts.append(c)
        if sum(map(len, keys[1:])) > max(HELD, len(keys[0])):
            k, c = _merge(keys, counts)
            keys, counts = [k], [c]
    return _merge(keys, counts)


#: What a reducer hands on: a file with its tables' sizes and counts of counts, or packed counts for a bucket of a later step.
ROW = pa.schema([("kind", pa.string()), ("bucket", pa.int32()), ("file", pa.string()), ("sizes", pa.list_(pa.int64())), ("seen", pa.list_(pa.int64())), ("total", pa.int64()), ("data", pa.binary())])
ROWS = "kind string, bucket int, file string, sizes array<long>, seen array<long>, total long, data binary"


def _seen(counts: np.ndarray) -> list[int]:
    """How many counts there are, and how many are 1 to 4."""
    return [len(counts), *np.bincount(np.minimum(counts, 5), minlength=6)[1:5].tolist()]


def _rows(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), ROW)], schema=ROW) if rows else ROW.empty_table()


def _write_words(folder, top: int = 64):
    """A range's words -> its file; sizes are the words, then the numbers of the most frequent; seen their counts."""

    def run(_key, table):
        bucket = table.column("bucket")[0].as_py()
        keys, counts = _totals(table.column("data").to_pylist())
        name = _store(folder, "words", bucket, [keys, counts.astype(np.uint64)])
        most = np.argsort(-counts, kind="stable")[:top]
        return _rows([("words", bucket, name, [len(keys), *most.tolist()], counts[most].tolist(), int(counts.sum()), None)])

    return run


class Lexicon:
    """Word numbers by hash, over all ranges' files."""

    def __init__(self, files: list[tuple], buckets: int):
        self.bounds = _word_bounds(buckets)
        self.first = np.zeros(buckets + 1, np.int64)
        self.parts: dict[int, list[np.ndarray]] = {}
        for bucket, file, n in files:
            self.first[bucket + 1] = n
            self.parts[bucket] = _load(file, [("<u8", n), ("<u8", n)])
        self.first = np.cumsum(self.first)
        self.size = int(self.first[-1])

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of sorted keys: numbers (-1: unknown) and counts."""
        ids, counts = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        cut = np.r_[np.searchsorted(keys, self.bounds), len(keys)]
        for i in np.flatnonzero(np.diff(cut)).tolist():
            if i in self.parts:
                words, n = self.parts[i]
                k = keys[cut[i] : cut[i + 1]]
                at = np.minimum(np.searchsorted(words, k), len(words) - 1)
                known = words[at] == k
                ids[cut[i] : cut[i + 1]] = np.where(known, self.first[i] + at, -1)
                counts[cut[i] : cut[i + 1]] = np.where(known, n[at], 0)
        return ids, counts


def _context(ids: np.ndarray, first: np.ndarray, start: int) -> np.ndarray:
    """The number before each token; a text's first token follows number `start`."""
    before = np.r_[np.int64(start), ids[:-1]] if len(ids) else ids
    before[first[:-1][first[:-1] < len(ids)]] = start
    return before


def _numbered(col, lexicon: Lexicon):
    h, first = tokens(col)
    keys, inverse = np.unique(h, return_inverse=True)
    ids, counts = lexicon.find(keys)
    return ids[inverse], counts[inverse], first


_models: dict[str, object] = {}


def _kept(key: str, make):
    """One model at a time for a worker process."""
    if key not in _models:
        _models.clear()
        _models[key] = make()
    return _models[key]


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.uint64) << WIDE) | b.astype(np.uint64)


def _bucket(middle: np.ndarray, other: np.ndarray, buckets: int, hot: np.ndarray) -> np.ndarray:
    """Where a gram of a middle word lies; those of hot ones are dealt by another word too."""
    h = mix(middle.astype(np.uint64) + STEP)
    if len(hot):
        is_hot = _is_hot(middle, hot)
        h[is_hot] = mix(h[is_hot] + other[is_hot].astype(np.uint64) * STEP)
    return (h % np.uint64(buckets)).astype(np.int32)


def _is_hot(words: np.ndarray, hot: np.ndarray) -> np.ndarray:
    if not len(hot):
        return np.zeros(len(words), bool)
    words = words.astype(np.int64)
    return hot[np.minimum(np.searchsorted(hot, words), len(hot) - 1)] == words


def _hash40(a: np.ndarray, b: np.ndarray | None = None) -> np.ndarray:
    """40 bits of a pair of numbers, or of a pair and one more."""
    h = mix(a * STEP + np.uint64(1))
    if b is not None:
        h = mix(h + b.astype(np.uint64) * STEP)
    return h >> np.uint64(24)


def _count_grams(key, sent, buckets):
    """Texts -> packed trigrams (middle and first word, third word, count) by bucket."""

    def run(batches):
        files, hot = sent.value
        lexicon = _kept(key, lambda: Lexicon(files, buckets))
        held, size = [], 0
        for b in small(batches, col=0):
            ids, _, first = _numbered(b.column(0), lexicon)
            middle = _context(ids, first, lexicon.size)
            held.append((_pair(middle, _context(middle, first, lexicon.size)), ids.astype(np.uint32)))
            size += len(ids)
            if size > HELD_GRAMS:
                yield _deal(held, buckets, hot)
                held, size = [], 0
        if held:
            yield _deal(held, buckets, hot)

    return run


def _distinct(a: np.ndarray, w: np.ndarray, to: np.ndarray, c: np.ndarray | None = None):
    """Grams in the order of `to`, their pairs and last words, each once, with their counts."""
    order = np.lexsort((w, a, to))
    a, w, to = a[order], w[order], to[order]
    start = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (w[1:] != w[:-1]) | (to[1:] != to[:-1])]) if len(a) else order
    n = np.diff(np.r_[start, len(a)]) if c is None else np.add.reduceat(c[order], start) if len(a) else c
    return a[start], w[start], to[start], n


def _deal(held, buckets, hot):
    a, w = (np.concatenate(x) for x in zip(*held))
    a, w, to, n = _distinct(a, w, _bucket(a >> WIDE, a & LOW, buckets, hot))
    return _blobs(np.searchsorted(to, np.arange(buckets + 1)), lambda s: _pack(a[s], n[s], w[s]))


def _table(h: np.ndarray, values: np.ndarray) -> tuple[list[np.ndarray], list[int]]:
    """Arrays of a table of hashes and rows of values, and their sizes."""
    order = np.argsort(h, kind="stable")
    h, values = h[order], values[order].astype(np.uint64)
    key = np.zeros(len(h), np.uint64)
    for v in values.T:
        key = mix(key + v + STEP)
    _, at, inverse, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    common = np.argsort(-n, kind="stable")[:255]
    code = np.full(len(at), 255, np.uint8)
    code[common] = np.arange(len(common), dtype=np.uint8)
    code = code[inverse] if len(at) else code
    rest = np.flatnonzero(code == 255)
    hi = (h >> np.uint64(8)).astype(np.uint32)
    run = np.diff(np.r_[np.flatnonzero(np.r_[True, hi[1:] != hi[:-1]]), len(hi)]).max() if len(hi) else 0
    arrays = [hi, (h & np.uint64(255)).astype(np.uint8), code, values[at[common]].ravel(), rest.astype(np.uint64), values[rest].ravel()]
    return arrays, [len(h), len(common), len(rest), values.shape[1], int(run)]


def _kinds(sizes: list[int]) -> list[tuple[str, int]]:
    n, common, rest, width, _ = sizes
    return [("<u4", n), ("u1", n), ("u1", n), ("<u8", common * width), ("<u8", rest), ("<u8", rest * width)]


class Table:
    """Values by hash, from the arrays of a table."""

    def __init__(self, arrays: list[np.ndarray], sizes: list[int]):
        self.hi, self.lo, self.code, common, self.rest, rest = arrays
        self.run, width = sizes[4], sizes[3]
        self.common, self.values = common.reshape(-1, width), rest.reshape(-1, width)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Of sorted hashes: rows of values, 0 where there is none."""
        out = np.zeros((len(h), self.common.shape[1]), np.int64)
        if not len(self.hi):
            return out
        hi, lo = (h >> np.uint64(8)).astype(np.uint32), (h & np.uint64(255)).astype(np.uint8)
        first = np.searchsorted(self.hi, hi)
        at = np.full(len(h), -1)
        for j in range(self.run):
            place = np.minimum(first + j, len(self.hi) - 1)
            at = np.where((at < 0) & (self.hi[place] == hi) & (self.lo[place] == lo), place, at)
        known = np.flatnonzero(at >= 0)
        at = at[known]
        code = self.code[at]
        plain = code < 255
        out[known[plain]] = self.common[code[plain]]
        out[known[~plain]] = self.values[np.searchsorted(self.rest, at[~plain])]
        return out


def _stats(starts: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of each context: the sum of its counts, and how many are 1, 2 and more."""
    if not len(c):
        return np.zeros((0, 4), np.int64)
    return np.stack([np.add.reduceat(x.astype(np.int64), starts) for x in (c, c == 1, c == 2, c > 2)], 1)


def _starts(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)


def _pair_tables(pairs: np.ndarray, n: np.ndarray):
    """Tables of sorted pairs, and of the words they begin with."""
    at = _starts(pairs >> WIDE)
    return [_table(_hash40(pairs), n[:, None]), _table(_hash40((pairs >> WIDE)[at]), _stats(at, n))]


def _second_words(pairs: np.ndarray, firsts: np.ndarray) -> list[tuple]:
    """Packed counts of the pairs' second words, by range."""
    w, n = np.unique(pairs & LOW, return_counts=True)
    b = _blobs(np.r_[np.searchsorted(w, firsts[:-1].astype(np.uint64)), len(w)], lambda s: _pack(w[s], n[s]))
    return [("contexts", i, None, None, None, None, data) for i, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]


def _write_grams(folder, firsts, buckets, hot, order):
    """Trigrams of a bucket -> its tables' file, pairs of hot words, and the second words of the other pairs."""

    def run(_key, table):
        bucket = table.column("bucket")[0].as_py()
        keys, counts, last = (np.concatenate(x) for x in zip(*map(_unpack, table.column("data").to_pylist())))
        a, w, _, c = _distinct(keys, last, np.zeros(len(keys), np.uint8), counts)
        del keys, counts, last
        at = _starts(a)
        tables = [_table(_hash40(a, w), c[:, None]), _table(_hash40(a[at]), _stats(at, c))] if order == 3 else []
        seen = _seen(c)
        pairs, n = _merge([_pair(a >> WIDE, w)], [np.ones(len(a), np.int64) if order == 3 else c])
        del a, w, c
        is_hot = _is_hot(pairs >> WIDE, hot)
        out = []
        if is_hot.any():
            p, k = pairs[is_hot], n[is_hot]
            to = _bucket(p >> WIDE, p & LOW, buckets, hot)
            by = np.argsort(to, kind="stable")
            b = _blobs(np.searchsorted(to[by], np.arange(buckets + 1)), lambda s: _pack(p[by][s], k[by][s]))
            out = [("hot", i, None, None, None, None, data) for i, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        pairs, n = pairs[~is_hot], n[~is_hot]
        tables += _pair_tables(pairs, n)
        name = _store(folder, "grams", bucket, [x for t, _ in tables for x in t])
        return _rows([("grams", bucket, name, [s for _, t in tables for s in t], seen + _seen(n), None, None), *out, *_second_words(pairs, firsts)])

    return run


def _write_hot(folder, firsts):
    """Pairs of hot words in a bucket -> their table's file, each hot word's part of its sums, and their second words."""

    def run(_key, table):
        bucket = table.column("bucket")[0].as_py()
        pairs, n = _totals(table.column("data").to_pylist())
        (arrays, sizes), _ = _pair_tables(pairs, n)
        at = _starts(pairs >> WIDE)
        sums = [("sums", None, None, [int(w), *s], None, None, None) for w, s in zip((pairs >> WIDE)[at].tolist(), _stats(at, n).tolist())]
        return _rows([("hot", bucket, _store(folder, "hot", bucket, arrays), sizes, _seen(n), None, None), *sums, *_second_words(pairs, firsts)])

    return run


def _write_contexts(folder, firsts):
    def run(_key, table):
        bucket = table.column("bucket")[0].as_py()
        w, k = _totals(table.column("data").to_pylist())
        dense = np.zeros(int(firsts[bucket + 1] - firsts[bucket]), np.int64)
        dense[w.astype(np.int64) - int(firsts[bucket])] = k
        return _rows([("contexts", bucket, _store(folder, "contexts", bucket, [dense.astype(np.uint64)]), [len(dense)], _seen(dense[dense > 0]), int(dense.sum()), None)])

    return run


def discounts(c: list[int]) -> np.ndarray:
    """D for counts of 0, 1, 2 and more, from how many were seen 1 to 4 times."""
    c1, c2, c3, c4 = c
    if not c1 or not c2:
        return np.array([0, 0.5, 0.5, 0.5])
    y = c1 / (c1 + 2 * c2)
    d = [0.0, 1 - 2 * y * c2 / c1, 2 - 3 * y * c3 / c2, 3 - 4 * y * c4 / c3 if c3 else 1.5]
    return np.array([0, *(float(np.clip(x, 0.05, i - 0.05)) for i, x in enumerate(d[1:], 1))])


def _lookup(tables, bucket: np.ndarray, h: np.ndarray, width: int) -> np.ndarray:
    """Rows of values by bucket and hash."""
    keys, inverse = np.unique((bucket.astype(np.uint64) << np.uint64(40)) | h, return_inverse=True)
    own = keys >> np.uint64(40)
    out = np.zeros((len(keys), width), np.int64)
    at = _starts(own)
    for s, e in zip(at.tolist(), np.r_[at[1:], len(keys)].tolist()):
        table = tables(int(own[s]))
        if table is not None:
            out[s:e] = table.find(keys[s:e] & np.uint64((1 << 40) - 1))
    return out[inverse]


class Model:
    """The model's files, for scores of whole batches; a file is mapped when it is first asked."""

    def __init__(self, words, grams, hot_files, contexts, buckets, hot, hot_sums, discount, kinds, total, order):
        self.lexicon = Lexicon(words, buckets)
        self.buckets, self.hot, self.hot_sums, self.order = buckets, hot, hot_sums, order
        self.d3, self.d2, self.d1 = discount
        self.files, self.hot_files = {b: (f, s) for b, f, s in grams}, {b: (f, s) for b, f, s in hot_files}
        self.open: dict[tuple, list] = {}
        self.contexts = {b: _load(f, [("<u8", s[0])])[0] for b, f, s in contexts}
        self.total, self.rest = max(total, 1), float(np.dot(self.d1[1:], kinds)) / max(total, 1) if total else 1.0

    def _tables(self, files: dict, which: int):
        def get(bucket: int):
            if bucket not in files:
                return None
            key = (files is self.hot_files, bucket)
            if key not in self.open:
                file, sizes = files[bucket]
                parts = [sizes[i : i + 5] for i in range(0, len(sizes), 5)]
                arrays = _load(file, [k for p in parts for k in _kinds(p)])
                self.open[key] = [Table(arrays[6 * i : 6 * i + 6], p) for i, p in enumerate(parts)]
            return self.open[key][which]

        return get

    def unigram(self, ids: np.ndarray) -> np.ndarray:
        """p(w) of sorted numbers; -1: a word never seen."""
        out = np.full(len(ids), self.rest / (self.lexicon.size + 1))
        known = ids >= 0
        k = np.zeros(len(ids), np.int64)
        cut = np.r_[np.searchsorted(ids, self.lexicon.first[:-1]), len(ids)]
        for i in np.flatnonzero(np.diff(cut)).tolist():
            if i in self.contexts:
                s = slice(int(cut[i]), int(cut[i + 1]))
                k[s] = self.contexts[i][ids[s] - self.lexicon.first[i]]
        out[known] += np.maximum(k - self.d1[np.minimum(k, 3)], 0)[known] / self.total
        return out

    @staticmethod
    def _mixed(c, stats, d, known, lower):
        """A discounted share and what its context leaves to the lower order."""
        total = stats[:, 0]
        ok, t = known & (total > 0), np.maximum(total, 1)
        high = np.where(ok, np.maximum(c - d[np.minimum(c, 3)], 0) / t, 0)
        return high + np.where(ok, stats[:, 1:] @ d[1:] / t, 1) * lower

    def log10(self, first: np.ndarray, middle: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """log10 p of each token after its two contexts; -1: unknown."""
        words, inverse = np.unique(ids, return_inverse=True)
        p = self.unigram(words)[inverse]
        seen_2 = middle >= 0
        m, w = np.maximum(middle, 0), np.maximum(ids, 0)
        pairs = _pair(m, w)
        of = 2 if self.order == 3 else 0
        is_hot = _is_hot(m, self.hot)
        c, stats = np.zeros(len(ids), np.int64), np.zeros((len(ids), 4), np.int64)
        for mask, files, other in ((~is_hot, self.files, None), (is_hot, self.hot_files, w)):
            if mask.any():
                to = _bucket(m[mask], np.zeros(0) if other is None else other[mask], self.buckets, self.hot if other is not None else self.hot[:0])
                c[mask] = _lookup(self._tables(files, of if other is None else 0), to, _hash40(pairs[mask]), 1)[:, 0]
                if other is None:
                    stats[mask] = _lookup(self._tables(files, of + 1), to, _hash40(m[mask].astype(np.uint64)), 4)
        if is_hot.any():
            stats[is_hot] = self.hot_sums[np.searchsorted(self.hot, m[is_hot])]
        c[~seen_2 | (ids < 0)] = 0
        p = self._mixed(c, stats, self.d2, seen_2, p)
        if self.order == 3:
            known = seen_2 & (first >= 0)
            f = np.maximum(first, 0)
            a, to = _pair(m, f), _bucket(m, f, self.buckets, self.hot)
            c = _lookup(self._tables(self.files, 0), to, _hash40(a, w.astype(np.uint32)), 1)[:, 0]
            c[~known | (ids < 0)] = 0
            p = self._mixed(c, _lookup(self._tables(self.files, 1), to, _hash40(a), 4), self.d3, known, p)
        return np.log10(p)


def _score(key, make, total: int, size: int):
    def run(batches):
        model = _kept(key, make)
        for b in small(batches):
            ids, counts, first = _numbered(b.column(1), model.lexicon)
            middle = _context(ids, first, model.lexicon.size)
            own = model.log10(_context(middle, first, model.lexicon.size), middle, ids)
            base = np.log10((counts + 1) / (total + size + 1))
            add = lambda x: np.add.reduceat(x, first[:-1])  # noqa: E731  every text has its end mark
            yield pa.record_batch(
                [b.column(0), b.column(2), pa.array(np.diff(first), pa.int64()), pa.array(add((counts > 0).astype(np.int64))), pa.array(np.full(len(b), total, np.int64)), pa.array(add(base)), pa.array(add(own))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return run


def kneser_ney(docs: DataFrame, order: int = 3) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each input row.

    order: 3, or 2.  Learns from rows that aren't held out.  A null text is
    empty: its end mark is scored.  A null doc_id is learned from.  Repeated
    rows count and are scored each.  Other columns are ignored; an empty table
    gives an empty table.  If nothing is learned, every token has the share
    1 / (V + 1) = 1.  Results hold up to collisions of 64-bit hashes of words
    and of 40-bit hashes of grams within a bucket.
    """
    if order not in (2, 3):
        raise ValueError("order is 2 or 3")
    spark = docs.sparkSession
    folder = shared(spark, "kneser-ney")
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root)
    parts = buckets(docs, 1 << 24)
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held.alias("held_out"))
    train = d.where("not held_out").select("text")

    def packed(df, step):
        return df.select("bucket", "data").groupBy("bucket").applyInArrow(step, ROWS)

    def of(df, kind):
        return df.where(F.col("kind") == kind)

    def files(df, kind):
        """A row for each range."""
        return of(df, kind).where("file is not null").drop("data").collect()

    words = files(saved(packed(train.mapInArrow(_count_words(_word_bounds(parts)), BLOBS), _write_words(folder)), "words"), "words")
    firsts = np.zeros(parts + 1, np.int64)
    for r in words:
        firsts[r["bucket"] + 1] = r["sizes"][0]
    firsts = np.cumsum(firsts)
    size, total = int(firsts[-1]), sum(r["total"] for r in words)
    if size >= M64 >> 32:
        raise ValueError("more than 2^32 different words")
    frequent = [(int(firsts[r["bucket"]]) + i, n) for r in words for i, n in zip(r["sizes"][1:], r["seen"])]
    hot = np.array(sorted(i for i, n in frequent if n * 4 * parts > total), np.int64)
    lexicon = [(r["bucket"], r["file"], r["sizes"][0]) for r in words]
    known = spark.sparkContext.broadcast((lexicon, hot))
    grams = saved(packed(train.mapInArrow(_count_grams(folder, known, parts), BLOBS), _write_grams(folder, firsts, parts, hot, order)), "grams")
    split = saved(packed(of(grams, "hot"), _write_hot(folder, firsts)), "hot")
    seconds = of(grams, "contexts").unionAll(of(split, "contexts"))
    contexts = files(saved(packed(seconds, _write_contexts(folder, firsts)), "contexts"), "contexts")
    found, hot_files = files(grams, "grams"), files(split, "hot")
    sums = of(split, "sums").groupBy(F.col("sizes")[0].alias("word")).agg(*[F.sum(F.col("sizes")[i]).alias(f"s{i}") for i in range(1, 5)]).collect()  # a row for each hot word
    hot_sums = np.zeros((len(hot), 4), np.int64)
    for r in sums:
        hot_sums[np.searchsorted(hot, r["word"])] = r[1:]

    def many(lists):
        """Counts of counts, summed over files: all, and those of 1 to 4."""
        return np.array(lists, np.int64).reshape(-1, 5).sum(0).tolist()

    threes, twos, ones = many([r["seen"][:5] for r in found]), many([r["seen"][5:] for r in found] + [r["seen"] for r in hot_files]), many([r["seen"] for r in contexts])
    discount = [discounts(x[1:]) for x in (threes, twos, ones)]
    kinds = (ones[1], ones[2], ones[0] - ones[1] - ones[2])
    named = [[(r["bucket"], r["file"], r["sizes"]) for r in x] for x in (found, hot_files, contexts)]
    sent = spark.sparkContext.broadcast((lexicon, *named, parts, hot, hot_sums, discount, kinds, sum(r["total"] for r in contexts), order))
    kinds_out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return d.select("doc_id", "text", "held_out").mapInArrow(_score(folder + "/model", lambda: Model(*sent.value), total, size), kinds_out)
