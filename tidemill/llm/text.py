"""Vectorised word, hash and n-gram helpers over Arrow string batches.

Words are maximal runs of bytes outside space and \\x09-\\x0D; a null text has
none.  All helpers work on a whole batch at once: one contiguous UTF-8 buffer,
cut by row offsets.  Hashes are 64 bits wide and the same on every machine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

M64 = (1 << 64) - 1
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Odd multipliers (fixed by us); INV is BASE's inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15 | 1
INV = pow(BASE, -1, 1 << 64)
STEP = np.uint64(0xD1B54A32D192ED03)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the 64 output bits (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * STEP)
#: Bytes hashed at a time, and powers kept by a process.
PIECE = 1 << 19
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i < n; up to 2 * PIECE of them are kept by the process."""
    if len(_powers.get("up", ())) >= n:
        return _powers["up"], _powers["down"]
    made = {}
    for name, base in (("up", BASE), ("down", INV)):
        a = np.full(1 << max(16, (n - 1).bit_length()), base, np.uint64)
        a[0] = 1
        made[name] = np.multiply.accumulate(a, out=a)
    if n <= 2 * PIECE:
        _powers.update(made)
    return made["up"], made["down"]


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    offs = np.frombuffer(col.buffers()[1], np.int64, n + 1, col.offset * 8) if n else np.zeros(1, np.int64)
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits for each buf[start:end], in ascending order and apart; a long buffer is hashed piece by piece."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(starts, lo + PIECE)))
        part = BYTE_CODE[buf[lo : ends[j - 1]]]
        up, down = powers(len(part) + 1)
        total = np.empty(len(part) + 1, np.uint64)
        total[0] = 0
        part *= up[: len(part)]
        np.cumsum(part, out=total[1:])
        s = starts[i:j] - lo
        out[i:j] = mix((total[ends[i:j] - lo] - total[s]) * down[s])
        i = j
    return out


class Words:
    """Words of a batch: byte starts and ends, and first[i]:first[i + 1] for row i."""

    def __init__(self, col: pa.Array, lower: bool = False):
        buf, offs = utf8(col)
        if lower:
            buf = LOWER[buf]
        self.buf, self.offs, n = buf, offs, len(buf)
        gap = SPACE[buf]
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        word = ~gap
        begin = word.copy()
        if n:
            begin[1:] &= gap[:-1] | edge[1:n]
        self.starts = np.flatnonzero(begin)
        end = word
        if n:
            end[:-1] &= gap[1:] | edge[1:n]
        self.ends = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, offs)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """64 bits for each word."""
        return span_hashes(self.buf, self.starts, self.ends)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the len(h) - k + 1 runs of k items."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out *= STEP
        out += h[j : j + n]
    return mix(out)


def small(batches, size: int = 1 << 21, col: int = 1):
    """The same rows in slices of about `size` bytes of text; a longer row is alone."""
    for b in batches:
        _, offs = utf8(b.column(col))
        a = 0
        while a < len(b):
            z = max(a + 1, int(np.searchsorted(offs, offs[a] + size, side="right")) - 1)
            yield b.slice(a, z - a)
            a = z


def shared(spark, name: str) -> str:
    """A fresh path in the folder the cluster shares (spark.checkpoint.dir).

    Without that setting, a folder of this machine serves where all of Spark
    runs on it (local mode, as in tests); on a cluster it is an error.
    """
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidemill-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def buckets(df, size: int = 1 << 26, most: int = 1 << 16) -> int:
    """How many parts to deal the rows of df into: one for each `size` bytes that df reads.

    At least the session's shuffle partitions.  Inputs whose size Spark does
    not know (rows from the driver) count nothing.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    read = sum(x for x in sizes if x < 1 << 60)
    return min(most, max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-read // size)))


def saved(df, name: str):
    """Writes df to the shared folder and reads it back: lineage ends here."""
    spark = df.sparkSession
    path = shared(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_ids(docs, id_col: str = "doc_id", text_col: str = "text"):
    """The two columns the operators read, under fixed names."""
    from pyspark.sql import functions as F

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
