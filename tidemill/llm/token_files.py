"""Token files: independent zstandard frames, a document index and a seek table.

A file is a row of zstandard frames, each the token ids of some whole documents
as little-endian unsigned integers, followed by two skippable frames.  The first
is the document index: doc_id, ids and nulls of all documents, in order.  The
second is the seek table of the public seekable format: for each frame its
compressed size, size and the low 32 bits of its XXH64, then the number of
frames, a descriptor with the checksum bit, and the magic number.  A reader
takes the tables from the file's end and decompresses only the frames it needs.

Documents are dealt into files by ranges of doc_id, so files in order and the
documents in each give ascending doc_id over all.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import SPACE, Words, buckets, saved, shared, small, span_hashes, with_ids

#: Fixed values of the public seekable format.
SKIPPABLE, SEEK_TABLE, SEEKABLE, CHECKED = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
#: UTF-8 of the white space that a text may hold beyond the bytes which end words.
OTHER_SPACE = [c.encode() for c in "\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"]
ODD = {n: np.array([int.from_bytes(c, "big") for c in OTHER_SPACE if len(c) == n]) for n in (1, 2, 3)}
#: Bytes of chunks and their ids that a process keeps.
MOST_KEPT = 40 << 20
SLICE = 1 << 20


def _odd_rows(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The rows with white space beyond the bytes which end words."""
    found = [np.flatnonzero((buf >= 0x1C) & (buf <= 0x1F))]
    for n, leads in ((2, (0xC2,)), (3, (0xE1, 0xE2, 0xE3))):
        at = np.flatnonzero(np.isin(buf[: len(buf) - n + 1], leads))
        code = np.zeros(len(at), np.int64)
        for j in range(n):
            code = code << 8 | buf[at + j]
        found.append(at[np.isin(code, ODD[n])])
    return np.unique(np.searchsorted(offs, np.concatenate(found), side="right") - 1)


def _runs(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers from start to start + n of all rows, one after the other."""
    stop = np.cumsum(n)
    return np.arange(stop[-1] if len(stop) else 0) + np.repeat(start - (stop - n), n)


class Known:
    """Chunks seen before and their ids: sorted hashes, each with the number of its row in flat buffers."""

    def __init__(self, kind):
        self.key, self.row = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.raw, self.ids = np.zeros(0, np.uint8), np.zeros(0, kind)
        self.cut = np.zeros((0, 4), np.int32)  # start and length in raw, start and length in ids
        self.used = np.zeros(0, bool)

    def size(self) -> int:
        return self.key.nbytes + self.row.nbytes + self.raw.nbytes + self.ids.nbytes + self.cut.nbytes

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Rows of keys; -1: not known."""
        if not len(self.key):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.key, keys), len(self.key) - 1)
        return np.where(self.key[at] == keys, self.row[at], -1)

    def add(self, keys: np.ndarray, raw: np.ndarray, raw_n: np.ndarray, ids: np.ndarray, ids_n: np.ndarray) -> None:
        cut = np.stack([len(self.raw) + np.cumsum(raw_n) - raw_n, raw_n, len(self.ids) + np.cumsum(ids_n) - ids_n, ids_n], 1).astype(np.int32)
        at = np.searchsorted(self.key, keys)
        row = np.arange(len(self.cut), len(self.cut) + len(keys), dtype=np.int32)
        self.key, self.row = np.insert(self.key, at, keys), np.insert(self.row, at, row)
        self.cut, self.used = np.concatenate([self.cut, cut]), np.r_[self.used, np.zeros(len(keys), bool)]
        self.raw, self.ids = np.concatenate([self.raw, raw]), np.concatenate([self.ids, ids])

    def shrink(self) -> None:
        """Keeps what was met again, or nothing if that is most of it."""
        k = np.flatnonzero(self.used[self.row])
        if 2 * len(k) > len(self.key):
            k = k[:0]
        c = self.cut[self.row[k]].T.astype(np.int64)
        key, raw, ids = self.key[k], self.raw[_runs(c[0], c[1])], self.ids[_runs(c[2], c[3])]
        self.__init__(self.ids.dtype)
        self.add(key, raw, c[1], ids, c[3])


class Encoder:
    """Byte-level BPE of whole texts; chunks of white space and a word are encoded once.

    A pre-token never runs from a word into white space, so a text cut before
    each run of white space has the same ids.  Texts with other white space than
    the words' are encoded whole.  Chunks meet by hash and are compared byte by
    byte: where two of one hash differ, the texts of the slice are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.bytes_of[i] = len(token)
        self.kind = np.uint16 if len(self.bytes_of) <= 1 << 16 else np.uint32
        self.known = Known(self.kind)

    def plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, keys: np.ndarray, raw: np.ndarray, size: np.ndarray) -> None:
        """Encodes chunks given one after the other in raw; those of white space and a word go joined."""
        end = np.cumsum(size)
        joined = SPACE[raw[end - size]] & ~SPACE[raw[end - 1]]
        ids: list[np.ndarray] = []
        count = np.zeros(len(size), np.int64)
        order = np.r_[np.flatnonzero(~joined), np.flatnonzero(joined)]
        alone = int((~joined).sum())
        data = raw.tobytes()
        texts = [data[end[i] - size[i] : end[i]].decode() for i in order[:alone]]
        for a in range(0, alone, 4096):
            for i, x in zip(order[a : a + 4096], self.plain(texts[a : a + 4096])):
                ids.append(np.array(x, self.kind))
                count[i] = len(x)
        for a in range(alone, len(order), 4096):
            part = order[a : a + 4096]
            got = np.array(self.plain([raw[_runs(end[part] - size[part], size[part])].tobytes().decode()])[0], self.kind)
            ids.append(got)
            count[part] = np.diff(np.searchsorted(np.cumsum(self.bytes_of[got]), np.cumsum(size[part])) + 1, prepend=0)
        flat = np.concatenate(ids) if ids else np.zeros(0, self.kind)
        start = np.empty(len(size), np.int64)
        start[order] = np.cumsum(count[order]) - count[order]
        self.known.add(keys, raw, size, flat[_runs(start, count)], count)

    def encode(self, col: pa.Array) -> list[bytes]:
        """Ids of each text, packed; a null text is empty."""
        w = Words(col)
        odd = _odd_rows(w.buf, w.offs)
        # chunk: from the last word's end to this word's; what is left after a text's last word is a chunk too
        first, last = w.first[:-1], w.first[1:]
        some = last > first
        tail = np.where(some, w.ends[np.maximum(last, 1) - 1] if len(w.ends) else 0, w.offs[:-1])
        has_tail = tail < w.offs[1:]
        cuts = [w.ends, w.offs[1:][has_tail]]
        ends = np.sort(np.concatenate(cuts)) if has_tail.any() else w.ends
        starts = np.r_[0, ends[:-1]].astype(np.int64)[: len(ends)]
        size = ends - starts
        keys, at, inverse = np.unique(span_hashes(w.buf, starts, ends), return_index=True, return_inverse=True)
        canon, canon_n = starts[at], size[at]
        same = np.array_equal(canon_n[inverse], size) and np.array_equal(w.buf[_runs(canon[inverse], size)], w.buf)
        place = self.known.find(keys)
        old = np.flatnonzero(place >= 0)
        self.known.used[place[old]] = True
        c = self.known.cut[place[old]].T.astype(np.int64)
        same = same and np.array_equal(c[1], canon_n[old]) and np.array_equal(self.known.raw[_runs(c[0], c[1])], w.buf[_runs(canon[old], canon_n[old])])
        if not same:  # two chunks of one hash
            return [np.array(x, self.kind).tobytes() for x in self.plain([t or "" for t in col.to_pylist()])]
        new = np.flatnonzero(place < 0)
        if len(new):
            if self.known.size() > MOST_KEPT:
                self.known.shrink()
                new = np.flatnonzero(self.known.find(keys) < 0)
            self._learn(keys[new], w.buf[_runs(canon[new], canon_n[new])], canon_n[new])
            place = self.known.find(keys)
        c = self.known.cut[place, 2:].astype(np.int64)[inverse]
        n = c[:, 1]
        flat = self.known.ids[_runs(c[:, 0], n)].tobytes()
        cut = np.r_[0, np.cumsum(n)][np.searchsorted(ends, w.offs, side="right")] * np.dtype(self.kind).itemsize
        out = [flat[s:e] for s, e in zip(cut[:-1].tolist(), cut[1:].tolist())]
        if len(odd):
            for i, x in zip(odd.tolist(), self.plain(col.take(pa.array(odd)).to_pylist())):
                out[i] = np.array(x, self.kind).tobytes()
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The process's encoder."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Writer:
    """Writes one token file to an open stream."""

    def __init__(self, out, width: int, frame_bytes: int = 1 << 18):
        self.out, self.width, self.frame_bytes = out, width, frame_bytes
        self.codec = zstandard.ZstdCompressor(level=1)
        self.held, self.size, self.frames = [], 0, []
        self.docs, self.counts, self.nulls = [], [], []

    def add(self, doc: int | None, ids: bytes) -> None:
        self.held.append(ids)
        self.size += len(ids)
        self.docs.append(doc or 0)
        self.nulls.append(doc is None)
        self.counts.append(len(ids) // self.width)
        if self.size >= self.frame_bytes:
            self.flush()

    def flush(self) -> None:
        if self.held:
            data = b"".join(self.held)
            packed = self.codec.compress(data)
            self.out.write(packed)
            self.frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
            self.held, self.size = [], 0

    def close(self) -> int:
        self.flush()
        index = self.codec.compress(np.array(self.docs, "<i8").tobytes() + np.array(self.counts, "<i8").tobytes() + np.array(self.nulls, "u1").tobytes())
        self.out.write(struct.pack("<II", SKIPPABLE, len(index) + 16) + index + struct.pack("<QII", len(self.docs), self.width, len(index)))
        table = b"".join(struct.pack("<III", *f) for f in self.frames)
        self.out.write(struct.pack("<II", SEEK_TABLE, len(table) + 9) + table + struct.pack("<IBI", len(self.frames), CHECKED, SEEKABLE))
        return sum(self.counts)


class Reader:
    """Reads documents of one token file, frame by frame."""

    def __init__(self, file):
        self.file, size = file, file.size()
        n, checked, magic = struct.unpack("<IBI", file.read_at(9, size - 9))
        if magic != SEEKABLE or checked != CHECKED:
            raise ValueError("not a token file")
        at = size - 9 - 12 * n
        self.frames = np.frombuffer(file.read_at(12 * n, at), "<u4").reshape(n, 3).astype(np.int64)
        docs, self.width, packed = struct.unpack("<QII", file.read_at(16, at - 8 - 16))
        index = zstandard.ZstdDecompressor().decompress(file.read_at(packed, at - 8 - 16 - packed))
        self.docs = np.frombuffer(index, "<i8", docs)
        self.counts = np.frombuffer(index, "<i8", docs, 8 * docs)
        self.nulls = np.frombuffer(index, "u1", docs, 16 * docs).astype(bool)
        self.begin = np.r_[0, np.cumsum(self.counts)] * self.width
        self.offset, self.starts = np.r_[0, np.cumsum(self.frames[:, 0])], np.r_[0, np.cumsum(self.frames[:, 1])]
        self.kept = (-1, b"")

    def frame(self, i: int) -> bytes:
        if self.kept[0] != i:
            data = zstandard.ZstdDecompressor().decompress(self.file.read_at(int(self.frames[i, 0]), int(self.offset[i])))
            if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.frames[i, 2]:
                raise ValueError(f"frame {i} is damaged")
            self.kept = (i, data)
        return self.kept[1]

    def ids(self, i: int) -> np.ndarray:
        """The ids of the file's i-th document."""
        a, b = int(self.begin[i]), int(self.begin[i + 1])
        kind = "<u2" if self.width == 2 else "<u4"
        if a == b:
            return np.zeros(0, kind)
        f = int(np.searchsorted(self.starts, a, side="right")) - 1
        s = a - int(self.starts[f])
        return np.frombuffer(self.frame(f)[s : s + b - a], kind)


def _write(folder: str, path: str, end_id: int):
    def run(batches):
        enc = encoder(path)
        fs, root = pafs.FileSystem.from_uri(folder)
        task = TaskContext.get().partitionId()
        name = f"part-{task:06d}-{uuid.uuid4().hex}.tok"
        with fs.open_output_stream(f"{root}/{name}") as out:
            writer = Writer(out, enc.kind().itemsize)
            end = np.array([end_id], enc.kind).tobytes()
            for b in small(batches, SLICE):
                for doc, ids in zip(b.column(0).to_pylist(), enc.encode(b.column(1))):
                    writer.add(doc, ids + end)
            total = writer.close()
        yield pa.record_batch([pa.array([task], pa.int32()), pa.array([f"{folder}/{name}"]), pa.array([len(writer.docs)], pa.int64()), pa.array([total], pa.int64())], names=["part", "file", "docs", "tokens"])

    return run


def write_tokens(docs: DataFrame, path: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Encodes and writes every text; (part, file, docs, tokens, start), a row for each file.

    Only files named in this table count: a task that is run again writes
    another file.  A null or empty text has its end id only; a null doc_id comes
    first; rows alike in doc_id come in the order of a hash of their texts.
    """
    spark = docs.sparkSession
    folder = folder or shared(spark, "tokens")
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root)
    parts = buckets(docs)
    d = with_ids(docs).repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    files = saved(d.mapInArrow(_write(folder, path, end_id), "part int, file string, docs long, tokens long"), "token-files")
    rows, start = [], 0
    for r in sorted(files.collect()):  # a row for each task
        rows.append((*r, start))
        start += r["tokens"]
    return spark.createDataFrame(rows, "part int, file string, docs long, tokens long, start long")


def _read(batches):
    for b in batches:
        for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            fs, at = pafs.FileSystem.from_uri(name)
            with fs.open_input_file(at) as file:
                r = Reader(file)
                crc = [zlib.crc32(r.ids(i).astype("<u4").tobytes()) for i in range(len(r.docs))]
                starts = start + np.r_[0, np.cumsum(r.counts)[:-1]] if len(r.docs) else r.docs
                yield pa.record_batch([pa.array(r.docs, pa.int64(), mask=r.nulls), pa.array(starts, pa.int64()), pa.array(r.counts, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    files = files.where("docs > 0").select("file", "start")
    return files.repartition(buckets(files), "file").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
