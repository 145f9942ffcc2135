"""Token files of fixed-width bit packing.

Each id takes the fewest bits that hold the vocabulary. Ids are packed in blocks
of ``BLOCK``; the footer has the byte offset of each block and the first id of
each document, so that any range unpacks by itself with array operations:

    blocks | block offsets (u8) | doc ids (i8) | first id of each document and the end (u8) | footer (6 x u8)

The footer holds bits, block length, ids, documents, start of the offset tables,
and the magic number. Little-endian throughout.

Documents are encoded where they are read; their ids, not their texts, are then
dealt to files by ranges of doc_id.

Edge cases: null text is an empty document (its end id is still written); an
empty table writes no file and gives no row; rows with the same doc_id are
written one after another, by a hash of the text; rows without doc_id come first
and are read back without one; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, parts
from .textvec import chunks, column_bytes, give_back
from .tokens import encoder

BLOCK, MAGIC = 1 << 14, 0x314B50544B4F54  # a multiple of 8 ids, so that blocks end on bytes
FILE_BYTES, MISSING = 512 << 20, -(1 << 63)  # text of a file; the doc_id of a row without one


def width(vocabulary: int) -> int:
    """Fewest bits for ids below ``vocabulary``."""
    return max(1, int(vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Eight ids become ``bits`` bytes; the last group is filled with zeros."""
    n = len(ids)
    v = np.zeros(-(-n // 8) * 8, np.uint64)
    v[:n] = ids
    v = v.reshape(-1, 8)
    out = np.zeros((len(v), bits + 8), np.uint8)
    for j in range(8):
        at = j * bits
        x = v[:, j] << np.uint64(at & 7)
        for k in range((bits + (at & 7) + 7) // 8):
            out[:, (at >> 3) + k] |= (x >> np.uint64(8 * k)).astype(np.uint8)
    return out[:, :bits].tobytes()


def unpack_bits(raw: bytes, bits: int, begin: int, end: int) -> np.ndarray:
    """Ids begin..end-1 of one packed run, without a loop over them."""
    buf = np.frombuffer(raw + bytes(8), np.uint8)
    at = np.arange(begin, end, dtype=np.int64) * bits
    wide = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))
    return ((wide[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


class Writer:
    """Streams ids to a file that appears under its name only when closed."""

    def __init__(self, uri: str, bits: int, attempt: int):
        self.fs, self.path = _open(uri)
        self.bits = bits
        self.temp = f"{self.path}.{attempt}.tmp"
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.temp)
        self.wait: list[np.ndarray] = []
        self.waiting = self.ids = self.at = 0
        self.blocks: list[int] = []
        self.docs: list[np.ndarray] = []
        self.lens: list[np.ndarray] = []

    def add(self, docs: np.ndarray, ids: np.ndarray, lens: np.ndarray) -> None:
        self.docs.append(docs)
        self.lens.append(lens)
        self.wait.append(ids)
        self.waiting += len(ids)
        if self.waiting >= 16 * BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        v = np.concatenate(self.wait) if self.wait else np.zeros(0, np.uint32)
        to = len(v) if last else len(v) // BLOCK * BLOCK
        size = BLOCK // 8 * self.bits
        raw = pack_bits(v[:to], self.bits)
        self.blocks += range(self.at, self.at + len(raw), size)
        self.out.write(raw)
        self.at += len(raw)
        self.ids += to
        self.wait, self.waiting = [v[to:]], len(v) - to

    def close(self) -> None:
        self._flush(True)
        docs = np.concatenate(self.docs).astype("<i8")
        first = np.concatenate([[0], np.cumsum(np.concatenate(self.lens))]).astype("<u8")
        for x in (np.array(self.blocks, "<u8"), docs, first, np.array([self.bits, BLOCK, self.ids, len(docs), self.at, MAGIC], "<u8")):
            self.out.write(x.tobytes())
        self.out.close()
        self.fs.move(self.temp, self.path)


class Reader:
    """Random access to a token file."""

    def __init__(self, uri: str):
        fs, path = _open(uri)
        self.f = fs.open_input_file(path)
        size = self.f.size()
        self.bits, self.block, self.n_ids, self.n_docs, tables, magic = np.frombuffer(self.f.read_at(48, size - 48), "<u8").tolist()
        if magic != MAGIC:
            raise ValueError(f"{uri} is no token file")
        raw = self.f.read_at(size - 48 - tables, tables)
        k = -(-self.n_ids // self.block)
        self.offsets = np.frombuffer(raw, "<u8", k)
        self.docs = np.frombuffer(raw, "<i8", self.n_docs, 8 * k)
        self.first = np.frombuffer(raw, "<u8", self.n_docs + 1, 8 * (k + self.n_docs)).astype(np.int64)
        self.end = tables

    def ids(self, begin: int, end: int) -> np.ndarray:
        """Ids begin..end-1, from the blocks that hold them."""
        if begin >= end:
            return np.zeros(0, np.uint32)
        a, b = begin // self.block, (end - 1) // self.block
        at = int(self.offsets[a])
        to = int(self.offsets[b + 1]) if b + 1 < len(self.offsets) else self.end
        return unpack_bits(self.f.read_at(to - at, at), self.bits, begin - a * self.block, end - a * self.block)

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.first[i]), int(self.first[i + 1]))


KEYED = f"coalesce(cast(doc_id as long), {MISSING}) doc_id", "xxhash64(text) h"


def file_bounds(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The least (doc_id, h) of each of at most n files of about equal rows, but for the first."""
    dealt = docs.selectExpr(*KEYED).repartitionByRange(n, "doc_id", "h")
    rows = dealt.groupBy(F.spark_partition_id()).agg(F.min(F.struct("doc_id", "h")).alias("x")).select("x.*").collect()
    rows = sorted(tuple(r) for r in rows)[1:]
    return np.array([d for d, _ in rows], np.int64), np.array([h for _, h in rows], np.int64)


def file_of(doc_id: np.ndarray, h: np.ndarray, bounds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many bounds are at or under each row."""
    low, high = (np.searchsorted(bounds[0], doc_id, side) for side in ("left", "right"))
    for i in np.flatnonzero(low < high).tolist():
        low[i] += np.searchsorted(bounds[1][low[i] : high[i]], h[i], "right")
    return low.astype(np.int32)


def _encoded(docs: DataFrame, tokenizer: str, kind: str, end_id: int, bounds: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(file, doc_id, h, ids): ids with the end id as an array of ``kind``, h a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, False)
        for batch in batches:
            for part in chunks(batch, "text"):
                ids, at = enc.encode(*column_bytes(part.column("text")))
                ids, at = np.insert(ids, at[1:], np.uint32(end_id)).astype(kind), at + np.arange(len(at))
                held = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at * ids.itemsize), pa.py_buffer(ids)])
                number = file_of(part.column("doc_id").to_numpy(), part.column("h").to_numpy(), bounds)
                yield pa.record_batch([pa.array(number), part.column("doc_id"), part.column("h"), held.cast(pa.binary())], names=["file", "doc_id", "h", "ids"])
        give_back()

    return docs.selectExpr(*KEYED, "text").mapInArrow(run, "file int, doc_id long, h long, ids binary")


def write_files(docs: DataFrame, out: str, tokenizer: str, vocabulary: int, end_id: int, n: int) -> list[tuple[str, int]]:
    """Encode (doc_id, text) and write it in ascending doc_id order; (file, ids) in that order.

    One small row per file comes back to the driver. A retried task writes the
    same file again under the same name.
    """
    bits = width(vocabulary)
    kind = "<u2" if bits <= 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, ctx = None, TaskContext.get()
        name = f"{out}/part-{ctx.partitionId():06d}.tok"
        for batch in batches:
            held = batch.column("ids").cast(pa.large_binary())
            off = np.frombuffer(held.buffers()[1], np.int64, len(held) + 1, held.offset * 8)
            raw = np.frombuffer(held.buffers()[2], np.uint8)[off[0] : off[-1]] if len(held) else np.zeros(0, np.uint8)
            writer = writer or Writer(name, bits, ctx.taskAttemptId())
            writer.add(batch.column("doc_id").to_numpy(), raw.view(kind).astype(np.uint32), np.diff(off) // np.dtype(kind).itemsize)
        if writer:
            writer.close()
            yield pa.record_batch([pa.array([ctx.partitionId()]), pa.array([name]), pa.array([writer.ids])], names=["k", "file", "ids"])
        give_back()

    bounds = file_bounds(docs, n)
    dealt = _encoded(docs, tokenizer, kind, end_id, bounds).repartitionById(len(bounds[0]) + 1, "file").sortWithinPartitions("doc_id", "h")
    rows = dealt.select("doc_id", "ids").mapInArrow(run, "k long, file string, ids long").collect()
    return [(r.file, r.ids) for r in sorted(rows)]


def read_files(spark: SparkSession, files: list[tuple[str, int]]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files alone."""
    result = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not files:
        return spark.createDataFrame([], result)
    before = np.cumsum([0] + [n for _, n in files]).tolist()
    listed = spark.createDataFrame([(f, s) for (f, _), s in zip(files, before)], "file string, before long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist()):
                r = Reader(name)
                a = 0
                while a < r.n_docs:
                    b = max(a + 1, int(np.searchsorted(r.first, r.first[a] + (1 << 20), "right")) - 1)
                    first = r.first[a : b + 1]
                    raw = memoryview(r.ids(int(first[0]), int(first[-1])).astype("<u4").tobytes())
                    at = (4 * (first - first[0])).tolist()
                    crc = [zlib.crc32(raw[x:y]) for x, y in zip(at, at[1:])]
                    yield pa.record_batch([pa.array(r.docs[a:b], mask=r.docs[a:b] == MISSING), pa.array(base + first[:-1]), pa.array(np.diff(first)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                    a = b

    return listed.repartition(len(files)).mapInArrow(run, result)


def write_and_read(docs: DataFrame, tokenizer: str, vocabulary: int, end_id: int) -> DataFrame:
    """Write the corpus in doc_id order to the shared folder and read the files back."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(parts(spark), -(-total // FILE_BYTES))
    return read_files(spark, write_files(docs, new_path(spark, "token-files"), tokenizer, vocabulary, end_id, n))
