"""Packing along a space-filling curve.

1. Each document is tokenised once; its ids and its Hilbert key are written to the shared folder.  The key comes from
   the document's hashed vector (its tokens, hashed), projected to four dimensions, on a Hilbert curve of 60 bits.
2. Documents are range-sorted by key (ties by id), so that neighbours on the curve meet; copies of one text have one
   key and spread over ranges by their ids.
3. Each range fills sequences in curve order, cutting documents where a sequence ends.  What is left at the end of a
   range goes to sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, table
from .lexicon import default_path, lexicon

LENGTH, END = 4096, 2
DIMS, ORDER = 4, 15
#: Tokens of a range.
RANGE_TOKENS = 4 << 20


def hilbert(points: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Hilbert keys (int64) of integer points (rows) with ``order`` bits a dimension, by Skilling's transform (2004)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (order - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            hit = (x[i] & q) != 0
            t = np.where(hit, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(hit, p, t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (order - 1)
    while q > 1:
        t ^= np.where(x[n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for bit in range(order - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def _directions(size: int) -> np.ndarray:
    """The projection's row for each hashed token."""
    return np.random.Generator(np.random.PCG64(7)).standard_normal((size, DIMS)).astype(np.float32)


def curve_keys(vectors: np.ndarray) -> np.ndarray:
    """Keys of projected vectors: direction only, each coordinate to ORDER bits."""
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = vectors / np.where(norm > 0, norm, 1)
    return hilbert(np.clip((unit + 1) * (1 << (ORDER - 1)), 0, (1 << ORDER) - 1).astype(np.int64))


class Packer:
    """Fills sequences of ``length`` from ids in the order given; pieces are (doc, start, length, crc, total, sequence, offset)."""

    def __init__(self, first: int, length: int = LENGTH) -> None:
        self.sequence, self.length, self.used = first, length, 0
        self.open: list[tuple] = []

    def add(self, doc: int | None, data: bytes) -> Iterator[tuple]:
        total = len(data) // 4
        at = 0
        while at < total:
            n = min(self.length - self.used, total - at)
            self.open.append((doc, at, n, data[4 * at : 4 * (at + n)], total))
            at += n
            self.used += n
            if self.used == self.length:
                yield from self._close()

    def _close(self) -> Iterator[tuple]:
        from zlib import crc32

        offset = 0
        for doc, start, n, data, total in self.open:
            yield doc, start, n, crc32(data), total, self.sequence, offset
            offset += n
        self.open, self.used = [], 0
        self.sequence += 1

    def end(self) -> Iterator[tuple]:
        """The open sequence's pieces again, in sequences as long as the powers of two that its length is the sum of."""
        rest, left = self.open, self.used
        self.open, self.used = [], 0
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            while room:
                doc, start, n, data, total = rest.pop(0)
                take = min(n, room)
                self.open.append((doc, start, take, data[: 4 * take], total))
                if take < n:
                    rest.insert(0, (doc, start + take, n - take, data[4 * take :], total))
                room -= take
            yield from self._close()


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are the tokenizer's, without special tokens, then ``end``; so a null or empty text has the one
    id ``end``.  Rows repeated with one id are packed as often as they come.  A sequence is full, or as long as a
    power of two.  An empty table gives an empty result.
    """
    path = tokenizer or default_path()
    from tokenizers import Tokenizer

    size = max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values(), default=0) + 1
    kind, dtype = ("ids2", "<u2") if size <= 1 << 16 and end < 1 << 16 else ("ids4", "<u4")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, rows = lexicon(path, kind), _directions(1 << 16)
        stop = np.array([end], dtype).tobytes()
        for b in batches:
            texts, ids = b.column(1).to_pylist(), []
            vectors = np.zeros((len(texts), DIMS), np.float32)
            for i, t in enumerate(texts):
                t = t or ""
                data = lex.read(t)
                if data:
                    vectors[i] = rows[np.frombuffer(data, dtype) & 0xFFFF].sum(0)
                ids.append(data + stop)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(curve_keys(vectors), pa.int64()), pa.array([len(x) // int(dtype[2]) for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "curve", "n", "ids"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, out = Packer(TaskContext.get().partitionId() << 32, length), []

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], [x.split()[0] for x in PIECE.split(", ")])

        for b in batches:
            for doc, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out += packer.add(doc, np.frombuffer(data, dtype).astype("<u4").tobytes())
                if len(out) >= 20_000:
                    yield batch(out)
                    out = []
        out += packer.end()
        if out:
            yield batch(out)

    coded = stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(encode, "doc_id long, curve long, n long, ids binary"))
    tokens = coded.agg(F.sum("n")).first()[0] or 0
    ranges = max(1, -(-tokens // RANGE_TOKENS))
    ordered = coded.select("doc_id", "ids", "curve").repartitionByRange(ranges, "curve", "doc_id").sortWithinPartitions("curve", "doc_id", "ids")
    return ordered.select("doc_id", "ids").mapInArrow(fill, PIECE)


def op10_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
