"""Exact deduplication with an extendible-hash index on files in the shared folder.

1. Each scan task folds the equal texts it meets and writes one *entry* for each (hash key, text, largest id, rows).
2. A histogram of key prefixes drives the directory: it doubles until no bucket exceeds its capacity, buckets whose
   local depth is less than the global one being shared by several directory slots.
3. Every bucket has one owner task, which may own several.  It gets its entries sorted by key, chains those of a key,
   compares their bytes and folds equal texts; so it holds the texts of one key at a time, however large the bucket.
4. Documents look their group up by SHA-256 (and no two texts of one SHA-256 are known; two in one chain are an error).  A group's copies meet only as one entry per scan task, so no group is
   ever gathered; the lookup is a join on a unique side, which adaptive execution splits when a key is hot.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, lean, stored, table, utf8

#: Bytes of text in a bucket before it splits, and the directory's largest depth: 2**20 slots, 8 MB to broadcast.
CAPACITY, MAX_DEPTH, STEP = 32 << 20, 20, 10
#: Owner tasks at most; beyond that a task owns several buckets.
OWNERS = 1 << 15
#: Bytes of distinct texts a scan task holds before it writes them out.
SCAN_BYTES = 24 << 20


@dataclass
class Directory:
    """slots[key prefix of depth bits] is a bucket; depth_of has each bucket's local depth."""

    depth: int = 0
    slots: list[int] = field(default_factory=lambda: [0])
    depth_of: list[int] = field(default_factory=lambda: [0])

    def double(self) -> None:
        self.slots = [b for b in self.slots for _ in range(2)]
        self.depth += 1

    def split(self, bucket: int) -> int:
        """Gives the upper half of the bucket's keys to a new bucket, and its number back."""
        if self.depth_of[bucket] == self.depth:
            self.double()
        mine = [i for i, b in enumerate(self.slots) if b == bucket]
        new = len(self.depth_of)
        self.depth_of[bucket] += 1
        self.depth_of.append(self.depth_of[bucket])
        for i in mine[len(mine) // 2 :]:
            self.slots[i] = new
        return new

    @classmethod
    def built(cls, sizes: dict[int, int], depth: int, capacity: int) -> Directory:
        """The directory for bytes by key prefix of ``depth`` bits; one prefix alone is never split further."""
        d, todo = cls(), [(0, 0, 1 << depth)]
        sums = [0]
        for i in range(1 << depth):
            sums.append(sums[-1] + sizes.get(i, 0))
        leaves: list[tuple[int, int]] = []
        while todo:
            local, lo, hi = todo.pop()
            if sums[hi] - sums[lo] > capacity and hi - lo > 1:
                mid = (lo + hi) // 2
                todo += [(local + 1, mid, hi), (local + 1, lo, mid)]
            else:
                leaves.append((local, lo))
        d.depth = max(x for x, _ in leaves)
        d.slots, d.depth_of = [], []
        for local, _ in leaves:  # in key order: what repeated splits of the overfull bucket come to
            d.slots += [len(d.depth_of)] * (1 << (d.depth - local))
            d.depth_of.append(local)
        return d


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    import xxhash

    def out(held: dict) -> pa.RecordBatch:
        keys = [xxhash.xxh64_intdigest(t) for t in held]
        rows = list(held.values())
        return pa.RecordBatch.from_arrays(
            [
                pa.array([k - (1 << 64) if k >> 63 else k for k in keys], pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in held], pa.string()),
                pa.array(list(held), pa.binary()),
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([r[1] for r in rows], pa.int64()),
            ],
            ["key", "sha", "body", "top", "n"],
        )

    held: dict[bytes, list] = {}
    size = 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), utf8(b.column(1)), strict=True):
            got = held.get(t)
            if got is None:
                held[t] = [i, 1]
                size += len(t)
                if size >= SCAN_BYTES:
                    yield out(held)
                    held, size = {}, 0
            else:
                got[1] += 1
                if i is not None and (got[0] is None or i > got[0]):
                    got[0] = i
    if held:
        yield out(held)


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket or more, sorted by key: bytes compared along the chain of a key."""
    out: list[list] = []

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([e[1] for e in out], pa.string()), pa.array([e[2] for e in out], pa.int64()), pa.array([e[3] for e in out], pa.int64())], ["sha", "keep_id", "group_size"])

    def close(chain: list[list]) -> None:
        if len({e[1] for e in chain}) < len(chain):
            raise ValueError("two different texts have one SHA-256")
        out.extend([None, *e[1:]] for e in chain)  # the texts themselves are not needed any more

    now, chain = None, []
    for b in batches:
        for key, sha, body, top, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if key != now:
                close(chain)
                now, chain = key, []
                if len(out) >= 10_000:
                    yield done()
                    out.clear()
            for entry in chain:
                if entry[0] == body:
                    entry[3] += n
                    if top is not None and (entry[2] is None or top > entry[2]):
                        entry[2] = top
                    break
            else:
                chain.append([body, sha, top, n])
    close(chain)
    if out:
        yield done()


def _prefix(bits: int) -> Column:
    return F.shiftrightunsigned(F.col("key"), 64 - bits).cast("int")


def text_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(sha, keep_id, group_size) of each distinct text; the index itself."""
    entries = stored(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(_scan), "key long, sha string, body binary, top long, n long"))
    length = F.sum(F.octet_length("body") + 64).alias("size")
    sizes, depth = {0: 0}, 0
    while depth < MAX_DEPTH:  # deeper only while some prefix is overfull, and only below those
        over = [p for p, s in sizes.items() if s > capacity or not depth]
        if not over:
            break
        below = entries if not depth else entries.where(_prefix(depth).isin(over))
        found = {r.p: r.size for r in below.groupBy(_prefix(depth + STEP).alias("p")).agg(length).collect()}
        sizes = {p << STEP: s for p, s in sizes.items() if depth and p not in set(over)} | found
        depth += STEP
    d = Directory.built(sizes, depth, capacity)
    buckets = len(d.depth_of)
    if d.depth:
        slots = F.broadcast(docs.sparkSession.createDataFrame(list(enumerate(d.slots)), "slot int, bucket int"))  # 2**MAX_DEPTH rows at most
        placed = entries.join(slots, _prefix(d.depth) == F.col("slot")).drop("slot")
    else:
        placed = entries.withColumn("bucket", F.lit(0))
    dealt = placed.repartitionById(min(buckets, OWNERS), F.pmod("bucket", F.lit(OWNERS))).sortWithinPartitions("key").drop("bucket")
    return dealt.mapInArrow(lean(_own), "sha string, keep_id long, group_size long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; null counts as empty.  keep_id is the largest id of the group (null only
    if all its ids are null); kept tells whether the row's id is that one, so rows repeated with one id are kept or
    dropped together.  Other columns are ignored; an empty table gives an empty result.
    """
    found = text_groups(docs, id_col, text_col, capacity)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256).alias("text_sha256"))
    return rows.join(found, rows.text_sha256 == found.sha).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with its columns: one of each group of equal texts, repeated rows counting once."""
    sha, top, other = fresh(docs, "text_sha256", "keep_id", "sha_right")
    found = text_groups(docs, id_col, text_col).select(F.col("sha").alias(other), F.col("keep_id").alias(top))
    rows = docs.withColumn(sha, F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256))
    # By text and id: a hot text's rows spread by their ids, and the repeats of a row meet without another shuffle.
    same = (F.col(sha) == F.col(other)) & F.col(id_col).cast("long").eqNullSafe(F.col(top))
    return rows.join(found, same).dropDuplicates([other, top]).select(*docs.columns)


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id = max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))
"""
